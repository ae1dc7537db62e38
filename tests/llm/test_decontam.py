import hashlib
import random
import re

import duckdb
from pyspark.sql import types as T

from tidemark.llm import decontam

ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])


def words(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def brute(docs, items, window=13):
    grams = {}
    for i, t in items:
        w = words(t)
        if i is not None and w:
            k = min(len(w), window)
            for p in range(len(w) - k + 1):
                grams.setdefault(tuple(w[p : p + k]), set()).add(str(i))
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for k in {len(g) for g in grams}:
            for p in range(len(w) - k + 1):
                if got := grams.get(tuple(w[p : p + k])):
                    hit |= set(range(p, p + k))
                    found |= got
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_random_texts_match_brute_force(spark, make, folder):
    r = random.Random(3)
    pick = lambda n, v="abcé": " ".join(r.choice(v) for _ in range(n))
    items = [(i, pick(r.choice([1, 2, 3, 5, 12, 13, 14, 20, 30]), "abcdeé")) for i in range(25)]
    items[0:3] = [(0, "a"), (1, "b a"), (2, "b A!")]
    items += [(99, None), (98, ""), (None, "c c c"), (97, items[10][1])]
    texts = [None, "", "...", "A", *(pick(r.randrange(60), "abcdxé") for _ in range(40))]
    texts += [pick(7) + ", " + items[k][1].upper() + " ; " + pick(9, "xyz") for k in range(3, 25)] * 2
    docs = make(*texts)
    d = folder(documents=docs, benchmark=spark.createDataFrame(items, ITEMS))
    got = sorted((tuple(x) for x in decontam.op2_decontaminate(spark, d).collect()), key=str)
    assert got == brute(list(enumerate(texts)), items)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{d}/{t}.parquet/*.parquet'")
    assert sorted(con.sql(decontam.OP2_SQL).fetchall(), key=str) == got


def test_many_blocks_give_what_one_gives(spark, make):
    """Five blocks and more go in several passes, each of no more automata than are held."""
    r = random.Random(5)
    pick = lambda n: " ".join(r.choice("abcd") for _ in range(n))
    items = spark.createDataFrame([(i, pick(r.choice([2, 13, 15, 20]))) for i in range(14)] + [(20, "a"), (21, "A."), (22, None)], ITEMS)
    docs = make(*(pick(80) for _ in range(20)), None, "")
    one = sorted(decontam.report(docs, items).collect())
    dealt, names = decontam.blocks_of(items, 30)
    sizes = {x.block: x.n for x in dealt.rdd.map(lambda x: (x.block, len(decontam.words_of(x.text)))).reduceByKey(int.__add__).toDF(["block", "n"]).collect()}
    assert len(names) >= 5 and set(sizes) == set(names) and max(sizes.values()) <= 30
    assert sorted(decontam.report(docs, items, block_words=30).collect()) == one
    cleaned = sorted(decontam.remove_passages(docs, items).collect())
    assert sorted(decontam.remove_passages(docs, items, block_words=30).collect()) == cleaned


def test_a_block_is_built_once_while_it_is_held():
    built = []
    for name in ("a", "b", "a", "b"):
        built.append(decontam.automaton(name, [("1", "x y")], 13))
    assert built[0] is built[2] and built[1] is built[3] and decontam.HELD_BLOCKS == 2


def test_passages_go_and_the_rest_stays(spark, make):
    item = " ".join(f"w{i}" for i in range(20))
    items = spark.createDataFrame([(1, item)], ITEMS)
    clean = " ".join(f"k{i}" for i in range(40))
    docs = make(clean, f"{clean}. {item}! {clean}", item, None, "")
    rows = {x.doc_id: x for x in decontam.remove_passages(docs, items).collect()}
    assert sorted(rows) == [0, 1, 3, 4]
    assert rows[0].text == clean and rows[1].text == f"{clean}. ! {clean}" and rows[1].n_chars == len(rows[1].text)
    assert rows[3].text is None and rows[4].text == ""


def test_empty_tables(spark, make, folder):
    d = folder(documents=make("a b").limit(0), benchmark=spark.createDataFrame([], ITEMS))
    assert decontam.op2_decontaminate(spark, d).count() == 0
    d = folder(documents=make("a b"), benchmark=spark.createDataFrame([], ITEMS))
    assert decontam.op2_decontaminate(spark, d).collect()[0].n_hit == 0
