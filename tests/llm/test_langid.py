import math
import random
import zlib
from collections import Counter

import numpy as np

from tidemark.llm import langid


def test_probabilities_of_a_context_sum_to_one():
    words = ["abc", "abd", "bca", "cab", "aab", "dab"]
    m = langid.KneserNey({"x": {w: i + 1 for i, w in enumerate(words)}, "y": {"zzz": 2, "zab": 1}})
    for start in ("a", "ab", "zz", ""):
        got = np.exp([m.score([start + c])[0] if c != " " else m.score([start])[0] for c in "abcdz "])
        # the score of a word holds its closing blank: take that part away
        if start:
            base = sum(np.exp(_upto(m, start + c)) for c in "abcdz ") / np.exp(_upto(m, start))
            assert (base <= 1.0 + 1e-3).all() and (base > 0.8).all()
        assert (got > 0).all()


def _upto(m, text):
    """Log probability of the characters of " text", without a closing blank unless it ends in one."""
    grams, contexts, depth, word = langid.ngrams([text.rstrip(" ")], m.order)
    keep = len(text)
    p = np.full((len(word), len(m.languages)), m.floor)
    for n in range(m.order):
        there = depth >= n
        p[there] = langid._lookup(m.keys[n], m.probs[n], grams[n][there]) + langid._lookup(m.context_keys[n], m.weights[n], contexts[n][there]) * p[there]
    return np.log(p[:keep]).sum(axis=0)


def test_held_out_accuracy_and_edge_rows(spark, make, folder):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: r for r in langid.op10_language(spark, "/root/testdata/sf0.01").collect()}
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert rows.keys() == truth.keys()
    held = [i for i in rows if rows[i].held_out]
    assert all(rows[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in rows)
    assert np.mean([rows[i].lang_pred == truth[i] for i in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows.values())
    assert np.mean([r.rejected for r in rows.values()]) < 0.05


def test_texts_without_letters_and_empty_tables(spark, make, folder):
    d = folder(documents=make(None, "", "12 3!", "the word and", "das wort", "١"))
    rows = {r.doc_id: r for r in langid.op10_language(spark, d).collect()}
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (0, 1, 2, 5))
    assert langid.op10_language(spark, folder(documents=make("x").limit(0))).count() == 0


def test_every_language_is_learned(spark):
    # one row each: the held-back fifth would take all of a language
    rows = [(i, " ".join([chr(0x4E00 + i) * 3] * 5), f"l{i:03}") for i in range(230)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = langid.fit(docs)
    assert set(got.model.languages) == {lang for _, _, lang in rows}
    pred = {r.doc_id: r.lang_pred for r in langid.predict(docs, got).collect()}
    assert pred == {i: lang for i, _, lang in rows}


def plain_kneser_ney(samples, order, discount):
    """Interpolated Kneser-Ney with dictionaries: a function of the characters before one, and it, for each language."""
    alphabet = {c for words in samples.values() for w in words for c in f"{w} "}
    floor = 1 / max(2, len(alphabet) + 1)
    tables = {}
    for lang, words in samples.items():
        raw, begins = [Counter() for _ in range(order + 1)], [Counter() for _ in range(order + 1)]
        before = [{} for _ in range(order + 1)]
        for w, times in words.items():
            s = f" {w} "
            for end in range(1, len(s)):
                for n in range(1, min(order, end + 1) + 1):
                    g = s[end - n + 1 : end + 1]
                    raw[n][g] += times
                    if end - n >= 0:
                        before[n].setdefault(g, set()).add(s[end - n])
        counts = [{}] + [{g: raw[n][g] if n == order else len(before[n][g]) if g in before[n] else min(raw[n][g], 1) for g in raw[n]} for n in range(1, order + 1)]
        tables[lang] = counts

    def p(lang, context, c):
        out = floor
        for n in range(1, order + 1):
            if n - 1 > len(context):
                break
            left = context[len(context) - n + 1 :]
            own = {g: k for g, k in tables[lang][n].items() if g[:-1] == left}
            total = sum(own.values())
            if total:
                out = max(own.get(left + c, 0) - discount, 0) / total + discount * len(own) / total * out
        return out

    return p


def test_probabilities_match_a_plain_model():
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randrange(1, 7)))
    samples = {lang: {word(): r.randrange(1, 9) for _ in range(30)} for lang in ("x", "y", "z")}
    m = langid.KneserNey(samples)
    p = plain_kneser_ney(samples, langid.ORDER, langid.DISCOUNT)
    words = [*samples["x"], "zzz", "q", *(word() for _ in range(20))]
    got = m.score(words)
    for i, w in enumerate(words):
        s = f" {w} "
        for k, lang in enumerate(m.languages):
            want = sum(math.log(p(lang, s[max(0, end - langid.ORDER + 1) : end], s[end])) for end in range(1, len(s)))
            assert abs(got[i, k] - want) < 1e-3 * max(1, abs(want)), (w, lang)
