"""Benchmark decontamination with a generalised suffix automaton.

The normalised test items become one suffix automaton over word numbers, built
on the driver and sent as flat arrays; the texts stream through it and each
position carries the length of the longest match that ends there. Words that no
item has break a match, so only runs of known words enter the automaton.

Bound of what is sent: the executors deal the items into blocks of at most
BLOCK_WORDS words (an item is never divided), each block has an automaton of at
most two states a word, and HELD_BLOCKS of them are sent and held at a time. All
texts meet all blocks: with more blocks than that the texts go through in several
passes, written in between, so that a task builds each automaton once.

Null and empty texts have no words, hits or items; long ones take time in
proportion to their words. Items without words and items of null id are passed
over; equal items of different ids all count, and are noted once a document
however often they occur. Repeated document rows give repeated rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._shared import WorkerCache, set_aside, shipped, stored, table, texts_of

WINDOW = 13
#: A document is contaminated from this share of hit words: one in so many.
COVERAGE = 20
#: Words of test items in one automaton, and automata that a worker keeps.
BLOCK_WORDS, HELD_BLOCKS = 1_000_000, 2
#: Bytes of UTF-8 that are no word's, as blanks; A to Z as a to z.
FOLD = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(FOLD).split()


class Automaton:
    """Suffix automaton of word sequences with the items of each window.

    ``starts[s]`` tells which items have the window that state s stands for, and
    ``whole[s]`` the items shorter than a window that end in s, with their length.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> None:
        self.window, self.items = window, [i for i, _ in items]
        self.number: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [[self.number.setdefault(w, len(self.number)) for w in words] for _, words in items]
        for sequence in coded:
            last = 0
            for w in sequence:
                last = self._extend(last, w)
        self.windows: dict[int, list[int]] = {}
        self.whole: dict[int, list[tuple[int, int]]] = {}
        for k, sequence in enumerate(coded):
            state = matched = 0
            for w in sequence:
                state, matched = self.step(state, matched, w)
                if matched >= window:
                    held = self.windows.setdefault(self.at_window(state), [])
                    if not held or held[-1] != k:
                        held.append(k)
            if 0 < len(sequence) < window:
                while self.length[self.link[state]] >= len(sequence):
                    state = self.link[state]
                self.whole.setdefault(state, []).append((len(sequence), k))
        #: The nearest state with whole items on the way up, itself included.
        self.above = [-1] * len(self.link)
        for s in sorted(range(len(self.link)), key=self.length.__getitem__):
            self.above[s] = s if s in self.whole else self.above[self.link[s]] if s else -1
        self.shortest = min([window, *(len(s) for s in coded if s)])
        #: Of whole items by state: their sizes from the longest, and all of them.
        self.sizes = {s: sorted({size for size, _ in held}, reverse=True) for s, held in self.whole.items()}
        self.names = {s: {k for _, k in held} for s, held in self.whole.items()}

    def _extend(self, last: int, w: int) -> int:
        """The state of the item so far and w; items share states, so that w may follow already."""
        nexts, link, length = self.next, self.link, self.length
        if w in nexts[last]:
            q = nexts[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        made = len(link)
        nexts.append({}), link.append(0), length.append(length[last] + 1)
        p = last
        while p >= 0 and w not in nexts[p]:
            nexts[p][w] = made
            p = link[p]
        if p >= 0:
            q = nexts[p][w]
            link[made] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return made

    def _clone(self, p: int, w: int, q: int) -> int:
        nexts, link, length = self.next, self.link, self.length
        made = len(link)
        nexts.append(dict(nexts[q])), link.append(link[q]), length.append(length[p] + 1)
        link[q] = made
        while p >= 0 and nexts[p].get(w) == q:
            nexts[p][w] = made
            p = link[p]
        return made

    def step(self, state: int, matched: int, w: int) -> tuple[int, int]:
        """The longest match that ends with w, after one that ended before it."""
        nexts = self.next
        if w in nexts[state]:
            return nexts[state][w], matched + 1
        while state and w not in nexts[state]:
            state = self.link[state]
        if w in nexts[state]:
            matched = self.length[state] + 1
            return nexts[state][w], matched
        return 0, 0

    def at_window(self, state: int) -> int:
        """The state of the last ``window`` words of a match at least so long."""
        link, length = self.link, self.length
        while length[link[state]] >= self.window:
            state = link[state]
        return state

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans [start, end) of words that windows cover, joined where they touch, and the items found."""
        n = len(words)
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        noted: set[int] = set()
        if n < self.shortest:
            return spans, found
        coded = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, n)
        known = np.flatnonzero(np.diff(np.concatenate(([0], coded >= 0, [0]))))
        begins, ends = known[::2], known[1::2]
        window, step = self.window, self.step
        for a, b in zip(begins, ends):
            if b - a < self.shortest:
                continue
            state = matched = 0
            for i, w in enumerate(coded[a:b].tolist(), int(a)):
                state, matched = step(state, matched, w)
                reach = 0
                if matched >= window:
                    reach = window
                    at = self.at_window(state)
                    if ~at not in noted:
                        noted.add(~at)
                        found.update(self.windows[at])
                up = self.above[state]
                while up > 0:
                    # of the state itself the match may be shorter than its items; further up all fit
                    fits = next((x for x in self.sizes[up] if x <= matched), 0)
                    reach = max(reach, fits)
                    if fits == self.sizes[up][0]:
                        if up not in noted:
                            noted.add(up)
                            found |= self.names[up]
                    elif fits:
                        found.update(k for size, k in self.whole[up] if size <= matched)
                    up = self.above[self.link[up]]
                if reach:
                    start = i + 1 - reach
                    while spans and start <= spans[-1][1]:
                        start = min(start, spans.pop()[0])
                    spans.append((start, i + 1))
        return spans, found


def blocks_of(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, list[str]]:
    """The items with the block that each belongs to, and the blocks' names."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).where("item is not null and text is not null").distinct()
    # a word has at least one byte, and a blank after it
    most = rows.agg(F.sum(F.floor(F.octet_length("text") / 2) + 1)).first()[0] or 0

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, size = "", 0
        for b in batches:
            blocks, keep = [], []
            for t in b.column("text").to_pylist():
                n = len(words_of(t))
                keep.append(n > 0)
                if not name or (size and size + n > block_words):
                    name, size = uuid.uuid4().hex, 0
                size += n
                blocks.append(name)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(blocks, pa.string())], names=["item", "text", "block"]).filter(pa.array(keep))

    dealt = stored(rows.repartition(max(1, int(most // block_words) + 1)).transform(shipped).mapInArrow(deal, "item string, text string, block string"), "items")
    return dealt, sorted(r.block for r in dealt.select("block").distinct().collect())


_built = WorkerCache()


def automaton(name: str, items: list, window: int) -> Automaton:
    key = (name, window)
    _built.mine()
    if key not in _built:
        while len(_built) >= HELD_BLOCKS:
            # the one that was built first
            del _built[next(iter(_built))]
        _built[key] = Automaton([(i, words_of(t)) for i, t in items], window)
    return _built[key]


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans in order, those that meet or touch as one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


Finish = Callable[[pa.RecordBatch, list[list[bytes]], list[list[tuple[int, int]]], list[set[str]]], pa.RecordBatch]


def searched(docs: DataFrame, benchmark: DataFrame, window: int, finish: Finish, schema: object, block_words: int = BLOCK_WORDS, held: int = HELD_BLOCKS) -> DataFrame:
    """What ``finish`` makes of batches of ``docs``, their texts' words, hit spans, and items found.

    In each pass the texts meet ``held`` blocks; what was found so far goes with
    them as two more columns.
    """
    items, names = blocks_of(benchmark, block_words)
    own, fields = docs.columns, docs.schema.fields

    def a_pass(df: DataFrame, blocks: list[str], last: bool) -> DataFrame:
        rows = items.where(F.col("block").isin(blocks)).toArrow().to_pylist()
        sent = df.sparkSession.sparkContext.broadcast({n: [(r["item"], r["text"]) for r in rows if r["block"] == n] for n in blocks})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 2000):
                    b = whole.slice(at, 2000)
                    documents = [words_of(t) for t in texts_of(b)]
                    if "_spans" in b.schema.names:
                        spans = [list(zip(x[::2], x[1::2])) for x in b.column("_spans").to_pylist()]
                        found = [set(x) for x in b.column("_items").to_pylist()]
                    else:
                        spans, found = [[] for _ in documents], [set() for _ in documents]
                    for n in blocks:
                        a = automaton(n, sent.value[n], window)
                        for k, words in enumerate(documents):
                            new, which = a.match(words)
                            if new:
                                spans[k] = joined(spans[k] + new) if spans[k] else new
                                found[k] |= {a.items[i] for i in which}
                    if last:
                        yield finish(b.select(own), documents, spans, found)
                    else:
                        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in own), pa.array([[v for span in x for v in span] for x in spans], pa.list_(pa.int64())), pa.array([sorted(x) for x in found], pa.list_(pa.string()))], names=[*own, "_spans", "_items"])

        middle = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "_spans array<bigint>", "_items array<string>"])
        return df.transform(shipped).mapInArrow(run, schema if last else middle)

    groups = [names[at : at + held] for at in range(0, len(names), held)] or [[]]
    for group in groups[:-1]:
        docs = stored(a_pass(docs, group, False), "searched")
    return a_pass(docs, groups[-1], True)


REPORT = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: int = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document the counts of words, of hit words and of items found."""

    def finish(b, documents, spans, found):
        n = [len(w) for w in documents]
        hit = [sum(e - s for s, e in x) for x in spans]
        digests = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in found]
        bad = [h > 0 and coverage * h >= w for h, w in zip(hit, n)]
        return pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(x) for x in found], pa.int64()), pa.array(digests, pa.string()), pa.array(bad, pa.bool_())],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )

    return searched(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), benchmark, window, finish, REPORT, block_words)


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words in ``spans`` and what lies between them."""
    if not spans:
        return text
    raw = text.encode()
    bounds = np.diff(np.concatenate(([0], np.frombuffer(raw.translate(FOLD), np.uint8) != 0x20, [0])))
    begins, ends = np.flatnonzero(bounds == 1), np.flatnonzero(bounds == -1)
    out, at = [], 0
    for s, e in spans:
        out.append(raw[at : begins[s]])
        at = int(ends[e - 1])
    return b"".join([*out, raw[at:]]).decode()


def remove_passages(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, drop_share: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents without the passages that windows cover.

    Documents of which at least ``drop_share`` of the words are hit go as a whole.
    ``n_chars`` follows the text; all other columns pass through.
    """
    docs, back = set_aside(docs, {"_spans", "_items"})
    names = docs.columns

    def finish(b, documents, spans, found):
        texts = b.column("text").to_pylist()
        keep = [not s or sum(e - a for a, e in s) < drop_share * len(w) for s, w in zip(spans, documents)]
        cut = [None if t is None else cut_spans(t, s) for t, s in zip(texts, spans)]
        columns = [pa.array(cut, pa.string()) if n == "text" else b.column(n) for n in names]
        if "n_chars" in names:
            old = b.column("n_chars").to_pylist()
            columns[names.index("n_chars")] = pa.array([len(c) if s and c is not None else o for c, s, o in zip(cut, spans, old)], b.schema.field("n_chars").type)
        return pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep))

    return searched(docs, benchmark, window, finish, docs.schema, block_words).withColumnsRenamed(back)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: DuckDB. Windows as joined words; a hit window marks its positions, counted once.
OP2_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
i AS (
  SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
iw AS (
  SELECT DISTINCT item, least(len(w), 13) AS k, array_to_string(w[p : p + least(len(w), 13) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM iw),
dw AS (
  SELECT r, k, p, array_to_string(w[p : p + k - 1], ' ') AS g
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, ks WHERE len(w) >= k)),
m AS (SELECT r, p, iw.k, item FROM dw JOIN iw ON dw.k = iw.k AND dw.g = iw.g),
h AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS q FROM m) GROUP BY r),
f AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM m GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN f USING (r)
"""
