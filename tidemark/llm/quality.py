"""Quality classification by co-training of two views.

One classifier sees the words of a text (hashed words and word endings), the
other its page's metadata (source, language, length, and layout: lines, letter
cases, kinds of characters). Over some rounds each labels the unlabelled
documents that it is most sure of, for the other to learn from. Both are
calibrated on labelled documents, each scored by views that learned from other
ones, and the mean of their log odds is the score of every document.

Fitting takes a bounded sample, by a hash of the id: about FIT_LABELLED labelled
documents, and FIT_POOL of those without a label, which the views label for each
other (README tells what a larger pool gains). No labelled document is in the
pool. All else covers all documents and whole texts.
The threshold is that which rejects at most REJECT_GOOD of the good documents,
so scored. Null texts and texts without words score 0 and are rejected. A label
that is null is none; of several labels of a document the least counts. With no
labels of both kinds there is nothing to learn: every text with words scores 0.5
and is kept. Repeated rows give repeated rows; equal texts with equal metadata have
equal scores, and a score at the threshold is kept. Several texts of one doc_id
share its label, and are learned from in the order of their features. Long texts
take time in proportion; nothing of them is kept but counts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._shared import WorkerCache, set_aside, shipped, table, texts_of
from tidemark.llm.counts import words_by_row

#: Bounds of the fitting sample, hashed content features, rounds, and the share of the pool that a view labels in each.
FIT_LABELLED, FIT_POOL, CONTENT, ROUNDS, SHARE = 4000, 4000, 1024, 4, 0.1
#: Parts of the labelled documents, each scored for the calibration by views that learned from the others.
FOLDS = 4
REJECT_GOOD = 0.002
SOURCES, LANGS = 256, 64
#: Words that a worker remembers; longer ones than so many characters are worked out each time.
CACHE_WORDS, CACHE_LETTERS = 200_000, 64

#: Class of each byte: upper, lower, digit, blank, line end, ordinary punctuation, other sign, part of another character.
_CLASS = np.array([7 if b >= 0x80 else 0 if 65 <= b <= 90 else 1 if 97 <= b <= 122 else 2 if 48 <= b <= 57 else 4 if b == 10 else 3 if b in b" \t\r\v\f" else 5 if b in b".,;:'\"-()?" else 6 for b in range(256)], np.uint8)


def _bucket(value: str | None, buckets: int) -> int:
    return zlib.crc32((value or "").encode()) % buckets


def metadata(texts: list[str], sources: list, langs: list, row: np.ndarray, sizes: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Per document the values of the metadata view; row, sizes: each word's document and bytes, kinds: distinct words of each document."""
    n = len(texts)
    out = np.zeros((n, 16 + SOURCES + LANGS), np.float32)
    words = np.bincount(row, minlength=n)
    letters = np.bincount(row, weights=sizes, minlength=n)
    for i, (t, s, lang) in enumerate(zip(texts, sources, langs)):
        raw = np.frombuffer(t.encode(), np.uint8)
        size = max(1, len(raw))
        counts = np.bincount(_CLASS[raw], minlength=8)
        ends = np.flatnonzero(raw == 10)
        before = raw[np.maximum(ends - 1, 0)]
        out[i, :8] = counts / size
        out[i, 8:12] = np.log1p(len(t)), np.log1p(len(ends)), np.log1p(size / (len(ends) + 1)), np.isin(before, (46, 33, 63)).mean() if len(ends) else 1.0
        # signs that stand in a row
        signs = _CLASS[raw] == 6
        out[i, 12] = (signs[1:] & signs[:-1]).sum() / size
        out[i, 16 + _bucket(s, SOURCES)] = 1
        out[i, 16 + SOURCES + _bucket(lang, LANGS)] = 1
    out[:, 13] = letters / np.maximum(words, 1)
    out[:, 14] = kinds / np.maximum(words, 1)
    out[:, 15] = np.log1p(words)
    return out


class _Features:
    """Views of batches; what a word hashes to is remembered."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[int, int, int]] = {}

    def _of(self, word: str) -> tuple[int, int, int]:
        raw = word.encode()
        return zlib.crc32(raw) % (CONTENT // 2), CONTENT // 2 + zlib.crc32(raw[-3:], 1) % (CONTENT // 2), len(raw)

    def views(self, b: pa.RecordBatch) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray, np.ndarray]:
        """Content as (document, feature, share of the words), metadata, and the number of words."""
        n = b.num_rows
        row, words = words_by_row(b.column("text"))
        coded = words.dictionary_encode()
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        own, of = self.known, self._of
        each = np.array([own.get(w) or (own.setdefault(w, of(w)) if len(w) <= CACHE_LETTERS else of(w)) for w in coded.dictionary.to_pylist()], np.int64).reshape(-1, 3)
        codes = coded.indices.to_numpy().astype(np.int64)
        total = np.bincount(row, minlength=n)
        flat = np.concatenate([row * CONTENT + each[codes, 0], row * CONTENT + each[codes, 1]])
        cells, counts = np.unique(flat, return_counts=True)
        document, feature = cells // CONTENT, cells % CONTENT
        share = np.sqrt(counts / np.maximum(total, 1)[document]).astype(np.float32)
        kinds = np.bincount(np.unique(row * (len(each) + 1) + codes) // (len(each) + 1), minlength=n) if len(row) else np.zeros(n)
        meta = metadata(texts_of(b), b.column("source").to_pylist(), b.column("lang").to_pylist(), row, each[codes, 2], kinds)
        return (document, feature, share), meta, total


class Logistic:
    """Ridge logistic regression on columns scaled to unit deviation."""

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 80, ridge: float = 1e-3) -> Logistic:
        self.mean, deviation = x.mean(axis=0), x.std(axis=0)
        self.scale = (1 / np.maximum(deviation, 1e-3) * (deviation > 0)).astype(np.float32)
        z = (x - self.mean) * self.scale
        weight = weight / weight.sum()
        w, b = np.zeros(x.shape[1], np.float32), float(np.log((weight @ y + 1e-3) / (weight @ (1 - y) + 1e-3)))
        moment, power, bm, bp = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
        for t in range(1, steps + 1):
            p = 1 / (1 + np.exp(-np.clip(z @ w + b, -30, 30)))
            g = (weight * (p - y)).astype(np.float32)
            gw, gb = z.T @ g + ridge * w, float(g.sum())
            moment, power = 0.9 * moment + 0.1 * gw, 0.99 * power + 0.01 * gw * gw
            bm, bp = 0.9 * bm + 0.1 * gb, 0.99 * bp + 0.01 * gb * gb
            rate = 0.05 / (1 + t / 60)
            w = w - rate * (moment / (1 - 0.9**t)) / (np.sqrt(power / (1 - 0.99**t)) + 1e-8)
            b -= rate * (bm / (1 - 0.9**t)) / (np.sqrt(bp / (1 - 0.99**t)) + 1e-8)
        self.weights = (w * self.scale).astype(np.float32)
        self.bias = float(b - self.mean @ self.weights)
        return self

    def logits(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias


def _platt(logits: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that make logits calibrated; targets are drawn in a little, so that separable data stay finite."""
    good, bad = y.sum(), (1 - y).sum()
    target = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    a, c = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * logits + c, -30, 30)))
        d, h = p - target, np.maximum(p * (1 - p), 1e-6)
        x = np.stack([logits, np.ones_like(logits)])
        step = np.linalg.solve((x * h) @ x.T + 1e-6 * np.eye(2), x @ d)
        a, c = a - np.clip(step[0], -1, 1), c - np.clip(step[1], -1, 1)
    return float(max(a, 1e-3)), float(c)


def co_trained(x: list[np.ndarray], y: np.ndarray, fitted: np.ndarray) -> list[Logistic]:
    """Both views after all rounds. ``x``: their values; ``y``: 0, 1 or -1 where there is no label; ``fitted``: the labelled rows to learn from."""
    pool = np.flatnonzero(y < 0)
    prior = y[fitted].mean()
    given: list[dict[int, int]] = [{}, {}]
    views = [Logistic(), Logistic()]
    for k in range(ROUNDS + 1):
        logits = []
        for v in (0, 1):
            own = np.array(sorted(given[v]), np.int64)
            rows = np.concatenate([fitted, own])
            labels = np.concatenate([y[fitted], [given[v][i] for i in own]]).astype(np.float32)
            weight = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-3), 0.5 / max(1 - labels.mean(), 1e-3)) * np.concatenate([np.ones(len(fitted)), np.full(len(own), 0.5)])
            views[v].fit(x[v][rows], labels, weight)
            logits.append(views[v].logits(x[v][pool]) if len(pool) else np.empty(0))
        if k == ROUNDS or not len(pool):
            break
        for v in (0, 1):
            order = np.argsort(logits[v], kind="stable")
            most = max(2, int(SHARE * len(pool)))
            bad = max(1, round(most * (1 - prior)))
            for i in order[:bad]:
                if logits[v][i] < -1:
                    given[1 - v][int(pool[i])] = 0
            for i in order[::-1][: most - bad]:
                if logits[v][i] > 1:
                    given[1 - v][int(pool[i])] = 1
    return views


class Model:
    def __init__(self) -> None:
        self.content: Logistic | None = None

    def co_train(self, x: list[np.ndarray], y: np.ndarray, fold: np.ndarray) -> Model:
        """Views of all labelled rows, calibrated on what views of the other folds make of each fold."""
        labelled = np.flatnonzero(y >= 0)
        self.content, self.meta = co_trained(x, y, labelled)
        held, logits = [], [[], []]
        for f in range(FOLDS):
            own, others = labelled[fold[labelled] == f], labelled[fold[labelled] != f]
            if len(own) and len(set(y[others])) == 2:
                held.append(own)
                for v, view in enumerate(co_trained(x, y, others)):
                    logits[v].append(view.logits(x[v][own]))
        # with no label to spare, on what was learned from
        rows = np.concatenate(held) if held else labelled
        both = [np.concatenate(s) for s in logits] if held else [self.content.logits(x[0][rows]), self.meta.logits(x[1][rows])]
        self.shape = [_platt(s, y[rows]) for s in both]
        combined = np.sort(self.combine(*both)[2][y[rows] == 1])
        least = float(combined[int(REJECT_GOOD * len(combined))]) if len(combined) else 0.5
        # where even the poorest good documents score high, half of that margin is left to those not seen
        self.threshold = min(least, (0.5 + least) / 2)
        return self

    def combine(self, content: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z = [np.clip(a * s.astype(np.float64) + c, -30, 30) for (a, c), s in zip(self.shape, (content, meta))]
        p = [1 / (1 + np.exp(-v)) for v in (*z, (z[0] + z[1]) / 2)]
        return p[0], p[1], p[2]


_made = WorkerCache()


def _features() -> _Features:
    _made.mine()
    if "features" not in _made:
        _made["features"] = _Features()
    return _made["features"]


def _share(column: str, salt: int, share: float):
    return F.pmod(F.xxhash64(column, F.lit(salt)), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30))


def fit(docs: DataFrame, labels: DataFrame, fit_labelled: int = FIT_LABELLED, fit_pool: int = FIT_POOL) -> Model:
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in ("text", "source", "lang")))
    known = labels.where("doc_id is not null and quality is not null").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    n, total = known.count(), docs.count()
    sample = known.where(_share("doc_id", 11, fit_labelled / max(n, 1))).groupBy("doc_id").agg(F.min("quality").cast("int").alias("y"))
    pooled = _share("doc_id", 13, fit_pool / max(total, 1))
    # what has a label is never in the pool: neither is its label guessed, nor is what is held back learned from
    pool = docs.where(pooled).join(known.where(pooled).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns).withColumn("y", F.lit(-1))
    # the sample's size is bounded by a parameter
    rows = docs.join(F.broadcast(sample), "doc_id").select(*pool.columns).union(pool)

    def views(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _features()
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                (document, feature, share), meta, _ = own.views(part)
                cuts = np.searchsorted(document, np.arange(part.num_rows + 1))
                spans = list(zip(cuts[:-1], cuts[1:]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("y"), pa.array([feature[s:e].astype(np.uint16).tobytes() for s, e in spans], pa.binary()), pa.array([share[s:e].tobytes() for s, e in spans], pa.binary()), pa.array([m.tobytes() for m in meta], pa.binary())],
                    names=["doc_id", "y", "features", "shares", "meta"],
                )

    got = rows.select("doc_id", "text", "source", "lang", "y").transform(shipped).mapInArrow(views, "doc_id bigint, y int, features binary, shares binary, meta binary").orderBy("doc_id", "y", "features", "shares", "meta").toArrow()
    y = got["y"].to_numpy()
    if not {0, 1} <= set(y.tolist()):
        return Model()
    content = np.zeros((len(y), CONTENT), np.float32)
    for i, (f, s) in enumerate(zip(got["features"].to_pylist(), got["shares"].to_pylist())):
        content[i, np.frombuffer(f, np.uint16)] = np.frombuffer(s, np.float32)
    meta = np.stack([np.frombuffer(m, np.float32) for m in got["meta"].to_pylist()])
    fold = np.array([zlib.crc32(b"back%d" % (i or 0)) % FOLDS for i in got["doc_id"].to_pylist()])
    return Model().co_train([content, meta], y, fold)


SCORED = "p_content double, p_meta double, score double, keep boolean"


def kept(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the model keeps, with their columns."""
    own, back = set_aside(docs, {"p_content", "p_meta", "score", "keep"})
    return classify(own, model).where("keep").drop("p_content", "p_meta", "score", "keep").withColumnsRenamed(back)


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with p_content, p_meta, score and keep."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, features = sent.value, _features()
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                (document, feature, share), meta, words = features.views(b)
                some = words > 0
                if own.content is None:
                    p = [np.where(some, 0.5, 0.0)] * 3
                    keep = some
                else:
                    content = np.bincount(document, weights=share * own.content.weights[feature], minlength=b.num_rows) + own.content.bias
                    p = [np.where(some, v, 0.0) for v in own.combine(content, own.meta.logits(meta))]
                    keep = some & (p[2] >= own.threshold)
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *(pa.array(v, pa.float64()) for v in p), pa.array(keep)], names=[*names, "p_content", "p_meta", "score", "keep"])

    return docs.transform(shipped).mapInArrow(run, f"{fields}, {SCORED}")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return classify(docs.select("doc_id", "text", "source", "lang"), model).select("doc_id", "p_content", "p_meta", "score", "keep")
