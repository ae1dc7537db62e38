"""Language identification by interpolated Kneser-Ney character models.

Each language has a model of characters within words, words taken with a blank
before and after them. The n-grams of all orders and all languages lie in sorted
arrays of 64-bit hashes, one row of values per language beside each: the
discounted probability of an n-gram, and the weight that its context leaves to
the next lower order. A text's language is that of the lowest cross-entropy a
character; the score is the winner's share of the probabilities per word,
calibrated on held-back training documents, and texts under the calibrated
threshold are marked as rejected.

Fitting takes a bounded sample: documents of a language with hashes under
FIT_DOCS over its count and FIT_CHARS over its characters, so about FIT_DOCS of
each, and no more than FIT_CHARS characters but for one long document; counts of
languages cover all rows, and all languages are learned. Everything else covers all documents and whole texts. Null texts and
texts without a letter are ``und`` with score 0; without training documents all
are. Ties take the language first in order. Repeated rows give repeated rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._shared import WorkerCache, crc_of_id, shipped, table
from tidemark.llm.counts import words_by_row

ORDER = 4
#: Documents of a language that its model is fitted on, about.
FIT_DOCS = 400
#: Characters of a language that its model is fitted on, about.
FIT_CHARS = 2_000_000
DISCOUNT = 0.75
#: Share of right held-back documents that a rejection may cost.
REJECT_RIGHT = 0.005
CACHE_WORDS = 300_000
#: Values of words by languages that are kept, and that are scored at once.
CACHE_CELLS, SCORE_CELLS = 60_000_000, 4_000_000
#: Characters of remembered words (in scripts without blanks a word may be a sentence).
CACHE_CHARS = 4_000_000
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    h = (h ^ c) * _PRIME
    return h ^ (h >> np.uint64(29))


def _characters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all words, each between blanks, and the word of each."""
    joined = "".join(f" {w} " for w in words)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
    return points, np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)) + 2)


def ngrams(words: list[str], order: int = ORDER) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray]:
    """For each order n the hash of the n-gram that ends at each character but a word's first, and of its context; which exist; the word.

    Contexts don't reach over a word's first blank.
    """
    points, word = _characters(words)
    first = np.concatenate(([True], word[1:] != word[:-1])) if len(word) else np.empty(0, bool)
    place = np.arange(len(word)) - np.maximum.accumulate(np.where(first, np.arange(len(word)), 0)) if len(word) else np.empty(0, np.int64)
    ends = np.flatnonzero(~first)
    grams, contexts, depth = [], [], place[ends]
    for n in range(1, order + 1):
        h = np.full(len(ends), n, np.uint64)
        for back in range(n - 1, 0, -1):
            h = _mix(h, points[np.maximum(ends - back, 0)])
        contexts.append(h)
        grams.append(_mix(h ^ np.uint64(0xABCDEF), points[ends]))
    return grams, contexts, depth, word[ends]


def _lookup(keys: np.ndarray, values: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Rows of ``values`` for hashes ``h`` in sorted ``keys``; the last row where there is none."""
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return values[np.where(keys[at] == h, at, len(keys))]


class KneserNey:
    """Models of several languages over shared sorted arrays."""

    def __init__(self, samples: dict[str, dict[str, int]], order: int = ORDER) -> None:
        """``samples``: for each language its words with their counts."""
        self.languages, self.order = sorted(samples), order
        per: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = []
        for language in self.languages:
            words = sorted(samples[language])
            weights = np.array([samples[language][w] for w in words], np.float64)
            grams, contexts, depth, word = ngrams(words, order)
            per.append([])
            for n in range(1, order + 1):
                there = depth >= n - 1
                g, at = np.unique(grams[n - 1][there], return_index=True)
                counts = np.zeros(len(g))
                np.add.at(counts, np.searchsorted(g, grams[n - 1][there]), weights[word[there]])
                if n < order:
                    # lower orders count the distinct characters that come before
                    higher = depth >= n
                    lower = {}
                    pairs = np.unique(np.stack([grams[n][higher], grams[n - 1][higher]]), axis=1)[1]
                    names, kinds = np.unique(pairs, return_counts=True)
                    lower = np.zeros(len(g))
                    lower[np.searchsorted(g, names)] = kinds
                    # n-grams at a word's beginning have no character before them: their own counts stand in
                    counts = np.where(lower > 0, lower, np.minimum(counts, 1))
                per[-1].append((g, contexts[n - 1][there][at], counts))
        self.keys, self.probs, self.context_keys, self.weights = [], [], [], []
        size = len(self.languages)
        alphabet = max(2, len(np.unique(np.concatenate([p[0][0] for p in per]))) + 1)
        self.floor = 1.0 / alphabet
        for n in range(order):
            keys = np.unique(np.concatenate([p[n][0] for p in per]))
            context_keys = np.unique(np.concatenate([p[n][1] for p in per]))
            probs = np.zeros((len(keys) + 1, size), np.float32)
            weights = np.ones((len(context_keys) + 1, size), np.float32)
            for k, p in enumerate(per):
                g, c, counts = p[n]
                at = np.searchsorted(context_keys, c)
                total = np.bincount(at, weights=counts, minlength=len(context_keys))
                kinds = np.bincount(at, minlength=len(context_keys))
                probs[np.searchsorted(keys, g), k] = np.maximum(counts - DISCOUNT, 0) / total[at]
                seen = total > 0
                weights[:-1, k][seen] = DISCOUNT * kinds[seen] / total[seen]
            self.keys.append(keys), self.probs.append(probs), self.context_keys.append(context_keys), self.weights.append(weights)

    def score(self, words: list[str]) -> np.ndarray:
        """Per word and language the natural log probability of its characters and closing blank."""
        grams, contexts, depth, word = ngrams(words, self.order)
        p = np.full((len(word), len(self.languages)), self.floor, np.float32)
        for n in range(self.order):
            there = depth >= n
            mixed = _lookup(self.keys[n], self.probs[n], grams[n][there]) + _lookup(self.context_keys[n], self.weights[n], contexts[n][there]) * p[there]
            p[there] = mixed
        logs = np.log(p)
        out = np.zeros((len(words), len(self.languages)))
        for k in range(len(self.languages)):
            out[:, k] = np.bincount(word, weights=logs[:, k], minlength=len(words))
        return out


class _Scorer:
    """Scores rows of words, each distinct word once while it is remembered."""

    def __init__(self, model: KneserNey) -> None:
        self.model, self.known, self.values, self.chars = model, {}, np.zeros((0, len(model.languages))), 0

    def rows(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Per text and language the log probability; per text the number of characters."""
        row, words = words_by_row(pc.utf8_lower(pc.fill_null(texts, "")))
        n = len(texts)
        sums = np.zeros((n, len(self.model.languages)))
        if not len(row):
            return sums, np.zeros(n)
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        languages = len(self.model.languages)
        if len(self.known) > min(CACHE_WORDS, CACHE_CELLS // languages) or self.chars > CACHE_CHARS:
            self.known, self.values, self.chars = {}, self.values[:0], 0
        new = [w for w in distinct if w not in self.known]
        if new:
            self.known |= {w: len(self.values) + i for i, w in enumerate(new)}
            self.chars += sum(map(len, new))
            step = max(1, min(20_000, SCORE_CELLS // languages))
            self.values = np.concatenate([self.values, *(self.model.score(new[at : at + step]) for at in range(0, len(new), step))])
        each = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy()]
        for k in range(sums.shape[1]):
            sums[:, k] = np.bincount(row, weights=self.values[each, k], minlength=n)
        size = np.fromiter(map(len, distinct), np.int64, len(distinct))[coded.indices.to_numpy()] + 1
        return sums, np.bincount(row, weights=size, minlength=n)


def _confidence(sums: np.ndarray, chars: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """The winner and its share, with differences of cross-entropy a character times ``scale``."""
    per = sums / np.maximum(chars, 1)[:, None]
    best = per.argmax(axis=1)
    odds = np.exp(scale * (per - per.max(axis=1, keepdims=True)))
    return best, (1 / odds.sum(axis=1))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.pmod(crc_of_id(doc_id), F.lit(4)) == 2


class Identifier:
    """A fitted model, the scale of its scores, and the threshold under which texts are rejected."""

    def __init__(self, model: KneserNey | None, scale: float = 20.0, threshold: float = 0.0) -> None:
        self.model, self.scale, self.threshold = model, scale, threshold


def fit(docs: DataFrame, fit_docs: int = FIT_DOCS) -> Identifier:
    """Models of the languages in ``docs`` (doc_id, text, lang), which are all there is to learn from."""
    labelled = docs.where("lang is not null and text is not null")
    counts = {r.lang: (r["n"], r["chars"]) for r in labelled.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.char_length("text")).alias("chars")).collect()}
    if not counts:
        return Identifier(None)
    share = F.try_element_at(F.create_map(*(F.lit(x) for k, (n, chars) in counts.items() for x in (k, min(1.0, fit_docs / n, FIT_CHARS / max(1, chars))))), F.col("lang"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = labelled.where(place < share).withColumn("back", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(5)) == 0)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang in set(b.column("lang").to_pylist()):
                own = b.filter(pc.equal(b.column("lang"), lang))
                counted = pc.value_counts(words_by_row(pc.utf8_lower(own.column("text")))[1])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counted), pa.string()), counted.field("values"), counted.field("counts")], names=["lang", "word", "n"])

    samples: dict[str, dict[str, int]] = {}

    def learn(rows: DataFrame) -> None:
        fitted = rows.select("lang", "text").transform(shipped).mapInArrow(words, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()
        for lang, word, n in zip(*(fitted[c].to_pylist() for c in ("lang", "word", "n"))):
            samples.setdefault(lang, {})[word] = n

    learn(sample.where("not back"))
    # languages with words in held-back rows alone: they are learned from, and not calibrated on
    lost = set(counts) - set(samples)
    if lost:
        learn(sample.where(F.col("back") & F.col("lang").isin(list(lost))))
    if not samples:
        return Identifier(None)
    model = KneserNey(samples)
    back = sample.where("back").select("lang", "text").toArrow()
    scorer, logs, sizes, langs = _Scorer(model), [], [], back["lang"].to_pylist()
    for b in back.to_batches():
        s, c = scorer.rows(b.column("text"))
        logs.append(s), sizes.append(c)
    if not logs:
        return Identifier(model)
    sums, chars = np.concatenate(logs), np.concatenate(sizes)
    place_of = {lang: k for k, lang in enumerate(model.languages)}
    truth = np.array([-1 if x in lost else place_of.get(x, -1) for x in langs])
    use = (chars > 0) & (truth >= 0)
    sums, chars, truth = sums[use], chars[use], truth[use]
    if not len(truth):
        return Identifier(model)

    def loss(scale: float) -> float:
        per = sums / chars[:, None]
        logits = scale * (per - per.max(axis=1, keepdims=True))
        return float(-(logits[np.arange(len(truth)), truth] - np.log(np.exp(logits).sum(axis=1))).mean())

    scale = min((float(2**k) for k in range(8)), key=loss)
    best, sure = _confidence(sums, chars, scale)
    right = np.sort(sure[best == truth])
    return Identifier(model, scale, float(right[int(REJECT_RIGHT * len(right))]) if len(right) else 0.0)


PREDICTED = "doc_id bigint, held_out boolean, lang_pred string, score double, rejected boolean, cross_entropy double"
_scorers = WorkerCache()


def predict(docs: DataFrame, identifier: Identifier) -> DataFrame:
    """Per document the language, the score, and whether the score is under the threshold. Only text is looked at."""
    import uuid

    sent, name = docs.sparkSession.sparkContext.broadcast(identifier), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        _scorers.mine()
        if name not in _scorers and own.model is not None:
            _scorers.clear()
            _scorers[name] = _Scorer(own.model)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                texts = pc.fill_null(b.column("text"), "")
                lettered = pc.match_substring_regex(texts, r"\pL").to_numpy(zero_copy_only=False)
                if own.model is None:
                    lettered[:] = False
                    best, sure, entropy = np.zeros(b.num_rows, int), np.zeros(b.num_rows), np.zeros(b.num_rows)
                else:
                    sums, chars = _scorers[name].rows(texts)
                    best, sure = _confidence(sums, chars, own.scale)
                    entropy = -sums.max(axis=1) / np.maximum(chars, 1)
                pred = [own.model.languages[k] if ok else "und" for k, ok in zip(best, lettered)]
                score = np.where(lettered, np.clip(sure, 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(pred, pa.string()), pa.array(score), pa.array(score < own.threshold), pa.array(np.where(lettered, entropy, 0.0))], names=["doc_id", "held_out", "lang_pred", "score", "rejected", "cross_entropy"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out().alias("held_out")).transform(shipped).mapInArrow(run, PREDICTED)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs.where(~held_out()).select("doc_id", "text", "lang")))
