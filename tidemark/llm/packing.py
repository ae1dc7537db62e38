"""Packing of token ids into rows of a fixed length, by best-fit decreasing.

Documents become ids followed by one end id; those longer than a row are split
without loss into whole rows and a rest. The pieces of a block are placed from
the longest to the shortest, each in the fullest row that still takes it; a
segment tree over capacities, with a row of each capacity at its leaf, finds the
least sufficient capacity in logarithmic time. Rows are written as binary
matrices of little-endian ids with cumulative segment lengths (boundaries from
zero) and positions that restart at each segment.

A block is at most BLOCK_TOKENS ids of one task's input, so memory is bounded and
nothing is shuffled; which documents share a block follows from the input's
files. Null and empty texts give the end id alone. A document's pieces carry
its id and the offset of their first token, so that it can be put together
again; repeated rows are packed as often as they occur.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._shared import WorkerCache, shipped, table
from tidemark.llm.bpe import ASCII_PATTERN, CACHE_WORDS, PATTERN

ROW_TOKENS = 2048
BLOCK_TOKENS = 2_000_000
END_ID = 50256
PAD_ID = 50256


class Capacities:
    """Which capacities have an open row: a segment tree with the number of rows below each node."""

    def __init__(self, most: int) -> None:
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: dict[int, list[int]] = defaultdict(list)

    def add(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        self._change(capacity, 1)

    def take(self, needed: int) -> tuple[int, int] | None:
        """The row of the least capacity that suffices, and that capacity; it is open no more."""
        count = self.count
        node = needed + self.size
        if not count[node]:
            # up until a right sibling has rows, then down to its least capacity
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if count[2 * node] else 2 * node + 1
        capacity = node - self.size
        self._change(capacity, -1)
        return self.rows[capacity].pop(), capacity

    def _change(self, capacity: int, by: int) -> None:
        node = capacity + self.size
        while node:
            self.count[node] += by
            node >>= 1


def best_fit_decreasing(lengths: Iterable[int], row_tokens: int) -> list[list[int]]:
    """The pieces of each row, by their index; no length is above ``row_tokens``."""
    lengths = list(lengths)
    open_rows, rows = Capacities(row_tokens), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        got = open_rows.take(lengths[i])
        if got is None:
            got = len(rows), row_tokens
            rows.append([])
        row, capacity = got
        rows[row].append(i)
        if capacity > lengths[i]:
            open_rows.add(capacity - lengths[i], row)
    return rows


def split(ids: np.ndarray, row_tokens: int) -> list[tuple[int, np.ndarray]]:
    """Pieces of at most a row, each with the offset of its first token."""
    return [(at, ids[at : at + row_tokens]) for at in range(0, len(ids), row_tokens)]


class _Encoder:
    """Ids of whole texts: pre-tokeniser words are looked up, and new ones encoded by the public library."""

    def __init__(self, path: str) -> None:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, map(bytes.strip, f)))}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.words = regex.compile(PATTERN).findall
        self.ascii_words = regex.compile(ASCII_PATTERN, regex.ASCII).findall
        encode = self.encoding.encode_ordinary

        class Known(dict):
            def __missing__(self, word: str) -> bytes:
                out = np.array(encode(word), "<u2").tobytes()
                if len(word) < 64:
                    self[word] = out
                return out

        self.known = Known()

    def encode(self, text: str) -> np.ndarray:
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        words = self.ascii_words(text) if text.isascii() else self.words(text)
        return np.frombuffer(b"".join(map(self.known.__getitem__, words)), "<u2")


_encoders = WorkerCache()


def _encoder(path: str) -> _Encoder:
    _encoders.mine()
    if path not in _encoders:
        _encoders[path] = _Encoder(path)
    return _encoders[path]


PACKED = "pack_id string, n_tokens int, n_segments int, ids binary, cu_seqlens array<int>, position_ids binary, doc_ids array<bigint>, offsets array<bigint>"


def _packed(pieces: list[tuple[int | None, int, np.ndarray]], row_tokens: int, name: str) -> pa.RecordBatch:
    rows = best_fit_decreasing((len(p[2]) for p in pieces), row_tokens)
    columns: list[list] = [[] for _ in range(8)]
    for k, row in enumerate(rows):
        ids = np.full(row_tokens, PAD_ID, "<u2")
        positions = np.zeros(row_tokens, "<u2")
        bounds = [0]
        for i in row:
            own = pieces[i][2]
            at = bounds[-1]
            ids[at : at + len(own)] = own
            positions[at : at + len(own)] = np.arange(len(own))
            bounds.append(at + len(own))
        values = (f"{name}-{k}", bounds[-1], len(row), ids.tobytes(), bounds, positions.tobytes(), [pieces[i][0] for i in row], [pieces[i][1] for i in row])
        for column, value in zip(columns, values):
            column.append(value)
    types = [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    names = ["pack_id", "n_tokens", "n_segments", "ids", "cu_seqlens", "position_ids", "doc_ids", "offsets"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def pack(docs: DataFrame, row_tokens: int = ROW_TOKENS, block_tokens: int = BLOCK_TOKENS, path: str | None = None) -> DataFrame:
    """A row for each packed row of ids: the padded row, its segments' boundaries, positions, and where each segment comes from."""
    import public_tokenizers

    if not 1 <= row_tokens <= 65_535:
        raise ValueError("a row has 1 to 65,535 tokens, so that positions fit 16 bits")
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = _encoder(path), np.array([END_ID], "<u2")
        part = (c := TaskContext.get()) and c.partitionId() or 0
        pieces, held, block = [], 0, 0
        for b in batches:
            for i, text in enumerate(b.column("text")):
                ids = np.concatenate((encoder.encode(text.as_py() or ""), end))
                doc = b.column("doc_id")[i].as_py()
                for at, piece in split(ids, row_tokens):
                    pieces.append((doc, at, piece))
                    held += len(piece)
                    if held >= block_tokens:
                        yield _packed(pieces, row_tokens, f"{part}-{block}")
                        pieces, held, block = [], 0, block + 1
        if pieces:
            yield _packed(pieces, row_tokens, f"{part}-{block}")

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).transform(shipped).mapInArrow(run, PACKED)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
