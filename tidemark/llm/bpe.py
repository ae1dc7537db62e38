"""Byte-level BPE: encoding and decoding of whole texts.

Words of the pre-tokeniser are merged with a contiguous rank array: the part
boundaries of the word and the merge rank of each adjacent pair lie in two flat
lists; the minimum is found by a scan, its boundary deleted, and the two ranks
beside it refreshed. Long words, where repeated scans would cost the square of
their length, use a heap over linked parts with the same order of merges
(lowest rank, then leftmost), so that results are equal.

Null texts encode as empty ones (no ids); the special token's own string in a
text is that token, as in the public tokenizers library. Repeated rows give
repeated rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidemark.llm._shared import WorkerCache, shipped, table, texts_of

#: The pre-tokeniser's pattern of the public vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for a text of ASCII alone, where the classes are short ranges.
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
#: Words of more bytes than this are merged with the heap.
SHORT_WORD = 128
#: Words remembered by a worker; beyond it, it starts anew.
CACHE_WORDS = 200_000
NO_RANK = 1 << 30


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, and its byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Encoder and decoder over a tokenizer file of the byte-level BPE kind."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = byte_characters()
        vocab = spec["model"]["vocab"]
        self.piece = {i: bytes(map(to_byte.__getitem__, s)) for s, i in vocab.items()}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.piece |= {i: s.encode() for s, i in self.specials.items()}
        self.byte_id = [0] * 256
        for character, byte in to_byte.items():
            self.byte_id[byte] = vocab[character]
        self.rank: dict[tuple[int, int], int] = {}
        self.merged: list[int] = []
        for pair in spec["model"]["merges"]:
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocab[left], vocab[right]] = len(self.merged)
            self.merged.append(vocab[left + right])
        self.words = regex.compile(PATTERN).findall
        self.ascii_words = regex.compile(ASCII_PATTERN, regex.ASCII).findall
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")").split if self.specials else None
        self.written = _Words(self)
        self.spelled = {str(i).encode(): b for i, b in self.piece.items()}

    def merge(self, word: bytes) -> list[int]:
        return self._merge_short(word) if len(word) <= SHORT_WORD else self._merge_long(word)

    def _merge_short(self, word: bytes) -> list[int]:
        bounds = list(range(len(word)))
        parts = [self.byte_id[b] for b in word]
        rank, merged = self.rank.get, self.merged
        ranks = [rank(pair, NO_RANK) for pair in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) < NO_RANK:
            at = ranks.index(least)
            parts[at] = merged[least]
            del parts[at + 1], bounds[at + 1], ranks[at]
            if at:
                ranks[at - 1] = rank((parts[at - 1], parts[at]), NO_RANK)
            if at < len(ranks):
                ranks[at] = rank((parts[at], parts[at + 1]), NO_RANK)
        return parts

    def _merge_long(self, word: bytes) -> list[int]:
        n = len(word)
        parts = [self.byte_id[b] for b in word]
        after, before, gone = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(n)
        heap = [(r, i) for i in range(n - 1) if (r := self.rank.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= n or self.rank.get((parts[i], parts[j])) != r:
                continue
            parts[i], gone[j], after[i] = self.merged[r], 1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] < n and (s := self.rank.get((parts[left], parts[after[left]]))) is not None:
                    heapq.heappush(heap, (s, left))
        return [p for p, g in zip(parts, gone) if not g]

    def _plain(self, text: str) -> list[bytes]:
        return list(map(self.written.__getitem__, self.ascii_words(text) if text.isascii() else self.words(text)))

    def encode_written(self, text: str) -> bytes:
        """The ids in decimal, joined by commas."""
        if len(self.written) > CACHE_WORDS:
            self.written.clear()
        if self.split is None or not any(s in text for s in self.specials):
            return b",".join(self._plain(text))
        out: list[bytes] = []
        for i, piece in enumerate(self.split(text)):
            out += [str(self.specials[piece]).encode()] if i % 2 else self._plain(piece)
        return b",".join(out)

    def encode(self, text: str) -> list[int]:
        written = self.encode_written(text)
        return list(map(int, written.split(b","))) if written else []

    def decode_written(self, written: list[bytes]) -> bytes:
        raw = b"".join(map(self.spelled.__getitem__, written))
        return raw.decode("utf-8", "replace").encode()

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.piece.__getitem__, ids)).decode("utf-8", "replace")


class _Words(dict):
    """Word to its ids in decimal, found when first asked for."""

    def __init__(self, codec: ByteBpe) -> None:
        super().__init__()
        self.codec = codec

    def __missing__(self, word: str) -> bytes:
        out = b",".join(b"%d" % i for i in self.codec.merge(word.encode()))
        if len(word) <= SHORT_WORD:
            self[word] = out
        return out


_codecs = WorkerCache()


def codec(path: str) -> ByteBpe:
    """One for each worker and file."""
    _codecs.mine()
    if path not in _codecs:
        _codecs[path] = ByteBpe(path)
    return _codecs[path]


def encode(df: DataFrame, text: str = "text", out: str = "ids", path: str | None = None) -> DataFrame:
    """``df`` with an array of token ids of its column ``text``."""
    path = path or tokenizer_path()
    schema = T.StructType([f for f in df.schema.fields if f.name != out] + [T.StructField(out, T.ArrayType(T.IntegerType(), False), False)])
    names = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for b in batches:
            ids = pa.array([bpe.encode(t) for t in texts_of(b, text)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(n) for n in names] + [ids], names=[*names, out])

    return df.transform(shipped).mapInArrow(run, schema)


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """``df`` with the text that its array of token ids ``ids`` stands for; null ids give an empty text."""
    path = path or tokenizer_path()
    schema = T.StructType([f for f in df.schema.fields if f.name != out] + [T.StructField(out, T.StringType(), False)])
    names = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for b in batches:
            texts = pa.array([bpe.decode(x or []) for x in b.column(ids).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(n) for n in names] + [texts], names=[*names, out])

    return df.transform(shipped).mapInArrow(run, schema)


DIGESTS = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document the number of ids, and digests of the ids and of the text decoded from them.

    Encoding and decoding share one pass, so that ids never leave the worker.
    """
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for b in batches:
            counts, ids, decoded = [], [], []
            for t in texts_of(b):
                written = bpe.encode_written(t)
                each = written.split(b",") if written else []
                counts.append(len(each))
                ids.append(hashlib.sha256(written).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode_written(each)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    from pyspark.sql import functions as F

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).transform(shipped).mapInArrow(run, DIGESTS)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
