"""Token counts by a linear longest-match automaton.

A trie over the vocabulary's bytes has, for each node, a failure link and the
number of tokens that following it pops: when a byte has no edge, greedy
longest-match pieces of what was read are already decided, and only their
number is added. A word thus costs time in proportion to its length, whatever
the vocabulary, and no piece is built. Every byte is a token, so that all words
have pieces.

Words are the runs of other than ASCII blanks, with one blank before them as the
vocabulary writes word beginnings. Null and empty texts have no words and no
tokens. Repeated rows give repeated rows.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._shared import WorkerCache, shipped, table

#: Words remembered by a worker; beyond it, it starts anew.
CACHE_WORDS = 300_000


def vocabulary(path: str | None = None) -> list[bytes]:
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


class LongestMatch:
    """Numbers of greedy longest-match pieces. ``tokens`` must hold every byte that words have."""

    def __init__(self, tokens: Iterable[bytes]) -> None:
        self.next: list[dict[int, int]] = [{}]
        whole = bytearray(1)
        for token in tokens:
            node = 0
            for byte in token:
                if byte not in self.next[node]:
                    self.next[node][byte] = len(self.next)
                    self.next.append({})
                    whole.append(0)
                node = self.next[node][byte]
            if node:
                whole[node] = 1
        self.fail, self.popped = [-1] * len(whole), [0] * len(whole)
        queue = deque([0])
        while queue:
            parent = queue.popleft()
            for byte, node in self.next[parent].items():
                queue.append(node)
                if whole[node]:
                    # all that was read is one token
                    self.fail[node], self.popped[node] = 0, 1
                    continue
                # what the parent's failure path pops, until a node goes on with this byte
                at, pops = self.fail[parent], self.popped[parent]
                while at >= 0 and byte not in self.next[at]:
                    pops += self.popped[at]
                    at = self.fail[at]
                if at >= 0:
                    self.fail[node], self.popped[node] = self.next[at][byte], pops

    def count(self, word: bytes) -> int:
        nexts, fail, popped = self.next, self.fail, self.popped
        node = pieces = 0
        for byte in word:
            while byte not in nexts[node]:
                if fail[node] < 0:
                    raise ValueError(f"no token begins with byte {byte}")
                pieces += popped[node]
                node = fail[node]
            node = nexts[node][byte]
        while node:
            if fail[node] < 0:
                raise ValueError("the word's end is no token")
            pieces += popped[node]
            node = fail[node]
        return pieces


_automata = WorkerCache()


def automaton(path: str | None) -> tuple[LongestMatch, dict[str, int]]:
    _automata.mine()
    if path not in _automata:
        _automata[path] = (LongestMatch(vocabulary(path)), {})
    return _automata[path]


def words_by_row(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The row of each word, and the words, of a column of texts."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words = pc.list_flatten(lists)
    rows = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    full = pc.greater(pc.binary_length(words), 0)
    return rows[full.to_numpy(zero_copy_only=False)], words.filter(full)


COUNTS = "doc_id bigint, n_words bigint, n_tokens bigint, longest_word bigint"


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document the number of words, of greedy pieces, and the most pieces of a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match, known = automaton(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                rows, words = words_by_row(b.column("text"))
                coded = words.dictionary_encode()
                sizes = []
                for w in coded.dictionary.to_pylist():
                    n = known.get(w)
                    if n is None:
                        n = match.count(b" " + w.encode())
                        if len(w) < 100:
                            known[w] = n
                    sizes.append(n)
                if len(known) > CACHE_WORDS:
                    known.clear()
                each = np.array(sizes, np.int64)[coded.indices.to_numpy()] if len(rows) else np.empty(0, np.int64)
                most = np.zeros(b.num_rows, np.int64)
                np.maximum.at(most, rows, each)
                n_words = np.bincount(rows, minlength=b.num_rows)
                tokens = np.bincount(rows, weights=each, minlength=b.num_rows).astype(np.int64)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(tokens), pa.array(most)], names=["doc_id", "n_words", "n_tokens", "longest_word"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).transform(shipped).mapInArrow(run, COUNTS)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
