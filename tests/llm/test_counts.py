import random
import re

from tidemark.llm import counts


def greedy(word, vocab):
    n = at = 0
    while at < len(word):
        size = next(k for k in range(len(word) - at, 0, -1) if word[at : at + k] in vocab)
        at += size
        n += 1
    return n


def test_random_vocabularies_match_greedy_pieces():
    r = random.Random(1)
    for _ in range(60):
        vocab = {b"a", b"b", b"c"} | {bytes(r.choice(b"abc") for _ in range(r.randrange(1, 8))) for _ in range(25)}
        m = counts.LongestMatch(sorted(vocab))
        for _ in range(40):
            w = bytes(r.choice(b"abc") for _ in range(r.randrange(0, 30)))
            assert m.count(w) == greedy(w, vocab)


def test_documents_match_brute_force(spark, make, folder):
    vocab = set(counts.vocabulary())
    texts = [None, "", " \n\t", "Hello  world\x0bé", "x" * 400, "日本語 ½", "same text", "same text", "\x1c\x85 a"]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(25).collect()]
    got = {x.doc_id: x for x in counts.op9_token_counts(spark, folder(documents=make(*texts))).collect()}
    for i, t in enumerate(texts):
        each = [greedy(b" " + w.encode(), vocab) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        assert (got[i].n_words, got[i].n_tokens, got[i].longest_word) == (len(each), sum(each), max(each, default=0))


def test_empty_table(spark, make, folder):
    assert counts.op9_token_counts(spark, folder(documents=make("x").limit(0))).count() == 0
