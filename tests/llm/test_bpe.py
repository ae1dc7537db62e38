import hashlib

from tokenizers import Tokenizer

from tidemark.llm import bpe

TEXTS = [None, "", " ", "Hello world's  test\n\n x", "a<|endoftext|>b <|endoftext|>", "éà ½²³ 日本語 ​\u0085", "x" * 3000, "ab" * 2000 + "é1" * 300, "same", "same"]


def test_encode_decode_match_the_public_library(spark, make, folder):
    t = Tokenizer.from_file(bpe.tokenizer_path())
    docs = make(*TEXTS)
    rows = {r.doc_id: r for r in bpe.decode(bpe.encode(docs)).collect()}
    sums = {r.doc_id: r for r in bpe.op8_bpe(spark, folder(documents=docs)).collect()}
    for i, text in enumerate(TEXTS):
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert rows[i].ids == ids
        assert rows[i].decoded == t.decode(ids, skip_special_tokens=False) == (text or "")
        assert (sums[i].n_tokens, sums[i].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert sums[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_short_and_long_merges_agree():
    c = bpe.codec(bpe.tokenizer_path())
    for w in (b"a", b"thethethe", b" international" * 9, "ñandú".encode() * 12, bytes(range(256))):
        assert c._merge_short(w) == c._merge_long(w)


def test_empty_table(spark, make, folder):
    assert bpe.op8_bpe(spark, folder(documents=make("x").limit(0))).count() == 0
