import random
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from tidemark.llm import packing
from tidemark.llm.bpe import tokenizer_path


def plain_fit(lengths, size):
    rows = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [r for r in rows if r[0] >= lengths[i]]
        row = min(fits, key=lambda r: r[0], default=None)
        if row is None:
            rows.append(row := [size, []])
        row[0] -= lengths[i]
        row[1].append(i)
    return rows


def test_segment_tree_finds_the_best_fit():
    r = random.Random(6)
    for _ in range(40):
        size = r.choice([1, 7, 16, 33])
        lengths = [r.randrange(1, size + 1) for _ in range(r.randrange(0, 60))]
        got = packing.best_fit_decreasing(lengths, size)
        free = lambda rows: sorted(size - sum(lengths[i] for i in row) for row in rows)
        assert sorted(i for row in got for i in row) == list(range(len(lengths)))
        assert free(got) == free([row for _, row in plain_fit(lengths, size)])


def test_rows_hold_every_document_without_loss(spark, make):
    t = Tokenizer.from_file(tokenizer_path())
    texts = [None, "", "word " * 100, "é日本 x", "same", "same", *(r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(30).collect())]
    rows = packing.pack(make(*texts).repartition(2), row_tokens=64, block_tokens=3000).collect()
    assert len({r.pack_id for r in rows}) == len(rows)
    back = defaultdict(dict)
    for r in rows:
        ids, positions = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == len(positions) == 64 and r.cu_seqlens[-1] == r.n_tokens <= 64
        for doc, at, s, e in zip(r.doc_ids, r.offsets, r.cu_seqlens, r.cu_seqlens[1:]):
            assert positions[s:e].tolist() == list(range(e - s))
            back[doc][at] = ids[s:e].tolist()
    for i, text in enumerate(texts):
        want = t.encode(text or "", add_special_tokens=False).ids + [packing.END_ID]
        assert [x for _, part in sorted(back[i].items()) for x in part] == want
    assert sum(r.n_tokens for r in rows) > 0.9 * 64 * len(rows)


def test_empty_table(spark, make, folder):
    assert packing.op7_packing(spark, folder(documents=make("x").limit(0))).count() == 0
