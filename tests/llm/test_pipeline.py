import random

import corpus_pipeline
from tidemark.llm._shared import stored


def test_stages_keep_columns_and_take_effect(spark, make, folder):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen, now = [], docs
    for name, stage in corpus_pipeline.STAGES:
        now = stored(stage(spark, now, d), "t")
        seen.append((name, now.count()))
        if name != "bpe":
            assert now.dtypes == docs.dtypes
    assert seen[0][1] < docs.count() and seen[1][1] < seen[0][1] and seen[4][1] == seen[3][1] == seen[2][1]
    assert corpus_pipeline.run(spark, d).count() == seen[-1][1]


def test_odd_rows_and_empty_tables(spark, make, folder):
    r = random.Random(1)
    text = " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(80))
    docs = make(text, text, "", None, text + " tail", "other words here")
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id bigint, quality int, toxic int")
    items = spark.createDataFrame([(0, "never seen words")], "item_id bigint, text string")
    rows = corpus_pipeline.run(spark, folder(documents=docs, labels=labels, benchmark=items)).collect()
    assert sorted(x.doc_id for x in rows) == [0, 5]
    empty = folder(documents=docs.limit(0), labels=labels.limit(0), benchmark=items.limit(0))
    assert corpus_pipeline.run(spark, empty).count() == 0
