"""All corpus queries and stages over a table with nulls everywhere, repeated rows, very long texts and columns of clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm.registry import QUERIES

EXTRA = ("row", "digest", "head", "_may", "keep", "score", "y", "p_meta", "_email", "_spans", "_new", "ids", "held_out", "token", "fp", "html", "g", "n")


@pytest.fixture(scope="module")
def odd(spark, make, folder):
    long = "long text with words " * 20_000
    docs = make(None, "", " ", "a", "some plain words here", "some plain words here", long, "mail a@b.cd and 10.0.0.1", "$$$ ### %%%", "é" * 3000)
    docs = docs.union(docs.where("doc_id in (4, 7)")).union(docs.select(F.lit(None).cast("bigint"), "text", F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("bigint")))
    docs = docs.withColumns({c: F.lit("x") for c in EXTRA})
    labels = spark.createDataFrame([(4, 1, 0), (8, 0, 0), (None, 1, None), (3, None, 0)], "doc_id bigint, quality int, toxic int")
    items = spark.createDataFrame([(1, "plain words"), (None, "a"), (2, None)], "item_id bigint, text string")
    return folder(documents=docs.repartition(3), labels=labels, benchmark=items), docs.count()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries(spark, odd, name):
    d, n = odd
    rows = QUERIES[name](spark, d).collect()
    if name.startswith("op7"):
        assert sum(x == 0 for r in rows for x in r.offsets) == n
    else:
        assert len(rows) == n


def test_stages(spark, odd):
    d, _ = odd
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d)
        if name != "bpe":
            assert out.columns == docs.columns
            assert all(r.row == "x" and r.keep == "x" for r in out.collect())
        else:
            assert out.count() == docs.count()
