import itertools

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.errors import EngineError
from tidemark.operators import overlay
from tidemark.sources.catalog import Catalog
from tidemark.streaming import tail as tails

KV, CHANGES = "id bigint, v string", "id bigint, v string, _seq bigint, _op string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def plain_merge(committed, changes, w, lossless):
    fresh = [c for c in changes if w is None or c[2] > w]
    keyed = {c[0] for c in fresh if c[3] != "append"}
    out = [r for r in committed if r[0] not in keyed]
    for k in {c[0] for c in fresh}:
        own = sorted((c for c in fresh if c[0] == k), key=lambda c: c[2])
        if lossless and k not in keyed:
            out += [c[:2] for c in own]
        elif own[-1][3] != "delete":
            out.append(own[-1][:2])
    return sorted(out, key=str)


def test_merge_rule_by_example(spark):
    committed = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], KV)
    tail = spark.createDataFrame([(1, "old", 1, "append"), (2, "B", 5, "upsert"), (3, None, 6, "delete"), (4, "d", 7, "append"), (3, "again", 8, "append")], CHANGES)
    assert rows(overlay.merged_fresh(committed, tail, ["id"], 3)) == [(1, "a"), (2, "B"), (3, "again"), (4, "d")]
    assert rows(overlay.merged_fresh(committed, tail, [], 6)) == [(1, "a"), (2, "b"), (3, "again"), (3, "c"), (4, "d")]
    two = spark.createDataFrame([(9, "x", 4, "append"), (9, "y", 5, "append")], CHANGES)
    assert len(rows(overlay.merged_fresh(committed, two, ["id"], 3))) == 5
    assert len(rows(overlay.merged_fresh(committed, two, ["id"], 3, lossless=False))) == 4


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 4), st.sampled_from(["append", "upsert", "delete"])), max_size=10), st.one_of(st.none(), st.integers(0, 10)), st.booleans())
def test_merge_rule_matches_a_plain_one(spark, ops, w, lossless):
    committed = [(0, "a"), (1, "b"), (2, "c")]
    changes = [(k, None if op == "delete" else f"n{i}", i, op) for i, (k, op) in enumerate(ops, 1)]
    got = overlay.merged_fresh(spark.createDataFrame(committed, KV), spark.createDataFrame(changes, CHANGES), ["id"], w, lossless)
    assert rows(got) == plain_merge(committed, changes, w, lossless)


def test_layers(spark):
    committed = spark.createDataFrame([(1, "a"), (2, "b")], KV)
    first = spark.createDataFrame([(1, "A", 1, "upsert"), (3, "n", 2, "append")], CHANGES)
    second = spark.createDataFrame([(3, None, 3, "delete"), (1, "AA", 4, "upsert"), (5, "e", 5, "append")], CHANGES)
    assert rows(overlay.layered(committed, [first, second], ["id"])) == [(1, "AA"), (2, "b"), (5, "e")]
    up, plain = overlay.route_appends(second.where("_op = 'append'"), second.where("id = 5"), ["id"])
    assert (up.count(), plain.count()) == (1, 0)
    assert [tuple(r) for r in overlay.runs(second).orderBy("first_seq").collect()] == [("delete", 3, 3, 1), ("upsert", 4, 4, 1), ("append", 5, 5, 1)]
    with pytest.raises(EngineError):
        overlay.merge_overlays(first, second, ["id"], ["v"])
    with pytest.raises(Exception, match="without a primary key"):
        overlay.ingest(first, []).collect()


def test_literals_are_keys_only_as_written():
    assert overlay.literal_key("'5'", "bigint") == 5 and overlay.literal_key("'05'", "bigint") is None
    assert overlay.literal_key("5", "string") is None and overlay.literal_key("'a''b'", "string") == "a'b"
    assert overlay.literal_key("true", "boolean") is True and str(overlay.literal_key("DATE '2024-01-02'", "date")) == "2024-01-02"
    kinds = {"id": "bigint", "v": "string"}
    assert overlay.keyed_candidate({"id": "5"}, ["v"], ["id"], kinds) == {"id": 5}
    assert overlay.keyed_candidate({"id": "5", "v": "'x'"}, ["v"], ["id"], kinds) is None
    assert overlay.keyed_candidate({"id": "5"}, ["id"], ["id"], kinds) is None


@pytest.fixture
def log(spark, tmp_path):
    clock, ids = itertools.count(1_000_000, 1000), itertools.count(1)
    catalog = Catalog(spark, str(tmp_path / "lake"), lambda: next(clock), lambda: next(ids))
    catalog.create("t", spark.createDataFrame([], KV).schema, primary_key=["id"])
    catalog.append("t", spark.createDataFrame([(1, "a"), (2, "b")], KV))
    return tails.TailLog(catalog, "t")


def test_tail_merges_and_flushes_once(spark, log):
    c = log.catalog
    assert log.write(spark.createDataFrame([(i, f"n{i}") for i in range(10, 15)], KV).repartition(3)) == (1, 5)
    assert log.write(spark.createDataFrame([(1, "A")], KV), "upsert") == (6, 6)
    assert log.write(spark.createDataFrame([(2,)], "id bigint"), "delete") == (7, 7)
    assert sorted(r._seq for r in log.read().collect()) == list(range(1, 8))
    want = [(1, "A"), *((i, f"n{i}") for i in range(10, 15))]
    assert rows(log.merged()) == sorted(want, key=str) and c.table("t").count() == 2
    assert log.flush(6) == 6 and rows(log.merged()) == sorted(want, key=str)
    assert c.table("t").count() == 7
    assert log.flush() == 7 and log.flush() is None
    assert rows(c.table("t")) == sorted(want, key=str) == rows(log.merged())
    assert c.load("t").properties[tails.WATERMARK] == "7"


def test_tail_as_a_source_and_a_stream(spark, log, tmp_path):
    spark.dataSource.register(tails.TailSource)
    log.write(spark.createDataFrame([(7, "s"), (8, "t")], KV))
    read = spark.read.format("tidemark_tail").schema(log.schema()).option("folder", log.folder).load()
    assert rows(read) == rows(log.read())
    stream = spark.readStream.format("tidemark_tail").schema(log.schema()).option("folder", log.folder).load()
    for _ in range(2):
        tails.follow(stream, log.catalog, "t", str(tmp_path / "cp"), once=False, seconds=0.1)
        for q in spark.streams.active:
            q.processAllAvailable()
            q.stop()
        assert rows(log.catalog.table("t")) == [(1, "a"), (2, "b"), (7, "s"), (8, "t")]
    assert len(log.catalog.load("t").snapshots) == 2
    log.read().withColumn("_seq", F.col("_seq") + 5).withColumn("_op", F.lit("upsert")).write.parquet(str(tmp_path / "files"))
    files = spark.readStream.schema(log.schema()).parquet(str(tmp_path / "files"))
    tails.follow(files, log.catalog, "t", str(tmp_path / "cp2")).awaitTermination()
    assert log.catalog.table("t").count() == 4 and log.watermark() == 7


def test_the_newest_of_several_changes_of_a_key_counts(spark):
    import pytest

    view = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, v string")
    twice = spark.createDataFrame([(1, "x", 5), (1, "y", 7), (3, "z", 9)], "id bigint, v string, _seq bigint")
    assert [(r.id, r.v) for r in overlay.update_by_key(view, twice, ["id"], ["v"]).collect()] == [(1, "y")]
    with pytest.raises(Exception, match="several changes"):
        overlay.update_by_key(view, twice.drop("_seq"), ["id"], ["v"]).collect()
