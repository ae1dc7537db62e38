import itertools

import pytest
from pyspark.sql import functions as F

from tidemark.errors import EngineError, InsufficientPrivilege, NotSupported, SerializationFailure, UndefinedTable, UniqueViolation
from tidemark.functions import compat
from tidemark.plans import asof, guard
from tidemark.plans.engine import Engine, copy_out, parse, prepared
from tidemark.plans.guard import Authorizer, read_only, text_read_only
from tidemark.sources.catalog import Catalog


@pytest.fixture
def engine(spark, tmp_path):
    clock, ids = itertools.count(1_782_864_000_000, 1000), itertools.count(101)
    return Engine(Catalog(spark, str(tmp_path / "lake"), lambda: next(clock), lambda: next(ids)))


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_statements_end_to_end(engine):
    run = engine.sql
    run("CREATE TABLE Trips (id BIGINT NOT NULL PRIMARY KEY, city VARCHAR(20), km DOUBLE PRECISION)")
    assert run("INSERT INTO trips VALUES (1, 'Paris', 2.5), (2, 'Oslo', 7)").tag == "INSERT 0 2"
    assert run("insert into public.trips (city, id) select upper(city), id + 10 from trips t where t.km > 3").tag == "INSERT 0 1"
    with pytest.raises(UniqueViolation):
        run("INSERT INTO trips VALUES (1, 'dup', 0)")
    assert run("UPDATE trips SET km = coalesce(km, 0) + 1, city = lower(city) WHERE city <> 'Paris'").tag == "UPDATE 2"
    assert rows(engine.query("SELECT trips.id, city, km FROM trips ORDER BY id")) == [(1, "Paris", 2.5), (12, "oslo", 1.0), (2, "oslo", 8.0)]
    assert rows(engine.query("SELECT count(*) FROM trips AS OF 101")) == [(2,)]
    assert rows(engine.query('SELECT count(*) n FROM "trips@102" x JOIN trips ON x.id = trips.id')) == [(3,)]
    assert rows(engine.query("SELECT count(*) FROM trips AS OF TIMESTAMP '2026-07-01 00:00:00.5'")) == [(2,)]
    with pytest.raises(EngineError):
        engine.query("SELECT * FROM trips AS OF TIMESTAMP '2020-01-01'")
    assert len(rows(engine.query("SELECT * FROM \"trips$snapshots\""))) == 3
    assert rows(engine.query("SELECT id FROM trips WHERE id = $1 AND city = $2", 2, "oslo")) == [(2,)]
    assert rows(engine.query("WITH c AS (SELECT city, count(*) n FROM trips GROUP BY city) SELECT * FROM c WHERE n > 1")) == [("oslo", 2)]
    assert rows(engine.query("SELECT table_name FROM information_schema.tables")) == [("trips",)]
    assert run("DELETE FROM trips WHERE km IS NULL OR id > 10").tag == "DELETE 1"
    assert run("DROP TABLE IF EXISTS nope").tag == run("DROP TABLE trips").tag == "DROP TABLE"
    with pytest.raises(UndefinedTable):
        run("DELETE FROM trips")


@pytest.mark.parametrize("sql", ["UPDATE t SET a = 1 FROM u", "UPDATE t SET a = (SELECT 1)", "DELETE FROM t USING u", "DELETE FROM t WHERE a IN (SELECT 1)", "UPDATE t SET (a, b) = (1, 2)", "DELETE FROM t LIMIT 1", "UPDATE t x SET a = 1", "INSERT OVERWRITE t VALUES (1)", "INSERT INTO t VALUES (1) RETURNING a"])
def test_refused_statements(sql):
    with pytest.raises(NotSupported):
        parse(sql)


def test_transactions_by_sql(engine):
    engine.sql("CREATE TABLE t (id BIGINT, v TEXT)")
    engine.sql("BEGIN")
    engine.sql("INSERT INTO t VALUES (1, 'a')")
    assert rows(engine.query("SELECT * FROM t")) == [(1, "a")]
    other = Engine(engine.catalog)
    assert rows(other.query("SELECT * FROM t")) == []
    with pytest.raises(NotSupported):
        engine.sql("CREATE TABLE x (id INT)")
    assert engine.sql("COMMIT").tag == "ROLLBACK"
    engine.sql("BEGIN")
    engine.sql("INSERT INTO t VALUES (1, 'a')")
    other.sql("INSERT INTO t VALUES (2, 'b')")
    with pytest.raises(SerializationFailure):
        engine.sql("COMMIT")
    assert rows(engine.query("SELECT * FROM t")) == [(2, "b")]


def test_plan_cache_and_staleness(engine):
    engine.sql("CREATE TABLE t (id BIGINT)")
    for _ in range(2):
        engine.query("SELECT count(*) FROM t")
    assert engine.plans.hits == 1
    engine.sql("INSERT INTO t VALUES (1)")
    assert rows(engine.query("select COUNT(*) from t")) == [(1,)]
    engine.query("SELECT now() FROM t")
    engine.query("SELECT now() FROM t")
    assert engine.plans.hits == 1
    slow = Engine(engine.catalog, staleness_s=1000)
    slow.query("SELECT * FROM t")
    engine.sql("INSERT INTO t VALUES (2)")
    assert slow.query("SELECT * FROM t").count() == 1
    slow.sql("INSERT INTO t VALUES (3)")
    assert slow.query("SELECT * FROM t").count() == 3


def test_privileges(engine):
    engine.sql("CREATE TABLE t (id BIGINT)")
    a = Authorizer()
    a.grant("readers", "read", "public")
    a.add_member("ann", "team")
    a.add_member("team", "readers")
    ann = Engine(engine.catalog, "ann", a)
    assert ann.query("SELECT * FROM t").count() == 0
    with pytest.raises(InsufficientPrivilege):
        ann.sql("INSERT INTO t VALUES (1)")
    a.grant("ann", "write", "public.t")
    assert ann.sql("INSERT INTO t SELECT id + 1 FROM t").tag == "INSERT 0 0"
    assert not a.allows("bob", "read", "public.t") and a.allows("bob", "read", "information_schema.tables")
    with pytest.raises(NotSupported):
        Engine(engine.catalog, read_only=True).sql("DELETE FROM t")
    assert guard.needs("drop", "a.b", []) == [("drop", "a.b")]


def test_read_only_classes():
    for sql in ("SELECT 1", "(select 1) union select 2", "WITH a AS (SELECT 1) SELECT * FROM a", "VALUES (1)", "EXPLAIN DELETE FROM t", "explain analyze select 1", "SHOW timezone"):
        assert read_only(sql), sql
    for sql in ("DELETE FROM t", "WITH a AS (DELETE FROM t) SELECT 1", "EXPLAIN ANALYZE DELETE FROM t", "SELECT 1; DROP TABLE t", "", "frobnicate", "SELECT * INTO x FROM t"):
        assert not read_only(sql), sql
    assert text_read_only("select 1") and not text_read_only("select 1 where delete") and text_read_only("select 'drop table'")


def test_table_names_are_told_from_other_words():
    found = lambda s: [".".join(u.parts) for u in asof.table_uses(s)]
    assert found("SELECT extract(year FROM ts), trim(both 'x' from b) FROM a, ns.b AS OF 5, c JOIN (SELECT * FROM d) e ON 1=1 WHERE x IS DISTINCT FROM y") == ["a", "ns.b", "c", "d"]
    assert found("SELECT 'from x' -- from y\n FROM \"Q T\"") == ["Q T"]
    with pytest.raises(EngineError):
        asof.table_uses("SELECT * FROM t AS OF 'x'")
    with pytest.raises(NotSupported):
        asof.table_uses("SELECT * FROM a.b.c AS OF 5")


def test_copy_named_and_prepared(engine):
    engine.sql("CREATE TABLE t (id BIGINT, v TEXT, b BOOLEAN)")
    insert = prepared(engine, "INSERT INTO t VALUES ($1, $2, $3)")
    insert(1, 'a,"q"\tx\\', True)
    insert(2, None, False)
    assert rows(copy_out(engine, "COPY t TO STDOUT")) == [('1\ta,"q"\\tx\\\\\tt',), ("2\t\\N\tf",)]
    assert rows(copy_out(engine, "COPY (SELECT v, id FROM t) TO STDOUT WITH (FORMAT csv, HEADER)")) == sorted([("v,id",), ('"a,""q""\tx\\",1',), (",2",)], key=str)
    for bad in ("COPY t FROM STDIN", "COPY t TO STDOUT (HEADER)", "COPY t TO STDOUT (DELIMITER ';')"):
        with pytest.raises(NotSupported):
            copy_out(engine, bad)
    engine.define("by_id", "SELECT v FROM t WHERE id = :id", id=int)
    assert engine.named("by_id", id=2).count() == 1
    with pytest.raises(EngineError):
        engine.named("by_id", id="2 or 1=1")
    with pytest.raises(NotSupported):
        engine.define("bad", "DELETE FROM t")


def test_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(compat.gcd(F.lit(48), F.lit(-18))) == 6 and one(compat.gcd(F.lit(0), F.lit(0))) == 0
    assert one(compat.lcm(F.lit(4), F.lit(6))) == 12 and one(compat.int_div(F.lit(-7), F.lit(2))) == -3
    assert one(compat.trunc(F.lit(-2.75), 1)) == pytest.approx(-2.7)
    assert one(compat.string_to_array(F.lit("a.b.c"), ".")) == ["a", "b", "c"] and one(compat.to_hex(F.lit(255))) == "ff"
    assert one(compat.similar_to(F.lit("abc"), "(a|x)%c")) and not one(compat.similar_to(F.lit("abcd"), "(a|x)%c"))
    assert one(compat.regexp_replace_first(F.lit("aXbX"), "X", "-")) == "a-bX"
    a = F.array(*map(F.lit, (1, 2, 2, 3)))
    assert one(compat.array_positions(a, F.lit(2))) == [2, 3] and one(compat.array_pop_back(a)) == [1, 2, 2]
    assert one(compat.array_replace(a, F.lit(2), F.lit(9))) == [1, 9, 2, 3] and one(compat.array_replace_all(a, F.lit(2), F.lit(9))) == [1, 9, 9, 3]
    assert one(compat.array_resize(a, 6, F.lit(0))) == [1, 2, 2, 3, 0, 0] and one(compat.array_slice(a, 2, 3)) == [2, 2]
    assert one(compat.array_distance(F.array(F.lit(0.0), F.lit(3.0)), F.array(F.lit(4.0), F.lit(0.0)))) == 5.0 and one(compat.array_sum(a)) == 8
    assert str(one(compat.date_bin(900, F.lit("2024-01-01 10:29:59").cast("timestamp_ntz")))) == "2024-01-01 10:15:00"
    assert one(compat.array_has_all(a, F.array(F.lit(1), F.lit(3)))) and one(compat.generate_subscripts(a)) == [1, 2, 3, 4]


def test_system_tables_and_guards(engine, tmp_path):
    from tidemark.sources import system

    engine.sql("CREATE TABLE t (id BIGINT NOT NULL, v TEXT)")
    engine.sql("INSERT INTO t SELECT id, 'x' FROM range(10000)")
    got = engine.query("SELECT n.nspname, c.relname, a.attname, t.typname FROM pg_catalog.pg_class c JOIN pg_namespace n ON c.relnamespace = n.oid JOIN pg_attribute a ON a.attrelid = c.oid JOIN pg_type t ON t.oid = a.atttypid")
    assert rows(got) == [("public", "t", "id", "bigint"), ("public", "t", "v", "string")]
    assert sum(b.num_rows for b in system.guarded(engine.query("SELECT * FROM t"))) == 10000
    with pytest.raises(EngineError, match="bytes"):
        list(system.guarded(engine.query("SELECT * FROM t"), max_bytes=100))
    system.extract(engine.query("SELECT * FROM t"), str(tmp_path / "out"))
    assert system.external(engine.spark, "parquet", str(tmp_path / "out")).count() == 10000
    with pytest.raises(EngineError):
        system.external(engine.spark, "csv", "x")
    assert system.tails(engine.catalog).count() == 0
    assert engine.metrics.counts["select"] >= 2


def test_results_are_kept_while_the_table_is_unchanged(engine):
    run = engine.sql
    run("CREATE TABLE t (a BIGINT, b DOUBLE)")
    run("INSERT INTO t VALUES (3, 1), (1, 2), (2, 3)")
    db = Engine(engine.catalog, result_rows=100)
    text = "SELECT a FROM t ORDER BY a LIMIT 2"
    first = db.query(text)
    assert [r.a for r in first.collect()] == [1, 2] and first.is_cached and db.results.used == 2
    assert db.query(text) is first
    run("DELETE FROM t WHERE a = 1")
    assert [r.a for r in db.query(text).collect()] == [2, 3]


def test_sql_sees_the_tail_and_flushes_before_changes(engine):
    from tidemark.streaming.tail import TailLog

    engine.sql("CREATE TABLE t (id BIGINT PRIMARY KEY, v TEXT)")
    engine.sql("INSERT INTO t VALUES (1, 'a'), (2, 'b')")
    log, spark = TailLog(engine.catalog, "t"), engine.spark
    log.write(spark.createDataFrame([(3, "c")], "id bigint, v string"))
    log.write(spark.createDataFrame([(2, "B")], "id bigint, v string"), "upsert")
    assert rows(engine.query("SELECT * FROM t")) == [(1, "a"), (2, "B"), (3, "c")]
    assert engine.plans.hits == 0 and log.watermark() is None
    assert engine.sql("UPDATE t SET v = 'C' WHERE id = 3").tag == "UPDATE 1"
    assert log.watermark() == 2 and rows(engine.query("SELECT * FROM t")) == [(1, "a"), (2, "B"), (3, "C")]
    assert log.flush(0) is None and log.flush() is None
    log.write(spark.createDataFrame([(1,)], "id bigint"), "delete")
    engine.sql("BEGIN")
    assert log.watermark() == 3
    log.write(spark.createDataFrame([(9, "z")], "id bigint, v string"))
    assert rows(engine.query("SELECT id FROM t")) == [(2,), (3,)]
    engine.sql("COMMIT")
    assert rows(engine.query("SELECT id FROM t")) == [(2,), (3,), (9,)]


def test_dialect_texts():
    from tidemark.plans import dialect

    none = lambda source, expressions: None
    whole = lambda source, expressions: ["int"] * len(expressions)
    assert dialect.rewritten("SELECT a / b * 2 FROM t WHERE c = 1", whole) == "SELECT (a DIV b) * 2 FROM t WHERE c = 1"
    assert dialect.rewritten("SELECT x + a * b / (c - 1) FROM t", whole) == "SELECT x + (a * b DIV (c - 1)) FROM t"
    assert dialect.rewritten("SELECT a / b FROM t", none) == "SELECT a / b FROM t"
    assert dialect.rewritten("SELECT '/ ~ order by' FROM t", whole) == "SELECT '/ ~ order by' FROM t"
    assert dialect.null_order("SELECT a FROM t ORDER BY a DESC, b NULLS FIRST, c LIMIT 1") == "SELECT a FROM t ORDER BY a DESC NULLS FIRST, b NULLS FIRST, c NULLS LAST LIMIT 1"
    assert dialect.operators("SELECT ~a FROM t WHERE b !~* 'x'") == "SELECT ~a FROM t WHERE b NOT RLIKE '(?i)x'"
    assert dialect.functions("SELECT array_has(make_array(1, 2), strpos(a, 'b'))") == "SELECT array_contains(array(1, 2), instr(a, 'b'))"
    with pytest.raises(EngineError):
        dialect.functions("SELECT to_hex(1, 2)")
