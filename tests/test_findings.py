"""Queries on tables of their own that the fixtures don't reach: halves, large keys, nulls, skew; each against DuckDB."""

import re

import duckdb
import pytest

from test_queries import table
from tidemark.plans import registry


def same(spark, folder, name, **tables):
    """The query's rows on tables given as DuckDB SQL are those of its own SQL."""
    con = duckdb.connect()
    for t, text in tables.items():
        con.sql(f"COPY ({text}) TO '{folder}/{t}.parquet'")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = registry.QUERIES[name](spark, str(folder))
    got = table(df.columns, [tuple(r) for r in df.collect()])
    want = con.sql(registry.ORACLE_SQL[name])
    assert got == table(want.columns, want.fetchall())
    return df


def test_casts_round_halves_to_even(spark, tmp_path):
    same(spark, tmp_path, "casts", orders="SELECT CAST(i AS BIGINT) AS o_orderkey, i + 0.5::DOUBLE AS o_totalprice FROM range(-4, 20) t(i)")


def test_folded_operations_change_only_what_they_added(spark, tmp_path):
    same(spark, tmp_path, "folded_ops", orders="SELECT CAST(i AS BIGINT) AS o_orderkey, 'F' AS o_orderstatus, i * 1.5::DOUBLE AS o_totalprice FROM (SELECT unnest(range(-30, 60)) AS i UNION ALL SELECT unnest(range(4999990, 5000030)) UNION ALL SELECT NULL) t")


def joins(df):
    return len(re.findall(r"\bJoin (?:Left|Inner|Right|Full)", df._jdf.queryExecution().optimizedPlan().toString()))


def windows(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Window [")


ODD_ORDERS = """SELECT CAST(i * 3 - 40 AS BIGINT) AS o_orderkey, i % 5 AS o_custkey, CASE WHEN i % 7 = 0 THEN NULL WHEN i = 5 THEN 'P' WHEN i % 3 = 0 THEN 'F' ELSE 'O' END AS o_orderstatus,
    CASE WHEN i % 11 = 0 THEN NULL ELSE CAST(i % 13 AS DOUBLE) END AS o_totalprice, TIMESTAMP '2024-01-01' AS o_orderdate, CASE WHEN i % 9 = 0 THEN NULL ELSE 'p' || i % 4 END AS o_orderpriority FROM range(150) t(i)"""


@pytest.fixture
def small_ranges(monkeypatch):
    """Ranges of few rows, so that these tables have many."""
    from tidemark.operators import ranking

    monkeypatch.setattr(ranking, "RANGE_ROWS", 7)


def test_sql_numbers_of_all_rows_without_a_window(spark, tmp_path, small_ranges):
    assert not windows(same(spark, tmp_path, "sql_null_order", orders=ODD_ORDERS))


def test_sql_numberings_taken_apart(spark, tmp_path, small_ranges):
    from tidemark.plans.engine import Engine
    from tidemark.sources.catalog import Catalog

    db = Engine(Catalog(spark, str(tmp_path / "lake")))
    db.sql("CREATE TABLE t (k BIGINT, s TEXT)")
    db.sql("INSERT INTO t VALUES (1, 'b'), (2, 'a'), (3, NULL), (4, 'a'), (5, 'b')")
    cases = {
        "SELECT k AS a, row_number() OVER (ORDER BY s DESC, k) AS n FROM t WHERE k > 1 ORDER BY n LIMIT 3 OFFSET 1": [(5, 2), (2, 3), (4, 4)],
        "SELECT row_number() OVER (ORDER BY s, x.k DESC), x.k, NULL AS e FROM t AS x ORDER BY 1 DESC": [(5, 3, None), (4, 1, None), (3, 5, None), (2, 2, None), (1, 4, None)],
        "SELECT -k AS k, row_number() OVER (ORDER BY k) AS n FROM t ORDER BY k": [(-5, 5), (-4, 4), (-3, 3), (-2, 2), (-1, 1)],
    }
    for text, want in cases.items():
        got = db.query(text)
        assert not windows(got)
        assert [tuple(r) for r in got.collect()] == want, text
    grouped = db.query("SELECT s, count(*) AS c, row_number() OVER (ORDER BY s) AS n FROM t GROUP BY s ORDER BY n")
    assert [tuple(r) for r in grouped.collect()] == [("a", 2, 1), ("b", 2, 2), (None, 1, 3)]


def test_numbers_of_all_rows_without_a_window(spark, tmp_path, small_ranges):
    assert not windows(same(spark, tmp_path, "null_order", orders=ODD_ORDERS))
    customers = "SELECT CAST(i AS BIGINT) AS c_custkey, CASE WHEN i % 6 > 0 THEN CAST(i % 4 AS INTEGER) END AS c_nationkey FROM range(60) t(i)"
    assert not windows(same(spark, tmp_path, "sort_mixed", customer=customers))


def test_flush_in_steps_merges_in_one_join(spark, tmp_path):
    assert joins(same(spark, tmp_path, "flush_in_steps", orders=ODD_ORDERS)) == 1


def test_composite_keys_merge_in_one_join(spark, tmp_path):
    lines = "SELECT CAST(i // 3 AS BIGINT) AS l_orderkey, CAST(i % 3 AS INTEGER) AS l_linenumber, CAST(i AS DOUBLE) AS l_quantity FROM range(90) t(i) UNION ALL SELECT 7, 1, 2.5"
    assert joins(same(spark, tmp_path, "composite_key_merge", lineitem=lines)) == 1


@pytest.mark.parametrize("name", ["window_rank", "window_ntile", "window_range"])
def test_windows_over_few_groups_are_divided(spark, tmp_path, small_ranges, name):
    text = same(spark, tmp_path, name, orders=ODD_ORDERS)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"windowspecdefinition\(o_orderstatus#\d+, (?!_span)", text)


def test_merge_in_one_join(spark, tmp_path):
    assert joins(same(spark, tmp_path, "merged_fresh", orders="SELECT CAST(i AS BIGINT) AS o_orderkey, 'F' AS o_orderstatus, CAST(i AS DOUBLE) AS o_totalprice FROM range(300) t(i)")) == 1


def test_percentiles_of_few_groups_are_divided(spark, tmp_path, small_ranges):
    lines = "SELECT CASE WHEN i % 5 = 0 THEN NULL WHEN i = 3 THEN 'A' WHEN i = 4 THEN 'N' ELSE 'R' END AS l_returnflag, CASE WHEN i % 7 = 0 OR i = 4 THEN NULL ELSE (i * 37 % 101) / 4.0::DOUBLE END AS l_extendedprice FROM range(200) t(i)"
    text = same(spark, tmp_path, "percentiles", lineitem=lines)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile_cont" not in text and "median" not in text and "percentile(" not in text
