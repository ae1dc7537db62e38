"""Read queries over the fixture tables: projection, predicates, joins, aggregates, windows, sets and functions.

Each is a Spark query, as a DataFrame or as SQL over tables in braces, and the
DuckDB SQL for the same rows; where one text serves both it is written once.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import compat
from tidemark.operators import ranking
from tidemark.operators.ranking import ascending

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql(name: str, duck: str, spark_sql: str | None = None) -> None:
    """A query by SQL, tables in braces; the oracle's text is ``duck``."""
    text = spark_sql or duck
    used = [t for t in TABLES if re.search(rf"\{{{t}\}}", text)]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(text, **{t: read(spark, sf_dir, t) for t in used})

    QUERIES[name] = run
    ORACLE_SQL[name] = re.sub(r"\{(\w+)\}", r"\1", duck)


def frame(name: str, duck: str) -> Callable[[Callable], Callable]:
    """A query by DataFrame: the function takes a reader of tables."""

    def add(f: Callable) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(lambda t: read(spark, sf_dir, t))
        ORACLE_SQL[name] = duck
        return f

    return add


# --- projection, filters, sorting ------------------------------------------------------------------

sql("point_lookup", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM {orders} WHERE o_orderkey = 137")
sql("filtered_scan", "SELECT l_orderkey, l_linenumber, l_quantity FROM {lineitem} WHERE l_returnflag = 'R' AND l_quantity > 45 AND l_discount < 0.03")
sql("range_slice", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM {orders} WHERE o_orderkey BETWEEN 250 AND 350")
sql("in_list", "SELECT c_custkey, c_name, c_mktsegment FROM {customer} WHERE c_custkey IN (1, 5, 9, 77, 140) OR c_mktsegment IN ('BUILDING')")
sql("or_of_keys", "SELECT l_orderkey, l_linenumber, l_partkey FROM {lineitem} WHERE (l_orderkey = 1 AND l_linenumber = 1) OR (l_orderkey = 3 AND l_linenumber = 2) OR (l_orderkey = 7 AND l_linenumber = 1)")
sql("is_distinct_from", "SELECT o_orderkey FROM {orders} WHERE (NULLIF(o_orderstatus, 'O') = 'F') IS DISTINCT FROM TRUE")
sql("null_tests", "SELECT count(*) AS n, count(NULLIF(o_orderstatus, 'F')) AS n_known, CAST(sum(CASE WHEN NULLIF(o_orderstatus, 'F') IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_null FROM {orders}")
sql("like_forms", "SELECT p_partkey, p_name LIKE '%a%' AS a, p_type LIKE 'S_%' AS b, p_brand NOT LIKE '%1' AS c, lower(p_name) LIKE '%e_' AS d FROM {part}")
sql("ilike_forms", "SELECT p_partkey, p_name ILIKE '%A%' AS a, NOT (p_type ILIKE 's%') AS b FROM {part}")
sql("group_agg", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_extendedprice), 2) AS avg_price, round(sum(l_quantity), 2) AS sum_qty FROM {lineitem} GROUP BY l_returnflag, l_linestatus ORDER BY n DESC, l_returnflag")
sql("topk", "SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 5")
sql("limit_rows", "SELECT count(*) AS n, count(DISTINCT x.o_orderkey) AS own FROM (SELECT o_orderkey FROM {orders} LIMIT 25) x JOIN {orders} o ON o.o_orderkey = x.o_orderkey")
sql("offset_page", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 20")


@frame("sort_mixed", "SELECT c_nationkey, c_custkey, row_number() OVER (ORDER BY c_nationkey DESC, c_custkey) AS place FROM customer ORDER BY c_nationkey DESC, c_custkey")
def _sort_mixed(t):
    order = [F.col("c_nationkey").desc_nulls_last(), *ascending("c_custkey")]
    return ranking.numbered(t("customer").select("c_nationkey", "c_custkey"), order, "place").withColumn("place", F.col("place").cast("int")).orderBy(*order)


@frame("null_order", "SELECT o_orderkey, row_number() OVER (ORDER BY NULLIF(o_orderstatus, 'F') ASC NULLS LAST, o_orderkey) AS up, row_number() OVER (ORDER BY NULLIF(o_orderstatus, 'F') DESC NULLS FIRST, o_orderkey) AS down FROM orders")
def _null_order(t):
    s = F.col("s")
    up = ranking.numbered(t("orders").select("o_orderkey", F.expr("NULLIF(o_orderstatus, 'F')").alias("s")), [s.asc_nulls_last(), *ascending("o_orderkey")], "up")
    both = ranking.numbered(up, [s.desc_nulls_first(), *ascending("o_orderkey")], "down")
    return both.select("o_orderkey", F.col("up").cast("int"), F.col("down").cast("int"))

sql("values_scan", "SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS v(id, name)")
sql("select_without_from", "SELECT 1 + 2 AS three, 'x' AS x, NULL IS NULL AS yes")
sql("case_coalesce", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, coalesce(NULLIF(o_orderstatus, 'O'), 'open') AS status FROM {orders}")
sql("update_projection", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN round(o_totalprice * 1.1, 2) ELSE o_totalprice END AS o_totalprice FROM {orders}")

# --- joins -------------------------------------------------------------------------------------------

sql("inner_join_agg", "SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey GROUP BY n_name ORDER BY n DESC, n_name")
sql("selective_join", "SELECT o_orderkey, c_name, c_mktsegment FROM {orders} JOIN {customer} ON o_custkey = c_custkey WHERE o_orderkey BETWEEN 100 AND 140")
sql("implicit_join", "SELECT s_name, n_name, r_name FROM {supplier}, {nation}, {region} WHERE s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND s_acctbal > 5000")
sql("left_join", "SELECT c_custkey, count(o_orderkey) AS n_orders FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY c_custkey")
sql("right_join", "SELECT n_name, count(s_suppkey) AS n FROM {supplier} RIGHT JOIN {nation} ON s_nationkey = n_nationkey AND s_acctbal > 9000 GROUP BY n_name")
sql("full_join", "SELECT coalesce(a.k, b.k) AS k, a.n AS n_c, b.n AS n_s FROM (SELECT c_nationkey AS k, count(*) AS n FROM {customer} WHERE c_nationkey < 15 GROUP BY c_nationkey) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM {supplier} WHERE s_nationkey > 8 GROUP BY s_nationkey) b ON a.k = b.k")
sql("semi_join", "SELECT c_custkey FROM {customer} WHERE c_custkey IN (SELECT o_custkey FROM {orders} WHERE o_totalprice > 300000)")
sql("anti_join", "SELECT c_custkey FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
sql("cross_join", "SELECT r_name, x.v FROM {region} CROSS JOIN (VALUES (1), (2)) AS x(v)")
sql("theta_join", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
sql("using_join", "SELECT k, n_name, r_name FROM (SELECT n_regionkey AS k, n_name FROM {nation}) a JOIN (SELECT r_regionkey AS k, r_name FROM {region}) b USING (k)")
sql("natural_join", "SELECT k, n_name, r_name FROM (SELECT n_regionkey AS k, n_name FROM {nation}) a NATURAL JOIN (SELECT r_regionkey AS k, r_name FROM {region}) b")
sql("lateral_join", "SELECT c_custkey, t.o_orderkey, t.o_totalprice FROM {customer}, LATERAL (SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) t")
sql("corr_subquery", "SELECT o_orderkey, o_totalprice FROM {orders} o WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM {orders} i WHERE i.o_custkey = o.o_custkey)")
sql("exists_subquery", "SELECT s_suppkey, s_name FROM {supplier} WHERE EXISTS (SELECT 1 FROM {lineitem} WHERE l_suppkey = s_suppkey AND l_quantity > 49 AND l_discount > 0.08)")
sql("scalar_subquery", "SELECT n_name, (SELECT max(c_acctbal) FROM {customer} WHERE c_nationkey = n_nationkey) AS best FROM {nation}")


@frame("range_join", "SELECT e.event_id, b.v AS bucket FROM events e JOIN (VALUES (0, 10.0, 20.0), (1, 20.0, 30.0), (2, 15.0, 25.0)) AS b(v, lo, hi) ON e.value >= b.lo AND e.value < b.hi")
def _range_join(t):
    events = t("events")
    bands = events.sparkSession.createDataFrame([(0, 10.0, 20.0), (1, 20.0, 30.0), (2, 15.0, 25.0)], "bucket int, lo double, hi double")
    # three rows: a bound that doesn't grow
    return events.join(F.broadcast(bands), (F.col("value") >= F.col("lo")) & (F.col("value") < F.col("hi"))).select("event_id", "bucket")


# --- aggregates --------------------------------------------------------------------------------------

sql("count_all", "SELECT count(*) AS n FROM {lineitem}")
sql("count_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM {lineitem} GROUP BY l_returnflag")
sql("having", "SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey HAVING count(*) > 12")
sql("max_or_zero", "SELECT coalesce(max(o_orderkey), 0) AS top, (SELECT coalesce(max(o_orderkey), 0) FROM {orders} WHERE o_orderkey < 0) AS none FROM {orders}")
sql("length_checksum", "SELECT CAST(sum(length(text)) AS BIGINT) AS chars, count(*) AS n FROM {documents}")
sql("rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag) + grouping(l_linestatus) AS BIGINT) AS g FROM {lineitem} GROUP BY ROLLUP (l_returnflag, l_linestatus)")
sql("cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY CUBE (o_orderstatus, o_orderpriority)")
sql("grouping_sets", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS q FROM {lineitem} GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
sql("filter_agg", "SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS big, round(avg(l_discount) FILTER (WHERE l_linestatus = 'O'), 6) AS avg_open FROM {lineitem} GROUP BY l_returnflag")
sql("string_agg", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM {nation} GROUP BY n_regionkey")
sql("array_agg", "SELECT n_regionkey, array_to_string(list_sort(array_agg(n_nationkey)), '-') AS ks FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, array_join(sort_array(array_agg(n_nationkey)), '-') AS ks FROM {nation} GROUP BY n_regionkey")
sql("bool_agg", "SELECT c_mktsegment, bool_and(c_acctbal > -1000) AS all_ok, bool_or(c_acctbal > 9990) AS any_rich FROM {customer} GROUP BY c_mktsegment")
sql("bit_agg", "SELECT n_regionkey, CAST(bit_and(n_nationkey) AS BIGINT) AS a, CAST(bit_or(n_nationkey) AS BIGINT) AS o, CAST(bit_xor(n_nationkey) AS BIGINT) AS x FROM {nation} GROUP BY n_regionkey")
sql("stats_agg", "SELECT l_returnflag, round(stddev_samp(l_quantity), 4) AS sd, round(stddev_pop(l_quantity), 4) AS sdp, round(var_samp(l_discount), 8) AS v, round(var_pop(l_discount), 8) AS vp, round(covar_samp(l_quantity, l_extendedprice), 1) AS cs, round(covar_pop(l_quantity, l_extendedprice), 1) AS cp, round(corr(l_quantity, l_extendedprice), 6) AS r FROM {lineitem} GROUP BY l_returnflag")
sql("regr_agg", "SELECT round(regr_slope(l_extendedprice, l_quantity), 3) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS icpt, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n, round(regr_avgx(l_extendedprice, l_quantity), 4) AS ax, round(regr_avgy(l_extendedprice, l_quantity), 2) AS ay FROM {lineitem}")


@frame("percentiles", "SELECT l_returnflag, round(median(l_extendedprice), 3) AS med, round(quantile_cont(l_extendedprice, 0.9), 3) AS p90 FROM lineitem GROUP BY l_returnflag")
def _percentiles(t):
    # nulls are no values, but their group stays
    counts = t("lineitem").groupBy("l_returnflag", "l_extendedprice").agg(F.count("l_extendedprice").alias("_rows"))
    values = ranking.running(counts, ["l_returnflag"], ascending("l_extendedprice"))

    def cont(q: float):
        at = F.lit(q) * (F.col("_size") - 1)
        value = lambda i: F.max(F.when((F.col("_before") <= i) & (i < F.col("_before") + F.col("_rows")), F.col("l_extendedprice")))
        low, high = value(F.floor(at)), value(F.ceil(at))
        return F.round(low + (high - low) * F.max(at - F.floor(at)), 3)

    return values.groupBy("l_returnflag").agg(cont(0.5).alias("med"), cont(0.9).alias("p90"))

sql("approx_distinct_bound", "SELECT l_returnflag, count(DISTINCT l_orderkey) AS n, true AS near, count(DISTINCT l_linenumber) AS few FROM {lineitem} GROUP BY l_returnflag", "SELECT l_returnflag, count(DISTINCT l_orderkey) AS n, abs(approx_count_distinct(l_orderkey) - count(DISTINCT l_orderkey)) <= 0.1 * count(DISTINCT l_orderkey) AS near, approx_count_distinct(l_linenumber) AS few FROM {lineitem} GROUP BY l_returnflag")
sql("approx_percentile_bound", "SELECT l_returnflag, quantile_disc(l_quantity, 0.5) AS half, quantile_disc(l_quantity, 0.9) AS most FROM {lineitem} GROUP BY l_returnflag", "SELECT l_returnflag, approx_percentile(l_quantity, 0.5, 1000000) AS half, approx_percentile(l_quantity, 0.9, 1000000) AS most FROM {lineitem} GROUP BY l_returnflag")
sql("first_last_by_order", "SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order FROM {orders} GROUP BY o_custkey", "SELECT o_custkey, min_by(o_orderkey, struct(o_orderdate, o_orderkey)) AS first_order, max_by(o_orderkey, struct(o_orderdate, o_orderkey)) AS last_order FROM {orders} GROUP BY o_custkey")
sql("daily_buckets", "SELECT day, count(*) AS n, round(avg(value), 4) AS avg_value FROM (SELECT date_trunc('day', ts) AS day, value FROM {events}) x GROUP BY day", "SELECT CAST(day AS TIMESTAMP_NTZ) AS day, count(*) AS n, round(avg(value), 4) AS avg_value FROM (SELECT date_trunc('day', ts) AS day, value FROM {events}) x GROUP BY day")

# --- windows -----------------------------------------------------------------------------------------


@frame("window_rank", "SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS rk, dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS dr, round(percent_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority), 6) AS pr, round(cume_dist() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority), 6) AS cd FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey)")
def _window_rank(t):
    orders = t("orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    rows = ranking.row_numbers(orders, ["o_orderstatus"], ascending("o_totalprice", "o_orderkey"), "rn")
    peers = ranking.peer_ranks(orders, ["o_orderstatus"], ["o_orderpriority"])
    rank, size = F.col("_before") + 1, F.col("_size")
    share = F.when(size == 1, 0.0).otherwise(F.col("_before") / (size - 1))
    met = ranking.same_groups(rows, peers, ["o_orderstatus", "o_orderpriority"])
    return met.select("o_orderkey", "rn", rank.cast("int").alias("rk"), F.col("_dense").cast("int").alias("dr"), F.round(share, 6).alias("pr"), F.round((F.col("_before") + F.col("_rows")) / size, 6).alias("cd"))


@frame("window_ntile", "SELECT o_orderkey, ntile(4) OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS quarter FROM orders")
def _window_ntile(t):
    rows = ranking.row_numbers(t("orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), ["o_orderstatus"], ascending("o_totalprice", "o_orderkey"), "rn", "n")
    # the first n % 4 quarters have a row more
    return rows.select("o_orderkey", F.expr("CAST(IF(rn <= n % 4 * (n DIV 4 + 1), (rn - 1) DIV (n DIV 4 + 1), n % 4 + (rn - 1 - n % 4 * (n DIV 4 + 1)) DIV greatest(n DIV 4, 1)) + 1 AS INT)").alias("quarter"))

sql("window_lag_lead", "SELECT event_id, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev, lead(value, 2, -1.0) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next2 FROM {events}")
sql("window_values", "SELECT event_id, first_value(event_id) OVER w AS f, last_value(event_id) OVER w AS l, nth_value(event_id, 2) OVER w AS n2 FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
sql("window_ignore_nulls", "SELECT event_id, last_value(NULLIF(event_type, 'view') IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_other FROM {events}", "SELECT event_id, last_value(CASE WHEN event_type <> 'view' THEN event_type END) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_other FROM {events}")
sql("window_rows", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 4) AS s, count(*) OVER (PARTITION BY user_id) AS n FROM {events}")


@frame("window_range", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey RANGE BETWEEN 50 PRECEDING AND CURRENT ROW) AS near FROM orders")
def _window_range(t):
    # spans of keys, each with the rows of the 50 keys before it
    span, at = 100_000, F.col("o_orderkey")
    own = t("orders").select("o_orderkey", "o_orderstatus", F.expr(f"(o_orderkey - pmod(o_orderkey, {span})) DIV {span}").alias("_span"), F.lit(True).alias("_own"))
    before = own.where(F.pmod(at, F.lit(span)) >= span - 50).withColumn("_span", F.col("_span") + 1).withColumn("_own", F.lit(False))
    w = Window.partitionBy("o_orderstatus", "_span").orderBy("o_orderkey").rangeBetween(-50, 0)
    return own.unionByName(before).withColumn("near", F.count("*").over(w)).where("_own").select("o_orderkey", "near")


@frame("window_groups", "SELECT c_custkey, count(*) OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n FROM customer")
def _window_groups(t):
    return compat.groups_frame(t("customer"), F.count("*"), ["c_mktsegment"], F.col("c_nationkey"), 1, 1, "n").select("c_custkey", "n")


@frame("qualify", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
def _qualify(t):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t("orders").withColumn("rn", F.row_number().over(w)).where("rn <= 2").select("o_custkey", "o_orderkey")


@frame("distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_orderdate FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey")
def _distinct_on(t):
    return compat.distinct_on(t("orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.desc("o_orderdate"), F.asc("o_orderkey")])


# --- sets and common table expressions ------------------------------------------------------------

sql("distinct_rows", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM {orders}")
sql("union_all", "SELECT c_nationkey AS k FROM {customer} WHERE c_acctbal > 9000 UNION ALL SELECT s_nationkey FROM {supplier}")
sql("union_distinct", "SELECT c_nationkey AS k FROM {customer} WHERE c_acctbal > 9000 UNION SELECT s_nationkey FROM {supplier}")
sql("intersect", "SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey FROM {supplier}")
sql("intersect_all", "SELECT c_nationkey AS k FROM {customer} INTERSECT ALL SELECT s_nationkey FROM {supplier}")
sql("except", "SELECT n_nationkey AS k FROM {nation} EXCEPT SELECT s_nationkey FROM {supplier} WHERE s_acctbal > 5000")
sql("except_all", "SELECT c_nationkey AS k FROM {customer} EXCEPT ALL SELECT s_nationkey FROM {supplier}")
sql("cte", "WITH spend AS (SELECT o_custkey AS k, sum(o_totalprice) AS total FROM {orders} GROUP BY o_custkey), best AS (SELECT k, total FROM spend WHERE total > 1500000) SELECT c_name, round(total, 2) AS total FROM best JOIN {customer} ON c_custkey = k")
sql("recursive_cte", "WITH RECURSIVE r(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM r WHERE n < 12) SELECT n, f FROM r")
sql("derived_table", "SELECT band, count(*) AS n FROM (SELECT CASE WHEN l_quantity < 10 THEN 's' WHEN l_quantity < 30 THEN 'm' ELSE 'l' END AS band FROM {lineitem}) x GROUP BY band")

# --- functions -----------------------------------------------------------------------------------------

sql("math_fns", "SELECT l_orderkey, l_linenumber, abs(l_quantity - 25) AS a, ceil(l_extendedprice) AS c, floor(l_extendedprice) AS f, round(sqrt(l_quantity), 6) AS s, round(ln(l_quantity), 6) AS ln, round(log10(l_quantity), 6) AS lg, round(log2(l_quantity), 6) AS l2, round(exp(l_discount), 6) AS e, round(pow(l_quantity, 2), 2) AS p, sign(l_quantity - 25) AS sg, round(cbrt(l_quantity), 6) AS cb FROM {lineitem}", "SELECT l_orderkey, l_linenumber, abs(l_quantity - 25) AS a, CAST(ceil(l_extendedprice) AS DOUBLE) AS c, CAST(floor(l_extendedprice) AS DOUBLE) AS f, round(sqrt(l_quantity), 6) AS s, round(ln(l_quantity), 6) AS ln, round(log10(l_quantity), 6) AS lg, round(log2(l_quantity), 6) AS l2, round(exp(l_discount), 6) AS e, round(pow(l_quantity, 2), 2) AS p, CAST(sign(l_quantity - 25) AS TINYINT) AS sg, round(cbrt(l_quantity), 6) AS cb FROM {lineitem}")
sql("trig_fns", "SELECT l_orderkey, l_linenumber, round(sin(l_discount), 8) AS s, round(cos(l_discount), 8) AS c, round(tan(l_discount), 8) AS t, round(asin(l_discount), 8) AS a1, round(acos(l_discount), 8) AS a2, round(atan(l_quantity), 8) AS a3, round(atan2(l_quantity, 2), 8) AS a4, round(degrees(l_discount), 6) AS d, round(radians(l_quantity), 8) AS r, round(sinh(l_discount), 8) AS sh, round(cosh(l_discount), 8) AS ch, round(tanh(l_discount), 8) AS th, round(cot(l_quantity), 6) AS ct, round(pi(), 8) AS pi FROM {lineitem}")
sql("string_fns", "SELECT c_custkey, upper(c_name) AS u, lower(c_mktsegment) AS l, length(c_name) AS n, reverse(c_name) AS r, substr(c_name, 3, 4) AS s, left(c_name, 3) AS lf, right(c_name, 2) AS rt, lpad(c_mktsegment, 14, '*') AS lp, rpad(c_mktsegment, 14, '-') AS rp, replace(c_name, 'C', 'K') AS rep, concat(c_name, '/', c_mktsegment) AS cc, concat_ws('-', c_name, c_mktsegment) AS cw, repeat('ab', 3) AS re, translate(c_mktsegment, 'AEIOU', 'aeiou') AS tr, trim('  x ') AS t, ltrim('  x ') AS lt, rtrim('  x ') AS rtr, ascii(c_mktsegment) AS asc_, chr(65) AS ch, starts_with(c_name, 'Cust') AS sw, contains(c_mktsegment, 'U') AS co, split_part(c_name, '#', 2) AS sp FROM {customer}", "SELECT c_custkey, upper(c_name) AS u, lower(c_mktsegment) AS l, length(c_name) AS n, reverse(c_name) AS r, substr(c_name, 3, 4) AS s, left(c_name, 3) AS lf, right(c_name, 2) AS rt, lpad(c_mktsegment, 14, '*') AS lp, rpad(c_mktsegment, 14, '-') AS rp, replace(c_name, 'C', 'K') AS rep, concat(c_name, '/', c_mktsegment) AS cc, concat_ws('-', c_name, c_mktsegment) AS cw, repeat('ab', 3) AS re, translate(c_mktsegment, 'AEIOU', 'aeiou') AS tr, trim('  x ') AS t, ltrim('  x ') AS lt, rtrim('  x ') AS rtr, ascii(c_mktsegment) AS asc_, chr(65) AS ch, startswith(c_name, 'Cust') AS sw, contains(c_mktsegment, 'U') AS co, split_part(c_name, '#', 2) AS sp FROM {customer}")
sql("string_position_fns", "SELECT p_partkey, CAST(instr(p_type, 'E') AS BIGINT) AS i, CAST(strpos(p_name, 'a') AS BIGINT) AS sp, ends_with(p_type, 'L') AS ew, CAST(levenshtein(p_brand, 'Brand#33') AS BIGINT) AS lv, CAST(bit_length(p_name) AS BIGINT) AS bl, CAST(octet_length(encode(p_name)) AS BIGINT) AS ol, CAST(ascii(p_brand) AS BIGINT) AS a FROM {part}", "SELECT p_partkey, CAST(instr(p_type, 'E') AS BIGINT) AS i, CAST(position('a', p_name) AS BIGINT) AS sp, endswith(p_type, 'L') AS ew, CAST(levenshtein(p_brand, 'Brand#33') AS BIGINT) AS lv, CAST(bit_length(p_name) AS BIGINT) AS bl, CAST(octet_length(p_name) AS BIGINT) AS ol, CAST(ascii(p_brand) AS BIGINT) AS a FROM {part}")
sql("regex_fns", "SELECT p_partkey, regexp_matches(p_name, '[aeiou][aeiou]') AS m, regexp_replace(p_name, '[0-9]+', '#', 'g') AS r, regexp_extract(p_brand, '([0-9]+)', 1) AS x, CAST(len(regexp_extract_all(p_name, '[aeiou]')) AS BIGINT) AS n FROM {part}", "SELECT p_partkey, regexp_like(p_name, '[aeiou][aeiou]') AS m, regexp_replace(p_name, '[0-9]+', '#') AS r, regexp_extract(p_brand, '([0-9]+)', 1) AS x, CAST(regexp_count(p_name, '[aeiou]') AS BIGINT) AS n FROM {part}")
sql("date_fns", "SELECT o_orderkey, CAST(extract(year FROM o_orderdate) AS BIGINT) AS y, CAST(extract(month FROM o_orderdate) AS BIGINT) AS m, CAST(extract(day FROM o_orderdate) AS BIGINT) AS d, CAST(date_part('quarter', o_orderdate) AS BIGINT) AS q, CAST(extract(hour FROM o_orderdate) AS BIGINT) AS h, CAST(o_orderdate AS DATE) AS dt, CAST(date_trunc('month', o_orderdate) AS DATE) AS mo, strftime(o_orderdate, '%Y-%m') AS ym, CAST(epoch(o_orderdate) AS BIGINT) AS ep, make_date(2024, 2, 29) AS md FROM {orders}", "SELECT o_orderkey, CAST(extract(year FROM o_orderdate) AS BIGINT) AS y, CAST(extract(month FROM o_orderdate) AS BIGINT) AS m, CAST(extract(day FROM o_orderdate) AS BIGINT) AS d, CAST(date_part('quarter', o_orderdate) AS BIGINT) AS q, CAST(extract(hour FROM o_orderdate) AS BIGINT) AS h, CAST(o_orderdate AS DATE) AS dt, CAST(date_trunc('month', o_orderdate) AS DATE) AS mo, date_format(o_orderdate, 'yyyy-MM') AS ym, unix_timestamp(CAST(o_orderdate AS TIMESTAMP)) AS ep, make_date(2024, 2, 29) AS md FROM {orders}")
sql("hash_fns", "SELECT c_custkey, md5(c_name) AS m, sha256(c_name) AS s, hex(c_name) AS h, lower(to_hex(c_custkey)) AS th, to_base64(encode(c_name)) AS b FROM {customer}", "SELECT c_custkey, md5(c_name) AS m, sha2(c_name, 256) AS s, hex(c_name) AS h, lower(hex(c_custkey)) AS th, base64(c_name) AS b FROM {customer}")
sql("json_fns", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM {events}", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM {events}")
sql("conditional_fns", "SELECT c_custkey, NULLIF(c_mktsegment, 'BUILDING') AS nu, coalesce(NULLIF(c_mktsegment, 'BUILDING'), 'none') AS co, ifnull(NULLIF(c_nationkey, 3), -1) AS fn, greatest(c_nationkey, 10) AS g, least(c_nationkey, 10) AS l FROM {customer}")
sql("casts", "SELECT o_orderkey, CAST(o_totalprice AS BIGINT) AS b, CAST(o_orderkey AS VARCHAR) AS s, CAST('12.50' AS DECIMAL(10, 2)) AS d, CAST('2024-05-06' AS DATE) AS dt FROM {orders} WHERE o_totalprice = floor(o_totalprice) OR o_orderkey < 20", "SELECT o_orderkey, CAST(rint(o_totalprice) AS BIGINT) AS b, CAST(o_orderkey AS STRING) AS s, CAST('12.50' AS DECIMAL(10, 2)) AS d, CAST('2024-05-06' AS DATE) AS dt FROM {orders} WHERE o_totalprice = floor(o_totalprice) OR o_orderkey < 20")
sql("struct_map_fns", "SELECT n_nationkey, struct_pack(a := n_name, b := n_regionkey).a AS a, map([n_name], [n_regionkey])[n_name] AS m, len(map_keys(map([n_name], [1]))) AS k FROM {nation}", "SELECT n_nationkey, named_struct('a', n_name, 'b', n_regionkey).a AS a, element_at(map(n_name, n_regionkey), n_name) AS m, CAST(size(map_keys(map(n_name, 1))) AS BIGINT) AS k FROM {nation}")


@frame("array_fns", "SELECT vec_id, CAST(len(embedding) AS BIGINT) AS n, CAST(embedding[1] AS DOUBLE) AS first, CAST(list_max(embedding) AS DOUBLE) AS top, CAST(list_min(embedding) AS DOUBLE) AS low, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total, CAST(list_position(embedding, list_max(embedding)) AS BIGINT) AS at, CAST(len(embedding[2:5]) AS BIGINT) AS part, CAST(len(list_distinct(embedding)) AS BIGINT) AS kinds FROM embeddings")
def _array_fns(t):
    e = F.col("embedding")
    return t("embeddings").select("vec_id", F.size(e).cast("bigint").alias("n"), F.element_at(e, 1).cast("double").alias("first"), F.array_max(e).cast("double").alias("top"), F.array_min(e).cast("double").alias("low"), F.round(compat.array_sum(e), 4).alias("total"), F.array_position(e, F.array_max(e)).cast("bigint").alias("at"), F.size(compat.array_slice(e, 2, 5)).cast("bigint").alias("part"), F.size(F.array_distinct(e)).cast("bigint").alias("kinds"))


@frame("array_set_fns", "SELECT vec_id, list_has_all([1, 2, 3, label], [2, 3]) AS a, list_has_any([1, 2], [label]) AS b, array_to_string(list_sort(list_distinct(list_concat([label], [1, 2]))), ',') AS c, array_to_string([label, 5, 7][1:2], ',') AS d FROM embeddings")
def _array_set_fns(t):
    f, a = F.col("label"), F.array
    ints = lambda *xs: a(*(F.lit(x) for x in xs))
    return t("embeddings").select("vec_id", compat.array_has_all(F.concat(ints(1, 2, 3), a(f)), ints(2, 3)).alias("a"), compat.array_has_any(ints(1, 2), a(f)).alias("b"), F.array_join(F.array_sort(F.array_union(a(f), ints(1, 2))), ",").alias("c"), F.array_join(compat.array_pop_back(a(f, F.lit(5), F.lit(7))), ",").alias("d"))


@frame("gcd_lcm", "SELECT p_partkey, gcd(p_partkey, p_size) AS g, lcm(p_partkey, p_size) AS l FROM part")
def _gcd_lcm(t):
    return t("part").select("p_partkey", compat.gcd("p_partkey", "p_size").alias("g"), compat.lcm("p_partkey", "p_size").alias("l"))


@frame("date_bin", "SELECT event_id, time_bucket(INTERVAL '15 minutes', ts, TIMESTAMP '1970-01-01') AS slot FROM events")
def _date_bin(t):
    return t("events").select("event_id", compat.date_bin(900, "ts").alias("slot"))


@frame("similar_to", "SELECT p_partkey, regexp_full_match(p_brand, 'Brand#(1|2)(?s:.*)') AS s, regexp_matches(p_name, '^[a-m]') AS r FROM part")
def _similar_to(t):
    return t("part").select("p_partkey", compat.similar_to("p_brand", "Brand#(1|2)%").alias("s"), compat.regex_match("p_name", "^[a-m]").alias("r"))


@frame("integer_division", "SELECT o_orderkey, (o_orderkey - 500) // 7 AS q FROM orders WHERE o_orderkey >= 500")
def _integer_division(t):
    return t("orders").where("o_orderkey >= 500").select("o_orderkey", compat.int_div(F.col("o_orderkey") - 500, F.lit(7)).alias("q"))


@frame("unnest", "SELECT vec_id, unnest(range(1, 4)) AS i, unnest(embedding[1:3])::DOUBLE AS x FROM embeddings")
def _unnest(t):
    return t("embeddings").select("vec_id", F.posexplode(F.slice("embedding", 1, 3))).select("vec_id", (F.col("pos") + 1).cast("bigint").alias("i"), F.col("col").cast("double").alias("x"))


sql("generate_series", "SELECT g FROM (SELECT unnest(generate_series(1, 20, 3)) AS g)", "SELECT CAST(g AS BIGINT) AS g FROM (SELECT explode(sequence(1, 20, 3)) AS g)")
