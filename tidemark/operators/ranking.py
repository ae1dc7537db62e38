"""Numbers of rows in an order over large or few groups, by all tasks.

A window over all rows, or over a few groups, is one task's work for each
group. Here rows are dealt into ranges of the group and the order, sorted and
numbered within each, and cut from their lineage, so that ranges are drawn once;
a range's numbers begin after the rows of those before it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.workspace import scratch

#: Rows of a range that a task sorts, where the shuffle has fewer partitions than that gives.
RANGE_ROWS = 500_000
#: Groups whose sizes are broadcast.
MOST_GROUPS = 10_000


def numbered(df: DataFrame, order: list[Column], name: str = "_n") -> DataFrame:
    """``df`` with each row's number, from 1, in the given order of all rows; ties are numbered in any order.

    Numbers per range reach the driver: one for each task.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // RANGE_ROWS))
    id_ = F.monotonically_increasing_id()
    path = f"{scratch(spark)}/ranks-{uuid.uuid4().hex}"
    # the number's upper bits are the range, the lower 33 the place in it
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", id_)
    ranged.write.option("compression", "zstd").parquet(path)
    held = spark.read.schema(ranged.schema).parquet(path)
    sizes = {r["_range"]: r["count"] for r in held.groupBy(F.shiftright("_at", 33).alias("_range")).count().collect()}
    if not sizes:
        return held.withColumn(name, F.col("_at") + 1).drop("_at")
    starts, total = [], 0
    for i in range(max(sizes) + 1):
        starts.append(total)
        total += sizes.get(i, 0)
    start = F.get(F.lit(starts).cast("array<bigint>"), F.shiftright("_at", 33).cast("int"))
    return held.withColumn(name, start + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_at")


def same_groups(a: DataFrame, b: DataFrame, partition: list[str]) -> DataFrame:
    """``a`` with the columns of ``b``, which has a row for each group; nulls are one group. Up to ``MOST_GROUPS`` rows are broadcast."""
    if b.limit(MOST_GROUPS + 1).count() <= MOST_GROUPS:
        b = F.broadcast(b)
    if not partition:
        return a.crossJoin(b)
    names = {c: f"_of_{c}" for c in partition}
    met = a.join(b.withColumnsRenamed(names), [F.col(f"`{c}`").eqNullSafe(F.col(f"`{n}`")) for c, n in names.items()])
    return met.drop(*names.values())


def row_numbers(df: DataFrame, partition: list[str], order: list[Column], name: str, size: str | None = None) -> DataFrame:
    """``row_number()`` within groups as column ``name``; ``size``: a column for the rows of the group."""
    if not partition and size is None:
        return numbered(df, order, name)
    all_ = numbered(df, [*(F.col(f"`{c}`") for c in partition), *order], "_n")
    groups = all_.groupBy(*partition).agg(F.min("_n").alias("_first"), F.count("*").alias("_size"))
    out = same_groups(all_, groups, partition).withColumn(name, (F.col("_n") - F.col("_first") + 1).cast("int"))
    return (out if size is None else out.withColumn(size, F.col("_size"))).drop("_n", "_first", "_size")


def ascending(*names: str) -> list[Column]:
    """Columns in ascending order, nulls last."""
    return [F.col(f"`{c}`").asc_nulls_last() for c in names]


def peer_ranks(df: DataFrame, partition: list[str], order: list[str]) -> DataFrame:
    """A row for each group and value of the order columns, ascending: see ``running``."""
    return running(df.groupBy(*partition, *order).agg(F.count("*").alias("_rows")), partition, ascending(*order))


def running(counts: DataFrame, partition: list[str], order: list[Column]) -> DataFrame:
    """``counts``, with ``_rows`` for each value of a group, and with the rows before it as ``_before``, its place as ``_dense`` and the group's rows as ``_size``.

    Sums go over blocks of values, then over the blocks.
    """
    at = numbered(counts, [*(F.col(f"`{c}`") for c in partition), *order], "_n").withColumn("_block", F.floor((F.col("_n") - 1) / F.lit(RANGE_ROWS)))
    blocks = at.groupBy("_block").agg(F.sum("_rows").alias("_sum"))
    starts = blocks.withColumn("_start", F.sum("_sum").over(Window.orderBy("_block")) - F.col("_sum")).drop("_sum")
    within = F.sum("_rows").over(Window.partitionBy("_block").orderBy("_n")) - F.col("_rows")
    all_ = at.withColumn("_in", within).join(starts, "_block").withColumn("_before", F.col("_start") + F.col("_in"))
    groups = all_.groupBy(*partition).agg(F.min("_before").alias("_first"), F.min("_n").alias("_one"), F.sum("_rows").alias("_size"))
    out = same_groups(all_, groups, partition).withColumn("_before", F.col("_before") - F.col("_first")).withColumn("_dense", F.col("_n") - F.col("_one") + 1)
    return out.drop("_n", "_block", "_start", "_in", "_first", "_one")
