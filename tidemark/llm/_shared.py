"""What the corpus operators share: reading tables, cutting lineage, hashing a row's id."""

from __future__ import annotations

import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.workspace import one_machine, ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shipped(df: DataFrame) -> DataFrame:
    """``df``, whose session's executors have this package now: they import it with the functions that they run."""
    ship(df.sparkSession)
    return df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and all runs on one machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        one_machine(spark)
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of frames that are no longer held, as it does on its own every half hour."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_of_id(column: str | Column) -> Column:
    """crc32 of the id written in decimal; null ids hash as the empty text."""
    c = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


def texts_of(batch, name: str = "text") -> list[str]:
    """The column as Python strings, null as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


class WorkerCache(dict):
    """What a Python worker keeps for an operator between tasks. Workers run one stage after another: only the last operator's stays."""

    every: list[WorkerCache] = []

    def __init__(self) -> None:
        super().__init__()
        self.every.append(self)

    def mine(self) -> None:
        """Drops what other operators have kept."""
        held = [c for c in self.every if c and c is not self]
        for c in held:
            c.clear()
        if held:
            gc.collect()
            pa.default_memory_pool().release_unused()


def set_aside(df: DataFrame, used: set[str]) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns of names that an operator uses itself renamed, and their own names by the new ones."""
    clash = {c: f"__own_{c}" for c in df.columns if c.lower() in used}
    return df.withColumnsRenamed(clash), {new: old for old, new in clash.items()}
