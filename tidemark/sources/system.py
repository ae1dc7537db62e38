"""System tables, external files, extracts, and guards around a result."""

from __future__ import annotations

import threading
import time
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidemark.errors import EngineError, NotSupported
from tidemark.sources.catalog import Catalog

FIRST_OID = 16_384
#: Type numbers that clients of the wire protocol know.
TYPE_OIDS = {"boolean": 16, "binary": 17, "tinyint": 21, "smallint": 21, "int": 23, "bigint": 20, "float": 700, "double": 701, "string": 25, "date": 1082, "timestamp": 1184, "timestamp_ntz": 1114}


def oid(name: str) -> int:
    """A stable number for a name."""
    return FIRST_OID + zlib.crc32(name.encode()) % (2**31 - FIRST_OID - 1)


def pg_catalog(catalog: Catalog) -> dict[str, DataFrame]:
    """pg_namespace, pg_class, pg_attribute and pg_type made from one listing, so that their numbers join."""
    spark, names = catalog.spark, catalog.names()
    tables = {n: catalog.load(n) for n in names}
    namespaces = sorted({n.split(".")[0] for n in names})
    return {
        "pg_namespace": spark.createDataFrame([(oid(n), n) for n in namespaces], "oid bigint, nspname string"),
        "pg_class": spark.createDataFrame([(oid(n), n.split(".")[1], oid(n.split(".")[0]), "r", len(tables[n].struct())) for n in names], "oid bigint, relname string, relnamespace bigint, relkind string, relnatts int"),
        "pg_attribute": spark.createDataFrame([(oid(n), f.name, TYPE_OIDS.get(f.dataType.simpleString(), 25), i, not f.nullable) for n in names for i, f in enumerate(tables[n].struct().fields, 1)], "attrelid bigint, attname string, atttypid bigint, attnum int, attnotnull boolean"),
        "pg_type": spark.createDataFrame(sorted({(o, k) for k, o in TYPE_OIDS.items() if k not in ("tinyint",)}), "oid bigint, typname string"),
    }


def tails(catalog: Catalog) -> DataFrame:
    """The tables that have a change tail."""
    rows = [tuple(n.split(".")) for n in catalog.names() if catalog.store.names(catalog.load(n).location + "/tail/log")]
    return catalog.spark.createDataFrame(rows, "table_schema string, table_name string")


def external(spark: SparkSession, kind: str, path: str, schema: T.StructType | str | None = None, **options: str) -> DataFrame:
    """Files outside the catalog: parquet, csv, json, orc or text. Text formats take a schema, so that no pass infers one."""
    if kind not in ("parquet", "csv", "json", "orc", "text"):
        raise NotSupported(f"files of kind {kind}")
    if kind in ("csv", "json") and schema is None:
        raise EngineError(f"{kind} files need a schema")
    reader = spark.read.options(**options)
    return (reader.schema(schema) if schema is not None else reader).format(kind).load(path)


def extract(df: DataFrame, path: str, codec: str = "zstd", max_records: int | None = None) -> None:
    """The rows as Parquet for another tool."""
    w = df.write.option("compression", codec)
    (w.option("maxRecordsPerFile", max_records) if max_records else w).parquet(path)


def guarded(df: DataFrame, seconds: float | None = None, max_bytes: int | None = None) -> Iterator[pa.RecordBatch]:
    """Arrow batches of the result, partition by partition; over the time its jobs are cancelled, over the bytes it ends with an error."""
    context, group = df.sparkSession.sparkContext, f"guarded-{time.monotonic_ns()}"
    late = threading.Event()

    def cancel() -> None:
        late.set()
        context.cancelJobGroup(group)

    timer = threading.Timer(seconds, cancel) if seconds else None
    context.setJobGroup(group, "guarded", interruptOnCancel=True)
    if timer:
        timer.start()
    sent = 0
    schema = pa.schema([pa.field(f.name, pa.null()) for f in df.schema.fields])
    try:
        rows: list = []
        for row in df.toLocalIterator():
            rows.append(row)
            if len(rows) == 8192:
                batch = pa.RecordBatch.from_pylist([r.asDict() for r in rows])
                rows, sent = [], sent + batch.nbytes
                if max_bytes is not None and sent > max_bytes:
                    raise EngineError(f"the result is over {max_bytes} bytes")
                yield batch
        batch = pa.RecordBatch.from_pylist([r.asDict() for r in rows]) if rows else pa.RecordBatch.from_pylist([], schema=schema)
        if max_bytes is not None and sent + batch.nbytes > max_bytes:
            raise EngineError(f"the result is over {max_bytes} bytes")
        yield batch
    except Exception:
        if late.is_set():
            raise EngineError(f"the statement took over {seconds} s") from None
        raise
    finally:
        if timer:
            timer.cancel()
        context.setLocalProperty("spark.jobGroup.id", None)


@dataclass
class Metrics:
    """Counts and seconds by kind of statement."""

    counts: dict[str, int] = field(default_factory=dict)
    seconds: dict[str, float] = field(default_factory=dict)
    errors: dict[str, int] = field(default_factory=dict)

    def timed(self, kind: str, work):
        began = time.perf_counter()
        try:
            return work()
        except EngineError as e:
            self.errors[e.sqlstate] = self.errors.get(e.sqlstate, 0) + 1
            raise
        finally:
            self.counts[kind] = self.counts.get(kind, 0) + 1
            self.seconds[kind] = self.seconds.get(kind, 0.0) + time.perf_counter() - began
