"""A table's change tail: numbered batches of rows, their replay, and the flush into the table.

Every batch is a folder of Parquet whose rows have consecutive sequence numbers, by
writing partition and place in it.
A batch's place in the log is a file that is created only if it doesn't exist,
so that two writers never share numbers. Flushing commits the changes and the
highest flushed number together; a replay skips what the table has.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tidemark.errors import EngineError, SerializationFailure
from tidemark.operators import overlay
from tidemark.operators.dml import ATTEMPTS
from tidemark.operators.overlay import APPEND, DELETE, OP, SEQ, UPSERT
from tidemark.sources.catalog import Catalog
from tidemark.sources.meta import Table

WATERMARK = "tail.watermark"
#: Rows in one flush at most before another is due.
FLUSH_ROWS = 50_000


#: Column names of a batch's files: the writing partition, and a row's place in it.
PART, PLACE = "_part", "_place"


class TailLog:
    """The tail of table ``name`` in ``catalog``.

    A batch is written once; its record in the log says at which of its numbers
    each writing partition begins. Records never change, and are read once a
    process.
    """

    _records: dict[str, dict] = {}

    def __init__(self, catalog: Catalog, name: str, table: Table | None = None) -> None:
        self.catalog, self.name = catalog, name
        self.folder = (table or catalog.load(name)).location + "/tail"
        self.store = catalog.store

    def schema(self) -> T.StructType:
        fields = [T.StructField(f.name, f.dataType) for f in self.catalog.load(self.name).struct().fields]
        return T.StructType([*fields, T.StructField(SEQ, T.LongType()), T.StructField(OP, T.StringType())])

    def batches(self) -> list[dict]:
        """The records of the log, in order: first, last, path, op, starts."""
        out = []
        for n in self.store.names(f"{self.folder}/log"):
            if n.endswith(".json"):
                path = f"{self.folder}/log/{n}"
                if path not in self._records:
                    self._records[path] = json.loads(self.store.read(path))
                out.append(self._records[path])
        return out

    @property
    def high(self) -> int:
        found = self.batches()
        return found[-1]["last"] if found else 0

    def watermark(self) -> int | None:
        w = self.catalog.load(self.name).properties.get(WATERMARK)
        return None if w is None else int(w)

    def pending(self, table: Table) -> int:
        """Changes beyond the table's watermark."""
        return max(0, self.high - int(table.properties.get(WATERMARK, 0)))

    def due(self) -> bool:
        """Whether a flush is due by rows."""
        return self.pending(self.catalog.load(self.name)) >= FLUSH_ROWS

    def write(self, rows: DataFrame, op: str = APPEND) -> tuple[int, int]:
        """Acknowledges ``rows`` under new sequence numbers: the first and the last. Deletes need the key columns only."""
        table = self.catalog.load(self.name)
        if op not in (APPEND, UPSERT, DELETE):
            raise EngineError(f"unknown operation {op}")
        if op != APPEND and not table.primary_key:
            raise EngineError(f"{self.name} has no primary key for a keyed change")
        for f in table.struct().fields:
            if f.name not in rows.columns:
                rows = rows.withColumn(f.name, F.lit(None).cast(f.dataType))
        rows = rows.select(*(F.col(f"`{f.name}`").cast(f.dataType) for f in table.struct().fields))
        path = f"{self.folder}/data/{uuid.uuid4().hex}"
        place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        rows.withColumns({PART: F.spark_partition_id(), PLACE: place}).write.parquet(path)
        sizes = self.catalog.spark.read.schema(f"{PART} int").parquet(path).groupBy(PART).count().orderBy(PART).collect()
        starts, total = {}, 0
        for r in sizes:
            starts[str(r[PART])] = total
            total += r["count"]
        if not total:
            return self.high + 1, self.high
        while True:
            done = self.batches()
            first = (done[-1]["last"] if done else 0) + 1
            record = {"first": first, "last": first + total - 1, "path": path, "op": op, "starts": starts}
            if self.store.create(f"{self.folder}/log/{len(done):012d}.json", json.dumps(record).encode()):
                return record["first"], record["last"]

    def read(self, since: int | None = None, until: int | None = None) -> DataFrame:
        """Changes with since < sequence <= until; batches outside are not opened."""
        schema, out = self.schema(), None
        columns = schema.names[:-2]
        stored = T.StructType([*schema.fields[:-2], T.StructField(PART, T.IntegerType()), T.StructField(PLACE, T.LongType())])
        for b in self.batches():
            if (since is not None and b["last"] <= since) or (until is not None and b["first"] > until):
                continue
            part = self.catalog.spark.read.schema(stored).parquet(b["path"])
            start = F.lit(0)
            if len(b["starts"]) > 1:
                at = self.catalog.spark.createDataFrame([(int(p), s) for p, s in b["starts"].items()], f"{PART} int, _start bigint")
                # a row for each file of the batch: far smaller than the rows, which would meet in as many tasks as it has files
                part, start = part.join(F.broadcast(at), PART), F.col("_start")
            part = part.select(*(F.col(f"`{c}`") for c in columns), (F.lit(b["first"]) + start + F.col(PLACE)).cast("bigint").alias(SEQ), F.lit(b["op"]).alias(OP))
            out = part if out is None else out.unionByName(part)
        if out is None:
            return self.catalog.spark.createDataFrame([], schema)
        if since is not None:
            out = out.where(F.col(SEQ) > since)
        return out if until is None else out.where(F.col(SEQ) <= until)

    def merged(self, table: Table | None = None) -> DataFrame:
        """The table with its tail; metadata is read before the tail, so that nothing is missed or doubled."""
        table = table or self.catalog.load(self.name)
        w = table.properties.get(WATERMARK)
        committed = self.catalog.read_files(table, self.catalog.files(table, table.head()))
        mark = None if w is None else int(w)
        return overlay.merged_fresh(committed, self.read(mark), table.primary_key, mark)

    def flush(self, until: int | None = None) -> int | None:
        """Commits the changes up to ``until`` (all, if None) with the watermark, once; the new watermark, None if there was nothing.

        What is highest is settled first: a batch written meanwhile is neither
        in the commit nor under its watermark.
        """
        high = self.high if until is None else min(until, self.high)
        return flush_changes(self.catalog, self.name, self.read(self.watermark(), high), high)


def flush_changes(catalog: Catalog, name: str, changes: DataFrame, high: int) -> int | None:
    """Commits ``changes``, which hold all up to ``high`` that the table lacks, in one snapshot with the watermark.

    A declared key isn't enforced here: acknowledged appends are never refused.
    """
    for attempt in range(1, ATTEMPTS + 1):
        pointer = catalog.pointer(name)
        table = Table.from_json(catalog.store.read(pointer))
        w = table.properties.get(WATERMARK)
        if high <= int(w or 0):
            return None
        fresh = overlay.after(changes, None if w is None else int(w)).where(F.col(SEQ) <= high)
        try:
            catalog.swap([(name, pointer, _folded(catalog, table, fresh, {WATERMARK: str(high)}))])
            return high
        except SerializationFailure:
            if attempt == ATTEMPTS:
                raise
    return None


def _folded(catalog: Catalog, table: Table, fresh: DataFrame, properties: dict[str, str]) -> Table:
    """New metadata with the changes: files that hold keys of keyed ones are rewritten by an anti join, all else is added."""
    key, columns = table.primary_key, table.struct().names
    files = catalog.files(table, table.head())
    rewrite: list = []
    if key:
        keyed = fresh.where(F.col(OP).isin(UPSERT, DELETE)).select(*key).distinct()
        if files:
            rows = catalog.read_files(table, files, file_path=True)
            hit = {catalog._plain(r[0]) for r in rows.join(keyed, key, "left_semi").select("_file").distinct().collect()}
            rewrite = [f for f in files if catalog._plain(f.path) in hit]
        new = overlay.merged_fresh(catalog.read_files(table, rewrite), fresh, key).select(columns)
    else:
        new = fresh.select(columns)
    paths = {f.path for f in rewrite}
    added = [f for f in catalog.write_files(table, new, key) if f.rows]
    out, _ = catalog.add_snapshot(table, [f for f in files if f.path not in paths], added, rewrite, "overwrite" if rewrite else "append")
    out.properties |= properties
    return out


def follow(changes: DataFrame, catalog: Catalog, name: str, checkpoint: str, once: bool = True, seconds: float = 1.0):
    """Flushes a stream of changes (the table's columns, _seq, _op) into the table; replayed batches change nothing."""

    def flush(batch: DataFrame, _: int) -> None:
        high = batch.agg(F.max(SEQ)).first()[0]
        if high is not None:
            flush_changes(catalog, name, batch, high)

    writer = changes.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()


# --- the tail as a data source --------------------------------------------------------------------


class _Batch(InputPartition):
    def __init__(self, record: dict) -> None:
        self.record = record


def _at(path: str):
    """A file system of Arrow and the path on it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _files(path: str, suffix: str) -> list[tuple]:
    from pyarrow import fs

    system, folder = _at(path)
    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return [(system, f.path) for f in sorted(found, key=lambda f: f.path) if f.path.endswith(suffix)]


def _rows(record: dict, since: int, until: int | None, schema: T.StructType) -> Iterator:
    """Arrow batches of a record's rows with since < sequence <= until."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    starts = {int(k): v for k, v in record["starts"].items()}
    for system, path in _files(record["path"], ".parquet"):
        with system.open_input_file(path) as f:
            for b in pq.ParquetFile(f).iter_batches():
                start = np.array([starts[p] for p in b.column(PART).to_pylist()], np.int64)
                seq = b.column(PLACE).to_numpy() + start + record["first"]
                keep = (seq > since) & (seq <= (record["last"] if until is None else until))
                own = {SEQ: pa.array(seq, pa.int64()), OP: pa.array([record["op"]] * b.num_rows, pa.string())}
                columns = [own[n] if n in own else b.column(n).cast(arrow.field(n).type) for n in schema.names]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow).filter(pa.array(keep))


def _log(folder: str) -> list[dict]:
    found = []
    for system, path in _files(folder + "/log", ".json"):
        with system.open_input_file(path) as f:
            found.append(json.loads(f.read()))
    return found


class TailSource(DataSource):
    """``format("tidemark_tail")`` with options folder (the tail's) and from_seq; give the schema of TailLog.schema().

    It reads Arrow batches through Arrow's file systems; on a store that these lack read TailLog.read().
    """

    @classmethod
    def name(cls) -> str:
        return "tidemark_tail"

    def schema(self) -> str:
        raise EngineError("give the tail's schema")

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _TailReader(self.options, schema)

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return _TailStream(self.options, schema)


class _TailReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType) -> None:
        self.folder, self.since, self.schema = options["folder"], int(options.get("from_seq", 0)), schema

    def partitions(self) -> list[InputPartition]:
        return [_Batch(b) for b in _log(self.folder) if b["last"] > self.since]

    def read(self, partition: _Batch) -> Iterator:
        return _rows(partition.record, self.since, None, self.schema)


class _TailStream(DataSourceStreamReader):
    """Offsets are sequence numbers; each batch of the log is a partition, read by an executor."""

    def __init__(self, options: dict, schema: T.StructType) -> None:
        self.folder, self.since, self.schema = options["folder"], int(options.get("from_seq", 0)), schema

    def initialOffset(self) -> dict:
        return {"seq": self.since}

    def latestOffset(self) -> dict:
        return {"seq": max([self.since, *(b["last"] for b in _log(self.folder))])}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Batch(b | {"since": start["seq"], "until": end["seq"]}) for b in _log(self.folder) if b["last"] > start["seq"] and b["first"] <= end["seq"]]

    def read(self, partition: _Batch) -> Iterator:
        return _rows(partition.record, partition.record["since"], partition.record["until"], self.schema)
