"""The catalog: versioned tables as Parquet files under a folder, and their commits.

All pointers to table metadata lie in one catalog file, whose next version is
created only if it doesn't exist: that is the compare-and-swap, for one table or
for several at once. Data files are never overwritten; a commit adds files and
a new list of the live ones.
"""

from __future__ import annotations

import itertools
import json
import random
import time
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import DuplicateTable, EngineError, SerializationFailure, UndefinedColumn, UndefinedTable
from tidemark.sources.meta import MAIN, DataFile, Snapshot, Table, fields_of, manifest_from, manifest_json
from tidemark.sources.store import Store

DEFAULT_NAMESPACE = "public"
#: Attempts of a commit that recomputes on newer metadata.
ATTEMPTS = 3
#: Rows of metadata given to Spark as a local table at most per file listing.
MANIFESTS = "path string, rows bigint, bytes bigint, status string, schema_id int"
SNAPSHOTS = "snapshot_id bigint, parent_id bigint, committed_at timestamp_ntz, operation string, summary map<string,string>, schema_id int"


def canonical(name: str) -> str:
    """``namespace.table``, with the default namespace where there is none."""
    parts = name.split(".")
    if len(parts) > 3 or not all(parts):
        raise UndefinedTable(f"bad table name {name}")
    return ".".join(parts[-2:]) if len(parts) > 1 else f"{DEFAULT_NAMESPACE}.{name}"


def align(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns by position, with names that match in any case, cast; overflows and bad text are errors."""
    if len(df.columns) != len(schema):
        raise EngineError(f"{len(df.columns)} columns for a table of {len(schema)}")
    for have, want in zip(df.columns, schema.names):
        if have.lower() != want.lower():
            raise UndefinedColumn(f"column {have} where the table has {want}")
    renamed = df.toDF(*schema.names)
    return renamed.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields))


class Catalog:
    """``clock``: milliseconds now; ``ids``: next snapshot id. Both can be fixed in tests."""

    def __init__(self, spark: SparkSession, root: str, clock: Callable[[], int] | None = None, ids: Callable[[], int] | None = None) -> None:
        self.spark, self.store = spark, Store(spark, root)
        self.clock = clock or (lambda: time.time_ns() // 1_000_000)
        self.ids = ids or (lambda: random.getrandbits(62))
        self.commit_hook: Callable[[], None] | None = None

    # --- state

    def _versions(self) -> list[int]:
        return sorted(int(n[1:-5]) for n in self.store.names(self.store.path("catalog")) if n.startswith("v") and n.endswith(".json"))

    def state(self) -> tuple[int, dict[str, str]]:
        """The catalog's version and each table's metadata file."""
        versions = self._versions()
        if not versions:
            return 0, {}
        return versions[-1], json.loads(self.store.read(self.store.path("catalog", f"v{versions[-1]}.json")))

    def names(self) -> list[str]:
        return sorted(self.state()[1])

    def pointer(self, name: str) -> str:
        tables = self.state()[1]
        if (name := canonical(name)) not in tables:
            raise UndefinedTable(f"no table {name}")
        return tables[name]

    def load(self, name: str) -> Table:
        return Table.from_json(self.store.read(self.pointer(name)))

    def _swap(self, changes: dict[str, tuple[str | None, str | None]]) -> None:
        """Pointers from what they were expected to be to new ones, all or none."""
        if self.commit_hook:
            self.commit_hook()
        while True:
            version, tables = self.state()
            for name, (old, new) in changes.items():
                if tables.get(name) != old:
                    raise SerializationFailure(f"{name} was changed by another commit")
                if new is None:
                    tables.pop(name, None)
                else:
                    tables[name] = new
            if self.store.create(self.store.path("catalog", f"v{version + 1}.json"), json.dumps(tables, sort_keys=True).encode()):
                return
            # another commit took this version; if it left our tables alone, ours still holds

    def _write(self, table: Table) -> str:
        path = f"{table.location}/metadata/{uuid.uuid4().hex}.json"
        if not self.store.create(path, table.to_json()):
            raise EngineError(f"{path} exists")
        return path

    def swap(self, changes: Iterable[tuple[str, str, Table]]) -> None:
        """New metadata of tables, each with the pointer that it was made from."""
        self._swap({canonical(name): (old, self._write(table)) for name, old, table in changes})

    # --- tables

    def create(self, name: str, schema: T.StructType, primary_key: Iterable[str] = (), properties: dict[str, str] | None = None) -> Table:
        name = canonical(name)
        if name in self.state()[1]:
            raise DuplicateTable(f"{name} exists")
        location = self.store.path("tables", *name.split("."), uuid.uuid4().hex[:8])
        fields = fields_of(schema)
        table = Table(name, location, [{"fields": fields}], last_field_id=len(fields), properties=dict(properties or {}))
        if primary_key:
            table.properties["primary-key"] = ",".join(primary_key)
        table.primary_key  # noqa: B018  unknown columns are an error now
        self._swap({name: (None, self._write(table))})
        return table

    def drop(self, name: str, if_exists: bool = False) -> None:
        name = canonical(name)
        tables = self.state()[1]
        if name not in tables:
            if if_exists:
                return
            raise UndefinedTable(f"no table {name}")
        self._swap({name: (tables[name], None)})

    def set_schema(self, name: str, fields: list[dict]) -> None:
        """A new schema; fields keep their ids, so that renames are told from drops and adds."""
        pointer = self.pointer(name)
        table = Table.from_json(self.store.read(pointer))
        table.schemas.append({"fields": fields})
        table.schema_id = len(table.schemas) - 1
        table.last_field_id = max([table.last_field_id, *(f["id"] for f in fields)])
        self.swap([(name, pointer, table)])

    def set_properties(self, name: str, **properties: str) -> None:
        pointer = self.pointer(name)
        table = Table.from_json(self.store.read(pointer))
        table.properties |= properties
        self.swap([(name, pointer, table)])

    # --- reading

    def files(self, table: Table, snapshot: Snapshot | None) -> list[DataFile]:
        """The live files of a snapshot."""
        if snapshot is None:
            return []
        return [f for f in manifest_from(self.store.read(snapshot.manifest)) if f.status != "DELETED"]

    def read_files(self, table: Table, files: list[DataFile], schema_id: int | None = None, file_path: bool = False) -> DataFrame:
        """The rows of files, in the columns of a schema; fields are matched by id, so that renames are seen through."""
        schema = table.struct(schema_id)
        wanted = table.schemas[table.schema_id if schema_id is None else schema_id]["fields"]
        out = None
        for own, group in itertools.groupby(sorted(files, key=lambda f: f.schema_id), key=lambda f: f.schema_id):
            names = {f["id"]: f["name"] for f in table.schemas[own]["fields"]}
            df = self.spark.read.schema(table.struct(own)).parquet(*(f.path for f in group))
            columns = [(F.col(f"`{names[w['id']]}`") if w["id"] in names else F.lit(None)).cast(field.dataType).alias(w["name"]) for w, field in zip(wanted, schema.fields)]
            if file_path:
                columns.append(F.col("_metadata.file_path").alias("_file"))
            part = df.select(*columns)
            out = part if out is None else out.unionByName(part)
        if out is None:
            empty = T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields] + ([T.StructField("_file", T.StringType())] if file_path else []))
            return self.spark.createDataFrame([], empty)
        return out

    def resolve(self, table: Table, snapshot_id: int | None = None, as_of_ms: int | None = None, branch: str | None = None) -> Snapshot | None:
        if snapshot_id is not None:
            return table.snapshot(snapshot_id)
        if as_of_ms is not None:
            return table.at(as_of_ms)
        return table.head(branch or MAIN)

    def table(self, name: str, snapshot_id: int | None = None, as_of_ms: int | None = None, branch: str | None = None, where: dict[str, tuple] | None = None) -> DataFrame:
        """The rows of a table now, in a snapshot, at a time, or of a branch.

        ``where``: (least, most) by column, None for open; files whose bounds lie
        outside are not opened, and the rows are filtered as well.
        """
        table = self.load(name)
        snapshot = self.resolve(table, snapshot_id, as_of_ms, branch)
        files = self.files(table, snapshot)
        old = None if snapshot is None or (snapshot_id is None and as_of_ms is None) else snapshot.schema_id
        for column, (least, most) in (where or {}).items():
            if column not in table.struct(old).names:
                raise UndefinedColumn(f"{name} has no column {column}")
            files = [f for f in files if (b := f.bounds.get(column)) is None or ((least is None or b[1] >= least) and (most is None or b[0] <= most))]
        df = self.read_files(table, files, old)
        for column, (least, most) in (where or {}).items():
            if least is not None:
                df = df.where(F.col(column) >= F.lit(least))
            if most is not None:
                df = df.where(F.col(column) <= F.lit(most))
        return df

    def snapshots(self, name: str) -> DataFrame:
        """The metadata table of snapshots."""
        rows = [(s.id, s.parent, s.ts_ms * 1000, s.operation, s.summary, s.schema_id) for s in self.load(name).snapshots]
        made = self.spark.createDataFrame(rows, "snapshot_id bigint, parent_id bigint, us bigint, operation string, summary map<string,string>, schema_id int")
        return made.withColumn("committed_at", F.timestamp_micros("us").cast("timestamp_ntz")).select("snapshot_id", "parent_id", "committed_at", "operation", "summary", "schema_id")

    def manifests(self, name: str, snapshot_id: int | None = None) -> DataFrame:
        """The metadata table of a snapshot's files, deleted ones too."""
        table = self.load(name)
        snapshot = self.resolve(table, snapshot_id)
        files = manifest_from(self.store.read(snapshot.manifest)) if snapshot else []
        return self.spark.createDataFrame([(f.path, f.rows, f.bytes, f.status, f.schema_id) for f in files], MANIFESTS)

    def tables_df(self) -> DataFrame:
        """As information_schema.tables."""
        rows = [("tidemark", *n.split("."), "BASE TABLE") for n in self.names()]
        return self.spark.createDataFrame(rows, "table_catalog string, table_schema string, table_name string, table_type string")

    def columns_df(self) -> DataFrame:
        """As information_schema.columns."""
        rows = [("tidemark", *n.split("."), f.name, i, f.dataType.simpleString(), "YES" if f.nullable else "NO") for n in self.names() for i, f in enumerate(self.load(n).struct().fields, 1)]
        return self.spark.createDataFrame(rows, "table_catalog string, table_schema string, table_name string, column_name string, ordinal_position int, data_type string, is_nullable string")

    def row_count(self, name: str) -> int | None:
        """Rows by the file list: an estimate for planning, never the answer of a count."""
        table = self.load(name)
        return sum(f.rows for f in self.files(table, table.head()))

    # --- writing

    def write_files(self, table: Table, df: DataFrame, bounds: Iterable[str] = ()) -> list[DataFile]:
        """``df`` as new data files; rows, sizes and bounds of the given columns come from reading what was written."""
        folder = f"{table.location}/data/{uuid.uuid4().hex}"
        codec = table.properties.get("write.parquet.compression-codec", "zstd")
        writer = df.write.option("compression", codec)
        if most := table.properties.get("write.max-records-per-file"):
            writer = writer.option("maxRecordsPerFile", int(most))
        writer.parquet(folder)
        sizes = {self._plain(p): (p, s) for p, s, _ in self.store.list(folder) if p.endswith(".parquet")}
        columns = [c for c in bounds if not isinstance(table.struct()[c].dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.TimestampType, T.TimestampNTZType, T.DateType, T.DecimalType))]
        aggregates = [F.count("*").alias("n")] + [f(f"`{c}`").alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("lo", F.min), ("hi", F.max))]
        got = self.spark.read.schema(df.schema).parquet(folder).groupBy(F.col("_metadata.file_path").alias("p")).agg(*aggregates).collect()
        out = []
        for r in got:
            path, size = sizes[self._plain(r.p)]
            own = {c: [r[f"lo{i}"], r[f"hi{i}"]] for i, c in enumerate(columns) if r[f"lo{i}"] is not None}
            out.append(DataFile(path, r.n, size, table.schema_id, "ADDED", own))
        return sorted(out, key=lambda f: f.path)

    @staticmethod
    def _plain(path: str) -> str:
        from urllib.parse import unquote, urlparse

        return unquote(urlparse(path).path) if "://" in path or path.startswith("file:") else path

    def add_snapshot(self, table: Table, kept: list[DataFile], added: list[DataFile], removed: list[DataFile], operation: str, branch: str = MAIN, summary: dict[str, str] | None = None) -> tuple[Table, Snapshot]:
        """A copy of the metadata with a new snapshot at the branch's head."""
        new = table.copy()
        parent = new.refs.get(branch)
        for f in kept:
            f.status = "EXISTING"
        for f in removed:
            f.status = "DELETED"
        manifest = f"{table.location}/metadata/files-{uuid.uuid4().hex}.json"
        self.store.create(manifest, manifest_json(kept + added + removed))
        counts = {"added-records": str(sum(f.rows for f in added)), "deleted-records": str(sum(f.rows for f in removed)), "added-data-files": str(len(added)), "deleted-data-files": str(len(removed)), "total-records": str(sum(f.rows for f in kept + added))}
        now = max(self.clock(), new.log[-1][0] if new.log else 0)
        s = Snapshot(self.ids(), parent, now, operation, counts | (summary or {}), table.schema_id, manifest)
        new.snapshots.append(s)
        new.refs[branch] = s.id
        if branch == MAIN:
            new.log.append([s.ts_ms, s.id])
        return new, s

    def append(self, name: str, df: DataFrame, branch: str = MAIN, properties: dict[str, str] | None = None) -> Snapshot | None:
        """One snapshot with the rows of ``df``; properties change in the same commit."""
        from tidemark.operators.dml import Append, execute

        return execute(self, name, [Append(df)], branch, properties).snapshot

    def insert(self, name: str, df: DataFrame, branch: str = MAIN):
        from tidemark.operators.dml import Append, execute

        return execute(self, name, [Append(df)], branch)

    def delete(self, name: str, predicate: Column | str | None = None, branch: str = MAIN):
        from tidemark.operators.dml import Delete, execute

        return execute(self, name, [Delete(predicate)], branch)

    def update(self, name: str, assignments: dict[str, Column | str], predicate: Column | str | None = None, branch: str = MAIN):
        from tidemark.operators.dml import Update, execute

        return execute(self, name, [Update(assignments, predicate)], branch)
