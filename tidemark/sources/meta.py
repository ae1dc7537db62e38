"""Table metadata: schemas with field ids, snapshots, refs and data files, as plain records."""

from __future__ import annotations

import copy
import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import types as T

from tidemark.errors import EngineError, UndefinedTable

MAIN = "main"


@dataclass
class DataFile:
    """A Parquet file of the table; ``status`` is relative to its snapshot: ADDED, EXISTING or DELETED."""

    path: str
    rows: int
    bytes: int
    schema_id: int = 0
    status: str = "ADDED"
    bounds: dict[str, list] = field(default_factory=dict)


@dataclass
class Snapshot:
    id: int
    parent: int | None
    ts_ms: int
    operation: str
    summary: dict[str, str]
    schema_id: int
    manifest: str


@dataclass
class Table:
    """One version of a table's metadata."""

    name: str
    location: str
    schemas: list[dict]
    schema_id: int = 0
    last_field_id: int = 0
    properties: dict[str, str] = field(default_factory=dict)
    snapshots: list[Snapshot] = field(default_factory=list)
    refs: dict[str, int] = field(default_factory=dict)
    #: What main pointed to, and since when; for reads by time.
    log: list[list[int]] = field(default_factory=list)

    def to_json(self) -> bytes:
        return json.dumps(asdict(self)).encode()

    @staticmethod
    def from_json(data: bytes) -> Table:
        raw = json.loads(data)
        raw["snapshots"] = [Snapshot(**s) for s in raw["snapshots"]]
        return Table(**raw)

    def copy(self) -> Table:
        return copy.deepcopy(self)

    def snapshot(self, snapshot_id: int) -> Snapshot:
        for s in self.snapshots:
            if s.id == snapshot_id:
                return s
        raise UndefinedTable(f"{self.name} has no snapshot {snapshot_id}")

    def head(self, ref: str = MAIN) -> Snapshot | None:
        if ref not in self.refs:
            if ref == MAIN:
                return None
            raise UndefinedTable(f"{self.name} has no branch {ref}")
        return self.snapshot(self.refs[ref])

    def at(self, ts_ms: int) -> Snapshot:
        """What main pointed to at that time."""
        found = [s for t, s in self.log if t <= ts_ms]
        if not found:
            raise EngineError(f"{self.name} has no snapshot at or before {ts_ms}")
        try:
            return self.snapshot(found[-1])
        except UndefinedTable:
            raise EngineError(f"the snapshot of {self.name} at {ts_ms} has expired") from None

    def struct(self, schema_id: int | None = None) -> T.StructType:
        fields = self.schemas[self.schema_id if schema_id is None else schema_id]["fields"]
        return T.StructType([T.StructField(f["name"], T._parse_datatype_json_value(f["type"]), f["nullable"]) for f in fields])

    @property
    def primary_key(self) -> list[str]:
        names = [c.strip() for c in self.properties.get("primary-key", "").split(",") if c.strip()]
        known = {f.name for f in self.struct().fields}
        if unknown := [c for c in names if c not in known]:
            raise EngineError(f"primary key of {self.name} names unknown columns: {', '.join(unknown)}")
        return names


def fields_of(schema: T.StructType, first_id: int = 1) -> list[dict]:
    return [{"id": first_id + i, "name": f.name, "type": f.dataType.jsonValue(), "nullable": f.nullable} for i, f in enumerate(schema.fields)]


def manifest_json(files: list[DataFile]) -> bytes:
    return json.dumps([asdict(f) for f in files]).encode()


def manifest_from(data: bytes) -> list[DataFile]:
    return [DataFile(**f) for f in json.loads(data)]


def lineage(table: Table, snapshot_id: int | None) -> list[int]:
    """The snapshot and its ancestors; stops at an expired parent or a cycle."""
    by_id, seen = {s.id: s for s in table.snapshots}, []
    while snapshot_id in by_id and snapshot_id not in seen:
        seen.append(snapshot_id)
        snapshot_id = by_id[snapshot_id].parent
    return seen
