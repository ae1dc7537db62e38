"""Copy-on-write changes: INSERT, DELETE and UPDATE as one new snapshot.

Operations fold in their order: each applies to the rows of earlier appends too.
Only files with matching rows are rewritten, by all executors at once; the rest
are carried over. A predicate that is null matches nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.errors import EngineError, NotNullViolation, NotSupported, SerializationFailure, UndefinedColumn, UniqueViolation
from tidemark.sources.catalog import ATTEMPTS, Catalog, align
from tidemark.sources.meta import MAIN, DataFile, Snapshot, Table


def _column(c: Column | str) -> Column:
    return F.expr(c) if isinstance(c, str) else c


@dataclass
class Append:
    rows: DataFrame


@dataclass
class Delete:
    predicate: Column | str | None = None


@dataclass
class Update:
    assignments: dict[str, Column | str]
    predicate: Column | str | None = None


Op = Append | Delete | Update


@dataclass
class DmlOutcome:
    """Rows that the last operation met, attempts that the commit took, and the snapshot (None: nothing to commit)."""

    rows: int
    attempts: int
    snapshot: Snapshot | None
    tag: str = ""
    by_op: list[int] = field(default_factory=list)


def matches(op: Op) -> Column:
    """True where a row is met; null counts as false."""
    return F.lit(True) if op.predicate is None else F.coalesce(_column(op.predicate).cast("boolean"), F.lit(False))


def check_assignments(op: Update, names: list[str]) -> dict[str, Column | str]:
    """The assignments by the table's own column names."""
    known = {n.lower(): n for n in names}
    out: dict[str, Column | str] = {}
    for c, value in op.assignments.items():
        if c.lower() not in known:
            raise UndefinedColumn(f"no column {c}")
        if known[c.lower()] in out:
            raise NotSupported(f"column {c} is assigned twice")
        out[known[c.lower()]] = value
    return out


def apply(op: Op, df: DataFrame) -> DataFrame:
    """The rows of ``df`` after a delete or update."""
    if isinstance(op, Delete):
        return df.where(~matches(op))
    own = check_assignments(op, df.columns)
    met = matches(op)
    return df.select(*(F.when(met, _column(own[c]).cast(df.schema[c].dataType)).otherwise(F.col(f"`{c}`")).alias(c) if c in own else F.col(f"`{c}`") for c in df.columns))


def fold(base: DataFrame, ops: list[Op], schema) -> DataFrame:
    """``base`` after all operations in order: the lazy view that a transaction reads."""
    layers = [base]
    for op in ops:
        layers = [*layers, align(op.rows, schema)] if isinstance(op, Append) else [apply(op, x) for x in layers]
    out = layers[0]
    for x in layers[1:]:
        out = out.unionByName(x)
    return out


def check_primary_key(rows: DataFrame, key: list[str], name: str) -> None:
    """Nulls first, then duplicates, of the final row set."""
    if not key:
        return
    columns = [F.col(f"`{c}`") for c in key]
    null = columns[0].isNull()
    for c in columns[1:]:
        null = null | c.isNull()
    keys = rows.select(*columns)
    if keys.where(null).limit(1).count():
        raise NotNullViolation(f"null in the primary key of {name}")
    if keys.groupBy(*columns).count().where("count > 1").limit(1).count():
        raise UniqueViolation(f"duplicate primary key in {name}")


def check_nulls(rows: DataFrame, schema, name: str) -> None:
    required = [f.name for f in schema.fields if not f.nullable]
    if not required:
        return
    bad = F.lit(False)
    for c in required:
        bad = bad | F.col(f"`{c}`").isNull()
    if rows.where(bad).limit(1).count():
        raise NotNullViolation(f"null in a required column of {name}")


def touched(catalog: Catalog, table: Table, files: list[DataFile], ops: list[Op]) -> tuple[list[DataFile], list[int]]:
    """The files in which any operation meets a row, and how many rows each operation meets in them (in their state of now)."""
    changing = [op for op in ops if not isinstance(op, Append)]
    if not files or not changing:
        return [], [0] * len(changing)
    rows = catalog.read_files(table, files, file_path=True)
    met = [matches(op) for op in changing]
    some = met[0]
    for m in met[1:]:
        some = some | m
    got = rows.where(some).groupBy("_file").agg(*(F.count_if(m).alias(f"m{i}") for i, m in enumerate(met))).collect()
    hit = {catalog._plain(r["_file"]) for r in got}
    return [f for f in files if catalog._plain(f.path) in hit], [sum(r[f"m{i}"] for r in got) for i in range(len(met))]


def prepare(catalog: Catalog, table: Table, snapshot: Snapshot | None, ops: list[Op], branch: str, operation: str | None = None, summary: dict[str, str] | None = None, properties: dict[str, str] | None = None) -> tuple[Table | None, Snapshot | None, list[int]]:
    """New metadata with the operations folded in on ``snapshot``; None if no row is met or added."""
    schema = table.struct()
    for op in ops:
        if isinstance(op, Update):
            check_assignments(op, schema.names)
    files = catalog.files(table, snapshot)
    rewrite, met = touched(catalog, table, files, ops)
    paths = {f.path for f in rewrite}
    kept = [f for f in files if f.path not in paths]
    layers: list[DataFrame] = [catalog.read_files(table, rewrite)] if rewrite else []
    counts: list[int] = []
    for op in ops:
        if isinstance(op, Append):
            layers.append(align(op.rows, schema))
            counts.append(-1)
        else:
            # a first change meets what was counted with the files
            counts.append(met[0] if not counts else sum(x.where(matches(op)).count() for x in layers))
            layers = [apply(op, x) for x in layers]
    new = None
    for x in layers:
        new = x if new is None else new.unionByName(x)
    key = table.primary_key
    assigned = {c.lower() for op in ops if isinstance(op, Update) for c in op.assignments}
    added: list[DataFile] = []
    if new is not None:
        if any(isinstance(op, Append) for op in ops) or any(not f.nullable and f.name.lower() in assigned for f in schema.fields):
            check_nulls(new, schema, table.name)
        if key and (any(isinstance(op, Append) for op in ops) or assigned & {k.lower() for k in key}):
            others = catalog.read_files(table, kept).select(*key)
            check_primary_key(others.unionByName(new.select(*key)), key, table.name)
        added = [f for f in catalog.write_files(table, new, key) if f.rows]
    before, after = sum(f.rows for f in rewrite), sum(f.rows for f in added)
    if not any(isinstance(op, Append) for op in ops):
        gone = sum(c for c, op in zip(counts, ops) if isinstance(op, Delete))
        if after != before - gone:
            raise EngineError(f"{before} rows less {gone} are not {after}: refusing to commit")
    elif len(ops) == 1:
        counts = [after]
    if not added and not rewrite and not properties:
        return None, None, counts
    if operation is None:
        operation = "append" if not rewrite else "overwrite" if added else "delete"
    out, made = catalog.add_snapshot(table, kept, added, rewrite, operation, branch, summary)
    out.properties |= properties or {}
    return out, made, counts


def execute(catalog: Catalog, name: str, ops: list[Op], branch: str = MAIN, properties: dict[str, str] | None = None) -> DmlOutcome:
    """An autocommit statement: recomputed on fresh metadata if another commit was first."""
    for attempt in range(1, ATTEMPTS + 1):
        pointer = catalog.pointer(name)
        table = Table.from_json(catalog.store.read(pointer))
        new, snapshot, counts = prepare(catalog, table, table.head(branch), ops, branch, properties=properties)
        rows = counts[-1] if counts else 0
        kind = {Append: "INSERT 0", Delete: "DELETE", Update: "UPDATE"}[type(ops[-1])]
        if new is None:
            return DmlOutcome(max(rows, 0), attempt, None, f"{kind} {max(rows, 0)}", counts)
        try:
            catalog.swap([(name, pointer, new)])
        except SerializationFailure:
            if attempt == ATTEMPTS:
                raise
            continue
        return DmlOutcome(rows, attempt, snapshot, f"{kind} {rows}", counts)
    raise AssertionError


class Transaction:
    """Snapshot isolation over any number of tables; the first committer wins.

    A table is pinned when it is first read or written. Reads see the pinned
    rows with the transaction's own operations folded in.
    """

    def __init__(self, catalog: Catalog) -> None:
        self.catalog = catalog
        self.pins: dict[str, tuple[str, Table]] = {}
        self.ops: dict[str, list[Op]] = {}
        self.state = "open"

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, *_) -> None:
        if self.state in ("open", "failed"):
            self.rollback() if kind or self.state == "failed" else self.commit()

    def _pin(self, name: str) -> tuple[str, Table]:
        from tidemark.errors import FailedTransaction
        from tidemark.sources.catalog import canonical

        if self.state != "open":
            raise FailedTransaction(f"the transaction is {self.state}")
        name = canonical(name)
        if name not in self.pins:
            pointer = self.catalog.pointer(name)
            self.pins[name] = pointer, Table.from_json(self.catalog.store.read(pointer))
        return name, self.pins[name][1]

    def _guard(self, work):
        try:
            return work()
        except Exception:
            if self.state == "open":
                self.state = "failed"
            raise

    def table(self, name: str) -> DataFrame:
        def work():
            own, table = self._pin(name)
            base = self.catalog.read_files(table, self.catalog.files(table, table.head()))
            return fold(base, self.ops.get(own, []), table.struct())

        return self._guard(work)

    def _run(self, name: str, op: Op) -> int:
        def work():
            own, table = self._pin(name)
            if isinstance(op, Update):
                check_assignments(op, table.struct().names)
            before = self.table(own)
            key = table.primary_key
            after = fold(before, [op], table.struct())
            if key and (isinstance(op, Append) or isinstance(op, Update) and {c.lower() for c in op.assignments} & {k.lower() for k in key}):
                check_primary_key(after, key, own)
            rows = align(op.rows, table.struct()).count() if isinstance(op, Append) else before.where(matches(op)).count()
            self.ops.setdefault(own, []).append(op)
            return rows

        return self._guard(work)

    def insert(self, name: str, rows: DataFrame) -> int:
        return self._run(name, Append(rows))

    def delete(self, name: str, predicate: Column | str | None = None) -> int:
        return self._run(name, Delete(predicate))

    def update(self, name: str, assignments: dict[str, Column | str], predicate: Column | str | None = None) -> int:
        return self._run(name, Update(assignments, predicate))

    def refuse(self, what: str) -> None:
        def work():
            raise NotSupported(f"{what} inside a transaction")

        self._guard(work)

    def commit(self) -> str:
        """COMMIT, or ROLLBACK where an error came before. All tables change at once, or none (40001)."""
        if self.state == "failed":
            self.rollback()
            return "ROLLBACK"
        if self.state != "open":
            from tidemark.errors import FailedTransaction

            raise FailedTransaction(f"the transaction is {self.state}")
        changes = []
        try:
            for name, ops in self.ops.items():
                pointer, table = self.pins[name]
                new, _, _ = prepare(self.catalog, table, table.head(), ops, MAIN)
                if new is not None:
                    changes.append((name, pointer, new))
            if changes:
                self.catalog.swap(changes)
        except Exception:
            self.state = "rolled back"
            raise
        self.state = "committed"
        return "COMMIT"

    def rollback(self) -> str:
        self.ops.clear()
        self.state = "rolled back"
        return "ROLLBACK"
