"""SQL over the catalog: one statement in, a DataFrame or a command tag out.

A statement's tables are found in its text, pinned to snapshots by metadata, and
given to Spark as temporary views under names of the engine's own; the rest is
Spark's parser, Catalyst and its adaptive execution. INSERT, UPDATE and DELETE
are taken apart here and run copy-on-write.
"""

from __future__ import annotations

import re
from collections import OrderedDict
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import EngineError, NotSupported, UndefinedColumn, UndefinedTable
from tidemark.operators import ranking
from tidemark.operators.dml import Append, Delete, Transaction, Update, execute
from tidemark.operators.overlay import DELETE, OP, UPSERT, key_filter, keyed_candidate, update_by_key
from tidemark.plans import asof, dialect
from tidemark.plans.asof import Token, tokens
from tidemark.plans.cache import PINNED, Freshness, PlanCache, ResultCache, deterministic
from tidemark.plans.guard import Authorizer, needs, read_only
from tidemark.sources.catalog import Catalog, align, canonical
from tidemark.sources.meta import Table
from tidemark.sources.system import Metrics, pg_catalog
from tidemark.sources.workspace import scratch
from tidemark.streaming.tail import TailLog

METADATA = ("$snapshots", "$manifests")
#: A table's property: changes by whole key may go to its tail.
KEYED_WRITES = "tail.keyed"


def session(builder: SparkSession.Builder | None = None) -> SparkSession:
    """A session with the semantics that statements here expect."""
    b = builder or SparkSession.builder
    conf = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.ansi.doubleQuotedIdentifiers": "true", "spark.sql.timestampType": "TIMESTAMP_NTZ", "spark.sql.adaptive.enabled": "true"}
    return b.config(map=conf).getOrCreate()


@dataclass
class Result:
    """Rows of a query (None for commands) and the command tag."""

    df: DataFrame | None
    tag: str
    rows: int | None = None


@dataclass
class _Parts:
    """A statement's clauses at the top level, as spans of its text."""

    sql: str
    toks: list[Token]

    def find(self, *words: str, start: int = 0) -> int:
        depth = 0
        for i in range(start, len(self.toks)):
            t = self.toks[i]
            depth += (t.text == "(") - (t.text == ")")
            if not depth and t.word in words:
                return i
        return -1

    def text(self, i: int, j: int) -> str:
        return self.sql[self.toks[i].start : self.toks[j - 1].end] if j > i else ""

    def split(self, i: int, j: int) -> list[tuple[int, int]]:
        """Parts between commas at the top level."""
        out, depth, at = [], 0, i
        for k in range(i, j):
            depth += (self.toks[k].text in "([") - (self.toks[k].text in ")]")
            if not depth and self.toks[k].text == ",":
                out.append((at, k))
                at = k + 1
        return [*out, (at, j)]


def _no_subquery(toks: list[Token]) -> None:
    if any(t.word == "select" for t in toks):
        raise NotSupported("a subquery in UPDATE or DELETE")


def literal(text: str) -> bool:
    """Whether an expression is one literal: a number, a string, a date, true, false or null."""
    toks = tokens(text)
    if toks and toks[0].text == "-":
        toks = toks[1:]
    if len(toks) == 2 and toks[0].word in ("date", "timestamp"):
        toks = toks[1:]
    return len(toks) == 1 and (toks[0].kind in ("number", "string") or toks[0].word in ("true", "false", "null"))


def equalities(predicate: str, table: str) -> dict[str, str] | None:
    """Column to literal of a chain of ``column = literal``; None for any other predicate, and for a column named twice."""
    p = _Parts(predicate, tokens(predicate))
    out: dict[str, str] = {}
    at = 0
    while at < len(p.toks):
        end = p.find("and", start=at)
        end = len(p.toks) if end < 0 else end
        toks = p.toks[at:end]
        if len(toks) > 2 and toks[1].text == "." and toks[0].name == table.split(".")[-1]:
            at += 2
            toks = toks[2:]
        if len(toks) < 3 or toks[1].text != "=" or toks[0].kind not in ("word", "quoted") or not literal(p.text(at + 2, end)) or toks[0].name in out:
            return None
        out[toks[0].name] = p.text(at + 2, end)
        at = end + 1
    return out or None


@dataclass
class Statement:
    kind: str
    table: str = ""
    columns: list[str] = field(default_factory=list)
    assignments: list[tuple[str, str]] = field(default_factory=list)
    predicate: str | None = None
    source: str = ""
    if_exists: bool = False


def _name(toks: list[Token], i: int) -> tuple[str, int]:
    if i >= len(toks) or toks[i].kind not in ("word", "quoted"):
        raise EngineError("a table name is missing")
    parts, i = [toks[i].name], i + 1
    while i + 1 < len(toks) and toks[i].text == ".":
        parts.append(toks[i + 1].name)
        i += 2
    return ".".join(parts), i


def parse(sql: str) -> Statement:
    """The statement's kind, and its parts where this engine runs it."""
    toks = tokens(sql)
    while toks and toks[-1].text == ";":
        toks.pop()
    if not toks:
        raise EngineError("an empty statement")
    p, first = _Parts(sql, toks), toks[0].word
    if first == "insert":
        if toks[1].word != "into":
            raise NotSupported("INSERT other than INSERT INTO")
        name, i = _name(toks, 2)
        columns: list[str] = []
        if i < len(toks) and toks[i].text == "(" and toks[i + 1].word != "select":
            end = next(k for k in range(i, len(toks)) if toks[k].text == ")")
            columns, i = [t.name for t in toks[i + 1 : end] if t.text != ","], end + 1
        if p.find("returning", start=i) >= 0 or p.find("conflict", start=i) >= 0:
            raise NotSupported("RETURNING or ON CONFLICT")
        return Statement("insert", name, columns, source=p.text(i, len(toks)))
    if first == "delete":
        if len(toks) < 3 or toks[1].word != "from":
            raise NotSupported("DELETE of several tables")
        name, i = _name(toks, 2)
        if any(p.find(w, start=i) >= 0 for w in ("using", "returning", "order", "limit", "join")):
            raise NotSupported("DELETE with USING, RETURNING, ORDER BY, LIMIT or a join")
        if i < len(toks) and toks[i].word != "where":
            raise NotSupported("DELETE with an alias or several tables")
        _no_subquery(toks)
        return Statement("delete", name, predicate=p.text(i + 1, len(toks)) if i < len(toks) else None)
    if first == "update":
        if len(toks) > 1 and toks[1].word == "or":
            raise NotSupported("UPDATE OR")
        name, i = _name(toks, 1)
        if i >= len(toks) or toks[i].word != "set":
            raise NotSupported("UPDATE with an alias or a join")
        where = p.find("where", start=i)
        end = where if where >= 0 else len(toks)
        if any(p.find(w, start=i) >= 0 for w in ("from", "returning", "order", "limit")):
            raise NotSupported("UPDATE with FROM, RETURNING, ORDER BY or LIMIT")
        _no_subquery(toks)
        assignments = []
        for a, b in p.split(i + 1, end):
            if toks[a].text == "(":
                raise NotSupported("UPDATE of a tuple")
            if b - a < 3 or toks[a + 1].text != "=":
                raise NotSupported("UPDATE of other than a plain column")
            assignments.append((toks[a].name, p.text(a + 2, b)))
        return Statement("update", name, assignments=assignments, predicate=p.text(where + 1, len(toks)) if where >= 0 else None)
    if first in ("create", "drop") and len(toks) > 2 and toks[1].word == "table":
        i, flag = 2, False
        if toks[2].word == "if":
            i, flag = (5, True) if first == "create" else (4, True)
        name, i = _name(toks, i)
        return Statement(first, name, source=p.text(i, len(toks)), if_exists=flag)
    if first in ("begin", "commit", "rollback", "start", "end", "abort"):
        return Statement({"start": "begin", "end": "commit", "abort": "rollback"}.get(first, first))
    if first in ("set", "show"):
        return Statement(first, source=sql)
    if first in ("merge", "truncate", "alter", "grant", "revoke", "copy"):
        return Statement(first)
    return Statement("explain" if first == "explain" else "select", source=sql)


class Engine:
    """Statements of one user, with their transaction and settings.

    Reads merge the changes that a table's tail holds beyond its watermark.
    Statements that must follow those changes flush them first: UPDATE and
    DELETE, BEGIN, DDL, and inserts with a primary key to enforce. ``buffered``:
    other inserts go to the tail, and so do changes by whole key of tables with
    the property ``tail.keyed``. ``result_rows``: results of together so many rows
    are kept while their tables are unchanged.
    """

    def __init__(self, catalog: Catalog, user: str = "owner", authorizer: Authorizer | None = None, staleness_s: float = 0.0, read_only: bool = False, buffered: bool = False, result_rows: int = 0) -> None:
        self.catalog, self.spark = catalog, catalog.spark
        self.user, self.authorizer, self.reads_only, self.buffered = user, authorizer, read_only, buffered
        self.fresh, self.plans = Freshness(catalog, staleness_s), PlanCache()
        self.results = ResultCache(result_rows) if result_rows else None
        self.transaction: Transaction | None = None
        self.pinned: OrderedDict[str, None] = OrderedDict()
        self.settings: dict[str, str] = {}
        self.system: dict[str, DataFrame] | None = None
        self.metrics = Metrics()
        self.templates: dict[str, tuple[str, dict[str, type]]] = {}

    # --- names

    def _current(self, name: str) -> tuple[DataFrame, str | None]:
        """The table's rows with its tail, and the pointer that they are of: None where buffered changes are among them.

        The metadata are read first, the tail second: its changes beyond the
        watermark of those same metadata are neither missed nor doubled.
        """
        pointer = self.fresh.pointer(name)
        table = Table.from_json(self.catalog.store.read(pointer))
        log = TailLog(self.catalog, name, table)
        if log.pending(table):
            return log.merged(table), None
        return self.catalog.read_files(table, self.catalog.files(table, table.head())), pointer

    def _fence(self, *names: str) -> None:
        """Flushes the tails of tables: what is acknowledged comes before the statement that follows."""
        for name in names:
            if TailLog(self.catalog, name).flush() is not None:
                self.fresh.invalidate(name)

    def _view(self, use: asof.TableUse, known: set[str], pointers: dict[str, str | None]) -> str | None:
        """A temporary view of what is meant, or None for names that aren't the catalog's; tables as of now go to ``pointers``."""
        last = use.parts[-1]
        meta = next((m for m in METADATA if last.endswith(m)), "")
        base = ".".join([*use.parts[:-1], last.removesuffix(meta)])
        if use.parts[0] == "information_schema" and len(use.parts) == 2:
            df = {"tables": self.catalog.tables_df, "columns": self.catalog.columns_df}.get(last)
            if df is None:
                raise UndefinedTable(f"no table {'.'.join(use.parts)}")
            return self._register(f"__info_{last}", df())
        if use.parts[0] == "pg_catalog" and len(use.parts) == 2 or last in ("pg_class", "pg_namespace", "pg_attribute", "pg_type"):
            # one listing for all of a statement's system tables
            if self.system is None:
                self.system = pg_catalog(self.catalog)
            if last not in self.system:
                raise UndefinedTable(f"no table {'.'.join(use.parts)}")
            return self._register(f"__{last}", self.system[last])
        try:
            name = canonical(base)
        except UndefinedTable:
            return None
        if name not in known:
            return None
        plain = name.replace(".", "__")
        if meta:
            return self._register(f"__{plain}_{meta[1:]}", self.catalog.snapshots(name) if meta == "$snapshots" else self.catalog.manifests(name))
        if self.transaction and use.snapshot_id is None and use.as_of_ms is None:
            return self._register(f"__txn_{plain}", self.transaction.table(name))
        if use.as_of_ms is not None:
            use.snapshot_id = self.catalog.load(name).at(use.as_of_ms).id
        if use.snapshot_id is not None:
            view = f"__{plain}_at_{use.snapshot_id}"
            if view not in self.pinned:
                self._register(view, self.catalog.table(name, snapshot_id=use.snapshot_id))
            self.pinned[view] = None
            self.pinned.move_to_end(view)
            while len(self.pinned) > PINNED:
                self.spark.catalog.dropTempView(self.pinned.popitem(last=False)[0])
            return view
        df, pointers[name] = self._current(name)
        return self._register(f"__{plain}", df)

    def _register(self, view: str, df: DataFrame) -> str:
        view = re.sub(r"[^A-Za-z0-9_]", "_", view)
        df.createOrReplaceTempView(view)
        return view

    def _prepared(self, sql: str) -> tuple[str, dict[str, str], bool]:
        """The text over views, the pointers of its tables, and whether all are read as of now."""
        known = set(self.catalog.names())
        self.system = None
        uses, names, pointers, now = [], [], {}, True
        for use in asof.table_uses(sql):
            view = self._view(use, known, pointers)
            if view is None:
                if use.snapshot_id is not None or use.as_of_ms is not None:
                    raise UndefinedTable(f"no table {'.'.join(use.parts)}")
                continue
            uses.append(use)
            # the table's own name stays usable before its columns
            following = tokens(sql[use.end :])[:2]
            aliased = bool(following) and (following[0].word == "as" or following[0].kind == "quoted" or (following[0].kind == "word" and following[0].word not in asof.NO_ALIAS))
            names.append(f"`{view}`" + ("" if aliased else f" AS `{use.parts[-1]}`"))
            if use.snapshot_id is not None or use.as_of_ms is not None or any(m in use.parts[-1] for m in METADATA) or use.parts[0] == "information_schema" or use.parts[-1].startswith("pg_"):
                now = False
        now = now and None not in pointers.values()
        return asof.splice(sql, uses, names), pointers, now

    # --- statements

    def sql(self, text: str, *args) -> Result:
        """Runs one statement; ``$1`` and so on are ``args`` (queries and inserts only)."""
        statement = parse(text)
        if self.reads_only and not read_only(text):
            raise NotSupported("the session only reads")
        if self.authorizer:
            sources = [canonical(".".join(u.parts)) for u in asof.table_uses(statement.source if statement.kind == "insert" else text) if statement.kind in ("select", "explain", "insert") and canonical(".".join(u.parts)).split("$")[0].split("@")[0] in set(self.catalog.names())]
            self.authorizer.check(self.user, needs(statement.kind, canonical(statement.table) if statement.table else None, [s.split("$")[0] for s in sources]))
        t = self.transaction
        if t and t.state == "failed" and statement.kind not in ("commit", "rollback"):
            t._pin("x.y")
        run = getattr(self, f"_{statement.kind}", None)
        if run is None:
            raise NotSupported(statement.kind.upper())
        if args and statement.kind in ("update", "delete"):
            raise NotSupported("parameters of UPDATE and DELETE")
        return self.metrics.timed(statement.kind, lambda: run(statement, args))

    def query(self, text: str, *args) -> DataFrame:
        out = self.sql(text, *args).df
        if out is None:
            raise EngineError("not a query")
        return out

    def _spark_sql(self, sql: str, args: tuple) -> DataFrame:
        named = {f"p{i}": a for i, a in enumerate(args, 1)}

        def run(text: str) -> DataFrame:
            parts, at = [], 0
            for tok in tokens(text):
                if tok.kind == "param":
                    parts += [text[at : tok.start], f":p{tok.text[1:]}"]
                    at = tok.end
            text = "".join([*parts, text[at:]])
            return self.spark.sql(text, args={k: v for k, v in named.items() if f":{k}" in text} or None)

        def kinds(source: str, expressions: list[str]) -> list[str] | None:
            try:
                return [run(f"SELECT ({e}) AS e {source}").schema[0].dataType.simpleString() for e in expressions]
            except Exception:  # what the analyzer can't type alone keeps Spark's division
                return None

        text = dialect.rewritten(sql, kinds)
        plain = run(text)
        parts = dialect.numbering(text, lambda: plain.columns)
        return plain if parts is None else self._numbered(plain, run(parts.inner), parts)

    def _numbered(self, plain: DataFrame, inner: DataFrame, parts: dialect.Numbering) -> DataFrame:
        """The query with its row numbers given by all tasks; a window over all rows is one task's."""
        try:
            scratch(self.spark)
        except EngineError:
            return plain
        if any(re.search("void|interval", f.dataType.simpleString()) and not isinstance(f.dataType, T.NullType) for f in inner.schema):
            return plain
        df = inner.toDF(*(f"c{i}" for i in range(len(inner.columns))))
        # a column of nulls alone has no type that files keep
        df = df.select(*(F.col(f.name).cast("int") if isinstance(f.dataType, T.NullType) else F.col(f.name) for f in df.schema))

        def by(keys: list[tuple[int, str]]) -> list[Column]:
            return [getattr(F.col(f"c{i}"), ("desc" if "desc" in way else "asc") + ("_nulls_first" if "first" in way else "_nulls_last"))() for i, way in keys]

        for n, keys in parts.numbers:
            df = ranking.numbered(df.drop(f"c{n}"), by(keys), f"c{n}").withColumn(f"c{n}", F.col(f"c{n}").cast("int"))
        if parts.order:
            df = df.orderBy(*by(parts.order))
        df = df.select(*((F.lit(None) if isinstance(f.dataType, T.NullType) else F.col(f"c{i}").cast(f.dataType)).alias(f.name) for i, f in enumerate(plain.schema)))
        df = df.offset(parts.offset) if parts.offset else df
        return df if parts.limit is None else df.limit(parts.limit)

    def _select(self, s: Statement, args: tuple) -> Result:
        sql, pointers, now = self._prepared(s.source)
        key = (" ".join(t.text if t.kind in ("quoted", "string") else t.text.lower() for t in tokens(s.source)), args, self.spark.conf.get("spark.sql.session.timeZone"))
        cacheable = now and bool(pointers) and not self.transaction
        df = self.plans.get(key, pointers) if cacheable else None
        if df is None:
            df = self._spark_sql(sql, args)
            if cacheable and deterministic(df):
                self.plans.put(key, pointers, df)
                if self.results is not None:
                    self.plans.put(key, pointers, df := self.results.put((key, tuple(sorted(pointers.items()))), df))
        return Result(df, "SELECT")

    def _explain(self, s: Statement, args: tuple) -> Result:
        toks = [t for t in tokens(s.source)[1:]]
        while toks and toks[0].word in ("analyze", "verbose", "formatted", "extended", "cost"):
            toks = toks[1:]
        sql, _, _ = self._prepared(s.source[toks[0].start :])
        return Result(self.spark.sql("EXPLAIN FORMATTED " + sql), "EXPLAIN")

    def _insert(self, s: Statement, args: tuple) -> Result:
        table = self.catalog.load(s.table)
        schema = table.struct()
        sql, _, _ = self._prepared(s.source)
        rows = self._spark_sql(f"SELECT * FROM ({sql}) AS __rows" if tokens(s.source)[0].word == "values" else sql, args)
        names = [c.lower() for c in s.columns] or [f.name.lower() for f in schema.fields[: len(rows.columns)]]
        if len(names) != len(rows.columns):
            raise EngineError(f"{len(names)} columns and {len(rows.columns)} values")
        known = {f.name.lower() for f in schema.fields}
        if unknown := [n for n in names if n not in known]:
            raise UndefinedColumn(f"no column {unknown[0]}")
        given = rows.toDF(*(f"_{i}" for i in range(len(names))))
        full = given.select(*((F.col(f"_{names.index(f.name.lower())}") if f.name.lower() in names else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields))
        op = Append(align(full, schema))
        if self.buffered and not self.transaction and (not table.primary_key or table.properties.get(KEYED_WRITES) == "true"):
            log = TailLog(self.catalog, s.table, table)
            first, last = log.write(op.rows)
            if log.due():
                self._fence(s.table)
            return Result(None, f"INSERT 0 {last - first + 1}", last - first + 1)
        return self._dml(s.table, op, "INSERT 0", fence=bool(table.primary_key))

    def _keyed(self, s: Statement) -> Result | None:
        """A change of the one row of a key as an upsert or delete of the tail; None where the statement is no such change."""
        table = self.catalog.load(s.table)
        key = table.primary_key
        if not self.buffered or self.transaction or table.properties.get(KEYED_WRITES) != "true" or s.predicate is None:
            return None
        schema = table.struct()
        equal = equalities(s.predicate, s.table)
        if equal is None or not all(literal(e) for _, e in s.assignments):
            return None
        values = keyed_candidate(equal, [c for c, _ in s.assignments], key, {f.name: f.dataType.simpleString() for f in schema.fields})
        if values is None:
            return None
        rows = self._current(canonical(s.table))[0].where(key_filter([values])).limit(2)
        n = rows.count()
        if n > 1:
            return None
        tag = s.kind.upper()
        if n:
            log = TailLog(self.catalog, s.table, table)
            if s.kind == "delete":
                log.write(rows.select(*key), DELETE)
            else:
                change = rows.select(*key, *(F.expr(e).cast(schema[c].dataType).alias(c) for c, e in s.assignments))
                log.write(update_by_key(rows, change, key, [c for c, _ in s.assignments]).drop(OP), UPSERT)
        return Result(None, f"{tag} {n}", n)

    def _dml(self, name: str, op, tag: str, fence: bool = True) -> Result:
        if self.transaction:
            n = {Append: lambda: self.transaction.insert(name, op.rows), Delete: lambda: self.transaction.delete(name, op.predicate), Update: lambda: self.transaction.update(name, op.assignments, op.predicate)}[type(op)]()
            return Result(None, f"{tag} {n}", n)
        if fence:
            self._fence(name)
        try:
            out = execute(self.catalog, name, [op])
        finally:
            # also when the commit failed half-way: what is known of the table may be old
            self.fresh.invalidate(name)
        return Result(None, out.tag, out.rows)

    def _delete(self, s: Statement, args: tuple) -> Result:
        return self._keyed(s) or self._dml(s.table, Delete(s.predicate), "DELETE")

    def _update(self, s: Statement, args: tuple) -> Result:
        seen: dict[str, str] = {}
        for c, e in s.assignments:
            if c in seen:
                raise NotSupported(f"column {c} is assigned twice")
            seen[c] = e
        return self._keyed(s) or self._dml(s.table, Update(seen, s.predicate), "UPDATE")

    def _create(self, s: Statement, args: tuple) -> Result:
        if self.transaction:
            self.transaction.refuse("CREATE TABLE")
        if s.if_exists and canonical(s.table) in self.catalog.names():
            return Result(None, "CREATE TABLE")
        toks = tokens(s.source)
        if toks and toks[0].word == "as":
            df = self._select(Statement("select", source=s.source[toks[1].start :]), args).df
            self.catalog.create(s.table, T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields]))
            n = execute(self.catalog, s.table, [Append(df)]).rows
            return Result(None, f"SELECT {n}", n)
        body = s.source.strip()
        if not (body.startswith("(") and body.endswith(")")):
            raise NotSupported("CREATE TABLE without a column list")
        p = _Parts(body, tokens(body))
        fields, key = [], []
        kinds = {"text": "string", "varchar": "string", "bigint": "bigint", "int8": "bigint", "int4": "int", "integer": "int", "float8": "double", "float4": "float", "bool": "boolean", "timestamptz": "timestamp_ltz", "timestamp": "timestamp_ntz", "real": "float"}
        for a, b in p.split(1, len(p.toks) - 1):
            words = [t.word for t in p.toks[a:b]]
            if words[:2] == ["primary", "key"]:
                key = [t.name for t in p.toks[a + 3 : b - 1] if t.text != ","]
                continue
            end = next((a + i for i, w in enumerate(words) if w in ("not", "null", "primary")), b)
            kind = p.text(a + 1, end).lower()
            base = re.sub(r"\(.*\)", "", kind).strip()
            kind = kinds.get("double" if base == "double precision" else base, "double" if base == "double precision" else kind)
            fields.append(T.StructField(p.toks[a].name, T.DataType.fromDDL(kind), "not" not in words))
            if "primary" in words:
                key = [p.toks[a].name]
        self.catalog.create(s.table, T.StructType(fields), key)
        return Result(None, "CREATE TABLE")

    def _drop(self, s: Statement, args: tuple) -> Result:
        if self.transaction:
            self.transaction.refuse("DROP TABLE")
        if canonical(s.table) in self.catalog.names():
            self._fence(s.table)
        self.catalog.drop(s.table, s.if_exists)
        self.fresh.invalidate(s.table)
        return Result(None, "DROP TABLE")

    def _begin(self, s: Statement, args: tuple) -> Result:
        if self.transaction is None:
            self._fence(*self.catalog.names())
            self.transaction = Transaction(self.catalog)
        return Result(None, "BEGIN")

    def _end(self, commit: bool) -> Result:
        t, self.transaction = self.transaction, None
        if t is None:
            return Result(None, "COMMIT" if commit else "ROLLBACK")
        try:
            return Result(None, t.commit() if commit else t.rollback())
        finally:
            for name in t.pins:
                self.fresh.invalidate(name)

    def _commit(self, s: Statement, args: tuple) -> Result:
        return self._end(True)

    def _rollback(self, s: Statement, args: tuple) -> Result:
        return self._end(False)

    def _set(self, s: Statement, args: tuple) -> Result:
        m = re.fullmatch(r"(?is)\s*set\s+([\w.]+)\s*(?:=|\bto\b)\s*(.+?)\s*;?\s*", s.source)
        if not m:
            raise NotSupported("SET of that form")
        value = m[2].strip("'\"")
        if m[1].lower() in ("timezone", "time.zone"):
            self.spark.conf.set("spark.sql.session.timeZone", value)
        self.settings[m[1].lower()] = value
        return Result(None, "SET")

    def _show(self, s: Statement, args: tuple) -> Result:
        name = s.source.split(None, 1)[1].strip(" ;").lower()
        value = self.settings.get(name, self.spark.conf.get("spark.sql.session.timeZone") if name == "timezone" else "")
        return Result(self.spark.createDataFrame([(value,)], f"`{name}` string"), "SHOW")

    # --- named queries

    def define(self, name: str, text: str, **params: type) -> None:
        """A query by name; its ``$name`` parameters have types, and no free text is spliced in."""
        if not read_only(text):
            raise NotSupported("a named query must only read")
        self.templates[name] = (text, params)

    def named(self, name: str, **values) -> DataFrame:
        if name not in self.templates:
            raise UndefinedTable(f"no query {name}")
        text, params = self.templates[name]
        if set(values) != set(params):
            raise EngineError(f"parameters are {', '.join(params)}")
        for p, kind in params.items():
            if isinstance(kind, (set, frozenset, tuple, list)):
                if values[p] not in kind:
                    raise EngineError(f"{p} isn't one of its values")
            elif not isinstance(values[p], kind) or isinstance(values[p], bool) and kind is not bool:
                raise EngineError(f"{p} must be {kind.__name__}")
        sql, _, _ = self._prepared(text)
        return self.spark.sql(sql, args=values)


def prepared(engine: Engine, text: str):
    """A statement to run with other parameters each time."""
    parse(text)
    return lambda *args: engine.sql(text, *args)


COPY = re.compile(r"(?is)^\s*copy\s+(?:\((?P<query>.*)\)|(?P<table>[\w.\"]+)\s*(?:\((?P<columns>[^)]*)\))?)\s+to\s+stdout(?:\s+(?:with\s*)?\(?(?P<options>[^)]*)\)?)?\s*;?\s*$")


def copy_out(engine: Engine, text: str) -> DataFrame:
    """``COPY … TO STDOUT`` as one column of lines, encoded by the executors; text and csv, the latter with HEADER."""
    m = COPY.match(text)
    if not m:
        raise NotSupported("COPY other than TO STDOUT")
    options = [o for o in re.split(r"[\s,]+", (m["options"] or "").lower()) if o]
    kind = "csv" if "csv" in options else "text"
    if "binary" in options:
        raise NotSupported("binary COPY")
    if bad := [o for o in options if o not in ("format", "csv", "text", "header", "true")]:
        raise NotSupported(f"COPY option {bad[0]}")
    header = "header" in options
    if header and kind != "csv":
        raise NotSupported("HEADER is for csv")
    df = engine.query(m["query"] or f"SELECT {m['columns'] or '*'} FROM {m['table']}")
    cells = [F.when(F.col(f"`{f.name}`").cast("boolean"), "t").otherwise("f") if f.dataType == T.BooleanType() else F.col(f"`{f.name}`").cast("string") for f in df.schema.fields]
    if kind == "text":
        plain = list(cells)
        for sign, written in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
            plain = [F.replace(c, F.lit(sign), F.lit(written)) for c in plain]
        line = F.concat_ws("\t", *(F.when(F.col(f"`{n}`").isNull(), F.lit(r"\N")).otherwise(c) for n, c in zip(df.columns, plain)))
        return df.select(line.alias("line"))
    quoted = [F.when(F.regexp_like(c, F.lit("[\",\\n\\r]")) | (c == ""), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c) for c in cells]
    line = F.concat_ws(",", *(F.when(F.col(f"`{n}`").isNull(), F.lit("")).otherwise(c) for n, c in zip(df.columns, quoted)))
    lines = df.select(line.alias("line"))
    return engine.spark.createDataFrame([(",".join(df.columns),)], "line string").union(lines) if header else lines
