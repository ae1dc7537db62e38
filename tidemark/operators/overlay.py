"""Union reads: committed rows merged with a change tail, each change exactly once.

A tail is a DataFrame with the table's columns and ``_seq`` (bigint), ``_op``
(append, upsert, delete). Keys are hidden by anti joins; a small key set is
broadcast by the planner where its size is known to be small, and shuffled
otherwise. Keys never hold nulls: a null key matches nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.errors import EngineError

SEQ, OP = "_seq", "_op"
APPEND, UPSERT, DELETE = "append", "upsert", "delete"
KEYED = (UPSERT, DELETE)


def union_read(committed: DataFrame, *overlays: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), overlays, committed)


def suppress(rows: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` without those whose key is among ``keys``."""
    return rows.join(keys.select(*key).distinct(), key, "left_anti").select(rows.columns)


def newest(tail: DataFrame, key: list[str]) -> DataFrame:
    """The newest row of each key by sequence; an aggregate, so that a hot key is combined before the shuffle."""
    rest = [c for c in tail.columns if c not in key]
    return tail.groupBy(*key).agg(F.max_by(F.struct(*rest), SEQ).alias("_x")).select(*key, *(F.col(f"_x.`{c}`").alias(c) for c in rest)).select(tail.columns)


def after(tail: DataFrame, watermark: int | None) -> DataFrame:
    """Changes beyond the watermark; without one, all."""
    return tail if watermark is None else tail.where(F.col(SEQ) > F.lit(watermark))


def merged_fresh(committed: DataFrame, tail: DataFrame, key: list[str], watermark: int | None = None, lossless: bool = True) -> DataFrame:
    """Committed rows with all changes beyond the watermark.

    Without a key all changes are appended. With one, committed rows of keys that
    have a keyed change (upsert or delete) are hidden, and of such keys the newest
    change counts. ``lossless``: keys with nothing but appends keep all of them,
    as a declared key isn't an enforced one; otherwise the newest change of every
    key counts.
    """
    fresh = after(tail, watermark)
    columns = committed.columns
    if not key:
        return committed.unionByName(fresh.select(columns))
    if not lossless:
        keyed = fresh.where(F.col(OP).isin(*KEYED)).select(*key).distinct()
        return suppress(committed, keyed, key).unionByName(newest(fresh, key).where(F.col(OP) != DELETE).select(columns))
    is_keyed = F.coalesce(F.col(OP).isin(*KEYED), F.lit(False))
    for c in key:
        # a null key matches nothing
        is_keyed = is_keyed & F.col(f"`{c}`").isNotNull()
    rest = [c for c in fresh.columns if c not in key]
    # one row for each changed key; its newest change counts where any of its changes is a keyed one
    last = fresh.groupBy(*key).agg(F.max_by(F.struct(*rest), SEQ).alias("_x"), F.bool_or(is_keyed).alias("_keyed")).where("_keyed")
    new = last.where(F.col(f"_x.{OP}") != DELETE).select(*key, *(F.col(f"_x.`{c}`").alias(c) for c in columns if c not in key)).select(columns)
    # committed rows and appends lose their keys in one join: an anti join would be planned again for each part of the union
    hidden = fresh.where(is_keyed).select(*key).distinct().withColumn("_hidden", F.lit(True))
    plain = committed.unionByName(fresh.where(~is_keyed).select(columns))
    return plain.join(hidden, key, "left").where(F.col("_hidden").isNull()).select(columns).unionByName(new)


def layered(committed: DataFrame, layers: list[DataFrame], key: list[str]) -> DataFrame:
    """Committed rows under change layers, oldest first.

    A layer's keyed changes hide its own earlier appends and everything older of
    that key; one ranking over all layers finds the newest keyed change of a key.
    """
    if not layers:
        return committed
    rows = reduce(lambda a, b: a.unionByName(b), (layer.select(*committed.columns, SEQ, OP).withColumn("_layer", F.lit(i)) for i, layer in enumerate(layers)))
    at = F.struct("_layer", SEQ)
    # the newest keyed change of each key, by an aggregate; appends after it stay beside it
    last = rows.where(F.col(OP).isin(*KEYED)).groupBy(*key).agg(F.max(at).alias("_last"))
    stays = F.col("_last").isNull() | (at >= F.col("_last"))
    changed = rows.join(last, key, "left").where(stays & (F.col(OP) != DELETE)).select(committed.columns)
    # committed rows are older than all layers: they only lose their keys
    return suppress(committed, last, key).unionByName(changed)


def route_appends(appends: DataFrame, live: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Appends whose key has a live keyed entry, as newer upserts, and the others."""
    keys = live.select(*key).distinct()
    return appends.join(keys, key, "left_semi").withColumn(OP, F.lit(UPSERT)).select(appends.columns), appends.join(keys, key, "left_anti").select(appends.columns)


def update_by_key(view: DataFrame, changes: DataFrame, key: list[str], assigned: list[str]) -> DataFrame:
    """Read-modify-write: the view's rows of the changes' keys with the assigned columns replaced, as upserts.

    Keys the view lacks change nothing. Of several changes of a key the newest
    counts: the greatest ``_seq``, where there is one; without it they are an error.
    """
    if SEQ in changes.columns:
        changes = newest(changes, key)
    else:
        many = F.raise_error(F.lit("several changes of one key and no order of them"))
        rest = [c for c in changes.columns if c not in key]
        one = changes.groupBy(*key).agg(F.count("*").alias("_n"), F.first(F.struct(*rest)).alias("_x"))
        checked = one.withColumn("_x", F.when(F.col("_n") > 1, many.cast(one.schema["_x"].dataType)).otherwise(F.col("_x")))
        changes = checked.select(*key, *(F.col(f"_x.`{c}`").alias(c) for c in rest))
    new = changes.select(*key, *(F.col(c).alias(f"_new_{c}") for c in assigned))
    met = view.join(new, key)
    return met.select(*(F.col(f"_new_{c}").alias(c) if c in assigned else F.col(c) for c in view.columns)).withColumn(OP, F.lit(UPSERT))


def merge_overlays(local: DataFrame, peer: DataFrame, key: list[str], peer_key: list[str]) -> DataFrame:
    """Two sources' changes as one tail; keys and schemas must agree."""
    if key != peer_key:
        raise EngineError(f"primary keys differ: {key} and {peer_key}")
    if dict(local.dtypes) != dict(peer.dtypes):
        raise EngineError("schemas differ")
    return local.unionByName(peer)


def ingest(tail: DataFrame, key: list[str]) -> DataFrame:
    """Known operations only; keyed ones on a table without a key are an error where they occur."""
    known = tail.where(F.col(OP).isin(APPEND, *KEYED))
    if key:
        return known
    bad = F.when(F.col(OP).isin(*KEYED), F.raise_error(F.lit("keyed change on a table without a primary key")).cast("string")).otherwise(F.col(OP))
    return known.withColumn(OP, bad)


def runs(tail: DataFrame) -> DataFrame:
    """Run-length groups of equal operations in order of sequence: first and last sequence, operation, rows."""
    # runs within ranges of the sequence, by all tasks; only those meet in one order
    own = Window.partitionBy("_part").orderBy(SEQ)
    ranged = tail.select(SEQ, OP).repartitionByRange(SEQ).withColumn("_part", F.spark_partition_id())
    marked = ranged.withColumn("_new", (F.lag(OP).over(own) != F.col(OP)).cast("int")).withColumn("_run", F.sum(F.coalesce("_new", F.lit(0))).over(own))
    pieces = marked.groupBy("_part", "_run", OP).agg(F.min(SEQ).alias("first_seq"), F.max(SEQ).alias("last_seq"), F.count("*").alias("n"))
    whole = Window.orderBy("first_seq")
    joined = pieces.withColumn("_new", (F.lag(OP).over(whole) != F.col(OP)).cast("int")).withColumn("_run", F.sum(F.coalesce("_new", F.lit(0))).over(whole))
    return joined.groupBy("_run", OP).agg(F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq"), F.sum("n").alias("n")).drop("_run")


def literal_key(text: str, kind: str) -> object | None:
    """A literal as a key of its column, or None where its writing is not the value's own ('05' for an integer)."""
    quoted = len(text) > 1 and text[0] == text[-1] == "'"
    raw = text[1:-1].replace("''", "'") if quoted else text
    if kind in ("tinyint", "smallint", "int", "bigint"):
        try:
            value = int(raw)
        except ValueError:
            return None
        return value if str(value) == raw else None
    if kind == "boolean":
        return {"true": True, "false": False}.get(raw.lower())
    if kind == "string":
        return raw if quoted else None
    if kind == "date":
        import datetime

        raw = raw[5:].strip().strip("'") if raw.lower().startswith("date ") else raw
        try:
            value = datetime.date.fromisoformat(raw)
        except ValueError:
            return None
        return value if value.isoformat() == raw else None
    return None


def keyed_candidate(conjuncts: dict[str, str], assigned: list[str], key: list[str], kinds: dict[str, str]) -> dict[str, object] | None:
    """The key that a predicate of equalities names exactly, or None where the statement is no keyed one."""
    if not key or set(conjuncts) != set(key) or set(assigned) & set(key):
        return None
    values = {c: literal_key(conjuncts[c], kinds[c]) for c in key}
    return None if any(v is None for v in values.values()) else values


def key_filter(keys: list[dict[str, object]]) -> Column:
    """The disjunction of key equalities, for a short list; longer ones are joined."""
    out = F.lit(False)
    for k in keys:
        one = F.lit(True)
        for c, v in k.items():
            one = one & (F.col(c) == F.lit(v))
        out = out | one
    return out
