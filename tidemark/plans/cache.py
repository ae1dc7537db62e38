"""Bounded staleness, plans and results that are used again while their tables are unchanged."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tidemark.errors import UndefinedTable
from tidemark.sources.catalog import Catalog, canonical

PLANS, PINNED, RESULT_ROWS = 256, 16, 100_000


@dataclass
class _Entry:
    pointer: str
    at: float
    generation: int


class Freshness:
    """Pointers of tables no older than ``seconds``; own writes are always seen.

    A load that overlaps a write doesn't count as fresh: its generation was
    taken before. If the catalog fails, ``stale_ok`` serves the last pointer.
    """

    def __init__(self, catalog: Catalog, seconds: float = 0.0, stale_ok: bool = True, now: Callable[[], float] = time.monotonic) -> None:
        self.catalog, self.seconds, self.stale_ok, self.now = catalog, seconds, stale_ok, now
        self.entries: dict[str, _Entry] = {}
        self.writes: dict[str, int] = {}

    def pointer(self, name: str) -> str:
        name = canonical(name)
        written = self.writes.get(name, 0)
        e = self.entries.get(name)
        if e and e.generation == written and self.seconds and self.now() - e.at <= self.seconds:
            return e.pointer
        try:
            pointer = self.catalog.pointer(name)
        except UndefinedTable:
            raise
        except Exception:  # remote stores fail with classes of their own
            if e and self.stale_ok and self.seconds:
                return e.pointer
            raise
        self.entries[name] = _Entry(pointer, self.now(), written)
        return pointer

    def invalidate(self, name: str) -> None:
        name = canonical(name)
        self.writes[name] = self.writes.get(name, 0) + 1


class PlanCache:
    """DataFrames by statement, each valid while the pointers of its tables are what they were."""

    def __init__(self, size: int = PLANS) -> None:
        self.size, self.held, self.hits, self.misses = size, OrderedDict(), 0, 0

    def get(self, key: tuple, pointers: dict[str, str]) -> DataFrame | None:
        got = self.held.get(key)
        if got is None or got[0] != pointers:
            self.held.pop(key, None)
            self.misses += 1
            return None
        self.held.move_to_end(key)
        self.hits += 1
        return got[1]

    def put(self, key: tuple, pointers: dict[str, str], df: DataFrame) -> None:
        self.held[key] = (dict(pointers), df)
        while len(self.held) > self.size:
            self.held.popitem(last=False)


class ResultCache:
    """Results kept by Spark within a bound of rows; larger ones aren't, and the oldest go first."""

    def __init__(self, rows: int = RESULT_ROWS) -> None:
        self.rows, self.used, self.held = rows, 0, OrderedDict()

    def get(self, key: tuple) -> DataFrame | None:
        if key in self.held:
            self.held.move_to_end(key)
            return self.held[key][1]
        return None

    def put(self, key: tuple, df: DataFrame) -> DataFrame:
        kept = df.limit(self.rows + 1).persist()
        n = kept.count()
        if n > self.rows:
            kept.unpersist()
            return df
        while self.held and self.used + n > self.rows:
            _, (m, old) = self.held.popitem(last=False)
            self.used -= m
            old.unpersist()
        self.held[key] = (n, kept)
        self.used += n
        return kept


def deterministic(df: DataFrame) -> bool:
    """Whether the plan has no function like now() or rand()."""
    plan = df._jdf.queryExecution().analyzed()
    text = plan.toString().lower()
    return plan.deterministic() and not any(w in text for w in ("current_timestamp", "current_date", "localtimestamp", "now()", "current_time"))
