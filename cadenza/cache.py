"""Cached results: by the plan's meaning, with a lifetime and keys that say when data changed."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class CacheConfig:
    ttl_seconds: float | None = None
    #: (table, SQL expression) whose value tells whether the table changed; looked at by refresh() only.
    refresh_keys: tuple[tuple[str, str], ...] = ()


@dataclass
class _Entry:
    plan: DataFrame
    cached: DataFrame
    at: float
    config: CacheConfig
    seen: tuple = ()


#: Results that are kept at once, at most.
MOST = 64


@dataclass
class ResultCache:
    """The results used least recently go when there are more than `most`."""

    clock: Callable[[], float] = time.monotonic
    most: int = MOST
    entries: list[_Entry] = field(default_factory=list)
    hits: int = 0

    def get(self, df: DataFrame, config: CacheConfig, read: Callable[[str], DataFrame]) -> DataFrame:
        """The cached result of the same plan while it lives, else this one from now on."""
        for e in list(self.entries):
            if e.config.ttl_seconds is not None and self.clock() - e.at > e.config.ttl_seconds:
                self._drop(e)
            elif e.plan.sameSemantics(df):
                self.hits += 1
                self.entries.append(self.entries.pop(self.entries.index(e)))
                return e.cached
        entry = _Entry(df, df.cache(), self.clock(), config, _look(config, read))
        self.entries.append(entry)
        for e in self.entries[: -self.most]:
            self._drop(e)
        return entry.cached

    def evict(self, df: DataFrame | None = None) -> int:
        gone = [e for e in self.entries if df is None or e.plan.sameSemantics(df)]
        for e in gone:
            self._drop(e)
        return len(gone)

    def refresh(self, read: Callable[[str], DataFrame]) -> int:
        """Drops what has new values of its refresh keys."""
        gone = [e for e in self.entries if e.config.refresh_keys and _look(e.config, read) != e.seen]
        for e in gone:
            self._drop(e)
        return len(gone)

    def _drop(self, e: _Entry) -> None:
        e.cached.unpersist()
        self.entries.remove(e)


def _look(config: CacheConfig, read: Callable[[str], DataFrame]) -> tuple:
    return tuple(read(table).selectExpr(f"{text} AS v").first()[0] for table, text in config.refresh_keys)
