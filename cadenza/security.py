"""Row-level rules, applied where scans are made and nowhere else."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .errors import PolicyError


def _is(column: str, value: Any):
    values = list(value) if isinstance(value, (list, tuple, set, frozenset)) else [value]
    return F.col(f"`{column}`").isin(*values)


@dataclass(frozen=True)
class ColumnFilterRule:
    """Every table with the column shows only rows with the value (or one of the values)."""

    column: str
    value: Any
    on_unapplicable: str = "block"  # what a table without the column gets: an error, or 'pass'

    def __post_init__(self):
        if self.on_unapplicable not in ("block", "pass"):
            raise PolicyError("on_unapplicable is block or pass")


@dataclass(frozen=True)
class JoinFilterRule:
    """Rows of `target_table` count if the path of joins from them ends at a row with the value."""

    target_table: str
    join_path: tuple  # of (table, ((column, its column), ...)), from the target on
    column: str
    value: Any

    def __post_init__(self):
        path = tuple((t, tuple(tuple(p) for p in pairs)) for t, pairs in self.join_path)
        if not path or any(not pairs for _, pairs in path):
            raise PolicyError(f"the join rule of {self.target_table} needs a path")
        object.__setattr__(self, "join_path", path)


@dataclass(frozen=True)
class Policy:
    rules: tuple = ()

    def __post_init__(self):
        object.__setattr__(self, "rules", tuple(self.rules))
        joins = [r for r in self.rules if isinstance(r, JoinFilterRule)]
        blocks = [r for r in self.rules if isinstance(r, ColumnFilterRule) and r.on_unapplicable == "block"]
        if joins and not blocks:
            raise PolicyError("join rules need a column rule that blocks beside them")

    def apply(self, table: str, df: DataFrame, read: Callable[[str], DataFrame]) -> DataFrame:
        """The rows of the table that the rules show."""
        joins = [r for r in self.rules if isinstance(r, JoinFilterRule) and r.target_table == table]
        if joins:
            for rule in joins:
                df = self._semi(df, rule, read)
            return df
        for rule in self.rules:
            if isinstance(rule, JoinFilterRule):
                continue
            if rule.column in df.columns:
                df = df.filter(_is(rule.column, rule.value))
            elif rule.on_unapplicable == "block":
                raise PolicyError(f"table {table} has no column {rule.column}")
        return df

    def _semi(self, df: DataFrame, rule: JoinFilterRule, read: Callable[[str], DataFrame]) -> DataFrame:
        # From the far end: the rows with the value, then those of each table before that reach them.
        tables = [read(t) for t, _ in rule.join_path]
        if rule.column not in tables[-1].columns:
            raise PolicyError(f"table {rule.join_path[-1][0]} has no column {rule.column}")
        tables[-1] = tables[-1].filter(_is(rule.column, rule.value))
        for i in range(len(tables) - 1, -1, -1):
            pairs = rule.join_path[i][1]
            keys = tables[i].select(*[F.col(f"`{b}`").alias(f"_p{n}") for n, (_, b) in enumerate(pairs)])
            before = tables[i - 1] if i else df
            on = [F.col(f"`{a}`") == F.col(f"_p{n}") for n, (a, _) in enumerate(pairs)]
            before = before.join(keys, on, "left_semi")
            if i:
                tables[i - 1] = before
            else:
                df = before
        return df
