"""Models from tables: typed columns, keys and joins by the names of columns (Parquet has no foreign keys)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from ..errors import CadenzaError
from ..operators.aggregate import type_of_spark
from ..semantics import Column, Join, Model


@dataclass
class Report:
    added_models: list[str] = field(default_factory=list)
    added_columns: list[tuple[str, str]] = field(default_factory=list)
    added_joins: list[tuple[str, str]] = field(default_factory=list)
    drift: list = field(default_factory=list)


def _bases(columns: Sequence[str]) -> dict[str, str]:
    """Column names without a prefix that all of the table's columns share (o_custkey: custkey)."""
    heads = {c.split("_", 1)[0] for c in columns if "_" in c}
    shared = len(heads) == 1 and all("_" in c for c in columns) and len(next(iter(heads))) <= 2
    return {c: c.split("_", 1)[1] if shared else c for c in columns}


def primary_key(table: str, columns: Sequence[str]) -> str | None:
    """id, or <start of the table's name>key or <that>_id."""
    singular = {table, table.rstrip("s"), *(table[:n] for n in range(3, len(table) + 1))}
    wanted = {"id", *(s + e for s in singular for e in ("key", "_id", "_key"))}
    return next((c for c, base in _bases(columns).items() if base in wanted), None)


def joins_by_name(tables: dict[str, Sequence[str]]) -> dict[str, list[Join]]:
    """A join wherever a table has a column named as another's key."""
    keys = {t: primary_key(t, cols) for t, cols in tables.items()}
    out: dict[str, list[Join]] = {t: [] for t in tables}
    for table, columns in tables.items():
        for column, base in _bases(columns).items():
            for other, key in keys.items():
                if key and other != table and base != "id" and base == _bases(tables[other])[key] and column != keys[table]:
                    out[table].append(Join(other, ((column, key),)))
    return out


def check_graph(joins: dict[str, list[Join]]) -> None:
    """Joins made from names may not go in circles."""
    state: dict[str, int] = {}

    def visit(t: str) -> None:
        if state.get(t) == 1:
            raise CadenzaError(f"joins go in a circle at {t}")
        if state.get(t) is None:
            state[t] = 1
            for j in joins.get(t, ()):
                visit(j.target_model)
            state[t] = 2

    for t in joins:
        visit(t)


def ingest(engine, include: Sequence[str] | None = None, exclude: Sequence[str] = (), joins: dict | None = None) -> Report:
    """Adds what is new, changes nothing that is there, and tells what no longer fits."""
    from . import drift

    names = [t for t in engine.tables.names() if (include is None or t in include) and t not in exclude]
    schemas = {t: engine.tables.read(t).dtypes for t in names}
    found = {t: list(js) for t, js in joins.items()} if joins is not None else joins_by_name({t: [c for c, _ in s] for t, s in schemas.items()})
    check_graph(found)
    report = Report()
    for table, schema in schemas.items():
        key = primary_key(table, [c for c, _ in schema])
        columns = tuple(Column(c, type=type_of_spark(t), primary_key=c == key) for c, t in schema)
        times = [c.name for c in columns if c.type in ("DATE", "TIMESTAMP")]
        own = tuple(found.get(table, ()))
        old = engine.models.get(table)
        if old is None:
            engine.add(Model(table, sql_table=table, columns=columns, joins=own, default_time_dimension=times[0] if times else None))
            report.added_models.append(table)
            continue
        more = tuple(c for c in columns if not old.column(c.name) and not old.measure(c.name))
        new_joins = tuple(j for j in own if not old.join(j.target_model))
        if more or new_joins:
            engine.add(replace(old, columns=old.columns + more, joins=old.joins + new_joins))
            report.added_columns += [(table, c.name) for c in more]
            report.added_joins += [(table, j.target_model) for j in new_joins]
    report.drift = drift.validate(engine)
    return report
