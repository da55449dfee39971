"""Definitions: models with columns, measures, aggregations and joins, and the queries over them."""

from __future__ import annotations

import dataclasses
import re
from dataclasses import dataclass, field
from typing import Any

from .dsl import TRANSFORMS
from .errors import CadenzaError
from .functions.calendar import GRANULARITIES

_TYPE_NAMES = {
    "string": "TEXT", "text": "TEXT", "number": "DOUBLE", "double": "DOUBLE", "float": "DOUBLE", "integer": "INT", "int": "INT",
    "time": "TIMESTAMP", "timestamp": "TIMESTAMP", "date": "DATE", "boolean": "BOOLEAN", "bool": "BOOLEAN",
}
SQL_TYPES = {"TEXT": "STRING", "INT": "BIGINT", "DOUBLE": "DOUBLE", "BOOLEAN": "BOOLEAN", "DATE": "DATE", "TIMESTAMP": "TIMESTAMP_NTZ"}
_IDENTIFIER = re.compile(r"[A-Za-z_]\w*\Z")


def type_name(name: str | None) -> str | None:
    """One of the six scalar types; the former spellings are read too."""
    if name is None:
        return None
    known = _TYPE_NAMES.get(name.lower())
    if known is None:
        raise CadenzaError(f"unknown type {name!r}")
    return known


def _make(cls, value, **more):
    if isinstance(value, cls):
        return value
    if isinstance(value, str) and more:
        return cls(**{next(iter(more)): value})
    names = {f.name for f in dataclasses.fields(cls)}
    if extra := set(value) - names:
        raise CadenzaError(f"{cls.__name__} has no {', '.join(sorted(extra))}")
    return cls(**value)


@dataclass(frozen=True)
class Column:
    """A dimension or the input of aggregations, whichever a query makes of it."""

    name: str
    sql: str | None = None
    type: str | None = None
    primary_key: bool = False
    allowed_aggregations: tuple[str, ...] | None = None
    filter: str | None = None
    label: str | None = None
    format: str | None = None
    description: str | None = None
    meta: dict[str, Any] = field(default_factory=dict, hash=False)

    def __post_init__(self):
        if not self.name or re.search(r"[.:]", self.name):
            raise CadenzaError(f"column name {self.name!r} may not have '.' or ':'")
        object.__setattr__(self, "type", type_name(self.type))
        if self.allowed_aggregations is not None:
            object.__setattr__(self, "allowed_aggregations", tuple(self.allowed_aggregations))


@dataclass(frozen=True)
class Measure:
    formula: str
    name: str | None = None
    type: str | None = None
    label: str | None = None
    description: str | None = None
    meta: dict[str, Any] = field(default_factory=dict, hash=False)

    def __post_init__(self):
        object.__setattr__(self, "type", type_name(self.type))
        if self.name is not None and (not _IDENTIFIER.match(self.name) or self.name in TRANSFORMS):
            raise CadenzaError(f"measure name {self.name!r} has to be an identifier and no transform")


@dataclass(frozen=True)
class Aggregation:
    """A template over {value} (or {expr}) and its parameters."""

    name: str
    formula: str
    params: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self):
        if not _IDENTIFIER.match(self.name) or self.name in TRANSFORMS - {"first", "last"}:
            raise CadenzaError(f"aggregation name {self.name!r} has to be an identifier and no transform")


@dataclass(frozen=True)
class Join:
    target_model: str
    join_pairs: tuple[tuple[str, str], ...]
    join_type: str = "left"

    def __post_init__(self):
        pairs = tuple(tuple(p) for p in self.join_pairs)
        if not pairs or any(len(p) != 2 for p in pairs):
            raise CadenzaError(f"join to {self.target_model}: pairs of columns are needed")
        if self.join_type not in ("left", "inner"):
            raise CadenzaError(f"join to {self.target_model}: left or inner, not {self.join_type!r}")
        object.__setattr__(self, "join_pairs", pairs)


@dataclass(frozen=True)
class Model:
    """A relation: exactly one of a table, a SQL text, saved queries, or (for stages of a query) a frame."""

    name: str
    sql_table: str | None = None
    sql: str | None = None
    source_queries: tuple | None = None
    columns: tuple[Column, ...] = ()
    measures: tuple[Measure, ...] = ()
    aggregations: tuple[Aggregation, ...] = ()
    joins: tuple[Join, ...] = ()
    filters: tuple[str, ...] = ()
    default_time_dimension: str | None = None
    query_variables: dict[str, Any] = field(default_factory=dict)
    label: str | None = None
    description: str | None = None
    meta: dict[str, Any] = field(default_factory=dict, hash=False)
    frame: Any = field(default=None, compare=False, repr=False)
    #: Of a stage: its columns that are aggregated values, and the models it came from.
    aggregated: frozenset[str] = frozenset()
    origins: tuple[str, ...] = ()

    def __post_init__(self):
        if not self.name or re.search(r"__|[.:]", self.name):
            raise CadenzaError(f"model name {self.name!r} may not have '__', '.' or ':'")
        if sum(x is not None for x in (self.sql_table, self.sql, self.source_queries, self.frame)) != 1:
            raise CadenzaError(f"model {self.name}: exactly one of sql_table, sql and source_queries")
        for name, cls in (("columns", Column), ("measures", Measure), ("aggregations", Aggregation), ("joins", Join)):
            object.__setattr__(self, name, tuple(_make(cls, x) for x in getattr(self, name) or ()))
        object.__setattr__(self, "filters", tuple(self.filters or ()))
        if any(m.name is None for m in self.measures):
            raise CadenzaError(f"model {self.name}: its measures need names")
        names = [c.name for c in self.columns] + [m.name for m in self.measures]
        if twice := {n for n in names if names.count(n) > 1}:
            raise CadenzaError(f"model {self.name}: {', '.join(sorted(twice))} is defined twice")

    def column(self, name: str) -> Column | None:
        return next((c for c in self.columns if c.name == name), None)

    def measure(self, name: str) -> Measure | None:
        return next((m for m in self.measures if m.name == name), None)

    def aggregation(self, name: str) -> Aggregation | None:
        return next((a for a in self.aggregations if a.name == name), None)

    def join(self, target: str) -> Join | None:
        return next((j for j in self.joins if j.target_model == target), None)

    @staticmethod
    def of(value: Model | dict) -> Model:
        return _make(Model, value)


@dataclass(frozen=True)
class TimeDimension:
    dimension: str
    granularity: str
    date_range: tuple[str, str] | None = None
    label: str | None = None

    def __post_init__(self):
        if self.granularity not in GRANULARITIES:
            raise CadenzaError(f"unknown granularity {self.granularity!r}")
        if self.date_range is not None:
            object.__setattr__(self, "date_range", tuple(self.date_range))
            if len(self.date_range) != 2:
                raise CadenzaError("date_range has a first and a last date")


@dataclass(frozen=True)
class Order:
    column: str
    direction: str = "asc"

    def __post_init__(self):
        known = {"asc": "asc", "ascending": "asc", "desc": "desc", "descending": "desc"}
        if self.direction.lower() not in known:
            raise CadenzaError(f"unknown direction {self.direction!r}")
        object.__setattr__(self, "direction", known[self.direction.lower()])

    @staticmethod
    def of(value) -> Order:
        if isinstance(value, str):
            return Order(value)
        if isinstance(value, dict) and set(value) <= {"column", "direction"} and "column" in value:
            return Order(**value)
        if isinstance(value, dict) and len(value) == 1 and "column" not in value:  # {"revenue:sum": "desc"}
            return Order(*next(iter(value.items())))
        if isinstance(value, Order):
            return value
        raise CadenzaError(f"can't order by {value!r}")


@dataclass(frozen=True)
class Extension:
    """A model with more columns, measures or joins for one query."""

    source_name: str
    columns: tuple = ()
    measures: tuple = ()
    joins: tuple = ()


@dataclass(frozen=True)
class Query:
    source_model: Any
    measures: tuple[Measure, ...] = ()
    dimensions: tuple[str, ...] = ()
    time_dimensions: tuple[TimeDimension, ...] = ()
    main_time_dimension: str | None = None
    filters: tuple[str, ...] = ()
    variables: dict[str, Any] = field(default_factory=dict)
    order: tuple[Order, ...] = ()
    limit: int | None = None
    offset: int | None = None
    whole_periods_only: bool = False
    distinct_dimension_values: bool = True
    name: str | None = None

    def __post_init__(self):
        object.__setattr__(self, "measures", tuple(_make(Measure, m, formula=m) if isinstance(m, str) else _make(Measure, m) for m in self.measures or ()))
        object.__setattr__(self, "dimensions", tuple(d if isinstance(d, str) else d["name"] for d in self.dimensions or ()))
        object.__setattr__(self, "time_dimensions", tuple(_make(TimeDimension, t) for t in self.time_dimensions or ()))
        object.__setattr__(self, "order", tuple(Order.of(o) for o in self.order or ()))
        object.__setattr__(self, "filters", tuple(self.filters or ()))
        object.__setattr__(self, "variables", dict(self.variables or {}))

    @staticmethod
    def of(value: Query | dict) -> Query:
        return _make(Query, value)
