"""Aggregations of a model's columns, with the rules of which column admits which."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import CadenzaError, NotAllowed, UnknownName
from ..functions.names import BY_TYPE, COUNTS, NUMERIC, TWO_COLUMNS
from ..semantics import Model
from .relation import Path, Relation

_PARAMETER = re.compile(r"[A-Za-z_][\w.]*\Z")
_SPARK_TYPES = {"bigint": "INT", "int": "INT", "smallint": "INT", "tinyint": "INT", "double": "DOUBLE", "float": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP"}


def type_of_spark(name: str) -> str:
    return "DOUBLE" if name.startswith("decimal") else _SPARK_TYPES.get(name, "TEXT")


def check(model: Model, column_name: str, agg: str, column_type: str | None) -> None:
    """Known name, then primary key, then the column's own list, then the type."""
    custom = model.aggregation(agg)
    if not custom and agg not in NUMERIC:
        raise UnknownName(f"unknown aggregation {agg!r}")
    column = model.column(column_name)
    if column and column.primary_key and agg not in COUNTS:
        raise NotAllowed(f"{column_name} is a primary key; it can only be counted")
    if column and column.allowed_aggregations is not None and agg not in column.allowed_aggregations:
        raise NotAllowed(f"{column_name} admits only {', '.join(column.allowed_aggregations)}")
    if not custom and column_type and agg not in BY_TYPE[column_type]:
        raise NotAllowed(f"{agg} is not for {column_name} of type {column_type}")


def _inside(value: str, condition: str | None) -> str:
    return f"CASE WHEN {condition} THEN {value} END" if condition else value


def _steady(agg: str, value: str) -> Column:
    """The sum or mean of doubles as a sum of decimals, which is the same in any order of the rows; equal groups tie.

    Where a value isn't kept by the decimal (over 10 ** 15, or of more than 17 places) or the sum has no room, the group is summed as doubles.
    """
    exact = f"try_cast({value} AS DECIMAL(32, 17))"
    kept = f"count({value}) = count_if(CAST({exact} AS DOUBLE) = {value})"
    total = f"CASE WHEN {kept} THEN coalesce(CAST(try_sum({exact}) AS DOUBLE), sum({value})) ELSE sum({value}) END"
    return F.expr(total if agg == "sum" else f"try_divide({total}, CAST(count({value}) AS DOUBLE))")


def agg_column(rel: Relation, path: Path, name: str, agg: str, args: tuple, kwargs: dict, time: str | None, as_filter: bool = False, steady: bool = False) -> Column:
    """The aggregate as a Column over `rel`'s frame. `time` orders first and last; `as_filter` leaves the column's own filter to a WHERE.

    `steady`: sums and means of doubles don't depend on the order of the rows.
    """
    model = rel.model_at(path)
    if name == "*":
        if agg != "count":
            raise NotAllowed("* can only be counted")
        return F.count(F.lit(1))
    column = model.column(name)
    value = rel.column_sql(path, name)
    condition = rel.expand(path, column.filter) if column and column.filter and not as_filter else None
    kind = column.type if column and column.type else type_of_spark(_type(rel, value))
    check(model, name, agg, kind)
    custom = model.aggregation(agg)
    if custom:
        return F.expr(_template(rel, path, custom, _inside(value, condition), args, kwargs))
    kept = _inside(value, condition)

    def parameter(key: str, nth: int = 0) -> str:
        given = kwargs.get(key, args[nth] if len(args) > nth else None)
        if not isinstance(given, str) or not _PARAMETER.match(given):
            raise CadenzaError(f"{agg} needs the column {key}=")
        *hops, leaf = given.split(".")
        return rel.column_sql((*path, *hops), leaf)

    if agg == "sum" and kind == "BOOLEAN":
        return F.expr(f"sum(CAST({kept} AS INT))")
    if steady and agg in ("sum", "avg") and _type(rel, value) in ("double", "float"):
        return _steady(agg, f"CAST(({kept}) AS DOUBLE)")
    if agg in ("count", "sum", "avg", "min", "max", "median", "stddev_samp", "stddev_pop", "var_samp", "var_pop"):
        return F.expr(f"{agg}({kept})")
    if agg == "count_distinct":
        return F.expr(f"count(DISTINCT {kept})")
    if agg == "count_distinct_approx":
        return F.expr(f"approx_count_distinct({kept})")
    if agg == "percentile":
        p = kwargs.get("p", args[0] if args else None)
        if isinstance(p, bool) or not isinstance(p, (int, float)) or not 0 <= p <= 1:
            raise CadenzaError("percentile needs p= between 0 and 1")
        return F.expr(f"percentile({kept}, {float(p)}D)")
    if agg == "weighted_avg":
        weight = _inside(parameter("weight"), condition)
        return F.expr(f"try_divide(sum(({kept}) * ({weight})), CAST(sum({weight}) AS DOUBLE))")
    if agg in TWO_COLUMNS:
        other = parameter("other")
        x, y = (f"CASE WHEN ({kept}) IS NOT NULL AND ({other}) IS NOT NULL THEN CAST({v} AS DOUBLE) END" for v in (kept, other))
        if agg != "corr":
            return F.expr(f"{agg}({x}, {y})")
        spread = f"(stddev_pop({x}) * stddev_pop({y}))"
        return F.expr(f"CASE WHEN count({x}) > 1 THEN try_divide(covar_pop({x}, {y}), {spread}) END")
    if time is None:
        raise CadenzaError(f"{agg} of {name} needs a time column")
    pick = "min_by" if agg == "first" else "max_by"
    rows = [f"({time}) IS NOT NULL", *([f"({condition})"] if condition else [])]
    # Of several at the same time the least (first) or greatest (last), so that reruns agree.
    return F.expr(f"{pick}({value}, struct({time}, {value})) FILTER (WHERE {' AND '.join(rows)})")


def _type(rel: Relation, sql: str) -> str:
    plain = re.fullmatch(r"`([^`.]+)\.([^`]+)`", sql)
    for path in ((), *rel.paths) if plain else ():
        if rel.alias(path) == plain[1]:
            return dict(rel.engine.scan(rel.model_at(path)).dtypes)[plain[2]]
    return rel.frame().select(F.expr(sql).alias("x")).dtypes[0][1]


def _template(rel: Relation, path: Path, custom, value: str, args: tuple, kwargs: dict) -> str:
    params = dict(custom.params)
    params.update(zip([k for k in params if k not in kwargs], args, strict=False))
    params.update(kwargs)
    text = custom.formula

    def put(m: re.Match) -> str:
        key = m[1]
        if key in ("value", "expr"):
            return f"({value})"
        if key not in params:
            raise CadenzaError(f"aggregation {custom.name} needs {key}=")
        given = params[key]
        if isinstance(given, (int, float)) and not isinstance(given, bool):
            return str(given)
        if isinstance(given, str) and re.fullmatch(r"-?\d+(\.\d+)?", given):
            return given
        if not isinstance(given, str) or (key in kwargs or given not in custom.params.values()) and not _PARAMETER.match(given):
            raise CadenzaError(f"parameter {key}={given!r} has to be a name or a number")
        return rel.expand(path, given)

    # Names of the template itself are the model's columns.
    pieces = re.split(r"(\{\w+\})", text)
    return "".join(put(re.match(r"\{(\w+)\}", p)) if re.fullmatch(r"\{\w+\}", p) else rel.expand(path, p) for p in pieces)


def grouped(df: DataFrame, keys: list[tuple[str, str]], aggs: list[tuple[str, Column]]) -> DataFrame:
    """Rows by the keys (name, SQL); with no keys one row, with no aggregates the distinct keys."""
    withkeys = df.select("*", *[F.expr(sql).alias(name) for name, sql in keys]) if keys else df
    names = [name for name, _ in keys]
    if not aggs:
        return withkeys.select(*names).distinct() if names else df.sparkSession.range(1).select()
    grouped_ = withkeys.groupBy(*names) if names else withkeys.groupBy()
    return grouped_.agg(*[c.alias(name) for name, c in aggs])
