"""Queries to DataFrames.

A query becomes a grid: one row for each combination of its dimensions and time buckets. Aggregates of
the model's own rows are one groupBy; aggregates that must not share its rows (measures of a joined model,
filters that reach another model, trailing windows) are grids of their own, joined by the keys. Transforms add columns layer
by layer; time shifts join a grid whose time column is moved. Filters go before the grid (rows), on it (aggregates)
or after the transforms. Names inside are k0, k1, ... and h0, h1, ...; public names come with the last select.
"""

from __future__ import annotations

import datetime
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dsl
from ..dsl import Agg, Call, In, Is, Like, Lit, Op, Ref
from ..errors import CadenzaError, JoinPathError, NotAllowed, UnknownName
from ..functions import scalars
from ..functions.calendar import aligned, bucket_sql, duration, moved_sql, period_end, period_start, widened
from ..operators.aggregate import agg_column, grouped
from ..operators.quantile import quantile
from ..operators.relation import Path, Relation, sql_names
from ..operators.trailing import trailing
from ..operators.windows import RANKS, ranked, streak, streak_parts, window_transform
from ..semantics import SQL_TYPES, Measure, Model, Query

_WORD = re.compile(r"\W+")
QUANTILES = {"percentile", "median"}
RANK_NAMES = {*RANKS, "ntile"}


def suffix(args: tuple, kwargs: tuple) -> str:
    parts = [_WORD.sub("_", str(a)).strip("_") for a in args]
    for k, v in sorted(kwargs):
        parts += [_WORD.sub("_", str(k)).strip("_"), _WORD.sub("_", str(v)).strip("_")]
    parts = [p for p in parts if p]
    return "_" + "_".join(parts) if parts else ""


def leaf_name(agg: Agg) -> str:
    leaf = agg.path.rsplit(".", 1)[-1]
    return ("" if leaf == "*" else leaf) + "_" + agg.name + suffix(agg.args, agg.kwargs)


def mangled(formula: str) -> str:
    return formula.replace(" ", "_").replace("/", "_div_").replace(":", "_").replace("*", "")


def fill_variables(text: str, variables: dict) -> str:
    """{name} by its value, {{ and }} by single braces."""

    def put(m: re.Match) -> str:
        if m[0] in ("{{", "}}"):
            return m[0][0]
        if m[1] not in variables:
            raise UnknownName(f"no value for the variable {m[1]!r}")
        value = variables[m[1]]
        if isinstance(value, bool) or not isinstance(value, (str, int, float)):
            raise CadenzaError(f"the variable {m[1]} has to be a text or a number")
        return str(value)

    return re.sub(r"\{\{|\}\}|\{(\w+)\}", put, text)


@dataclass
class Key:
    """A dimension or time bucket of the grid."""

    path: Path
    name: str
    public: str
    id: str
    granularity: str | None = None
    date_range: tuple[str, str] | None = None
    label: str | None = None


@dataclass
class Grid:
    """Aggregated rows: keys k*, values by what they are the value of."""

    df: DataFrame
    keys: list[Key]
    values: dict[Agg, str]
    hidden: dict = field(default_factory=dict)
    bare: bool = True  # no row of it was filtered out after the aggregation


@dataclass
class Planned:
    df: DataFrame
    columns: list[dict]
    aggregated: frozenset[str]


class Planner:
    def __init__(self, engine, query: Query, model: Model, variables: dict):
        self.engine, self.query, self.model = engine, query, model
        self.counter = 0
        self.ranks = False
        self.moved_measures: list[str] = []
        self.keys = self._keys()
        self.measures = [(m, self.bind(dsl.parse(m.formula))) for m in query.measures if not self._is_dimension(m)]
        self.names = {}
        for m, node in self.measures:
            if m.name:
                self.names[m.name] = node
        self.extra_aggs = {a.name for a in model.aggregations}
        texts = [fill_variables(f, variables) for f in query.filters]
        texts += self._whole_periods(texts)
        self.where, self.having, self.post = [], [], []
        for text in texts:
            self._classify(text)

    # -- names ---------------------------------------------------------------

    def strip(self, path: str) -> str:
        head, _, rest = path.partition(".")
        return rest if rest and head == self.model.name else path

    def locate(self, path: str, model: Model | None = None) -> tuple[Path, str]:
        """Join path and column of a dotted name."""
        model = model or self.model
        head, _, rest = path.partition(".")
        if rest and head == model.name:
            path = rest
        parts = path.split(".")
        flat = "__".join(parts)
        if len(parts) > 1 and model.column(flat):
            return (), flat
        if len(parts) > 2 and parts[0] in model.origins and model.column("__".join(parts[1:])):
            return (), "__".join(parts[1:])
        if len(parts) > 1 and parts[0] in model.origins and model.column(parts[-1]):
            return (), parts[-1]
        *hops, name = parts
        hops = [h for hop in hops for h in hop.split("__")]
        at = self.engine.model_at(model, tuple(hops))
        if name != "*" and not at.column(name) and name not in self.engine.physical_columns(at):
            raise UnknownName(f"model {at.name} has no column {name!r}")
        return tuple(hops), name

    def _is_dimension(self, m: Measure) -> bool:
        """A bare column among the measures is a dimension."""
        node = dsl.parse(m.formula)
        if isinstance(node, Ref) and not self.model.measure(self.strip(node.path)):
            self.moved_measures.append(node.path)
            return True
        return False

    def _keys(self) -> list[Key]:
        keys, q = [], self.query
        bare = [m.formula for m in q.measures if isinstance(n := dsl.parse(m.formula), Ref) and not self.model.measure(self.strip(n.path))]
        for d in [*q.dimensions, *bare]:
            path, name = self.locate(d)
            public = ".".join([self.model.name, *path, name])
            if all(k.public != public for k in keys):
                keys.append(Key(path, name, public, f"k{len(keys)}"))
        for t in q.time_dimensions:
            path, name = self.locate(t.dimension)
            public = ".".join([self.model.name, *path, name])
            if any(k.public == public for k in keys):
                public += "." + t.granularity
            keys.append(Key(path, name, public, f"k{len(keys)}", t.granularity, t.date_range, t.label))
        return keys

    @property
    def dims(self) -> list[Key]:
        return [k for k in self.keys if not k.granularity]

    @property
    def times(self) -> list[Key]:
        return [k for k in self.keys if k.granularity]

    def time_key(self, what: str) -> Key:
        """The bucket that transforms run along."""
        times = self.times
        if len(times) == 1:
            return times[0]
        for wanted in (self.query.main_time_dimension, self.model.default_time_dimension):
            if wanted and times:
                path, name = self.locate(wanted)
                found = [k for k in times if (k.path, k.name) == (path, name)]
                if found:
                    return found[0]
        raise CadenzaError(f"{what} needs a time dimension" + (" (main_time_dimension says which)" if times else ""))

    def time_column(self, arg: str | None, model: Model, path: Path) -> tuple[Path, str] | None:
        """What first and last go by: the argument, the main time dimension, a dimension or filter of time, the model's default."""
        if arg:
            at, name = self.locate(arg, model)
            return (*path, *at), name
        if path == () and model is self.model:
            if self.query.main_time_dimension:
                return self.locate(self.query.main_time_dimension)
            for k in self.keys:
                if not k.granularity and self._is_time(k.path, k.name):
                    return k.path, k.name
            if self.times:
                return self.times[0].path, self.times[0].name
            for node in self.where:
                for n in dsl.walk(node):
                    if isinstance(n, Ref) and self._is_time(*self.locate(n.path)):
                        return self.locate(n.path)
        if model.default_time_dimension:
            at, name = self.locate(model.default_time_dimension, model)
            return (*path, *at), name
        return None

    def _is_time(self, path: Path, name: str) -> bool:
        return self.engine.column_type(self.engine.model_at(self.model, path), name) in ("DATE", "TIMESTAMP")

    # -- binding -------------------------------------------------------------

    def bind(self, node, stack: tuple[str, ...] = ()):
        """Named measures put in; source prefixes and re-aggregations of a stage resolved."""

        def change(n):
            if isinstance(n, Ref):
                name = self.strip(n.path)
                found = self.model.measure(name)
                if found:
                    if name in stack:
                        raise CadenzaError(f"measure {name} is defined by itself")
                    return self.bind(dsl.parse(found.formula), (*stack, name))
                return Ref(name)
            if isinstance(n, Agg):
                path = self.strip(n.path)
                *hops, leaf = path.split(".")
                if hops and self.model.frame is not None and not n.args and not n.kwargs:
                    short = ("" if leaf == "*" else leaf) + "_" + n.name
                    for base in ([*hops[1:]] if hops[0] in self.model.origins else None, hops):
                        flat = None if base is None else "__".join([*base, short])
                        if flat in self.model.aggregated and n.name in ("sum", "min", "max", "count"):
                            return Agg(flat, "sum" if n.name == "count" else n.name)
                return Agg(path, n.name, n.args, n.kwargs)
            return n

        return dsl.rewrite(node, change)

    def _whole_periods(self, texts: list[str]) -> list[str]:
        if not self.query.whole_periods_only:
            return []
        out = []
        for t in self.query.time_dimensions:
            name = t.dimension.rsplit(".", 1)[-1]
            if not any(name in f for f in texts):
                start = period_start(self.engine.today(), t.granularity)
                end = period_end(start - datetime.timedelta(1), t.granularity)
                out.append(f"{t.dimension} <= '{end.isoformat()}'")
        return out

    def _classify(self, text: str) -> None:
        """WHERE for rows, HAVING for aggregates, after the transforms for the rest."""
        node, late = dsl.parse(text), False

        def change(n):
            nonlocal late
            if isinstance(n, Ref):
                name = self.strip(n.path)
                if name in self.names:
                    late = late or not isinstance(self.names[name], Agg)
                    return self.names[name]
                for m, bound in self.measures:
                    if not m.name and (leaf := self._leaf(m, bound)) == name:
                        late = late or not isinstance(bound, Agg)
                        return bound
                return Ref(name)
            return n

        node = self.bind(dsl.rewrite(node, change))
        aggs = dsl.aggregates(node)
        if late or dsl.has_transform(node) or any(dict(a.kwargs).get("window") for a in aggs):
            self.post.append(node)
        elif aggs:
            for n in dsl.walk(node):
                if isinstance(n, Ref) and not self._key_of(n.path):
                    raise NotAllowed(f"{text!r} mixes an aggregate with {n.path}, which is no dimension of the query")
            self.having.append(node)
        else:
            for n in dsl.walk(node):
                if isinstance(n, Ref):
                    path, name = self.locate(n.path)
                    column = self.engine.model_at(self.model, path).column(name)
                    if column and column.sql and any(k == "name" and v.upper() == "OVER" for k, v, _ in sql_names(column.sql)):
                        raise NotAllowed(f"{n.path} is a window column and can't be filtered by")
            self.where.append(node)

    def _leaf(self, m: Measure, node) -> str:
        if m.name:
            return m.name
        return leaf_name(node) if isinstance(node, Agg) else mangled(m.formula)

    def _key_of(self, path: str) -> Key | None:
        path = self.strip(path)
        return next((k for k in self.keys if path in (k.name, ".".join([*k.path, k.name]), k.public)), None)

    # -- rows ----------------------------------------------------------------

    def row_column(self, rel: Relation, node, planner_path: Path | None = ()) -> Column:
        """A condition or expression on rows."""
        if isinstance(node, Lit):
            return F.lit(node.value)
        if isinstance(node, Ref):
            path, name = self.locate(node.path, rel.root)
            return F.expr(rel.column_sql(path, name))
        if isinstance(node, (Agg, Call)) and not (isinstance(node, Call) and node.name in scalars.SCALARS):
            raise NotAllowed("an aggregate can't be used on rows")
        return self._combine(node, lambda n: self.row_column(rel, n))

    def _combine(self, node, of) -> Column:
        if isinstance(node, Lit):
            return F.lit(node.value)
        if isinstance(node, Op):
            if node.op in ("=", "<>") and any(isinstance(a, Lit) and a.value is None for a in node.args):
                other = next(a for a in node.args if not (isinstance(a, Lit) and a.value is None))
                return of(other).isNull() if node.op == "=" else of(other).isNotNull()
            return scalars.operate(node.op, [of(a) for a in node.args])
        if isinstance(node, Call):
            return scalars.call(node.name, [of(a) for a in node.args], [a.value if isinstance(a, Lit) else None for a in node.args])
        if isinstance(node, In):
            some = [v for v in node.values if v is not None]
            out = of(node.arg).isin(*some) if some else F.lit(False)
            return ~out if node.negated else out
        if isinstance(node, Is):
            arg = of(node.arg)
            out = arg.isNull() if node.value is None else arg.eqNullSafe(F.lit(node.value))
            return ~out if node.negated else out
        if isinstance(node, Like):
            out = of(node.arg).like(node.pattern)
            return ~out if node.negated else out
        raise CadenzaError(f"can't evaluate {node}")

    def filtered(self, rel: Relation, where: list, ranges: list[tuple[Path, str, tuple[str, str]]]) -> list[Column]:
        """The WHERE conditions; asking for them tells `rel` which joins they need."""
        out = [self.row_column(rel, node) for node in where]
        for path, name, (low, high) in ranges:
            sql = rel.column_sql(path, name)
            out.append(F.expr(f"{sql} BETWEEN '{_plain(low)}' AND '{_plain(high)}'"))
        return out

    # -- grids ---------------------------------------------------------------

    def grid(self, aggs: list[Agg], shift: tuple[Key, int, str] | None = None, outer: bool = False) -> Grid:
        """The aggregates by the query's keys, the time column moved by `shift`."""
        seen = list(dict.fromkeys(aggs))
        local, apart = [], []
        for a in seen:
            (apart if self._apart(a) else local).append(a)
        ids = {a: self.new("m") for a in seen}
        rel = self._relation(shift)
        keys = [(k.id, self._key_sql(rel, k)) for k in self.keys]
        conditions = self.filtered(rel, self.where, self._ranges()) + self._moved_reach(rel, shift)
        columns = [(ids[a], self._agg(rel, a)) for a in local]
        df = rel.frame()
        for c in conditions:
            df = df.filter(c)
        base = grouped(df, keys, columns)
        if not keys and not columns:
            base = self.engine.spark.range(1).select(F.lit(1).alias("_one"))
        for a in apart:
            base = self._join_apart(base, a, ids[a], shift)
        return Grid(base, self.keys, ids)

    def _reach(self, rel: Relation, key: Key, back: list[tuple[int, str]], on: list[tuple[int, str]]) -> list[Column]:
        """Bounds on the bare time column that all rows meet which a range, widened by these durations, can need.

        They cut nothing off: the exact condition stands beside them. Unlike it, they reach the scan.
        """
        if not key.date_range:
            return []
        try:
            low, high = (datetime.date.fromisoformat(str(d)[:10]) for d in key.date_range)
            low, high = widened(low, back, -1), widened(high, on, 1)
        except (ValueError, OverflowError):
            return []
        bare = Relation(self.engine, rel.root).column_sql(key.path, key.name)
        return [F.expr(f"{bare} >= '{low}'"), F.expr(f"{bare} <= '{high}'")]

    def new(self, prefix: str) -> str:
        self.counter += 1
        return f"{prefix}{self.counter}"

    def _relation(self, shift: tuple[Key, int, str] | None) -> Relation:
        if not shift:
            return Relation(self.engine, self.model)
        key, n, unit = shift
        return Relation(self.engine, self.model, (key.path, key.name), lambda sql: moved_sql(sql, n, unit))

    def _moved_reach(self, rel: Relation, shift: tuple[Key, int, str] | None) -> list[Column]:
        """The range of a shifted time column in terms of the column itself."""
        if not shift:
            return []
        key, n, unit = shift
        moved = [(abs(n), unit)]
        return self._reach(rel, key, moved if n > 0 else [(-abs(n), unit)], moved if n < 0 else [(-abs(n), unit)])

    def _ranges(self) -> list:
        return [(k.path, k.name, k.date_range) for k in self.times if k.date_range]

    def _key_sql(self, rel: Relation, k: Key) -> str:
        sql = rel.column_sql(k.path, k.name)
        return bucket_sql(k.granularity, sql) if k.granularity else sql

    def _apart(self, a: Agg) -> bool:
        if dict(a.kwargs).get("window"):
            return True
        path, name = self.locate(a.path)
        if path or a.name in QUANTILES:
            return True
        column = self.model.column(name)
        if not column or not column.filter:
            return False
        rel = Relation(self.engine, self.model)
        rel.expand((), column.filter)
        return bool(rel.paths)

    def _agg(self, rel: Relation, a: Agg, as_filter: bool = False) -> Column:
        path, name = self.locate(a.path, rel.root)
        time = None
        if a.name in ("first", "last"):
            model = rel.model_at(path)
            at = self.time_column(a.args[0] if a.args else None, model if path else rel.root, path)
            time = rel.column_sql(*at) if at else None
            if rel.root is not self.model and at is None and rel.root.default_time_dimension:
                time = rel.column_sql(*self.locate(rel.root.default_time_dimension, rel.root))
        kwargs = {k: v for k, v in a.kwargs if k != "window"}
        args = () if a.name in ("first", "last") else a.args
        return agg_column(rel, path, name, a.name, args, kwargs, time, as_filter, self.ranks)

    def _join_apart(self, base: DataFrame, a: Agg, out: str, shift) -> DataFrame:
        path, name = self.locate(a.path)
        if dict(a.kwargs).get("window"):
            return self._trailing(base, a, out, shift)
        if path:
            return self._cross(base, a, path, name, out, shift)
        if a.name in QUANTILES:
            return self._quantile(base, a, name, out, shift)
        # A filter that reaches another model is this aggregate's WHERE; its joins are no one else's.
        rel = self._relation(shift)
        keys = [(k.id, self._key_sql(rel, k)) for k in self.keys]
        conditions = self.filtered(rel, self.where, self._ranges()) + self._moved_reach(rel, shift)
        conditions.append(F.expr(rel.expand((), self.model.column(name).filter)))
        column = self._agg(rel, a, as_filter=True)
        df = rel.frame()
        for c in conditions:
            df = df.filter(c)
        return self._attach(base, grouped(df, keys, [(out, column)]), [k.id for k in self.keys], out)

    def _attach(self, base: DataFrame, part: DataFrame, ids: list[str], out: str) -> DataFrame:
        if not ids:
            return base.crossJoin(part.select(out))  # one row
        named = part.select(*[F.col(i).alias(f"_{i}") for i in ids], out)
        on = [F.col(i).eqNullSafe(F.col(f"_{i}")) for i in ids]  # a group without a value is a group too
        return base.join(named, on, "left").drop(*[f"_{i}" for i in ids])

    def _trailing(self, base: DataFrame, a: Agg, out: str, shift) -> DataFrame:
        if a.name not in ("sum", "avg"):
            raise NotAllowed("only sum and avg have a window")
        key = self.time_key("a trailing window")
        rel = self._relation(shift)
        path, name = self.locate(a.path)
        keys = [(k.id, self._key_sql(rel, k)) for k in self.keys if k is not key]
        time = rel.column_sql(key.path, key.name)
        # Filters on the rows hold; the range of the window's own time dimension doesn't, as the window reaches back before it.
        ranges = [r for r in self._ranges() if (r[0], r[1]) != (key.path, key.name)]
        conditions = self.filtered(rel, self.where, ranges)
        window, one = duration(dict(a.kwargs)["window"]), [(1, key.granularity)]
        moved = [(shift[1], shift[2])] if shift else []
        conditions += self._reach(rel, key, [*moved, *window, *one], [*((-n, u) for n, u in moved), *one])
        self._agg(rel, Agg(a.path, a.name))  # the rules hold here too
        column = rel.model_at(path).column(name)
        value = rel.column_sql(path, name)
        if column and column.filter:
            value = f"CASE WHEN {rel.expand(path, column.filter)} THEN {value} END"
        df = rel.frame()
        for c in conditions:
            df = df.filter(c)
        rows = df.select(*[F.expr(s).alias(i) for i, s in keys], F.expr(time).alias("_time"), F.expr(value).alias("_value"))
        ids = [k.id for k in self.keys]
        part = trailing(rows, base.select(*ids).distinct(), ids, key.id, key.granularity, dict(a.kwargs)["window"], a.name, out)
        return self._attach(base, part, ids, out)

    def _quantile(self, base: DataFrame, a: Agg, name: str, out: str, shift) -> DataFrame:
        rel = self._relation(shift)
        keys = [(k.id, self._key_sql(rel, k)) for k in self.keys]
        conditions = self.filtered(rel, self.where, self._ranges()) + self._moved_reach(rel, shift)
        self._agg(rel, a)  # the rules hold here too
        column, value = self.model.column(name), rel.column_sql((), name)
        if column and column.filter:
            value = f"CASE WHEN {rel.expand((), column.filter)} THEN {value} END"
        df = rel.frame()
        for c in conditions:
            df = df.filter(c)
        rows = df.select(*[F.expr(s).alias(i) for i, s in keys], F.expr(value).alias("_value"))
        p = 0.5 if a.name == "median" else float(dict(a.kwargs).get("p", a.args[0] if a.args else 0.5))
        ids = [k.id for k in self.keys]
        return self._attach(base, quantile(rows, ids, p, out), ids, out)

    def _cross(self, base: DataFrame, a: Agg, path: Path, name: str, out: str, shift) -> DataFrame:
        """A measure of a joined model: aggregated from that model's rows by the keys reachable from there."""
        target = self.engine.model_at(self.model, path)
        moved, move = None, None
        if shift:
            key, n, unit = shift
            there = self._from_target(key.path, key.name, path, target)
            moved, move = there, lambda sql: moved_sql(sql, n, unit)
        rel = Relation(self.engine, target, moved, move)
        keys, ids = [], []
        for k in self.keys:
            there = self._from_target(k.path, k.name, path, target)
            if there is not None:
                sql = rel.column_sql(*there)
                keys.append((k.id, bucket_sql(k.granularity, sql) if k.granularity else sql))
                ids.append(k.id)
        conditions = []
        for node in [*self.where, *[self.bind(dsl.parse(f)) for f in self.model.filters if _is_formula(f)]]:
            refs = {n.path for n in dsl.walk(node) if isinstance(n, Ref)}
            places = {}
            for r in refs:
                try:
                    places[r] = self._from_target(*self.locate(r), path, target)
                except CadenzaError:
                    places[r] = None
            if all(places.values()):
                moved_node = dsl.rewrite(node, lambda n, p=places: Ref(".".join([*p[n.path][0], p[n.path][1]])) if isinstance(n, Ref) else n)
                conditions.append(self.row_column(rel, moved_node))
        for p, n, (low, high) in self._ranges():
            there = self._from_target(p, n, path, target)
            if there is not None:
                conditions.append(F.expr(f"{rel.column_sql(*there)} BETWEEN '{_plain(low)}' AND '{_plain(high)}'"))
        column = self._agg(rel, Agg(name, a.name, a.args, a.kwargs))
        df = rel.frame()
        for c in conditions:
            df = df.filter(c)
        return self._attach(base, grouped(df, keys, [(out, column)]), ids, out)

    def _from_target(self, path: Path, name: str, to: Path, target: Model) -> tuple[Path, str] | None:
        """Where the target model has this column: below it, or by its own joins."""
        if path[: len(to)] == to:
            return path[len(to) :], name
        wanted = self.engine.model_at(self.model, path).name
        if wanted == target.name:
            return None  # the same model by another path is another row
        found = self.engine.join_path(target.name, wanted)
        if found is None:
            return None
        return found, name

    # -- the query -----------------------------------------------------------

    def evaluate(self, grid: Grid, node) -> Column:
        """A formula over the grid; transforms become columns of it."""
        if isinstance(node, Agg):
            return F.col(grid.values[node])
        if isinstance(node, Ref):
            key = self._key_of(node.path)
            if not key:
                raise UnknownName(f"{node.path} is neither a dimension nor a measure of the query")
            return F.col(key.id)
        if isinstance(node, Call) and node.name in dsl.TRANSFORMS:
            if node not in grid.hidden:
                grid.hidden[node] = self.transform(grid, node)
            return F.col(grid.hidden[node])
        return self._combine(node, lambda n: self.evaluate(grid, n))

    def _hide(self, grid: Grid, column: Column) -> str:
        name = self.new("h")
        grid.df = grid.df.withColumn(name, column)
        return name

    def transform(self, grid: Grid, node: Call) -> str:
        name, kwargs = node.name, dict(node.kwargs)
        if not node.args:
            raise CadenzaError(f"{name} needs an argument")
        dims = [k.id for k in self.dims]
        extra = [a.value if isinstance(a, Lit) else getattr(a, "path", None) for a in node.args[1:]]
        if name in RANK_NAMES:
            by = kwargs.get("partition_by", ())
            parts = []
            for p in (by,) if isinstance(by, str) else by:
                key = self._key_of(p)
                if not key:
                    raise CadenzaError(f"partition_by={p}: no dimension of the query")
                parts.append(key.id)
            value = self._hide(grid, self.evaluate(grid, node.args[0]))
            out = self.new("h")
            grid.df = ranked(grid.df, name, value, parts, [k.id for k in self.keys], kwargs.get("n", extra[0] if extra else None), out)
            return out
        key = self.time_key(name)
        if name in ("change", "change_pct"):
            off = kwargs.get("periods", extra[0] if extra else -1)
            unit = kwargs.get("granularity", extra[1] if len(extra) > 1 else None)
            shifted = Call("time_shift", (node.args[0], Lit(off), *([Lit(unit)] if unit else [])))
            x, y = self.evaluate(grid, node.args[0]), self.evaluate(grid, shifted)
            if name == "change":
                return self._hide(grid, x - y)
            return self._hide(grid, F.when(y != 0, F.try_divide((x - y).cast("double"), y.cast("double"))))
        if name == "time_shift":
            n = kwargs.get("periods", extra[0] if extra else 1)
            unit = kwargs.get("granularity", extra[1] if len(extra) > 1 else None) or key.granularity
            if not isinstance(n, int):
                raise CadenzaError("time_shift takes a whole number of periods")
            return self._shift(grid, node.args[0], key, n, unit)
        if name == "consecutive_periods":
            arg = self.evaluate(grid, node.args[0])
            held = self._hide(grid, arg)
            logical = dict(grid.df.dtypes)[held] == "boolean"
            flag = F.col(held) if logical else F.col(held).isNotNull() & (F.col(held) != 0)
            flag = F.coalesce(flag, F.lit(False))
            group = self._hide(grid, streak_parts(flag, dims, key.id)[0])
            return self._hide(grid, streak(flag, group, dims, key.id))
        n = kwargs.get("n", extra[0] if extra else 1)
        value = self._hide(grid, self.evaluate(grid, node.args[0]))
        return self._hide(grid, window_transform(name, F.col(value), dims, key.id, n))

    def _shift(self, grid: Grid, inner, key: Key, n: int, unit: str) -> str:
        """The formula's value n periods on, beside each row."""
        filters_time = key.date_range or any(
            isinstance(x, Ref) and self.locate(x.path) == (key.path, key.name) for node in self.where for x in dsl.walk(node)
        )
        windows = dsl.has_transform(inner)
        if windows or (grid.bare and not filters_time and aligned(key.granularity, unit) and not any(dict(a.kwargs).get("window") for a in dsl.aggregates(inner))):
            # The grid's own rows, a bucket further: whole buckets move to whole buckets.
            column = self.evaluate(grid, inner)
            other = grid.df.select(*[self._moved_key(k, key, n, unit) for k in self.keys], column.alias("_value"))
        else:
            moved = self.grid(dsl.aggregates(inner), (key, -n, unit))
            column = self.evaluate(moved, inner)
            other = moved.df.select(*[F.col(k.id).alias(f"_{k.id}") for k in self.keys], column.alias("_value"))
        name = self.new("h")
        # A group without a value is a group too; a row without a time has no other period.
        on = [F.col(k.id) == F.col(f"_{k.id}") if k is key else F.col(k.id).eqNullSafe(F.col(f"_{k.id}")) for k in self.keys]
        grid.df = grid.df.join(other.withColumnRenamed("_value", name), on, "left").drop(*[f"_{k.id}" for k in self.keys])
        return name

    def _moved_key(self, k: Key, key: Key, n: int, unit: str) -> Column:
        return F.expr(moved_sql(f"`{k.id}`", -n, unit)).alias(f"_{k.id}") if k is key else F.col(k.id).alias(f"_{k.id}")

    def plan(self) -> Planned:
        q = self.query
        if not q.distinct_dimension_values:
            return self._raw()
        if not self.keys and not self.measures:
            raise CadenzaError("a query needs measures or dimensions")
        orders = [(self._order_node(o.column), o) for o in q.order]
        nodes = [n for _, n in self.measures] + self.having + self.post + [n for n, _ in orders if not isinstance(n, str)]
        aggs = [a for n in nodes for a in dsl.aggregates(n)]
        self.ranks = any(isinstance(c, Call) and c.name in RANK_NAMES for n in nodes for c in dsl.walk(n))
        grid = self.grid(aggs)
        for node in self.having:
            grid.df = grid.df.filter(self.evaluate(grid, node))
            grid.bare = False
        outputs = []
        for m, node in self.measures:
            column = self.evaluate(grid, node)
            outputs.append((self._public(m, node), column.cast(SQL_TYPES[m.type]) if m.type else column, m, node))
        names = [k.public for k in self.keys] + [o[0] for o in outputs]
        if twice := {n for n in names if names.count(n) > 1}:
            raise CadenzaError(f"{', '.join(sorted(twice))} would be there twice")
        conditions = [self.evaluate(grid, node) for node in self.post]
        sorts = [(self._sort(grid, node), o) for node, o in orders]
        held = [(p, self._hide(grid, c)) for p, c, _, _ in outputs]
        for c in conditions:
            grid.df = grid.df.filter(c)
        df = self._cut(grid.df, [(c, o.direction) for c, o in sorts])
        df = df.select(*[F.col(k.id).alias(k.public) for k in self.keys], *[F.col(h).alias(p) for p, h in held])
        columns = [{"name": k.public, "label": k.label, "role": "time" if k.granularity else "dimension", "granularity": k.granularity} for k in self.keys]
        columns += [{"name": p, "label": m.label, "role": "measure", "formula": m.formula, "node": n} for p, _, m, n in outputs]
        flat = frozenset(p.split(".", 1)[1].replace(".", "__") for p, _, _, _ in outputs)
        return Planned(df, columns, flat)

    def _public(self, m: Measure, node) -> str:
        hops = node.path.split(".")[:-1] if isinstance(node, Agg) else []
        if isinstance(node, Agg) and self.model.frame is None:
            hops = list(self.locate(node.path)[0])
        return ".".join([self.model.name, *hops, self._leaf(m, node)])

    def _order_node(self, text: str):
        name = self.strip(text)
        for k in self.keys:
            if name in (k.name, ".".join([*k.path, k.name]), k.public):
                return k.id
        for m, node in self.measures:
            leaf = self._leaf(m, node)
            if name in (leaf, self._public(m, node), self.strip(self._public(m, node)), m.formula) or (name == "count" and leaf == "_count"):
                return node
        node = self.bind(dsl.rewrite(dsl.parse(text), lambda n: self.names.get(self.strip(n.path), n) if isinstance(n, Ref) else n))
        if isinstance(node, Ref):
            path, _ = self.locate(node.path)
            raise NotAllowed(f"can't order by {text}: it is not in the query")
        return node

    def _sort(self, grid: Grid, node) -> Column:
        return F.col(node) if isinstance(node, str) else F.col(self._hide(grid, self.evaluate(grid, node)))

    def _cut(self, df: DataFrame, sorts: list[tuple[Column, str]]) -> DataFrame:
        if sorts:
            df = df.orderBy(*[c.desc_nulls_last() if d == "desc" else c.asc_nulls_last() for c, d in sorts])
        if self.query.offset:
            df = df.offset(self.query.offset)
        return df.limit(self.query.limit) if self.query.limit is not None else df

    def _raw(self) -> Planned:
        """Rows as they are, without grouping."""
        if self.measures or self.having or self.post or any(not isinstance(self._order_or_row(o.column), str) for o in self.query.order):
            raise NotAllowed("raw rows have no measures")
        rel = self._relation(None)
        keys = [(k, self._key_sql(rel, k)) for k in self.keys]
        conditions = self.filtered(rel, self.where, self._ranges())
        sorts = []
        for o in self.query.order:
            path, name = self.locate(self._order_or_row(o.column))
            sorts.append((F.expr(rel.column_sql(path, name)), o.direction))
        df = rel.frame()
        for c in conditions:
            df = df.filter(c)
        df = self._cut(df, sorts).select(*[F.expr(s).alias(k.public) for k, s in keys])
        return Planned(df, [{"name": k.public, "label": k.label, "role": "dimension", "granularity": k.granularity} for k in self.keys], frozenset())

    def _order_or_row(self, text: str):
        node = dsl.parse(text)
        return self.strip(node.path) if isinstance(node, Ref) else node


def _plain(text: str) -> str:
    return str(text).replace("'", "''")


def _is_formula(text: str) -> bool:
    """Whether a model's SQL filter can also be read as a filter of the language."""
    try:
        dsl.parse(text)
        return True
    except CadenzaError:
        return False


__all__ = ["JoinPathError", "Planner", "fill_variables", "leaf_name", "mangled"]
