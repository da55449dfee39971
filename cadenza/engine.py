"""The engine: a registry of models over tables, and the execution of queries."""

from __future__ import annotations

import copy
import datetime
import re
from collections import deque
from collections.abc import Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dsl
from .cache import CacheConfig, ResultCache
from .errors import CadenzaError, JoinPathError, PolicyError, SchemaDrift, UnknownName
from .functions.display import format_of, formatted
from .operators.aggregate import type_of_spark
from .operators.relation import Relation, sql_names
from .plans.planner import Planned, Planner
from .security import Policy
from .semantics import Column, Extension, Join, Measure, Model, Query
from .sources import drift, ingest, profiling, recommend
from .sources.catalog import Tables


@dataclass
class Response:
    """A result: the DataFrame, and what its columns are."""

    df: DataFrame
    columns: list[dict]
    plan: str | None = None

    def rows(self) -> list[dict]:
        return [r.asDict() for r in self.df.collect()]

    def markdown(self) -> str:
        names = [c["name"] for c in self.columns]
        lines = ["| " + " | ".join(c.get("label") or c["name"] for c in self.columns) + " |", "|" + " --- |" * len(names)]
        for row in self.df.collect():
            lines.append("| " + " | ".join(formatted(row[n], c.get("format")) for n, c in zip(names, self.columns, strict=True)) + " |")
        return "\n".join(lines)


class Engine:
    def __init__(
        self,
        spark: SparkSession,
        tables: dict[str, Any] | str | None = None,
        models: Sequence[Model | dict] = (),
        policy: Policy | None = None,
        today: datetime.date | None = None,
    ):
        self.spark, self.policy, self._today = spark, policy, today
        self.tables = tables if isinstance(tables, Tables) else Tables(spark, tables)
        self.models: dict[str, Model] = {}
        self.saved: dict[str, tuple[Query, ...]] = {}
        self.cache = ResultCache()
        self._scans: dict[str, DataFrame] = {}
        self._compiling: tuple[str, ...] = ()
        for m in models:
            self.add(m)

    def today(self) -> datetime.date:
        return self._today or datetime.date.today()

    # -- registry ------------------------------------------------------------

    def add(self, model: Model | dict) -> Model:
        """Registers a model; its derived columns may not go in circles, and inner joins hold both ways."""
        model = Model.of(model)
        self.models[model.name] = model
        self._scans.pop(model.name, None)
        _check_columns(model)
        for join in model.joins:
            if join.join_type == "inner":
                self._mirror(model, join)
        for other in list(self.models.values()):
            for join in other.joins:
                if join.target_model == model.name and join.join_type == "inner":
                    self._mirror(other, join)
        return self.models[model.name]

    def _mirror(self, model: Model, join: Join) -> None:
        target = self.models.get(join.target_model)
        if target and not target.join(model.name):
            back = Join(model.name, tuple((b, a) for a, b in join.join_pairs), "inner")
            self.models[target.name] = replace(target, joins=(*target.joins, back))

    def model(self, name: str) -> Model:
        if name not in self.models:
            raise UnknownName(f"no model {name!r}")
        return self.models[name]

    def model_at(self, root: Model, path: tuple[str, ...]) -> Model:
        model, seen = root, {root.name}
        for hop in path:
            if not model.join(hop):
                raise JoinPathError(f"model {model.name} has no join to {hop}")
            if hop in seen:
                raise JoinPathError(f"the path {'.'.join(path)} comes back to {hop}")
            seen.add(hop)
            model = self.model(hop)
        return model

    def join_path(self, source: str, target: str) -> tuple[str, ...] | None:
        """The shortest path of joins; of several the first in alphabetical order."""
        queue, seen = deque([(source, ())]), {source}
        while queue:
            name, path = queue.popleft()
            if name == target:
                return path
            for join in sorted(self.model(name).joins, key=lambda j: j.target_model) if name in self.models else ():
                if join.target_model not in seen and join.target_model in self.models:
                    seen.add(join.target_model)
                    queue.append((join.target_model, (*path, join.target_model)))
        return None

    # -- scans ---------------------------------------------------------------

    def read_table(self, name: str) -> DataFrame:
        """A table as the policy shows it. All rows of all queries come from here."""
        df = self.tables.read(name)
        return self.policy.apply(name.rsplit(".", 1)[-1], df, self.tables.read) if self.policy else df

    def scan(self, model: Model) -> DataFrame:
        if model.frame is not None:
            return model.frame
        if self.models.get(model.name) is not model:
            return self._scan(model)
        if model.name not in self._scans:
            self._scans[model.name] = self._scan(model)
        return self._scans[model.name]

    def _scan(self, model: Model) -> DataFrame:
        if model.sql_table is not None:
            return self.read_table(model.sql_table)
        if model.sql is not None:
            return self._sql(model.sql)
        if model.name in self._compiling:
            raise CadenzaError(f"model {model.name} is its own source")
        inner = copy.copy(self)
        inner._compiling, inner._scans, inner.models = (*self._compiling, model.name), {}, dict(self.models)
        stages = [Query.of(q) for q in model.source_queries]
        planned, last = inner._compile_list(stages, dict(model.query_variables), prior_only=True)
        return _stage_frame(planned, last)

    def _sql(self, text: str) -> DataFrame:
        """A SQL text over the tables, each as the policy shows it."""
        tokens = sql_names(text)
        flat = [(k, v) for k, v, _ in tokens if v.strip()]
        ctes = {v.strip("`\"").lower() for i, (k, v) in enumerate(flat[:-2]) if k in ("name", "quoted", "inner") and flat[i + 1][1].lower() == "as" and flat[i + 2][1] == "("}
        if not flat or flat[0][1].lower() not in ("select", "with", "("):
            raise PolicyError("only SELECT is admitted as a source")
        frames, out, before, in_from = {}, [], "", False
        for kind, value, _ in tokens:
            low = value.lower()
            if kind in ("name", "inner", "quoted"):
                name = re.sub(r'[`"\s]', "", value)
                if low in ("from", "join"):
                    in_from = True
                elif low in ("where", "group", "order", "having", "on", "select", "union", "limit", "using"):
                    in_from = False
                elif before in ("from", "join") or (before == "," and in_from):
                    if name.lower() not in ctes:
                        key = "t_" + re.sub(r"\W", "_", name)
                        try:
                            frames[key] = self.read_table(name)
                            value = "{" + key + "}"
                        except UnknownName:
                            if self.policy:
                                raise
            else:
                value = value.replace("{", "{{").replace("}", "}}")
            out.append(value)
            before = low if value.strip() else before
        return self.spark.sql("".join(out), **frames)

    def physical_columns(self, model: Model) -> list[str]:
        return self.scan(model).columns

    def column_type(self, model: Model, name: str) -> str:
        """One of the six types: as declared, or as Spark finds it. No job runs."""
        column = model.column(name)
        if column and column.type:
            return column.type
        rel = Relation(self, model)
        sql = rel.column_sql((), name)
        return type_of_spark(rel.frame().select(F.expr(sql).alias("x")).dtypes[0][1])

    def get_column_types(self, name: str) -> dict[str, str]:
        model = self.model(name)
        names = [c.name for c in model.columns] or self.physical_columns(model)
        return {n: self.column_type(model, n) for n in names}

    # -- queries -------------------------------------------------------------

    def _source(self, source: Any, stages: dict[str, Model]) -> Model:
        if isinstance(source, str):
            return stages.get(source) or self.model(source)
        if isinstance(source, dict) and "source_name" in source:
            source = Extension(**source)
        if isinstance(source, Extension):
            base = stages.get(source.source_name) or self.model(source.source_name)
            made = Model(base.name, frame=0, columns=source.columns, measures=source.measures, joins=source.joins)
            own = {c.name for c in made.columns}
            merged = replace(
                base,
                columns=tuple(c for c in base.columns if c.name not in own) + made.columns,
                measures=tuple(m for m in base.measures if m.name not in {x.name for x in made.measures}) + made.measures,
                joins=tuple(j for j in base.joins if j.target_model not in {x.target_model for x in made.joins}) + made.joins,
            )
            _check_columns(merged)
            return merged
        model = Model.of(source)
        _check_columns(model)
        return model

    def _plan(self, query: Query, stages: dict[str, Model], variables: dict) -> Planned:
        view = copy.copy(self)
        view._scans = self._scans
        view.models = {**self.models, **stages}
        model = view._source(query.source_model, stages)
        if view.models.get(model.name) is not model and model.name in view.models:
            view.models[model.name] = model
            view._scans = {k: v for k, v in self._scans.items() if k != model.name}
        known = {**model.query_variables, **query.variables, **variables}
        known = _Placeholders(known) if isinstance(variables, _Placeholders) else known
        return Planner(view, query, model, known).plan()

    def _compile_list(self, queries: Sequence[Query], variables: dict, prior_only: bool = False) -> tuple[Planned, Query]:
        """A list of queries as a graph: the last is the result, others are its stages in any order."""
        names = [q.name for q in queries]
        root = queries[-1]
        if len(queries) > 1 and any(n is None for n in names[:-1]):
            raise CadenzaError("stages need names")
        if len(set(names)) != len(names):
            raise CadenzaError("stage names have to differ")
        by_name = {q.name: q for q in queries[:-1]}
        order = {n: i for i, n in enumerate(names)}
        built: dict[str, Model] = {}

        def build(q: Query, at: tuple[str, ...]) -> Planned:
            needed = [n for n in _mentioned(q, self) if n in by_name or n == root.name]
            for n in needed:
                if n == q.name or n == root.name or n in at:
                    raise CadenzaError(f"stage {q.name or 'at the end'} depends on itself by {n}")
                if prior_only and order[n] > order[q.name]:
                    raise CadenzaError(f"stage {q.name} refers to the later stage {n}")
                if n not in built:
                    stage = by_name[n]
                    built[n] = self._stage_model(n, build(stage, (*at, q.name)), stage, built)
            return self._plan(q, built, variables)

        return build(root, ()), root

    def _stage_model(self, name: str, planned: Planned, query: Query, stages: dict[str, Model]) -> Model:
        frame = _stage_frame(planned, query)
        source = self._source(query.source_model, stages)
        columns = tuple(Column(c, type=type_of_spark(t)) for c, t in frame.dtypes)
        default = source.default_time_dimension if source.default_time_dimension in frame.columns else None
        if default is None:
            times = [c["name"].split(".", 1)[1].replace(".", "__") for c in planned.columns if c["role"] == "time"]
            default = times[0] if times else None
        return Model(name, frame=frame, columns=columns, default_time_dimension=default, aggregated=planned.aggregated, origins=(source.name, *source.origins))

    def execute(
        self, query: Query | dict | list | str, variables: dict | None = None, cache: CacheConfig | bool | None = None, explain: bool = False, **more
    ) -> Response:
        """Plans a query, a graph of queries, or a saved one by its name. Nothing runs until rows are asked for."""
        try:
            planned = self._planned(query, variables or {}, more)
        except (AnalysisException, UnknownName) as e:
            if found := drift.validate(self):
                raise SchemaDrift(f"{e}; the models no longer fit the tables", found) from e
            raise
        df = planned.df
        if cache:
            df = self.cache.get(df, cache if isinstance(cache, CacheConfig) else CacheConfig(), self.read_table)
        columns = [{k: v for k, v in c.items() if k != "node" and v is not None} | {"format": format_of(c)} for c in planned.columns]
        plan = df._jdf.queryExecution().toString() if explain else None
        return Response(df, columns, plan)

    def _planned(self, query, variables: dict, more: dict) -> Planned:
        if isinstance(query, str):
            if query in self.saved:
                return self._compile_list(self.saved[query], variables)[0]
            model = self.model(query)
            if model.source_queries:
                return self._compile_list([Query.of(q) for q in model.source_queries], {**model.query_variables, **variables}, True)[0]
            if more:
                return self._planned({"source_model": query, **more}, variables, {})
            raise UnknownName(f"{query} is no saved query")
        queries = query if isinstance(query, (list, tuple)) else [query]
        return self._compile_list([Query.of(q) for q in queries], variables)[0]

    def dry_run(self, query: Query | dict | list | str, variables: dict | None = None) -> dict:
        """What a query would give: its columns with their types, and the plan. Nothing runs."""
        made = self.execute(query, variables, explain=True)
        kinds = dict(made.df.dtypes)
        return {"columns": [{**c, "type": kinds[c["name"]]} for c in made.columns], "plan": made.plan}

    def sql_text(self, query, variables: dict | None = None) -> str:
        """The optimised plan, without running it."""
        return self.execute(query, variables, explain=True).plan

    def save_query(self, name: str, query: Query | dict | list, variables: dict | None = None) -> None:
        """Saves a query by name, after planning it with '0' for variables that have no value yet."""
        queries = tuple(Query.of(q) for q in (query if isinstance(query, (list, tuple)) else [query]))
        self._compile_list(queries, _Placeholders(variables or {}))
        self.saved[name] = queries

    def create_model_from_query(self, name: str, query: Query | dict | list, variables: dict | None = None) -> Model:
        """A model whose rows are a query's."""
        queries = tuple(Query.of(q) for q in (query if isinstance(query, (list, tuple)) else [query]))
        planned, root = self._compile_list(queries, _Placeholders(variables or {}), prior_only=True)
        stage = self._stage_model(name, planned, root, {})
        model = Model(name, source_queries=queries, columns=stage.columns, query_variables=dict(variables or {}), default_time_dimension=stage.default_time_dimension, aggregated=stage.aggregated, origins=stage.origins)
        return self.add(model)

    save_model = add

    def evict(self, query=None) -> int:
        return self.cache.evict(self.execute(query).df if query is not None else None)

    def refresh(self) -> int:
        return self.cache.refresh(self.read_table)

    # -- catalog -------------------------------------------------------------

    def ingest(self, include: Sequence[str] | None = None, exclude: Sequence[str] = (), joins: dict | None = None) -> ingest.Report:
        return ingest.ingest(self, include, exclude, joins)

    def validate_models(self) -> list[drift.Drift]:
        return drift.validate(self)

    def apply_drift_deletes(self, found: list[drift.Drift]) -> None:
        drift.apply(self, found)

    def profile(self, model: str, columns: Sequence[str] | None = None) -> DataFrame:
        return profiling.profile(self, self.model(model), columns)

    def recommend_root(self, items: Sequence[str], hint: str | None = None) -> recommend.Recommendation:
        return recommend.recommend(self, items, hint)

    def search(self, question: str, **more) -> DataFrame:
        """Entities and notes that fit a question; see `notes.search`."""
        from .notes import search

        return search(self, question, **more)

    def inspect(self, name: str, samples: int = 5) -> dict:
        """All about one entity, `model` or `model.part`: definitions, reachable joins, and the values a column has most."""
        head, _, part = name.partition(".")
        m = self.model(head)
        if not part:
            return {
                "id": head, "kind": "Model", "label": m.label, "description": m.description, "meta": m.meta, "source": m.sql_table or m.sql or "saved queries",
                "columns": {c: t for c, t in self.get_column_types(head).items()}, "measures": {x.name: x.formula for x in m.measures},
                "joins": {other: list(path) for other in sorted(self.models) if other != head and (path := self.join_path(head, other))},
            }
        if column := m.column(part):
            kind = self.column_type(m, part)
            from .functions.names import BY_TYPE, COUNTS

            allowed = column.allowed_aggregations if column.allowed_aggregations is not None else sorted(COUNTS if column.primary_key else BY_TYPE[kind])
            asked = {"source_model": head, "dimensions": [part], "measures": ["*:count"], "order": [{"column": "*:count", "direction": "desc"}], "limit": samples}
            values = [r[0] for r in self.execute(asked).df.collect()]
            return {"id": name, "kind": "ModelColumn", "label": column.label, "description": column.description, "meta": column.meta, "type": kind, "sql": column.sql, "aggregations": list(allowed), "values": values}
        if measure := m.measure(part):
            uses = sorted({a.path for a in dsl.aggregates(dsl.parse(measure.formula))})
            return {"id": name, "kind": "Measure", "label": measure.label, "description": measure.description, "meta": measure.meta, "formula": measure.formula, "uses": uses}
        if made := m.aggregation(part):
            return {"id": name, "kind": "Aggregation", "formula": made.formula, "params": made.params}
        raise UnknownName(f"model {head} has no {part!r}")

    def describe(self, name: str) -> str:
        """A model on one page."""
        m = self.model(name)
        source = m.sql_table or m.sql or "saved queries"
        lines = [f"# {name}", m.description or "", f"source: {source}", "", "| column | type | sql |", "| --- | --- | --- |"]
        lines += [f"| {c.name} | {self.column_type(m, c.name)} | {c.sql or ''} |" for c in m.columns]
        lines += [f"- measure {x.name} = {x.formula}" for x in m.measures]
        lines += [f"- {j.join_type} join {j.target_model} on {', '.join(f'{a} = {b}' for a, b in j.join_pairs)}" for j in m.joins]
        return "\n".join(lines)


class _Placeholders(dict):
    """'0' for any variable without a value."""

    def __contains__(self, key) -> bool:
        return True

    def __missing__(self, key) -> str:
        return "0"


def _stage_frame(planned: Planned, query: Query) -> DataFrame:
    """The rows with flat names: the source's prefix off, other dots as __."""
    names = planned.df.columns
    return planned.df.toDF(*[n.split(".", 1)[1].replace(".", "__") if "." in n else n for n in names])


def _mentioned(query: Query, engine: Engine) -> list[str]:
    """Names of stages that a query may refer to: its source, and targets of joins."""
    source = query.source_model
    out = []
    if isinstance(source, str):
        out.append(source)
        joins = engine.models[source].joins if source in engine.models else ()
    elif isinstance(source, dict):
        out.append(source.get("source_name"))
        joins = source.get("joins", ())
    else:
        out.append(getattr(source, "source_name", None))
        joins = source.joins
    out += [j["target_model"] if isinstance(j, dict) else j.target_model for j in joins]
    return [n for n in out if n]


def _check_columns(model: Model) -> None:
    """Derived columns may not go in circles."""
    uses = {c.name: {v for k, v, called in sql_names(c.sql) if k == "name" and not called and v != c.name and model.column(v)} for c in model.columns if c.sql}

    def visit(name: str, at: tuple[str, ...]) -> None:
        if name in at:
            raise CadenzaError(f"columns of {model.name} go in a circle: {' -> '.join([*at, name])}")
        for other in uses.get(name, ()):
            visit(other, (*at, name))

    for name in uses:
        visit(name, ())


__all__ = ["CacheConfig", "Engine", "Measure", "Model", "Policy", "Query", "Response"]
