"""dbt semantic models and metrics as models.

Measures become a column and an aggregation over it; metrics become formulas on the model their measures belong to. Filters
of metrics go down to the columns that are aggregated. A metric over several models is put on the one that reaches them.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from typing import Any

from ..functions.calendar import GRANULARITIES
from .imports import IDENTIFIER, CannotSay, Draft, Imported, Issue, anchor, documents, finish, told, ways

# The aggregations of the format, and its types of columns.
_TYPES = {
    "varchar": "TEXT", "text": "TEXT", "string": "TEXT", "char": "TEXT", "int": "INT", "integer": "INT", "bigint": "INT", "smallint": "INT", "double": "DOUBLE", "float": "DOUBLE",
    "numeric": "DOUBLE", "decimal": "DOUBLE", "real": "DOUBLE", "boolean": "BOOLEAN", "bool": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP", "datetime": "TIMESTAMP",
}
_AGGREGATIONS = {
    "sum": "sum", "sum_boolean": "sum", "average": "avg", "avg": "avg", "count": "count", "count_distinct": "count_distinct",
    "count_distinct_approx": "count_distinct_approx", "min": "min", "max": "max", "median": "median", "percentile": "percentile",
}
_RELATION = re.compile(r"(?:ref|source)\(\s*(?:['\"][^'\"]*['\"]\s*,\s*)?['\"]([^'\"]+)['\"][^)]*\)")
_CALL = re.compile(r"\{\{\s*(\w+)\(\s*['\"]([^'\"]+)['\"][^)]*\)\s*\}\}")
_WORD = re.compile(r"'(?:[^']|'')*'|[A-Za-z_]\w*")


def read(path: str) -> Imported:
    """All definitions of a project's folder (or one file)."""
    return convert(documents(path))


def convert(definitions: Iterable[dict]) -> Imported:
    definitions = list(definitions)
    gather = lambda key: [x for d in definitions for x in d.get(key) or ()]
    return _Project(gather("semantic_models"), gather("metrics"), gather("models")).convert()


def _named(value: Any) -> dict:
    return {"name": value} if isinstance(value, str) else dict(value or {})


def _filters(value: Any) -> list[str]:
    """A text, a list of them, or the parsed form with templates."""
    if not value:
        return []
    if isinstance(value, str):
        return [value]
    if isinstance(value, dict):
        return _filters(value.get("where_filters") or value.get("where_sql_template"))
    return [f for v in value for f in _filters(v)]


class _Project:
    def __init__(self, models: list[dict], metrics: list[dict], plain: list[dict] = ()):
        self.plain = plain
        self.sources, self.metrics = {m["name"]: m for m in models}, {m["name"]: m for m in metrics}
        self.drafts: dict[str, Draft] = {}
        self.issues: list[Issue] = []
        self.owners: dict[str, tuple[str, str]] = {}  # entity: model, column
        self.leaves: dict[str, tuple[str, dict]] = {}  # measure: model, definition
        self.names = {*self.metrics, *(m["name"] for s in models for m in s.get("measures") or ())}
        self.failed: dict[str, CannotSay] = {}

    def convert(self) -> Imported:
        for kinds in (("primary",), ("unique", "natural")):
            for m in self.sources.values():
                for e in m.get("entities") or ():
                    if e.get("type") in kinds:
                        self.owners.setdefault(e["name"], (m["name"], str(e.get("expr") or e["name"])))
        for m in self.sources.values():
            self._model(m)
        for m in self.sources.values():
            for measure in m.get("measures") or ():
                self.leaves[measure["name"]] = (m["name"], measure)
        for name, (model, measure) in self.leaves.items():
            self._try(f"{model}.{name}", name, lambda n=name, o=model, d=measure: self.drafts[o].add_measure(n, self._leaf(n, [], o), d))
        done: set[str] = set()
        for name in self.metrics:
            self._metric(name, done, ())
        wrapped = {d.known["sql_table"] for d in self.drafts.values()}
        for m in self.plain:
            if m.get("name") and m["name"] not in wrapped and m["name"] not in self.drafts:
                self._try(m["name"], m["name"], lambda m=m: self._plain(m))
        return finish(self.drafts, self.issues)

    def _try(self, entity: str, name: str, make) -> None:
        try:
            make()
        except CannotSay as e:
            self.failed[name] = e
            self.issues.append(e.issue(entity))

    def _model(self, m: dict) -> None:
        relation = _RELATION.search(str(m.get("model") or ""))
        draft = Draft(name=m["name"], sql_table=relation[1] if relation else str(m.get("model") or m["name"]), **told(m),
                      default_time_dimension=(m.get("defaults") or {}).get("agg_time_dimension"))
        self.drafts[m["name"]] = draft
        for e in m.get("entities") or ():
            column = str(e.get("expr") or e["name"])
            if not IDENTIFIER.match(column):
                draft.columns[e["name"]] = {"name": e["name"], "sql": column}
                column = e["name"]
            known = draft.columns.setdefault(column, {"name": column})
            if e.get("type") in ("primary", "unique"):
                known["primary_key"] = True
            owner = self.owners.get(e["name"])
            if owner and owner[0] != m["name"] and e.get("type") == "foreign":
                draft.join_to(owner[0], [(column, owner[1] if IDENTIFIER.match(owner[1]) else e["name"])])
        for d in m.get("dimensions") or ():
            sql = str(d.get("expr") or d["name"])
            column = {"name": d["name"], "type": "TIMESTAMP" if d.get("type") == "time" else None, **told(d), "sql": None if sql == d["name"] else sql}
            draft.columns[d["name"]] = {**draft.columns.get(d["name"], {}), **{k: v for k, v in column.items() if v is not None}}

    def _plain(self, m: dict) -> None:
        """A model that no semantic model describes: its table with the columns it lists."""
        if not IDENTIFIER.match(m["name"]) or "__" in m["name"]:
            raise CannotSay("name", f"a model can't be called {m['name']!r}", "give it an alias")
        config = m.get("config") or {}
        draft = Draft(name=m["name"], sql_table=str(m.get("alias") or config.get("alias") or m["name"]), **told(m))
        for c in m.get("columns") or ():
            kind = _TYPES.get(re.sub(r"\W.*", "", str(c.get("data_type") or "")).lower())
            rules = {r.get("type") for r in c.get("constraints") or () if isinstance(r, dict)}
            draft.columns[c["name"]] = {"name": c["name"], **({"type": kind} if kind else {}), **({"primary_key": True} if "primary_key" in rules else {}), **told(c)}
        self.drafts[m["name"]] = draft

    def _leaf(self, name: str, filters: list[str], home: str) -> str:
        """A measure as path.column:aggregation, its filters on the column."""
        model, m = self.leaves[name]
        draft, params = self.drafts[model], m.get("agg_params") or {}
        agg = str(m.get("agg") or "").lower()
        if agg not in _AGGREGATIONS:
            raise CannotSay("aggregation", f"{agg!r} has no counterpart", "define a custom aggregation")
        if m.get("non_additive_dimension"):
            raise CannotSay("semi-additive measure", "it isn't summed over one of its dimensions", "balance:last(time), or a query in two stages")
        if params.get("use_discrete_percentile") or params.get("use_approximate_percentile"):
            raise CannotSay("percentile", "only the continuous, exact percentile is offered", "drop the flag")
        if agg == "percentile" and params.get("percentile") is None:
            raise CannotSay("percentile", "it has no percentile")
        prefix = "".join(f"{p}." for p in self._way(home, model))
        sql = str(m.get("expr") if m.get("expr") is not None else name)
        condition = " AND ".join(f"({self._condition(f, model)})" for f in filters) or None
        if agg == "count" and sql in ("1", "*"):
            if condition is None:
                return f"{prefix}*:count"
            sql = "1"
        more = {"filter": condition}
        if agg == "sum_boolean":
            sql, more["type"] = f"CASE WHEN ({sql}) THEN 1 ELSE 0 END", "INT"
        bare = IDENTIFIER.match(sql) and not filters
        known = draft.columns.get(sql)
        if bare and known and known.get("sql") is None:
            column = sql  # also keys, on which counts are allowed
        else:
            column = draft.input_column(sql if bare else f"{name}_col", sql, self.names, **more)
        return f"{prefix}{column}:" + (f"percentile(p={params['percentile']})" if agg == "percentile" else _AGGREGATIONS[agg])

    def _way(self, home: str, model: str) -> tuple[str, ...]:
        reach = ways(self.drafts, home)
        if model not in reach:
            raise CannotSay("unreachable", f"{home} has no joins to {model}", "declare the join")
        return reach[model]

    def _condition(self, text: str, model: str) -> str:
        def plain(call: re.Match) -> str:
            kind, ref = call[1], call[2]
            if kind not in ("Dimension", "TimeDimension", "Entity"):
                raise CannotSay("filter", f"{kind}() can't be filtered by", "filter in a second stage")
            *entities, last = ref.split("__")
            if kind == "Entity":
                own = {e["name"]: str(e.get("expr") or e["name"]) for e in self.sources[model].get("entities") or ()}
                if not entities and last in own:
                    return own[last]
                target, column = self._owner(last)
                return ".".join([*self._way(model, target), column])
            target = self._owner(entities[-1])[0] if entities else model
            if last == "metric_time":
                last = self.drafts[target].known.get("default_time_dimension") or last
            if last not in self.drafts[target].columns:
                raise CannotSay("filter", f"{target} has no dimension {last}")
            return ".".join([*self._way(model, target), last])

        out = _CALL.sub(plain, text.strip())
        if "{{" in out or "{%" in out:
            raise CannotSay("filter", f"the template {text.strip()!r} isn't understood")
        return out

    def _owner(self, entity: str) -> tuple[str, str]:
        if entity not in self.owners:
            raise CannotSay("filter", f"no model has the entity {entity} as its key")
        return self.owners[entity]

    def _metric(self, name: str, done: set[str], at: tuple[str, ...]) -> None:
        """Put a metric, after those it is made of, on its model."""
        if name in done:
            return
        if name in at:
            self._try(name, name, lambda: (_ for _ in ()).throw(CannotSay("metric", f"{name} is defined by itself")))
            done.add(name)
            return
        for part in self._parts(self.metrics[name]):
            if part["name"] in self.metrics and part["name"] != name:
                self._metric(part["name"], done, (*at, name))
        if name not in done:
            done.add(name)
            self._try(name, name, lambda: self._put(name))

    def _put(self, name: str) -> None:
        m = self.metrics[name]
        home = self._home(name)
        formula = self._of_metric(m, [], home)
        if formula == name:  # a metric that only repeats its measure
            return
        self.drafts[home].add_measure(name, formula, m)

    def _parts(self, m: dict) -> list[dict]:
        p = m.get("type_params") or {}
        parts = [p.get("measure"), p.get("numerator"), p.get("denominator"), *(p.get("metrics") or ())]
        return [_named(x) for x in parts if x]

    def _is_leaf(self, m: dict, part: dict) -> bool:
        """Whether the name is of a measure: simple and cumulative metrics refer to measures, others to metrics first."""
        own = part["name"] in self.leaves
        return own and (m.get("type", "simple") in ("simple", "cumulative") or part["name"] not in self.metrics)

    def _models_of(self, name: str, seen: tuple[str, ...] = ()) -> list[str]:
        m, out = self.metrics[name], []
        for part in self._parts(m):
            if self._is_leaf(m, part):
                out.append(self.leaves[part["name"]][0])
            elif part["name"] in self.metrics and part["name"] not in (*seen, name):
                out += self._models_of(part["name"], (*seen, name))
        return list(dict.fromkeys(out))

    def _home(self, name: str) -> str:
        used = self._models_of(name)
        if not used:
            raise CannotSay("metric", "it names no known measure", "define a measure")
        return used[0] if all(u in ways(self.drafts, used[0]) for u in used) else anchor(self.drafts, used)

    def _part(self, m: dict, part: dict, filters: list[str], home: str) -> str:
        """One input of a metric, by its name where that says it all."""
        name, filters = part["name"], [*filters, *_filters(part.get("filter"))]
        if part.get("join_to_timespine") or part.get("fill_nulls_with") is not None:
            raise CannotSay("time spine", "gaps aren't filled", "remove the request")
        if name in self.failed and not (self._is_leaf(m, part) and name in self.metrics):
            raise CannotSay("input", f"its input {name} couldn't be converted: {self.failed[name].reason}")
        if self._is_leaf(m, part):
            return name if not filters and name in self.drafts[home].measures and self.leaves[name][0] == home else self._leaf(name, filters, home)
        if name not in self.metrics:
            raise CannotSay("input", f"there is no measure or metric {name}")
        if not filters and name in self.drafts[home].measures:
            return name
        return f"({self._of_metric(self.metrics[name], filters, home)})"

    def _of_metric(self, m: dict, filters: list[str], home: str) -> str:
        p, kind = m.get("type_params") or {}, m.get("type", "simple")
        filters = [*filters, *_filters(m.get("filter"))]
        if kind == "simple":
            if not p.get("measure"):
                raise CannotSay("metric", "it has no measure", "define a measure")
            return self._part(m, _named(p["measure"]), filters, home)
        if kind == "ratio":
            top, bottom = (self._part(m, _named(p[k]), filters, home) for k in ("numerator", "denominator"))
            return f"{top} / nullif({bottom}, 0)"
        if kind == "cumulative":
            more = {**p, **(p.get("cumulative_type_params") or {})}
            if more.get("window"):
                raise CannotSay("rolling window", "its result depends on the grain of the query", "measure:sum(window='90d') in the query")
            if more.get("grain_to_date"):
                raise CannotSay("grain to date", "a saved measure can't start anew at each grain", "cumsum with partition_by in the query")
            if (more.get("period_agg") or "first") != "first":
                raise CannotSay("period aggregation", "only the running total itself is offered", "leave out period_agg")
            return f"cumsum({self._part(m, _named(p.get('measure')), filters, home)})"
        if kind == "derived":
            return self._derived(m, p, filters, home)
        raise CannotSay(f"{kind} metric", "it has no counterpart", "a query in several stages")

    def _derived(self, m: dict, p: dict, filters: list[str], home: str) -> str:
        said = {}
        for part in map(_named, p.get("metrics") or ()):
            if part.get("offset_to_grain"):
                raise CannotSay("offset to grain", "no transform moves to the start of a grain", "first(x, partition_by=...) in the query")
            text = self._part(m, part, filters, home)
            if part.get("offset_window"):
                of = self.metrics.get(part["name"])
                if of is not None and of.get("type", "simple") != "simple":
                    raise CannotSay("offset of a composed metric", "only a single aggregate is moved in time", "a query in two stages")
                text = f"time_shift({text}, {self._offset(part['offset_window'])})"
            said[part.get("alias") or part["name"]] = text
        return _WORD.sub(lambda w: said.get(w[0], w[0]), str(p.get("expr") or ""))

    @staticmethod
    def _offset(window: Any) -> str:
        count, grain = (window.get("count"), window.get("granularity")) if isinstance(window, dict) else str(window).split()
        grain = str(grain).lower()
        grain = grain if grain in GRANULARITIES else grain.removesuffix("s")
        if grain not in GRANULARITIES:
            raise CannotSay("granularity", f"{grain!r} isn't known", "day, week, month, quarter or year")
        return f"-{int(count)}, '{grain}'"
