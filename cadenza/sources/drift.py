"""Where models no longer fit their tables, and what depends on that."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException

from ..errors import CadenzaError
from ..operators.aggregate import type_of_spark
from ..operators.relation import sql_names

_BUCKETS = {"INT": "number", "DOUBLE": "number", "TEXT": "text", "BOOLEAN": "boolean", "DATE": "time", "TIMESTAMP": "time"}


@dataclass(frozen=True)
class Drift:
    model: str
    kind: str  # table, sql, query, column, type, join, measure, filter
    name: str
    why: str


def validate(engine) -> list[Drift]:
    """Differences between models and what they stand on as it is now, with what falls with them.

    Models over SQL or saved queries are analysed, not run. Failures that say nothing about a schema, such as a lost connection, are raised.
    """
    engine.tables.read_before.clear()
    engine._scans.clear()
    out: list[Drift] = []
    missing: dict[str, set[str]] = {}
    for model in engine.models.values():
        kind = "table" if model.sql_table else "sql" if model.sql else "query"
        source = model.sql_table or f"the {kind} of {model.name}"
        try:
            schema = dict((engine.tables.read(model.sql_table) if model.sql_table else engine._scan(model)).dtypes)
        except (CadenzaError, AnalysisException) as e:
            out.append(Drift(model.name, kind, source, str(e).splitlines()[0][:200]))
            missing[model.name] = {c.name for c in model.columns}
            continue
        gone = set()
        for c in model.columns:
            base = (c.sql or c.name).strip()
            if re.fullmatch(r"[^\W\d]\w*", base) and not (c.sql and model.column(base) and base != c.name):
                if base not in schema:
                    gone.add(c.name)
                    out.append(Drift(model.name, "column", c.name, f"{source} has no {base}"))
                elif c.type and _BUCKETS[c.type] != _BUCKETS[type_of_spark(schema[base])]:
                    out.append(Drift(model.name, "type", c.name, f"{c.type} is now {schema[base]}"))
        missing[model.name] = gone
    for model in engine.models.values():
        gone = missing.get(model.name, set())
        # Derived columns fall with what they use, and so on.
        while True:
            more = {
                c.name for c in model.columns if c.name not in gone and c.sql
                and any(k == "name" and not called and v in gone for k, v, called in sql_names(c.sql))
            }
            if not more:
                break
            gone |= more
            out += [Drift(model.name, "column", n, "it uses a column that is gone") for n in sorted(more)]
        for m in model.measures:
            if any(re.search(rf"(?<![\w.]){re.escape(n)}(?!\w)", m.formula) for n in gone):
                out.append(Drift(model.name, "measure", m.name, "it uses a column that is gone"))
        for f in model.filters:
            if any(k == "name" and v in gone for k, v, _ in sql_names(f)):
                out.append(Drift(model.name, "filter", f, "it uses a column that is gone"))
        for j in model.joins:
            target = engine.models.get(j.target_model)
            if target is None or any(a in gone for a, _ in j.join_pairs) or any(b in missing.get(j.target_model, ()) for _, b in j.join_pairs):
                out.append(Drift(model.name, "join", j.target_model, "a side of it is gone"))
    return out


def apply(engine, found: list[Drift]) -> None:
    """Takes out of the models what `found` says is gone."""
    for name in {d.model for d in found}:
        model = engine.models[name]
        out = {(d.kind, d.name) for d in found if d.model == name}
        if any(kind == "table" for kind, _ in out):
            del engine.models[name]
            continue
        engine.models[name] = replace(
            model,
            columns=tuple(c for c in model.columns if ("column", c.name) not in out),
            measures=tuple(m for m in model.measures if ("measure", m.name) not in out),
            filters=tuple(f for f in model.filters if ("filter", f) not in out),
            joins=tuple(j for j in model.joins if ("join", j.target_model) not in out),
        )
    engine._scans.clear()
