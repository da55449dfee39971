"""A subset of SQL over models, as BI tools write it, and the catalog as DataFrames.

    SELECT items FROM model [LEFT JOIN (SELECT columns FROM model) ON a = b]
    [WHERE ..] [GROUP BY ..] [HAVING ..] [ORDER BY ..] [LIMIT ..] [OFFSET ..]

A statement is read as tokens, so literals and quoted names stay as they are. WHERE and HAVING become filters of the
engine's own language, which has the same precedence of OR, AND and NOT; only a chain of ANDs at the top is taken apart.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import dsl
from .errors import CadenzaError, NotAllowed
from .functions.calendar import GRANULARITIES
from .functions.names import BY_TYPE, NUMERIC, aggregation_name
from .plans.planner import leaf_name
from .semantics import Extension, Join, Model, Query

_CLAUSES = ("select", "from", "where", "group by", "having", "order by", "limit", "offset")
_DATE_PARTS = ("year", "quarter", "month", "week", "day", "hour", "minute", "second")
_TYPE_NAMES = {
    "varchar": "TEXT", "text": "TEXT", "string": "TEXT", "bigint": "INT", "integer": "INT", "int": "INT", "double": "DOUBLE", "float": "DOUBLE",
    "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP",
}
_SPARK = {"TEXT": "string", "INT": "bigint", "DOUBLE": "double", "BOOLEAN": "boolean", "DATE": "date", "TIMESTAMP": "timestamp_ntz"}
# What each type may be cast to besides itself, and the casts that would change an order or merge groups.
CASTS = {"DATE": {"TIMESTAMP", "TEXT"}, "TIMESTAMP": {"DATE", "TEXT"}, "INT": {"DOUBLE", "TEXT"}, "DOUBLE": {"TEXT"}, "BOOLEAN": {"TEXT"}, "TEXT": set(), None: {"TEXT"}}
_REORDERS = {(kind, "TEXT") for kind in ("INT", "DOUBLE", "BOOLEAN", "DATE", "TIMESTAMP")}
_MERGES = {("TIMESTAMP", "DATE"), ("INT", "DOUBLE")}

_TOKEN = re.compile(
    r"""\s*(?:(?P<text>'(?:[^']|'')*')|"(?P<quoted>(?:[^"]|"")*)"|`(?P<ticked>[^`]*)`|(?P<number>\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+)
    |(?P<word>[^\W\d]\w*)|(?P<op>::|<=|>=|<>|!=|\|\||[-+*/%<>=(),.;]))""",
    re.X,
)
#: Kind (text, number, path, word, op) and value. A path is a name with its hops.
Token = tuple[str, str]


@dataclass
class Item:
    """An expression of SELECT, GROUP BY or ORDER BY: a dimension, a time (column|granularity) or a metric (formula)."""

    kind: str
    formula: str
    cast: str | None = None


@dataclass
class Translated:
    query: Query
    names: list[tuple[str, int, str | None]]  # SQL name, which column of the result, Spark type it is cast to


def _read(sql: str) -> list[Token]:
    out, at, sql = [], 0, sql.rstrip().rstrip(";").rstrip()
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if not m:
            raise NotAllowed(f"can't read {sql[at : at + 20]!r}")
        kind = m.lastgroup
        if kind in ("quoted", "ticked") and not re.fullmatch(r"\w[\w .]*", m[kind]):
            raise NotAllowed(f"{m[kind]!r} is no name")
        out.append(("name" if kind in ("quoted", "ticked") else kind, m[kind]))
        at = m.end()
    return out


def _is(token: Token, *values: str) -> bool:
    return token[0] in ("word", "op") and token[1].lower() in values


def _split(tokens: list[Token], *seps: str) -> list[list[Token]]:
    """The parts between separators outside of parentheses."""
    out, depth = [[]], 0
    for t in tokens:
        depth += _is(t, "(") - _is(t, ")")
        if depth == 0 and _is(t, *seps):
            out.append([])
        else:
            out[-1].append(t)
    return out


def _clauses(tokens: list[Token]) -> dict[str, list[Token]]:
    found: dict[str, list[Token]] = {}
    now, depth, k = None, 0, 0
    while k < len(tokens):
        t = tokens[k]
        depth += _is(t, "(") - _is(t, ")")
        pair = f"{t[1]} {tokens[k + 1][1]}".lower() if k + 1 < len(tokens) and t[0] == tokens[k + 1][0] == "word" else ""
        name = pair if pair in _CLAUSES else t[1].lower() if t[0] == "word" else ""
        if depth == 0 and name in _CLAUSES:
            if name in found:
                raise NotAllowed(f"{name.upper()} is there twice")
            found[name], now = [], name
            k += len(name.split())
            continue
        if now is None:
            break
        found[now].append(t)
        k += 1
    if not found or next(iter(found)) != "select" or not found.get("from"):
        raise NotAllowed("only SELECT ... FROM a model is understood")
    order = [_CLAUSES.index(c) for c in found if c not in ("limit", "offset")]
    if order != sorted(order):
        raise NotAllowed("the clauses are out of order")
    return found


def _paths(tokens: list[Token], resolve: Callable[[str], str]) -> list[Token]:
    """The tokens with dotted names as one path; names before a parenthesis and keywords stay words."""
    out, k = [], 0
    while k < len(tokens):
        kind, value = tokens[k]
        follows = tokens[k + 1] if k + 1 < len(tokens) else ("end", "")
        literal = kind == "word" and value.lower() in ("date", "timestamp") and follows[0] == "text"
        plain = kind == "word" and (value.lower() in _KEYWORDS or _is(follows, "("))
        if literal:
            k += 1
        elif kind in ("word", "name") and not plain:
            parts = [value]
            while k + 2 < len(tokens) and _is(tokens[k + 1], ".") and tokens[k + 2][0] in ("word", "name"):
                parts.append(tokens[k + 2][1])
                k += 2
            out.append(("path", resolve(".".join(parts))))
            k += 1
        else:
            out.append((kind, value))
            k += 1
    return out


_KEYWORDS = frozenset("and or not in is null like between true false as asc desc nulls distinct case when then else end interval cast".split())


def _text(tokens: list[Token]) -> str:
    return " ".join(value for _, value in tokens)


def _conjuncts(tokens: list[Token]) -> list[list[Token]]:
    """The parts of a chain of ANDs; all in one if there is an OR beside them. The AND of BETWEEN is no separator."""
    if not tokens:
        return []
    if len(_split(tokens, "or")) > 1:
        return [tokens]
    out: list[list[Token]] = []
    for part in _split(tokens, "and"):
        if out and any(_is(t, "between") for t in out[-1]) and not _closed(out[-1]):
            out[-1] += [("word", "AND"), *part]
        else:
            out.append(part)
    return out


def _closed(part: list[Token]) -> bool:
    """Whether each BETWEEN outside of parentheses has its AND."""
    return len(_split(part, "between")) <= len(_split(part, "and"))


def _from(engine, tokens: list[Token]) -> tuple[Model, object, Callable[[str], str]]:
    """The model, what the query's source is, and how names are resolved."""
    at = next((k for k, t in enumerate(tokens) if _is(t, "left", "join", "inner", "right", "full", "cross", ",")), len(tokens))
    name, alias = _named(tokens[:at])
    model = engine.model(name.rsplit(".", 1)[-1])
    prefixes: dict[str, Callable[[str], str]] = {p: lambda rest: rest for p in {alias, name, model.name} - {None}}
    source: object = model.name
    if at < len(tokens):
        rest = tokens[at:]
        words = [t[1].lower() for t in rest[:3]]
        skip = 2 if words[:2] == ["left", "join"] else 3 if words == ["left", "outer", "join"] else 0
        sides = _split(rest[skip:], "on")
        if not skip or len(sides) != 2 or any(len(_split(side, "join", ",")) > 1 for side in sides):
            raise NotAllowed("only one LEFT JOIN ... ON a = b is understood")
        columns = None
        if _is(sides[0][0], "("):
            close = max(k for k, t in enumerate(sides[0]) if _is(t, ")"))
            inner = _clauses(sides[0][1:close])
            if set(inner) != {"select", "from"}:
                raise NotAllowed("the joined SELECT has columns and a model only")
            target, under = _named(inner["from"])
            joined_as = _named([("word", "x"), *sides[0][close + 1 :]])[1]
            if _text(inner["select"]) != "*":
                columns = {}
                for piece in _split(inner["select"], ","):
                    parts = [t[1] for t in piece if not _is(t, "as", ".")]
                    if under and len(parts) > 1 and parts[0] in (under, target):
                        parts = parts[1:]
                    if not 1 <= len(parts) <= 2 or any(t[0] not in ("word", "name", "op") for t in piece):
                        raise NotAllowed(f"{_text(piece)}: the joined SELECT has plain columns")
                    columns[parts[-1]] = parts[0]
        else:
            target, joined_as = _named(sides[0])
        other = engine.model(target.rsplit(".", 1)[-1])
        joined_as = joined_as or other.name

        def reach(rest: str) -> str:
            if columns is not None and rest not in columns:
                raise NotAllowed(f"{rest} is not selected in the joined SELECT")
            return f"{other.name}.{columns[rest] if columns is not None else rest}"

        on = [t for t in sides[1] if not _is(t, "(", ")")]
        ends = [part[0][1] for part in _split(_paths(on, lambda n: n), "=") if len(part) == 1 and part[0][0] == "path"]
        ours = [e.split(".", 1)[1] for e in ends if "." in e and e.split(".")[0] in prefixes]
        theirs = [reach(e.split(".", 1)[1]).split(".", 1)[1] for e in ends if e.split(".")[0] == joined_as]
        if len(ends) != 2 or len(ours) != 1 or len(theirs) != 1:
            raise NotAllowed("ON takes one equality of a column of each side")
        join = Join(other.name, ((ours[0], theirs[0]),))
        if join not in model.joins:
            source = Extension(model.name, joins=(join,))
            model = engine._source(source, {})
        prefixes[joined_as] = reach

    def resolve(path: str) -> str:
        for prefix, put in prefixes.items():
            if path.startswith(f"{prefix}."):
                return put(path[len(prefix) + 1 :])
        return path

    return model, source, resolve


def _named(tokens: list[Token]) -> tuple[str, str | None]:
    """A name and its alias."""
    parts = _paths([t for t in tokens if not _is(t, "as")], lambda n: n)
    if not 1 <= len(parts) <= 2 or any(p[0] != "path" for p in parts):
        raise NotAllowed("FROM names one model; joined columns are written as paths")
    return parts[0][1], parts[1][1] if len(parts) == 2 else None


def translate(engine, sql: str) -> Translated:
    """The query that a SELECT over a model stands for."""
    parts = _clauses(_read(sql))
    model, source, resolve = _from(engine, parts["from"])
    metrics = {leaf_name(dsl.Agg(c.name, a)): f"{c.name}:{a}" for c in model.columns for a in _eligible(c, engine.column_type(model, c.name))}
    metrics |= {"row_count": "*:count", "_count": "*:count"} | {m.name: m.name for m in model.measures}
    own = {c.name for c in model.columns}

    def formula(tokens: list[Token]) -> str:
        """Aggregates and names of metrics in the engine's language."""
        out, k = [], 0
        while k < len(tokens):
            agg = _aggregate(tokens[k:])
            if agg:
                out.append(agg[0])
                k += agg[1]
                continue
            kind, value = tokens[k]
            out.append(metrics[value] if kind == "path" and value in metrics and value not in own else value)
            k += 1
        return " ".join(out)

    def item(tokens: list[Token]) -> Item:
        while len(tokens) > 2 and _is(tokens[0], "(") and _matching(tokens) == len(tokens) - 1:
            tokens = tokens[1:-1]
        if len(tokens) > 2 and _is(tokens[-2], "::"):
            return cast(item(tokens[:-2]), tokens[-1])
        if _is(tokens[0], "cast") and _matching(tokens, 1) == len(tokens) - 1 and _is(tokens[-3], "as"):
            return cast(item(tokens[2:-3]), tokens[-2])
        found = _time(tokens)
        if found:
            return Item("time", found)
        agg = _aggregate(tokens)
        if agg and agg[1] == len(tokens):
            return Item("metric", agg[0])
        if len(tokens) == 1 and tokens[0][0] == "path":
            name = tokens[0][1]
            return Item("metric", metrics[name]) if name in metrics and name not in own else Item("dimension", name)
        if _is(tokens[0], "*"):
            raise NotAllowed("SELECT * over a model: name its dimensions and metrics")
        return Item("metric", formula(tokens))

    def type_of(x: Item) -> str | None:
        if x.kind == "time":
            return "TIMESTAMP"
        path, _, agg = x.formula.partition(":")
        if x.kind == "metric" and not re.fullmatch(r"[\w.*]+:\w+", x.formula):
            return next((m.type for m in model.measures if m.name == x.formula), None)
        if agg.startswith("count"):
            return "INT"
        if agg in NUMERIC - BY_TYPE["TEXT"] - {"sum"}:
            return "DOUBLE"
        *hops, leaf = path.split(".")
        kind = engine.column_type(engine.model_at(model, tuple(hops)), leaf)
        return "INT" if agg == "sum" and kind == "BOOLEAN" else kind

    def cast(x: Item, to: Token) -> Item:
        target, kind = _TYPE_NAMES.get(to[1].lower()), type_of(x)
        if x.cast or target is None or target != kind and target not in CASTS[kind]:
            raise NotAllowed(f"can't cast {x.formula} ({kind or 'a formula'}) to {to[1]}")
        return Item(x.kind, x.formula, target)

    projected: list[tuple[Item, str]] = []
    for tokens in _split(_paths(parts["select"], resolve), ","):
        as_ = next((k for k, t in enumerate(tokens) if _is(t, "as") and k == len(tokens) - 2), None)
        if not tokens:
            raise NotAllowed("an empty item in SELECT")
        made = item(tokens[:as_])
        projected.append((made, tokens[-1][1] if as_ is not None else _text(tokens)))
    named = {out: x for x, out in projected}

    def of(tokens: list[Token], lossy: set, where: str) -> Item:
        """An item of GROUP BY or ORDER BY: a projected name, a position, or an expression."""
        nth = tokens[0][1] if len(tokens) == 1 and tokens[0][0] == "number" else ""
        if nth and not 1 <= int(nth) <= len(projected):
            raise NotAllowed(f"{where} {nth}: there are {len(projected)} columns")
        x = projected[int(nth) - 1][0] if nth else named.get(_text(tokens)) or item(tokens)
        if x.cast and (type_of(x), x.cast) in lossy:
            raise NotAllowed(f"{where} {x.formula} as {x.cast}: use the column itself")
        if (x.kind, x.formula) not in {(p.kind, p.formula) for p, _ in projected}:
            raise NotAllowed(f"{where} has {x.formula}, which isn't selected")
        return x

    for tokens in _split(_paths(parts["group by"], resolve), ",") if "group by" in parts else []:
        of(tokens, _MERGES, "GROUP BY")
    times = {x.formula.split("|")[0] for x, _ in projected if x.kind == "time"}
    bounds: dict[str, list[str | None]] = {}
    filters: list[str] = []
    conditions = _conjuncts(_paths(parts.get("where", []), resolve))
    ends = {}
    for tokens in conditions:
        if len(tokens) == 3 and tokens[0][0] == "path" and tokens[0][1] in times and _is(tokens[1], ">=", "<=") and tokens[2][0] == "text":
            ends.setdefault(tokens[0][1], []).append((tokens[1][1], tokens[2][1][1:-1]))
    for column, found in ends.items():
        if sorted(op for op, _ in found) == ["<=", ">="]:
            bounds[column] = [value for _, value in sorted(found, reverse=True)]
    for tokens in conditions:
        if tokens[0][1] not in bounds or len(tokens) != 3 or not _is(tokens[1], ">=", "<="):
            alias = {k: x.formula for k, x in named.items() if x.kind == "dimension" and k not in own}
            filters.append(" ".join(alias.get(v, v) if k == "path" else v for k, v in tokens))
    filters += [formula(h) for h in _conjuncts(_paths(parts.get("having", []), resolve))]
    order = []
    for tokens in _split(_paths(parts["order by"], resolve), ",") if "order by" in parts else []:
        if len(tokens) > 2 and _is(tokens[-2], "nulls"):
            if not (tokens[-1][1].lower() == "last"):
                raise NotAllowed("NULLS FIRST")
            tokens = tokens[:-2]
        direction = tokens[-1][1].lower() if _is(tokens[-1], "asc", "desc") else None
        x = of(tokens[:-1] if direction else tokens, _REORDERS, "ORDER BY")
        order.append({"column": x.formula.split("|")[0] if x.kind == "time" else x.formula, "direction": direction or "asc"})
    unique = {kind: list(dict.fromkeys(x.formula for x, _ in projected if x.kind == kind)) for kind in ("dimension", "time", "metric")}
    query = Query(
        source_model=source,
        measures=tuple({"formula": f} for f in unique["metric"]),
        dimensions=tuple(unique["dimension"]),
        time_dimensions=tuple({"dimension": f.split("|")[0], "granularity": f.split("|")[1], "date_range": tuple(bounds[f.split("|")[0]]) if f.split("|")[0] in bounds else None} for f in unique["time"]),
        filters=tuple(filters),
        order=tuple(order),
        limit=_number(parts, "limit"),
        offset=_number(parts, "offset"),
    )
    place = [(kind, f) for kind in ("dimension", "time", "metric") for f in unique[kind]]
    return Translated(query, [(out, place.index((x.kind, x.formula)), _SPARK[x.cast] if x.cast else None) for x, out in projected])


def _number(parts: dict[str, list[Token]], clause: str) -> int | None:
    if clause not in parts:
        return None
    if len(parts[clause]) != 1 or not parts[clause][0][1].isdigit():
        raise NotAllowed(f"{clause.upper()} takes a number")
    return int(parts[clause][0][1])


def _matching(tokens: list[Token], at: int = 0) -> int:
    """The place of the parenthesis that closes the one at `at`; -1 if there is none."""
    depth = 0
    for k in range(at, len(tokens)):
        depth += _is(tokens[k], "(") - _is(tokens[k], ")")
        if depth == 0:
            return k if _is(tokens[k], ")") else -1
    return -1


def _aggregate(tokens: list[Token]) -> tuple[str, int] | None:
    """An aggregate call at the start, in the engine's language, and how many tokens it has."""
    if len(tokens) < 4 or tokens[0][0] != "word" or not _is(tokens[1], "("):
        return None
    name, k = aggregation_name(tokens[0][1]), 2
    if _is(tokens[2], "distinct"):
        name, k = "count_distinct" if name == "count" else "", 3
    path = tokens[k][1] if k < len(tokens) and (tokens[k][0] == "path" or _is(tokens[k], "*")) else None
    if name not in NUMERIC or path is None or k + 1 >= len(tokens) or not _is(tokens[k + 1], ")"):
        return None
    return f"{path}:{name}", k + 2


def _time(tokens: list[Token]) -> str | None:
    """date_trunc('g', x), part(x), or a week that begins on Sunday, as x|granularity."""
    shape = " ".join("P" if k == "path" else "T" if k == "text" else v.lower() for k, v in tokens)
    texts = [v[1:-1].lower() for k, v in tokens if k == "text"]
    path = next((v for k, v in tokens if k == "path"), "")
    if shape == "date_trunc ( T , P )" and texts[0] in GRANULARITIES:
        return f"{path}|{texts[0]}"
    if re.fullmatch(r"\(?\s*date_trunc \( T , (\( )?P \+ interval T (\) )?\) - interval T\s*\)?", shape) and texts == ["week", "1 day", "1 day"]:
        return f"{path}|week_sunday"
    if len(tokens) == 4 and shape.endswith("( P )") and tokens[0][1].lower() in _DATE_PARTS:
        return f"{path}|{tokens[0][1].lower()}"
    return None


def run(engine, sql: str) -> DataFrame:
    """The rows of a SELECT, with its names and in its order of columns. Tables of information_schema are read by Spark's own SQL."""
    if re.search(r"\binformation_schema\s*\.", sql, re.I):
        return _of_catalog(engine, sql)
    made = translate(engine, sql)
    df = engine.execute(made.query).df
    columns = [F.col(f"`{c}`") for c in df.columns]
    return df.select(*[(columns[at].cast(kind) if kind else columns[at]).alias(name) for name, at, kind in made.names])


def _of_catalog(engine, sql: str) -> DataFrame:
    tables = information_schema(engine)
    if _read(sql)[0][1].lower() not in ("select", "with"):
        raise NotAllowed("only SELECT ... FROM the catalog is understood")

    def put(m: re.Match) -> str:
        if m[1].lower() not in tables:
            raise NotAllowed(f"information_schema has no {m[1]}")
        return "{" + m[1].lower() + "}"

    pieces = re.split(r"('(?:[^']|'')*')", sql.rstrip().rstrip(";"))  # literals are the odd ones
    safe = [p.replace("{", "{{").replace("}", "}}") for p in pieces]
    text = "".join(p if k % 2 else re.sub(r"\binformation_schema\s*\.\s*(\w+)", put, p, flags=re.I) for k, p in enumerate(safe))
    return engine.spark.sql(text, **tables)


def _eligible(column, kind: str) -> list[str]:
    allowed = BY_TYPE[kind] - {"percentile", "weighted_avg", "corr", "covar_samp", "covar_pop"}
    if column.primary_key:
        allowed = {a for a in allowed if a.startswith("count")}
    return sorted(allowed & set(column.allowed_aggregations) if column.allowed_aggregations is not None else allowed)


def metrics(engine) -> DataFrame:
    """Rows model, metric, formula: each column with each aggregation it admits, saved measures, and the row count."""
    rows = []
    for name, model in sorted(engine.models.items()):
        rows.append((name, "row_count", "*:count"))
        rows += [(name, m.name, m.formula) for m in model.measures]
        rows += [(name, leaf_name(dsl.Agg(c.name, a)), f"{c.name}:{a}") for c in model.columns for a in _eligible(c, engine.column_type(model, c.name))]
    return engine.spark.createDataFrame(rows, "model string, metric string, formula string")


def dimensions(engine, depth: int = 3) -> DataFrame:
    """Rows model, dimension, type: own columns and those of joined models down to `depth` hops."""
    rows = []

    def visit(root: str, path: tuple[str, ...]) -> None:
        model = engine.model_at(engine.model(root), path)
        rows.extend((root, ".".join([*path, c.name]), engine.column_type(model, c.name)) for c in model.columns)
        if len(path) < depth:
            for join in model.joins:
                if join.target_model in engine.models and join.target_model not in (root, *path):
                    visit(root, (*path, join.target_model))

    for name in sorted(engine.models):
        visit(name, ())
    return engine.spark.createDataFrame(rows, "model string, dimension string, type string")


def information_schema(engine) -> dict[str, DataFrame]:
    """METRICS, DIMENSIONS, TABLES, COLUMNS and SCHEMATA, made from the registry."""
    spark = engine.spark
    tables = [("cadenza", n, "SEMANTIC MODEL") for n in sorted(engine.models)]
    columns = [("cadenza", n, c.name, i + 1, engine.column_type(m, c.name)) for n, m in sorted(engine.models.items()) for i, c in enumerate(m.columns)]
    return {
        "metrics": metrics(engine),
        "dimensions": dimensions(engine),
        "tables": spark.createDataFrame(tables, "table_schema string, table_name string, table_type string"),
        "columns": spark.createDataFrame(columns, "table_schema string, table_name string, column_name string, ordinal_position int, data_type string"),
        "schemata": spark.createDataFrame([("cadenza",)], "schema_name string"),
    }


__all__ = ["CadenzaError", "information_schema", "run", "translate"]
