"""Open Semantic Interchange definitions as models.

Datasets become models, relationships left joins, and metrics, which are SQL over aggregates, formulas on the model that
reaches all datasets they name. Column types are those of the tables.
"""

from __future__ import annotations

from collections.abc import Iterable

from ..functions.names import NUMERIC, SCALARS, aggregation_name
from ..operators.relation import sql_names
from .imports import IDENTIFIER, CannotSay, Draft, Imported, Issue, anchor, documents, finish, told, ways

# Versions with this structure, and dialects whose expressions are SQL.
VERSIONS = ("1.0", "0.1.0", "0.1.1", "0.2.0.dev0")
DIALECTS = ("ANSI_SQL", "SNOWFLAKE", "DATABRICKS")
_ORDERED = {"percentile_cont", "median"}


def read(path: str, dialect: str = "ANSI_SQL") -> Imported:
    """All definitions of a folder (or one file)."""
    return convert(documents(path), dialect)


def convert(definitions: Iterable[dict], dialect: str = "ANSI_SQL") -> Imported:
    drafts: dict[str, Draft] = {}
    issues: list[Issue] = []
    for d in definitions:
        if "semantic_model" not in d:
            continue
        if str(d.get("version")) not in VERSIONS:
            issues.append(Issue(str(d.get("version")), "version", "this version isn't known; it is read like the others", severity="info"))
        for part in d["semantic_model"] or ():
            _Part(part, dialect, drafts, issues).convert()
    return finish(drafts, issues)


def _text(expression, dialect: str) -> str:
    """The expression in the wanted dialect, or else in another one of SQL."""
    if isinstance(expression, str):
        return expression
    said = {str(x.get("dialect")).upper(): x.get("expression") for x in (expression or {}).get("dialects") or ()}
    for name in (dialect.upper(), *DIALECTS):
        if said.get(name):
            return str(said[name])
    raise CannotSay("dialect", f"there is no SQL among {', '.join(sorted(said)) or 'no dialects'}", "add ANSI_SQL")


class _Part:
    """One semantic model: its datasets see each other, not those of other parts."""

    def __init__(self, part: dict, dialect: str, drafts: dict[str, Draft], issues: list[Issue]):
        self.part, self.dialect, self.all, self.issues = part, dialect, drafts, issues
        self.drafts: dict[str, Draft] = {}
        self.metrics = [str(m.get("name")) for m in part.get("metrics") or ()]

    def convert(self) -> None:
        for kind, make, severity in (("datasets", self._dataset, "dropped"), ("relationships", self._relationship, "dropped"), ("metrics", self._metric, "unconverted")):
            for thing in self.part.get(kind) or ():
                try:
                    make(thing)
                except CannotSay as e:
                    self.issues.append(e.issue(str(thing.get("name")), severity))

    def _dataset(self, d: dict) -> None:
        name, source = str(d.get("name")), str(d.get("source") or d.get("name")).strip()
        if not IDENTIFIER.match(name) or "__" in name:
            raise CannotSay("name", f"a model can't be called {name!r}", "rename it")
        if name in self.all:
            raise CannotSay("name taken", f"there is another dataset {name}", "rename one of them")
        where = {"sql": source} if len(source.split()) > 1 else {"sql_table": source}
        draft = Draft(name=name, **told(d), **where)
        keys = set(d.get("primary_key") or ())
        for f in d.get("fields") or ():
            try:
                sql = _text(f.get("expression") or f["name"], self.dialect)
            except CannotSay as e:
                self.issues.append(e.issue(f"{name}.{f['name']}"))
                continue
            column = {"name": f["name"], **({} if sql == f["name"] else {"sql": sql}), **told(f)}
            if f["name"] in keys:
                column["primary_key"] = True
            draft.columns[f["name"]] = column
            if (f.get("dimension") or {}).get("is_time"):
                draft.known.setdefault("default_time_dimension", f["name"])
        for key in d.get("primary_key") or ():
            draft.columns.setdefault(key, {"name": key, "primary_key": True})
        self.drafts[name] = self.all[name] = draft

    def _relationship(self, r: dict) -> None:
        source, target = r.get("from"), r.get("to")
        here, there = r.get("from_columns") or (), r.get("to_columns") or ()
        if source not in self.drafts or target not in self.drafts:
            raise CannotSay("join", f"{source} or {target} is no dataset")
        if not here or len(here) != len(there):
            raise CannotSay("join", "both sides need the same number of columns")
        if target in self.drafts[source].joins:
            raise CannotSay("join", f"{source} is joined to {target} already", "a second dataset over the same table")
        self.drafts[source].join_to(target, list(zip(here, there, strict=True)))

    def _metric(self, m: dict) -> None:
        name = str(m.get("name"))
        pieces = _pieces(_text(m.get("expression"), self.dialect))
        used = list(dict.fromkeys(o for p in pieces if isinstance(p, _Aggregate) for a in p.args for o in self._datasets(a)))
        host = anchor(self.drafts, used) if used else self._fact()
        formula = "".join(p if isinstance(p, str) else self._aggregate(name, host, p) for p in pieces)
        self.drafts[host].add_measure(name, formula.strip(), m)

    def _fact(self) -> str:
        """The dataset no other one refers to: what a count without columns counts."""
        targets = {t for d in self.drafts.values() for t in d.joins}
        facts = [n for n in self.drafts if n not in targets]
        if len(facts) != 1:
            raise CannotSay("count", "it isn't clear which dataset's rows are counted", "COUNT(dataset.key)")
        return facts[0]

    def _owner(self, name: str) -> tuple[str, str]:
        *before, last = name.split(".")
        owners = [before[-1]] if before else [n for n, d in self.drafts.items() if last in d.columns]
        owners = [o for o in owners if o in self.drafts and last in self.drafts[o].columns]
        if len(owners) != 1:
            raise CannotSay("column", f"{name} is {'in several datasets' if owners else 'in no dataset'}", "dataset.column")
        return owners[0], last

    def _datasets(self, sql: str) -> list[str]:
        return [self._owner(v)[0] for k, v, called in _tokens(sql) if _is_column(k, v, called)]

    def _from(self, host: str, name: str) -> str:
        """A column as seen from a model."""
        owner, column = self._owner(name)
        return ".".join([*ways(self.drafts, host)[owner], column])

    def _aggregate(self, metric: str, host: str, a: _Aggregate) -> str:
        if a.name == "count" and a.args == ["*"]:
            return "*:count"
        first, *more = [self._operand(metric, host, x) for x in a.args]
        given = [f"other={x}" for x in more] + ([f"p={a.p}"] if a.p else [])
        return f"{first}:{a.name}" + (f"({', '.join(given)})" if given else "")

    def _operand(self, metric: str, host: str, sql: str) -> str:
        tokens = [t for t in _tokens(sql) if t[1].strip()]
        if len(tokens) == 1 and _is_column(*tokens[0]):
            return self._from(host, tokens[0][1])
        datasets = set(self._datasets(sql))
        at = datasets.pop() if len(datasets) == 1 else host
        text = "".join(self._from(at, v) if _is_column(k, v, c) else v for k, v, c in _tokens(sql))
        column = self.drafts[at].input_column(f"{metric}_col", text, self.metrics)
        return ".".join([*ways(self.drafts, host)[at], column])


class _Aggregate:
    def __init__(self, name: str, args: list[str], p: str | None = None):
        self.name, self.args, self.p = name, args, p


_KEYWORDS = set("and or not is null in like between case when then else end true false cast as interval distinct double bigint int string date timestamp".split())


def _tokens(sql: str) -> list[tuple[str, str, bool]]:
    return [(k, v.replace(" ", "") if k == "name" else v, called) for k, v, called in sql_names(sql)]


def _is_column(kind: str, value: str, called: bool) -> bool:
    return kind == "name" and not called and value.lower() not in _KEYWORDS


def _group(tokens: list, at: int) -> tuple[list, int]:
    """The tokens between the bracket at `at` and its partner, and the place after it."""
    depth, inside = 0, []
    for i in range(at, len(tokens)):
        depth += {"(": 1, ")": -1}.get(tokens[i][1], 0)
        if not depth:
            return inside[1:], i + 1
        inside.append(tokens[i])
    raise CannotSay("syntax", "a bracket isn't closed")


def _split(tokens: list) -> list[str]:
    """Texts between the commas of the outermost level."""
    out, depth = [""], 0
    for _, value, _ in tokens:
        depth += {"(": 1, ")": -1}.get(value, 0)
        if value == "," and not depth:
            out.append("")
        else:
            out[-1] += value
    return [x.strip() for x in out]


def _pieces(sql: str) -> list[str | _Aggregate]:
    """A metric as texts and aggregates."""
    tokens, out, at = _tokens(sql), [], 0
    while at < len(tokens):
        kind, value, called = tokens[at]
        low = value.lower()
        name = "percentile" if low in ("percentile_cont", "percentile") else aggregation_name(low)
        if kind != "name":
            if kind in ("inner", "quoted"):
                raise CannotSay("expression", f"{value} can't be part of a metric")
            out.append(value)
            at += 1
        elif called and (name in NUMERIC and name not in SCALARS):
            opening = next(i for i in range(at, len(tokens)) if tokens[i][1] == "(")
            inside, at = _group(tokens, opening)
            made, at = _aggregate(low, name, inside, tokens, at)
            out.append(made)
        elif called and low in SCALARS:
            out.append(low)
            at += 1
        elif low in ("and", "or", "not") or low == "null":
            out.append(low)
            at += 1
        else:
            raise CannotSay("expression", f"{value} stands outside of an aggregate", "put it inside, or define a column")
    if not any(isinstance(p, _Aggregate) for p in out):
        raise CannotSay("expression", "it aggregates nothing")
    return out


def _aggregate(said: str, name: str, inside: list, tokens: list, at: int) -> tuple[_Aggregate, int]:
    def upcoming(place: int) -> tuple[str, int]:
        while place < len(tokens) and not tokens[place][1].strip():
            place += 1
        return (tokens[place][1].lower() if place < len(tokens) else "", place)

    words = [v for _, v, _ in inside if v.strip()]
    args, p = _split(inside), None
    if words and words[0].lower() == "distinct":
        if name != "count" or len(args) != 1:
            raise CannotSay("expression", f"{said}(DISTINCT) isn't offered")
        name, args = "count_distinct", [args[0].strip()[len("distinct") :].strip()]
    word, place = upcoming(at)
    if word == "within":
        if said not in _ORDERED and name != "percentile":
            raise CannotSay("expression", f"{said} takes no order")
        _, place = upcoming(place + 1)  # GROUP
        opening, place = upcoming(place + 1)
        if opening != "(":
            raise CannotSay("syntax", "WITHIN GROUP needs a bracket")
        order, at = _group(tokens, place)
        text = "".join(v for _, v, _ in order).strip()
        if text.lower().split()[:2] != ["order", "by"] or text.lower().endswith(" desc"):
            raise CannotSay("expression", "only an ascending order by one expression is read")
        p, args = args[0], [text.split(None, 2)[2].removesuffix(" ASC").removesuffix(" asc")]
    elif name == "percentile":
        raise CannotSay("expression", "a percentile needs WITHIN GROUP (ORDER BY ...)")
    if p is not None and float(p) == 0.5:
        name, p = "median", None
    word, _ = upcoming(at)
    if word in ("over", "filter"):
        raise CannotSay("expression", f"{word.upper()} of an aggregate isn't read", "a transform, or CASE inside the aggregate")
    if len(args) != (2 if name in ("corr", "covar_samp", "covar_pop") else 1) or not args[0]:
        raise CannotSay("expression", f"{said} with {len(args)} arguments isn't read")
    return _Aggregate(name, args, p), at
