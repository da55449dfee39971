"""A model with the joins a query needs, as one DataFrame; column references as SQL over its columns.

Each physical column is carried as `alias.column`, where the alias of the join path a, b, c is
`a__b__c`; so a table joined twice by different paths (a diamond) never clashes.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import CadenzaError, JoinPathError, UnknownName
from ..semantics import SQL_TYPES, Model

Path = tuple[str, ...]

_SQL_TOKEN = re.compile(
    r"""(?P<text>'(?:[^'\\]|\\.|'')*')|(?P<quoted>(?:`[^`]+`|"[^"]+")(?:\s*\.\s*(?:`[^`]+`|"[^"]+"|\w+))*)"""
    r"""|(?P<name>[^\W\d]\w*(?:\s*\.\s*[^\W\d]\w*)*)|(?P<number>\d[\w.]*)|(?P<rest>\s+|.)""",
    re.S | re.X,
)


def sql_names(text: str) -> list[tuple[str, str, bool]]:
    """(kind, text, called) for each token; names inside a nested SELECT are of kind 'inner'."""
    tokens = [(m.lastgroup, m[0]) for m in _SQL_TOKEN.finditer(text)]
    out, depth, inner = [], 0, []
    for i, (kind, value) in enumerate(tokens):
        following = next((v for k, v in tokens[i + 1 :] if v.strip()), "")
        if value == "(":
            depth += 1
            if following.lower() == "select":
                inner.append(depth)
        elif value == ")":
            if inner and inner[-1] == depth:
                inner.pop()
            depth -= 1
        if inner and kind in ("name", "quoted"):
            kind = "inner"
        out.append((kind, value, following == "("))
    return out


class Relation:
    """The base of one aggregate: root model, the join paths in use, and a shift of one time column."""

    def __init__(self, engine, root: Model, moved: tuple[Path, str] | None = None, move=None):
        self.engine, self.root = engine, root
        self.paths: set[Path] = set()
        self.moved, self.move = moved, move

    def alias(self, path: Path) -> str:
        return "__".join(path) if path else self.root.name

    def model_at(self, path: Path) -> Model:
        return self.engine.model_at(self.root, path)

    def use(self, path: Path) -> None:
        self.model_at(path)
        self.paths |= {path[:i] for i in range(1, len(path) + 1)}

    def physical(self, path: Path, name: str) -> str:
        self.use(path)
        return f"`{self.alias(path)}.{name}`"

    def column_sql(self, path: Path, name: str, stack: tuple = ()) -> str:
        """A column as SQL over the joined frame; derived columns are put in, with their type."""
        model = self.model_at(path)
        column = model.column(name)
        if (path, name) in stack:
            raise CadenzaError(f"column {name} of {model.name} is defined by itself")
        if column is None or column.sql is None or column.sql.strip() == name:
            if name not in self.engine.physical_columns(model):
                raise UnknownName(f"model {model.name} has no column {name!r}")
            sql = self.physical(path, name)
        elif re.fullmatch(r"[^\W\d]\w*", column.sql.strip()) and not model.column(column.sql.strip()):
            if column.sql.strip() not in self.engine.physical_columns(model):
                raise UnknownName(f"{model.name}.{name}: its table has no column {column.sql.strip()!r}")
            sql = self.physical(path, column.sql.strip())
        else:
            sql = "(" + self.expand(path, column.sql, (*stack, (path, name))) + ")"
            if column.type and column.type != "TEXT" and not re.fullmatch(r"[^\W\d]\w*", column.sql.strip()):
                sql = f"CAST({sql} AS {SQL_TYPES[column.type]})"
        if self.moved == (path, name) and self.move:
            sql = self.move(sql)
        return sql

    def expand(self, path: Path, text: str, stack: tuple = ()) -> str:
        """SQL text of a model with its names put in terms of the joined frame."""
        model, out = self.model_at(path), []
        for kind, value, called in sql_names(text):
            if kind == "quoted":
                value = re.sub(r'[`"]', "", value)
                kind = "name"
            if kind != "name":
                out.append(value)
                continue
            if called:
                out.append("get_json_object" if value.lower() == "json_extract" else value)
                continue
            out.append(self._name(model, path, re.sub(r"\s", "", value), stack) or value)
        return "".join(out)

    def _name(self, model: Model, path: Path, value: str, stack: tuple) -> str | None:
        *before, last = value.split(".")
        own = self.engine.physical_columns(model)
        if not before:
            if model.column(last) and (path, last) not in stack:
                return self.column_sql(path, last, stack)
            if last in own:
                return self.physical(path, last)
            if model.column(last):
                return self.column_sql(path, last, stack)
            return None
        if before == [model.name]:
            return self._name(model, path, last, stack)
        hops = [h for b in before for h in b.split("__")]
        if hops and hops[0] == model.name:
            hops = hops[1:]
        if model.join(hops[0]):
            return self.column_sql((*path, *hops), last, stack)
        if model.column(before[0]) or before[0] in own:  # a field of a struct
            return self._name(model, path, before[0], stack) + "." + ".".join([*before[1:], last])
        raise JoinPathError(f"model {model.name} has no join to {hops[0]}")

    def frame(self) -> DataFrame:
        """The joined rows, with the root's own filters."""
        conditions = [self.expand((), f) for f in self.root.filters]
        # Join columns may be derived ones that need further joins.
        pairs, done = {}, set()
        while todo := self.paths - done:
            for path in sorted(todo, key=lambda p: (len(p), p)):
                join = self.model_at(path[:-1]).join(path[-1])
                pairs[path] = [(self.column_sql(path[:-1], a), self.column_sql(path, b)) for a, b in join.join_pairs]
                done.add(path)
        df = self._scan((), self.root)
        for path in sorted(self.paths, key=lambda p: (len(p), p)):
            join = self.model_at(path[:-1]).join(path[-1])
            other = self._scan(path, self.model_at(path))
            on = " AND ".join(f"{a} = {b}" for a, b in pairs[path])
            df = df.join(other, F.expr(on), join.join_type)
        for condition in conditions:
            df = df.filter(F.expr(condition))
        return df

    def _scan(self, path: Path, model: Model) -> DataFrame:
        df = self.engine.scan(model)
        return df.select(*[F.col(f"`{c}`").alias(f"{self.alias(path)}.{c}") for c in df.columns])
