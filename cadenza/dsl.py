"""The formula and filter language: tokens, grammar, syntax tree.

    revenue:sum / *:count            aggregates of columns (path:name(args))
    cumsum(x), rank(x, partition_by=a)   transforms of aggregated values
    a = 'x' and not b in (1, 2) or c is null or d like 'a%' or e || 'x' = 'yx'
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from typing import Any

from .errors import CadenzaError
from .functions.names import SCALARS, aggregation_name

TRANSFORMS = frozenset(
    "cumsum lag lead first last rank dense_rank percent_rank ntile time_shift change change_pct consecutive_periods".split()
)


@dataclass(frozen=True)
class Lit:
    value: Any


@dataclass(frozen=True)
class Ref:
    """A column, dimension, measure or alias, by its path."""

    path: str


@dataclass(frozen=True)
class Agg:
    path: str  # of the column, or *
    name: str
    args: tuple = ()
    kwargs: tuple[tuple[str, Any], ...] = ()


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple
    kwargs: tuple[tuple[str, Any], ...] = ()


@dataclass(frozen=True)
class Op:
    """An operator on one or two operands: + - * / % ** || = <> < <= > >= and or not neg."""

    op: str
    args: tuple


@dataclass(frozen=True)
class In:
    arg: Any
    values: tuple
    negated: bool


@dataclass(frozen=True)
class Is:
    arg: Any
    value: Any  # None, True or False
    negated: bool


@dataclass(frozen=True)
class Like:
    arg: Any
    pattern: str
    negated: bool


_TOKEN = re.compile(
    r"""\s*(?:
    (?P<number>\d+\.\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|\d+(?:[eE][+-]?\d+)?)
  | (?P<text>'(?:[^']|'')*'|"(?:[^"]|"")*")
  | (?P<word>[^\W\d]\w*)
  | (?P<op>\*\*|\|\||<=|>=|<>|!=|==|[-+*/%<>=():,.\[\]])
)""",
    re.X,
)
_COMPARE = {"=": "=", "==": "=", "<>": "<>", "!=": "<>", "<": "<", "<=": "<=", ">": ">", ">=": ">="}


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m:
            raise CadenzaError(f"can't read {text[at:]!r} in {text!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return [*out, ("end", "")]


class _Parser:
    def __init__(self, text: str):
        self.text, self.tokens, self.at = text, _tokens(text), 0

    def fail(self, why: str) -> CadenzaError:
        return CadenzaError(f"{why} in {self.text!r}")

    def peek(self, *values: str, ahead: int = 0) -> bool:
        kind, value = self.tokens[min(self.at + ahead, len(self.tokens) - 1)]
        return kind in ("op", "word") and value.lower() in values

    def take(self, *values: str) -> bool:
        if self.peek(*values):
            self.at += 1
            return True
        return False

    def need(self, value: str) -> None:
        if not self.take(value):
            raise self.fail(f"expected {value!r} before {self.tokens[self.at][1]!r}")

    def word(self) -> str:
        kind, value = self.tokens[self.at]
        if kind != "word":
            raise self.fail(f"expected a name before {value!r}")
        self.at += 1
        return value

    def whole(self):
        out = self.either()
        if self.tokens[self.at][0] != "end":
            raise self.fail(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def either(self):
        out = self.both()
        while self.take("or"):
            out = Op("or", (out, self.both()))
        return out

    def both(self):
        out = self.negation()
        while self.take("and"):
            out = Op("and", (out, self.negation()))
        return out

    def negation(self):
        if self.take("not"):
            return Op("not", (self.negation(),))
        return self.comparison()

    def comparison(self):
        left = self.joined()
        if self.tokens[self.at][1] in _COMPARE:
            op = _COMPARE[self.tokens[self.at][1]]
            self.at += 1
            right = self.joined()
            if self.tokens[self.at][1] in _COMPARE:
                raise self.fail("chained comparison")
            return Op(op, (left, right))
        if self.take("is"):
            negated = self.take("not")
            word = self.word().lower()
            if word not in ("null", "none", "true", "false"):
                raise self.fail("IS takes null, true or false")
            return Is(left, {"true": True, "false": False}.get(word), negated)
        negated = self.peek("not") and self.peek("in", "like", "between", ahead=1) and self.take("not")
        if self.take("in"):
            close = "]" if self.take("[") else ")"
            if close == ")":
                self.need("(")
            values = []
            while not self.take(close):
                item = self.unary()
                if not isinstance(item, Lit):
                    raise self.fail("IN takes a list of values")
                values.append(item.value)
                if not self.peek(close):
                    self.need(",")
            return In(left, tuple(values), negated)
        if self.take("like"):
            pattern = self.unary()
            if not isinstance(pattern, Lit) or not isinstance(pattern.value, str):
                raise self.fail("LIKE takes a text")
            return Like(left, pattern.value, negated)
        if self.take("between"):
            low = self.joined()
            self.need("and")
            span = Op("and", (Op(">=", (left, low)), Op("<=", (left, self.joined()))))
            return Op("not", (span,)) if negated else span
        return left

    def _left(self, part: Callable, *ops: str):
        out = part()
        while self.peek(*ops):
            op = self.tokens[self.at][1]
            self.at += 1
            out = Op(op, (out, part()))
        return out

    def joined(self):
        return self._left(self.sum, "||")

    def sum(self):
        return self._left(self.product, "+", "-")

    def product(self):
        return self._left(self.unary, "*", "/", "%")

    def unary(self):
        if self.take("-"):
            arg = self.unary()
            return Lit(-arg.value) if isinstance(arg, Lit) and not isinstance(arg.value, str) else Op("neg", (arg,))
        if self.take("+"):
            return self.unary()
        return self.power()

    def power(self):
        base = self.primary()
        return Op("**", (base, self.unary())) if self.take("**") else base

    def primary(self):
        kind, value = self.tokens[self.at]
        if kind == "number":
            self.at += 1
            return Lit(int(value) if value.isdigit() else float(value))
        if kind == "text":
            self.at += 1
            return Lit(value[1:-1].replace(value[0] * 2, value[0]))
        if self.take("("):
            out = self.either()
            self.need(")")
            return out
        if self.peek("*") and self.peek(":", ahead=1):
            self.at += 1
            return self.aggregate("*")
        name = self.word()
        if name.lower() in ("true", "false", "null", "none"):
            return Lit({"true": True, "false": False}.get(name.lower()))
        path = [name]
        while self.take("."):
            path.append("*" if self.take("*") else self.word())
        if self.peek(":"):
            return self.aggregate(".".join(path))
        if len(path) == 1 and self.take("("):
            return self.call(name)
        return Ref(".".join(path))

    def aggregate(self, path: str):
        self.need(":")
        name = aggregation_name(self.word())
        args, kwargs = self.arguments(names=True) if self.take("(") else ((), ())
        return Agg(path, name, args, kwargs)

    def arguments(self, names: bool = False) -> tuple[tuple, tuple]:
        args, kwargs = [], []
        while not self.take(")"):
            if self.tokens[self.at][0] == "word" and self.tokens[self.at + 1] == ("op", "="):
                key = self.word()
                self.need("=")
                kwargs.append((key, self.value()))
            else:
                args.append(self.value() if names else self.either())
            if not self.peek(")"):
                self.need(",")
        return tuple(args), tuple(kwargs)

    def value(self):
        """A parameter: a name, a value, or a list of them."""
        if self.take("["):
            out = []
            while not self.take("]"):
                out.append(self.value())
                if not self.peek("]"):
                    self.need(",")
            return tuple(out)
        item = self.unary()
        if isinstance(item, Ref):
            return item.path
        if isinstance(item, Lit):
            return item.value
        raise self.fail("a parameter is a name or a value")

    def call(self, name: str):
        low = name.lower()
        if self.peek("*") and self.peek(")", ahead=1):
            self.at += 2
            return Agg("*", aggregation_name(name))
        args, kwargs = self.arguments()
        if low in TRANSFORMS and not (low in ("first", "last") and args and isinstance(args[0], Ref)):
            return Call(low, args, kwargs)
        if low in SCALARS:
            if kwargs:
                raise self.fail(f"{name} takes no named arguments")
            return Call(low, args)
        if args and isinstance(args[0], Ref):  # sum(revenue) for revenue:sum
            more = tuple(a.path if isinstance(a, Ref) else a.value for a in args[1:] if isinstance(a, (Ref, Lit)))
            return Agg(args[0].path, aggregation_name(name), more, kwargs)
        raise self.fail(f"unknown function {name!r}")


def parse(text: str):
    """The syntax tree of a formula or filter."""
    if not text or not text.strip():
        raise CadenzaError("an empty formula")
    return _Parser(text).whole()


def children(node) -> Iterator:
    if isinstance(node, (Op, Call)):
        yield from node.args
    elif isinstance(node, (In, Is, Like)):
        yield node.arg


def walk(node) -> Iterator:
    yield node
    for child in children(node):
        yield from walk(child)


def rewrite(node, change: Callable):
    """The tree with `change` applied from the leaves up."""
    if isinstance(node, (Op, Call)):
        node = replace(node, args=tuple(rewrite(a, change) for a in node.args))
    elif isinstance(node, (In, Is, Like)):
        node = replace(node, arg=rewrite(node.arg, change))
    return change(node)


def has_transform(node) -> bool:
    return any(isinstance(n, Call) and n.name in TRANSFORMS for n in walk(node))


def aggregates(node) -> list[Agg]:
    return [n for n in walk(node) if isinstance(n, Agg)]
