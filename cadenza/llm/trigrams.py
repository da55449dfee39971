"""Boolean trigram queries that a text must satisfy for a regular expression to match it.

From the parsed expression, every part gets the set of strings it can be (while that set is small) or a
condition on trigrams. A condition is a set of alternatives; each alternative is a set of trigrams that
all have to be there. `{frozenset()}` holds for any text: such a rule has no mandatory trigram.
All is in lower case (ASCII), so the text has to be folded alike.
"""

from __future__ import annotations

import re
from re import _constants as op
from re import _parser as parser

Query = frozenset[frozenset[str]]
ANY: Query = frozenset([frozenset()])
#: Strings that a part may stand for before it is turned into a condition.
_MOST = 64


def _both(a: Query, b: Query) -> Query:
    return _least(frozenset(x | y for x in a for y in b))


def _least(q: Query) -> Query:
    """Without alternatives that another one implies."""
    out = frozenset(x for x in q if not any(y < x for y in q))
    return out if len(out) <= _MOST else ANY


def _needs(strings: set[str]) -> Query:
    grams = [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings]
    return _least(frozenset(grams)) if grams else ANY


def _chars(items: list) -> set[str] | None:
    out: set[str] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            out.add(chr(value).lower())
        elif kind is op.RANGE and value[1] - value[0] < 8:
            out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out


def _one(kind, value) -> tuple[set[str] | None, Query]:
    """Of a part: the strings it can be, if few, and else a condition."""
    if kind is op.LITERAL:
        return {chr(value).lower()}, ANY
    if kind is op.AT or kind in (op.ASSERT, op.ASSERT_NOT):
        return {""}, ANY
    if kind is op.IN:
        return _chars(value), ANY
    if kind is op.SUBPATTERN:
        return _whole(value[-1])
    if kind is op.BRANCH:
        parts = [_whole(x) for x in value[1]]
        if all(s is not None for s, _ in parts) and sum(len(s) for s, _ in parts) <= _MOST:
            return set().union(*(s for s, _ in parts)), ANY
        alternatives = [_needs(s) if s is not None else q for s, q in parts]
        return None, _least(frozenset().union(*alternatives))
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
        low, high, body = value
        exact, query = _whole(body)
        if exact is not None and high != op.MAXREPEAT and high <= 2:
            powers, out = {""}, set()
            for n in range(high + 1):
                out |= powers if n >= low else set()
                powers = {a + b for a in powers for b in exact}
            if len(out) <= _MOST:
                return out, ANY
        if low:
            return None, _needs(exact) if exact is not None else query
        return None, ANY
    return None, ANY


def _whole(parts) -> tuple[set[str] | None, Query]:
    run: set[str] = {""}
    query, exact = ANY, True
    for kind, value in parts:
        strings, condition = _one(kind, value)
        if strings is not None and len(run) * len(strings) <= _MOST:
            run = {a + b for a in run for b in strings}
            continue
        query, exact = _both(_both(query, _needs(run)), condition), False
        run = strings if strings is not None and len(strings) <= _MOST else {""}
    if exact:
        return run, ANY
    return None, _both(query, _needs(run))


def trigram_query(pattern: str) -> list[list[str]]:
    """The alternatives, each a sorted list of trigrams; [[]] if there are no mandatory ones."""
    strings, query = _whole(parser.parse(pattern, re.ASCII))
    if strings is not None:
        query = _needs(strings)
    return sorted(sorted(x) for x in query)
