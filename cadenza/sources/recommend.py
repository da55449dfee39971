"""Which model a query should start from, given the columns it wants."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from ..errors import UnknownName


@dataclass
class Recommendation:
    root: str | None
    paths: dict[str, str] = field(default_factory=dict)
    #: Without a common root: models that reach some of the items, none better than another.
    partial: list[tuple[str, list[str]]] = field(default_factory=list)


def recommend(engine, items: Sequence[str], hint: str | None = None) -> Recommendation:
    """The model with the fewest hops to all items; ties go to a model that is mentioned, then by name; a hint that works wins.

    Items are model.column or model.column:aggregation.
    """
    owners = {}
    for item in items:
        name = item.split(":", 1)[0].split(".")[0]
        if name not in engine.models:
            raise UnknownName(f"{item}: no model {name!r}")
        owners[item] = name
    mentioned = set(owners.values())
    reach = {}
    for model in sorted(engine.models):
        hops = {m: engine.join_path(model, m) for m in mentioned}
        reach[model] = {m: p for m, p in hops.items() if p is not None}
    whole = [m for m, r in reach.items() if set(r) == mentioned]
    if whole:
        best = min(whole, key=lambda m: (sum(len(p) for p in reach[m].values()), m not in mentioned, m))
        root = hint if hint in whole else best
        paths = {}
        for item in items:
            rest = item.split(".", 1)[1] if "." in item.split(":", 1)[0] else item.split(":", 1)[-1]
            paths[item] = ".".join([*reach[root][owners[item]], rest])
        return Recommendation(root, paths)

    def better(a: str, b: str) -> bool:
        x, y = reach[a], reach[b]
        if set(x) > set(y):
            return True
        return set(x) == set(y) and all(len(x[m]) <= len(y[m]) for m in x) and any(len(x[m]) < len(y[m]) for m in x)

    front = [m for m in reach if reach[m] and (m == hint or not any(better(o, m) for o in reach if o != m))]
    covered = [(m, [i for i in items if owners[i] in reach[m]]) for m in front]
    covered.sort(key=lambda c: (-len(c[1]), sum(len(p) for p in reach[c[0]].values()), c[0]))
    return Recommendation(None, {}, covered)
