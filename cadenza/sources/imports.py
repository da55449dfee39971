"""What imports of foreign semantic definitions share: the report, names, and ways along joins.

An import either says a thing exactly or lists it as an issue; it never approximates.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterable
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml

from ..dsl import TRANSFORMS
from ..errors import CadenzaError
from ..semantics import Model

IDENTIFIER = re.compile(r"[A-Za-z_]\w*\Z")


@dataclass(frozen=True)
class Issue:
    """Something that was left out (`unconverted`, `dropped`) or deserves a look (`info`)."""

    entity: str
    category: str
    reason: str
    workaround: str = ""
    severity: str = "unconverted"


class CannotSay(CadenzaError):
    """A definition without an exact counterpart here."""

    def __init__(self, category: str, reason: str, workaround: str = ""):
        super().__init__(reason)
        self.category, self.reason, self.workaround = category, reason, workaround

    def issue(self, entity: str, severity: str = "unconverted") -> Issue:
        return Issue(entity, self.category, self.reason, self.workaround, severity)


@dataclass
class Imported:
    models: list[Model]
    issues: list[Issue] = field(default_factory=list)

    def report(self) -> str:
        """The issues by category, and a tally."""
        lines = []
        for category in sorted({i.category for i in self.issues}):
            lines.append(f"{category}:")
            for i in self.issues:
                if i.category == category:
                    lines.append(f"  [{i.severity}] {i.entity}: {i.reason}" + (f" (instead: {i.workaround})" if i.workaround else ""))
        count = {s: sum(i.severity == s for i in self.issues) for s in ("unconverted", "dropped")}
        return "\n".join([*lines, f"{len(self.models)} models, {count['unconverted']} unconverted, {count['dropped']} dropped"])

    def register(self, engine) -> None:
        for model in self.models:
            engine.add(model)


def told(said: dict) -> dict:
    """What a foreign definition says to people: label, description, metadata."""
    meta = said.get("meta") or (said.get("config") or {}).get("meta")
    out = {"label": said.get("label"), "description": said.get("description"), "meta": dict(meta) if isinstance(meta, dict) else None}
    return {k: v for k, v in out.items() if v}


class Draft:
    """A model while it is put together; measures and columns share one name space."""

    def __init__(self, **known: Any):
        self.known = {k: v for k, v in known.items() if v is not None}
        self.columns: dict[str, dict] = {}
        self.measures: dict[str, dict] = {}
        self.joins: dict[str, dict] = {}

    @property
    def name(self) -> str:
        return self.known["name"]

    def input_column(self, wanted: str, sql: str, taken: Iterable[str] = (), **more: Any) -> str:
        """The name of a column that means `sql`: one that is there already, or a new one."""
        sql = sql.strip()
        for name, c in self.columns.items():
            if (c.get("sql") or name) == sql and c.get("filter") == more.get("filter") and not c.get("primary_key"):
                return name
        name, taken = wanted, {*taken, *self.measures}
        while name in self.columns or name in taken:
            name += "_col"
        self.columns[name] = {"name": name, **({} if sql == name else {"sql": sql}), **{k: v for k, v in more.items() if v is not None}}
        return name

    def add_measure(self, name: str, formula: str, said: dict | None = None) -> None:
        """`said` is the foreign definition: its label, description and metadata come along."""
        if name in TRANSFORMS:
            raise CannotSay("name of a transform", f"{name!r} would hide the transform of that name", "rename it")
        if not IDENTIFIER.match(name):
            raise CannotSay("name", f"{name!r} is no identifier", "rename it")
        if name in self.columns or name in self.measures:
            raise CannotSay("name taken", f"model {self.name} already has {name!r}", "rename one of them")
        self.measures[name] = {"name": name, "formula": formula, **told(said or {})}

    def join_to(self, target: str, pairs: list[tuple[str, str]]) -> None:
        self.joins.setdefault(target, {"target_model": target, "join_pairs": pairs})

    def model(self) -> Model:
        return Model.of({**self.known, "columns": list(self.columns.values()), "measures": list(self.measures.values()), "joins": list(self.joins.values())})


def ways(drafts: dict[str, Draft], root: str) -> dict[str, tuple[str, ...]]:
    """For each model that joins lead to from `root`, the shortest path (ties: declared order)."""
    out, todo = {root: ()}, deque([root])
    while todo:
        at = todo.popleft()
        for target in drafts[at].joins:
            if target in drafts and target not in out:
                out[target] = (*out[at], target)
                todo.append(target)
    return out


def anchor(drafts: dict[str, Draft], wanted: list[str]) -> str:
    """The model from which all wanted ones are fewest hops away; ties: a wanted one, then by name."""
    found = []
    for name in drafts:
        reach = ways(drafts, name)
        if all(w in reach for w in wanted):
            found.append((sum(len(reach[w]) for w in wanted), name not in wanted, name))
    if not found:
        raise CannotSay("unreachable", f"no model reaches all of {', '.join(sorted(wanted))} by joins", "declare the join")
    return min(found)[2]


def finish(drafts: dict[str, Draft], issues: list[Issue]) -> Imported:
    """The drafts as models, without joins to models that weren't made."""
    models = []
    for draft in drafts.values():
        for target in [t for t in draft.joins if t not in drafts]:
            del draft.joins[target]
            issues.append(Issue(f"{draft.name} to {target}", "join", f"there is no model {target}", severity="dropped"))
        try:
            models.append(draft.model())
        except CadenzaError as e:
            issues.append(Issue(draft.name, "model", str(e), severity="dropped"))
    return Imported(models, issues)


def documents(path: str) -> list[dict]:
    """All YAML or JSON documents of a file or a folder, in order of path."""
    root = Path(path)
    files = [root] if root.is_file() else sorted(p for p in root.rglob("*") if p.suffix in (".yaml", ".yml", ".json"))
    return [d for p in files for d in yaml.safe_load_all(p.read_text()) if isinstance(d, dict)]
