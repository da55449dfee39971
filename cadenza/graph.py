"""The graph of models, their parts and the notes about them, and filters over it written as a MATCH pattern.

Nodes are rows (id, kind, name), edges rows (a, type, b). A pattern is a chain of joins, so a filter narrows ranked
retrieval without anything on the driver but the pattern.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .errors import NotAllowed

# Labels by lower-case spelling, and the types of edges.
LABELS = {"memory": "Memory", "datasource": "Datasource", "model": "Model", "column": "ModelColumn", "modelcolumn": "ModelColumn", "measure": "Measure", "aggregation": "Aggregation"}
EDGES = ("MENTIONS", "CONTAINS", "JOINS")
MOST_HOPS = 5

_QUERY = re.compile(r"\s*MATCH\s+(?P<pattern>.+?)\s+RETURN\s+(?P<var>\w+)\.id\s+AS\s+id\s*\Z", re.I | re.S)
_NODE = re.compile(r"\s*\(\s*(?P<var>\w*)\s*(?P<labels>(?::\s*\w+\s*)*)(?:\{(?P<where>[^}]*)\})?\s*\)\s*")
_HOP = re.compile(r"(?P<back><?)-\[\s*\w*\s*(?P<types>(?::\s*\w+\s*(?:\|\s*:?\s*\w+\s*)*)?)(?P<many>\*\s*(?P<low>\d*)\s*(?P<dots>(?:\.\.)?)\s*(?P<high>\d*)\s*)?\]-(?P<on>>?)")
_EQUAL = re.compile(r"\s*(id|name)\s*:\s*'([^']*)'\s*\Z")


@dataclass(frozen=True)
class Node:
    var: str
    kinds: tuple[str, ...]
    where: tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class Hop:
    types: tuple[str, ...]
    low: int
    high: int | None  # None: however many
    back: bool


def parse(text: str) -> tuple[list[Node], list[Hop], int]:
    """The nodes and hops of a pattern, and which node is asked for."""
    said = _QUERY.match(text)
    if not said or ";" in text:
        raise NotAllowed("a graph filter is MATCH (a:Label)-[:TYPE]->(b:Label) RETURN b.id AS id")
    pattern, at, nodes, hops = said["pattern"], 0, [], []
    while True:
        m = _NODE.match(pattern, at)
        if not m:
            raise NotAllowed(f"{pattern[at:]!r} is no node of a graph filter")
        nodes.append(_node(m))
        at = m.end()
        if at == len(pattern):
            break
        m = _HOP.match(pattern, at)
        if not m or bool(m["back"]) == bool(m["on"]):
            raise NotAllowed(f"{pattern[at:]!r} is no hop of a graph filter")
        hops.append(_hop(m))
        at = m.end()
    named = [n.var for n in nodes if n.var]
    if len(set(named)) < len(named):
        raise NotAllowed("a variable stands for one node of a graph filter")
    if said["var"] not in named:
        raise NotAllowed(f"{said['var']} isn't in the pattern")
    return nodes, hops, [n.var for n in nodes].index(said["var"])


def _node(m: re.Match) -> Node:
    labels = re.findall(r"\w+", m["labels"])
    if unknown := [x for x in labels if x.lower() not in LABELS]:
        raise NotAllowed(f"unknown label {unknown[0]!r}")
    where = []
    for part in (m["where"] or "").split(",") if (m["where"] or "").strip() else ():
        equal = _EQUAL.match(part)
        if not equal:
            raise NotAllowed(f"{part.strip()!r}: only id and name are compared, with a text")
        where.append((equal[1], equal[2]))
    return Node(m["var"], tuple(LABELS[x.lower()] for x in labels), tuple(where))


def _hop(m: re.Match) -> Hop:
    types = tuple(x.upper() for x in re.findall(r"\w+", m["types"])) or EDGES
    if unknown := [x for x in types if x not in EDGES]:
        raise NotAllowed(f"unknown relationship {unknown[0]!r}")
    low = high = 1
    if m["many"]:
        low = int(m["low"] or 1)
        high = int(m["high"]) if m["high"] else None if m["dots"] or not m["low"] else low
    if not 1 <= low <= (low if high is None else high) <= MOST_HOPS:
        raise NotAllowed(f"a hop is repeated 1 to {MOST_HOPS} times, or as often as it can be")
    return Hop(types, low, high, bool(m["back"]))


def nodes(engine, notes: DataFrame | None = None) -> DataFrame:
    """Rows id, kind, name: models, `model.part`, and notes as `memory:id`."""
    rows = []
    for name, model in sorted(engine.models.items()):
        rows.append((name, "Model", name))
        for kind, parts in (("ModelColumn", model.columns), ("Measure", model.measures), ("Aggregation", model.aggregations)):
            rows += [(f"{name}.{p.name}", kind, p.name) for p in parts]
    out = engine.spark.createDataFrame(rows, "id string, kind string, name string")
    if notes is None:
        return out
    return out.union(notes.where("id IS NOT NULL").select(_note(), F.lit("Memory"), F.col("id").cast("string")).distinct())


_EDGE = "a string, type string, b string"


def _registered(engine) -> list[tuple[str, str, str]]:
    """The edges between models and their parts."""
    rows = []
    for name, model in sorted(engine.models.items()):
        rows += [(name, "CONTAINS", f"{name}.{p.name}") for p in (*model.columns, *model.measures, *model.aggregations)]
        rows += [(name, "JOINS", j.target_model) for j in model.joins if j.target_model in engine.models]
    return rows


def _reachable(engine, hop: Hop) -> DataFrame:
    """Rows at, to: which models and parts lie some hops apart. The registry is on the driver already."""
    next_: dict[str, set[str]] = {}
    for a, kind, b in _registered(engine):
        if kind in hop.types:
            next_.setdefault(b if hop.back else a, set()).add(a if hop.back else b)
    rows = []
    for start in sorted(next_):
        seen, todo = set(), list(next_[start])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += next_.get(x, ())
        rows += [(start, x) for x in sorted(seen)]
    return engine.spark.createDataFrame(rows, "at string, to string")


def edges(engine, notes: DataFrame | None = None) -> DataFrame:
    """Rows a, type, b. Notes (id, entities) mention what they are tagged with, once for each tag."""
    out = engine.spark.createDataFrame(_registered(engine), _EDGE)
    if notes is None:
        return out
    tags = notes.where("id IS NOT NULL").select(_note().alias("a"), F.lit("MENTIONS"), F.explode("entities").alias("b"))
    return out.union(tags.where("b IS NOT NULL").distinct())


def _note():
    return F.concat(F.lit("memory:"), F.col("id").cast("string"))


def select(engine, text: str, notes: DataFrame | None = None) -> DataFrame:
    """Rows id: the nodes a pattern asks for, each once."""
    chain, hops, wanted = parse(text)
    every, links = nodes(engine, notes), edges(engine, notes)
    found = _those(every, chain[0]).select(F.col("id").alias("at"), F.col("id").alias("out"))
    for i, hop in enumerate(hops, 1):
        step = links.where(F.col("type").isin(*hop.types))
        step = step.select(F.col("b" if hop.back else "a").alias("at"), F.col("a" if hop.back else "b").alias("to")).distinct()
        reached, walk = None, found
        for k in range(1, (hop.low if hop.high is None else hop.high) + 1):
            walk = walk.join(step, "at").select(F.col("to").alias("at"), "out").distinct()
            if k >= hop.low:
                reached = walk if reached is None else reached.union(walk)
        if hop.high is None:
            # Notes only begin walks (or end them, backwards), so all steps between are among registered entities.
            on = _reachable(engine, hop)
            reached = reached.union(reached.join(on, "at").select(F.col("to").alias("at"), "out"))
            if hop.back:
                last = on.join(step.withColumnsRenamed({"at": "mid", "to": "end"}), F.col("to") == F.col("mid")).select("at", "end").distinct()
                early = found
                for _ in range(1, hop.low):
                    early = early.join(step, "at").select(F.col("to").alias("at"), "out").distinct()
                reached = reached.union(early.join(last, "at").select(F.col("end").alias("at"), "out"))
        found = reached.distinct().join(_those(every, chain[i]).select(F.col("id").alias("at")), "at", "left_semi")
        if i == wanted:
            found = found.select("at", F.col("at").alias("out")).distinct()
    return found.select(F.col("out").alias("id")).distinct()


def _those(every: DataFrame, node: Node) -> DataFrame:
    out = every.where(F.col("kind").isin(*node.kinds)) if node.kinds else every
    for column, value in node.where:
        out = out.where(F.col(column) == value)
    return out


def within(ranked: DataFrame, chosen: DataFrame) -> DataFrame:
    """A ranked list (id, score) cut down to chosen ids."""
    return ranked.join(chosen.select("id"), "id", "left_semi")
