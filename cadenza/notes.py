"""Notes about models, kept in a folder of Parquet files, and a search over entities and notes that joins its channels."""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph
from .errors import CadenzaError, UnknownName
from .search import cosine, fuse, tag_search, text_search

_SCHEMA = "id string, text string, entities array<string>, saved_at timestamp, gone boolean"


def resolve(engine, name: str) -> str:
    """The entity a name means: a model, `model.part`, or the one part of that name in all models; case doesn't matter."""
    wanted = name.strip().replace(":", ".").lower()
    ids = [r.id for r in graph.nodes(engine).select("id").collect()]  # the registry's own entities
    exact = [i for i in ids if i.lower() == wanted]
    found = exact or [i for i in ids if i.lower().rsplit(".", 1)[-1] == wanted]
    if len(found) == 1:
        return found[0]
    if found:
        raise UnknownName(f"{name!r} may be {', '.join(sorted(found))}")
    raise UnknownName(f"{name!r} is no model, column, measure or aggregation")


class Notes:
    """Notes tagged with entities. Saving appends; a later row of the same id replaces an earlier one."""

    def __init__(self, engine, folder: str):
        self.engine, self.folder = engine, folder.rstrip("/")

    def _append(self, row: tuple) -> None:
        self.engine.spark.createDataFrame([row], _SCHEMA).coalesce(1).write.mode("append").parquet(self.folder)

    def save(self, text: str, entities: Sequence[str] = (), id: str | None = None) -> str:
        """The note's id. Its entities have to exist."""
        if not text or not text.strip():
            raise CadenzaError("a note needs a text")
        tags = list(dict.fromkeys(resolve(self.engine, e) for e in entities))
        key = id or uuid.uuid4().hex[:12]
        self._append((key, text, tags, datetime.datetime.now(datetime.UTC), False))
        return key

    def forget(self, id: str) -> None:
        if self.all().where(F.col("id") == id).isEmpty():
            raise UnknownName(f"there is no note {id!r}")
        self._append((id, None, None, datetime.datetime.now(datetime.UTC), True))

    def all(self) -> DataFrame:
        """Rows id, text, entities of the notes that are not forgotten; of the entities those that still exist."""
        spark = self.engine.spark
        try:
            rows = spark.read.schema(_SCHEMA).parquet(self.folder)
        except AnalysisException:  # nothing was saved yet
            rows = spark.createDataFrame([], _SCHEMA)
        last = rows.groupBy("id").agg(F.max_by(F.struct("text", "entities", "gone"), F.struct("saved_at", "gone")).alias("r")).where("NOT r.gone")
        live = [r.id for r in graph.nodes(self.engine).select("id").collect()]
        return last.select("id", "r.text", F.filter("r.entities", lambda e: e.isin(*live)).alias("entities"))


def entities(engine) -> DataFrame:
    """Rows id, kind, text: names, labels and descriptions of models and their parts."""
    rows = []
    for name, model in sorted(engine.models.items()):
        rows.append((name, "Model", _words(name, model.label, model.description)))
        for kind, parts in (("ModelColumn", model.columns), ("Measure", model.measures), ("Aggregation", model.aggregations)):
            rows += [(f"{name}.{p.name}", kind, _words(name, p.name, getattr(p, "label", None), getattr(p, "description", None))) for p in parts]
    return engine.spark.createDataFrame(rows, "id string, kind string, text string")


def _words(*parts: str | None) -> str:
    return " ".join(p.replace("_", " ") for p in parts if p)


def search(
    engine, question: str, notes: Notes | None = None, about: Sequence[str] = (), kinds: Sequence[str] = (), pattern: str | None = None,
    vector: Sequence[float] | None = None, embeddings: DataFrame | None = None, top: int = 20,
) -> DataFrame:
    """Rows id, kind, score, best first: text of entities and notes, tags of notes, and embeddings (id, embedding), fused by rank.

    `about` names entities that notes may be tagged with, `kinds` and `pattern` (a graph filter) narrow the result.
    """
    every = entities(engine)
    told = notes.all() if notes else None
    if told is not None:
        every = every.unionByName(told.select(F.concat(F.lit("memory:"), "id").alias("id"), F.lit("Memory").alias("kind"), "text"))
    channels = [text_search(every, question)]
    if told is not None and about:
        tagged = told.select(F.concat(F.lit("memory:"), "id").alias("id"), "entities")
        channels.append(tag_search(tagged, [resolve(engine, a) for a in about]))
    if vector is not None and embeddings is not None:
        channels.append(cosine(embeddings, vector, 100, "id"))
    found = fuse(channels).join(every.select("id", "kind"), "id")
    if kinds:
        found = found.where(F.col("kind").isin(*kinds))
    if pattern:
        found = graph.within(found, graph.select(engine, pattern, told))
    return found.select("id", "kind", "score").orderBy(F.col("score").desc(), "id").limit(top)
