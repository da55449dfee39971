"""Ranked retrieval: BM25+ over tags, BM25 over texts, cosine over embeddings, and their fusion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B, DELTA = 1.5, 0.75, 1.0


def terms_of(text: Column) -> Column:
    """Lower-cased words with a plural or -ing ending taken off."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 0)
    return F.transform(words, lambda w: F.regexp_replace(w, "(?<=...)(ing|es|s)$", ""))


def bm25(docs: DataFrame, id_: str, terms: Column, wanted: Sequence[str], plus: bool = True) -> DataFrame:
    """Rows id, score for documents with at least one wanted term; statistics are over all documents.

    Only the wanted terms are exploded: lengths and document frequencies come from one aggregate each.
    """
    wanted = sorted(set(wanted))
    base = docs.select(F.col(id_).alias("id"), terms.alias("terms")).withColumn("len", F.size("terms"))
    totals = base.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"))
    own = F.filter("terms", lambda t: t.isin(*wanted))
    hits = base.select("id", "len", F.explode(own).alias("term")).groupBy("id", "len", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # a row for each wanted term at most
    scored = hits.join(F.broadcast(df), "term").crossJoin(F.broadcast(totals))  # totals is one row
    norm = K1 * (1 - B + B * F.col("len") / F.col("avg_len"))
    idf = F.log((F.col("n") + 1) / F.col("df")) if plus else F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * ((DELTA if plus else 0.0) + F.col("tf") * (K1 + 1) / (norm + F.col("tf")))
    if not plus:
        return scored.groupBy("id").agg(F.sum(part).alias("score"))
    # BM25+ gives every wanted term its floor, also where a document doesn't have it.
    floor = df.crossJoin(totals).agg(F.sum(F.log((F.col("n") + 1) / F.col("df"))).alias("floor"))
    above = idf * F.col("tf") * (K1 + 1) / (norm + F.col("tf"))
    return scored.groupBy("id").agg(F.sum(above).alias("s")).crossJoin(F.broadcast(floor)).select("id", (F.col("s") + DELTA * F.col("floor")).alias("score"))


def tag_search(notes: DataFrame, entities: Sequence[str], id_: str = "id", tags: str = "entities") -> DataFrame:
    """BM25+ of notes by the entities they are tagged with (each tag counts once)."""
    return bm25(notes, id_, F.array_distinct(F.coalesce(F.col(tags), F.array())), entities)


def text_search(docs: DataFrame, query: str, id_: str = "id", text: str = "text") -> DataFrame:
    """BM25 of texts by the words of a query."""
    words = docs.sparkSession.range(1).select(terms_of(F.lit(query)).alias("t")).first()[0]
    return bm25(docs, id_, terms_of(F.col(text)), words, plus=False)


def cosine(docs: DataFrame, vector: Sequence[float], top: int, id_: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The `top` nearest rows by cosine, ties by id."""
    q = F.array(*[F.lit(float(x)) for x in vector])
    v = F.transform(F.col(column), lambda x: x.cast("double"))
    dot = F.aggregate(F.zip_with(v, q, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)) * float(sum(x * x for x in vector) ** 0.5)
    scored = docs.select(F.col(id_).alias("id"), F.try_divide(dot, size).alias("score")).where("score IS NOT NULL")
    return scored.orderBy(F.col("score").desc(), "id").limit(top)


def fuse(rankings: Sequence[DataFrame], k: int = 60, top: int = 100) -> DataFrame:
    """Reciprocal rank fusion of scored lists (id, score), each cut at its `top` best."""
    parts = []
    for r in rankings:
        best = r.orderBy(F.col("score").desc(), "id").limit(top)
        rank = F.row_number().over(Window.orderBy(F.col("score").desc(), F.col("id")))  # `top` rows
        parts.append(best.select("id", (1.0 / (k + rank)).alias("part")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("id").agg(F.sum("part").alias("score"))


def of_kinds(rows: DataFrame, kinds: Sequence[str], column: str = "kind") -> DataFrame:
    """Only entities of these kinds."""
    return rows.filter(F.col(column).isin(*kinds))
