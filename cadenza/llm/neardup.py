"""MinHash near-duplicates with tensored banding.

A document's set is its distinct five-word shingles. Two collections U and V of `HALVES` half keys
are made, each half key of `ROWS` minhashes; table (i, j) is keyed by U_i with V_j. So HALVES ** 2 tables cost
2 * HALVES * ROWS minhashes instead of 2 * HALVES ** 2 * ROWS. Two sets of similarity s share a
table with probability (1 - (1 - s ** ROWS) ** HALVES) ** 2: 0.9988 at 0.75 itself, above 0.9999 from 0.8 on.

Candidates, without pairs of a whole bucket:
1. Equal sets, by a 128-bit digest of the set, are one class; only classes go on, under numbers given as they are written.
2. Each table key with several classes is a star around the one with the smallest number: linear in rows.
   Star pairs are verified on full sets, and verified links joined into components. The pairs of a centre are dealt
   over as many parts as it has `CENTRE` pairs, so a large group of near copies is not one task's work.
3. A key whose members other than the centre are then in one component has nothing left to tell. Those of the others
   meet by that same table key, once for each pair of different components (in the first table they share), if
   their lengths allow the similarity. The join's own condition verifies the full
   sets, so it only gives out links. Nothing is capped; large joins are split by AQE. No side of them is broadcast.
Texts aren't shuffled: a bit map of bounded size says which ids may be asked for, and only what passes it goes on to the exact join.
Components are found by the distributed large-star/small-star rounds of `_io.components`.

Words and shingles stand as 64-bit hashes (of words: two polynomials modulo primes, so no word is made to equal another by how
it is built), equal sets as 128-bit digests.

Defined cases: a null or empty text, or one without words, has an empty set and is linked with nothing; a text of fewer
than five words is one shingle; rows that repeat a doc_id are rows of their own: each is linked by its own text, equal ones share a
component; a null doc_id is linked with nothing and kept; an empty table gives no rows. Other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import BitMap, components, join_dealt, keep
from ._text import NONSPACE, mix, shingle_sets, slices, strings, tidy, words

SHINGLE = 5
PERCENT = 75
ROWS, HALVES = 2, 9
#: Pairs of a star that one part of its centre verifies.
CENTRE = 256
_N = 2 * ROWS * HALVES
_ODD = mix(np.arange(1, _N + 1, dtype=np.uint64)) | np.uint64(1)
_XOR = mix(np.arange(1001, _N + 1001, dtype=np.uint64))


def half_keys(sets: list[np.ndarray]) -> np.ndarray:
    """For each set (none empty) its 2 * HALVES half keys."""
    all_, begin = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    keys = np.zeros((len(sets), 2 * HALVES), np.uint64)
    for h in range(_N):
        least = np.minimum.reduceat((all_ ^ _XOR[h]) * _ODD[h], begin)
        keys[:, h // ROWS] = mix(keys[:, h // ROWS] * np.uint64(31) + least)
    return keys


def _sets(column: pa.Array) -> Iterator[list[np.ndarray]]:
    for lo, hi in slices(column):
        yield shingle_sets(words(column.slice(lo, hi - lo), NONSPACE), SHINGLE)


def _digest(set_: np.ndarray) -> bytes:
    return hashlib.blake2b(set_.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame) -> DataFrame:
    """Rows doc_id, n (set size), digest of the set, u and v (half keys; empty for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digest, u, v = [], [], [], []
            for sets in _sets(strings(batch.column(1))):
                some = [s for s in sets if len(s)]
                keys = iter(half_keys(some).view(np.int64) if some else ())
                for s in sets:
                    own = next(keys) if len(s) else np.zeros(0, np.int64)
                    n.append(len(s))
                    digest.append(_digest(s))
                    u.append(own[:HALVES])
                    v.append(own[HALVES:])
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(u, lists), pa.array(v, lists)],
                ["doc_id", "n", "digest", "u", "v"],
            )

    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return own.mapInArrow(tidy(run), "doc_id long, n long, digest binary, u array<long>, v array<long>")


def full_sets(docs: DataFrame, some: BitMap) -> DataFrame:
    """Of the documents (id, text) whose id's hash passes `some` rows digest, set: the sorted shingle hashes of each text that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.filter(pa.array(some.among(batch.column(0).to_numpy().view(np.uint64))))
            rows = [s for sets in _sets(strings(wanted.column(1))) for s in sets if len(s)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([_digest(s) for s in rows], pa.binary()), pa.array([s.view(np.int64) for s in rows], pa.list_(pa.int64()))], ["digest", "set"]
            )

    return docs.where("id IS NOT NULL").select(F.xxhash64("id"), "text").mapInArrow(tidy(run), "digest binary, set array<long>")


def _similar(a: str, b: str) -> str:
    both = f"size(array_intersect({a}, {b}))"
    return f"{both} * {100 + PERCENT}L >= {PERCENT}L * (size({a}) + size({b}))"


def _lengths(a: str, b: str) -> str:
    return f"least({a}, {b}) * 100L >= {PERCENT}L * greatest({a}, {b})"


def _verified(star: DataFrame, sets: DataFrame, centre: int = CENTRE) -> DataFrame:
    """Of pairs a (a centre), b the ones whose full sets are similar. `sets` has the name of a set and the set."""
    sets = sets.toDF("name", "set")
    parts = keep(star.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / centre).cast("int").alias("parts")), "centres")
    left = join_dealt(sets.select(F.col("name").alias("a"), F.col("set").alias("set_a")), parts, "a")
    left = left.select("a", "set_a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    right = sets.select(F.col("name").alias("b"), F.col("set").alias("set_b"))
    pairs = join_dealt(star, parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    return join_dealt(join_dealt(pairs, right, "b"), left, ["a", "part"]).where(F.expr(_similar("set_a", "set_b"))).select("a", "b")


def classes(docs: DataFrame) -> DataFrame:
    """Rows doc_id, n (set size), component (smallest doc_id reachable; the own one without links)."""
    sig = keep(signatures(docs), "signatures")
    named = sig.where("n > 0 AND doc_id IS NOT NULL")
    # Written, so that the joins with it deal both sides afresh and a class of very many copies can be split, and the numbers stay.
    heads = named.groupBy("digest", "n").agg(F.min("doc_id").alias("rep"), F.any_value("u").alias("u"), F.any_value("v").alias("v"))
    heads = keep(heads.withColumn("own", F.monotonically_increasing_id()), "classes")
    tables = heads.select("own", F.posexplode("u").alias("i", "x"), "v")
    tables = tables.select("own", "i", "x", F.posexplode("v").alias("j", "y"))
    rows = tables.select("own", F.xxhash64("i", "x", "j", "y").alias("key"))
    shared = rows.groupBy("key").agg(F.min("own").alias("head"), F.count(F.lit(1)).alias("many")).where("many > 1")
    live = keep(join_dealt(rows, shared.select("key", "head"), "key"), "live")
    known = keep(join_dealt(heads, live.select("own").distinct(), "own", "left_semi").select("own", "digest", "rep", "n", "u", "v"), "known")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    of_live = full_sets(texts, BitMap(known.select(F.xxhash64("rep")), known.count()))
    of_live = of_live.groupBy("digest").agg(F.any_value("set").alias("set"))
    sets = keep(join_dealt(of_live, known.select("digest", "own", "n", "u", "v"), "digest").select("own", "n", "u", "v", "set"), "sets")
    star = live.where("own <> head").select(F.col("head").alias("a"), F.col("own").alias("b")).distinct()
    for side in ("a", "b"):
        star = join_dealt(star, known.select(F.col("own").alias(side), F.col("n").alias(f"n_{side}")), side)
    links = keep(_verified(keep(star.where(_lengths("n_a", "n_b")).select("a", "b"), "stars"), sets.select("own", "set")), "star-links")
    label = keep(components(links), "components")
    # Keys with members in several components: those members meet again, table by table. Pairs with the head are done.
    named_live = join_dealt(live.where("own <> head"), label, F.col("own") == F.col("node"), "left").select("key", "own", F.coalesce("label", "own").alias("comp"))
    mixed = named_live.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    some = keep(join_dealt(named_live, mixed.select("key"), "key"), "open")
    wide = join_dealt(some, sets, "own")
    a, b = wide.alias("a"), wide.alias("b")

    def first(side: str) -> str:
        """The first place where both have the same half key, and that key."""
        at = f"cast(array_position(zip_with(a.{side}, b.{side}, (p, q) -> p = q), true) - 1 as int)"
        return f"{at}, get(a.{side}, {at})"

    met = (
        "a.key = b.key AND a.own < b.own AND a.comp <> b.comp AND " + _lengths("a.n", "b.n")
        + f" AND xxhash64({first('u')}, {first('v')}) = a.key AND " + _similar("a.set", "b.set")
    )
    more = keep(join_dealt(a, b, F.expr(met)).select(F.col("a.own").alias("a"), F.col("b.own").alias("b")), "more-links")
    if not more.isEmpty():
        label = keep(components(links.union(more)), "components")
    least = join_dealt(heads, label, F.col("own") == F.col("node")).groupBy("label").agg(F.min("rep").alias("component"))
    of_class = join_dealt(heads, join_dealt(label, least, "label").select("node", "component"), F.col("own") == F.col("node"), "left")
    of_class = keep(of_class.select(F.col("digest").alias("_digest"), F.coalesce("component", "rep").alias("component")), "labels")
    out = join_dealt(sig.select("doc_id", "n", "digest"), of_class, F.col("digest") == F.col("_digest"), "left")
    linked = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    return out.select("doc_id", "n", F.when(linked, F.col("component")).otherwise(F.col("doc_id")).alias("component"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The documents, with all their columns, of each component only the one with the smallest id.

    Of rows that repeat a doc_id all stay if one does.
    """
    found = classes(docs).groupBy("doc_id").agg(F.min("component").alias("least"), F.max("component").alias("most"))
    gone = keep(found.where("doc_id <> most").select(F.col("doc_id").alias("_near_id")), "gone")
    some = BitMap(gone.select(F.xxhash64("_near_id")), gone.count())
    among = F.pandas_udf(lambda hashes: pd.Series(some.among(hashes.to_numpy().view(np.uint64))), "boolean")
    passes = among(F.xxhash64(docs["doc_id"].cast("long")))
    # Only rows that may have to go, a few more than those that do, are dealt out for the exact join.
    asked = docs.where(passes)
    return docs.where(~passes).union(join_dealt(asked, gone, asked["doc_id"] == F.col("_near_id"), "left_anti"))
