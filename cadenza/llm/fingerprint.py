"""Document fingerprints by consistent weighted sampling.

A text's terms are its pairs of neighbouring lower-cased words (a lone word is a term), weighted by how often they occur. For each
of `SAMPLES` samples a term draws r and c from Gamma(2, 1) and b from [0, 1), fixed by the term; with weight w
it has t = floor(ln w / r + b) and a = ln c - r (t + 1 - b), and the sample is the term and t of
least a. Two texts then agree in a sample with a probability equal to their generalised Jaccard similarity, sum of least weights by
sum of greatest. Least a stands for its term and t, so a 16-bit digest of it is kept.

The draws come from three tables of `POOL` rows each, picked by independent bits of the term's hash, so that a
draw costs a lookup rather than logarithms.

Defined cases: a null text is empty; a text without words has a fingerprint of zeros, like 1 to another such and 0 to all others;
rows that repeat a doc_id follow each other in the order of their texts; a null doc_id
comes before all others; one single row is its own next. Other columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import NONSPACE, Words, mix, ngrams, slices, strings, tidy, words

SAMPLES = 96
POOL = 1 << 12
#: Rows that lie in one range of ids, on average, at least; with more than their square there are as many ranges as rows in each.
RANGE_ROWS = 4000
_rng = np.random.default_rng(20)
_R = _rng.gamma(2, 1, (POOL, SAMPLES)).astype(np.float32) + np.float32(1e-6)
_LNC = np.log(_rng.gamma(2, 1, (POOL, SAMPLES)) + 1e-12).astype(np.float32)
_B = _rng.random((POOL, SAMPLES)).astype(np.float32)


def _terms(w: Words) -> np.ndarray:
    """A term for each word: the pair it begins, or the lone word; 0 where there is none."""
    pair = ngrams(w.hash, 2) | np.uint64(1)
    many = np.diff(w.at)
    last = w.at[1:][many > 1] - 1
    pair[last] = 0
    lone = w.at[:-1][many == 1]
    pair[lone] = mix(w.hash[lone]) | np.uint64(1)
    return pair


def samples(column: pa.Array) -> np.ndarray:
    """A row of SAMPLES 16-bit digests for each text."""
    out = np.zeros((len(column), SAMPLES), np.uint16)
    bits = np.uint64(POOL - 1)
    for lo, hi in slices(column, 1 << 18):
        w = words(column.slice(lo, hi - lo), NONSPACE)
        terms = _terms(w)
        for i, (a, b) in enumerate(zip(w.at[:-1].tolist(), w.at[1:].tolist(), strict=True)):
            if a == b:
                continue
            own = terms[a:b]
            term, weight = np.unique(own[own != 0], return_counts=True)
            least = np.full(SAMPLES, np.inf, np.float32)
            for k in range(0, len(term), 4096):
                x = term[k : k + 4096]
                r = _R[(x >> np.uint64(1)) & bits]
                b_ = _B[(x >> np.uint64(25)) & bits]
                t = np.zeros_like(r)
                heavy = np.flatnonzero(weight[k : k + 4096] > 1)
                if len(heavy):
                    t[heavy] = np.floor(np.log(weight[k : k + 4096][heavy]).astype(np.float32)[:, None] / r[heavy] + b_[heavy])
                least = np.minimum(least, (_LNC[(x >> np.uint64(45)) & bits] - r * (t + np.float32(1) - b_)).min(0))
            code = mix(least.view(np.uint32).astype(np.uint64) + (np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32)))
            out[lo + i] = (code >> np.uint64(48)).astype(np.uint16) | np.uint16(1)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal samples, row by row."""
    return (a == b).mean(-1)


def edit(text: str, following: str) -> str:
    """The text whose last quarter of code points gives way to the first as many of the next document."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def ordered(docs: DataFrame) -> DataFrame:
    """Rows doc_id, text, part, ghost, dealt into ranges of ids and sorted; each part ends in a ghost: the row that follows it."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids = own.select("doc_id")
    rows = ids.count()
    n = max(1, rows // max(RANGE_ROWS, math.isqrt(rows)))
    cuts = ids.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n)).first()[0] if n > 1 else []
    edges = np.array(sorted(set(cuts or [])), np.int64)

    @F.pandas_udf("int")
    def part(doc_id: pd.Series) -> pd.Series:
        low = doc_id.isna()
        at = np.searchsorted(edges, doc_id.fillna(0).astype("int64").to_numpy(), "left")
        return pd.Series(np.where(low, 0, at).astype(np.int32))

    first = ids.select("doc_id", part("doc_id").alias("p")).groupBy("p").agg(
        F.min("doc_id").alias("id"), F.max(F.col("doc_id").isNull()).alias("none")
    )
    starts = {r.p: (None if r.none else r.id) for r in first.collect()}  # one row for each range
    after = sorted(starts)
    before = {starts[p]: after[i - 1] for i, p in enumerate(after)}
    named = own.select("doc_id", "text", part("doc_id").alias("part"))
    known = docs.sparkSession.createDataFrame([*before.items()], "k long, g int")
    seen = named.join(F.broadcast(known), F.col("doc_id").eqNullSafe(F.col("k")), "left").drop("k")  # one row for each range
    places = F.array(F.struct(F.col("part"), F.lit(False).alias("ghost")), F.struct(F.col("g").alias("part"), F.lit(True).alias("ghost")))
    spread = seen.select("doc_id", "text", F.explode(F.when(F.col("g").isNotNull(), places).otherwise(F.slice(places, 1, 1))).alias("at"))
    dealt = spread.select("doc_id", "text", "at.part", "at.ghost").repartition("part")
    return dealt.sortWithinPartitions("part", "ghost", F.col("doc_id").asc_nulls_first(), "text")


SCHEMA = "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame) -> DataFrame:
    """For each document its fingerprint, its edited text with fingerprint, and its likeness to that and to the next document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row before, which waits for the one after it
        for batch in batches:
            for lo, hi in slices(strings(batch.column(1)), 8 << 20):
                part = batch.slice(lo, hi - lo)
                texts = strings(part.column(1))
                prints = samples(texts)
                rows = list(zip(part.column(0).to_pylist(), texts.to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist(), prints, strict=True))
                ready = []
                for row in rows:
                    # Of rows that share the id of a ghost only the first ghost is the next row.
                    if held is not None and not held[3] and held[2] == row[2]:
                        ready.append((held, row))
                    held = row
                if not ready:
                    continue
                edited = [edit(a[1], b[1]) for a, b in ready]
                new = samples(pa.array(edited, pa.string()))
                old, following = np.array([a[4] for a, _ in ready]), np.array([b[4] for _, b in ready])
                hexed = [x.astype(">u2").tobytes().hex() for x in old]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([a[0] for a, _ in ready], pa.int64()),
                        pa.array([len(a[1]) for a, _ in ready], pa.int64()),
                        pa.array(edited, pa.string()),
                        pa.array(hexed),
                        pa.array([x.astype(">u2").tobytes().hex() for x in new]),
                        pa.array(likeness(old, new)),
                        pa.array(likeness(old, following)),
                    ],
                    ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    return ordered(docs).mapInArrow(tidy(run), SCHEMA)
