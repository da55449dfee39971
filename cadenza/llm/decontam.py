"""Benchmark decontamination by a prefix-filtered set join.

Each benchmark item is cut into windows of `WINDOW` consecutive words (a shorter item is one
window). A document contains a window only if it has all of the window's shingles, so with
containment 1 the prefix that must be shared has one shingle. Shingles are ordered by how often they occur in
all documents, and the join's key is the rarest one of each window. The shingle's place
in the window fixes where the window would lie; candidates that stick out of the document
(length and positional bounds) go, and the rest are verified: the words themselves are compared.

All tables of the benchmark (windows, shingles, prefix) are DataFrames. The documents are read twice: once
to count the benchmark's shingles, once for the places that have a prefix shingle, each with the words around it. What a
task gets is a bit map of shingles, at most `FILTER_BITS` bits whatever the benchmark's size; a
place that passes it by chance finds no partner in the join. So texts are never shuffled. A side of a join
is broadcast only if it was measured to be under `SMALL_BYTES`; else the join is salted, so a passage that very many documents hold is split.

Defined cases: a null or empty text has no words and is clean; a null or empty item has no
windows; repeated documents each get a row; repeated items count once per item_id; null item_ids are
left out; an empty table of documents gives no rows, an empty benchmark no hits. Columns beyond doc_id and text don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import FEW_ROWS, MAP_BITS, BitMap, join_dealt, keep
from ._text import Words, ngrams, slices, strings, tidy, words

WINDOW = 10
SHINGLE = 3
#: Bits of the map of shingles that goes to the tasks, at most.
FILTER_BITS = MAP_BITS
#: Bytes up to which a measured side of a join is broadcast.
SMALL_BYTES = 16 << 20
#: Parts that a key is split into in joins with a larger side.
SALTS = 16


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Rows item, win (digest of the words), words, width, tokens (the window's shingles in order)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = strings(batch.column(1))
            for lo, hi in slices(column):
                w = words(column.slice(lo, hi - lo))
                out: list[list] = [[], [], [], [], []]
                for i, (a, b) in enumerate(zip(w.at[:-1].tolist(), w.at[1:].tolist(), strict=True)):
                    own = [w.word(k) for k in range(a, b)]
                    for at in range(0, max(1, len(own) - size + 1) if own else 0):
                        part = own[at : at + size]
                        width = min(SHINGLE, len(part))
                        found = ngrams(w.hash[a + at : a + at + len(part)], width)[: len(part) - width + 1]
                        row = (batch.column(0)[lo + i].as_py(), hashlib.blake2b(b" ".join(part), digest_size=16).digest(), part, width, found.view(np.int64))
                        for column_, x in zip(out, row, strict=True):
                            column_.append(x)
                kinds = (pa.string(), pa.binary(), pa.list_(pa.binary()), pa.int32(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], ["item", "win", "words", "width", "tokens"])

    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    items = items.where("item IS NOT NULL AND text IS NOT NULL")
    return items.mapInArrow(tidy(run), "item string, win binary, words array<binary>, width int, tokens array<long>")


class TokenFilter:
    """A bit map of tokens and the widths they have; `places` finds tokens that may be among them."""

    def __init__(self, tokens: DataFrame, bits: int = FILTER_BITS):
        """`tokens` has token and width."""
        seen = tokens.agg(F.count(F.lit(1)), F.collect_set("width")).first()
        self.widths = sorted(seen[1])
        self.map = BitMap(tokens.select("token"), int(seen[0]), most=bits)

    def places(self, w: Words) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each width: width, the places of tokens that pass, and the tokens there."""
        for width in self.widths:
            tokens = ngrams(w.hash, width)
            at = np.flatnonzero(self.map.among(tokens))
            doc = np.searchsorted(w.at, at, "right") - 1
            at = at[at + width <= w.at[doc + 1]]
            yield width, at, tokens[at]


def token_counts(docs: DataFrame, tokens: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """Rows token, n: how often tokens occur in all documents; also some that are not asked for."""
    among = TokenFilter(tokens, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, found = strings(batch.column(0)), [np.zeros(0, np.uint64)]
            for lo, hi in slices(column):
                found += [t for _, _, t in among.places(words(column.slice(lo, hi - lo)))]
            token, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n.astype(np.int64))], ["token", "n"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(tidy(run), "token long, n long")
    return rows.groupBy("token").agg(F.sum("n").alias("n"))


def prefixes(docs: DataFrame, cut: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """Rows token, place, win, words, width: for each distinct window its rarest shingle."""
    own = cut.dropDuplicates(["win"]).select("win", "words", "width", "tokens")
    each = own.select("win", "width", F.posexplode("tokens").alias("place", "token"))
    n = token_counts(docs, each.select("token", "width").distinct(), bits)
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "place")).alias("least")
    chosen = each.join(n, "token", "left").groupBy("win").agg(rarest).select("win", "least.token", "least.place")
    return own.select("win", "words", "width").join(chosen, "win")


def _near(docs: DataFrame, prefix: DataFrame, size: int, bits: int) -> DataFrame:
    """A row for each document (token null), and one for each place that may have a prefix shingle.

    row numbers the document; start is the place, before how many words the context begins before it, words the context; digest is the text's.
    """
    among = TokenFilter(prefix.select("token", "width").distinct(), bits)
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.binary()), pa.binary())
    names = ["row", "doc_id", "n_words", "token", "start", "before", "words", "digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            column = strings(batch.column(1))
            for lo, hi in slices(column):
                w = words(column.slice(lo, hi - lo))
                many = np.diff(w.at)
                empty = [None] * (hi - lo)
                rows = [[*range(number, number + hi - lo)], batch.column(0).slice(lo, hi - lo).to_pylist(), many.tolist(), *[[*empty] for _ in range(5)]]
                digests: dict[int, bytes] = {}
                for _, at, token in among.places(w):
                    doc = np.searchsorted(w.at, at, "right") - 1
                    low, high = np.maximum(w.at[doc], at - size + 1), np.minimum(w.at[doc + 1], at + size)
                    for d, k, t, a, b in zip(doc.tolist(), at.tolist(), token.view(np.int64).tolist(), low.tolist(), high.tolist(), strict=True):
                        if d not in digests:
                            digests[d] = hashlib.md5(column[lo + d].as_buffer()).digest()
                        row = (number + d, None, None, t, k - int(w.at[d]), k - a, [w.word(j) for j in range(a, b)], digests[d])
                        for column_, x in zip(rows, row, strict=True):
                            column_.append(x)
                number += hi - lo
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], names)

    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return keep(own.mapInArrow(tidy(run), "row long, doc_id long, n_words long, token long, start long, before int, words array<binary>, digest binary"), "places")


def _joined(many: DataFrame, few: DataFrame, key: str, weight: str, small: int) -> DataFrame:
    """Inner join by `key`; `weight` is SQL for the bytes of a row of `few`, whose sum decides how."""
    size = few.agg(F.sum(F.expr(weight))).first()[0] or 0
    if size <= small:
        return many.join(F.broadcast(few), key)  # measured
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    dealt = many.withColumn("_salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    return join_dealt(dealt, few.withColumn("_salt", salt), [key, "_salt"]).drop("_salt")


def occurrences(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, bits: int = FILTER_BITS, small: int = SMALL_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows row, doc_id, n_words of all documents; rows row, digest, start, stop, win of all occurrences; rows win, item."""
    cut = keep(windows(benchmark, size), "windows")
    prefix = keep(prefixes(docs, cut, bits), "prefix")
    near = _near(docs, prefix, size, bits)
    places = near.where("token IS NOT NULL").select("row", "digest", "token", "start", "before", F.col("words").alias("around"))
    met = _joined(places, prefix.select("token", "place", "win", "words"), "token", "40 + 24 * size(words)", small)
    inside = F.expr("place <= before AND before - place + size(words) <= size(around) AND slice(around, greatest(before - place, 0) + 1, size(words)) = words")
    found = met.where(inside).select("row", "digest", (F.col("start") - F.col("place")).alias("start"), (F.col("start") - F.col("place") + F.size("words")).alias("stop"), "win")
    return near.where("token IS NULL").select("row", "doc_id", "n_words"), keep(found, "occurrences"), cut.select("win", "item").distinct()


#: The number of words inside any of the sorted spans.
_COVERED = (
    "aggregate(sort_array(collect_set(struct(start, stop))), named_struct('upto', 0L, 'n', 0L),"
    " (s, x) -> named_struct('upto', greatest(s.upto, x.stop), 'n', s.n + greatest(x.stop - greatest(x.start, s.upto), 0L)), s -> s.n)"
)


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, bits: int = FILTER_BITS, small: int = SMALL_BYTES) -> DataFrame:
    """Rows doc_id, n_words, n_hit, items (sorted as strings): what of the benchmark each document holds."""
    every, found, named = occurrences(docs, benchmark, size, bits, small)
    hit = found.groupBy("row").agg(F.expr(_COVERED).alias("n_hit"))
    items = _joined(found.select("row", "win").distinct(), named, "win", "40 + octet_length(item)", small)
    items = items.groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    out = every.join(hit.join(items, "row"), "row", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The documents, with all their columns, in which no window of the benchmark occurs."""
    gone = keep(occurrences(docs, benchmark, size)[1].select(F.hex("digest").alias("_digest")).distinct(), "contaminated")
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    met = DataFrame.join if gone.count() <= FEW_ROWS else join_dealt
    return met(docs, gone, F.upper(F.md5(text.cast("binary"))) == F.col("_digest"), "left_anti")
