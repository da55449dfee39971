"""Line dedup over levelled sorted runs of line hashes.

A run is a table of line keys, bucketed and sorted by their 128-bit hash, with the number of documents that hold each and the largest
of their ids. Documents come in batches of descending ids. A new batch merge-anti-joins the
runs: keys that are settled there (enough documents, all with larger ids) need nothing more; the rest become the batch's own run
at level 0. When a level has `FANOUT` runs, they are merged into one of the next level, so
there are never more than FANOUT runs a level and log(batches) levels. At the end all levels
are merged: a key found in at least `LEAST_DOCS` documents keeps its lines only in the document with the largest id.
All runs have the same buckets, so merges and anti-joins read them in place: only a batch's own lines are dealt.

Lines are made distinct by document, then counted within tasks before they are dealt by line, so a line that fills a third of all lines
costs each task one row there; texts are shuffled once, by id, to meet the list of their dropped keys.

Defined cases: a null or empty text is one empty line; lines under `LEAST_CHARS` code points (stripped) never
go; rows that repeat a doc_id count as one document and lose the same lines; rows with a null
doc_id stay as they are and don't count; an empty table gives no rows. Other columns are carried unread.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._io import FEW_ROWS, join_dealt, keep, keep_bucketed
from ._text import tidy

LEAST_DOCS = 3
LEAST_CHARS = 20
FANOUT = 2
#: A whole table is read in batches of so many lines, or, above `MOST_BATCHES` of these, in as many larger ones.
BATCH_LINES = 1 << 20
MOST_BATCHES = 64
_BLANK = " \t\n\x0b\x0c\r"
_UPPER = {c: c + 32 for c in range(65, 91)}


def line_keys(text: str | None) -> list[bytes | None]:
    """The hash of each line's key, None for lines too short to count."""
    keys = []
    for line in (text or "").split("\n"):
        key = line.strip(_BLANK)
        keys.append(hashlib.blake2b(key.encode("utf-8", "surrogatepass").lower(), digest_size=16).digest() if len(key) >= LEAST_CHARS else None)
    return keys


def _halves(keys: list[bytes]) -> tuple[pa.Array, pa.Array]:
    both = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
    return pa.array(both[:, 0]), pa.array(both[:, 1])


def document_lines(docs: DataFrame) -> DataFrame:
    """Rows h1, h2, doc_id: each document's distinct line keys, also when several rows have its id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = {k for k in line_keys(text.as_py()) if k}
                keys += own
                ids += [doc] * len(own)
            yield pa.RecordBatch.from_arrays([*_halves(keys), pa.array(ids, pa.int64())], ["h1", "h2", "doc_id"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")
    return own.mapInArrow(tidy(run), "h1 long, h2 long, doc_id long").distinct()


def _both(one: DataFrame, other: DataFrame) -> DataFrame:
    """Two runs merged: both are read in order of their keys."""
    joined = one.join(other.select("h1", "h2", F.col("docs").alias("_docs"), F.col("last").alias("_last")).hint("merge"), ["h1", "h2"], "full")
    docs = F.coalesce("docs", F.lit(0)) + F.coalesce("_docs", F.lit(0))
    return joined.select("h1", "h2", docs.alias("docs"), F.greatest("last", "_last").alias("last"))


class Runs:
    """The levels; `add` takes batches in descending order of doc_id, rows h1, h2, doc_id without repeats."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, least_docs: int = LEAST_DOCS):
        self.levels: list[list[DataFrame]] = []
        self.spark, self.fanout, self.least_docs = spark, fanout, least_docs
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.tables: list[str] = []

    def _run(self, rows: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        run, table = keep_bucketed(rows.select("h1", "h2", "docs", "last"), f"run-{level}", self.buckets, ["h1", "h2"])
        self.tables.append(table)
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            runs, self.levels[level] = self.levels[level], []
            self._run(reduce(_both, runs), level + 1)

    def all(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def unsettled(self, batch: DataFrame) -> DataFrame:
        """Rows of the batch whose keys the runs don't have in enough documents."""
        known = F.lit(0)
        for k, run in enumerate(self.all()):
            batch = batch.join(run.select("h1", "h2", F.col("docs").alias(f"_{k}")).hint("merge"), ["h1", "h2"], "left")
            known = known + F.coalesce(f"_{k}", F.lit(0))
        return batch.where(known < self.least_docs).select("h1", "h2", "docs", "last")

    def add(self, lines: DataFrame) -> None:
        batch = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("last"))
        self._run(self.unsettled(batch), 0)

    def repeated(self) -> DataFrame:
        """Rows h1, h2, last: the keys of at least least_docs documents."""
        return reduce(_both, self.all()).where(F.col("docs") >= self.least_docs).select("h1", "h2", "last")

    def close(self) -> None:
        """Takes the runs from the catalog; their files go with the session."""
        for table in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")


def dropped_keys(docs: DataFrame, batch_lines: int = BATCH_LINES) -> DataFrame:
    """Rows _id, _drop: for each document that loses lines, their keys (16 bytes each, on end)."""
    lines = keep(document_lines(docs), "lines")
    batches = min(MOST_BATCHES, max(1, -(-lines.count() // batch_lines)))
    cuts = [i / batches for i in range(1, batches)]
    edges = lines.agg(F.percentile_approx("doc_id", cuts, 1000)).first()[0] if cuts else []
    runs = Runs(docs.sparkSession)
    bounds = [None, *sorted(set(edges or [])), None]
    for lo, hi in list(zip(bounds[:-1], bounds[1:], strict=True))[::-1]:
        part = lines
        if lo is not None:
            part = part.where(F.col("doc_id") > lo)
        if hi is not None:
            part = part.where(F.col("doc_id") <= hi)
        runs.add(part)
    over = keep(runs.repeated(), "repeated")
    runs.close()
    met = DataFrame.join if over.count() <= FEW_ROWS else join_dealt
    gone = met(lines, over, ["h1", "h2"]).where("doc_id <> last")
    return gone.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list(F.struct("h1", "h2")).alias("_drop"))


def _cut(text: str | None, drop: list[dict] | None) -> tuple[list[str], int]:
    """The lines that stay, and how many went."""
    lines = (text or "").split("\n")
    if not drop:
        return lines, 0
    gone = {np.array([d["h1"], d["h2"]], np.int64).tobytes() for d in drop}
    stay = [line for line, key in zip(lines, line_keys(text), strict=True) if key not in gone]
    return stay, len(lines) - len(stay)


def line_report(docs: DataFrame) -> DataFrame:
    """Rows doc_id, n_lines, n_dropped, kept (the text that stays)."""
    gone = dropped_keys(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(*_cut(t.as_py(), d.as_py()),) for t, d in zip(batch.column(1), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) + n for s, n in rows], pa.int64()),
                    pa.array([n for _, n in rows], pa.int64()),
                    pa.array(["\n".join(s) for s, _ in rows], pa.string()),
                ],
                ["doc_id", "n_lines", "n_dropped", "kept"],
            )

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    joined = own.join(gone, F.col("doc_id") == F.col("_id"), "left").select("doc_id", "text", "_drop")
    return joined.mapInArrow(tidy(run), "doc_id long, n_lines long, n_dropped long, kept string")


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """The documents, with all their columns, without repeated lines; n_chars, if there, counts what stays."""
    gone = dropped_keys(docs).withColumnsRenamed({"_id": "_line_id", "_drop": "_line_drop"})
    names = docs.columns
    at, size = names.index("text"), names.index("n_chars") if "n_chars" in names else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.columns[:-1]
            kept, sizes = columns[at].to_pylist(), columns[size].to_pylist() if size >= 0 else []
            for i, drop in enumerate(batch.columns[-1]):
                if drop.is_valid:
                    kept[i] = "\n".join(_cut(kept[i], drop.as_py())[0])
                    if size >= 0:
                        sizes[i] = len(kept[i])
            columns[at] = pa.array(kept, columns[at].type)
            if size >= 0:
                columns[size] = pa.array(sizes, columns[size].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    joined = docs.join(gone, docs["doc_id"] == F.col("_line_id"), "left").drop("_line_id")
    return joined.mapInArrow(tidy(run), docs.schema)
