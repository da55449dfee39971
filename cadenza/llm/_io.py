"""Shared intermediate tables, scans, and small relational helpers."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. In local mode, where all run on one machine, one is made if it is unset."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[[^,]*\])?$", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="cadenza-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir() or folder
    return folder.rstrip("/")


def keep(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read again: lineage ends there.

    The files outlive the loss of any executor. They go when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = _new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keep_bucketed(df: DataFrame, name: str, buckets: int, keys: list[str]) -> tuple[DataFrame, str]:
    """Like `keep`, as a table whose buckets joins by the keys read in place; also its name, to be dropped from the catalog."""
    spark = df.sparkSession
    path = _new_path(spark, name)
    table_name = "cadenza_" + re.sub(r"\W", "_", path.rsplit("/", 1)[1])
    df.write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(table_name)
    return spark.table(table_name), table_name


#: Bits of a map that goes to the tasks, at most (32 MB).
MAP_BITS = 28


class BitMap:
    """Which of 64-bit hashes may be among those of a column: a map of bounded size, put together in the cluster."""

    def __init__(self, hashes: DataFrame, rows: int, each: int = 256, most: int = MAP_BITS):
        """`hashes` has one column of longs and `rows` rows; `each` is how many bits a row has, while there is room."""
        self.bits = min(most, max(16, (rows * each).bit_length()))
        slot = F.shiftrightunsigned(F.col(hashes.columns[0]), 64 - self.bits)
        one = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(`{hashes.columns[0]}`, {64 - self.bits}) & 63 as int))")
        got = hashes.groupBy(F.shiftrightunsigned(slot, 6).alias("at")).agg(F.bit_or(one).alias("word")).toArrow()  # 2 ** (bits - 6) rows at most
        self.map = np.zeros(1 << (self.bits - 6), np.uint64)
        self.map[got["at"].to_numpy()] = got["word"].to_numpy().view(np.uint64)

    def among(self, hashes: np.ndarray) -> np.ndarray:
        """A mark for each hash that passes; all that are in the column do."""
        slot = hashes >> np.uint64(64 - self.bits)
        return (self.map[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


def join_dealt(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join of sides that grow with the input: both are dealt and sorted, neither is broadcast.

    Spark sizes a table by its files, which are compressed, and takes an explode for as large as what it explodes; so it would broadcast
    sides of many times its threshold.
    """
    return left.join(right.hint("merge"), on, how)


#: Rows of a side that was counted up to which Spark may broadcast it (a few MB of numbers).
FEW_ROWS = 1 << 17


def _new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that goes when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of links (a, b) of any type with an order: rows (node, label), label the smallest node reachable.

    Alternates the large-star and small-star steps, each a minimum by node joined
    back to the links, until the links no longer change. All of it is distributed; the driver
    sees a count and a checksum for each round, and no more than `FEW_ROWS` links are broadcast. No links give no rows.
    """
    now = keep(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links"
    )
    before = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first()
        if tuple(seen) == before or not seen[0]:
            break
        before = tuple(seen)
        met = DataFrame.join if seen[0] <= FEW_ROWS else join_dealt
        both = now.union(now.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = met(both, least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = keep(large.where("a <> b").distinct(), "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = met(large, least, "a")
        now = keep(
            small.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(small.select("a", "m"))
            .where("a <> b")
            .distinct(),
            "small-star",
        )
    return now.groupBy("a").agg(F.min("b").alias("label")).select(F.col("a").alias("node"), "label").union(
        now.select("b", "b").distinct()
    ).groupBy("node").agg(F.min("label").alias("label"))
