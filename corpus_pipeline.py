"""A training corpus from raw documents: toxic ones go, repeated lines go, one of each group of near-duplicates stays,
documents with benchmark passages go, and what is left is mixed to target weights.

Each stage takes (spark, docs, sf_dir) and is written as Parquet before the next one reads it.

Defined cases: a null or empty text is scored like any other, loses no line, has no near-duplicate, holds no passage and has size 0, so the mix lists it
and takes nothing of it; a null id stays through all stages (it is no one's duplicate and counts for no line); rows that repeat an id are scored and
judged each by its text, lose the same lines, stay together in near_dedup if one of them stays, and are mixed each; a null source
is a source of its own; empty documents give no rows, empty labels a classifier that rejects nothing, an empty
benchmark rejects nothing. Other columns are carried to the last stage but one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cadenza.llm import decontam, linededup, mixing, neardup, toxicity
from cadenza.llm._io import keep, table

#: Toxicity from which a document goes: that from which op10_toxicity predicts it toxic.
TOXIC = toxicity.THRESHOLD


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled rows outside the held-out fold, doesn't reject."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), TOXIC)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that three or more of them hold, except in the last one."""
    return linededup.drop_repeated_lines(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id."""
    return neardup.drop_near_duplicates(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often the mix takes each document: doc_id, source, size, source_size, target, copies, taken."""
    return mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("decontamination", benchmark_stage),
    ("mixing", mix_stage),
]

#: SQL can't express the trained classifier; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
