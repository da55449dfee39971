"""Column profiles: the most frequent values of categories, the range of numbers and times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.relation import Relation

TOP = 50


def profile(engine, model, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows column, type, n_distinct (categories with up to TOP values), low, high, values (by count, then value).

    All ranges come from one aggregate; each category takes one grouped top list.
    """
    names = list(columns or [c.name for c in model.columns] or engine.physical_columns(model))
    rel = Relation(engine, model)
    sql = {n: rel.column_sql((), n) for n in names}
    kinds = {n: engine.column_type(model, n) for n in names}
    df = rel.frame().select(*[F.expr(s).alias(n) for n, s in sql.items()])
    ranged = [n for n in names if kinds[n] not in ("TEXT", "BOOLEAN")]
    shape = "column string, type string, n_distinct bigint, low string, high string, values array<string>"
    out = None
    if ranged:
        ends = df.agg(*[f(F.col(f"`{n}`")).cast("string").alias(f"{k}_{i}") for i, n in enumerate(ranged) for f, k in ((F.min, "lo"), (F.max, "hi"))])
        rows = F.array(*[F.struct(F.lit(n).alias("column"), F.lit(kinds[n]).alias("type"), F.col(f"lo_{i}").alias("low"), F.col(f"hi_{i}").alias("high")) for i, n in enumerate(ranged)])
        flat = ends.select(F.explode(rows).alias("r")).select("r.column", "r.type", F.lit(None).cast("bigint").alias("n_distinct"), "r.low", "r.high", F.lit(None).cast("array<string>").alias("values"))
        out = flat
    for n in names:
        if n in ranged:
            continue
        counts = df.where(F.col(f"`{n}`").isNotNull()).groupBy(F.col(f"`{n}`").cast("string").alias("v")).count()
        top = counts.orderBy(F.col("count").desc(), "v").limit(TOP + 1).agg(
            F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("c"), "v"))).alias("l")
        )
        row = top.select(
            F.lit(n).alias("column"), F.lit(kinds[n]).alias("type"), F.when(F.col("n") <= TOP, F.col("n")).alias("n_distinct"),
            F.lit(None).cast("string").alias("low"), F.lit(None).cast("string").alias("high"), F.expr(f"slice(transform(l, x -> x.v), 1, {TOP})").alias("values"),
        )
        out = row if out is None else out.unionByName(row)
    return out if out is not None else engine.spark.createDataFrame([], shape)
