"""Exact continuous percentiles without a group's values in one buffer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import steps


def quantile(rows: DataFrame, keys: list[str], p: float, out: str) -> DataFrame:
    """The keys with the p-th percentile of _value, interpolated between the two values around its place.

    Values are counted by steps (a bounded number for each group), which says in which step the place lies;
    only that step's distinct values are counted and sorted. Both counts have map-side partials.
    """
    values = rows.where("_value IS NOT NULL").select(*keys, F.col("_value").cast("double").alias("_value"))
    stepped = values.withColumn("_step", steps("_value"))
    each = stepped.groupBy(*keys, "_step").agg(F.count(F.lit(1)).alias("_n"))
    by_step = Window.partitionBy(*keys).orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)
    place = (F.sum("_n").over(Window.partitionBy(*keys)) - 1) * F.lit(p)
    each = each.select(*keys, "_step", "_n", F.coalesce(F.sum("_n").over(by_step), F.lit(0)).alias("_before"), place.alias("_place"))
    holds = (F.floor("_place") < F.col("_before") + F.col("_n")) & (F.ceil("_place") >= F.col("_before"))
    wanted = each.where(holds).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_step").alias("_at"), "_before", "_place")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    inside = stepped.join(wanted, [*same, F.col("_step") == F.col("_at")])
    counted = inside.groupBy(*keys, "_step", "_before", "_place", "_value").agg(F.count(F.lit(1)).alias("_n"))
    by_value = Window.partitionBy(*keys, "_step").orderBy("_value").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("_before") + F.coalesce(F.sum("_n").over(by_value), F.lit(0))
    spans = counted.select(*keys, "_value", "_place", first.alias("_from"), (first + F.col("_n")).alias("_to"))

    def at(which) -> Column:
        return F.max(F.when((which("_place") >= F.col("_from")) & (which("_place") < F.col("_to")), F.col("_value")))

    ends = spans.groupBy(*keys).agg(at(F.floor).alias("_low"), at(F.ceil).alias("_high"), F.max("_place").alias("_place"))
    between = (F.ceil("_place") - F.col("_place")) * F.col("_low") + (F.col("_place") - F.floor("_place")) * F.col("_high")
    return ends.select(*keys, F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(between).alias(out))
