"""Transforms over the aggregated rows that are window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import CadenzaError

RANKS = {"rank": F.rank, "dense_rank": F.dense_rank, "percent_rank": F.percent_rank}


def ordered(dims: list[str], time: str) -> Window:
    return Window.partitionBy(*dims).orderBy(F.col(time).asc_nulls_last())


def whole(dims: list[str], time: str, descending: bool) -> Window:
    by = F.col(time).desc_nulls_last() if descending else F.col(time).asc_nulls_last()
    return Window.partitionBy(*dims).orderBy(by).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def window_transform(name: str, value: Column, dims: list[str], time: str, n: int = 1) -> Column:
    if name == "cumsum":
        return F.sum(value).over(ordered(dims, time))
    if name in ("lag", "lead"):
        return (F.lag if name == "lag" else F.lead)(value, abs(n)).over(ordered(dims, time))
    if name in ("first", "last"):
        return F.first(value).over(whole(dims, time, name == "last"))
    raise CadenzaError(f"{name} is no window transform")


def steps(value: str) -> Column:
    """A whole number that never falls as `value` falls to rise: equal steps of the logarithm, NaN on top, null at the bottom."""
    x = F.col(value).cast("double")
    step = F.signum(x) * F.floor(F.log2(F.abs(x) + 1) * 64)
    top = F.lit(1 << 20).cast("double")
    return F.when(x.isNull(), -top).when(F.isnan(x) | (step > top), top).when(step <= -top, -top + 1).otherwise(step).cast("long")


def ranked(df: DataFrame, name: str, value: str, parts: list[str], keys: list[str], n: int | None, out: str) -> DataFrame:
    """`df` with the rank, from the greatest value down, nulls last, within `parts`. ntile takes ties in the order of the keys.

    Numbers ranked over all rows are ranked within steps of the value, and the steps, a bounded number, are
    summed up; so no task gets all rows.
    """
    if name == "ntile" and (not isinstance(n, int) or isinstance(n, bool) or n < 1):
        raise CadenzaError("ntile needs n=, a whole number from 1 on")
    ties = [F.col(k).asc_nulls_last() for k in keys] if name == "ntile" else []
    order = [F.col(value).desc_nulls_last(), *ties]
    numeric = dict(df.dtypes)[value].startswith(("decimal", "double", "float", "bigint", "int", "smallint", "tinyint"))
    if parts or not numeric:
        over = Window.partitionBy(*parts).orderBy(*order)
        place = F.ntile(n).over(over) if name == "ntile" else RANKS[name]().over(over)
        return df.withColumn(out, place if name == "percent_rank" else place.cast("long"))
    stepped = df.withColumn("_step", steps(value))
    many = stepped.groupBy("_step").agg(F.count(F.lit(1)).alias("_rows"), F.count_distinct(F.coalesce(value, F.lit(0))).alias("_values"))
    above = Window.partitionBy().orderBy(F.col("_step").desc())  # one row for each step
    before = above.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    sums = many.select(
        F.col("_step").alias("_at"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
        F.coalesce(F.sum("_values").over(before), F.lit(0)).alias("_values_before"),
        F.sum("_rows").over(whole).alias("_all"),
    )
    within = Window.partitionBy("_step").orderBy(*order)
    joined = stepped.join(sums, F.col("_step") == F.col("_at"))
    if name == "dense_rank":
        place = F.col("_values_before") + F.dense_rank().over(within)
    elif name == "ntile":
        row, size, more = F.col("_before") + F.row_number().over(within) - 1, F.expr(f"_all div {n}"), F.expr(f"_all % {n}")
        first = more * (size + 1)  # rows in the tiles that have one more
        place = F.when(row < first, F.floor(row / (size + 1))).otherwise(more + F.floor((row - first) / F.greatest(size, F.lit(1)))) + 1
    else:
        place = F.col("_before") + F.rank().over(within)
        if name == "percent_rank":
            place = F.when(F.col("_all") > 1, (place - 1).cast("double") / (F.col("_all") - 1)).otherwise(F.lit(0.0))
    kept = joined.withColumn(out, place if name == "percent_rank" else place.cast("long"))
    return kept.select(*df.columns, out)


def streak_parts(flag: Column, dims: list[str], time: str) -> tuple[Column, str]:
    """The number of breaks so far, which makes groups; the streak is the count of trues within a group so far."""
    return F.sum(F.when(flag, 0).otherwise(1)).over(ordered(dims, time).rowsBetween(Window.unboundedPreceding, 0)), time


def streak(flag: Column, group: str, dims: list[str], time: str) -> Column:
    over = ordered([*dims, group], time).rowsBetween(Window.unboundedPreceding, 0)
    return F.when(flag, F.sum(F.when(flag, 1).otherwise(0)).over(over)).otherwise(0)
