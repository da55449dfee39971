"""Trailing windows: for each bucket the rows in [end - w, end), as an equi-join and not a range join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import bucket_sql, duration, earlier_sql, steps_sql

_DAYS = {"YEAR", "MONTH", "WEEK", "DAY"}


def trailing(rows: DataFrame, spine: DataFrame, keys: list[str], bucket: str, granularity: str, window: str, agg: str, out: str) -> DataFrame:
    """The spine's keys with the sum or average of _value over the window that ends with each bucket.

    `rows` has the keys other than the bucket, _time and _value. Windows and buckets of whole days are
    first summed by day, so a row is spread over its buckets only after that.
    """
    parts = duration(window)
    days = granularity in ("day", "week", "week_sunday", "month", "quarter", "year") and all(u in _DAYS for _, u in parts)
    time = "CAST(date_trunc('DAY', _time) AS TIMESTAMP_NTZ)" if days else "CAST(_time AS TIMESTAMP_NTZ)"
    others = [k for k in keys if k != bucket]
    summed = rows.where("_time IS NOT NULL").groupBy(*others, F.expr(time).alias("_at"))
    summed = summed.agg(F.sum("_value").alias("_sum"), F.count("_value").alias("_n"))
    # Months have no inverse (Mar 31 - 1 month is Feb 29), so the last bucket is looked for with a margin.
    pad = " + INTERVAL '3' DAY" if any(u in ("YEAR", "MONTH") for _, u in parts) else ""
    first, last = bucket_sql(granularity, "_at"), bucket_sql(granularity, earlier_sql("_at", parts, "+") + pad)
    spread = summed.select("*", F.explode(F.expr(f"sequence({first}, {last}, {steps_sql(granularity)})")).alias(bucket))
    end = f"(`{bucket}` + {steps_sql(granularity)})"
    inside = spread.where(F.expr(f"_at < {end} AND _at >= {earlier_sql(end, parts)}"))
    total = inside.groupBy(*keys).agg(F.sum("_sum").alias("_sum"), F.sum("_n").alias("_n"))
    value = F.expr("_sum") if agg == "sum" else F.expr("try_divide(CAST(_sum AS DOUBLE), CAST(_n AS DOUBLE))")
    total = total.select(*[F.col(k).alias(f"_{k}") for k in keys], "_sum", "_n")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return spine.join(total, same, "left").select(*keys, value.alias(out))
