"""Time buckets, intervals and periods."""

from __future__ import annotations

import datetime
import math
import re

from ..errors import CadenzaError

GRANULARITIES = ("second", "minute", "hour", "day", "week", "week_sunday", "month", "quarter", "year")
_UNIT = {"week_sunday": ("WEEK", 1), "quarter": ("MONTH", 3)}
_FIXED = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800, "week_sunday": 604800}
_MONTHS = {"month": 1, "quarter": 3, "year": 12}
# The letters of a duration.
_LETTERS = (("y", "YEAR"), ("min", "MINUTE"), ("m", "MONTH"), ("w", "WEEK"), ("d", "DAY"), ("h", "HOUR"), ("s", "SECOND"))


def bucket_sql(granularity: str, time: str) -> str:
    """The start of the period that `time` is in, as timestamp without time zone."""
    if granularity == "week_sunday":
        return f"(CAST(date_trunc('WEEK', {time} + INTERVAL '1' DAY) AS TIMESTAMP_NTZ) - INTERVAL '1' DAY)"
    return f"CAST(date_trunc('{granularity.upper()}', {time}) AS TIMESTAMP_NTZ)"


def moved_sql(time: str, n: int, granularity: str) -> str:
    """`time` moved by n units of the granularity; month ends are kept inside the month."""
    unit, factor = _UNIT.get(granularity, (granularity.upper(), 1))
    return f"(CAST({time} AS TIMESTAMP_NTZ) + INTERVAL '{n * factor}' {unit})"


def steps_sql(granularity: str) -> str:
    unit, factor = _UNIT.get(granularity, (granularity.upper(), 1))
    return f"INTERVAL '{factor}' {unit}"


def aligned(bucket: str, shift: str) -> bool:
    """Whether moving by the shift maps whole buckets to whole buckets."""
    if bucket in _FIXED and shift in _FIXED:
        return _FIXED[shift] % _FIXED[bucket] == 0
    return bucket in _MONTHS and shift in _MONTHS and _MONTHS[shift] % _MONTHS[bucket] == 0


def duration(text: str) -> list[tuple[int, str]]:
    """1y2m3w5d6h7min8s as a list of amounts and units."""
    parts, at = [], 0
    pattern = re.compile(r"(\d+)\s*(" + "|".join(sorted((a for a, _ in _LETTERS), key=len, reverse=True)) + r")\s*", re.I)
    text = text.strip()
    while at < len(text):
        m = pattern.match(text, at)
        if not m or int(m[1]) < 1:
            raise CadenzaError(f"{text!r} is no duration such as 90d or 1y6m")
        parts.append((int(m[1]), dict(_LETTERS)[m[2].lower()]))
        at = m.end()
    if not parts:
        raise CadenzaError("an empty duration")
    return parts


def earlier_sql(time: str, parts: list[tuple[int, str]], sign: str = "-") -> str:
    for n, unit in parts:
        time = f"({time} {sign} INTERVAL '{n}' {unit})"
    return time


def widened(day: datetime.date, parts: list[tuple[int, str]], sign: int) -> datetime.date:
    """A day at or beyond `day` moved by the parts (amount, unit or granularity); month ends and times of day are allowed for."""
    days, months = 2, 0
    for n, unit in parts:
        name = {"WEEK_SUNDAY": "WEEK", "QUARTER": "MONTH"}.get(unit.upper(), unit.upper())
        n = n * 3 if unit.upper() == "QUARTER" else n
        if name in ("YEAR", "MONTH"):
            months += n * (12 if name == "YEAR" else 1)
        else:
            days += n * 7 if name == "WEEK" else n if name == "DAY" else math.ceil(n * _FIXED[name.lower()] / 86400)
    if months:
        days += 3 + abs(months) // 1200
        at = day.year * 12 + day.month - 1 + sign * months
        day = datetime.date(at // 12, at % 12 + 1, min(day.day, 28))
        days += 3
    return day + datetime.timedelta(sign * days)


def period_start(day: datetime.date, granularity: str) -> datetime.date:
    if granularity == "week":
        return day - datetime.timedelta(day.weekday())
    if granularity == "week_sunday":
        return day - datetime.timedelta((day.weekday() + 1) % 7)
    if granularity in _MONTHS:
        n = _MONTHS[granularity]
        return datetime.date(day.year, (day.month - 1) // n * n + 1, 1)
    return day


def period_end(day: datetime.date, granularity: str) -> datetime.date:
    """The last day of the period that `day` is in."""
    start = period_start(day, granularity)
    if granularity in ("week", "week_sunday"):
        return start + datetime.timedelta(6)
    if granularity in _MONTHS:
        months = start.year * 12 + start.month - 1 + _MONTHS[granularity]
        return datetime.date(months // 12, months % 12 + 1, 1) - datetime.timedelta(1)
    return day
