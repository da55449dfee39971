"""Number formats of result columns."""

from __future__ import annotations

from .. import dsl


def format_of(column: dict) -> str | None:
    """integer, float or percent by what the measure is; None for dimensions."""
    node = column.get("node")
    if column.get("role") != "measure":
        return None
    if isinstance(node, dsl.Agg):
        return "integer" if node.name.startswith("count") else "float"
    if isinstance(node, dsl.Call):
        if node.name in ("change_pct", "percent_rank"):
            return "percent"
        if node.name in ("rank", "dense_rank", "ntile", "consecutive_periods"):
            return "integer"
    return "float"


def formatted(value, kind: str | None) -> str:
    if value is None:
        return ""
    if kind == "percent":
        return f"{value:.1%}"
    if kind == "integer" and isinstance(value, (int, float)):
        return f"{value:,.0f}"
    if kind == "currency":
        return scaled(value, "$")
    if kind == "float" and isinstance(value, float):
        return f"{value:,.2f}"
    return str(value)


def scaled(value: float, sign: str = "") -> str:
    """1234567 as 1.2M."""
    for size, letter in ((1e9, "B"), (1e6, "M"), (1e3, "K")):
        if abs(value) >= size:
            return f"{sign}{value / size:.1f}{letter}"
    return f"{sign}{value:,.2f}"
