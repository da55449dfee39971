"""Scalar operators and functions as Column expressions. Division by zero gives NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import CadenzaError, NotAllowed
from .names import SCALARS


def operate(op: str, args: list[Column]) -> Column:
    a = args[0]
    if op == "not":
        return ~a
    if op == "neg":
        return -a
    b = args[1]
    if op == "/":
        return F.try_divide(a.cast("double"), b.cast("double"))
    if op == "%":
        return F.when(b != 0, a % F.when(b != 0, b))
    table = {
        "+": a.__add__, "-": a.__sub__, "*": a.__mul__, "**": lambda y: F.pow(a, y), "||": lambda y: F.concat(a, y),
        "=": a.__eq__, "<>": a.__ne__, "<": a.__lt__, "<=": a.__le__, ">": a.__gt__, ">=": a.__ge__, "and": a.__and__, "or": a.__or__,
    }
    return table[op](b)


def call(name: str, args: list[Column], literals: list) -> Column:
    low, high = SCALARS[name]
    if not low <= len(args) <= high:
        raise NotAllowed(f"{name} takes {low}{'' if low == high else f' to {high}'} arguments")
    if name == "trunc":
        return F.signum(args[0]) * F.floor(F.abs(args[0]))
    if name == "round" and len(args) == 2:
        return F.round(args[0], _whole(name, literals[1]))
    if name == "mod":
        return operate("%", args)
    if name == "log":
        return F.call_function("ln" if len(args) == 1 else "log", *args)
    spark_name = {"ceiling": "ceil", "pow": "power", "sign": "signum"}.get(name, name)
    return F.call_function(spark_name, *args)


def _whole(name: str, value) -> int:
    if not isinstance(value, int):
        raise CadenzaError(f"{name} takes a whole number of digits")
    return value
