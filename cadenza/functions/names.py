"""Names of aggregations and scalar functions, and which column types admit which aggregation."""

from __future__ import annotations

# Other spellings of aggregations.
ALIASES = {
    "countd": "count_distinct", "distinct_count": "count_distinct", "approx_count_distinct": "count_distinct_approx",
    "mean": "avg", "average": "avg", "stddev": "stddev_samp", "std": "stddev_samp", "var": "var_samp", "variance": "var_samp",
}
COUNTS = frozenset({"count", "count_distinct", "count_distinct_approx"})
ANY_TYPE = COUNTS | {"first", "last", "min", "max"}
TWO_COLUMNS = frozenset({"covar_samp", "covar_pop", "corr"})
NUMERIC = ANY_TYPE | TWO_COLUMNS | {
    "sum", "avg", "median", "percentile", "stddev_samp", "stddev_pop", "var_samp", "var_pop", "weighted_avg",
}
BY_TYPE = {"TEXT": ANY_TYPE, "DATE": ANY_TYPE, "TIMESTAMP": ANY_TYPE, "INT": NUMERIC, "DOUBLE": NUMERIC, "BOOLEAN": ANY_TYPE | {"sum"}}

# The scalar functions of the language, with how many arguments each takes.
SCALARS = {
    "coalesce": (1, 99), "nullif": (2, 2), "ifnull": (2, 2),
    "round": (1, 2), "abs": (1, 1), "ceil": (1, 1), "ceiling": (1, 1), "floor": (1, 1), "power": (2, 2), "pow": (2, 2),
    "sqrt": (1, 1), "exp": (1, 1), "mod": (2, 2), "sign": (1, 1), "trunc": (1, 1),
    "ln": (1, 1), "log": (1, 2), "log10": (1, 1), "log2": (1, 1),
    "greatest": (2, 99), "least": (2, 99),
    "lower": (1, 1), "upper": (1, 1), "trim": (1, 1), "ltrim": (1, 1), "rtrim": (1, 1), "replace": (3, 3),
    "substr": (2, 3), "substring": (2, 3), "instr": (2, 2), "length": (1, 1), "concat": (1, 99),
}


def aggregation_name(name: str) -> str:
    low = name.lower()
    return ALIASES.get(low, low if low in NUMERIC else name)
