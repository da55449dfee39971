"""Every registered query of the engine against its SQL in DuckDB, on the smallest tables."""

import math
import numbers
import os

import duckdb
import pandas as pd
import pytest

from cadenza import workload, workload_forms

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()
assert workload_forms  # registers more queries
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
            return ""
        return float(x) if isinstance(x, numbers.Number) and not isinstance(x, bool) else str(x)

    made = [tuple(plain(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False)]
    return sorted(made, key=lambda r: [f"{x:.4g}" if isinstance(x, float) else x for x in r])


def same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-7)
    return a == b


@pytest.mark.parametrize("name", sorted(workload.QUERIES))
def test_query(spark, duck, name):
    got = workload.QUERIES[name](spark, FOLDER).toPandas()
    if name not in workload.ORACLE:
        assert len(got)
        return
    want = duck.sql(workload.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    left, right = rows(got), rows(want)
    assert len(left) == len(right)
    assert not [(x, y) for x, y in zip(left, right, strict=True) if not all(map(same, x, y))]
