"""Every query with SQL against DuckDB on the same tables, and the others for rows."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from tonelake.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*' if os.path.isdir(path) else path}')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool) or not isinstance(v, (int, float)):
        return str(v)
    return f"{round(float(v), 4) + 0.0:.4f}"


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in values)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = df.collect()
    if name not in registry.ORACLE_SQL:
        assert got
        return
    want = duck.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    a, b = rows(df.columns, got), rows(names, want.fetchall())
    assert len(a) == len(b)
    assert not [x for x in zip(a, b) if x[0] != x[1] and any(p != q and not near(p, q) for p, q in zip(*x))]


def near(p: str, q: str) -> bool:
    try:
        return abs(float(p) - float(q)) <= 2e-4
    except ValueError:
        return False
