"""Norm-bucketed search against all pairs."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tonelake.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int, score string, `group` string"
NAMES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, step=50):
    ok = [(i, [math.floor(hn.SCALE * x) for x in v], lab) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v, lab in ok:
        if i % step:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, m) for j, w, m in ok if j != i and len(w) == len(v)]
        for s, p, _ in sorted(x for x in scored if x[2] == lab)[:5]:
            hits = sorted((t, j) for t, j, m in scored if m != lab and 50 * -s <= 100 * -t <= 95 * -s)[:3]
            out += [(i, p, r, j, -s, -t) for r, (t, j) in enumerate(hits, 1)]
    return sorted(out)


def mined(spark, rows, step=50):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    return sorted(tuple(r) for r in hn.hard_negatives(df, F.col("vec_id") % step == 0).select(*NAMES).collect())


@pytest.mark.parametrize("seed", [0, 1])
def test_equals_all_pairs(spark, monkeypatch, seed):
    monkeypatch.setattr(hn, "BUCKET", 8)
    monkeypatch.setattr(hn, "TILE", 5)
    monkeypatch.setattr(hn, "STRETCH", 2)
    rng = random.Random(seed)
    rows = []
    for i in range(400):
        size = rng.choice([0.01, 0.3, 1, 1, 5])
        v = [rng.gauss(0.2, 0.3) * size for _ in range(6)]
        rows.append((i, v if rng.random() > 0.2 or i < 9 else list(rng.choice(rows)[1]), rng.choice([0, 0, 0, 1, 2])))
    got = mined(spark, rows, 10)
    assert got == brute(rows, 10) and len(got) > 50


def test_rows_out_of_the_ordinary(spark):
    rows = [(0, [1.0, 0.5], 0), (1, [1.0, 0.4], 0), (2, [0.7, 0.2], 1), (3, [0.7, 0.2], 1), (4, None, 1), (5, [None, 1.0], 1), (6, [math.nan, 1.0], 1), (7, [math.inf, 1.0], 1), (8, [0.6, 0.2], None), (None, [0.6, 0.2], 1)]
    rows += [(9, [1.0], 1), (50, [0.0, 0.0], 0), (100, [], 2), (150, [], 2), (10, [], 3), (200, [1e6, 1e6], 7), (11, [2e6, 1e6], 7), (12, [1e6, 1e6 + 0.01], 8)]
    got = mined(spark, rows)
    assert got == brute(rows)
    assert (100, 150, 1, 10, 0, 0) in got and any(r[0] == 200 for r in got)
    assert mined(spark, []) == []
    huge = mined(spark, [(0, [1e300], 0), (1, [1e308], 0), (2, [1e10], 1)])
    assert huge == []
    repeated = mined(spark, [(0, [1.0], 0), (0, [1.0], 0), (1, [1.0], 0), (2, [0.9], 1), (2, [0.9], 1)])
    assert [r[:4] for r in repeated] == [(0, 1, 1, 2), (0, 1, 1, 2), (0, 1, 2, 2), (0, 1, 2, 2)]


def test_buckets_are_left_out(spark, monkeypatch):
    """Of vectors that are too short for the window, no product is made."""
    import numpy as np

    tile = hn._Tile(1, [0], ["a"], [10.0], [hn.packed(np.array([10.0]))], [[{"key": 1, "lo": 50, "hi": 90}]], 1, False)
    made = []
    monkeypatch.setattr(hn, "products", lambda a, b, f=hn.products: made.append(len(b)) or f(a, b))
    tile.meet(9.0, [1, 2], ["b", "b"], [hn.packed(np.array([9.0])), hn.packed(np.array([8.0]))])
    tile.meet(8.0, [3], ["b"], [hn.packed(np.array([8.0]))])  # the running score is 90
    assert made == [2] and tile.rows().to_pylist() == [{"key": 1, "vec_id": 1, "score": 90}]
