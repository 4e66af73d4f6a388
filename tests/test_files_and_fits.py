"""Preset files, closures and leaves of any depth, and bounded fits."""

from __future__ import annotations

import itertools
import os
import random

import numpy as np
import pytest

from tonelake.operators import inversion, space
from tonelake.sources import documents, preset_files, presets


def test_files_round_trip(spark, tmp_path):
    preset_files.register(spark)
    rng = random.Random(1)
    want = {f"{k % 3}/preset {k}.bin": rng.randbytes(rng.randrange(0, 300)) for k in range(20)}
    path = str(tmp_path / "out")
    spark.createDataFrame(list(want.items()), preset_files.SCHEMA).repartition(5).write.format("presets").mode("append").save(path)
    assert {os.path.relpath(os.path.join(d, f), path) for d, _, fs in os.walk(path) for f in fs} == set(want)
    assert {r.name: bytes(r.content) for r in spark.read.format("presets").load(path).collect()} == want
    assert all(open(f"{path}/{n}", "rb").read() == c for n, c in want.items())
    again = spark.read.format("presets").load(path).selectExpr("name as preset_id", "content")
    assert {r.preset_id: bytes(r.content) for r in presets.assemble(presets.tokens(again)).collect()} == {n: c for n, c in want.items() if c}
    spark.createDataFrame([("a", b"x")], preset_files.SCHEMA).write.format("presets").mode("overwrite").save(path)
    assert [(r.name, bytes(r.content)) for r in spark.read.format("presets").load(path).collect()] == [("a", b"x")]


@pytest.mark.parametrize("rows", [[("a", b"1"), ("../b", b"2")], [("same", b"1"), ("x/../same", b"2")]])
def test_a_failed_write_leaves_nothing(spark, tmp_path, rows):
    preset_files.register(spark)
    path = str(tmp_path / "out")
    os.makedirs(path)
    with pytest.raises(Exception):
        spark.createDataFrame(rows, preset_files.SCHEMA).repartition(2).write.format("presets").mode("append").save(path)
    assert [f for _, _, fs in os.walk(path) for f in fs] == []
    assert spark.read.format("presets").load(path).collect() == []


def test_partitions_by_bytes(tmp_path, monkeypatch):
    monkeypatch.setattr(preset_files, "PART_BYTES", 3 * preset_files.FILE_BYTES)
    for k in range(7):
        (tmp_path / f"p{k}").write_bytes(b"x" * k)
    assert [len(p.names) for p in preset_files.Reader(str(tmp_path)).partitions()] == [3, 3, 1]


def test_chain_and_ring(spark):
    chain = [(f"n{k}", f"n{k + 1}") for k in range(50)]
    ring = [(f"r{k}", f"r{(k + 1) % 7}") for k in range(7)]
    other = [("y", "x"), ("y", "n49"), ("self", "self"), (None, "n0"), ("z", None)]
    got = {(r.node, r.ancestor, r.steps) for r in space.ancestors(spark.createDataFrame(chain + ring + other, "c string, p string"), "c", "p").collect()}
    want = {(f"n{a}", f"n{b}", b - a) for a in range(50) for b in range(a + 1, 51)} | {(f"r{a}", f"r{(a + k) % 7}", k) for a in range(7) for k in range(1, 7)}
    assert {r for r in got if r[0] and r[0][0] in "nr"} == want
    assert {r for r in got if r[0] == "y"} == {("y", "x", 1), ("y", "n49", 1), ("y", "n50", 2)} and ("self", "self", 1) in got
    assert space.ancestors(spark.createDataFrame([], "c string, p string"), "c", "p").collect() == []


def test_leaves_of_any_depth(spark):
    deep = '{"a": 1, "b": {"c": -2.5, "d": [3, {"e": {"f": {"g": 4e2}}}, true, "7", null], "x": {}}, "t": "5", "y": false}'
    rows = [(1, deep), (2, "7"), (3, "[1, [2, [3]]]"), (4, None), (5, "{broken"), (6, "{}"), (7, '{"a": 1e999, "b": 12345678901234567890123}')]
    got = {(r.i, r.path): r.value for r in documents.numeric_leaves(spark.createDataFrame(rows, "i int, json string"), "i").collect()}
    want = {(1, "a"): 1, (1, "b/c"): -2.5, (1, "b/d/0"): 3, (1, "b/d/1/e/f/g"): 400, (2, ""): 7, (3, "0"): 1, (3, "1/0"): 2, (3, "1/1/0"): 3, (7, "b"): 12345678901234567890123.0}
    assert got == want


def exhaustive(basis, target, weights, low, high):
    """The best of all choices of which controls stand at which end."""
    a, b, best = basis * weights[:, None], target * weights, None
    for ends in itertools.product((0, low, high), repeat=basis.shape[1]):
        free = [k for k, e in enumerate(ends) if e == 0]
        x = np.array(ends, float)
        if free:
            x[free] = np.linalg.lstsq(a[:, free], b - a @ x, rcond=None)[0]
        if (x >= low - 1e-9).all() and (x <= high + 1e-9).all() and (best is None or ((a @ x - b) ** 2).sum() < best[0]):
            best = ((a @ x - b) ** 2).sum(), x
    return best[1]


def test_bounded_fits_are_the_best_of_all_active_sets():
    rng = np.random.default_rng(3)
    for seed in range(4):
        basis, targets = rng.normal(size=(12, 3)), rng.normal(size=(40, 12)) * rng.choice([1, 4, 20], (40, 1))
        weights = rng.uniform(0.1, 1, 12)
        x = inversion.bounded_fits(basis, targets, weights, -2.0, 3.0)
        assert x == pytest.approx(np.array([exhaustive(basis, t, weights, -2.0, 3.0) for t in targets]), abs=1e-6)
        assert inversion.optimality(basis, targets, weights, x, -2.0, 3.0).max() < 1e-5


def test_weighted_fits(spark):
    hz = [25.0, 60.0, 250.0, 1000.0, 4000.0]
    basis = inversion.bell_basis(hz, [60.0, 1000.0])
    moved = (basis @ np.array([3.0, -2.0])).tolist()
    quiet = [1e9, 0.0, 0.0, 0.0, 0.0]
    rows = [(1, moved, None, None), (2, moved, [9.0] * 5, None), (3, moved, quiet, None), (4, [0.0] * 5, None, moved), (5, None, None, None), (6, [1.0], None, None), (7, [float("nan")] * 5, None, None), (8, [0.0] * 5, None, None)]
    df = spark.createDataFrame(rows, "i int, curve array<double>, noise array<double>, handled array<double>")
    got = {r.i: r for r in inversion.weighted_fits(df, "i", basis, hz, -12.0, 12.0, "noise").collect()}
    assert got[1].gains == [3.0, -2.0] and got[1].residual == 0 and got[1].note is None and got[1].margin == got[1].effect
    assert got[2].gains == [0.0, 0.0] and got[2].note == "within the noise" and got[2].margin < 0
    assert got[3].gains == [3.0, -2.0] and got[3].noise_max == 0  # noise outside the full range doesn't count
    assert got[4].gains[0] < 0 < got[4].gains[1]
    assert [got[k].gains for k in (5, 6, 7)] == [None] * 3 and got[8].gains == [0.0, 0.0] and got[8].note is None
