"""Calibration operators on edge rows."""

from __future__ import annotations

from tonelake.operators import calibration as K


def test_repeats_need_two_measurements(spark):
    rows = [("a", 1, 2.0), ("a", 1, 5.0), ("a", 1, None), ("a", 2, 4.0), ("b", 1, None)]
    df = spark.createDataFrame(rows, "g string, c int, v double")
    got = {(r.g, r.c): (r.noise_db, r.median_db, r.repeats) for r in K.repeat_noise(df, "g", "c", "v").collect()}
    assert got == {("a", 1): (3.0, 3.5, 2), ("a", 2): (None, 4.0, 1), ("b", 1): (None, None, 0)}


def test_grids(spark):
    df = spark.createDataFrame([("a", 1, 0.1), ("a", 2, 5.0), ("a", 3, 5.0), ("b", 1, 4.9), ("b", 2, None)], "g string, p int, v double")
    assert {r.g: r.crossing for r in K.grid_crossing(df, "g", "p", "v", 5.0).collect()} == {"a": 2, "b": None}
    assert [(r.g, r.p) for r in K.unordered_grid(df, "g", "p", "v").collect()] == [("a", 3)]


def test_silent_first_has_no_error(spark):
    a = spark.createDataFrame([(1, 0, 0.0), (1, 1, 0.0), (2, 0, 1.0), (2, 1, 2.0)], "g int, i int, x double")
    b = spark.createDataFrame([(1, 0, 0.5), (1, 1, -0.5), (2, 0, 1.0), (2, 1, 2.0)], "g int, i int, x double")
    got = {r.g: (r.error_db, r.largest, r.place) for r in K.repeat_difference(a, b, "g", "i", "x").collect()}
    assert got == {1: (None, 0.5, 0), 2: (-300.0, 0.0, 0)}


def test_harmonics_against_all_pairs(spark):
    peaks = [(g, x) for g, xs in (("a", [10.0, 20.1, 29.8, 41.0, 7.0]), ("b", [0.0, -3.0, 5.0, 5.0, 10.25, 9.75])) for x in xs]
    got = {(r.g, r.root): r.multiples for r in K.harmonic_support(spark.createDataFrame(peaks, "g string, x double"), "g", "x", 4, 0.25).collect()}
    want = {(g, x): len({k for h, y in peaks for k in (2, 3, 4) if h == g and abs(y - k * x) <= 0.25}) for g, x in peaks if x > 0}
    assert got == {k: n for k, n in want.items() if n}


def test_drawn_settings_repeat_and_stay_in_range(spark):
    d = spark.createDataFrame([("x", -1.0, 1.0), ("y", 5.0, 5.0), ("z", None, 2.0)], "name string, lo double, hi double")
    a, b = (sorted(map(tuple, K.random_settings(d, "name", "lo", "hi", 50, s).collect()), key=str) for s in (1, 1))
    assert a == b and len(a) == 150
    assert all(-1 <= v <= 1 for n, _, v in a if n == "x") and {v for n, _, v in a if n == "y"} == {5.0} and {v for n, _, v in a if n == "z"} == {None}


def test_alignment_finds_the_delay(spark):
    x = [0.0, 1.0, -2.0, 3.0, 0.5, 0.0, 0.0, 0.0]
    a = spark.createDataFrame([(1, i, v) for i, v in enumerate(x)] + [(2, i, 0.0) for i in range(8)], "g int, i int, x double")
    b = spark.createDataFrame([(1, i + 2, -v) for i, v in enumerate(x)] + [(2, i, 1.0) for i in range(8)], "g int, i int, x double")
    got = {r.g: (r.lag, r.r and round(r.r, 9), r.trusted) for r in K.alignment(a, b, "g", "i", "x", 3).collect()}
    assert got == {1: (2, -1.0, True), 2: (0, None, False)}


def test_detrended_with_gaps(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (1, 1, None), (1, 2, 9.0), (2, 0, None)], "g int, i int, x double")
    assert sorted((r.g, r.i, r.above) for r in K.detrended(df, "g", "i", "x", 1).collect()) == [(1, 0, 0.0), (1, 1, None), (1, 2, 0.0), (2, 0, None)]


def test_empty_tables(spark):
    df = spark.createDataFrame([], "g int, i int, x double")
    outs = [K.repeat_noise(df, "g", "i", "x"), K.grid_crossing(df, "g", "i", "x", 1.0), K.unordered_grid(df, "g", "i", "x"), K.repeat_difference(df, df, "g", "i", "x"), K.harmonic_support(df, "g", "x", 3, 0.1)]
    outs += [K.regressions(df, df, ["g", "i"], "x"), K.cepstra(df, "g", "i", "x", 4, 2), K.covariances(df, "g", ["i", "x"]), K.alignment(df, df, "g", "i", "x", 2), K.detrended(df, "g", "i", "x", 2)]
    assert [d.collect() for d in outs] == [[]] * len(outs)
