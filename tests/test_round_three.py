"""Steps that failed or differed on larger tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tonelake.functions import values as V
from tonelake.llm import lm_scoring as lm
from tonelake.llm import ngram_join
from tonelake.operators import atlas as L
from tonelake.operators import calibration as K
from tonelake.operators import compare as C
from tonelake.operators import inversion
from tonelake.operators import parameters as P
from tonelake.operators import paths
from tonelake.plans.registry import QUERIES
from tonelake.sources import documents
from tonelake.streaming import state


def test_stamps_beyond_four_digits(spark):
    out = spark.range(1).select(V.iso_stamp(F.lit(2932897 * 86400)).alias("far"), V.iso_stamp(F.lit(86400)).alias("near"), F.array_join(V.rotated(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.lit(3 * 10**12 + 1)), "").alias("turned"))
    assert tuple(out.first()) == ("10000-01-01T00:00:00Z", "1970-01-02T00:00:00Z", "bca")


def test_blend_zero_never_beats_itself(spark):
    """A table that gives other last digits whenever it is read, as sums over a cluster do."""
    s = spark.range(4000).select((F.col("id") % 1000).alias("t"), (F.floor(F.col("id") / 1000) * 0.25).alias("b"), F.expr("1 + 1e-12 * rand()").alias("x"))
    got = {r.b: (r.wins, r.chosen) for r in L.best_blend(s, "t", "b", "x").collect()}
    assert got[0.0][0] == 0 and set(got) == {0.0, 0.25, 0.5, 0.75}
    rows = [(1, 0.0, 2.0), (1, 0.5, 1.0), (2, 0.5, 0.0), (3, 0.0, None), (3, 0.5, 1.0), (None, 0.0, 9.0)]
    got = {r.b: (r.mean, r.wins, r.chosen) for r in L.best_blend(spark.createDataFrame(rows, "t int, b double, x double"), "t", "b", "x").collect()}
    assert got == {0.0: (2.0, 0, False), 0.5: (1.0, 1, True)}


def test_steady_mean(spark):
    rows = [(k, 0.1 * 0 + v / 100) for k, vs in ((1, [1, 2, 3, 5, 8, 10, 7, 70, 9, 1]), (2, [70, 10, 9, 8, 7, 5, 3, 2, 1, 1])) for v in vs]
    rows += [(3, 1e-9), (3, 3e-9), (4, float("nan")), (5, None), (6, 1e30), (7, -0.25), (7, None)]
    got = dict(map(tuple, spark.createDataFrame(rows, "g int, x double").repartition(3).groupBy("g").agg(V.steady_mean(F.col("x"))).collect()))
    assert got[1] == got[2] == 0.116 and abs(got[3] - 2e-9) < 1e-20 and got[4] != got[4] and got[5] is None and got[6] == 1e30 and got[7] == -0.25


def test_regression_at_the_tolerance_in_any_order(spark):
    """The mean of 20 values lies at the tolerance exactly: what rows come first mustn't tell."""
    values = [5] * 10 + [10, 1, 4, 6, 2, 8, 3, 7, 9, 1]
    assert sum(values) == 101
    tables = [spark.createDataFrame([(1, v / 100) for v in vs], "k int, x double").coalesce(1).groupBy("k").agg(V.steady_mean(F.col("x")).alias("v")) for vs in (values, values[::-1], sorted(values))]
    assert {t.first().v for t in tables} == {0.0505}
    before = spark.createDataFrame([(1, 0.05)], "k int, v double")
    assert len({len(K.regressions(before, t, ["k"], "v").collect()) for t in tables}) == 1


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().sparkPlan().toString()


def test_packs_are_never_broadcast(spark):
    manifests = spark.createDataFrame([("a", '{"signal_paths": {"x": {"volume_control": "v"}}, "output_gain_control": "o"}', {}), ("b", None, {})], "pack string, calibration string, amps map<string,string>")
    spec = "pack string, path string, kind string, unit string, low double, high double, writable boolean, needs_review boolean, encoding string"
    specs = spark.createDataFrame([("a", p, "metered", "dB", None, None, True, False, None) for p in ("v", "o")], spec)
    found, faults = paths.signal_paths(manifests, specs, spark.createDataFrame([], "pack string, path string, member long, label string"))
    asked = spark.createDataFrame([("a", "X")], "pack string, asked string")
    for df in (found, paths.resolved(asked, found, manifests)):
        assert "BroadcastHashJoin" not in _plan(df)[1]
    assert [r.name for r in found.collect()] == ["x"] and [(r.pack, r.rule) for r in faults.collect()] == [("b", "no signal path")]


def test_members_meet_entries_where_they_are(spark):
    """Three values in many rows would be three tasks after a shuffle."""
    members = spark.createDataFrame([("flag", 0, " a "), ("flag", 1, "N"), ("flag", 2, None)], "path string, member int, label string")
    entries = spark.range(6).select(F.lit("flag").alias("path"), F.expr("array('A', 'n', '1', '2', 'R', null)[id]").alias("value"), "id")
    out = P.resolve_members(entries, F.broadcast(members))
    assert "BroadcastHashJoin" in _plan(out)[1] and "SortMergeJoin" not in _plan(out)[1]
    assert {r.id: r.member for r in out.collect()} == {0: 0, 1: 1, 2: 1, 3: 2, 4: None, 5: None}


def test_nearest_shapes_equal_all_pairs(spark, monkeypatch):
    """Against every pair, with copies, levels, odd vectors and groups of several tiles and stretches."""
    monkeypatch.setattr(C, "TILE", 7)
    monkeypatch.setattr(C, "STRETCH", 40)
    g = np.random.default_rng(3)
    vectors = [(g.integers(-20, 20, 8) / 8).tolist() for _ in range(60)]  # sums of such are exact
    rows = [(k, k % 3 if k % 41 else None, vectors[k % 60] if k % 5 else [x + 0.5 for x in vectors[7]]) for k in range(300)]
    rows += [(300, 1, None), (301, 1, [1.0, 2.0]), (302, 1, [float("nan")] * 8), (303, 9, [1.0] * 8), (304, 9, None), (305, 1, [])]
    df = spark.createDataFrame(rows, "i long, g int, v array<double>")
    targets, entries = df.filter("i % 10 = 0 or i > 300").select("g", F.col("i").alias("t"), F.col("v").alias("a")), df.select("g", F.col("i").alias("e"), F.col("v").alias("b"))
    got = {(r.t, r.rank): (r.e, r.distance) for r in C.nearest_shapes(targets, entries, "g", "t", "e", "a", "b", 4).collect()}
    want = {}
    for t, gt, a in rows:
        near = []
        for e, ge, b in rows:
            if (t % 10 == 0 or t > 300) and e != t and gt is not None and ge == gt:
                d = np.subtract(a, b) if a and b and len(a) == len(b) else None
                d = None if d is None else float(np.sqrt(np.mean((d - d.mean()) ** 2)))
                near.append((2 if d is None else 1 if d != d else 0, 0 if d is None or d != d else round(d, 9), e, d))
        want |= {(t, k): (e, d) for k, (_, _, e, d) in enumerate(sorted(near, key=lambda x: x[:3])[:4], 1)}
    assert got.keys() == want.keys()
    for k, (e, d) in want.items():
        assert got[k][0] == e and (d is got[k][1] is None or d != d and got[k][1] != got[k][1] or abs(d - got[k][1]) < 1e-9), (k, got[k], e, d)


def test_state_over_batches_is_that_of_all_trials(spark, tmp_path):
    """Trials that come twice, late or with another outcome, and few messages to the state's store."""
    g = np.random.default_rng(5)
    rows = [(int(r), int(t), float(x), bool(f)) for r, t, x, f in zip(g.integers(0, 9, 400), g.integers(0, 40, 400), g.integers(0, 50, 400) / 4, g.random(400) < 0.7)]
    rows += [(20, 5, None, True), (20, 5, float("nan"), False), (21, 1, 2.0, True), (None, 1, 1.0, False), (22, 7, 1.0, None)]
    t = spark.createDataFrame(rows, "run long, trial long, score double, failed boolean")
    t.repartition(6).write.parquet(f"{tmp_path}/log")
    own = spark.newSession()
    own.conf.set(*state.PROVIDER)
    got = state.states_of(own, own.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log"), f"file://{tmp_path}/s")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, state.batch_state(t).collect()))


def test_leaves_are_written_once_for_several_levels(spark, monkeypatch):
    written = []
    cut = documents.cut
    monkeypatch.setattr(documents, "cut", lambda df: written.append(1) or cut(df))
    rows = [(1, '{"a": {"b": {"c": [1, {"d": -2.5}, {}, [], null, true, "3"]}}, "e": 4}'), (2, "5"), (3, "{}"), (4, None), (5, "{x"), (6, '{"": {"": 6}}')]
    got = {(r.i, r.path): r.value for r in documents.numeric_leaves(spark.createDataFrame(rows, "i int, json string"), "i").collect()}
    assert got == {(1, "a/b/c/0"): 1.0, (1, "a/b/c/1/d"): -2.5, (1, "e"): 4.0, (2, ""): 5.0, (6, "/"): 6.0}
    assert len(written) == 1


def test_counters_are_worth_what_all_texts_say():
    """Each bit against its counter without it; every counter has a say, new contexts stay new."""
    none, ones = np.array([0, 1, 3, 0]), np.array([0, 1, 1, 5])
    got, want = lm.came(none, ones), np.zeros((2, 256), np.int64)
    for n0, n1 in zip(none, ones):
        for bit, times in enumerate((n0, n1)):
            for _ in range(times):
                want[bit, int(lm.odds(np.array([n0 - (bit == 0)]), np.array([n1 - (bit == 1)]))[0]) + 128] += 1
    assert (got == want).all() and got.sum() == 11
    assert (np.abs(lm.worth(np.zeros((2, 256), np.int64)) - np.arange(-128, 128)) <= 1).all()
    seen = np.zeros((2, 256), np.int64)
    seen[:, 128 + 40] = 1000, 1000
    seen[:, 128] = 0, 1000
    w = lm.worth(seen)
    assert 0 < w[128 + 40] <= 2 and w[128] == 0 and w[128 + 41] == 41


def test_model_learns_from_every_training_text(spark):
    """Odds, and what they are worth, sum up to the bits of all texts, short or long, however the rows are dealt."""
    texts = ["ab ba " * k for k in range(1, 401)] + ["abcd" * 9000]
    rows = spark.createDataFrame([(t.encode(),) for t in texts], "text binary")
    made = [lm.learned(rows.repartition(n)) for n in (2, 5)]
    assert all((x == y).all() for x, y in zip(made[0].tables, made[1].tables))
    tables = lm.tables_of(rows, made[0].code, made[0].bits)
    bits = sum(int(lm.Read(parts, made[0].code, 1).real.sum()) for _, parts in lm.together([t.encode() for t in texts]))
    seen = {m: 0 for m in range(lm.MODELS)}
    for r in tables.filter("block is null").collect():
        seen[r.model] += int(np.frombuffer(r.came, np.int64).sum())
    assert set(seen.values()) == {bits}


def test_absolute_bands_in_tasks_of_bounded_size(spark, tmp_path, monkeypatch):
    """More rows are dealt to more tasks from the aggregate to the end, which changes no result."""
    line = "l_suppkey long, l_partkey long, l_linenumber int, l_quantity double"
    spark.createDataFrame([(k % 40, k % 173, k % 7, float(k % 50 + 1)) for k in range(6000)], line).write.parquet(f"{tmp_path}/lineitem.parquet")
    want = sorted(map(tuple, QUERIES["absolute_bands"](spark, str(tmp_path)).collect()), key=str)
    monkeypatch.setattr(inversion, "ROWS", 500)
    out = QUERIES["absolute_bands"](spark, str(tmp_path))
    assert sorted(map(tuple, out.collect()), key=str) == want and len(want) > 1000
    dealt = [x for x in out._jdf.queryExecution().sparkPlan().toString().splitlines() if "Exchange" in x]
    assert len(dealt) == 3 and all(", 13), REPARTITION_BY_NUM" in x for x in dealt), dealt


def test_postings_are_dealt_once(spark):
    """Shingles of two or more documents with their centres, in one shuffle; heavy ones are summed up apart, to the same rows."""
    g = np.random.default_rng(8)
    sets = [(k, int(g.integers(5, 40)), [int(x) for x in g.permutation(60)[: int(g.integers(1, 6))]]) for k in range(50)]
    lead = spark.createDataFrame(sets + [(7, 9, [100]), (7, 8, [100])], "doc_id long, n long, prefix array<long>")
    held = {}
    for d, n, prefix in sets:
        for pos, h in enumerate(prefix):
            held.setdefault(h, []).append((pos, n, d))
    want = sorted((h, pos, d, n, min(x)[2], min(x)[1], len(x)) for h, x in held.items() if len(x) > 1 for pos, n, d in x)
    none, some = np.empty(0, np.uint64), np.array([h for h, x in held.items() if len(x) > 3] + [100], np.uint64)
    for heavy in (none, some):
        assert sorted(map(tuple, ngram_join.postings(lead, heavy).collect())) == want
    assert len(some) > 2 and _plan(ngram_join.postings(lead, none))[1].count("Window") and "Join" not in _plan(ngram_join.postings(lead, none))[1]
