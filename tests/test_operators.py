"""Edge rows: nulls, non-numbers, ties, empty groups, bounds, cycles and gaps."""

from __future__ import annotations

import random
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonelake.functions import timing
from tonelake.functions import values as V
from tonelake.operators import compare, inversion, parameters, signals, space, statistics, trials
from tonelake.sources import audio, documents, presets
from tonelake.streaming import trials as stream

NAN, INF = float("nan"), float("inf")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_values(spark):
    text = lambda k, v, e=None: one(spark, V.to_stored(F.lit(k), F.lit(v), F.lit(e)))
    assert text("switch", " Yes ") == "true" and text("switch", "off", "numeric") == "0" and text("switch", "maybe") is None
    assert text("rotation", "50") == "0.5" and text("rotation", "101") is None and text("fraction", "0.7803125") == "0.7803125"
    assert text("metered", "1e3") == "1000" and text("metered", "nan") is None and text("enum", "2.5") == "2" and text("internal", "1") is None
    assert one(spark, V.from_stored(F.lit("rotation"), F.lit("0.333333"))) == "33.3333"
    assert one(spark, V.described(F.lit("metered"), F.lit("-3.50"), F.lit("db"))) == "-3.5 db"
    q = lambda x, s: one(spark, V.quantised(F.lit(x), F.lit(s).cast("double"), F.lit(0.0), F.lit(1.0)))
    assert q(0.25, 0.5) == 0.0 and q(0.75, 0.5) == 1.0 and q(7.0, 0.5) == 1.0 and q(7.0, None) == 7.0
    assert one(spark, V.to_unit(F.lit(3.0), F.lit(2.0), F.lit(2.0))) == 0.0
    assert one(spark, V.below_floor(F.lit("hz"), F.lit(0.0))) is True and one(spark, V.below_floor(F.lit("ms"), F.lit(0.0))) is False
    assert one(spark, V.truthy(F.lit("2.0"))) is True and one(spark, V.truthy(F.lit(None).cast("string"))) is False


def test_timing(spark):
    m = lambda t: one(spark, timing.note_multiplier(F.lit(t)))
    assert m("1/8 dotted") == 0.75 and m("8thT") == pytest.approx(1 / 3) and m("Eighths") == 0.5 and m("thirty  second note") == 0.125
    assert m("dotted triplet 1/4") is None and m("") is None and m("fast") is None
    assert one(spark, timing.quarter_ms(F.lit(0.0))) is None


def test_weighted_drops_what_is_not_measured(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (1.0, 4.0)], "a double, b double")
    got = [r.x for r in df.select(compare.weighted({"a": F.col("a"), "b": F.col("b")}, {"a": 1.0, "b": 2.0}).alias("x")).collect()]
    assert got == [1.0, None, 3.0]


def test_objectives(spark):
    band = "band_centres_hz array<double>, band_db array<double>, tilt_db_per_decade double, centroid_hz struct<p10:double,p50:double,p90:double>, rolloff85_hz struct<p10:double,p50:double,p90:double>"
    kind = (
        f"struct<source:struct<lufs_i:double,channels:int>,spectrum:struct<{band.replace(' array', ':array').replace(' double', ':double').replace(' struct', ':struct')}>,dynamics:struct<crest_db:double,attack_ms:double,decay_db_per_s:double,lra_lu:double,rms_percentiles_db:struct<p10:double,p50:double,p90:double>>,"
        "harmonic:struct<hnr_db:double,odd_even_ratio:double,hf_residual_index:double,confidence:double>,time_fx:struct<rt60_s:double,rt60_confidence:double,delay_ms:double,delay_confidence:double,delay_feedback_est:double>,"
        "modulation:struct<am_rate_hz:double,am_depth:double,am_confidence:double>,spatial:struct<width:double,correlation:double>,cepstral:struct<mfcc_mean:array<double>>>"
    )
    none3 = (None, None, None)

    def record(lufs, bands, delay):
        return ((lufs, 1), ([100.0, 200.0, 400.0], bands, None, none3, none3), (None, None, None, None, none3), (None, None, None, 0.1), (None, None, 400.0, delay, 0.3), none3, (0.5, 0.5), ([1.0, 2.0],))

    df = spark.createDataFrame([(record(-20.0, [1.0, 2.0, 3.0], 0.9), record(-17.0, [4.0, 5.0, 9.0], 0.0))], f"t {kind}, c {kind}")
    o = compare.objectives("t", "c", compare.PROFILES["unpaired-v1"]["scales"], F.lit(NAN))
    r = df.select(*(v.alias(n) for n, v in o.items())).first()
    assert r.level == pytest.approx(1.0) and r.ambience == 1.0
    assert r.timbre == pytest.approx((np.std([-3, -3, -6]) / 3 + 0) / 2)
    assert r.harmonic is None and r.spatial is None and r.dynamics is None and r.residual is None


def test_band_shape(spark):
    f = lambda a, b: one(spark, compare.band_shape(F.lit(a).cast("array<double>"), F.lit(b).cast("array<double>")))
    assert f([1.0, 2.0], [3.0, 4.0]) == 0.0 and f([], []) is None and f([1.0], [1.0, 2.0]) is None


def test_ranges_skip_what_is_not_finite(spark):
    df = spark.createDataFrame([("g", 1.0, None), ("g", NAN, None), ("g", INF, None), ("g", 3.0, None)], "g string, a double, b double")
    assert [tuple(r) for r in compare.feature_ranges(df, "g", ["a", "b"]).collect()] == [("g", "a", 1.0, 3.0)]


def test_fronts(spark):
    rows = [("g", k, x, y) for k, (x, y) in enumerate([(1.0, 5.0), (2.0, 5.0), (1.0, 5.0), (3.0, 1.0), (0.5, 9.0), (None, 0.0)])]
    df = spark.createDataFrame(rows, "g string, k int, x double, y double")
    assert {r.k for r in compare.front_of_two(df.withColumn("x", F.col("x") / 100), ["g"], "x", "y").collect()} == {0, 2, 3, 4}
    assert {r.k for r in compare.undominated(df, "g", "k", ["x", "y"]).collect()} == {5}


def test_parameters(spark):
    df = spark.createDataFrame([(1, "a", 0, "x"), (1, "a", 1, "y"), (1, "b", 0, None), (2, "a", 0, "z")], "p int, k string, seq int, v string")
    got = {(r.p, r.k): r.v for r in parameters.last_wins(df, ["p", "k"], ["seq"], "v").collect()}
    assert got[1, "a"] == "y" and got[2, "a"] == "z" and got[1, "b"] is None
    assert parameters.last_wins(df.limit(0), ["p"], ["seq"], "v").collect() == []
    specs = spark.createDataFrame([("a", "metered", "hz", 10.0, None, True, True, None), ("b", "switch", None, None, None, False, False, None)], "path string, kind string, unit string, low double, high double, writable boolean, needs_review boolean, encoding string")
    asked = spark.createDataFrame([("a", "10"), ("a", "9.999"), ("a", "-1"), ("a", "true"), ("b", "on"), ("c", "1"), ("a", None)], "path string, value string")
    assert {(r.path, r.value): r.error for r in parameters.validate(asked, specs).collect()} == {
        ("a", "10"): None, ("a", "9.999"): "outside the range", ("a", "-1"): "not a possible value", ("a", "true"): "no value of this kind", ("b", "on"): "read-only", ("c", "1"): "unknown", ("a", None): "no value of this kind",
    }
    allowed = {r.value: (r.stored, r.warnings) for r in parameters.validate(asked.filter("path = 'a'"), specs, allow_outside=True).collect()}
    assert allowed["9.999"] == ("9.999", ["guessed kind", "outside the range"])


def test_gates(spark):
    rows = [("m", "sectionActive", "switch"), ("m", "leftCabActive", "switch"), ("m", "leftCabPan", "metered"), ("m", "leftCab", "enum"), ("m", "leftRoomLevel", "metered"), ("n", "eqActive", "switch"), ("n", "eqSubActive", "switch"), ("n", "eqSubGain", "metered"), ("n", "other", "metered")]
    got = {(r.module, r.key): r.gate for r in space.gates(spark.createDataFrame(rows, "module string, key string, kind string")).collect()}
    assert got == {("m", "leftCabActive"): "sectionActive", ("m", "leftCabPan"): "leftCabActive", ("m", "leftCab"): "leftCabActive", ("m", "leftRoomLevel"): "sectionActive", ("n", "eqSubGain"): "eqSubActive"}


def test_activity_with_a_cycle(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "c")], "child string, parent string")
    chain = space.ancestors(links, "child", "parent")
    assert {(r.node, r.ancestor) for r in chain.filter("node = 'd'").collect()} == {("d", "c"), ("d", "a"), ("d", "b")}
    dims = spark.createDataFrame([("d",), ("e",)], "path string")
    off = lambda v: {r.path for r in space.active(dims, chain, spark.createDataFrame([("b", v)], "path string, value string")).collect()}
    assert off("false") == {"e"} and off("true") == {"d", "e"}


def test_eq_state(spark):
    df = spark.createDataFrame([(1, True), (1, None), (2, False), (2, None), (3, True)], "g int, on boolean")
    assert {r.g: r.active for r in space.eq_state(df, "g", "on").collect()} == {1: None, 2: False, 3: True}


def test_log(spark):
    df = spark.createDataFrame([("r", 1, 2.0), ("r", 2, 1.0), ("r", 3, 1.0), ("r", 4, NAN), ("r", 5, None)], "run string, trial int, score double")
    assert tuple(trials.best_trial(df, "run", "score", "trial").first()) == ("r", 2, 1.0)
    ok = ~trials.failed(F.lit(None), F.col("score"), F.col("trial") == 3)
    assert trials.latest_success(df.filter("not isnan(score)"), "run", ok, "trial").first().trial == 2
    new = spark.createDataFrame([(1, "x"), (1, "x"), (2, "x"), (9, "x")], "trial int, listener string")
    old = spark.createDataFrame([(2, "x")], "trial int, listener string")
    assert [tuple(r) for r in trials.appendable(new, df, "trial", old, ["trial", "listener"]).collect()] == [(1, "x")]


def test_ridge(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 2))
    y = x @ [2.0, -1.0] + 3
    df = spark.createDataFrame([("g", i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], "g string, i int, a double, b double, y double")
    w, c = statistics.ridge(df, ["a", "b"], "y", 1e-6)
    assert w == pytest.approx([2, -1], abs=1e-4) and c == pytest.approx(3, abs=1e-4)
    assert statistics.fold_r2(df, "g", F.col("i"), ["a", "b"], "y", 5).first().r2 > 0.999
    flat = df.withColumn("y", F.lit(1.0))
    assert statistics.fold_r2(flat, "g", F.col("i"), ["a", "b"], "y", 5).first().r2 is None


def test_indistinguishable(spark):
    levels = spark.createDataFrame([("a", 0, 1.0, 0.1, 3), ("a", 6, 2.0, 0.1, 3), ("b", 0, 2.05, 0.1, 3), ("c", 0, 9.0, 0.0, 1)], "run string, level int, mean double, spread double, n long")
    worst = statistics.worst_level(levels, "run", "level").withColumn("g", F.lit(1))
    assert {r.run: r.level for r in worst.collect()} == {"a": 6, "b": 0, "c": 0}
    assert statistics.indistinguishable(worst, "g", "run").first().tied
    assert statistics.indistinguishable(worst.filter("run != 'a'"), "g", "run").first().tied  # nothing tells c's error


def test_bounded_least_squares():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(30, 5))
    truth = np.array([2.0, -1.0, 0.5, 5.0, 0.0])
    x = inversion.bounded_least_squares(a, a @ truth, -3, 3)
    g = a.T @ (a @ x - a @ truth)
    assert (np.abs(x) <= 3).all() and x[3] == 3
    assert all(abs(g[k]) < 1e-6 or (x[k] == 3 and g[k] < 0) or (x[k] == -3 and g[k] > 0) for k in range(5))


def test_signals(spark):
    rate, t = 48_000, np.arange(48_000) / 48_000
    clips = [("tone", (0.5 * np.sin(2 * np.pi * 1000 * t)).tolist()), ("low", (0.5 * np.sin(2 * np.pi * 125 * t)).tolist()), ("silent", [0.0] * 48_000), ("short", [0.1] * 100)]
    df = spark.createDataFrame(clips, "clip string, samples array<double>")
    got = {r.clip: r for r in signals.fingerprints(df, rate).collect()}
    assert set(got) == {"tone", "low"}
    for clip, hz in (("tone", 1000), ("low", 125)):
        s = got[clip].spectrum
        assert s.band_centres_hz[int(np.argmax(s.band_db))] == pytest.approx(hz, rel=0.02)
        assert got[clip].dynamics.crest_db == pytest.approx(3.0, abs=0.2)
    assert got["tone"].spectrum.centroid_hz.p50 == pytest.approx(1000, rel=0.05)


def test_windows_over_flags(spark):
    bits = [0, 1, 1, 0, 1, 1, 1, 0, 0, 1]
    df = spark.createDataFrame([("g", i, bool(b)) for i, b in enumerate(bits)], "g string, i int, hit boolean")
    assert tuple(signals.longest_run(df, "g", "i", "hit").first()) == ("g", 3, 4)
    assert tuple(signals.densest_window(df, "g", "i", "hit", 4).first()) == ("g", 1, 3)
    assert signals.densest_window(df, "g", "i", "hit", 11).collect() == []


def preset(rng):
    out = b"Header\x00"
    for k in range(rng.randrange(0, 12)):
        out += f"key{k}".encode() + b"\x00"
        out += rng.choice([presets.encode_text("v" * rng.randrange(0, 200)), presets.encode_text("É日" * 3), b"\x01\x09\x04" + rng.randbytes(8) + b"\x00", b"\x01\x09\x06" + rng.randbytes(8) + b"\x00", b"", bytes([1, 5])])
    return out


def test_presets(spark):
    rng = random.Random(4)
    files = [(str(k), preset(rng)) for k in range(60)] + [("junk", bytes(range(256)) * 3), ("empty", b""), ("none", None)]
    for _, data in files:
        parts = presets.tokenize(data or b"")
        assert b"".join(p + (x if x is not None else v.encode()) + t for p, v, t, x in parts) == (data or b"")
    df = spark.createDataFrame(files, "preset_id string, content binary")
    back = {r.preset_id: bytes(r.content) for r in presets.assemble(presets.tokens(df)).collect()}
    assert back == {i: d for i, d in files if d}
    with pytest.raises(ValueError):
        presets.encode_text("é" * 127)


def test_preset_structure_and_edit(spark):
    data = b"Name\x00" + b"subModels\x00" + presets.encode_text("amp") + b"gain\x00" + presets.encode_text("0.5") + b"lonely\x00" + b"subModels\x00" + presets.encode_text("eq") + b"gain\x00" + presets.encode_text("1")
    t = presets.tokens(spark.createDataFrame([("p", data)], "preset_id string, content binary"))
    got = [(r.module, r.key, r.stored) for r in presets.structure(t).orderBy("ord").collect()]
    assert got == [("amp", "gain", "0.5"), ("eq", "gain", "1")]
    at = presets.structure(t).filter("module = 'amp'").select("preset_id", F.col("value_index").alias("idx"), F.lit("0.75").alias("new"))
    new = bytes(presets.assemble(presets.set_values(t, at)).first().content)
    assert new == data.replace(presets.encode_text("0.5"), presets.encode_text("0.75"))


def test_manifests(spark, tmp_path):
    (tmp_path / "m.json").write_text(
        '{"pack_id": "own", "display_name": "Own", "file_header": "OWN", "switch_encoding": "numeric", "enums": {"mics": {"0": "Ribbon"}},'
        ' "parameters": {"cab/mic": {"kind": "enum", "enum": "mics"}, "gain": {"kind": "metered", "unit": "db", "min": -3, "writable": false}}}'
    )
    m = documents.read_manifests(spark, str(tmp_path))
    got = {r.path: r for r in documents.parameter_specs(m).collect()}
    assert (got["cab/mic"].module, got["cab/mic"].key, got["cab/mic"].members, got["cab/mic"].encoding) == ("cab", "mic", {"0": "Ribbon"}, "numeric")
    assert (got["gain"].module, got["gain"].key, got["gain"].low, got["gain"].writable) == ("", "gain", -3.0, False)
    seen = spark.createDataFrame([("OWN",), ("X",), (None,)], "header string")
    assert {r.header: r.pack_id for r in documents.routed(seen, m).collect()} == {"OWN": "own", "X": None, None: None}


def test_measurement_documents(spark):
    rows = [(1, '{"fingerprint_version": 1, "spectrum": {"tilt": -3.5, "note": "x"}}'), (2, '{"fingerprint_version": 2}'), (3, '{"fingerprint_version": 1, "odd": {}}'), (4, "[1]"), (5, None)]
    df = documents.measurement_faults(spark.createDataFrame(rows, "i int, json string"))
    assert {r.i: r.fault for r in df.collect()} == {1: None, 2: "version", 3: "unknown odd", 4: "not an object", 5: "not an object"}
    assert [tuple(r) for r in documents.numeric_leaves(df.filter("i = 1"), "i").collect()] == [(1, "fingerprint_version", 1.0), (1, "spectrum/tilt", -3.5)]


def test_audio(spark, tmp_path):
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(np.array([[16384, 0], [-16384, 16384]], "<i2").tobytes())
    (tmp_path / "b.wav").write_bytes(b"no audio")
    got = {r.clip.rsplit("/", 1)[1]: r for r in audio.read_clips(spark, str(tmp_path)).collect()}
    assert (got["a.wav"].rate, got["a.wav"].channels, got["a.wav"].samples) == (8000, 2, [0.25, 0.0])
    assert got["b.wav"].samples is None and got["b.wav"].error


def test_stream(spark, tmp_path):
    rows = [("r", 1, 3.0, "2024-01-01 00:00:00"), ("r", 2, 1.0, "2024-01-01 00:01:00"), ("r", 2, 1.0, "2024-01-01 00:01:00"), ("s", 3, None, "2024-01-01 00:02:00")]
    schema = "run string, trial int, score double, ts timestamp"
    df = spark.createDataFrame([(a, b, c) for a, b, c, _ in rows], "run string, trial int, score double")
    df = df.withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp")).withColumn("failed", F.col("score").isNull())
    df.write.parquet(f"{tmp_path}/log")
    log = stream.read_log(spark, f"{tmp_path}/log", schema + ", failed boolean")
    for name, out, mode in (("best", stream.running_best(log, "run", "trial", "score"), "complete"), ("once", stream.once(log, ["trial"], "ts"), "append"), ("wide", stream.windowed(log, "ts", "1 hour", "1 minute", "run"), "update")):
        q = out.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("best").collect()} == {("r", 2, 1.0)}
    assert sorted(r.trial for r in spark.table("once").collect()) == [1, 2, 3]
    assert {(r.run, r.trials, r.failures) for r in spark.table("wide").collect()} == {("r", 3, 0), ("s", 1, 1)}
    for _ in range(2):
        stream.append_new(log.select("run", "trial"), f"{tmp_path}/out", ["trial"], f"{tmp_path}/cp{_}").awaitTermination(120)
    assert sorted(r.trial for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2, 3]


def test_records_of_frames_and_rows_of_bins_agree(spark):
    rng = np.random.default_rng(3)
    clips = [(k, (rng.normal(size=9000) * 10.0 ** -rng.integers(0, 3)).tolist()) for k in range(4)]
    df = spark.createDataFrame(clips, "clip long, samples array<double>")
    rate = 48_000
    got = {r.clip: r for r in signals.fingerprints(df, rate).collect()}
    heard = signals.sounding(signals.frame_levels(signals.frames(df)).filter("level > -200"))
    bins = signals.spectra(heard.select("clip", "frame", "samples"), rate).cache()
    bands = signals.band_energies(bins)
    for r in bands.groupBy("clip").agg(F.sort_array(F.collect_list(F.struct("band_hz", "db"))).alias("b")).collect():
        assert [x.band_hz for x in r.b] == got[r.clip].spectrum.band_centres_hz
        assert [x.db for x in r.b] == pytest.approx(got[r.clip].spectrum.band_db)
    for r in signals.tilt(bands).collect():
        assert r.tilt_db_per_decade == pytest.approx(got[r.clip].spectrum.tilt_db_per_decade)
    for r in signals.spectral_statistics(bins).collect():
        for c in ("centroid_hz", "rolloff85_hz", "flatness"):
            assert tuple(r[c]) == pytest.approx(tuple(got[r.clip].spectrum[c]))
    flux = {(r.clip, r.frame): r.flux for r in signals.flux(bins).collect()}
    assert {(r.clip, r.frame): r.flux for r in signals.frame_records(df, rate).filter("heard").collect()} == pytest.approx(flux)


def plain_peaks(x, height, distance, prominence):
    at = []
    for i in range(1, len(x) - 1):
        j = i
        while j + 1 < len(x) and x[j + 1] == x[i]:
            j += 1
        if x[i - 1] < x[i] and j + 1 < len(x) and x[j + 1] < x[i] and x[i] >= height:
            at.append((i + j) // 2)
    kept = []
    for p in sorted(at, key=lambda p: (-x[p], -p)):
        if all(abs(p - q) >= distance for q in kept):
            kept.append(p)

    def out_of(p):
        low = []
        for step in (-1, 1):
            k, least = p + step, x[p]
            while 0 <= k < len(x) and x[k] <= x[p]:
                least, k = min(least, x[k]), k + step
            low.append(least)
        return x[p] - max(low)

    return sorted(p for p in kept if out_of(p) >= prominence)


def test_peaks(spark):
    rng = np.random.default_rng(5)
    rows = [(k, rng.integers(0, 9, size=rng.integers(0, 60)).astype(float).tolist()) for k in range(120)] + [(900, None), (901, [])]
    df = spark.createDataFrame(rows, "k int, x array<double>")
    got = df.select("k", "x", signals.peaks(F.col("x"), 2.0, 4, 1.5).alias("p"))
    for r in got.select("*", signals.strongest_peaks(F.col("x"), F.col("p"), 3).alias("s")).collect():
        want = plain_peaks(r.x, 2.0, 4, 1.5) if r.x is not None else None
        assert r.p == want
        assert want is None or r.s == sorted(want, key=lambda p: (-r.x[p], p))[:3]


def test_numbers_in_presets(spark):
    data = b"Header\x00" + b"gain\x00\x01\x09\x04" + struct.pack("<d", 2.5) + b"\x00" + b"odd\x00\x01\x09\x06abcdefgh\x00"
    raw = presets.tokenize(data)
    df = spark.createDataFrame([("p", i, bytearray(a), b, bytearray(c), None if d is None else bytearray(d)) for i, (a, b, c, d) in enumerate(raw)], presets.TOKENS)
    shown = {r.idx: r.x for r in df.select("idx", presets.double_text(F.col("payload")).alias("x")).collect()}
    assert shown[2] == "2.5" and shown[0] is None
    changed = presets.set_numbers(df, spark.createDataFrame([("p", 2, -0.125)], "preset_id string, idx int, new double"))
    assert bytes(presets.assemble(changed).first().content) == data.replace(struct.pack("<d", 2.5), struct.pack("<d", -0.125))
    with pytest.raises(Exception, match="no double"):
        presets.set_numbers(df, spark.createDataFrame([("p", 0, 1.0)], "preset_id string, idx int, new double")).collect()


def test_records_of_parameters(spark):
    text = lambda s: bytes([1, len(s) + 2, 5]) + s + b"\x00"
    number = b"value\x00\x01\x09\x04" + struct.pack("<d", 0.75) + b"\x00"
    data = b"Header\x00" + b"3PARAM\x00\x01\x02id\x00" + text(b"eqBand1") + number + b"PARAM\x00\x01\x01id\x00" + text(b"alone") + b"PARAM\x00\x01\x02id\x00" + text(b"last") + number
    raw = presets.tokenize(data)
    assert b"".join(a + (d if d is not None else b.encode()) + c for a, b, c, d in raw) == data
    df = spark.createDataFrame([("p", i, bytearray(a), b, bytearray(c), None if d is None else bytearray(d)) for i, (a, b, c, d) in enumerate(raw)], presets.TOKENS)
    got = [(r.ord, r.id, r.stored, r.number) for r in presets.param_records(df).orderBy("ord").collect()]
    assert got == [(0, "eqBand1", "0.75", 0.75), (1, "alone", None, None), (2, "last", "0.75", 0.75)]


def test_mel_filters():
    f = signals.mel_filters(48_000, 2048)
    assert f.shape == (40, 1025) and f.min() >= 0 and f.max() <= 1
    at = f.argmax(1)
    assert all(a <= b for a, b in zip(at, at[1:])) and f[-1, 1024] == 0


def test_same_structures(spark):
    same = lambda a, b: one(spark, V.same_array(F.lit(a).cast("array<double>"), F.lit(b).cast("array<double>")))
    assert same([1.0, 2.0], [1.0 + 1e-12, 2.0]) and not same([1.0], [1.0, 2.0]) and not same([1.0], [1.1]) and not same([NAN], [NAN])
    m = lambda **kw: F.create_map(*(F.lit(x) for kv in kw.items() for x in kv))
    assert one(spark, V.same_map(m(a="1.0", b="x"), m(b="x", a="1"))) is True and one(spark, V.same_map(m(a="1"), m(b="1"))) is False
    assert one(spark, V.same_map(m(a="x"), m(a="y"))) is False
    assert one(spark, V.rotated(F.array(*map(F.lit, [1, 2, 3])), F.lit(-1))) == [3, 1, 2] and one(spark, V.rotated(F.array().cast("array<int>"), F.lit(2))) == []
    assert one(spark, V.script_safe(F.lit("</script>&"))) == "\\u003c/script\\u003e\\u0026"
    assert one(spark, V.number_text(F.lit(1e40))) == "1" + "0" * 40 or one(spark, V.number_text(F.lit(1e40))).startswith("1000000")


def test_warm_start_refuses(spark):
    from tonelake.operators import warmstart

    df = spark.createDataFrame([(1.0, 2.0, 0.5), (2.0, 2.0, 0.75), (4.0, 2.0, 1.0)], "x double, flat double, y double")
    model = warmstart.fit(df, ["x", "flat"], [warmstart.Control("y", 0.0, 1.0)], 1e-6)
    assert model.features == ("x",)
    out = spark.createDataFrame([(2.0,), (None,), (9.0,)], "x double").select(*(c.alias(n) for n, c in warmstart.predicted(model).items())).collect()
    assert out[1].y is None and out[2].clipped_fraction == 1.0 and 0 <= out[2].y <= 1
    with pytest.raises(ValueError, match="width"):
        warmstart.fit(df, ["x"], [warmstart.Control("y", 1.0, 1.0)])
    with pytest.raises(ValueError, match="varies"):
        warmstart.fit(df, ["flat"], [warmstart.Control("y", 0.0, 1.0)])
    with pytest.raises(ValueError, match="alpha"):
        warmstart.fit(df, ["x"], [warmstart.Control("y", 0.0, 1.0)], 0.0)
    with pytest.raises(ValueError, match="two"):
        warmstart.fit(df.limit(1), ["x"], [warmstart.Control("y", 0.0, 1.0)])
