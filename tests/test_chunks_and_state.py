"""Clips in chunks, pitched runs, trial resolution and the stream's state, against plain loops and batch operators."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tonelake.operators import audit, chunks, signals
from tonelake.streaming import state


def clips(spark, **named):
    return spark.createDataFrame([(k, list(map(float, v))) for k, v in named.items()], "clip string, samples array<double>")


@pytest.mark.parametrize("length", [7, 50, 1000])
def test_frames_equal_those_of_whole_clips(spark, length):
    rng = np.random.default_rng(0)
    whole = clips(spark, a=rng.normal(size=333), b=rng.normal(size=99), c=rng.normal(size=100), d=[], e=rng.normal(size=20))
    got = {(r.clip, r.frame): r.samples for r in chunks.frames(chunks.chunked(whole, length), length, 100, 37).collect()}
    assert got == {(r.clip, r.frame): r.samples for r in signals.frames(whole, 100, 37).collect()} and len(got) == 8


def delayed(x, d):
    f = np.fft.rfftfreq(len(x))
    return np.fft.irfft(np.fft.rfft(x) * np.exp(-2j * np.pi * f * d), len(x))


def smooth(seed, n=600):
    x = np.random.default_rng(seed).normal(size=n) * np.hanning(n)
    s = np.fft.rfft(x)
    s[len(s) // 3 :] = 0
    return np.fft.irfft(s, n)


@pytest.mark.parametrize("length", [64, 600])
def test_alignment_finds_fractions_and_undoes_them(spark, length):
    x = {f"c{k}": smooth(k) for k in range(6)}
    late = {"c0": 0.0, "c1": 5.25, "c2": -7.5, "c3": 0.3, "c4": 12.0}
    b = {k: delayed(x[k], d) * (-1 if k == "c2" else 1) for k, d in late.items()} | {"c5": np.zeros(600)}
    ca, cb = (chunks.chunked(clips(spark, **v), length) for v in (x, b))
    found = chunks.aligned(ca, cb, length, 20)
    got = {r.clip: r for r in found.collect()}
    for k, d in late.items():
        assert abs(got[k].offset + got[k].fraction - d) < 0.02 and got[k].trusted and got[k].polarity == (-1 if k == "c2" else 1)
        at = int(np.argmax(np.abs([np.dot(x[k][max(0, -m) : 600 - max(0, m)], b[k][max(0, m) : 600 - max(0, -m)]) for m in range(-20, 21)]))) - 20
        assert got[k].offset == at
    assert (got["c5"].offset, got["c5"].r, got["c5"].trusted) == (0, 0.0, False)
    back: dict = {}
    for r in sorted(chunks.put_in_line(cb, found, length, 32).collect(), key=lambda r: r.chunk):
        back.setdefault(r.clip, []).extend(r.samples)
    for k in late:
        assert np.abs(np.array(back[k]) - x[k])[40:-40].max() < 0.02 * np.abs(x[k]).max()


def plain_run(frames):
    """(start, frames, pitch, periodicity) as one reads it off frame by frame."""
    best, run = None, []

    def close():
        nonlocal best
        if run and (best is None or len(run) > len(best)):
            best = list(run)

    for f, p, s in frames:
        if s is None or s <= signals.PERIODIC:
            close()
            run = []
        elif run and abs(p - run[0][1]) > signals.DRIFT * run[0][1]:
            close()
            run = [(f, p, s)]
        else:
            run.append((f, p, s))
    close()
    return best and (best[0][0], len(best), float(np.median([r[1] for r in best])), float(np.median([r[2] for r in best])))


def test_pitched_runs(spark):
    rng = random.Random(5)
    rows = {c: [(f, 100.0 + rng.choice([0, 0, 2, 4, 6, 30]), rng.choice([0.9, 0.8, 0.7, 0.7, None if c % 2 else 0.2])) for f in range(60)] for c in range(12)}
    rows[12] = [(0, 100.0, 0.1)]
    rows[13] = [(f, 100.0 + f, 0.9) for f in range(40)]
    df = spark.createDataFrame([(c, *r) for c, v in rows.items() for r in v], "clip int, frame int, pitch double, score double")
    got = {r.clip: (r.start, r.frames, r.pitch, r.periodicity) for r in signals.pitched_run(df).collect()}
    assert got == {c: w for c, v in rows.items() if (w := plain_run(v))} and 12 not in got


def test_harmonic_balance(spark):
    lines = [(1, 100.0 * k, float(100 / k)) for k in range(1, 6)] + [(1, 5050.0, 3.0), (1, 250.0, 1.0), (2, 100.0, 1.0)]
    df = spark.createDataFrame(lines, "clip int, hz double, power double")
    got = {r.clip: r for r in signals.harmonic_balance(df, spark.createDataFrame([(1, 100.0), (2, None), (3, 50.0)], "clip int, f0 double")).collect()}
    total = sum(p for c, _, p in lines if c == 1)
    assert got[1].hnr_db == pytest.approx(10 * np.log10((total - 4) / 4)) and got[1].odd_even_ratio == pytest.approx((100 / 3 + 20) / 75) and got[1].hf_residual_index == pytest.approx(3 / total) and len(got) == 1


def test_resolution_against_all_pairs(spark):
    rng = random.Random(2)
    log = [(k, rng.choice("ab"), rng.choice([0.0, -1.5, 1e6, 2.0 + rng.randrange(3) * 4e-4]), rng.choice([1.0, 3.0]), {"x": rng.choice(["1", "1.0", "2"]), **({"y": "t"} if rng.random() < 0.5 else {})}) for k in range(80)]
    log += [(90, "a", 5.0, 1.0, {}), (91, None, 5.0, 1.0, {"x": "1"}), (92, "a", None, 1.0, {"x": "1"}), (93, "c", 7.0, 1.0, {"x": "1"}), (94, "c", -7.0, 1.0, {"x": "1"})]
    asked = [(c, x + rng.choice([0, 1e-5 * max(1, abs(x)), 3e-4 * max(1, abs(x))]), y, s | {"z": "more"}) for _, c, x, y, s in log if x is not None] + [("c", 7.0, 1.0, {"x": "1.0"}), ("a", 1.0, 1.0, None)]
    number = lambda t: float(t) if t.replace(".", "").isdigit() else t

    def hits(c, x, y, s, tolerance=1e-4):
        near = lambda p, q: abs(p - q) <= tolerance * max(1, abs(p), abs(q))
        return [k for k, d, u, v, t in log if c is not None and c == d and u is not None and near(x, u) and near(y, v) and t and s is not None and all(j in s and number(s[j]) == number(t[j]) for j in t)]

    kind = "c string, x double, y double, s map<string,string>"
    out = audit.resolved(spark.createDataFrame(asked, kind), spark.createDataFrame(log, f"k int, {kind}"), "k", ["c"], ["x", "y"], "s", 1e-4).collect()
    assert len(out) == len(asked)
    for r in out:
        want = hits(r.c, r.x, r.y, r.s)
        assert r.hits == len(want) and r.found == (want[0] if len(want) == 1 else None)
    assert {1} < {r.hits for r in out}


def test_state_of_a_stream_equals_the_batch(spark, tmp_path):
    """Whatever the split into batches, out of order, with repeats, and after a restart."""
    own = spark.newSession()
    own.conf.set(*state.PROVIDER)
    rng = random.Random(4)
    rows = [(r, t, rng.choice([None, float("nan"), 1.0, 0.5, 2.0]), rng.choice([True, True, False, None])) for r in range(4) for t in range(25)] + [(None, 1, 1.0, False), (9, 3, None, True)]
    rng.shuffle(rows)
    schema = "run long, trial long, score double, failed boolean"
    (tmp_path / "in").mkdir()
    stream = own.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for k, at in enumerate((0, 40)):
        part = rows[at : at + 40] if not k else rows[at:]
        for piece in (part[: len(part) // 2], part[len(part) // 2 :]):
            own.createDataFrame(piece, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        got = state.states_of(own, stream, f"{tmp_path}/work").collect()  # the second time it goes on
        want = state.batch_state(own.createDataFrame(rows[: at + 40] if not k else rows, schema)).collect()
        assert sorted(map(str, got)) == sorted(map(str, want))


def test_idle_runs_are_given_once_more(spark, tmp_path):
    own = spark.newSession()
    own.conf.set(*state.PROVIDER)
    schema = "run long, trial long, score double, failed boolean"
    own.createDataFrame([(1, 1, 2.0, False)], schema).write.parquet(f"{tmp_path}/in")
    out: list = []
    states = state.running_state(own.readStream.schema(schema).parquet(f"{tmp_path}/in"), 1)
    query = states.writeStream.outputMode("update").foreachBatch(lambda b, k: out.extend(b.collect())).option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="1 second").start()
    for _ in range(40):
        query.awaitTermination(1)
        if any(r.expired for r in out):
            break
    query.stop()
    assert [(r.run, r.trials, r.expired) for r in out] == [(1, 1, False), (1, 1, True)]
