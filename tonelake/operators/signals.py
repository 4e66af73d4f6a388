"""Signals as tables: frames, levels, spectra, bands, onsets and periodicities.

A clip's samples lie in rows of chunks; frames overlap chunks by a join on the chunk that a frame begins in. Only the Fourier
transform of a frame runs in Python; all statistics over frames and bins are aggregations and windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import prepare

#: Frames of the spectrum, and decibels below a clip's loudest frame at which a frame counts as silent.
FRAME, HOP, GATE_DB = 2048, 512, 45.0
#: Centres of the third-octave bands: thirds of an octave about 1 kHz.
BANDS = [round(1000.0 * 2 ** (k / 3), 1) for k in range(-14, 14)]


def frames(clips: DataFrame, size: int = FRAME, hop: int = HOP) -> DataFrame:
    """(clip, frame, samples): overlapping whole frames of clips (clip, samples array); the last partial one is left out."""
    n = F.greatest(F.size("samples") - size, F.lit(-1)).cast("int")
    starts = F.when(n >= 0, F.sequence(F.lit(0), n, F.lit(hop))).otherwise(F.array().cast("array<int>"))
    return clips.select("clip", "samples", F.posexplode(starts).alias("frame", "start")).select("clip", "frame", F.slice("samples", F.col("start") + 1, size).alias("samples"))


def frame_levels(framed: DataFrame) -> DataFrame:
    """Adds level, the frame's root mean square in decibels."""
    power = F.aggregate("samples", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) / F.size("samples")
    return framed.withColumn("level", 10 * F.log10(F.greatest(power, F.lit(1e-30))))


def sounding(levels: DataFrame, clip: str = "clip", level: str = "level", gate_db: float = GATE_DB) -> DataFrame:
    """Frames within gate_db of their clip's loudest; the maximum is aggregated and joined back."""
    top = levels.groupBy(clip).agg(F.max(level).alias("_top"))
    return levels.join(top, clip).filter(F.col(level) > F.col("_top") - gate_db).drop("_top")


def spectra(framed: DataFrame, rate: int) -> DataFrame:
    """(clip, frame, hz, power): the power spectrum of each Hann-windowed frame."""
    prepare(framed.sparkSession)

    def power(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            out = []
            for x in b:
                y = np.asarray(x, float)
                w = np.hanning(len(y) + 1)[:-1]
                out.append((np.abs(np.fft.rfft(y * w)) ** 2 / max(w @ w, 1e-30)).tolist())
            yield pd.Series(out)

    udf = F.pandas_udf(power, "array<double>")
    p = framed.select("clip", "frame", F.size("samples").alias("size"), udf("samples").alias("p"))
    return p.select("clip", "frame", "size", F.posexplode("p").alias("bin", "power")).select("clip", "frame", (F.col("bin") * rate / F.col("size")).alias("hz"), "power")


def band_energies(bins: DataFrame) -> DataFrame:
    """(clip, band_hz, db): the mean power over frames, summed in third-octave bands. A bin's band follows from its logarithm."""
    third = F.round(3 * F.log2(F.col("hz") / 1000.0)).cast("int")
    mean = bins.filter("hz > 0").groupBy("clip", "hz").agg(F.avg("power").alias("power"))
    sums = mean.withColumn("third", third).filter(F.col("third").between(-14, 13)).groupBy("clip", "third").agg(F.sum("power").alias("power"))
    return sums.select("clip", F.round(1000.0 * F.pow(F.lit(2.0), F.col("third") / 3), 1).alias("band_hz"), (10 * F.log10(F.greatest("power", F.lit(1e-30)))).alias("db"))


def spectral_statistics(bins: DataFrame) -> DataFrame:
    """Per clip the 10th, 50th and 90th percentiles over frames of centroid, 85 % roll-off and flatness."""
    running = W.partitionBy("clip", "frame").orderBy("hz").rowsBetween(W.unboundedPreceding, W.currentRow)
    b = bins.filter("hz > 0").withColumns({"run": F.sum("power").over(running), "all": F.sum("power").over(W.partitionBy("clip", "frame"))})
    per = b.filter("all > 0").groupBy("clip", "frame").agg(
        (F.sum(F.col("hz") * F.col("power")) / F.sum("power")).alias("centroid_hz"),
        F.min(F.when(F.col("run") >= 0.85 * F.col("all"), F.col("hz"))).alias("rolloff85_hz"),
        (F.exp(F.avg(F.log(F.greatest("power", F.lit(1e-30))))) / F.avg("power")).alias("flatness"),
    )
    return per.groupBy("clip").agg(*(_percentiles(c) for c in ("centroid_hz", "rolloff85_hz", "flatness")))


def _percentiles(c: str) -> Column:
    p = F.percentile(c, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    return F.struct(p[0].alias("p10"), p[1].alias("p50"), p[2].alias("p90")).alias(c)


def tilt(bands: DataFrame) -> DataFrame:
    """Decibels per decade over a clip's bands."""
    return bands.groupBy("clip").agg(F.regr_slope("db", F.log10("band_hz")).alias("tilt_db_per_decade"))


def flux(bins: DataFrame) -> DataFrame:
    """(clip, frame, flux): how much each bin's magnitude grew since the frame before, summed."""
    m = F.sqrt("power")
    grown = F.greatest(m - F.lag(m).over(W.partitionBy("clip", "hz").orderBy("frame")), F.lit(0.0))
    return bins.withColumn("grown", grown).groupBy("clip", "frame").agg(F.sum("grown").alias("flux"))


def onsets(novelty: DataFrame, width: int = 12, factor: float = 1.5) -> DataFrame:
    """(clip, frame): local peaks of the flux above a multiple of its moving mean, whose window repeats the values at the edges."""
    w = W.partitionBy("clip").orderBy("frame")
    around = w.rowsBetween(-width, width)
    n, total = F.count("flux").over(around), F.sum("flux").over(around)
    ends = W.partitionBy("clip").orderBy("frame").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    first, last, rank, size = F.first("flux").over(ends), F.last("flux").over(ends), F.row_number().over(w), F.count("*").over(ends)
    missing = F.greatest(F.lit(width + 1) - rank, F.lit(0)) * first + F.greatest(rank + width - size, F.lit(0)) * last
    mean = (total + missing) / (2 * width + 1)
    x = novelty.withColumns({"mean": mean, "before": F.lag("flux").over(w), "after": F.lead("flux").over(w)})
    return x.filter(F.col("flux") > factor * F.col("mean")).filter("flux > coalesce(before, -1) and flux >= coalesce(after, -1)").select("clip", "frame")


def densest_window(flags: DataFrame, group: str, order: str, flag: str, span: int) -> DataFrame:
    """The start of the span of rows with the most flags; the first of equals, whole spans only."""
    w = W.partitionBy(group).orderBy(order)
    x = flags.withColumns({"held": F.sum(F.col(flag).cast("int")).over(w.rowsBetween(0, span - 1)), "left": F.count("*").over(w.rowsBetween(0, span - 1))})
    best = F.min(F.struct((-F.col("held")).alias("k"), F.col(order).alias("start")))
    return x.filter(F.col("left") == span).groupBy(group).agg(best.alias("b")).select(group, F.col("b.start").alias("start"), (-F.col("b.k")).alias("held"))


def longest_run(flags: DataFrame, group: str, order: str, flag: str) -> DataFrame:
    """The longest run of rows with the flag: rows and the first of them (the earliest of equals)."""
    w = W.partitionBy(group).orderBy(order)
    n = flags.withColumn("_all", F.row_number().over(w)).filter(flag)
    island = F.col("_all") - F.row_number().over(w)
    runs = n.withColumn("_island", island).groupBy(group, "_island").agg(F.count("*").alias("rows"), F.min(order).alias("start"))
    best = F.min(F.struct((-F.col("rows")).alias("k"), "start"))
    return runs.groupBy(group).agg(best.alias("b")).select(group, (-F.col("b.k")).alias("rows"), F.col("b.start").alias("start"))


def autocorrelation(x: DataFrame, group: str, order: str, value: str, lags: int) -> DataFrame:
    """(group, lag, r) for lags from 1, normalised by the group's energy; order is gapless. Each row meets its lags only."""
    a = x.select(group, F.col(order).alias("i"), F.col(value).alias("a"))
    later = a.select(group, F.col("i"), F.col("a").alias("b"), F.explode(F.sequence(F.lit(1), F.lit(lags))).alias("lag")).select(group, (F.col("i") - F.col("lag")).alias("i"), "b", "lag")
    energy = a.groupBy(group).agg(F.sum(F.col("a") * F.col("a")).alias("energy"))
    r = a.join(later, [group, "i"]).groupBy(group, "lag").agg(F.sum(F.col("a") * F.col("b")).alias("s"))
    return r.join(energy, group).filter("energy > 0").select(group, "lag", (F.col("s") / F.col("energy")).alias("r"))


def goertzel(x: DataFrame, group: str, order: str, value: str, cycles: list[float], size: Column) -> DataFrame:
    """(group, cycles, power) of the given numbers of cycles within size samples: two sums for each."""
    tone = x.select(group, F.col(order).alias("i"), F.col(value).alias("x"), size.alias("size"), F.explode(F.array(*map(F.lit, cycles))).alias("cycles"))
    angle = 2 * np.pi * F.col("cycles") * F.col("i") / F.col("size")
    s = tone.groupBy(group, "cycles", "size").agg(F.sum(F.col("x") * F.cos(angle)).alias("c"), F.sum(F.col("x") * F.sin(angle)).alias("s"))
    return s.select(group, "cycles", ((F.col("c") * F.col("c") + F.col("s") * F.col("s")) * 4 / (F.col("size") * F.col("size"))).alias("power"))


def distortion(powers: DataFrame, group: str, fundamental: float, harmonics: int = 8) -> DataFrame:
    """Total harmonic distortion in percent: the second to the given harmonic against the fundamental."""
    k = F.col("cycles") / fundamental
    return powers.groupBy(group).agg(F.sum(F.when(k.between(2, harmonics), F.col("power"))).alias("h"), F.sum(F.when(k == 1, F.col("power"))).alias("f")).select(group, F.when(F.col("f") > 0, 100 * F.sqrt(F.col("h") / F.col("f"))).alias("thd_percent"))


def residual_db(a: DataFrame, b: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Energy of the difference of two aligned signals against the first, in decibels; null for a silent first."""
    both = a.select(group, order, F.col(value).alias("a")).join(b.select(group, order, F.col(value).alias("b")), [group, order])
    d, e = F.avg((F.col("a") - F.col("b")) ** 2), F.avg(F.col("a") ** 2)
    return both.groupBy(group).agg(F.when(e > 0, 10 * F.log10(F.greatest(d / e, F.lit(1e-30)))).alias("residual_db"))


def stereo(samples: DataFrame, group: str, left: str, right: str) -> DataFrame:
    """Width (side against mid and side energy) and correlation of two channels; null where a channel has no variance."""
    mid, side = (F.col(left) + F.col(right)) / 2, (F.col(left) - F.col(right)) / 2
    return samples.groupBy(group).agg(
        (F.sum(side * side) / F.nullif(F.sum(mid * mid) + F.sum(side * side), F.lit(0.0))).alias("width"),
        F.when((F.var_pop(left) > 0) & (F.var_pop(right) > 0), F.corr(left, right)).alias("correlation"),
    )


def attack_segments(starts: DataFrame, clip: str = "clip", frame: str = "frame") -> DataFrame:
    """Segments from each onset to the next; the last is open."""
    return starts.withColumn("until", F.lead(frame).over(W.partitionBy(clip).orderBy(frame)))


def primary_onsets(starts: DataFrame, gap: int, clip: str = "clip", frame: str = "frame") -> DataFrame:
    """Onsets with more than gap frames since the one before."""
    before = F.lag(frame).over(W.partitionBy(clip).orderBy(frame))
    return starts.withColumn("_b", before).filter(F.col("_b").isNull() | (F.col(frame) - F.col("_b") > gap)).drop("_b")


def frame_records(clips: DataFrame, rate: int, size: int = FRAME, hop: int = HOP, gate_db: float = GATE_DB) -> DataFrame:
    """(clip, frame, level, heard, peak, bands, centroid_hz, rolloff85_hz, flatness, flux) of each frame above the floor.

    A frame is one row whatever its number of bins: its power is summed in bands where it is transformed, and bands without a
    bin are null. Frames that aren't heard have a level only; flux is the growth of magnitudes since the heard frame before.
    """
    prepare(clips.sparkSession)
    window = np.hanning(size + 1)[:-1]
    hz = np.arange(size // 2 + 1) * rate / size
    third = np.full(len(hz), -99)
    third[1:] = np.round(3 * np.log2(hz[1:] / 1000.0))
    inside = (third >= -14) & (third <= 13)
    held = np.bincount(third[inside] + 14, minlength=len(BANDS)) > 0
    names = ["clip", "frame", "level", "heard", "peak", "bands", "centroid_hz", "rolloff85_hz", "flatness", "flux"]

    def measured(x: np.ndarray) -> dict[str, list]:
        n = max(0, (len(x) - size) // hop + 1)
        rows = np.lib.stride_tricks.sliding_window_view(x, size)[::hop][:n] if n else np.empty((0, size))
        level = 10 * np.log10(np.maximum((rows * rows).mean(1), 1e-30)) if n else np.empty(0)
        at = np.flatnonzero(level > -200)
        heard = at[level[at] > level[at].max() - gate_db] if len(at) else at
        out = {c: [None] * len(at) for c in names[5:]}
        place, before = {f: k for k, f in enumerate(at.tolist())}, None
        for f in heard.tolist():
            p = np.abs(np.fft.rfft(rows[f] * window)) ** 2 / max(window @ window, 1e-30)
            k, own = place[f], p[1:]
            sums = np.bincount(third[inside] + 14, weights=p[inside], minlength=len(BANDS))
            out["bands"][k] = [float(s) if h else None for s, h in zip(sums, held, strict=True)]
            if (total := own.sum()) > 0:
                out["centroid_hz"][k] = float(hz[1:] @ own / total)
                out["rolloff85_hz"][k] = float(hz[1:][np.searchsorted(np.cumsum(own), 0.85 * total)])
                out["flatness"][k] = float(np.exp(np.log(np.maximum(own, 1e-30)).mean()) / own.mean())
            m = np.sqrt(p)
            out["flux"][k] = float(np.maximum(m - before, 0).sum()) if before is not None else 0.0
            before = m
        chosen = set(heard.tolist())
        return {"frame": at.tolist(), "level": level[at].tolist(), "heard": [f in chosen for f in at.tolist()], "peak": [float(np.abs(x).max())] * len(at) if len(at) else []} | out

    kinds = [pa.int32(), pa.float64(), pa.bool_(), pa.float64(), pa.list_(pa.float64()), *[pa.float64()] * 4]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, samples in enumerate(b.column("samples")):
                made = measured(samples.values.to_numpy(zero_copy_only=False).astype(float) if samples.is_valid else np.empty(0))
                n = len(made["frame"])
                clip = b.column("clip").take(pa.array([k] * n, pa.int32()))
                yield pa.RecordBatch.from_arrays([clip, *(pa.array(made[c], kind) for c, kind in zip(names[1:], kinds, strict=True))], names)

    kind = clips.schema["clip"].dataType.simpleString()
    schema = f"clip {kind}, frame int, level double, heard boolean, peak double, bands array<double>, centroid_hz double, rolloff85_hz double, flatness double, flux double"
    return clips.select("clip", "samples").mapInArrow(rows, schema)


def corners(centres: Column, levels: Column, drop_db: float = 6.0) -> Column:
    """A struct (low_hz, high_hz) of the outermost bands within drop_db of the loudest, placed between bands by the logarithm of
    frequency; null for fewer than six bands."""
    top = F.array_max(levels)
    inside = F.filter(F.sequence(F.lit(0), F.greatest(F.size(levels) - 1, F.lit(0))), lambda k: F.get(levels, k) >= top - drop_db)

    def crossing(k: Column, outside: Column) -> Column:
        span = F.get(levels, k) - F.get(levels, outside)
        share = (F.get(levels, k) - (top - drop_db)) / span
        hz = F.pow(F.lit(10.0), F.log10(F.get(centres, k)) + share * (F.log10(F.get(centres, outside)) - F.log10(F.get(centres, k))))
        return F.when((outside >= 0) & (outside < F.size(centres)) & (span > 0), hz).otherwise(F.get(centres, k))

    low, high = F.array_min(inside), F.array_max(inside)
    return F.when(F.size(centres) >= 6, F.struct(crossing(low, low - 1).alias("low_hz"), crossing(high, high + 1).alias("high_hz")))


def mel(hz: Column) -> Column:
    return 2595.0 * F.log10(1.0 + hz / 700.0)


def from_mel(m: Column) -> Column:
    return 700.0 * (F.pow(F.lit(10.0), m / 2595.0) - 1.0)


def mel_filters(rate: int, size: int, count: int = 40, low: float = 30.0, high: float = 16_000.0) -> np.ndarray:
    """Triangular filters (filter, bin) with corners at whole bins, evenly spaced in mels."""
    high = min(high, rate / 2.0)
    ends = 2595.0 * np.log10(1.0 + np.array([low, high]) / 700.0)
    hz = 700.0 * (10.0 ** (np.linspace(*ends, count + 2) / 2595.0) - 1.0)
    at = np.clip((size + 1) * hz // rate, 0, size // 2).astype(int)
    k = np.arange(size // 2 + 1)
    left, mid, right = at[:-2, None], at[1:-1, None], at[2:, None]
    sound = (left < mid) & (mid < right)
    up = (k >= left) & (k < mid) & sound
    down = (k >= mid) & (k < right) & sound
    return np.where(up, (k - left) / np.maximum(mid - left, 1), 0.0) + np.where(down, (right - k) / np.maximum(right - mid, 1), 0.0)


def tones(requests: DataFrame, rate: int) -> DataFrame:
    """Adds samples to requests (hz, amplitude, n): a sine of n samples from phase zero."""
    step = 2 * np.pi / rate
    wave = F.transform(F.sequence(F.lit(0), F.greatest(F.col("n"), F.lit(1)).cast("int") - 1), lambda k: F.col("amplitude") * F.sin(step * F.col("hz") * k))
    return requests.withColumn("samples", F.when(F.col("n") > 0, wave).otherwise(F.array().cast("array<double>")))


def slope_of(points: Column) -> Column:
    """The least-squares slope of an array of (x, y) structs; null without two different x."""
    total = lambda f: F.aggregate(points, F.lit(0.0), lambda s, p: s + f(p["x"], p["y"]))
    n, sx, sy = F.size(points), total(lambda x, y: x), total(lambda x, y: y)
    sxx, sxy = total(lambda x, y: x * x), total(lambda x, y: x * y)
    width = n * sxx - sx * sx
    return F.when(width > 0, (n * sxy - sx * sy) / width)


def fingerprints(clips: DataFrame, rate: int) -> DataFrame:
    """(clip, spectrum, dynamics, onsets): the measured record of each clip (clip, samples), from its sounding frames.

    Silence has no sounding frame above the floor and so no record: it isn't measured rather than zero.
    """
    f = frame_records(clips, rate)
    heard = lambda c: F.when(F.col("heard"), c)
    shape = ("centroid_hz", "rolloff85_hz", "flatness")
    bands = [F.struct(F.lit(hz).alias("hz"), F.when(F.count(F.col("bands")[k]) > 0, 10 * F.log10(F.greatest(F.avg(F.col("bands")[k]), F.lit(1e-30)))).alias("db")) for k, hz in enumerate(BANDS)]
    peaks = F.max("peak").alias("peak")
    a = f.groupBy("clip").agg(
        F.array(*bands).alias("b"), peaks, (10 * F.log10(F.avg(F.pow(F.lit(10.0), F.col("level") / 10)))).alias("mean_db"), _percentiles("level"), *(_percentiles(c) for c in shape)
    )
    a = a.withColumn("b", F.filter("b", lambda e: e["db"].isNotNull()))
    tilted = slope_of(F.transform("b", lambda e: F.struct(F.log10(e["hz"]).alias("x"), e["db"].alias("y"))))
    hits = onsets(f.filter("heard").select("clip", "frame", "flux")).groupBy("clip").agg(F.count("*").alias("onsets"))
    return a.join(hits, "clip", "left").select(
        "clip",
        F.struct(F.col("b.hz").alias("band_centres_hz"), F.col("b.db").alias("band_db"), tilted.alias("tilt_db_per_decade"), *shape).alias("spectrum"),
        F.struct((20 * F.log10(F.greatest("peak", F.lit(1e-12))) - F.col("mean_db")).alias("crest_db"), F.col("level").alias("rms_percentiles_db")).alias("dynamics"),
        "onsets",
    )


def peaks(values: Column, height: float, distance: int, prominence: float) -> Column:
    """Places (from 0) of an array's peaks: local maxima (a plateau's middle) of at least the height, of which none of two
    closer than distance but the higher is kept (the later of equals), and which stand out of their surroundings by the prominence."""

    def picked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([peak_places(np.asarray(x, float), height, distance, prominence) if x is not None else None for x in b])

    prepare(SparkSession.getActiveSession())
    return F.pandas_udf(picked, "array<int>")(values)


def peak_places(x: np.ndarray, height: float, distance: int, prominence: float) -> list[int]:
    """peaks() of one array; a small helper."""
    edge = np.flatnonzero(np.diff(x) != 0) + 1
    first, last = np.concatenate(([0], edge)), np.concatenate((edge, [len(x)])) - 1
    level = x[first] if len(x) else x
    top = [k for k in range(1, len(level) - 1) if level[k - 1] < level[k] > level[k + 1] and level[k] >= height]
    at = [int((first[k] + last[k]) // 2) for k in top]
    keep = np.ones(len(at), bool)
    for k in sorted(range(len(at)), key=lambda k: (x[at[k]], k), reverse=True):
        if keep[k]:
            for j in range(len(at)):
                keep[j] &= j == k or abs(at[j] - at[k]) >= distance
    out = []
    for p in (p for p, k in zip(at, keep, strict=True) if k):
        left, right = x[:p][::-1], x[p + 1 :]
        valley = [float(s[: np.argmax(s > x[p])].min(initial=x[p])) if (s > x[p]).any() else float(s.min(initial=x[p])) for s in (left, right)]
        if x[p] - max(valley) >= prominence:
            out.append(p)
    return out


def strongest_peaks(values: Column, places: Column, most: int = 6) -> Column:
    """The places of the highest peaks, highest first, then earliest."""
    ranked = F.array_sort(F.transform(places, lambda p: F.struct((-F.get(values, p)).alias("v"), p.alias("p"))))
    return F.slice(F.transform(ranked, lambda e: e["p"]), 1, most)


#: The periodicity above which a frame has a pitch, how far the pitch may leave the run's first, the harmonics that are
#: told apart, how near a line lies to one, and where a spectrum counts as high.
PERIODIC, DRIFT, HARMONICS, NEAR, HIGH_HZ = 0.55, 0.05, 24, 0.02, 4000.0


def pitched_run(framed: DataFrame, clip: str = "clip", frame: str = "frame") -> DataFrame:
    """(clip, start, frames, pitch, periodicity): the longest run of periodic frames (clip, frame, pitch, score) that stay near the run's first pitch.

    A run ends at a frame that isn't periodic or whose pitch leaves the first one's by more than DRIFT of it, where the next begins; the
    earliest of equals stands. pitch and periodicity are medians over the run. Frames are gapless by clip, a null score isn't periodic. Rows
    without a break in periodicity are gathered into an array of two numbers each and split by one fold.
    """
    w = W.partitionBy(clip).orderBy(frame)
    x = framed.withColumn("_n", F.row_number().over(w)).filter(F.col("score") > PERIODIC)
    x = x.withColumn("_island", F.col("_n") - F.row_number().over(w))
    islands = x.groupBy(clip, "_island").agg(F.array_sort(F.collect_list(F.struct(F.col(frame).cast("long").alias("f"), F.col("pitch").cast("double").alias("p"), F.col("score").cast("double").alias("s")))).alias("rows"))
    run = "struct<start:bigint,first:double,n:bigint>"
    begin = F.struct(F.lit(None).cast("bigint").alias("start"), F.lit(None).cast("double").alias("first"), F.lit(0).cast("bigint").alias("n"))
    state = F.struct(F.array().cast(f"array<{run}>").alias("done"), begin.alias("now"))

    def step(a: Column, r: Column) -> Column:
        new = F.struct(r["f"].alias("start"), r["p"].alias("first"), F.lit(1).cast("bigint").alias("n"))
        stays = F.abs(r["p"] - a["now"]["first"]) <= DRIFT * a["now"]["first"]
        longer = F.struct(a["now"]["start"].alias("start"), a["now"]["first"].alias("first"), (a["now"]["n"] + 1).alias("n"))
        ended = F.when(a["now"]["n"] > 0, F.array_append(a["done"], a["now"])).otherwise(a["done"])
        return F.struct(F.when(stays, a["done"]).otherwise(ended).alias("done"), F.when(stays, longer).otherwise(new).alias("now"))

    runs = islands.select(clip, "rows", F.explode(F.aggregate("rows", state, step, lambda a: F.array_append(a["done"], a["now"]))).alias("r"))
    own = F.filter("rows", lambda q: (q["f"] >= F.col("r.start")) & (F.col("r.n") > 0)).alias("own")
    best = runs.select(clip, F.col("r.n").alias("n"), F.col("r.start").alias("start"), own).withColumn("own", F.expr("slice(own, 1, int(n))"))
    first = F.min(F.struct((-F.col("n")).alias("less"), "start", "own")).alias("b")
    rows = best.groupBy(clip).agg(first).select(clip, F.col("b.start").alias("start"), (-F.col("b.less")).alias("frames"), F.explode("b.own").alias("o"))
    return rows.groupBy(clip, "start", "frames").agg(F.median("o.p").alias("pitch"), F.median("o.s").alias("periodicity"))


def harmonic_balance(lines: DataFrame, pitches: DataFrame, clip: str = "clip", resolution: float = 1.0, nyquist: float = float("inf")) -> DataFrame:
    """(clip, hnr_db, odd_even_ratio, hf_residual_index) from spectral lines (clip, hz, power) and pitches (clip, f0).

    A line belongs to each of the first HARMONICS below nyquist that it lies near: within two lines, or NEAR of the harmonic. The ratio
    is of odd ones from the third to even ones. Measures without a denominator are null; clips without a pitch are left out.
    """
    near = F.filter(F.sequence(F.lit(1), F.lit(HARMONICS)), lambda k: (F.abs(F.col("hz") - k * F.col("f0")) <= F.greatest(F.lit(2 * resolution), k * F.col("f0") * NEAR)) & (k * F.col("f0") < nyquist))
    x = lines.join(pitches.filter("f0 > 0").select(clip, "f0"), clip).withColumn("near", near)
    odd, even = F.size(F.filter("near", lambda k: (k % 2 == 1) & (k > 1))), F.size(F.filter("near", lambda k: k % 2 == 0))
    p = F.col("power")
    sums = x.groupBy(clip).agg(
        F.sum(p).alias("total"), F.sum(p * F.size("near")).alias("harmonic"), F.sum(p * odd).alias("odd"), F.sum(p * even).alias("even"), F.sum(F.when((F.col("hz") >= HIGH_HZ) & (F.size("near") == 0), p).otherwise(0.0)).alias("fizz")
    )
    rest = F.greatest(F.col("total") - F.col("harmonic"), F.lit(0.0))
    return sums.select(
        clip,
        F.when((rest > 0) & (F.col("harmonic") > 0), 10 * F.log10(F.col("harmonic") / rest)).alias("hnr_db"),
        F.when(F.col("even") > 0, F.col("odd") / F.col("even")).alias("odd_even_ratio"),
        F.when(F.col("total") > 0, F.col("fizz") / F.col("total")).alias("hf_residual_index"),
    )
