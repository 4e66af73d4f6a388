"""Calibration of a backend and its signals: repeats, grids, harmonics, alignment, cepstra and drawn settings."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import pi, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import prepare
from .parameters import ordered_union

#: How much a score may rise and not count as worse, and the correlation from which an alignment is trusted.
WORSE, TRUSTED = 5e-4, 0.3


def repeat_noise(levels: DataFrame, group: str, centre: str, level: str) -> DataFrame:
    """How far the level of a band spreads over repeats, and its median; a band without two measured repeats has no spread."""
    n = F.count(level)
    return levels.groupBy(group, centre).agg(F.when(n >= 2, F.max(level) - F.min(level)).alias("noise_db"), F.median(level).alias("median_db"), n.alias("repeats"))


def grid_crossing(points: DataFrame, group: str, position: str, value: str, least: float) -> DataFrame:
    """The first position of each group at which the value reaches a limit; null where it never does."""
    return points.groupBy(group).agg(F.min(F.when(F.col(value) >= least, F.col(position))).alias("crossing"))


def unordered_grid(points: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Rows whose value doesn't exceed that of the row before, which a grid may not have."""
    before = F.lag(value).over(W.partitionBy(group).orderBy(order))
    return points.withColumn("before", before).filter(F.col(value) <= F.col("before"))


def repeat_difference(a: DataFrame, b: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Two renders of the same signal: relative error in decibels (null for a silent first), largest difference and its place."""
    d = F.col("a") - F.col("b")
    both = a.select(group, order, F.col(value).alias("a")).join(b.select(group, order, F.col(value).alias("b")), [group, order])
    power = F.sum(F.col("a") * F.col("a"))
    return both.groupBy(group).agg(
        F.when(power > 0, 10 * F.log10(F.greatest(F.sum(d * d) / power, F.lit(1e-30)))).alias("error_db"),
        F.max(F.abs(d)).alias("largest"),
        F.max_by(order, F.struct(F.abs(d), -F.col(order))).alias("place"),
    )


def harmonic_support(peaks: DataFrame, group: str, at: str, most: int, tolerance: float) -> DataFrame:
    """(group, root, multiples): how many of the second to the given multiple of each peak are peaks too.

    Positions lie in cells as wide as the interval that a multiple may lie in, so that it meets two cells at most.
    Peaks without any such multiple, and those at zero or below, are left out.
    """
    p = peaks.select(group, F.col(at).cast("double").alias("at")).filter("at > 0").distinct()
    cell = lambda x: F.floor(x / (2 * tolerance))
    goals = p.select(group, F.col("at").alias("root"), F.explode(F.sequence(F.lit(2), F.lit(most))).alias("k")).withColumn("goal", F.col("root") * F.col("k"))
    goals = goals.withColumn("cell", F.explode(F.array_distinct(F.array(cell(F.col("goal") - tolerance), cell(F.col("goal") + tolerance)))))
    met = goals.join(p.withColumn("cell", cell(F.col("at"))), [group, "cell"]).filter(F.abs(F.col("at") - F.col("goal")) <= tolerance)
    return met.groupBy(group, "root").agg(F.count_distinct("k").alias("multiples"))


def regressions(before: DataFrame, after: DataFrame, keys: Sequence[str], value: str, tolerance: float = WORSE) -> DataFrame:
    """Objectives (lower is better) that a change made worse by more than a tolerance; those missing on a side can't be told."""
    both = before.select(*keys, F.col(value).alias("was")).join(after.select(*keys, F.col(value).alias("now")), list(keys))
    return both.filter(F.col("now") > F.col("was") + tolerance)


def random_settings(dimensions: DataFrame, name: str, low: str, high: str, samples: int, seed: int) -> DataFrame:
    """(name, sample, value): evenly drawn values of every dimension, the same for the same seed wherever they are made."""
    drawn = dimensions.select(name, low, high, F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample"))
    key = F.concat_ws(":", F.lit(str(seed)), F.col(name).cast("string"), F.col("sample").cast("string"))
    u = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / 2**32
    return drawn.select(name, "sample", (F.col(low) + u * (F.col(high) - F.col(low))).alias("value"))


def cepstra(levels: DataFrame, group: str, order: str, level: str, size: int, coefficients: int) -> DataFrame:
    """(group, coefficient, value): the first cosine coefficients of a curve of size points, order counting from 0."""
    each = levels.select(group, F.col(order).alias("i"), F.col(level).alias("x"), F.explode(F.sequence(F.lit(1), F.lit(coefficients))).alias("coefficient"))
    wave = F.cos(pi / size * F.col("coefficient") * (F.col("i") + 0.5))
    return each.groupBy(group, "coefficient").agg((F.sum(F.col("x") * wave) * sqrt(2 / size)).alias("value"))


def covariances(rows: DataFrame, group: str, features: Sequence[str]) -> DataFrame:
    """Means, population deviations and sample covariances of features, in one aggregation."""
    pairs = [(a, b) for k, a in enumerate(features) for b in features[k + 1 :]]
    return rows.groupBy(group).agg(
        *(F.avg(f).alias(f"mean_{f}") for f in features), *(F.stddev_pop(f).alias(f"deviation_{f}") for f in features), *(F.covar_samp(a, b).alias(f"cov_{a}_{b}") for a, b in pairs)
    )


def alignment(a: DataFrame, b: DataFrame, group: str, order: str, value: str, reach: int) -> DataFrame:
    """(group, lag, r, trusted): by how many rows b is late, within a reach, from the strongest correlation of either sign.

    Each row meets its lags only. The smallest lag wins among equals; without energy on both sides r is null and not trusted.
    """
    x = a.select(group, F.col(order).alias("i"), F.col(value).alias("a"))
    y = b.select(group, F.col(order).alias("j"), F.col(value).alias("b"))
    moved = y.select(group, "j", "b", F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("lag")).select(group, (F.col("j") - F.col("lag")).alias("i"), "b", "lag")
    sums = x.join(moved, [group, "i"]).groupBy(group, "lag").agg(F.sum(F.col("a") * F.col("b")).alias("s"))
    best = sums.groupBy(group).agg(F.max(F.struct(F.abs("s").alias("m"), (-F.abs("lag")).alias("near"), "lag", "s")).alias("t"))
    energy = x.groupBy(group).agg(F.sum(F.col("a") * F.col("a")).alias("ea")).join(y.groupBy(group).agg(F.sum(F.col("b") * F.col("b")).alias("eb")), group)
    r = F.when((F.col("ea") > 0) & (F.col("eb") > 0), F.col("t.s") / F.sqrt(F.col("ea") * F.col("eb")))
    return best.join(energy, group).select(group, F.col("t.lag").alias("lag"), r.alias("r")).withColumn("trusted", F.coalesce(F.abs("r") >= TRUSTED, F.lit(False)))


def detrended(x: DataFrame, group: str, order: str, value: str, reach: int) -> DataFrame:
    """Adds above: a value less the median of those within reach rows, fewer at the ends; a frame holds 2 * reach + 1 rows."""
    around = F.array_sort(F.collect_list(value).over(W.partitionBy(group).orderBy(order).rowsBetween(-reach, reach)))
    held = x.withColumn("_around", around)
    median = F.expr("(get(_around, (size(_around) - 1) div 2) + get(_around, size(_around) div 2)) / 2")
    return held.withColumn("above", F.col(value) - median).drop("_around")


def neutral_settings(paths: DataFrame, ranges: DataFrame) -> DataFrame:
    """(path, control, value, fault): the flat state in which a signal path's bands are measured.

    paths has path, settings (a map), switches and bands (arrays of controls), highpass and lowpass (a control or null); ranges
    has control, low and high. Switches are on and bands at zero, the high-pass at its lowest and the low-pass at its highest,
    each over the path's own settings. A filter without a declared end has a null value and the fault "no declared range".
    """
    listed = lambda c, value: paths.select("path", F.explode(c).alias("control")).select("path", "control", F.lit(value).alias("value"), F.lit(None).cast("string").alias("fault"))

    def filters(column: str, end: str) -> DataFrame:
        own = paths.filter(F.col(column).isNotNull()).select("path", F.col(column).alias("control"))
        known = ranges.select("control", F.col(end).cast("double").alias("e"))
        return own.join(known, "control", "left").select("path", "control", F.col("e").cast("string").alias("value"), F.when(F.col("e").isNull(), "no declared range").alias("fault"))

    own = paths.select("path", F.explode("settings").alias("control", "value")).withColumn("fault", F.lit(None).cast("string"))
    layers = ordered_union(own, listed("switches", "true"), listed("bands", "0.0"), filters("highpass", "low"), filters("lowpass", "high"))
    last = layers.groupBy("path", "control").agg(F.max_by(F.struct("value", "fault"), "layer").alias("e"))
    return last.select("path", "control", "e.value", "e.fault")


def topology_keys(settings: DataFrame, *facts: str) -> DataFrame:
    """(path, key): a digest of each path's settings (path, control, value) in the order of controls, and of further columns."""
    pair = F.struct("control", F.coalesce(F.col("value").cast("string"), F.lit("")).alias("value"))
    held = settings.groupBy("path", *facts).agg(F.array_sort(F.collect_list(pair)).alias("s"))
    text = F.array_join(F.transform("s", lambda e: F.concat(e["control"], F.lit("="), e["value"])), "\n")
    return held.select("path", F.sha2(F.concat_ws("\n", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in facts), text), 256).alias("key"))


def principal_axes(rows: DataFrame, group: str, features: Sequence[str], count: int = 3) -> DataFrame:
    """(group, axis, variance, loadings) of the axes of largest variance, loadings in the order of the features.

    The sample covariances are one aggregation; only their matrix, a row for each group, is decomposed. Of an axis' loadings the
    largest in size is positive. A group of one row has no axes; a feature that is null everywhere counts as constant.
    """
    n = len(features)
    upper = [(a, b) for a in range(n) for b in range(a, n)]

    def axes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for matrices in batches:
            out = []
            for cells in matrices:
                m = np.zeros((n, n))
                for (a, b), c in zip(upper, cells, strict=True):
                    m[a, b] = m[b, a] = c
                values, vectors = np.linalg.eigh(m)
                best = np.argsort(-values, kind="stable")[:count]
                turned = [vectors[:, k] * np.sign(vectors[np.argmax(np.abs(vectors[:, k])), k]) for k in best]
                out.append([{"variance": float(values[k]), "loadings": v.tolist()} for k, v in zip(best, turned, strict=True)])
            yield pd.Series(out)

    prepare(rows.sparkSession)
    cells = F.array(*(F.coalesce(F.covar_samp(features[a], features[b]), F.lit(0.0)) for a, b in upper))
    found = rows.groupBy(group).agg(cells.alias("m"), F.count("*").alias("n")).filter("n > 1")
    made = F.pandas_udf(axes, "array<struct<variance:double,loadings:array<double>>>")("m")
    return found.select(group, F.posexplode(made).alias("axis", "a")).select(group, "axis", "a.variance", "a.loadings")
