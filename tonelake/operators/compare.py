"""Distances between measurements: nullable terms, named dimensions, nearest entries, ranges and fronts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import prepare

# Weights and scales of the loss profiles.
PROFILES = {
    "unpaired-v1": {
        "weights": {"timbre": 1.0, "dynamics": 0.4, "ambience": 0.5, "level": 0.15, "harmonic": 0.4, "spatial": 0.2, "residual": 0.0, "prior_deviation": 0.15, "complexity": 0.0},
        "scales": {
            "band_db": 3.0, "tilt_db_per_decade": 2.0, "centroid_hz": 600.0, "rolloff85_hz": 1500.0, "mfcc": 12.0, "crest_db": 3.0, "attack_ms": 20.0, "decay_db_per_s": 6.0,
            "lra_lu": 3.0, "rms_spread_db": 4.0, "rt60_s": 0.4, "delay_ms": 40.0, "delay_feedback": 0.2, "am_rate_hz": 0.8, "am_depth": 0.15, "lufs_i": 3.0, "hnr_db": 6.0,
            "odd_even_ratio": 0.6, "hf_residual_index": 0.05, "width": 0.15, "correlation": 0.3, "residual_db": 6.0, "residual_floor_db": -17.0,
        },
    },
    "paired-v1": {
        "weights": {"timbre": 1.0, "dynamics": 0.8, "ambience": 0.8, "level": 0.3, "harmonic": 0.7, "spatial": 0.3, "residual": 0.9, "prior_deviation": 0.1, "complexity": 0.0},
        "scales": {
            "band_db": 2.0, "tilt_db_per_decade": 1.5, "centroid_hz": 400.0, "rolloff85_hz": 1000.0, "mfcc": 8.0, "crest_db": 2.0, "attack_ms": 10.0, "decay_db_per_s": 4.0,
            "lra_lu": 2.0, "rms_spread_db": 3.0, "rt60_s": 0.25, "delay_ms": 20.0, "delay_feedback": 0.12, "am_rate_hz": 0.4, "am_depth": 0.1, "lufs_i": 2.0, "hnr_db": 4.0,
            "odd_even_ratio": 0.4, "hf_residual_index": 0.03, "width": 0.1, "correlation": 0.2, "residual_db": 6.0, "residual_floor_db": -17.0,
        },
    },
}
#: Confidences from which reverb, delay and distortion count as measured.
RT60_SURE, DELAY_SURE, HARMONIC_SURE = 0.3, 0.15, 0.4


def finite(x: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def mean_of(*terms: Column) -> Column:
    """The mean of the terms that aren't null; null if all are."""
    kept = F.array_compact(F.array(*terms))
    return F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda s, x: s + x) / F.size(kept))


def weighted(values: Mapping[str, Column], weights: Mapping[str, float]) -> Column:
    """The mean of the measured values by their weights, renormalised over them; null if none with a weight is measured."""
    used = {n: c for n, c in values.items() if weights.get(n, 0.0) > 0}
    zero = F.lit(0.0)
    total = sum((F.coalesce(c * weights[n], zero) for n, c in used.items()), zero)
    weight = sum((F.when(c.isNotNull(), F.lit(weights[n])).otherwise(zero) for n, c in used.items()), zero)
    return F.when(weight > 0, total / weight)


def band_shape(a: Column, b: Column) -> Column:
    """The root mean square of the differences of two arrays about their mean: shape without level."""
    n = F.size(a)
    d = F.zip_with(a, b, lambda x, y: (x - y).cast("double"))
    mean = F.aggregate(d, F.lit(0.0), lambda s, x: s + x) / n
    square = F.aggregate(F.transform(d, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda s, x: s + x) / n
    return F.when((n > 0) & (n == F.size(b)), F.sqrt(square))


def shared_differences(a_centres: Column, a: Column, b_centres: Column, b: Column) -> Column:
    """The differences a - b of the bands whose centres both have, as an array in the order of a."""
    band = F.zip_with(a_centres, a, lambda c, v: F.struct(c.alias("c"), v.alias("v")))
    shared = F.filter(band, lambda e: F.array_contains(b_centres, e["c"]))
    return F.array_compact(F.transform(shared, lambda e: e["v"] - F.get(b, F.array_position(b_centres, e["c"]).cast("int") - 1)))


def rms_about_mean(d: Column) -> Column:
    """The root mean square of an array about its mean; null for an empty one."""
    n = F.size(d)
    mean = F.aggregate(d, F.lit(0.0), lambda s, x: s + x) / n
    return F.when(n > 0, F.sqrt(F.aggregate(F.transform(d, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda s, x: s + x) / n))


def band_differences(a: DataFrame, b: DataFrame, pair: Sequence[str], centre: str, level: str) -> DataFrame:
    """Per shared band of each pair: its level difference less the pair's mean difference."""
    both = a.select(*pair, centre, F.col(level).alias("_a")).join(b.select(*pair, centre, F.col(level).alias("_b")), [*pair, centre])
    d = F.col("_a") - F.col("_b")
    return both.select(*pair, centre, (d - F.avg(d).over(W.partitionBy(*pair))).alias("delta"))


def objectives(t: str, c: str, scales: Mapping[str, float], residual_db: Column | None = None) -> dict[str, Column]:
    """Nullable named distances between two fingerprint structs (columns t and c).

    Bands are compared where both have their centre, centroid and roll-off by their medians. What one side didn't measure
    drops out; an echo that only one side has is a whole unit.
    """
    x, y = (lambda name: F.col(f"{t}.{name}")), (lambda name: F.col(f"{c}.{name}"))
    known = lambda v: F.coalesce(v, F.lit(0.0))

    def term(name: str, scale: str) -> Column:
        return finite(F.abs(x(name) - y(name)) / scales[scale])

    def both(name: str) -> Column:
        return F.least(known(x(name)), known(y(name)))

    bands = rms_about_mean(shared_differences(*(v(f"spectrum.{n}") for v in (x, y) for n in ("band_centres_hz", "band_db")))) / scales["band_db"]
    cut = lambda v: F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0)))
    mx, my = x("cepstral.mfcc_mean"), y("cepstral.mfcc_mean")
    mfcc = F.sqrt(F.aggregate(F.zip_with(cut(mx), cut(my), lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)) / scales["mfcc"]
    spread = lambda v: v("dynamics.rms_percentiles_db.p90") - F.coalesce(v("dynamics.rms_percentiles_db.p10"), v("dynamics.rms_percentiles_db.p90"))
    rt60 = F.when(both("time_fx.rt60_confidence") >= RT60_SURE, term("time_fx.rt60_s", "rt60_s"))
    has_t, has_c = (known(v("time_fx.delay_confidence")) >= DELAY_SURE for v in (x, y))
    echo = F.when(has_t & has_c, term("time_fx.delay_ms", "delay_ms")).when(has_t != has_c, 1.0)
    feedback = F.when(has_t & has_c, term("time_fx.delay_feedback_est", "delay_feedback"))
    wobble = both("modulation.am_confidence")
    am = [F.when(wobble > 0, term(f"modulation.{n}", s) * wobble) for n, s in (("am_depth", "am_depth"), ("am_rate_hz", "am_rate_hz"))]
    sure = both("harmonic.confidence")
    harmonic = [F.when(sure >= HARMONIC_SURE, term(f"harmonic.{n}", n) * sure) for n in ("hnr_db", "odd_even_ratio", "hf_residual_index")]
    stereo = (F.coalesce(x("source.channels"), F.lit(1)) >= 2) & (F.coalesce(y("source.channels"), F.lit(1)) >= 2)
    out = {
        "timbre": mean_of(bands, term("spectrum.tilt_db_per_decade", "tilt_db_per_decade"), term("spectrum.centroid_hz.p50", "centroid_hz"), term("spectrum.rolloff85_hz.p50", "rolloff85_hz"), F.when((F.size(mx) > 0) & (F.size(mx) == F.size(my)), mfcc)),
        "dynamics": mean_of(*(term(f"dynamics.{n}", n) for n in ("crest_db", "attack_ms", "decay_db_per_s", "lra_lu")), F.abs(spread(x) - spread(y)) / scales["rms_spread_db"]),
        "ambience": mean_of(rt60, echo, feedback, *am),
        "level": mean_of(term("source.lufs_i", "lufs_i")),
        "harmonic": mean_of(*harmonic),
        "spatial": mean_of(*(F.when(stereo, term(f"spatial.{n}", n)) for n in ("width", "correlation"))),
    }
    if residual_db is not None:
        left = finite(residual_db)
        out["residual"] = F.when(left.isNotNull(), F.greatest(left - scales["residual_floor_db"], F.lit(0.0)) / scales["residual_db"])
    return out


def nearest(targets: DataFrame, entries: DataFrame, group: str, target: str, entry: str, distance: Column, k: int) -> DataFrame:
    """The k nearest entries to each target within its group, by distance, then entry.

    Targets stand for a stated query set. The rank is limited within each task before rows meet.
    """
    both = targets.join(entries, group).withColumn("distance", distance)
    rank = F.row_number().over(W.partitionBy(target).orderBy("distance", entry))
    return both.withColumn("rank", rank).filter(F.col("rank") <= k)


#: Targets and entries of a group that meet in one task, and entries of a matrix product.
TILE, STRETCH, SLICE = 8192, 32768, 256
#: Up to what share of the squares involved a product of matrices may err.
SLACK = 1e-12


def _regular(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The length of each vector (-1 for null), whether all its components are finite, and the vectors."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = np.array(pc.fill_null(pc.list_value_length(lists), -1))
    flat = pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(np.maximum(n, 0)) - np.maximum(n, 0)
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
    whole = (n >= 0) & (bad[starts + np.maximum(n, 0)] == bad[starts])
    return n, whole, np.split(flat, starts[1:]) if len(n) else []


def _least(target: np.ndarray, entry: np.ndarray, distance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k first rows of each target by distance, then entry, and their targets' first places."""
    order = np.lexsort((entry, distance, target))
    target, entry, distance = target[order], entry[order], distance[order]
    first = np.flatnonzero(np.concatenate(([True], target[1:] != target[:-1]))) if len(target) else np.zeros(0, np.int64)
    rank = np.arange(len(target)) - np.repeat(first, np.diff(np.append(first, len(target))))
    keep = rank < k
    return target[keep], entry[keep], distance[keep], rank[keep]


def _shapes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The distances of band_shape between rows."""
    d = a - b
    d -= np.cumsum(d, 1)[:, -1:] / d.shape[1]
    return np.sqrt(np.cumsum(d * d, 1)[:, -1] / d.shape[1])


def _nearest_of(t_ids: np.ndarray, t: np.ndarray, e_ids: np.ndarray, e: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the target, entry, distance): at least the k nearest of the entries to each target; all finite, of one length."""
    # Of equal vectors the least ids will do, k and those of the target's own.
    most = k + np.unique(e_ids, return_counts=True)[1].max()
    order = np.argsort(e_ids, kind="stable")
    e_ids, e = e_ids[order], np.ascontiguousarray(e[order]) + 0.0
    _, same = np.unique(e.view(np.dtype((np.void, e.shape[1] * 8))).ravel(), return_inverse=True)
    by = np.argsort(same, kind="stable")
    begins = np.searchsorted(same[by], np.arange(same.max() + 1))
    keep = np.sort(by[np.arange(len(by)) - begins[same[by]] < most])
    e_ids, e = e_ids[keep], e[keep]
    x, y = t - t.mean(1, keepdims=True), e - e.mean(1, keepdims=True)
    xx, yy = (x * x).sum(1), (y * y).sum(1)
    bound = np.full(len(t), np.inf)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    waiting = 0

    def closed() -> None:
        nonlocal found, waiting
        target, entry, distance, rank = _least(*(np.concatenate(c) for c in zip(*found)), k)
        last = rank == k - 1
        bound[target[last]] = np.minimum(bound[target[last]], distance[last] ** 2 * e.shape[1] * (1 + 1e-9))
        found, waiting = [(target, entry, distance)], 0

    for at in range(0, len(e), SLICE):
        part = slice(at, at + SLICE)
        squares = xx[:, None] + yy[part] - 2 * (x @ y[part].T)
        squares[t_ids[:, None] == e_ids[part]] = np.inf
        slack = SLACK * (xx + yy[part].max())
        if squares.shape[1] > k:
            np.minimum(bound, np.partition(squares, k - 1, 1)[:, k - 1] + slack, out=bound)
        row, col = np.nonzero(squares <= np.minimum(bound + slack, np.finfo(np.float64).max)[:, None])
        for b in range(0, len(row), 1 << 16):
            r, c = row[b : b + (1 << 16)], col[b : b + (1 << 16)] + at
            found.append((r, e_ids[c], _shapes(t[r], e[c])))
            waiting += len(r)
            if waiting > k * len(t) + (1 << 16):
                closed()
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def nearest_shapes(targets: DataFrame, entries: DataFrame, group: str, target: str, entry: str, t: str, e: str, k: int) -> DataFrame:
    """(target, entry, rank, distance): the k nearest other entries to each target within its group by band_shape, then entry.

    Ids are longs, vectors arrays of numbers below 1e150. Distances that can't be told come last: those of components that are missing or not finite as
    NaN, those of null vectors or other lengths as null. Tiles of a group's targets meet stretches of its entries in a task each, which
    finds candidates by products of matrices, works their distances out again and keeps k of them. The work is the product of both numbers
    in a group.
    """
    parts = lambda df, most: df.groupBy(group).agg(F.ceil(F.count("*") / most).cast("int").alias("n")).filter("n > 1")
    tiles, stretches = (F.broadcast(parts(df, most).withColumnRenamed("n", name)) for df, most, name in ((targets, TILE, "_tiles"), (entries, STRETCH, "_stretches")))  # a row per large group

    def dealt(df: DataFrame, key: str, v: str, own: str, other: str) -> DataFrame:
        """Rows by their own part of the group, once for each of the other side's parts."""
        x = df.select(group, F.col(key).cast("long").alias("_id"), F.col(v).cast("array<double>").alias("_v")).join(tiles, group, "left").join(stretches, group, "left")
        mine = F.pmod(F.xxhash64("_id"), F.coalesce(own, F.lit(1))).cast("int")
        return x.select(F.col(group).alias("_group"), mine.alias(f"{own}_at"), F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)).alias(f"{other}_at"), "_id", "_v")

    def met(key, left: pa.Table, right: pa.Table) -> pa.Table:
        t_ids, e_ids = left["_id"].to_numpy(), right["_id"].to_numpy()
        (tn, t_ok, tv), (en, e_ok, ev) = _regular(left["_v"]), _regular(right["_v"])
        out = []
        for n in np.unique(tn):
            here = np.flatnonzero(tn == n)
            like = (en == n) & (n > 0)
            good, fine = here[t_ok[here]], np.flatnonzero(like & e_ok)
            if n > 0 and len(good) and len(fine):
                at, ids, d = _nearest_of(t_ids[good], np.array([tv[j] for j in good]), e_ids[fine], np.array([ev[j] for j in fine]), k)
                out.append((good[at], ids, d, np.zeros(len(at), np.int8)))
            for which, rows, kind in ((good, like & ~e_ok, 1), (here[~t_ok[here]], like, 1), (here, ~like, 2)):
                first = np.sort(e_ids[rows])[: k + np.bincount(np.unique(e_ids[rows], return_inverse=True)[1]).max()] if rows.any() else e_ids[:0]
                a, b = np.repeat(which, len(first)), np.tile(first, len(which))
                other = t_ids[a] != b
                out.append((a[other], b[other], np.full(int(other.sum()), np.nan), np.full(int(other.sum()), kind, np.int8)))
        at, ids, d, kind = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int8))
        shown = pa.array(d, mask=kind == 2)
        return pa.table({"target": pa.array(t_ids[at]), "entry": pa.array(ids), "kind": pa.array(kind.astype(np.int32)), "distance": shown})

    prepare(targets.sparkSession)
    # The groups' own values are keys of both sides; a null group meets nothing.
    left = dealt(targets.filter(F.col(group).isNotNull()), target, t, "_tiles", "_stretches").groupBy("_group", "_tiles_at", "_stretches_at")
    right = dealt(entries.filter(F.col(group).isNotNull()), entry, e, "_stretches", "_tiles").groupBy("_group", "_tiles_at", "_stretches_at")
    found = left.cogroup(right).applyInArrow(met, "target long, entry long, kind int, distance double")
    rank = F.row_number().over(W.partitionBy("target").orderBy("kind", "distance", "entry"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select(F.col("target").alias(target), F.col("entry").alias(entry), "rank", "distance")


def feature_ranges(entries: DataFrame, group: str, features: Sequence[str]) -> DataFrame:
    """(group, feature, low, high) over finite values; features without any are left out."""
    long = entries.select(group, F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), finite(F.col(f).cast("double")).alias("x")) for f in features))).alias("e"))
    return long.filter("e.x is not null").groupBy(group, F.col("e.feature").alias("feature")).agg(F.min("e.x").alias("low"), F.max("e.x").alias("high"))


def outside_ranges(targets: DataFrame, ranges: DataFrame, group: str, target: str, features: Sequence[str]) -> DataFrame:
    """(target, feature, x, low, high) where a target's finite value lies outside its group's range."""
    long = targets.select(group, target, F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), finite(F.col(f).cast("double")).alias("x")) for f in features))).alias("e"))
    long = long.select(group, target, F.col("e.feature").alias("feature"), F.col("e.x").alias("x")).filter("x is not null")
    return long.join(ranges, [group, "feature"]).filter("x < low or x > high")


def front_of_two(rows: DataFrame, group: Sequence[str], first: str, second: str) -> DataFrame:
    """Rows that none of their group dominates in two objectives (smaller is better, ties on both are kept); one sort."""
    usable = rows.filter(F.col(first).isNotNull() & F.col(second).isNotNull())
    usable = usable.withColumn("_rank", F.dense_rank().over(W.partitionBy(*group).orderBy(first)))
    before = W.partitionBy(*group).orderBy("_rank").rangeBetween(W.unboundedPreceding, -1)
    same = W.partitionBy(*group, first)
    low = F.min(second).over(before)
    return usable.withColumns({"_low": low, "_own": F.min(second).over(same)}).filter((F.col(second) == F.col("_own")) & (F.col("_low").isNull() | (F.col(second) < F.col("_low")))).drop("_low", "_own", "_rank")


#: Objectives that lie no farther apart are equal.
TOLERANCE = 1e-9
#: How far apart two candidates of a shortlist have to be in some objective.
DISTINCT = 0.02


def undominated(rows: DataFrame, group: str, key: str, values: Sequence[str], tolerance: float = TOLERANCE) -> DataFrame:
    """Rows that no other of their group dominates over the objectives that both measured: none worse, one better.

    Such dominance isn't transitive, so all rows of a group are compared; groups are the shortlists of one run.
    """
    other = rows.select(group, F.col(key).alias("_key"), *(F.col(v).alias(f"_{v}") for v in values))
    shared = [F.col(v).isNotNull() & F.col(f"_{v}").isNotNull() for v in values]
    worse = [F.coalesce(F.col(f"_{v}") > F.col(v) + tolerance, F.lit(False)) for v in values]
    better = [F.coalesce(F.col(f"_{v}") < F.col(v) - tolerance, F.lit(False)) for v in values]
    any_of = lambda cs: F.array_contains(F.array(*cs), True)
    condition = (rows[group] == other[group]) & (F.col(key) != F.col("_key")) & any_of(shared) & ~any_of(worse) & any_of(better)
    return rows.join(other, condition, "left_anti")


def thinned(front: DataFrame, group: str, key: str, total: str, values: Sequence[str], limit: int = 5, distinct: float = DISTINCT) -> DataFrame:
    """(group, key, place) of each group's front by total, then key, less those too near to one kept before; at most limit.

    Two candidates are as far apart as in the objective where they differ most, of those that both have. Whether one is kept
    depends on all kept before it, so a group is folded in order; the fold holds at most limit candidates.
    """
    row = F.struct(F.col(total).alias("t"), F.col(key).alias("k"), F.array(*(F.col(v).cast("double") for v in values)).alias("v"))
    ordered = front.filter(F.col(total).isNotNull()).groupBy(group).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    gap = lambda a, b: F.coalesce(F.array_max(F.array_compact(F.zip_with(a, b, lambda x, y: F.abs(x - y)))), F.lit(0.0))
    far = lambda kept, r: F.forall(kept, lambda k: gap(k["v"], r["v"]) >= distinct)
    kept = F.aggregate("rows", F.slice("rows", 1, 0), lambda acc, r: F.when((F.size(acc) < limit) & far(acc, r), F.array_append(acc, r)).otherwise(acc))
    return ordered.select(group, F.posexplode(kept).alias("place", "r")).select(group, F.col("r.k").alias(key), (F.col("place") + 1).alias("place"))


def by_worst_level(levels: DataFrame, group: str, candidate: str, score: str) -> DataFrame:
    """(group, candidate, worst, place): a shortlist by each candidate's worst score over the levels; those without one last."""
    worst = levels.groupBy(group, candidate).agg(F.max(score).alias("worst"))
    return worst.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy(F.asc_nulls_last("worst"), candidate)))


def level_share(weight: float, level_before: Column, level_after: Column, total_before: Column, total_after: Column) -> Column:
    """The share of a score's change that its level term explains; null where the level is unknown or the score stood still."""
    change = F.abs(total_after - total_before)
    return F.when(change >= TOLERANCE, F.least(F.lit(1.0), weight * F.abs(level_after - level_before) / change)) if weight else F.lit(None).cast("double")


def resolved(difference: Column, noise_db: Column) -> Column:
    """Whether a band's difference is more than the noise between equal renders."""
    return F.abs(difference) > noise_db


#: Seconds and band levels that a reference needs to be measurable.
LEAST_SECONDS, SILENT_DB = 1.0, -120.0


def unmeasurable(seconds: Column, band_db: Column, lufs: Column) -> Column:
    """Why a reference can't be matched, by the first rule that applies; null for one that can."""
    return F.when(F.coalesce(seconds, F.lit(0.0)) < LEAST_SECONDS, "too short").when(F.array_max(band_db) < SILENT_DB, "silent").when(lufs.isNull(), "no loudness")


def band_at(centres: Column, levels: Column, hz: Column) -> Column:
    """The level of the band whose centre lies within half a hertz, else null."""
    near = F.filter(F.zip_with(centres, levels, lambda c, v: F.struct(c.alias("c"), v.alias("v"))), lambda e: F.abs(e["c"] - hz) < 0.51)
    return F.get(near, 0)["v"]
