"""From a measured difference to control settings: filter corners, band gains, and rules for time effects."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.levels import bell, butterworth_db
from ..session import prepare

#: Rows for which a task is enough.
ROWS = 500_000


def best_corners(bands: DataFrame, group: str, hz: str, delta: str, highpass: Sequence[float], lowpass: Sequence[float]) -> DataFrame:
    """(group, hpf, lpf, rms): the pair of filter corners whose response is nearest to a curve, up to its level.

    The grid is a short list of corners; a curve's sums for each pair are aggregated, so that no pair of rows is kept.
    """
    grid = F.explode(F.array(*(F.struct(F.lit(float(h)).alias("hpf"), F.lit(float(l)).alias("lpf")) for h in highpass for l in lowpass)))  # noqa: E741
    each = bands.select(group, F.col(hz).alias("hz"), F.col(delta).alias("delta"), grid.alias("c"))
    d = F.col("delta") - butterworth_db(F.col("hz"), F.col("c.hpf"), True) - butterworth_db(F.col("hz"), F.col("c.lpf"), False)
    fit = each.withColumn("d", d).groupBy(group, "c.hpf", "c.lpf").agg(F.sqrt(F.greatest(F.avg(F.col("d") * F.col("d")) - F.avg("d") * F.avg("d"), F.lit(0.0))).alias("rms"))
    best = F.min(F.struct(F.round("rms", 9).alias("rms"), "hpf", "lpf"))
    return fit.groupBy(group).agg(best.alias("b")).select(group, "b.hpf", "b.lpf", "b.rms")


def bounded_least_squares(a: np.ndarray, b: np.ndarray, low: float, high: float, steps: int = 500) -> np.ndarray:
    """The x in [low, high] that minimises |a x - b|, by coordinate descent; a has a column for each band control."""
    x, g, c = np.zeros(a.shape[1]), a.T @ a, a.T @ b
    for _ in range(steps):
        last = x.copy()
        for j in np.flatnonzero(np.diag(g) > 1e-12):
            x[j] = np.clip(x[j] + (c[j] - g[j] @ x) / g[j, j], low, high)
        if np.abs(x - last).max(initial=0) < 1e-12:
            break
    return x


def fit_bands(curves: DataFrame, basis: np.ndarray, low: float, high: float) -> DataFrame:
    """Adds gains to curves (curve array, one number for each analysis band): the bounded gains of the controls whose summed responses come nearest.

    basis has a row for each analysis band. A null curve, or one of another length, has null gains.
    """
    prepare(curves.sparkSession)

    def fit(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([bounded_least_squares(basis, np.asarray(c, float), low, high).tolist() if c is not None and len(c) == len(basis) else None for c in s], dtype=object)

    return curves.withColumn("gains", F.pandas_udf(fit, "array<double>")("curve"))


#: The range of full weight, and the weight outside it.
FULL_HZ, OUTSIDE = (50.0, 16_000.0), 0.15


def bounded_fits(basis: np.ndarray, targets: np.ndarray, weights: np.ndarray, low: float, high: float, rounds: int = 2000) -> np.ndarray:
    """For each row of targets the x within [low, high] that minimises |weights * (basis x - target)|.

    Sweeps over the controls bring all rows near their minima at once; then, for the rows that share the same controls at the
    ends of the range, the free ones are solved for, until no free control leaves the range and none at an end is pulled inwards.
    """
    a = basis * weights[:, None]
    g, c = a.T @ a, (targets * weights) @ a
    moves = np.flatnonzero(np.diag(g) > 1e-12)
    x = np.zeros_like(c)
    for _ in range(rounds):
        last = x.copy()
        for j in moves:
            x[:, j] = np.clip(x[:, j] + (c[:, j] - x @ g[:, j]) / g[j, j], low, high)
        if np.abs(x - last).max(initial=0) < 1e-10:
            break
    at = np.where(x <= low + 1e-7, -1, np.where(x >= high - 1e-7, 1, 0))
    at[:, np.setdiff1d(np.arange(len(g)), moves)] = 2  # controls without an effect stay at zero
    for held in np.unique(at, axis=0):
        rows, free = np.flatnonzero((at == held).all(1)), np.flatnonzero(held == 0)
        fixed = np.select([held == -1, held == 1], [low, high], 0.0)
        if len(free):
            solved = np.linalg.lstsq(g[np.ix_(free, free)], (c[rows][:, free] - fixed @ g[:, free]).T, rcond=None)[0].T
            y = np.tile(fixed, (len(rows), 1))
            y[:, free] = solved
            pull = c[rows] - y @ g
            good = ((solved >= low) & (solved <= high)).all(1) & ((pull <= 1e-7) | (held != -1)).all(1) & ((pull >= -1e-7) | (held != 1)).all(1)
            x[rows[good]] = y[good]
    return x


def optimality(basis: np.ndarray, targets: np.ndarray, weights: np.ndarray, x: np.ndarray, low: float, high: float) -> np.ndarray:
    """How far each row of x is from the conditions of a bounded minimum: 0 at one."""
    a = basis * weights[:, None]
    pull = (targets * weights) @ a - x @ (a.T @ a)
    wrong = np.where(x <= low, np.maximum(pull, 0), np.where(x >= high, np.maximum(-pull, 0), np.abs(pull)))
    return np.maximum(wrong.max(1, initial=0), np.maximum(low - x, x - high).max(1, initial=0))


def weighted_fits(curves: DataFrame, key: str, basis: np.ndarray, hz: Sequence[float], low: float, high: float, noise: str) -> DataFrame:
    """(key, gains, residual, effect, noise_max, margin, gap, note) for curves (key, curve array, noise array or null, handled array or null).

    Bands within FULL_HZ have full weight, others OUTSIDE. What something else in the chain handles is taken off first, but for
    its mean. Gains are rounded to two places; they stand only if the change that they make together exceeds the noise in any band of
    full weight, else they are zero with a note. margin is the largest excess, gap how far the fit is from a minimum's conditions. A
    null curve, one of another length or with null or non-finite numbers has null gains; null noise is none.
    """
    prepare(curves.sparkSession)
    f = np.asarray(hz, float)
    full = (f >= FULL_HZ[0]) & (f <= FULL_HZ[1])
    weights, compared = np.where(full, 1.0, OUTSIDE), full if full.any() else np.ones(len(f), bool)
    schema = "gains array<double>, residual double, effect double, noise_max double, margin double, gap double, note string"

    def fit(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for curve, floor, handled in batches:
            out = pd.DataFrame({c: pd.Series([None] * len(curve), dtype=object) for c in ("gains", "residual", "effect", "noise_max", "margin", "gap", "note")})
            sound = lambda v: v is not None and len(v) == len(f) and all(x is not None for x in v) and bool(np.isfinite(np.asarray(v, float)).all())
            good = [k for k, v in enumerate(curve) if sound(v)]
            if good:
                array = lambda s: np.array([np.asarray(s.iloc[k], float) if sound(s.iloc[k]) else np.zeros(len(f)) for k in good])
                other = array(handled)
                target, floors = array(curve) - (other - other.mean(1, keepdims=True)), np.maximum(array(floor), 0)
                x = bounded_fits(basis, target, weights, low, high)
                gains = np.round(x, 2)
                effect = np.abs(gains @ basis.T)[:, compared]
                margin = (effect - floors[:, compared]).max(1)
                emitted = np.where(margin[:, None] > 0, gains, 0.0)
                residual = np.sqrt(((emitted @ basis.T - target) ** 2).mean(1))
                gap = optimality(basis, target, weights, x, low, high)
                for n, k in enumerate(good):
                    none = not emitted[n].any() and bool(target[n].any())
                    out.iloc[k] = pd.Series([emitted[n].tolist(), round(residual[n], 3), round(effect[n].max(), 6), round(floors[n][compared].max(), 6), round(margin[n], 6), gap[n], "within the noise" if none else None], index=out.columns)
            yield out

    floor = F.col(noise) if noise else F.lit(None).cast("array<double>")
    handled = F.col("handled") if "handled" in curves.columns else F.lit(None).cast("array<double>")
    return curves.select(key, F.pandas_udf(fit, schema)("curve", floor, handled).alias("f")).select(key, "f.*")


def bell_basis(analysis_hz: Sequence[float], centres: Sequence[float], q: float = 1.4) -> np.ndarray:
    """The responses of bell controls at the analysis bands, where no basis was measured."""
    f, c = np.array(analysis_hz)[:, None], np.array(centres)[None, :]
    return 1 / (1 + (2 * q * np.log2(f / c)) ** 2)


def predicted_bands(gains: DataFrame, group: str, centre: str, gain: str, analysis_hz: Sequence[float]) -> DataFrame:
    """(group, hz, db): what band gains add up to at the analysis bands."""
    at = gains.select(group, F.col(centre).alias("centre"), F.col(gain).alias("gain"), F.explode(F.array(*map(F.lit, analysis_hz))).alias("hz"))
    return at.groupBy(group, "hz").agg(F.sum(F.col("gain") * bell(F.col("hz"), F.col("centre"))).alias("db"))


def time_settings(delay_ms: Column, delay_confidence: Column, feedback: Column, rt60_s: Column, rt60_confidence: Column, am_rate_hz: Column, am_depth: Column, am_confidence: Column) -> Mapping[str, Column]:
    """Settings of delay, reverb and tremolo, null where the measurement isn't sure, and why."""
    echo, room, wobble = delay_confidence >= 0.15, rt60_confidence >= 0.3, am_confidence > 0
    return {
        "delay_active": F.coalesce(echo, F.lit(False)),
        "delay_ms": F.when(echo, F.least(F.greatest(delay_ms, F.lit(1.0)), F.lit(2000.0))),
        "delay_feedback": F.when(echo, F.least(F.greatest(feedback, F.lit(0.0)), F.lit(0.95))),
        "reverb_active": F.coalesce(room & (rt60_s > 0.1), F.lit(False)),
        "reverb_s": F.when(room & (rt60_s > 0.1), F.least(rt60_s, F.lit(10.0))),
        "tremolo_active": F.coalesce(wobble & (am_depth > 0.05), F.lit(False)),
        "tremolo_hz": F.when(wobble & (am_depth > 0.05), am_rate_hz),
        "caveats": F.array_compact(F.array(F.when(~F.coalesce(echo, F.lit(False)), "no echo measured"), F.when(~F.coalesce(room, F.lit(False)), "no reverberation measured"), F.when(~F.coalesce(wobble, F.lit(False)), "no tremolo measured"))),
    }


def corrected(baseline: Column, correction: Column, low: Column, high: Column) -> Column:
    """An absolute control from a baseline and a correction, within the control's range; null without a baseline."""
    wanted = baseline + correction
    return F.when(wanted.isNotNull(), F.least(F.greatest(wanted, low), high))


def absolute_bands(corrections: DataFrame, settings: DataFrame, run: str, control: str, parts: int | None = None) -> DataFrame:
    """(run, control, value, note) of the fitted bands' absolute settings; notes stand for what couldn't be done.

    corrections: (run, control, change, low, high); settings: (run, control, current, eq_on). A band that isn't moved is left
    out where the equaliser is on already; where the corrections turn it on, all bands are written from neutral, so that stored
    values of a bypassed equaliser don't sound. A band without a stored value is left for the search. parts: how many tasks
    the runs are dealt to (one for ROWS rows, where Spark's own choice makes few large ones); tables dealt by run and control are joined so.
    """
    both = corrections.join(settings, [run, control], "left")
    both = both.repartition(parts, run) if parts else both
    on = F.coalesce(F.bool_and("eq_on").over(W.partitionBy(run)), F.lit(False))
    moves = F.coalesce(F.max((F.col("change") != 0).cast("int")).over(W.partitionBy(run)) == 1, F.lit(False))
    x = both.withColumns({"_on": on, "_moves": moves}).filter("_moves and not (coalesce(change, 0) = 0 and _on)")
    wanted = F.coalesce("change", F.lit(0.0)) + F.when(F.col("_on"), F.col("current")).when(F.col("current").isNotNull(), 0.0)
    held = F.least(F.greatest(wanted, "low"), F.col("high"))
    note = F.when(wanted.isNull(), "no stored value").when(F.abs(held - wanted) > 0.005, "held at the range's end")
    return x.select(run, control, F.when(wanted.isNotNull(), F.round(held, 2)).alias("value"), note.alias("note"))


def linear_slope(rows: DataFrame, group: Sequence[str], gain: str, level: str) -> DataFrame:
    """Central difference of a response about a flat setting, and how far its two halves differ: rows at -g, 0 and +g."""
    at = lambda s: F.max(F.when(F.signum(gain) == s, F.col(level)))
    a = rows.groupBy(*group).agg(at(1).alias("up"), at(0).alias("flat"), at(-1).alias("down"), F.max(F.abs(gain)).alias("g"))
    return a.select(*group, ((F.col("up") - F.col("down")) / (2 * F.col("g"))).alias("db_per_db"), F.abs(F.col("up") + F.col("down") - 2 * F.col("flat")).alias("nonlinear_db"))
