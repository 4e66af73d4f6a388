"""A linear warm start: settings predicted from measurements by a ridge fit, clipped, gated and blended with a neighbour's."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from .statistics import gram, ridge_of

#: The share of the model's features that a target has to bring.
OVERLAP = 0.5


@dataclass(frozen=True)
class Control:
    """A predicted control, its range and its step (None: as it is)."""

    name: str
    low: float
    high: float
    step: float | None = None


@dataclass(frozen=True)
class WarmStart:
    """A fitted model; its size is that of the features times the controls."""

    features: tuple[str, ...]
    controls: tuple[Control, ...]
    mean: dict[str, float]
    low: dict[str, float]
    high: dict[str, float]
    weights: np.ndarray
    intercepts: np.ndarray


def fit(entries: DataFrame, features: Sequence[str], controls: Sequence[Control], alpha: float = 0.01) -> WarmStart:
    """The model of entries whose features and controls are columns, from one pass of sums.

    Features that don't vary drop out. Raises ValueError for a control of no width, an alpha that isn't positive, fewer than
    two entries, or no feature left.
    """
    if flat := [c.name for c in controls if c.high <= c.low]:
        raise ValueError(f"controls of no width: {', '.join(flat)}")
    if not (np.isfinite(alpha) and alpha > 0):
        raise ValueError("alpha has to be positive and finite")
    unit = entries.select(*features, *((F.col(c.name) - c.low) / (c.high - c.low) for c in controls)).toDF(*features, *(c.name for c in controls))
    g = gram(unit, features, [c.name for c in controls])
    ends = unit.agg(*(f(x).alias(f"{n}_{x}") for x in features for n, f in (("low", F.min), ("high", F.max)))).first()
    sums = g.first()
    if sums["n"] < 2:
        raise ValueError("a warm start needs two entries")
    n = sums["n"]
    spread = {x: max(0.0, sums[f"x_{x}_{x}"] / n - (sums[f"s_{x}"] / n) ** 2) ** 0.5 for x in features}
    kept = [x for x in features if spread[x] > 1e-9]
    if not kept:
        raise ValueError("no feature varies")
    fits = [ridge_of(sums, kept, c.name, alpha) for c in controls]
    return WarmStart(
        tuple(kept), tuple(controls), {x: sums[f"s_{x}"] / n for x in kept}, {x: ends[f"low_{x}"] for x in kept}, {x: ends[f"high_{x}"] for x in kept},
        np.array([w for w, _ in fits]), np.array([b for _, b in fits]),
    )


def predicted(model: WarmStart) -> dict[str, Column]:
    """Columns by name: feature_overlap, clipped_fraction and each control's value from the features' columns.

    A feature that is null counts as the entries' mean; others are clipped to the entries' range. Values are null where the
    target brings too few features.
    """
    raw = {x: F.col(x).cast("double") for x in model.features}
    has = sum((c.isNotNull().cast("int") for c in raw.values()), F.lit(0))
    overlap = has / float(len(raw))
    outside = sum((F.coalesce(((c < model.low[x]) | (c > model.high[x])).cast("int"), F.lit(0)) for x, c in raw.items()), F.lit(0))
    held = {x: F.greatest(F.least(F.coalesce(c, F.lit(model.mean[x])), F.lit(model.high[x])), F.lit(model.low[x])) for x, c in raw.items()}
    out = {"feature_overlap": overlap, "clipped_fraction": F.when(has > 0, outside / has).otherwise(0.0)}
    for k, c in enumerate(model.controls):
        u = sum((held[x] * float(model.weights[k, j]) for j, x in enumerate(model.features)), F.lit(float(model.intercepts[k])))
        x = c.low + F.greatest(F.least(u, F.lit(1.0)), F.lit(0.0)) * (c.high - c.low)
        out[c.name] = F.when(overlap >= OVERLAP, V.quantised(x, F.lit(c.step).cast("double"), F.lit(c.low), F.lit(c.high)))
    return out


def blended(control: Control, nearest: Column, fitted: Column, blend: float, movable: bool = True) -> Column:
    """A control between the nearest entry's value and the fitted one; a control that may not move keeps the nearest's."""
    if not 0 <= blend <= 1:
        raise ValueError("blend lies between 0 and 1")
    x = nearest + blend * (fitted - nearest) if movable else nearest
    return V.quantised(x, F.lit(control.step).cast("double"), F.lit(control.low), F.lit(control.high))
