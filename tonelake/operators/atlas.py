"""Sampled response atlases: held-out scores, comparisons of scale, blends with a regression and robustness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import values as V


def held_out(scores: DataFrame, group: str, neutral: str, atlas: str) -> DataFrame:
    """How an atlas's nearest entry does against neutral settings on targets it didn't see."""
    return scores.groupBy(group).agg(
        F.count("*").alias("samples"),
        F.avg(neutral).alias("neutral_mean"),
        F.avg(atlas).alias("atlas_mean"),
        F.median(neutral).alias("neutral_median"),
        F.median(atlas).alias("atlas_median"),
        F.avg((F.col(atlas) < F.col(neutral)).cast("double")).alias("win_rate"),
    )


def held_out_faults(stored: DataFrame, scores: DataFrame, group: str, neutral: str, atlas: str, tolerance: float = 1e-12) -> DataFrame:
    """Stored statistics that the outcomes they were made from don't bear out; none in a sound atlas."""
    again = held_out(scores, group, neutral, atlas)
    names = ("neutral_mean", "atlas_mean", "neutral_median", "atlas_median", "win_rate")
    both = stored.select(group, *(F.col(c).alias(f"_{c}") for c in names)).join(again, group, "full_outer")
    ok = [F.coalesce(F.abs(F.col(c) - F.col(f"_{c}")) <= tolerance, F.lit(False)) for c in names]
    return both.filter(F.array_contains(F.array(*ok), False)).select(group)


def scale_comparison(a: DataFrame, b: DataFrame, group: str, index: str, score: str) -> DataFrame:
    """What a denser atlas gains on the same targets: null where the two don't hold the same ones."""
    x, y = a.select(group, index, F.col(score).alias("before")), b.select(group, index, F.col(score).alias("after"))
    both = x.join(y, [group, index], "full_outer")
    drop = F.when(F.col("before") != 0, (F.col("before") - F.col("after")) / F.col("before"))
    out = both.groupBy(group).agg(
        F.bool_and(F.col("before").isNotNull() & F.col("after").isNotNull()).alias("aligned"),
        ((F.avg("before") - F.avg("after")) / F.nullif(F.avg("before"), F.lit(0.0))).alias("mean_reduction"),
        F.count_if(F.col("after") < F.col("before")).alias("better"),
        F.median(drop).alias("median_reduction"),
        F.min(drop).alias("worst_reduction"),
    )
    return out.select(group, "aligned", *(F.when(F.col("aligned"), F.col(c)).alias(c) for c in ("mean_reduction", "better", "median_reduction", "worst_reduction")))


def blended(nearest: Column, predicted: Column, share: Column, movable: Column, step: Column, low: Column, high: Column) -> Column:
    """A setting between the nearest entry's and a regression's, at the control's step; the nearest's where it mustn't move."""
    return V.quantised(nearest + F.when(movable, share * (predicted - nearest)).otherwise(0.0), step, low, high)


def best_blend(scores: DataFrame, target: str, blend: str, score: str) -> DataFrame:
    """Per blend its mean, median and how often it beats blend 0, with the chosen one: the least mean, then the least blend.

    A target has one score for each blend; targets without one for blend 0 are left out.
    """
    neutral, own = F.col(blend) == 0, W.partitionBy(target)
    # A target's scores are held against one that was worked out with them: made again, it could differ in its last digits.
    s = scores.filter(F.col(target).isNotNull()).withColumns({"_has": F.count_if(neutral).over(own), "_base": F.max(F.when(neutral, F.col(score))).over(own)}).filter("_has > 0")
    s = s.groupBy(blend).agg(F.avg(score).alias("mean"), F.median(score).alias("median"), F.count_if(F.col(score) < F.col("_base")).alias("wins"))
    first = F.row_number().over(W.orderBy(F.round("mean", 12), blend))  # a row for each blend
    return s.withColumn("chosen", first == 1)


def level_share(total_before: Column, total_after: Column, level_before: Column, level_after: Column, weight: float) -> Column:
    """The share of a score's change that is its level term; null where nothing moved or a level wasn't measured."""
    moved = F.abs(total_after - total_before)
    return F.when(moved >= 1e-9, F.least(F.lit(1.0), weight * F.abs(level_after - level_before) / moved))


def robustness_grid(candidates: DataFrame, levels: list[float], replicates: int) -> DataFrame:
    """Each candidate at every level and replicate, by exploding two short lists."""
    return candidates.withColumn("level", F.explode(F.array(*map(F.lit, levels)))).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))


def backend_floor(repeats: DataFrame, group: str, score: str, stated: Column) -> DataFrame:
    """How far equal renders differ: the range of repeated scores, else what the backend states."""
    return repeats.groupBy(group).agg(F.coalesce(F.when(F.count(score) >= 2, F.max(score) - F.min(score)), F.max(stated)).alias("floor"))


def basis_for(basis: DataFrame, centres: list[float], path: str, hz: str) -> DataFrame:
    """(path, missing): how many of the asked centres a measured basis lacks; zero means that it may be used."""
    asked = F.array(*(F.lit(float(c)) for c in centres))
    return basis.groupBy(path).agg(F.collect_set(F.when(F.array_contains(asked, F.col(hz)), F.col(hz))).alias("have")).select(path, (F.lit(len(set(centres))) - F.size("have")).alias("missing"))
