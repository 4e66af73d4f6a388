"""Benchmark, replicate, screening and regression statistics."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Parts of a range of movements in which ranks are counted apart.
PARTS = 1024
# The mean range of n normal observations in standard deviations.
RANGE_TO_SIGMA = {2: 1.128, 3: 1.693, 4: 2.059, 5: 2.326, 6: 2.534, 7: 2.704, 8: 2.847, 9: 2.970, 10: 3.078}
#: Standard errors by which two candidates have to differ; shares of targets and failures that a shipped arm needs.
ERRORS, SHARED, FAILURES = 2.0, 0.7, 0.1


def arm_summary(outcomes: DataFrame, arm: str, failed: Column, objective: Column, mae: Column, wall_ms: Column) -> DataFrame:
    """Per arm: targets, failures and their rate, and means and median over the successes."""
    ok = lambda c: F.when(~failed, c)
    out = outcomes.groupBy(arm).agg(
        F.count("*").alias("targets"),
        F.count_if(failed).alias("failures"),
        F.round(F.avg(ok(objective)), 6).alias("mean_objective"),
        F.round(F.median(ok(objective)), 6).alias("median_objective"),
        F.round(F.avg(ok(mae)), 6).alias("mean_mae"),
        F.round(F.sum(wall_ms), 2).alias("wall_ms"),
    )
    return out.withColumn("failure_rate", F.round(F.col("failures") / F.col("targets"), 6))


def paired(outcomes: DataFrame, arm: str, target: str, objective: str, failed: Column) -> DataFrame:
    """(target, arm, other, a, b) for each two arms that both succeeded on a target."""
    ok = outcomes.filter(~failed)
    a = ok.select(target, arm, F.col(objective).alias("a"))
    b = ok.select(target, F.col(arm).alias("other"), F.col(objective).alias("b"))
    return a.join(b, target).filter(F.col(arm) < F.col("other"))


def ship_gate(pairs: DataFrame, summary: DataFrame, arm: str) -> DataFrame:
    """Whether an arm beats every other on their shared targets, with enough of them and few enough failures."""
    both = pairs.unionByName(pairs.selectExpr(f"other as {arm}", f"{arm} as other", "b as a", "a as b", *(c for c in pairs.columns if c not in (arm, "other", "a", "b"))))
    duel = both.groupBy(arm, "other").agg(F.avg("a").alias("mine"), F.avg("b").alias("theirs"), F.count("*").alias("shared"))
    duel = duel.join(summary.select(arm, "targets", "failure_rate"), arm)
    return duel.groupBy(arm).agg(F.every((F.col("mine") < F.col("theirs")) & (F.col("shared") >= SHARED * F.col("targets")) & (F.col("failure_rate") <= FAILURES)).alias("ships"))


def parameter_error(rows: DataFrame, group: str, continuous: Column, truth: Column, guess: Column, low: Column, high: Column) -> DataFrame:
    """Mean absolute error of continuous controls over their range, and the share of selectors that agree."""
    width = high - low
    err = F.when(continuous & (width > 0), F.abs(truth - guess) / width)
    return rows.groupBy(group).agg(F.avg(err).alias("mae"), F.avg(F.when(~continuous, (truth == guess).cast("double"))).alias("selector_accuracy"))


def prior_deviation(rows: DataFrame, group: str, seed: Column, value: Column, moved: float = 1e-9) -> DataFrame:
    """Root mean square distance of unit values from a seed's, and the share of controls that moved."""
    d = value - seed
    return rows.groupBy(group).agg(F.sqrt(F.avg(d * d)).alias("prior_deviation"), F.avg((F.abs(d) > moved).cast("double")).alias("complexity"))


def movement(scores: DataFrame, path: str, score: str, baseline: Column) -> DataFrame:
    """How far a control moves the score: the range of its two ends, or one end's distance from the baseline if the other failed."""
    ok = F.count(score)
    return scores.groupBy(path).agg(F.when(ok >= 2, F.max(score) - F.min(score)).when(ok == 1, F.abs(F.max(score) - F.max(baseline))).alias("movement"))


def screened(moves: DataFrame, floor: float, drop: float = 0.25) -> DataFrame:
    """Controls above the backend's floor, less the weakest share of them, with their rank by movement, then path.

    Ranks are counted within parts of the range of movements, of which only the numbers meet.
    """
    kept = moves.filter(F.col("movement") > floor)
    ends = kept.agg(F.min("movement").alias("_low"), F.max("movement").alias("_high"), F.count("*").alias("_n"))
    part = F.expr(f"if(_high > _low, int(least({PARTS - 1}, floor((movement - _low) / (_high - _low) * {PARTS}))), 0)")
    placed = kept.join(F.broadcast(ends), F.lit(True)).withColumn("_part", part)  # one row
    counts = placed.groupBy("_part").agg(F.count("*").alias("_c"))
    before = counts.select("_part", (F.sum("_c").over(W.orderBy("_part")) - F.col("_c")).alias("_before"))  # at most PARTS rows
    rank = (F.col("_before") + F.row_number().over(W.partitionBy("_part").orderBy("movement", "path"))).cast("int")
    return placed.join(F.broadcast(before), "_part").withColumn("rank", rank).filter(F.col("rank") > F.floor(F.col("_n") * drop)).select("path", "movement", "rank")


def replicates(scores: DataFrame, candidate: str, level: str, score: str) -> DataFrame:
    return scores.groupBy(candidate, level).agg(F.avg(score).alias("mean"), (F.max(score) - F.min(score)).alias("spread"), F.count(score).alias("n"))


def worst_level(levels: DataFrame, candidate: str, level: str) -> DataFrame:
    """Each candidate's highest mean score, its level and the standard error there; null where the replicates tell none."""
    sigma = F.create_map(*(F.lit(x) for kv in RANGE_TO_SIGMA.items() for x in kv))
    worst = levels.groupBy(candidate).agg(F.max(F.struct("mean", F.col(level).alias("level"), "spread", "n")).alias("w"))
    error = F.col("w.spread") / sigma[F.col("w.n").cast("int")] / F.sqrt("w.n")
    return worst.select(candidate, F.col("w.mean").alias("worst"), F.col("w.level").alias("level"), error.alias("error"))


def indistinguishable(worst: DataFrame, group: str, candidate: str) -> DataFrame:
    """For each group's two best candidates: their gap, what their scores can resolve, and whether the gap is within it or unknown."""
    w = W.partitionBy(group).orderBy("worst", candidate)
    top = worst.withColumns({"_r": F.row_number().over(w), "next": F.lead("worst").over(w), "next_error": F.lead("error").over(w)}).filter("_r = 1 and next is not null")
    limit = ERRORS * F.sqrt(F.col("error") * F.col("error") + F.col("next_error") * F.col("next_error"))
    gap = F.col("next") - F.col("worst")
    return top.select(group, candidate, gap.alias("gap"), limit.alias("resolution"), F.coalesce(gap <= limit, F.lit(True)).alias("tied"))


def gram(rows: DataFrame, features: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """One row of sums, products of features and of features with targets, which a ridge fit needs; one partial aggregation."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i:]]
    return rows.agg(
        F.count("*").alias("n"),
        *(F.sum(a).alias(f"s_{a}") for a in [*features, *targets]),
        *(F.sum(F.col(a) * F.col(b)).alias(f"x_{a}_{b}") for a, b in pairs),
        *(F.sum(F.col(a) * F.col(t)).alias(f"y_{a}_{t}") for a in features for t in targets),
    )


def ridge(rows: DataFrame, features: Sequence[str], target: str, alpha: float) -> tuple[np.ndarray, float]:
    """Weights and intercept of a ridge fit on features of mean 0 and deviation 1, in the features' own units, from one pass of sums.

    alpha penalises the squared weights of the standardised features, so that units don't matter. A feature that doesn't vary
    gets no weight.
    """
    return ridge_of(gram(rows, features, [target]).first(), features, target, alpha)


def ridge_of(g: Row, features: Sequence[str], target: str, alpha: float) -> tuple[np.ndarray, float]:
    """ridge() from a row of gram()."""
    k, n = len(features), g["n"]
    if not n:
        return np.zeros(k), 0.0
    mean = np.array([g[f"s_{a}"] for a in features], float) / n
    known = g.asDict()
    product = lambda a, b: known[f"x_{a}_{b}"] if f"x_{a}_{b}" in known else known[f"x_{b}_{a}"]
    xx = np.array([[product(a, b) for b in features] for a in features], float) - n * np.outer(mean, mean)
    xy = np.array([g[f"y_{a}_{target}"] for a in features], float) - mean * g[f"s_{target}"]
    w = _ridge_weights(xx, xy, n, alpha)
    return w, float(g[f"s_{target}"] / n - mean @ w)


def _ridge_weights(xx: np.ndarray, xy: np.ndarray, n: float, alpha: float) -> np.ndarray:
    """Weights from central sums of products: penalising standardised weights is penalising each by its feature's variance."""
    variance = np.diag(xx) / n
    varies = np.sqrt(np.maximum(variance, 0)) > 1e-9
    w = np.zeros(len(xy))
    at = np.ix_(varies, varies)
    w[varies] = np.linalg.solve(xx[at] + alpha * np.diag(variance[varies]), xy[varies])
    return w


def fold_r2(rows: DataFrame, group: str, fold: Column, features: Sequence[str], target: str, folds: int, alpha: float = 0.01) -> DataFrame:
    """(group, r2): cross-validated share of variance that a ridge fit explains, from sums per group and fold.

    Sums over all folds less a fold's own give that fold's training sums, so that one aggregation serves all folds; only the
    small systems are solved in Python, one row of sums at a time.
    """
    k, cols = len(features), [*features, target]
    x = F.array(F.lit(1.0), *(F.col(c).cast("double") for c in cols))
    outer = F.flatten(F.transform(x, lambda a: F.transform(x, lambda b: a * b)))
    sums = rows.select(group, F.pmod(fold, F.lit(folds)).alias("fold"), F.posexplode(outer).alias("at", "v")).groupBy(group, "fold", "at").agg(F.sum("v").alias("v"))
    packed = sums.groupBy(group, "fold").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda s: s["v"]).alias("m"))
    gathered = packed.groupBy(group).agg(F.collect_list("m").alias("m"))  # one matrix for each fold

    def solve(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([r2(np.array([np.array(m) for m in ms]).reshape(-1, k + 2, k + 2)) for ms in b])

    def r2(m: np.ndarray) -> float | None:
        total, res = m.sum(0), 0.0
        for own in m:
            t = total - own
            if t[0, 0] <= 0:
                return None
            mean = t[0, 1:] / t[0, 0]
            c = t[1:, 1:] - t[0, 0] * np.outer(mean, mean)
            w = _ridge_weights(c[:k, :k], c[:k, k], t[0, 0], alpha)
            v = np.concatenate(([-(mean[k] - mean[:k] @ w)], -w, [1.0]))
            res += v @ own @ v
        tss = total[-1, -1] - total[0, -1] ** 2 / total[0, 0]
        return float(1 - res / tss) if tss > 0 else None

    udf = F.pandas_udf(solve, "double")
    return gathered.select(group, udf("m").alias("r2"))


def median_deviation(rows: DataFrame, group: str, x: str) -> DataFrame:
    """Median, and median distance from it."""
    med = rows.groupBy(group).agg(F.median(x).alias("median"))
    return rows.join(med, group).groupBy(group, "median").agg(F.median(F.abs(F.col(x) - F.col("median"))).alias("mad"))
