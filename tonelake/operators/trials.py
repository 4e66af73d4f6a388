"""The log of runs, trials and verdicts: summaries, cache lookups, bests, and appends that keep its keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

RUNS = "run_id string, created_at double, pack string, template string, reference_sha string, regime string, loss_profile string, budget long, renderer_id string, plugin_version string, notes string"
TRIALS = "trial_id long, run_id string, params map<string,string>, cache_key string, objective_key string, di_sha string, di_offset_db double, render_sha string, peak double, silent boolean, wall_ms double, objectives map<string,double>, error string"
VERDICTS = "trial_id long, listener string, choice string, comment string, created_at double"


def failed(error: Column, score: Column, silent: Column) -> Column:
    """Whether a trial counts as failed: an error, no score, or silence even with a score."""
    return error.isNotNull() | score.isNull() | F.coalesce(silent, F.lit(False))


def run_summary(trials: DataFrame, run: str, failed: Column, error: Column, silent: Column, wall_ms: str) -> DataFrame:
    t = trials.groupBy(run).agg(
        F.count("*").alias("trials"),
        F.count_if(failed).alias("failures"),
        F.count_if(error).alias("errors"),
        F.count_if(silent).alias("silent"),
        F.round(F.sum(wall_ms), 1).alias("wall_ms"),
    )
    return t.withColumn("failure_rate", F.round(F.col("failures") / F.col("trials"), 6))


def best_trial(trials: DataFrame, run: str, score: str, trial: str) -> DataFrame:
    """The trial of each run with the least finite score; the earliest of equals."""
    ok = trials.filter(F.col(score).isNotNull() & ~F.isnan(score))
    best = F.min(F.struct(F.col(score).alias("score"), F.col(trial).alias("trial")))
    return ok.groupBy(run).agg(best.alias("b")).select(run, F.col("b.trial").alias("best_trial"), F.col("b.score").alias("best_score"))


def latest_success(trials: DataFrame, key: str, ok: Column, trial: str) -> DataFrame:
    """The newest trial of each key that didn't fail, whatever came after it."""
    n = F.row_number().over(W.partitionBy(key).orderBy(F.desc(trial)))
    return trials.filter(ok).withColumn("_n", n).filter("_n = 1").drop("_n")


def convergence(trials: DataFrame, run: str, trial: str, score: str) -> DataFrame:
    """Each trial with the best score of its run so far; nulls leave it."""
    so_far = W.partitionBy(run).orderBy(trial).rowsBetween(W.unboundedPreceding, W.currentRow)
    return trials.withColumn("best_so_far", F.min(score).over(so_far))


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return children.join(parents.select(key).distinct(), key, "left_anti")


def appendable(new: DataFrame, parents: DataFrame, parent: str, existing: DataFrame, keys: list[str]) -> DataFrame:
    """New rows whose parent exists and whose key isn't there yet, one for each key: what a log without constraints may append."""
    kept = new.join(parents.select(parent).distinct(), parent, "left_semi").join(existing.select(*keys).distinct(), keys, "left_anti")
    return kept.dropDuplicates(keys)


def verdicts_with_trials(verdicts: DataFrame, trials: DataFrame, key: str) -> DataFrame:
    """Verdicts with the columns of the trials that they judge; those of no known trial are left out."""
    return verdicts.join(trials, key)
