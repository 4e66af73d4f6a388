"""Trials that arrive over time: appended once, deduplicated, with running bests and windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

#: Identities of a batch that may be broadcast to the rows already there; beyond it both sides shuffle.
BATCH_IDS = 1_000_000


def read_log(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    """Rows appended to a folder of Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def once(events: DataFrame, identity: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """Each identity once while it may still repeat."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(identity)


def running_best(trials: DataFrame, run: str, trial: str, score: str) -> DataFrame:
    """The best trial of each run so far (the earliest of equals); for update or complete mode."""
    best = F.min(F.struct(F.col(score).alias("score"), F.col(trial).alias("trial")))
    ok = trials.filter(F.col(score).isNotNull() & ~F.isnan(score))
    return ok.groupBy(run).agg(best.alias("b")).select(run, F.col("b.trial").alias("best_trial"), F.col("b.score").alias("best_score"))


def windowed(trials: DataFrame, time: str, width: str, late: str, *keys: str) -> DataFrame:
    """Trials and failures in each window of time."""
    w = trials.withWatermark(time, late).groupBy(F.window(time, width), *keys)
    return w.agg(F.count("*").alias("trials"), F.count_if("failed").alias("failures")).select("window.start", *keys, "trials", "failures")


def append_new(events: DataFrame, path: str, identity: list[str], checkpoint: str) -> StreamingQuery:
    """Appends identities that the folder doesn't hold yet, one row for each; a batch that runs again adds nothing.

    Only the folder's identities are read, and only the batch's rows meet them.
    """

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(identity)
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            kept = spark.read.schema(new.schema).parquet(path).select(*identity)
            known = kept.join(F.broadcast(new.select(*identity)) if new.count() <= BATCH_IDS else new.select(*identity), identity, "left_semi")
            new = new.join(known.distinct(), identity, "left_anti")
        new.write.mode("append").parquet(path)

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
