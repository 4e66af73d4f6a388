"""The running state of each run in a stream of trials: its best, its newest success, and how often it has failed since.

State is kept by Spark in RocksDB under each run: a value with what is best and newest, a map of the failures that are newer than
the newest success, and a timer. Neither the order in which trials arrive nor how they fall into batches changes what is found,
and a trial that comes twice counts once towards the failures.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: What a session needs for this state; set it where the session is made.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
STATE = "run long, trials long, best_trial long, best_score double, newest_success long, failures_since long, expired boolean"
_VALUE = "trials long, best_trial long, best_score double, newest_success long, failures_since long"


class _Run(StatefulProcessor):
    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", _VALUE)
        self.failed = handle.getMapState("failed", "trial long", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        n, best, score, newest, since = self.value.get() or (0, None, None, None, 0)
        # Each look at the state is a message to the JVM, so failures are gathered, and those that count in the end are written.
        new: set[int] = set()
        for row in rows:
            n += 1
            if row.score is not None and (score is None or (row.score, row.trial) < (score, best)):
                best, score = row.trial, row.score
            if not row.failed:
                newest = row.trial if newest is None else max(newest, row.trial)
            elif newest is None or row.trial > newest:
                new.add(row.trial)
        if newest is not None:
            new = {t for t in new if t > newest}
        if since:
            old = []
            for (trial,) in self.failed.keys():
                if newest is not None and trial <= newest:
                    old.append(trial)
                else:
                    new.discard(trial)
            for trial in old:
                self.failed.removeKey((trial,))
            since -= len(old)
        for trial in new:
            self.failed.updateValue((trial,), (0,))
        since += len(new)
        self.value.update((n, best, score, newest, since))
        if self.idle_ms is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield _row(key[0], (n, best, score, newest, since), False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield _row(key[0], self.value.get(), True)
        self.value.clear()
        self.failed.clear()

    def close(self) -> None:
        pass


def _row(run: int, state: tuple, expired: bool) -> Row:
    return Row(*(x.split()[0] for x in STATE.split(",")))(run, *state, expired)


def running_state(trials: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Rows of STATE for the stream of trials (run long, trial long, score double, failed boolean): a run's state after each batch that has trials of it.

    best is the least score, the earliest of equals; a null or NaN score isn't one. failures_since counts the failed trials newer
    than the newest one that didn't fail. Rows without a run or a trial are left out; a null failed counts as failed. After idle_ms without
    trials a run's state is given once more, as expired, and forgotten. For update mode, in a session with PROVIDER.
    """
    rows = trials.filter("run is not null and trial is not null").select("run", "trial", F.nanvl("score", F.lit(None)).alias("score"), F.coalesce("failed", F.lit(True)).alias("failed"))
    mode = "none" if idle_ms is None else "processingTime"
    return rows.groupBy("run").transformWithState(_Run(idle_ms), STATE, "Update", mode)


def batch_state(trials: DataFrame) -> DataFrame:
    """The same for all trials at once, without the stream; no run is expired."""
    rows = trials.filter("run is not null and trial is not null").select("run", "trial", F.nanvl("score", F.lit(None)).alias("score"), F.coalesce("failed", F.lit(True)).alias("failed"))
    best = F.min(F.when(F.col("score").isNotNull(), F.struct("score", "trial")))
    out = rows.groupBy("run").agg(F.count("*").alias("trials"), best.alias("b"), F.max(F.when(~F.col("failed"), F.col("trial"))).alias("newest_success"))
    failed = rows.filter("failed").select("run", "trial").distinct().join(out.select("run", "newest_success"), "run")
    since = failed.filter("newest_success is null or trial > newest_success").groupBy("run").agg(F.count("*").alias("failures_since"))
    both = out.join(since, "run", "left")
    return both.select("run", "trials", F.col("b.trial").alias("best_trial"), F.col("b.score").alias("best_score"), "newest_success", F.coalesce("failures_since", F.lit(0)).alias("failures_since"), F.lit(False).alias("expired"))


def states_of(spark: SparkSession, trials: DataFrame, folder: str) -> DataFrame:
    """The last state of each run of a stream of trials, run until what is there has been read; folder keeps the stream's checkpoint and its states.

    A query that is started again with the same folder goes on where it was.
    """
    query = running_state(trials).writeStream.outputMode("update").foreachBatch(lambda batch, k: batch.withColumn("batch", F.lit(k)).write.mode("overwrite").parquet(f"{folder}/states/batch={k:09}"))
    query.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    states = spark.read.schema(STATE + ", batch long").parquet(f"{folder}/states/*")
    newest = F.row_number().over(W.partitionBy("run").orderBy(F.desc("batch"), F.desc("trials")))
    return states.withColumn("_n", newest).filter("_n = 1").drop("_n", "batch")
