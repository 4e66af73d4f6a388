"""Queries of clips in chunks, pitched runs, trial resolution and the state of a stream of trials."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import audit as A
from ..operators import chunks as C
from ..operators import signals as G
from ..session import delete_folder, new_folder
from ..streaming import state
from .tables import TRIALS, table, trials

QUERIES, SQL = {}, {}
#: Samples of a chunk: an embedding is one.
LENGTH = 64


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    """A clip for each label: its embeddings in a row."""
    e = table(spark, sf, "embeddings").filter("embedding is not null and label is not null")
    place = F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1
    return e.select(F.col("label").alias("clip"), place.cast("long").alias("chunk"), F.col("embedding").cast("array<double>").alias("samples"))


_SAMPLES = f"c AS (SELECT label AS clip, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS chunk, embedding::DOUBLE[] AS x FROM embeddings WHERE label IS NOT NULL), s AS (SELECT clip, chunk * {LENGTH} + unnest(range(0, {LENGTH})) AS i, unnest(x) AS x FROM c)"


@query(f"""WITH {_SAMPLES}, w AS (SELECT clip, i, sqrt(avg(x * x) OVER f) AS level, count(*) OVER f AS n FROM s WINDOW f AS (PARTITION BY clip ORDER BY i ROWS BETWEEN CURRENT ROW AND 149 FOLLOWING))
SELECT clip, CAST(i // 37 AS BIGINT) AS frame, round(level, 6) AS level FROM w WHERE i % 37 = 0 AND n = 150""")
def chunked_frames(spark: SparkSession, sf: str) -> DataFrame:
    """The level of every frame of 150 samples, across the borders of chunks."""
    f = C.frames(_chunks(spark, sf), LENGTH, 150, 37)
    level = F.sqrt(F.aggregate("samples", F.lit(0.0), lambda s, x: s + x * x) / F.size("samples"))
    return f.select("clip", F.col("frame").cast("long").alias("frame"), F.round(level, 6).alias("level"))


@query(f"""WITH {_SAMPLES}, m AS (SELECT clip, avg(x) AS m, sum(x * x) - sum(x) * sum(x) / count(*) AS e FROM s GROUP BY clip), t AS (SELECT clip, i, 0.3 * x - CASE WHEN i % {LENGTH} >= 3 THEN lag(x, 3) OVER (PARTITION BY clip ORDER BY i) ELSE 0 END AS y FROM s),
n AS (SELECT clip, avg(y) AS m, sum(y * y) - sum(y) * sum(y) / count(*) AS e FROM t GROUP BY clip), l AS (SELECT s.clip, t.i - s.i AS lag, sum((x - m.m) * (y - n.m)) AS c FROM s JOIN m USING (clip) JOIN n USING (clip) JOIN t ON t.clip = s.clip AND t.i - s.i BETWEEN -9 AND 9 GROUP BY ALL),
p AS (SELECT *, abs(lag(c) OVER w) AS b, abs(lead(c) OVER w) AS a FROM l WINDOW w AS (PARTITION BY clip ORDER BY lag)), k AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY clip ORDER BY abs(c) DESC, abs(lag), lag) = 1)
SELECT clip, lag AS offset_samples, round(least(greatest(0.5 * (b - a) / (b - 2 * abs(c) + a), -0.5), 0.5), 5) AS fraction, round(c / sqrt(m.e * n.e), 6) AS r, CASE WHEN c < 0 THEN -1 ELSE 1 END AS polarity, abs(c / sqrt(m.e * n.e)) >= 0.3 AS trusted FROM k JOIN m USING (clip) JOIN n USING (clip)""")
def aligned_clips(spark: SparkSession, sf: str) -> DataFrame:
    """By how much each clip lags behind the one it was made from, in parts of chunks."""
    a = _chunks(spark, sf)
    late = F.transform("samples", lambda x, i: 0.3 * x - F.when(i >= 3, F.get("samples", i - 3)).otherwise(0.0))
    found = C.aligned(a, a.withColumn("samples", late), LENGTH, 9)
    return found.select("clip", F.col("offset").alias("offset_samples"), F.round("fraction", 5).alias("fraction"), F.round("r", 6).alias("r"), "polarity", "trusted")


_FRAMES = "f AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS frame, 100.0 + (event_id * 7) % 9 AS pitch, CASE WHEN event_type = 'error' THEN 0.25 ELSE 0.625 + (event_id % 8) / 32 END AS score FROM events)"


@query(f"""WITH RECURSIVE {_FRAMES}, r AS (SELECT user_id, frame, CASE WHEN score > 0.55 THEN frame END AS start, pitch AS first FROM f WHERE frame = 1 UNION ALL
SELECT f.user_id, f.frame, CASE WHEN f.score > 0.55 THEN CASE WHEN r.start IS NOT NULL AND abs(f.pitch - r.first) <= 0.05 * r.first THEN r.start ELSE f.frame END END, CASE WHEN r.start IS NOT NULL AND abs(f.pitch - r.first) <= 0.05 * r.first THEN r.first ELSE f.pitch END FROM r JOIN f ON f.user_id = r.user_id AND f.frame = r.frame + 1),
n AS (SELECT user_id, start, count(*) AS n FROM r WHERE start IS NOT NULL GROUP BY user_id, start QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, start) = 1)
SELECT n.user_id, start, n AS frames, median(pitch) AS pitch, median(score) AS periodicity FROM n JOIN f ON f.user_id = n.user_id AND f.frame >= start AND f.frame < start + n GROUP BY ALL""")
def pitched_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's longest run of frames that stay near the run's first pitch."""
    frame = F.row_number().over(W.partitionBy("user_id").orderBy("event_id"))
    score = F.when(F.col("event_type") == "error", 0.25).otherwise(0.625 + (F.col("event_id") % 8) / 32)
    f = table(spark, sf, "events").select("user_id", frame.alias("frame"), (100.0 + (F.col("event_id") * 7) % 9).alias("pitch"), score.alias("score"))
    return G.pitched_run(f, "user_id")


@query("""WITH l AS (SELECT vec_id, 40.0 * (unnest(range(0, 64)) + 1) * (1 + label) AS hz, unnest(embedding)::DOUBLE AS x, 60.0 + vec_id % 200 AS f0 FROM embeddings WHERE label IS NOT NULL), h AS (SELECT vec_id, hz, x * x AS p, len(list_filter(range(1, 25), lambda k: abs(hz - k * f0) <= greatest(2.0, k * f0 * 0.02))) AS n,
len(list_filter(range(1, 25), lambda k: abs(hz - k * f0) <= greatest(2.0, k * f0 * 0.02) AND k % 2 = 1 AND k > 1)) AS odd, len(list_filter(range(1, 25), lambda k: abs(hz - k * f0) <= greatest(2.0, k * f0 * 0.02) AND k % 2 = 0)) AS even FROM l),
g AS (SELECT vec_id, sum(p) AS t, sum(p * n) AS h, sum(p * odd) AS o, sum(p * even) AS e, sum(CASE WHEN hz >= 4000 AND n = 0 THEN p ELSE 0 END) AS z FROM h GROUP BY vec_id)
SELECT vec_id, round(CASE WHEN t > h AND h > 0 THEN 10 * log10(h / (t - h)) END, 4) AS hnr_db, round(CASE WHEN e > 0 THEN o / e END, 4) AS odd_even_ratio, round(CASE WHEN t > 0 THEN z / t END, 6) AS hf_residual_index FROM g""")
def harmonic_balance(spark: SparkSession, sf: str) -> DataFrame:
    """How much of each spectrum lies in the harmonics of a pitch."""
    e = table(spark, sf, "embeddings").filter("label is not null")
    lines = e.select("vec_id", F.posexplode("embedding").alias("k", "x"), "label").select("vec_id", (40.0 * (F.col("k") + 1) * (1 + F.col("label"))).alias("hz"), (F.col("x").cast("double") * F.col("x").cast("double")).alias("power"))
    out = G.harmonic_balance(lines, e.select("vec_id", (60.0 + F.col("vec_id") % 200).alias("f0")), "vec_id")
    return out.select("vec_id", F.round("hnr_db", 4).alias("hnr_db"), F.round("odd_even_ratio", 4).alias("odd_even_ratio"), F.round("hf_residual_index", 6).alias("hf_residual_index"))


@query(f"""WITH {TRIALS}, t AS (SELECT trial, run, score, epoch(ts) AS at, kind, k FROM trials), q AS (SELECT * FROM t WHERE trial % 50 = 0)
SELECT q.trial, count(t.trial) AS hits, CASE WHEN count(t.trial) = 1 THEN min(t.trial) END AS found FROM q LEFT JOIN t ON t.run = q.run AND abs(t.score - q.score) <= 0.0005 * greatest(1, abs(t.score), abs(q.score)) AND abs(t.k - q.k) <= 0.0005 * greatest(1, abs(t.k), abs(q.k)) AND t.kind = q.kind GROUP BY q.trial""")
def resolved_settings(spark: SparkSession, sf: str) -> DataFrame:
    """Every fiftieth trial is asked for among all by its run, its numbers and its settings."""
    t = trials(spark, sf).select("trial", "run", "score", "k", F.create_map(F.lit("kind"), F.col("kind")).alias("settings"))
    return A.resolved(t.filter("trial % 50 = 0"), t, "trial", ["run"], ["score", "k"], "settings", 0.0005).select("trial", "hits", "found")


@query(f"""WITH {TRIALS}, s AS (SELECT run, count(*) AS trials, arg_min(trial, (score, trial)) FILTER (NOT isnan(score)) AS best_trial, min(score) FILTER (NOT isnan(score)) AS best_score, max(trial) FILTER (NOT error) AS newest_success FROM trials WHERE run IS NOT NULL GROUP BY run)
SELECT s.*, count(DISTINCT trial) FILTER (error AND (newest_success IS NULL OR trial > newest_success)) AS failures_since, false AS expired FROM s JOIN trials t ON t.run = s.run GROUP BY ALL""")
def running_state(spark: SparkSession, sf: str) -> DataFrame:
    """The last state of each run, of a stream that reads all trials in several batches."""
    own = spark.newSession()
    own.conf.set(*state.PROVIDER)
    folder = new_folder(spark, "running")
    t = trials(spark, sf).select("run", "trial", "score", F.col("error").alias("failed"))
    t.repartition(4, "trial").write.parquet(f"{folder}/log")
    stream = own.readStream.schema(t.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/log")
    last = state.states_of(own, stream, folder)
    result = new_folder(spark, "states")
    last.write.parquet(result)
    delete_folder(spark, folder)
    return spark.read.schema(last.schema).parquet(result)
