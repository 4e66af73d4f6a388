"""Queries of onsets, levels, responses, catalogs of measurements and enumerations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import levels as L
from ..operators import atlas as B
from ..operators import audit as A
from ..operators import inversion as I  # noqa: E741, N812
from ..operators import signals as G
from ..operators import space as S
from ..operators import trials as T
from ..sources import documents as D
from .tables import TRIALS, table, trials

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""SELECT user_id, event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS until FROM events""")
def note_segments(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", "event_id")
    return G.attack_segments(e, "user_id", "event_id")


@query("""SELECT user_id, event_id FROM (SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE b IS NULL OR event_id - b > 20""")
def primary_onsets(spark: SparkSession, sf: str) -> DataFrame:
    return G.primary_onsets(table(spark, sf, "events").select("user_id", "event_id"), 20, "user_id", "event_id")


@query("""SELECT vec_id, round(pow(10, embedding[1]::DOUBLE), 6) AS gain, round(20 * log10(greatest(abs(embedding[2]::DOUBLE), 1e-12)), 6) AS db, round(10 * log10(greatest(embedding[2]::DOUBLE ** 2, 1e-30)), 6) AS power_db FROM embeddings""")
def gain_levels(spark: SparkSession, sf: str) -> DataFrame:
    e = [F.col("embedding")[k].cast("double") for k in range(2)]
    return table(spark, sf, "embeddings").select("vec_id", F.round(L.gain(e[0] * 20), 6).alias("gain"), F.round(L.decibels(F.abs(e[1])), 6).alias("db"), F.round(L.power_db(e[1] * e[1]), 6).alias("power_db"))


@query("""WITH m AS (SELECT n_regionkey AS header, min(n_name) AS pack_id FROM nation WHERE n_regionkey != 3 GROUP BY 1) SELECT c_custkey, c_nationkey % 6 AS header, pack_id FROM customer LEFT JOIN m ON c_nationkey % 6 = header""")
def header_routes(spark: SparkSession, sf: str) -> DataFrame:
    packs = table(spark, sf, "nation").filter("n_regionkey != 3").select(F.col("n_regionkey").alias("file_header"), F.col("n_name").alias("pack_id"))
    return D.routed(table(spark, sf, "customer").select("c_custkey", (F.col("c_nationkey") % 6).alias("header")), packs).select("c_custkey", "header", "pack_id")


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 2 = 0 THEN 'cabParameters' ELSE 'delay' END AS module, ['leftChosenIRFilePath', 'rightMicType', 'leftMicType', 'other'][l_partkey % 4 + 1] AS key, CASE WHEN l_quantity > 25 THEN '10' ELSE 'x' END AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN module = 'cabParameters' AND key = 'leftChosenIRFilePath' THEN '' WHEN module = 'cabParameters' AND key = 'leftMicType' AND v = '10' THEN '0' WHEN module = 'cabParameters' AND key = 'rightMicType' AND v = '10' THEN '4' ELSE v END AS value FROM p""")
def stripped_files(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.expr("CASE WHEN l_partkey % 2 = 0 THEN 'cabParameters' ELSE 'delay' END AS module"), F.expr("array('leftChosenIRFilePath', 'rightMicType', 'leftMicType', 'other')[l_partkey % 4] AS key"), F.expr("CASE WHEN l_quantity > 25 THEN '10' ELSE 'x' END AS value"))
    return A.without_files(p).select("l_orderkey", "l_linenumber", "l_partkey", "value")


@query(f"""WITH {TRIALS} SELECT trial, error OR score < 5 OR silent AS failed FROM trials""")
def failed_trials(spark: SparkSession, sf: str) -> DataFrame:
    t = trials(spark, sf)
    return t.select("trial", T.failed(F.when(F.col("error"), "broken"), F.expr("CASE WHEN score >= 5 THEN score END"), F.when(F.col("silent"), True)).alias("failed"))


@query(f"""WITH {TRIALS}, s AS (SELECT run, avg(score) AS a, avg(k) AS b FROM trials GROUP BY run) SELECT run FROM s WHERE run % 3 = 0""")
def held_out_faults(spark: SparkSession, sf: str) -> DataFrame:
    t = trials(spark, sf).select("run", F.col("k").cast("double").alias("k"), "score")
    stored = B.held_out(t, "run", "k", "score").withColumn("atlas_mean", F.expr("CASE WHEN run % 3 = 0 THEN atlas_mean + 1 ELSE atlas_mean END"))
    return B.held_out_faults(stored, t, "run", "k", "score")


@query("""WITH r AS (SELECT vec_id, unnest([-6, 0, 6]) AS g, unnest([embedding[1], embedding[2], embedding[3]])::DOUBLE AS y FROM embeddings), a AS (SELECT vec_id, max(y) FILTER (g > 0) AS up, max(y) FILTER (g = 0) AS flat, max(y) FILTER (g < 0) AS down FROM r GROUP BY vec_id)
SELECT vec_id, round((up - down) / 12, 8) AS db_per_db, round(abs(up + down - 2 * flat), 6) AS nonlinear_db FROM a""")
def band_slopes(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "embeddings").select("vec_id", F.posexplode(F.slice("embedding", 1, 3)).alias("i", "y")).select("vec_id", (F.col("i") * 6 - 6).cast("double").alias("g"), F.col("y").cast("double").alias("y"))
    return I.linear_slope(r, ["vec_id"], "g", "y").select("vec_id", F.round("db_per_db", 8).alias("db_per_db"), F.round("nonlinear_db", 6).alias("nonlinear_db"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding[1:12]::DOUBLE[], lambda x: x * 60) AS y, list_transform(range(0, 12), lambda k: 100.0 * 2 ** (k / 3.0)) AS hz FROM embeddings), t AS (SELECT *, list_max(y) - 6 AS least FROM e),
i AS (SELECT *, list_filter(range(1, 13), lambda k: y[k] >= least) AS inside FROM t), c AS (SELECT *, list_min(inside) AS lo, list_max(inside) AS hi FROM i)
SELECT vec_id, round(CASE WHEN lo > 1 THEN pow(10, log10(hz[lo]) + (y[lo] - least) / (y[lo] - y[lo - 1]) * (log10(hz[lo - 1]) - log10(hz[lo]))) ELSE hz[1] END, 4) AS low_hz, round(CASE WHEN hi < 12 THEN pow(10, log10(hz[hi]) + (y[hi] - least) / (y[hi] - y[hi + 1]) * (log10(hz[hi + 1]) - log10(hz[hi]))) ELSE hz[12] END, 4) AS high_hz FROM c""")
def corner_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    hz = F.expr("transform(sequence(0, 11), k -> 100D * power(2D, k / 3D))")
    c = G.corners(hz, F.transform(F.slice("embedding", 1, 12), lambda x: x.cast("double") * 60))
    return table(spark, sf, "embeddings").select("vec_id", F.round(c["low_hz"], 4).alias("low_hz"), F.round(c["high_hz"], 4).alias("high_hz"))


@query("""SELECT p_partkey, round(2595 * log10(1 + p_size * 100 / 700.0), 6) AS mel, p_size * 100.0 AS hz FROM part""")
def mel_scale(spark: SparkSession, sf: str) -> DataFrame:
    hz = F.col("p_size") * 100.0
    return table(spark, sf, "part").select("p_partkey", F.round(G.mel(hz), 6).alias("mel"), F.round(G.from_mel(G.mel(hz)), 4).alias("hz"))


@query("""SELECT s_suppkey, k AS i, round(0.5 * sin(2 * pi() * (100 + s_suppkey % 7 * 50) * k / 8000), 6) AS x FROM supplier, (SELECT unnest(range(0, 64)) AS k)""")
def sine_tones(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "supplier").select("s_suppkey", (100.0 + F.col("s_suppkey") % 7 * 50).alias("hz"), F.lit(0.5).alias("amplitude"), F.lit(64).alias("n"))
    return G.tones(r, 8000).select("s_suppkey", F.posexplode("samples").alias("i", "x")).select("s_suppkey", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


@query("""SELECT s_suppkey, concat_ws(',', CASE WHEN s_suppkey % 2 = 0 THEN 'schema' END, CASE WHEN s_suppkey % 3 = 0 THEN 'sample count' END, CASE WHEN s_suppkey % 5 = 0 THEN 'caveat' END, CASE WHEN s_suppkey % 7 = 0 THEN 'dimensions' END, CASE WHEN s_suppkey % 11 = 0 THEN 'unknown feature' END, CASE WHEN s_suppkey % 13 = 0 THEN 'range' END, CASE WHEN s_suppkey % 7 = 0 OR s_suppkey % 17 = 0 THEN 'settings' END) AS faults FROM supplier""")
def atlas_faults(spark: SparkSession, sf: str) -> DataFrame:
    text = F.expr("""concat('{"schema": "', if(s_suppkey % 2 = 0, 'old', 'v1'), '", "sample_count": ', if(s_suppkey % 3 = 0, 2, 1), ', "renderer": {"reproducible": ', if(s_suppkey % 5 = 0, 'false', 'true'), '}, "dimensions": ["a", "', if(s_suppkey % 7 = 0, 'a', 'b'),
    '"], "achievable_ranges": {"', if(s_suppkey % 11 = 0, 'odd', 'tilt'), '": {"min": ', if(s_suppkey % 13 = 0, 5, 1), ', "max": 2}}, "entries": [{"settings": {"a": 1, "', if(s_suppkey % 17 = 0, 'c', 'b'), '": 2}, "fingerprint": "{}"}]}')""")
    out = D.atlas_faults(table(spark, sf, "supplier").select("s_suppkey", text.alias("json")), "s_suppkey", "json", "v1", ["tilt"])
    return out.select("s_suppkey", F.array_join("faults", ",").alias("faults"))


@query("""SELECT n_name AS profile, unnest(['weights', 'weights', 'scales']) AS part, unnest(['timbre', 'level', 'band_db']) AS name, unnest([n_nationkey, n_regionkey, 3])::DOUBLE AS value FROM nation""")
def loss_profiles(spark: SparkSession, sf: str) -> DataFrame:
    text = F.expr("""concat('{"', n_name, '": {"weights": {"timbre": ', n_nationkey, ', "level": ', n_regionkey, '}, "scales": {"band_db": 3.0}}}')""")
    return D.profiles(table(spark, sf, "nation").select(text.alias("json")), "json")


@query("""SELECT c_custkey, 'segment' AS field, c_mktsegment AS ran, 'BUILDING' AS measured FROM customer WHERE c_mktsegment != 'BUILDING' UNION ALL SELECT c_custkey, 'nation', CAST(c_nationkey AS VARCHAR), CAST(c_nationkey % 5 AS VARCHAR) FROM customer WHERE c_nationkey != c_nationkey % 5""")
def provenance_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    runs = c.select("c_custkey", F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    return D.same_provenance(runs, c.select("c_custkey", F.lit("BUILDING").alias("segment"), (F.col("c_nationkey") % 5).alias("nation")), "c_custkey", ["segment", "nation"])


@query("""WITH l AS (SELECT l_suppkey AS run, l_partkey AS control, max(CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE l_quantity - 25 END) AS change, min(l_discount) AS d FROM lineitem GROUP BY ALL), b AS (SELECT *, CASE WHEN control % 5 != 0 THEN (control % 20) / 2.0 END AS current, run % 3 = 0 AS on_ FROM l),
w AS (SELECT *, change + CASE WHEN on_ THEN current WHEN current IS NOT NULL THEN 0 END AS wanted, max(CAST(change != 0 AS INTEGER)) OVER (PARTITION BY run) AS moves FROM b)
SELECT run, control, round(CASE WHEN wanted IS NOT NULL THEN least(greatest(wanted, -12), 12) END, 2) AS value, CASE WHEN wanted IS NULL THEN 'no stored value' WHEN abs(least(greatest(wanted, -12), 12) - wanted) > 0.005 THEN 'held at the range''s end' END AS note FROM w WHERE moves = 1 AND NOT (change = 0 AND on_)""")
def absolute_bands(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("run"), F.col("l_partkey").alias("control"), F.expr("CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE l_quantity - 25 END").alias("change"))
    parts = rows.count() // I.ROWS + 1
    l = rows.repartition(parts, "run", "control").groupBy("run", "control").agg(F.max("change").alias("change"))  # noqa: E741
    settings = l.select("run", "control", F.expr("CASE WHEN control % 5 != 0 THEN (control % 20) / 2D END AS current"), F.expr("run % 3 = 0 AS eq_on"))
    return I.absolute_bands(l.withColumns({"low": F.lit(-12.0), "high": F.lit(12.0)}), settings, "run", "control", parts)


@query("""WITH k AS (SELECT p_partkey AS path, CASE WHEN p_size % 3 = 0 THEN 2 WHEN p_size % 3 = 1 AND p_size % 4 > 0 THEN p_size % 4 END AS n FROM part), a AS (SELECT o_custkey AS run, o_orderkey % 60 + 1 AS path, 400 AS b FROM orders WHERE o_orderkey % 5 = 0),
g AS (SELECT run, count(*) AS n, count(DISTINCT a.path) AS paths, count(k.n) AS found, CAST(product(coalesce(k.n, 1)) AS BIGINT) AS c FROM a LEFT JOIN k ON a.path = k.path GROUP BY run), e AS (SELECT *, CASE WHEN n > paths THEN 'a control twice' WHEN found < n THEN 'not a choice' WHEN 400 // c < 50 THEN 'too small a budget' END AS error FROM g)
SELECT run, c AS combinations, CASE WHEN error IS NULL THEN 400 // c END AS each, error FROM e""")
def enumerated_controls(spark: SparkSession, sf: str) -> DataFrame:
    dims = table(spark, sf, "part").select(F.col("p_partkey").alias("path"), F.expr("CASE p_size % 3 WHEN 0 THEN 'switch' WHEN 1 THEN 'enum' ELSE 'metered' END AS kind"), (F.col("p_size") % 4).cast("int").alias("members"))
    asked = table(spark, sf, "orders").filter("o_orderkey % 5 = 0").select(F.col("o_custkey").alias("run"), (F.col("o_orderkey") % 60 + 1).alias("path"), F.lit(400).alias("budget"))
    return S.enumeration(asked, S.choices(dims), "run", "budget", 50)
