"""Queries of audits, atlases and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import atlas as L
from ..operators import audit as A
from .tables import TRIALS, table, trials

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _r(c: str, digits: int = 6):
    return F.round(c, digits).alias(c)


_ATTEMPTS = """a AS (SELECT l_partkey AS control, CAST(l_orderkey AS VARCHAR) || '/' || CAST(l_partkey AS VARCHAR) AS session, CAST(l_quantity AS INTEGER) % 4 AS was, CAST(l_quantity AS INTEGER) % 3 AS wrote, CASE WHEN l_returnflag != 'N' THEN CAST(l_quantity AS INTEGER) % 2 END AS kept,
CASE WHEN l_tax >= 0.08 THEN 2 WHEN l_tax >= 0.07 THEN 1 ELSE 0 END AS moved, CASE WHEN l_tax >= 0.07 THEN l_suppkey % 2 END AS address FROM lineitem),
c AS (SELECT *, CASE WHEN kept IS NULL THEN 'unsupported' WHEN moved > 1 THEN 'ambiguous' WHEN moved = 1 THEN 'mapped' WHEN kept = was THEN CASE WHEN wrote = was THEN 'no_op' ELSE 'rejected' END ELSE 'state_only' END AS outcome FROM a)"""


def _attempts(spark: SparkSession, sf: str) -> DataFrame:
    q = "cast(l_quantity as int)"
    a = table(spark, sf, "lineitem").selectExpr(
        "l_partkey as control", "concat_ws('/', string(l_orderkey), string(l_partkey)) as session", f"string({q} % 4) as was", f"string({q} % 3) as wrote", f"CASE WHEN l_returnflag != 'N' THEN string({q} % 2) END as kept", "CASE WHEN l_tax >= 0.08 THEN 2 WHEN l_tax >= 0.07 THEN 1 ELSE 0 END as moved",
        "CASE WHEN l_tax >= 0.07 THEN l_suppkey % 2 END as address",
    )
    return A.classified(a)


@query(f"WITH {_ATTEMPTS} SELECT control, outcome, count(*) AS attempts FROM c GROUP BY ALL")
def probe_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return _attempts(spark, sf).groupBy("control", "outcome").agg(F.count("*").alias("attempts"))


@query(f"""WITH {_ATTEMPTS}, s AS (SELECT session, max(moved) AS m, count(DISTINCT address) AS n, min(address) AS address, count(DISTINCT outcome) AS o, min(outcome) AS only_one, bool_or(outcome = 'state_only') AS st FROM c GROUP BY session)
SELECT session, CASE WHEN m > 1 OR n > 1 THEN 'ambiguous' WHEN n = 1 THEN 'mapped' WHEN st THEN 'state_only' WHEN o = 1 THEN only_one ELSE 'inconclusive' END AS status, CASE WHEN m <= 1 AND n = 1 THEN address END AS address FROM s""")
def probe_summary(spark: SparkSession, sf: str) -> DataFrame:
    return A.summarised(_attempts(spark, sf), "session")


@query("""WITH b AS (SELECT l_orderkey AS k, l_partkey AS p, max(l_quantity) AS v FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL), a AS (SELECT l_orderkey AS k, l_partkey AS p, max(l_quantity) AS v FROM lineitem GROUP BY ALL)
SELECT k AS l_orderkey, p AS l_partkey, b.v AS was, a.v AS now FROM a JOIN b USING (k, p) WHERE abs(a.v - b.v) > 1e-9""")
def moved_controls(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "lineitem")
    of = lambda d: d.groupBy("l_orderkey", "l_partkey").agg(F.max("l_quantity").alias("value"))
    return A.moved_controls(of(e.filter("l_returnflag = 'A'")), of(e), ["l_orderkey", "l_partkey"]).select("l_orderkey", "l_partkey", "was", "now")


@query("""WITH o AS (SELECT l_partkey AS k, min(l_quantity) AS own FROM lineitem WHERE l_returnflag = 'N' GROUP BY ALL), s AS (SELECT DISTINCT l_partkey AS k, l_quantity AS x FROM lineitem), b AS (SELECT k, x, own, min(x) OVER (PARTITION BY k) AS lo, max(x) OVER (PARTITION BY k) AS hi FROM s JOIN o USING (k) WHERE abs(x - own) > 1e-9)
SELECT k AS l_partkey, rank, x AS value FROM (SELECT *, CAST(row_number() OVER (PARTITION BY k ORDER BY CASE WHEN x = lo THEN 0 WHEN x = hi THEN 1 ELSE 2 END, abs(x - own) DESC, x) AS INTEGER) AS rank FROM b) WHERE rank <= 4""")
def probe_values(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "lineitem").withColumnRenamed("l_quantity", "value")
    own = e.filter("l_returnflag = 'N'").groupBy("l_partkey").agg(F.min("value").alias("value"))
    return A.probe_values(own, e, "l_partkey")


@query("""WITH w AS (SELECT l_orderkey AS k, l_partkey AS p, max(l_linestatus) AS v FROM lineitem GROUP BY ALL), r AS (SELECT l_orderkey AS k, l_partkey AS p, min(l_linestatus) AS v FROM lineitem WHERE l_tax > 0.01 GROUP BY ALL)
SELECT w.k AS l_orderkey, w.p AS l_partkey, w.v AS written, r.v AS read FROM w LEFT JOIN r ON w.k = r.k AND w.p = r.p WHERE r.v IS DISTINCT FROM w.v""")
def state_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "lineitem")
    w = e.groupBy("l_orderkey", "l_partkey").agg(F.max("l_linestatus").alias("v"))
    r = e.filter("l_tax > 0.01").groupBy("l_orderkey", "l_partkey").agg(F.min("l_linestatus").alias("v"))
    return A.not_kept(w, r, ["l_orderkey", "l_partkey"], "v")


@query("""WITH d AS (SELECT p_brand AS b, p_size AS i, min(p_type) AS l FROM part GROUP BY ALL), p AS (SELECT p_brand AS b, p_size AS i, max(p_type) AS l FROM part WHERE p_retailprice > 950 GROUP BY ALL)
SELECT coalesce(d.b, p.b) AS p_brand, coalesce(d.i, p.i) AS p_size, d.l AS declared, p.l AS published FROM d FULL JOIN p ON d.b = p.b AND d.i = p.i WHERE d.l IS DISTINCT FROM p.l""")
def published_members(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    d = p.groupBy("p_brand", "p_size").agg(F.min("p_type").alias("label"))
    q = p.filter("p_retailprice > 950").groupBy("p_brand", "p_size").agg(F.max("p_type").alias("label"))
    return A.member_differences(d, q, ["p_brand", "p_size"])


@query("""SELECT bucket, count(*) AS specs FROM (SELECT p_partkey, CASE WHEN m.a IS NULL THEN 'not reached' WHEN m.a NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) THEN 'unpublished' ELSE 'mapped' END AS bucket
FROM part LEFT JOIN (SELECT l_partkey, min(l_suppkey) AS a FROM lineitem WHERE l_tax >= 0.07 GROUP BY ALL) m ON m.l_partkey = p_partkey) GROUP BY bucket""")
def audit_coverage(spark: SparkSession, sf: str) -> DataFrame:
    specs = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"))
    mapped = table(spark, sf, "lineitem").filter("l_tax >= 0.07").groupBy("l_partkey").agg(F.min("l_suppkey").alias("address"))
    published = table(spark, sf, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("address"))
    return A.coverage(specs, mapped, published, "l_partkey", "address").groupBy("bucket").agg(F.count("*").alias("specs"))


@query(f"""WITH {TRIALS}, q AS (SELECT run, round(score, 1) AS score, min(trial) AS id FROM trials WHERE trial % 50 = 0 GROUP BY ALL), m AS (SELECT q.run, q.score, count(*) AS n, min(t.trial) AS found FROM q JOIN trials t ON t.run = q.run AND abs(t.score - q.score) <= 0.001 * greatest(abs(t.score), abs(q.score), 1) GROUP BY ALL)
SELECT q.run, q.score, CASE WHEN n = 1 THEN found END AS found FROM q LEFT JOIN m ON q.run = m.run AND q.score = m.score""")
def resolved_trials(spark: SparkSession, sf: str) -> DataFrame:
    """Every fiftieth trial is asked for among all."""
    t = trials(spark, sf)
    asked = t.filter("trial % 50 = 0").select("run", F.round("score", 1).alias("score")).distinct()
    return A.matched_once(asked, t, "run", "trial", "score", 0.001)


@query("""WITH s AS (SELECT o_custkey AS preset, 'c' || CAST(o_orderkey % 3 AS VARCHAR) AS control, max(o_orderkey % 2) AS value FROM orders GROUP BY ALL), w AS (SELECT * FROM (VALUES ('clean', 'c0', 0), ('clean', 'c1', 1), ('lead', 'c0', 1), ('lead', 'c2', 1), ('any', 'c1', 0)) t(path, control, expected)),
m AS (SELECT preset, path, count(*) AS n FROM s JOIN w ON s.control = w.control AND s.value = w.expected GROUP BY ALL), f AS (SELECT preset, path FROM m WHERE n = (SELECT count(*) FROM w WHERE w.path = m.path))
SELECT preset, min(path) AS path FROM f GROUP BY preset HAVING count(*) = 1""")
def signal_paths(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("preset"), F.expr("concat('c', o_orderkey % 3)").alias("control")).agg(F.expr("string(max(o_orderkey % 2))").alias("value"))
    w = spark.createDataFrame([("clean", "c0", "0"), ("clean", "c1", "1.0"), ("lead", "c0", "1"), ("lead", "c2", "1"), ("any", "c1", "0")], "path string, control string, expected string")
    return A.selected_paths(w, s)


_BANDS = "b AS (SELECT vec_id, unnest(range(0, 64)) AS band, unnest(embedding)::DOUBLE AS x FROM embeddings)"


@query(f"""WITH {_BANDS}, t AS (SELECT vec_id, band, x * 400 AS target_db, x AS delta_db, max(x * 400) OVER (PARTITION BY vec_id) AS peak FROM b), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(delta_db) DESC, band) AS n FROM t WHERE target_db >= peak - 50)
SELECT vec_id, band, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY band) AS INTEGER) AS place FROM r WHERE n <= 5""")
def told_bands(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("band", "x"))
    b = b.select("vec_id", F.col("band").cast("bigint").alias("band"), (F.col("x").cast("double") * 400).alias("target_db"), F.col("x").cast("double").alias("delta_db"))
    return A.told_bands(b, "vec_id", "band").select("vec_id", "band", "place")


@query("""SELECT event_id, concat_ws('; ', CASE WHEN event_type = 'view' THEN 'the instrument isn''t isolated' END, CASE WHEN k < 50 THEN 'distortion is unmeasured' END, CASE WHEN k < 30 THEN 'no delay repeat' END, CASE WHEN k < 40 THEN 'reverberation is uncertain' END, CASE WHEN k % 2 = 0 AND k < 75 THEN 'the amplitude modulation may be the rate of the notes' END, CASE WHEN k % 7 < 2 THEN 'mono: width isn''t measured' END, CASE WHEN k % 7 > 5 THEN 'loudness was metered on the fold of all channels' END) AS notes
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)""")
def measurement_notes(spark: SparkSession, sf: str) -> DataFrame:
    t = trials(spark, sf)
    c = F.col("k") / 100.0
    return t.select(F.col("trial").alias("event_id"), F.array_join(A.caveats(F.when(F.col("kind") == "view", "mix"), c, c, c, F.col("k") % 7, F.when(F.col("k") % 2 == 0, 5.0), c), "; ").alias("notes"))


@query(f"""WITH {_BANDS}, f AS (SELECT *, x > -0.1 AS ok FROM b), g AS (SELECT vec_id, sum(CAST(NOT ok AS INTEGER)) OVER (PARTITION BY vec_id ORDER BY band) AS lo, sum(CAST(NOT ok AS INTEGER)) OVER (PARTITION BY vec_id ORDER BY band DESC) AS hi FROM f)
SELECT vec_id, count(*) FILTER (lo = 0) AS low_run, count(*) FILTER (hi = 0) AS high_run FROM g GROUP BY vec_id""")
def edge_runs(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("band", "x")).withColumn("ok", F.col("x").cast("double") > -0.1)
    return A.edge_runs(b, "vec_id", "band", "ok")


_SCORES = f"{TRIALS}, s AS (SELECT kind, run, min(score) AS atlas, avg(score) AS neutral FROM trials GROUP BY ALL)"


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    return trials(spark, sf).groupBy("kind", "run").agg(F.min("score").alias("atlas"), F.avg("score").alias("neutral"))


@query(f"""WITH {_SCORES} SELECT kind, count(*) AS samples, round(avg(neutral), 6) AS neutral_mean, round(avg(atlas), 6) AS atlas_mean, round(median(neutral), 6) AS neutral_median, round(median(atlas), 6) AS atlas_median, round(avg(CAST(atlas < neutral AS INTEGER)), 6) AS win_rate FROM s GROUP BY kind""")
def held_out_statistics(spark: SparkSession, sf: str) -> DataFrame:
    h = L.held_out(_scores(spark, sf), "kind", "neutral", "atlas")
    return h.select("kind", "samples", *(_r(c) for c in ("neutral_mean", "atlas_mean", "neutral_median", "atlas_median", "win_rate")))


@query(f"""WITH {_SCORES} SELECT kind, true AS aligned, round((avg(neutral) - avg(atlas)) / avg(neutral), 6) AS mean_reduction, count(*) FILTER (atlas < neutral) AS better, round(median(CASE WHEN neutral != 0 THEN (neutral - atlas) / neutral END), 6) AS median_reduction, round(min(CASE WHEN neutral != 0 THEN (neutral - atlas) / neutral END), 6) AS worst_reduction FROM s GROUP BY kind""")
def atlas_scale(spark: SparkSession, sf: str) -> DataFrame:
    s = _scores(spark, sf)
    c = L.scale_comparison(s.withColumnRenamed("neutral", "x"), s.withColumnRenamed("atlas", "x"), "kind", "run", "x")
    return c.select("kind", "aligned", _r("mean_reduction"), "better", _r("median_reduction"), _r("worst_reduction"))


@query(f"""WITH {TRIALS}, s AS (SELECT run, (k % 4) * 0.25 AS blend, avg(score) AS score FROM trials GROUP BY ALL), z AS (SELECT s.*, b.score AS base FROM s JOIN (SELECT run, score FROM s WHERE blend = 0) b USING (run)), g AS (SELECT blend, avg(score) AS mean, median(score) AS med, count(*) FILTER (score < base) AS wins FROM z GROUP BY blend)
SELECT blend, round(mean, 6) AS mean, round(med, 6) AS median, wins, row_number() OVER (ORDER BY round(mean, 12), blend) = 1 AS chosen FROM g""")
def blend_choice(spark: SparkSession, sf: str) -> DataFrame:
    s = trials(spark, sf).groupBy("run", (F.col("k") % 4 * 0.25).alias("blend")).agg(V.steady_mean(F.col("score")).alias("score"))
    return L.best_blend(s, "run", "blend", "score").select("blend", _r("mean"), _r("median"), "wins", "chosen")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, round(greatest(least(round_even((l_quantity + CASE WHEN l_returnflag != 'N' THEN 0.25 * (l_tax * 500 - l_quantity) ELSE 0 END) / 0.5, 0) * 0.5, 50.0), 0.0), 6) AS setting FROM lineitem""")
def blended_settings(spark: SparkSession, sf: str) -> DataFrame:
    s = L.blended(F.col("l_quantity"), F.col("l_tax") * 500, F.lit(0.25), F.col("l_returnflag") != "N", F.lit(0.5), F.lit(0.0), F.lit(50.0))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", s.alias("setting"))


@query("""SELECT o_orderkey, level, CAST(replicate AS INTEGER) AS replicate FROM orders, (SELECT unnest([0.0, -6.0, 6.0])::DOUBLE AS level), (SELECT unnest(range(0, 3)) AS replicate)""")
def robustness_grid(spark: SparkSession, sf: str) -> DataFrame:
    return L.robustness_grid(table(spark, sf, "orders").select("o_orderkey"), [0.0, -6.0, 6.0], 3)


@query(f"""WITH {TRIALS} SELECT run, round(coalesce(CASE WHEN count(score) FILTER (k < 3) >= 2 THEN max(score) FILTER (k < 3) - min(score) FILTER (k < 3) END, 0.5), 6) AS floor FROM trials GROUP BY run""")
def backend_floor(spark: SparkSession, sf: str) -> DataFrame:
    t = trials(spark, sf).select("run", F.when(F.col("k") < 3, F.col("score")).alias("s"))
    return L.backend_floor(t, "run", "s", F.lit(0.5)).select("run", _r("floor"))


@query("""SELECT l_suppkey, 3 - count(DISTINCT CASE WHEN l_quantity IN (1, 25, 60) THEN l_quantity END) AS missing FROM lineitem GROUP BY l_suppkey""")
def basis_centres(spark: SparkSession, sf: str) -> DataFrame:
    return L.basis_for(table(spark, sf, "lineitem"), [1.0, 25.0, 60.0], "l_suppkey", "l_quantity")
