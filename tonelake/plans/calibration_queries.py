"""Queries of calibration: repeats, grids, harmonics, alignment, cepstra and drawn settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import calibration as K
from .tables import table

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


def _samples(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    return s.select("vec_id", F.col("i").cast("bigint").alias("i"), F.col("x").cast("double").alias("x"))


def _next(s: DataFrame) -> DataFrame:
    return s.withColumn("vec_id", F.col("vec_id") - 1)


_SAMPLES = "s AS (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)"


@query("""SELECT l_suppkey, l_linenumber, CASE WHEN count(l_quantity) >= 2 THEN max(l_quantity) - min(l_quantity) END AS noise_db, median(l_quantity) AS median_db, count(l_quantity) AS repeats FROM lineitem GROUP BY l_suppkey, l_linenumber""")
def repeat_noise(spark: SparkSession, sf: str) -> DataFrame:
    return K.repeat_noise(table(spark, sf, "lineitem"), "l_suppkey", "l_linenumber", "l_quantity")


@query("""SELECT l_partkey, min(CASE WHEN l_tax >= 0.07 THEN l_quantity END) AS crossing FROM lineitem GROUP BY l_partkey""")
def grid_crossing(spark: SparkSession, sf: str) -> DataFrame:
    return K.grid_crossing(table(spark, sf, "lineitem"), "l_partkey", "l_quantity", "l_tax", 0.07)


@query("""SELECT user_id, event_id, value, before FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE value <= before""")
def unordered_grid(spark: SparkSession, sf: str) -> DataFrame:
    return K.unordered_grid(table(spark, sf, "events").select("user_id", "event_id", "value"), "user_id", "event_id", "value")


@query(f"""WITH {_SAMPLES} SELECT a.vec_id, round(10 * log10(greatest(sum((a.x - b.x) * (a.x - b.x)) / sum(a.x * a.x), 1e-30)), 6) AS error_db, round(max(abs(a.x - b.x)), 6) AS largest, arg_max(a.i, (abs(a.x - b.x), -a.i)) AS place FROM s a JOIN s b ON b.vec_id = a.vec_id + 1 AND a.i = b.i GROUP BY a.vec_id""")
def repeat_difference(spark: SparkSession, sf: str) -> DataFrame:
    s = _samples(spark, sf)
    return K.repeat_difference(s, _next(s), "vec_id", "i", "x").select("vec_id", _r("error_db"), _r("largest"), "place")


@query("""WITH p AS (SELECT DISTINCT l_suppkey AS s, l_quantity AS q FROM lineitem) SELECT a.s AS l_suppkey, a.q AS root, count(DISTINCT k) AS multiples FROM p a CROSS JOIN (SELECT unnest(range(2, 6)) AS k) g JOIN p b ON a.s = b.s AND abs(b.q - g.k * a.q) <= 0.25 GROUP BY ALL""")
def harmonic_support(spark: SparkSession, sf: str) -> DataFrame:
    return K.harmonic_support(table(spark, sf, "lineitem"), "l_suppkey", "l_quantity", 5, 0.25)


@query("""WITH b AS (SELECT l_partkey AS k, min(l_discount) AS was FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL), a AS (SELECT l_partkey AS k, avg(l_discount) AS now FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL)
SELECT k AS l_partkey, was, round(now, 6) AS now FROM a JOIN b USING (k) WHERE now > was + 0.0005""")
def regressions(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "lineitem")
    b = e.filter("l_returnflag = 'R'").groupBy("l_partkey").agg(F.min("l_discount").alias("v"))
    a = e.filter("l_returnflag = 'A'").groupBy("l_partkey").agg(V.steady_mean(F.col("l_discount")).alias("v"))
    return K.regressions(b, a, ["l_partkey"], "v").select("l_partkey", "was", _r("now"))


@query("""WITH d AS (SELECT p_size, min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part GROUP BY p_size)
SELECT p_size, k AS sample, round(lo + CAST('0x' || substr(md5('7:' || CAST(p_size AS VARCHAR) || ':' || CAST(k AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE * (hi - lo), 6) AS value FROM d CROSS JOIN (SELECT unnest(range(0, 16)) AS k)""")
def random_settings(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "part").groupBy("p_size").agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"))
    return K.random_settings(d, "p_size", "lo", "hi", 16, 7).select("p_size", F.col("sample").cast("bigint").alias("sample"), _r("value"))


@query(f"""WITH {_SAMPLES} SELECT vec_id, k AS coefficient, round(sum(x * cos(pi() / 64 * k * (i + 0.5))) * sqrt(2 / 64), 6) AS value FROM s CROSS JOIN (SELECT unnest(range(1, 5)) AS k) GROUP BY vec_id, k""")
def cepstral_coefficients(spark: SparkSession, sf: str) -> DataFrame:
    return K.cepstra(_samples(spark, sf), "vec_id", "i", "x", 64, 4).select("vec_id", F.col("coefficient").cast("bigint").alias("coefficient"), _r("value"))


@query("""WITH f AS (SELECT label, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c FROM embeddings)
SELECT label, round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b, round(avg(c), 6) AS mean_c, round(stddev_pop(a), 6) AS deviation_a, round(stddev_pop(b), 6) AS deviation_b, round(stddev_pop(c), 6) AS deviation_c,
round(covar_samp(a, b), 6) AS cov_a_b, round(covar_samp(a, c), 6) AS cov_a_c, round(covar_samp(b, c), 6) AS cov_b_c FROM f GROUP BY label""")
def feature_covariances(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "embeddings").select("label", *(F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate("abc")))
    c = K.covariances(f, "label", list("abc"))
    return c.select("label", *(_r(x) for x in c.columns if x != "label"))


@query(f"""WITH {_SAMPLES}, c AS (SELECT a.vec_id, b.i - a.i AS lag, sum(a.x * b.x) AS v FROM s a JOIN s b ON b.vec_id = a.vec_id + 1 AND b.i - a.i BETWEEN -4 AND 4 GROUP BY ALL), e AS (SELECT vec_id, sum(x * x) AS e FROM s GROUP BY vec_id),
t AS (SELECT vec_id, arg_max(lag, (abs(v), -abs(lag), lag)) AS lag, arg_max(v, (abs(v), -abs(lag), lag)) AS v FROM c GROUP BY vec_id)
SELECT t.vec_id, lag, round(v / sqrt(a.e * b.e), 6) AS r, coalesce(abs(v / sqrt(a.e * b.e)) >= 0.3, false) AS trusted FROM t JOIN e a ON a.vec_id = t.vec_id JOIN e b ON b.vec_id = t.vec_id + 1""")
def clip_alignment(spark: SparkSession, sf: str) -> DataFrame:
    s = _samples(spark, sf)
    return K.alignment(s, _next(s), "vec_id", "i", "x", 4).select("vec_id", F.col("lag").cast("bigint").alias("lag"), _r("r"), "trusted")


@query(f"""WITH {_SAMPLES} SELECT vec_id, i, round(x - median(x) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING), 6) AS above FROM s""")
def detrended_curves(spark: SparkSession, sf: str) -> DataFrame:
    return K.detrended(_samples(spark, sf), "vec_id", "i", "x", 4).select("vec_id", "i", _r("above"))
