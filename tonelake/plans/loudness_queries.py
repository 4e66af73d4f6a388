"""Queries of loudness, notes, mid and side, and neutral states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calibration as K
from ..operators import loudness as G
from .tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""WITH b AS (SELECT user_id, abs(value) / 1e4 AS p, -0.691 + 10 * log10(nullif(abs(value), 0) / 1e4) AS l FROM events), k AS (SELECT * FROM b WHERE l >= -70),
g AS (SELECT user_id, -0.691 + 10 * log10(avg(p)) - 10 AS gate FROM k GROUP BY user_id) SELECT user_id, round(-0.691 + 10 * log10(avg(p)), 6) AS lufs FROM k JOIN g USING (user_id) WHERE l > gate GROUP BY user_id""")
def gated_loudness(spark: SparkSession, sf: str) -> DataFrame:
    blocks = table(spark, sf, "events").select("user_id", (F.abs("value") / 1e4).alias("power"))
    return G.gated_loudness(blocks, "user_id").withColumn("lufs", F.round("lufs", 6))


@query("""WITH k AS (SELECT l_partkey, CAST(l_quantity AS DOUBLE) - 75 AS l FROM lineitem WHERE l_quantity - 75 > -70), g AS (SELECT l_partkey, avg(l) - 20 AS gate FROM k GROUP BY l_partkey HAVING count(*) >= 3)
SELECT l_partkey, round(quantile_cont(l, 0.95) - quantile_cont(l, 0.1), 6) AS lra_lu FROM k JOIN g USING (l_partkey) WHERE l > gate GROUP BY l_partkey HAVING count(*) >= 3""")
def loudness_range(spark: SparkSession, sf: str) -> DataFrame:
    short = table(spark, sf, "lineitem").select("l_partkey", (F.col("l_quantity").cast("double") - 75).alias("lufs"))
    return G.loudness_range(short, "l_partkey").withColumn("lra_lu", F.round("lra_lu", 6))


_NOTES = """WITH e AS (SELECT user_id, event_id % 2 AS note, event_id AS i, abs(value) AS v FROM events WHERE value IS NOT NULL), t AS (SELECT user_id, note, max(v) AS crest, min(i) AS begin_i, count(*) AS n FROM e GROUP BY ALL),
a AS (SELECT e.user_id, e.note, min(i) AS peak_i FROM e JOIN t ON e.user_id = t.user_id AND e.note = t.note AND v = crest GROUP BY ALL), x AS (SELECT e.*, crest, peak_i, begin_i, i >= peak_i AND v > crest * 0.001 AS tail FROM e JOIN t ON e.user_id = t.user_id AND e.note = t.note JOIN a ON e.user_id = a.user_id AND e.note = a.note WHERE n >= 5 AND crest > 0),
y AS (SELECT *, sum(CAST(tail AS INTEGER)) OVER (PARTITION BY user_id, note ORDER BY i) AS k FROM x), s AS (SELECT user_id, note, CASE WHEN any_value(peak_i - begin_i) >= 2 THEN (min(i) FILTER (i <= peak_i AND v >= 0.9 * crest) - min(i) FILTER (i <= peak_i AND v >= 0.1 * crest)) * 1000.0 / 100 END AS rise_ms,
regr_slope(CASE WHEN tail THEN 20 * log10(v + 1e-12) END, k / 100.0) AS slope, count(*) FILTER (tail) AS n FROM y GROUP BY ALL), notes AS (SELECT user_id, note, rise_ms, CASE WHEN n >= 5 AND slope < 0 THEN slope END AS decay_db_per_s FROM s) """


@query(_NOTES + "SELECT user_id, note, rise_ms, round(decay_db_per_s, 5) AS decay_db_per_s FROM notes")
def note_shapes(spark: SparkSession, sf: str) -> DataFrame:
    return _notes(spark, sf).withColumn("decay_db_per_s", F.round("decay_db_per_s", 5))


@query(_NOTES + "SELECT user_id, median(rise_ms) AS attack_ms, round(median(decay_db_per_s), 5) AS decay_db_per_s FROM notes GROUP BY user_id")
def attack_and_decay(spark: SparkSession, sf: str) -> DataFrame:
    return G.attack_and_decay(_notes(spark, sf), "user_id").withColumn("decay_db_per_s", F.round("decay_db_per_s", 5))


def _notes(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").filter("value is not null").select("user_id", (F.col("event_id") % 2).alias("note"), F.col("event_id").alias("i"), F.abs("value").alias("v"))
    return G.note_shapes(e, 100.0, "user_id", "note", "i", "v")


@query("""WITH b AS (SELECT l_suppkey AS clip, l_linenumber AS band_hz, avg(CAST(l_quantity AS DOUBLE)) AS m, avg(CAST(l_discount AS DOUBLE) * 400) AS s FROM lineitem GROUP BY ALL)
SELECT clip, band_hz, round(pow(10, s / 10) / (pow(10, m / 10) + pow(10, s / 10)), 4) AS share FROM b""")
def side_by_band(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("clip"), F.col("l_linenumber").alias("band_hz"), F.col("l_quantity").cast("double").alias("m"), (F.col("l_discount").cast("double") * 400).alias("s"))
    mid, side = (lines.groupBy("clip", "band_hz").agg(F.avg(c).alias("db")) for c in ("m", "s"))
    return G.side_by_band(mid, side)


_NEUTRAL = """WITH n AS (SELECT s_suppkey AS path, s_nationkey, unnest(['amp', 'b0', 'b1', 'eq', 'hp', 'lp']) AS control FROM supplier), f AS (SELECT path, control, CASE control WHEN 'amp' THEN CAST(s_nationkey AS VARCHAR) WHEN 'b0' THEN '0.0' WHEN 'b1' THEN '0.0' WHEN 'eq' THEN 'true' WHEN 'hp' THEN '20.0' END AS value,
CASE WHEN control = 'lp' THEN 'no declared range' END AS fault FROM n WHERE control != 'lp' OR path % 2 = 0) """


@query(_NEUTRAL + "SELECT * FROM f")
def neutral_settings(spark: SparkSession, sf: str) -> DataFrame:
    return _neutral(spark, sf)


@query(_NEUTRAL + "SELECT path, sha256(string_agg(control || '=' || coalesce(value, ''), chr(10) ORDER BY control)) AS key FROM f GROUP BY path")
def topology_keys(spark: SparkSession, sf: str) -> DataFrame:
    return K.topology_keys(_neutral(spark, sf))


def _neutral(spark: SparkSession, sf: str) -> DataFrame:
    settings = F.create_map(F.lit("amp"), F.col("s_nationkey").cast("string"), F.lit("b0"), F.lit("5"))
    lists = {"switches": F.array(F.lit("eq")), "bands": F.array(F.lit("b0"), F.lit("b1")), "highpass": F.lit("hp"), "lowpass": F.when(F.col("s_suppkey") % 2 == 0, "lp")}
    paths = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("path"), settings.alias("settings"), *(v.alias(k) for k, v in lists.items()))
    ranges = table(spark, sf, "nation").filter("n_nationkey = 0").select(F.lit("hp").alias("control"), F.lit(20.0).alias("low"), F.lit(500.0).alias("high"))
    return K.neutral_settings(paths, ranges)


@query("""WITH s AS (SELECT s_suppkey AS audition, 4 + s_suppkey % 3 AS n, -20.0 - s_suppkey % 5 AS l, -6.0 + s_suppkey % 7 AS p, s_suppkey % 4 = 0 AS swapped FROM supplier WHERE s_suppkey % 11 != 0), t AS (SELECT *, -23.0 - greatest(0, p - 23 - l + 1, -6 - 23 + 25 + 1) AS target FROM s),
k AS (SELECT *, unnest(range(0, 6)) AS k FROM t) SELECT audition, k AS place, ['Reference', 'A', 'B', 'Reference', 'A', 'B'][k + 1] AS label, round((k * n + (k - CAST(k > 2 AS INTEGER)) * 2 + CAST(k > 2 AS INTEGER) * 5) / 10.0, 6) AS start_s, CASE WHEN swapped THEN 'B' ELSE 'A' END AS first_label, round(CAST(target AS DOUBLE), 6) AS target_lufs, 6 * n + 13 AS samples,
round((CASE WHEN k % 3 = 0 THEN 0.5 * pow(10, (target - l) / 20) WHEN (k % 3 = 1) != swapped THEN 0.25 * pow(10, (target + 25) / 20) ELSE 0.125 * pow(10, (target + 25) / 20) END), 6) AS heard FROM k""")
def audition_timeline(spark: SparkSession, sf: str) -> DataFrame:
    n, known = F.expr("4 + s_suppkey % 3"), F.expr("s_suppkey % 11 != 0")
    role = F.explode(F.array(*map(F.lit, ("reference", "first", "second"))))
    s = table(spark, sf, "supplier").select("s_suppkey", n.alias("n"), known.alias("known"), role.alias("role"))
    mine = F.col("role") == "reference"
    sources = s.select(
        F.col("s_suppkey").alias("audition"), "role", F.array_repeat(F.expr("CASE role WHEN 'reference' THEN 0.5D WHEN 'first' THEN 0.25D ELSE 0.125D END"), F.col("n").cast("int")).alias("samples"),
        F.when(F.col("known"), F.when(mine, F.expr("-20D - s_suppkey % 5")).otherwise(-25.0)).alias("lufs"), F.when(mine, F.expr("-6D + s_suppkey % 7")).otherwise(-6.0).alias("peak_db"),
    )
    out = G.auditions(sources, F.col("audition") % 4 == 0, 10, 0.2, 0.5).filter("fault is null")
    heard = F.round(F.get("montage", F.round(F.col("t.start_s") * 10).cast("int")), 6)
    lined = out.select("audition", F.posexplode("timeline").alias("place", "t"), "first_label", F.round("target_lufs", 6).alias("target_lufs"), F.size("montage").cast("long").alias("samples"), "montage")
    return lined.select("audition", F.col("place").cast("long").alias("place"), "t.label", "t.start_s", "first_label", "target_lufs", "samples", heard.alias("heard"))


@query("""WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, coalesce(abs(value), 0) AS x FROM events), m AS (SELECT *, x - avg(x) OVER (PARTITION BY user_id) AS y, count(*) OVER (PARTITION BY user_id) AS n FROM e),
v AS (SELECT user_id, sum(y * y) AS energy FROM m WHERE n >= 32 GROUP BY user_id), r AS (SELECT a.user_id, b.i - a.i AS lag, sum(a.y * b.y) AS c FROM m a JOIN m b ON a.user_id = b.user_id AND b.i - a.i BETWEEN 6 AND 29 GROUP BY ALL), t AS (SELECT user_id, max_by(lag, c / energy) AS lag, max(c / energy) AS r FROM r JOIN v USING (user_id) WHERE energy > 0 GROUP BY user_id)
SELECT user_id, CASE WHEN r >= 0.1 THEN round(60 * 20.0 / lag, 2) END AS bpm FROM v LEFT JOIN t USING (user_id)""")
def beats(spark: SparkSession, sf: str) -> DataFrame:
    strengths = F.transform(F.array_sort(F.collect_list(F.struct("event_id", F.coalesce(F.abs("value"), F.lit(0.0)).alias("x")))), lambda e: e["x"])
    e = table(spark, sf, "events").groupBy("user_id").agg(strengths.alias("flux")).filter(F.size("flux") >= 32)
    return e.select("user_id", G.tempo(F.col("flux"), 20.0).alias("bpm"))


@query("""SELECT l_suppkey, round(var_samp(CAST(l_quantity AS DOUBLE)) + var_samp(CAST(l_discount AS DOUBLE) * 100) + var_samp(CAST(l_tax AS DOUBLE) * 100), 4) AS variance, 3 AS axes FROM lineitem GROUP BY l_suppkey HAVING count(*) > 1""")
def principal_variance(spark: SparkSession, sf: str) -> DataFrame:
    """The axes' variances add up to the features' own."""
    x = table(spark, sf, "lineitem").select("l_suppkey", F.col("l_quantity").cast("double").alias("q"), (F.col("l_discount").cast("double") * 100).alias("d"), (F.col("l_tax").cast("double") * 100).alias("t"))
    axes = K.principal_axes(x, "l_suppkey", ["q", "d", "t"])
    return axes.groupBy("l_suppkey").agg(F.round(F.sum("variance"), 4).alias("variance"), F.count("*").cast("int").alias("axes"))
