"""Queries of the search space, specs for presets, fronts, warm starts and comparisons of measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import compare as C
from ..operators import parameters as P
from ..operators import space as S
from ..operators import warmstart as R
from .tables import TRIALS, table, trials

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_SPEC = "CASE p_size % 6 WHEN 0 THEN 'switch' WHEN 1 THEN 'enum' WHEN 2 THEN 'rotation' WHEN 3 THEN 'fraction' WHEN 4 THEN 'string' ELSE 'metered' END"
_REASON = """CASE WHEN p_partkey % 7 = 0 THEN 'read-only' WHEN p_partkey % 11 = 0 THEN 'not searchable' WHEN kind = 'string' THEN 'not a quantity' WHEN p_partkey % 13 = 0 THEN 'guessed kind'
WHEN kind = 'enum' AND p_partkey % 5 = 0 THEN 'members aren''t known' WHEN p_partkey % 17 = 0 THEN 'members aren''t confirmed' WHEN kind = 'metered' AND p_size > 40 THEN 'no range' END"""


def _specs(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").withColumn("kind", F.expr(_SPEC))
    return p.select(
        F.col("p_partkey").cast("string").alias("path"), F.col("p_brand").alias("module"), "kind", F.expr("CASE WHEN kind = 'metered' THEN CASE WHEN p_size < 20 THEN 'db' ELSE 'ms' END END").alias("unit"),
        F.lit(1.0).alias("low"), F.expr("CASE WHEN p_size <= 40 THEN double(p_size) END").alias("high"), F.expr("CASE WHEN kind = 'enum' AND p_partkey % 5 != 0 THEN 3 END").alias("members"),
        F.expr("p_partkey % 7 != 0").alias("writable"), F.expr("p_partkey % 11 != 0").alias("searchable"), F.expr("p_partkey % 13 = 0").alias("needs_review"), F.expr("p_partkey % 17 = 0").alias("needs_confirmation"),
    )


@query(f"""SELECT p_partkey, {_REASON} AS reason FROM (SELECT *, {_SPEC} AS kind FROM part)""")
def excluded_dimensions(spark: SparkSession, sf: str) -> DataFrame:
    return S.exclusions(_specs(spark, sf)).select(F.col("path").cast("long").alias("p_partkey"), "reason")


_MEMBER = "CASE p_size % 4 WHEN 0 THEN '0' WHEN 1 THEN 'B  c' WHEN 2 THEN 'D' ELSE 'X' END"


def _conditions(spark: SparkSession, sf: str) -> DataFrame:
    specs = _specs(spark, sf).select("path", "kind").unionByName(spark.createDataFrame([("s1", "enum")], "path string, kind string"))
    members = spark.createDataFrame([("s1", 0, "A"), ("s1", 1, "b C"), ("s1", 2, "D")], "path string, member int, label string")
    rules = table(spark, sf, "part").filter("p_partkey % 3 = 0").select(F.expr("CASE WHEN p_partkey % 27 = 0 THEN 'none' ELSE string(p_partkey) END AS path"), F.expr("CASE WHEN p_partkey % 15 = 0 THEN 's2' ELSE 's1' END AS selector"), F.expr(f"{_MEMBER} AS member"))
    return S.conditions(rules.filter("path != 'none'"), specs, members)


_CONDITIONS = f"""c AS (SELECT CAST(p_partkey AS VARCHAR) AS path, CASE WHEN p_partkey % 15 = 0 THEN 's2' ELSE 's1' END AS selector, CASE WHEN p_partkey % 15 = 0 THEN CASE p_size % 4 WHEN 0 THEN '0' WHEN 1 THEN 'b c' WHEN 2 THEN 'd' ELSE 'x' END
ELSE CASE p_size % 4 WHEN 0 THEN '0|a' WHEN 1 THEN '1|b c' WHEN 2 THEN '2|d' ELSE 'x' END END AS accepted, CASE WHEN p_partkey % 15 = 0 THEN 'not a selector' WHEN p_size % 4 = 3 THEN 'unknown member' END AS error FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 27 != 0)"""


@query(f"WITH {_CONDITIONS} SELECT path, selector, accepted, error FROM c")
def selector_conditions(spark: SparkSession, sf: str) -> DataFrame:
    return _conditions(spark, sf).withColumn("accepted", F.array_join("accepted", "|"))


@query("""SELECT p_partkey, CASE WHEN starts_with(p_brand, 'Brand#12') THEN 'Brand#12' WHEN starts_with(p_brand, 'Brand#1') THEN 'Brand#1' WHEN starts_with(p_brand, 'Brand#3') THEN 'Brand#3' END AS owner FROM part""")
def amp_owners(spark: SparkSession, sf: str) -> DataFrame:
    prefixes = spark.createDataFrame([("Brand#1",), ("Brand#12",), ("Brand#3",)], "prefix string")
    return S.owners(table(spark, sf, "part").withColumn("module", F.col("p_brand")), prefixes).select("p_partkey", "owner")


@query("""SELECT c_custkey, CASE WHEN c_nationkey % 4 = 0 THEN 'one' WHEN c_nationkey % 4 = 1 THEN 'two' WHEN c_nationkey % 4 = 2 THEN 'two' END AS prefix FROM customer""")
def amp_prefixes(spark: SparkSession, sf: str) -> DataFrame:
    by_member, by_name = F.create_map(F.lit("0"), F.lit("one")), F.create_map(F.lit("First"), F.lit("one"), F.lit("Second"), F.lit("two"))
    given = F.expr("CASE c_nationkey % 4 WHEN 0 THEN '0' WHEN 1 THEN 'Second' WHEN 2 THEN 'two' ELSE 'Third' END")
    return table(spark, sf, "customer").select("c_custkey", S.amp_prefix(given, by_member, by_name).alias("prefix"))


@query(f"""WITH {_CONDITIONS}, k AS (SELECT *, {_SPEC} AS kind FROM part), d AS (SELECT *, {_REASON} AS reason FROM k)
SELECT p_partkey, d.kind, CASE kind WHEN 'rotation' THEN 0 WHEN 'fraction' THEN 0 ELSE 1 END AS low, CASE kind WHEN 'rotation' THEN 100 WHEN 'fraction' THEN 1 ELSE CASE WHEN p_size <= 40 THEN p_size END END AS high,
CASE kind WHEN 'rotation' THEN 0.5 WHEN 'fraction' THEN 0.005 WHEN 'metered' THEN CASE WHEN p_size < 20 THEN 0.25 ELSE 1.0 END END AS step, CASE WHEN p_partkey % 4 = 0 THEN 'g' || p_size % 6 END AS gate, CASE WHEN starts_with(p_brand, 'Brand#1') THEN 'Brand#1' END AS owner, selector, accepted
FROM d LEFT JOIN (SELECT * FROM c WHERE error IS NULL) c ON c.path = CAST(p_partkey AS VARCHAR) WHERE reason IS NULL""")
def search_space(spark: SparkSession, sf: str) -> DataFrame:
    specs = _specs(spark, sf)
    gate = table(spark, sf, "part").filter("p_partkey % 4 = 0").select(F.col("p_partkey").cast("string").alias("path"), F.concat(F.lit("g"), F.col("p_size") % 6).alias("gate"))
    owner = S.owners(specs, spark.createDataFrame([("Brand#1",)], "prefix string")).select("path", "owner")
    conditions = _conditions(spark, sf).filter("error is null").drop("error")
    out = S.dimensions(specs, gate, owner, conditions)
    return out.select(F.col("path").cast("long").alias("p_partkey"), "kind", "low", "high", "step", "gate", "owner", "selector", F.array_join("accepted", "|").alias("accepted"))


_DIMS = "dims AS (SELECT DISTINCT p_brand || '/' || p_size AS path, p_size, p_brand, p_size * 100 + CAST(substr(p_brand, 7) AS INTEGER) AS place, CASE WHEN p_size % 2 = 0 THEN left(p_brand, 7) END AS owner, CASE WHEN p_size % 3 = 0 THEN 'switch' ELSE 'metered' END AS kind FROM part WHERE p_size < 12)"
_RUNS = "runs AS (SELECT s_suppkey AS run, CASE WHEN s_nationkey % 7 != 0 THEN 'Brand#' || s_nationkey % 5 END AS amp FROM supplier)"
_HEARD = f"""{_DIMS}, {_RUNS}, live AS (SELECT run, path, amp FROM runs JOIN dims ON owner IS NULL OR owner = amp WHERE NOT (p_size % 5 = 0 AND run % 6 != 0 AND run % 4 > 1) AND (run + p_size % 4) % 3 != 0 AND NOT (p_size % 4 = 0 AND run % 5 = 0))"""


def _dims(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").filter("p_size < 12").select("p_brand", "p_size").distinct()
    return p.select(
        F.concat("p_brand", F.lit("/"), "p_size").alias("path"), "p_size", F.expr("p_size * 100 + int(substr(p_brand, 7))").alias("place"), F.expr("CASE WHEN p_size % 2 = 0 THEN left(p_brand, 7) END AS owner"), F.expr("CASE WHEN p_size % 3 = 0 THEN 'switch' ELSE 'metered' END AS kind"),
        F.expr("CASE WHEN p_size % 5 = 0 THEN 'sel' END AS selector"), F.expr("CASE WHEN p_size % 5 = 0 THEN array('0', '1') END AS accepted"),
    )


def _settings(spark: SparkSession, sf: str) -> DataFrame:
    runs = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("run"), F.expr("CASE WHEN s_nationkey % 7 != 0 THEN concat('Brand#', s_nationkey % 5) END AS amp"))
    gates = F.expr("transform(sequence(0, 3), g -> struct(concat('g', g) AS path, CASE WHEN (run + g) % 3 = 0 THEN 'false' ELSE 'true' END AS value))")
    more = F.expr("array(struct('top' AS path, CASE WHEN run % 5 = 0 THEN '0' ELSE '1' END AS value), struct('sel' AS path, CASE WHEN run % 6 != 0 THEN string(run % 4) END AS value))")
    return runs.select("run", "amp", F.inline(F.concat(gates, more)))


def _live(spark: SparkSession, sf: str) -> DataFrame:
    dims = _dims(spark, sf)
    chain = dims.select(F.col("path").alias("node"), F.concat(F.lit("g"), F.col("p_size") % 4).alias("ancestor")).unionByName(dims.filter("p_size % 4 = 0").select(F.col("path").alias("node"), F.lit("top").alias("ancestor")))
    return S.heard(dims, chain, _settings(spark, sf).filter("value is not null"), "run", "amp")


@query(f"WITH {_HEARD} SELECT run, path FROM live")
def heard_controls(spark: SparkSession, sf: str) -> DataFrame:
    return _live(spark, sf)


_VALUES = "v AS (SELECT run, amp, path, place, kind, owner, CAST((run * p_size) % 10 AS VARCHAR) AS value FROM runs JOIN dims ON (run + p_size) % 4 = 0 WHERE (run * p_size) % 10 != 7)"


def _chosen(spark: SparkSession, sf: str) -> DataFrame:
    runs = _settings(spark, sf).select("run", "amp").distinct()
    sizes = F.expr("filter(sequence(1, 11), s -> (run + s) % 4 = 0 and (run * s) % 10 != 7)")
    rows = runs.withColumn("p_size", F.explode(sizes)).join(_dims(spark, sf).select("path", "p_size"), "p_size")
    values = rows.select("run", "amp", "path", ((F.col("run") * F.col("p_size")) % 10).cast("string").alias("value"))
    return values.unionByName(runs.filter("run % 2 = 0").select("run", "amp", F.lit("selectedAmp").alias("path"), F.col("amp").alias("value")))


@query(f"""WITH {_HEARD}, {_VALUES}, bad AS (SELECT DISTINCT run FROM v WHERE owner IS NOT NULL AND amp IS NULL), k AS (SELECT run, place, path, value FROM v WHERE (owner IS NULL OR owner = amp) AND (kind = 'switch' OR EXISTS (SELECT 1 FROM live l WHERE l.run = v.run AND l.path = v.path))
UNION ALL SELECT run, -1, 'selectedAmp', amp FROM runs WHERE run % 2 = 0 AND amp IS NOT NULL), t AS (SELECT run FROM v UNION SELECT run FROM runs WHERE run % 2 = 0)
SELECT t.run, CASE WHEN t.run NOT IN (SELECT run FROM bad) THEN coalesce((SELECT string_agg(path || '=' || value, ',' ORDER BY place, path) FROM k WHERE k.run = t.run), '') END AS parameters, CASE WHEN t.run IN (SELECT run FROM bad) THEN 'an amp''s controls without an amp' END AS error FROM t""")
def emitted_specs(spark: SparkSession, sf: str) -> DataFrame:
    dims = _dims(spark, sf).select("path", "place", "kind", "owner").unionByName(spark.createDataFrame([("selectedAmp", 0, "enum", None)], "path string, place int, kind string, owner string"))
    out = S.emitted(_chosen(spark, sf), dims, _live(spark, sf), "run", "amp")
    return out.select("run", F.array_join(F.transform("parameters", lambda p: F.concat(p["path"], F.lit("="), p["value"])), ",").alias("parameters"), "error")


@query(f"WITH {_HEARD}, {_VALUES} SELECT v.run, v.path, v.value FROM v JOIN live l ON v.run = l.run AND v.path = l.path WHERE v.path LIKE 'Brand#%/%' AND CAST(split_part(v.path, '/', 2) AS INTEGER) < 9")
def backend_settings(spark: SparkSession, sf: str) -> DataFrame:
    supported = _dims(spark, sf).filter("p_size < 9").select(F.concat(F.lit("/"), "path").alias("path"))
    return S.for_backend(_chosen(spark, sf).drop("amp"), _live(spark, sf), supported, "run")


@query("""SELECT DISTINCT p_brand AS module, 'section' || p_size AS key FROM part WHERE p_size % 3 = 0 AND p_size % 2 = 1""")
def idle_sections(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    parameters = p.select(F.col("p_brand").alias("module"), F.concat(F.lit("section"), "p_size").alias("key"), F.expr("CASE WHEN p_size % 3 = 0 THEN 'switch' ELSE 'enum' END AS kind")).distinct()
    return S.idle_sections(parameters, p.filter("p_size % 2 = 0").select(F.col("p_brand").alias("module"), F.lit("x").alias("key"), F.concat(F.lit("section"), "p_size").alias("gate")))


@query("""SELECT n_name AS path, 40 AS samples, 40 AS strata, true AS within FROM nation""")
def latin_hypercube_strata(spark: SparkSession, sf: str) -> DataFrame:
    dims = table(spark, sf, "nation").select(F.col("n_name").alias("path"), F.lit(0.0).alias("low"), (F.col("n_nationkey") + 1).cast("double").alias("high"), F.lit(None).cast("double").alias("step"))
    rows = S.latin_hypercube(dims, 40, 7).join(dims.select("path", "high"), "path")
    inside = F.expr("value >= stratum / 40D * high - 1e-9 and value <= (stratum + 1) / 40D * high + 1e-9")
    return rows.groupBy("path").agg(F.count("*").alias("samples"), F.count_distinct("stratum").alias("strata"), F.bool_and(inside).alias("within"))


_THIN = "CASE WHEN len(kept) < 3 AND len(list_filter(kept, lambda z: greatest(abs(z.x - r.x), abs(z.y - r.y)) < 0.05)) = 0 THEN list_append(kept, {'k': r.k, 'x': r.x, 'y': r.y}) ELSE kept END"


@query(f"""WITH RECURSIVE c AS (SELECT o_custkey AS g, o_orderkey AS k, o_totalprice / 500000 AS x, (o_orderkey * 7919 % 1000) / 1000.0 AS y FROM orders), o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY x, k) AS n FROM c),
w AS (SELECT g, n, [{{'k': k, 'x': x, 'y': y}}] AS kept FROM o WHERE n = 1 UNION ALL SELECT r.g, r.n, {_THIN} FROM w JOIN o r ON r.g = w.g AND r.n = w.n + 1), f AS (SELECT g, arg_max(kept, n) AS kept FROM w GROUP BY g)
SELECT g AS o_custkey, unnest(kept).k AS o_orderkey, unnest(range(1, len(kept) + 1)) AS place FROM f""")
def thinned_fronts(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", (F.col("o_totalprice") / 500000).alias("x"), F.expr("(o_orderkey * 7919 % 1000) / 1000D AS y"))
    return C.thinned(o, "o_custkey", "o_orderkey", "x", ["x", "y"], limit=3, distinct=0.05)


@query(f"""WITH {TRIALS}, w AS (SELECT kind, run, max(CASE WHEN NOT error THEN score END) AS worst FROM trials GROUP BY ALL) SELECT kind, run, round(worst, 6) AS worst, row_number() OVER (PARTITION BY kind ORDER BY worst NULLS LAST, run) AS place FROM w""")
def worst_level_shortlist(spark: SparkSession, sf: str) -> DataFrame:
    t = trials(spark, sf).withColumn("ok", F.expr("CASE WHEN NOT error THEN score END"))
    return C.by_worst_level(t, "kind", "run", "ok").withColumn("worst", F.round("worst", 6))


@query("""SELECT l_suppkey, round(avg(CASE WHEN abs(l_extendedprice - l_quantity) >= 1e-9 THEN least(1.0, 0.3 * abs(l_tax - l_discount) * 1000 / abs(l_extendedprice / 1000 - l_quantity)) END), 6) AS share FROM lineitem GROUP BY l_suppkey""")
def level_shares(spark: SparkSession, sf: str) -> DataFrame:
    share = C.level_share(0.3, F.col("l_discount") * 1000, F.col("l_tax") * 1000, F.col("l_quantity"), F.col("l_extendedprice") / 1000)
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.round(F.avg(share), 6).alias("share"))


@query("""SELECT vec_id, CAST(len(list_filter(embedding::DOUBLE[], lambda x: abs(x) > 0.1)) AS INTEGER) AS resolved FROM embeddings""")
def resolved_bands(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.size(F.filter("embedding", lambda x: C.resolved(x.cast("double"), F.lit(0.1)))).alias("resolved"))


@query("""SELECT vec_id, CASE WHEN vec_id % 5 / 2.0 < 1 THEN 'too short' WHEN list_max(embedding)::DOUBLE * 1000 < 250 AND vec_id % 3 = 0 THEN 'silent' WHEN label = 1 THEN 'no loudness' END AS reason FROM embeddings""")
def unmeasurable_references(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    bands = F.transform("embedding", lambda x: F.when((F.array_max("embedding").cast("double") * 1000 < 250) & (F.col("vec_id") % 3 == 0), -200.0).otherwise(x.cast("double")))
    return e.select("vec_id", C.unmeasurable(F.expr("vec_id % 5 / 2D"), bands, F.expr("CASE WHEN label != 1 THEN -20D END")).alias("reason"))


@query("""SELECT vec_id, round(embedding[label + 1]::DOUBLE, 6) AS level FROM embeddings""")
def band_levels(spark: SparkSession, sf: str) -> DataFrame:
    centres = F.expr("transform(sequence(0, 63), k -> double(k * 100))")
    return table(spark, sf, "embeddings").select("vec_id", F.round(C.band_at(centres, F.transform("embedding", lambda x: x.cast("double")), F.expr("label * 100 + 0.5D")), 6).alias("level"))


@query("""WITH p AS (SELECT l_suppkey % 40 AS preset, CASE WHEN l_suppkey % 40 % 3 = 0 THEN l_partkey ELSE l_partkey % 3 END AS k, CASE WHEN l_suppkey % 40 = 4 AND l_linenumber = 2 THEN 7 ELSE 8 END AS width FROM lineitem)
SELECT preset, CASE WHEN bool_or(width != 8) THEN 'payloads of unknown widths' ELSE 'few distinct keys' END AS reason FROM p GROUP BY preset HAVING bool_or(width != 8) OR (count(*) > 20 AND count(DISTINCT k) * 4 < count(*))""")
def unsupported_shapes(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "lineitem").select(F.expr("l_suppkey % 40 AS preset"), F.expr("CASE WHEN l_suppkey % 40 % 3 = 0 THEN l_partkey ELSE l_partkey % 3 END AS k"), F.expr("repeat('x', CASE WHEN l_suppkey % 40 = 4 AND l_linenumber = 2 THEN 7 ELSE 8 END) AS payload"))
    return P.unsupported_shapes(p, "preset", "k", "payload")


@query("""WITH k AS (SELECT user_id AS u, CASE event_type WHEN 'click' THEN 'ampGain' WHEN 'view' THEN 'delayMode' WHEN 'error' THEN 'micPosition' WHEN 'purchase' THEN 'IRPath' ELSE 'level' END AS key, CASE WHEN event_type = 'purchase' THEN 'a/b' WHEN event_type = 'view' THEN CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 4 AS VARCHAR)
WHEN event_type = 'error' THEN '0.25' ELSE CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) AS VARCHAR) END AS v FROM events), n AS (SELECT u, key, min(v) AS lo, bool_and(coalesce(try_cast(v AS DOUBLE) BETWEEN 0 AND 1, false)) AS one FROM k GROUP BY u, key)
SELECT u, key, CASE key WHEN 'ampGain' THEN 'metered' WHEN 'delayMode' THEN 'enum' WHEN 'micPosition' THEN 'fraction' WHEN 'IRPath' THEN 'path' ELSE CASE WHEN one THEN 'rotation' ELSE 'metered' END END AS kind, CASE key WHEN 'ampGain' THEN 'db' END AS unit, CASE key WHEN 'delayMode' THEN 'confirmation' WHEN 'IRPath' THEN NULL ELSE 'review' END AS needs FROM n""")
def infer_kinds(spark: SparkSession, sf: str) -> DataFrame:
    t = trials(spark, sf)
    key = F.expr("CASE kind WHEN 'click' THEN 'ampGain' WHEN 'view' THEN 'delayMode' WHEN 'error' THEN 'micPosition' WHEN 'purchase' THEN 'IRPath' ELSE 'level' END")
    value = F.expr("CASE kind WHEN 'purchase' THEN 'a/b' WHEN 'view' THEN string(k % 4) WHEN 'error' THEN '0.25' ELSE string(k) END")
    return P.infer_kinds(t.select(F.col("run").alias("u"), key.alias("key"), value.alias("v")), ["u", "key"], "key", "v")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS stored, CASE WHEN p_size IS NULL THEN 'unknown' WHEN p_size % 2 = 0 THEN 'enum' ELSE 'string' END AS kind, CASE WHEN p_size % 2 = 0 THEN CASE CAST(l_quantity AS BIGINT) WHEN 1 THEN 'one' WHEN 2 THEN 'two' END END AS member,
coalesce(CASE WHEN p_size % 2 = 0 THEN CASE CAST(l_quantity AS BIGINT) WHEN 1 THEN 'one' WHEN 2 THEN 'two' END END, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)) AS display, coalesce(p_size % 7 = 0, false) AS read_only, coalesce(p_size % 3 = 0, false) AS unconfirmed, p_type AS observed
FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size < 40) ON l_partkey = p_partkey""")
def shown_presets(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").filter("p_size < 40")
    specs = p.select(
        F.col("p_partkey").alias("path"), F.expr("CASE WHEN p_size % 2 = 0 THEN 'enum' ELSE 'string' END AS kind"), F.lit(None).cast("string").alias("unit"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.expr("p_size % 7 != 0").alias("writable"),
        F.lit(False).alias("needs_review"), F.expr("p_size % 3 = 0").alias("needs_confirmation"), F.expr("CASE WHEN p_size % 2 = 0 THEN map('1', 'one', '2', 'two') END AS members"),
    )
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("path"), F.col("l_quantity").cast("long").cast("string").alias("stored"))
    out = P.shown_presets(rows, specs, p.select(F.col("p_partkey").alias("path"), F.col("p_type").alias("observed")))
    return out.select("l_orderkey", "l_linenumber", F.col("path").alias("l_partkey"), "stored", "kind", "member", "display", "read_only", "unconfirmed", "observed")


@query("""WITH p AS (SELECT o_custkey AS preset, CAST(o_orderkey % 5 AS VARCHAR) AS k, min(CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 7 AS VARCHAR) ELSE 'x' END) AS stored FROM orders GROUP BY ALL)
SELECT preset, CASE k WHEN '4' THEN 'selectedAmp' ELSE k END AS path, stored AS value, CAST(NULL AS VARCHAR) AS error FROM p WHERE preset % 10 != 0 AND (k = '4' OR (k IN ('0', '1') AND stored != 'x')) UNION ALL SELECT DISTINCT preset, NULL, NULL, 'another pack''s preset' FROM p WHERE preset % 10 = 0""")
def seed_values(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("preset"), (F.col("o_orderkey") % 5).cast("string").alias("k")).agg(F.min(F.expr("CASE WHEN o_orderkey % 2 = 0 THEN string(o_orderkey % 7) ELSE 'x' END")).alias("stored"))
    rows = rows.withColumn("path", F.expr("CASE k WHEN '4' THEN 'selectedAmp' ELSE k END"))
    dims = spark.createDataFrame([("0", "metered"), ("1", "metered")], "path string, kind string")
    return P.seed_values(rows.drop("k"), dims, F.expr("CASE WHEN preset % 10 != 0 THEN 'ours' END"), "ours")


_FAULTS = """SELECT event_id, CASE WHEN event_id % 4 = 3 OR event_id % 4 = 1 THEN 0 END AS place, CASE WHEN event_id % 4 IN (1, 3) THEN 'delay' END AS module, CASE WHEN event_id % 4 = 1 THEN 'mix' END AS key, CASE WHEN event_id % 4 IN (1, 3) THEN CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) AS VARCHAR) END AS value,
CASE event_id % 4 WHEN 0 THEN 'no JSON object' WHEN 2 THEN 'parameters are no list' WHEN 3 THEN 'no key' END AS error FROM events"""


@query(_FAULTS)
def spec_entries(spark: SparkSession, sf: str) -> DataFrame:
    t = trials(spark, sf)
    text = F.expr("""CASE trial % 4 WHEN 0 THEN '{"parameters"' WHEN 1 THEN concat('{"parameters": [{"module": "delay", "key": "mix", "value": ', k, '}]}') WHEN 2 THEN '{"parameters": 5}' ELSE concat('{"parameters": [{"module": "delay", "value": ', k, '}]}') END""")
    return P.entry_faults(t.select(F.col("trial").alias("event_id"), text.alias("text")), "event_id", "text")


@query("""WITH e AS (SELECT l_quantity AS x, (l_extendedprice / 100000) AS y FROM lineitem), f AS (SELECT regr_slope(y, x) / (1 + 0.01 / count(*)) AS w, avg(x) AS mx, avg(y) AS my, min(x) AS lo, max(x) AS hi FROM e),
t AS (SELECT p_partkey, CASE WHEN p_size % 5 != 0 THEN p_size * 2.0 END AS q FROM part)
SELECT p_partkey, CASE WHEN q IS NULL THEN 0.0 ELSE 1.0 END AS feature_overlap, CASE WHEN q < lo OR q > hi THEN 1.0 ELSE 0.0 END AS clipped_fraction, CASE WHEN q IS NOT NULL THEN round(greatest(least(my + w * (greatest(least(q, hi), lo) - mx), 1), 0) * 10, 3) END AS setting FROM t, f""")
def warm_start_predictions(spark: SparkSession, sf: str) -> DataFrame:
    entries = table(spark, sf, "lineitem").select(F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 100000 * 10).alias("setting"))
    model = R.fit(entries, ["x"], [R.Control("setting", 0.0, 10.0)])
    target = table(spark, sf, "part").select("p_partkey", F.expr("CASE WHEN p_size % 5 != 0 THEN p_size * 2.0D END AS x"))
    return target.select("p_partkey", *((F.round(c, 3) if n == "setting" else c).alias(n) for n, c in R.predicted(model).items()))


@query("""SELECT o_orderkey, array_to_string(list_transform(range(0, 4), lambda i: ['a', 'b', 'c', 'd'][(i + o_orderkey) % 4 + 1]), '') AS turned, '&lt;' || replace(o_orderstatus || '&', '&', '&amp;') || '&quot;' AS safe, strftime(make_timestamp(CAST(o_orderkey AS BIGINT) * 86400000000), '%Y-%m-%dT%H:%M:%SZ') AS stamp, abs(o_totalprice - round(o_totalprice)) <= greatest(o_totalprice, 1) * 1e-9 AS same FROM orders""")
def text_helpers(spark: SparkSession, sf: str) -> DataFrame:
    letters = F.array(*map(F.lit, "abcd"))
    same = V.same_number(F.col("o_totalprice"), F.round("o_totalprice"))
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(V.rotated(letters, F.col("o_orderkey")), "").alias("turned"), V.html_safe(F.concat(F.lit("<"), "o_orderstatus", F.lit('&"'))).alias("safe"), V.iso_stamp(F.col("o_orderkey") * 86400).alias("stamp"), same.alias("same"))


_RECORD = """source.lufs_i source.channels spectrum.tilt_db_per_decade spectrum.centroid_hz.p50 spectrum.rolloff85_hz.p50 dynamics.crest_db dynamics.attack_ms dynamics.decay_db_per_s dynamics.lra_lu dynamics.rms_percentiles_db.p10 dynamics.rms_percentiles_db.p90 time_fx.rt60_s time_fx.rt60_confidence time_fx.delay_ms
time_fx.delay_confidence time_fx.delay_feedback_est modulation.am_rate_hz modulation.am_depth modulation.am_confidence spatial.width spatial.correlation harmonic.hnr_db harmonic.odd_even_ratio harmonic.hf_residual_index harmonic.confidence""".split()


def _records(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as measured records: numbers 25 on are its scalars, the first 12 its bands, 13 to 18 its cepstrum; small numbers are missing."""
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    leaf = {n: F.when(F.abs(F.col("e")[25 + k]) > 0.01, F.abs(F.col("e")[25 + k]) * (10 if n.endswith("channels") else 1)) for k, n in enumerate(_RECORD)}
    leaf["source.channels"] = leaf["source.channels"].cast("int")
    part = lambda head: [c.alias(n.split(".")[-1]) for n, c in leaf.items() if n.rsplit(".", 1)[0] == head]
    bands = [F.expr("transform(sequence(1, 12), k -> double(k + vec_id % 3))").alias("band_centres_hz"), F.slice("e", 1, 12).alias("band_db")]
    return e.select(
        "vec_id",
        F.struct(
            F.struct(*part("source")).alias("source"),
            F.struct(*bands, *part("spectrum"), F.struct(*part("spectrum.centroid_hz")).alias("centroid_hz"), F.struct(*part("spectrum.rolloff85_hz")).alias("rolloff85_hz")).alias("spectrum"),
            F.struct(*part("dynamics"), F.struct(*part("dynamics.rms_percentiles_db")).alias("rms_percentiles_db")).alias("dynamics"),
            *(F.struct(*part(h)).alias(h) for h in ("time_fx", "modulation", "spatial", "harmonic")),
            F.struct(F.slice("e", 13, 6).alias("mfcc_mean")).alias("cepstral"),
        ).alias("record"),
    )


def _term(n: str, scale: float) -> str:
    return f"abs(x.{n} - y.{n}) / {scale}"


def _mean(*terms: str) -> str:
    return f"list_avg([{', '.join(f'CAST({t} AS DOUBLE)' for t in terms)}])"


_NAMES = [n.replace(".", "_") for n in _RECORD]
_S = C.PROFILES["unpaired-v1"]["scales"]
_LEAVES = ", ".join(f"CASE WHEN abs(e[{26 + k}]) > 0.01 THEN {'CAST(floor(abs(e[%d]) * 10) AS INTEGER)' % (26 + k) if n.endswith('channels') else 'abs(e[%d])' % (26 + k)} END AS {n}" for k, n in enumerate(_NAMES))
_BOTH = lambda n: f"least(coalesce(x.{n}, 0), coalesce(y.{n}, 0))"
_HAS = "(coalesce(x.time_fx_delay_confidence, 0) >= 0.15)", "(coalesce(y.time_fx_delay_confidence, 0) >= 0.15)"


@query(f"""WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings), f AS (SELECT *, {_LEAVES} FROM e), p AS (SELECT x.id AS id, x.e AS a, y.e AS b, x.id % 3 AS sa, y.id % 3 AS sb, x, y FROM f x JOIN f y ON y.id = x.id + 1),
d AS (SELECT *, list_transform(list_filter(range(1, 13), lambda k: k + sa - sb BETWEEN 1 AND 12), lambda k: a[k] - b[k + sa - sb]) AS diff FROM p)
SELECT id AS vec_id,
round({_mean("list_stddev_pop(diff) / " + str(_S["band_db"]), _term("spectrum_tilt_db_per_decade", _S["tilt_db_per_decade"]), _term("spectrum_centroid_hz_p50", _S["centroid_hz"]), _term("spectrum_rolloff85_hz_p50", _S["rolloff85_hz"]), f"sqrt(list_sum(list_transform(range(14, 19), lambda k: (a[k] - b[k]) ** 2))) / {_S['mfcc']}")}, 6) AS timbre,
round({_mean(*(_term("dynamics_" + n, _S[n]) for n in ("crest_db", "attack_ms", "decay_db_per_s", "lra_lu")), f"abs(x.dynamics_rms_percentiles_db_p90 - coalesce(x.dynamics_rms_percentiles_db_p10, x.dynamics_rms_percentiles_db_p90) - y.dynamics_rms_percentiles_db_p90 + coalesce(y.dynamics_rms_percentiles_db_p10, y.dynamics_rms_percentiles_db_p90)) / {_S['rms_spread_db']}")}, 6) AS dynamics,
round({_mean(f"CASE WHEN {_BOTH('time_fx_rt60_confidence')} >= 0.3 THEN {_term('time_fx_rt60_s', _S['rt60_s'])} END", f"CASE WHEN {_HAS[0]} AND {_HAS[1]} THEN {_term('time_fx_delay_ms', _S['delay_ms'])} WHEN {_HAS[0]} != {_HAS[1]} THEN 1.0 END", f"CASE WHEN {_HAS[0]} AND {_HAS[1]} THEN {_term('time_fx_delay_feedback_est', _S['delay_feedback'])} END",
*(f"CASE WHEN {_BOTH('modulation_am_confidence')} > 0 THEN {_term('modulation_' + n, _S[n])} * {_BOTH('modulation_am_confidence')} END" for n in ("am_depth", "am_rate_hz")))}, 6) AS ambience,
round({_term("source_lufs_i", _S["lufs_i"])}, 6) AS level,
round({_mean(*(f"CASE WHEN {_BOTH('harmonic_confidence')} >= 0.4 THEN {_term('harmonic_' + n, _S[n])} * {_BOTH('harmonic_confidence')} END" for n in ("hnr_db", "odd_even_ratio", "hf_residual_index")))}, 6) AS harmonic,
round({_mean(*(f"CASE WHEN coalesce(x.source_channels, 1) >= 2 AND coalesce(y.source_channels, 1) >= 2 THEN {_term('spatial_' + n, _S[n])} END" for n in ("width", "correlation")))}, 6) AS spatial FROM d""")
def compare_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    r = _records(spark, sf)
    both = r.withColumnRenamed("record", "t").join(r.select((F.col("vec_id") - 1).alias("vec_id"), F.col("record").alias("c")), "vec_id")
    return both.select("vec_id", *(F.round(c, 6).alias(n) for n, c in C.objectives("t", "c", _S).items()))
