"""Queries of parameter values, specs and the control space."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import timing
from ..functions import values as V
from ..operators import parameters as P
from ..operators import space as S
from ..sources import presets
from .tables import line_order, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""SELECT l_orderkey, l_partkey, arg_max(l_quantity, ({", ".join(line_order())})) AS value FROM lineitem GROUP BY l_orderkey, l_partkey""")
def overlay_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    return P.last_wins(table(spark, sf, "lineitem"), ["l_orderkey", "l_partkey"], line_order(), "l_quantity").withColumnRenamed("l_quantity", "value")


@query("""SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def duplicate_parameters(spark: SparkSession, sf: str) -> DataFrame:
    return P.duplicated(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)""")
def spec_join_missing(spark: SparkSession, sf: str) -> DataFrame:
    known = table(spark, sf, "part").filter("p_size > 5").select(F.col("p_partkey").alias("l_partkey"))
    return P.missing(table(spark, sf, "lineitem"), known, ["l_partkey"]).select("l_orderkey", "l_partkey").distinct()


#: Kinds, units and ranges of controls, by what a part is.
_KIND = "CASE p_size % 5 WHEN 0 THEN 'switch' WHEN 1 THEN 'enum' WHEN 2 THEN 'rotation' WHEN 3 THEN 'fraction' ELSE 'metered' END"


def _specs(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select(
        F.col("p_partkey").alias("path"), F.expr(_KIND).alias("kind"), F.expr("CASE WHEN p_size % 5 = 4 THEN 'ms' END").alias("unit"), F.lit(0.0).alias("low"), F.col("p_size").cast("double").alias("high"),
        F.expr("p_size % 7 != 0").alias("writable"), F.expr("p_size % 11 = 0").alias("needs_review"), F.lit("text").alias("encoding"),
    )


@query(f"""WITH e AS (SELECT l_orderkey, l_linenumber, l_partkey AS path, l_quantity AS x, {_KIND} AS kind, p_size AS high, p_size FROM lineitem JOIN part ON l_partkey = p_partkey),
s AS (SELECT *, CASE kind WHEN 'switch' THEN CASE WHEN x = 1 THEN 'true' WHEN x = 0 THEN 'false' END WHEN 'enum' THEN CAST(CAST(x AS BIGINT) AS VARCHAR)
  WHEN 'rotation' THEN rtrim(rtrim(printf('%.10f', x / 100), '0'), '.') WHEN 'fraction' THEN CASE WHEN x BETWEEN 0 AND 1 THEN CAST(CAST(x AS BIGINT) AS VARCHAR) END ELSE CAST(CAST(x AS BIGINT) AS VARCHAR) END AS v FROM e)
SELECT l_orderkey, l_linenumber, path, error, CASE WHEN error IS NULL THEN v END AS stored, CASE WHEN p_size % 11 = 0 THEN 'guessed kind' ELSE '' END AS warnings
FROM (SELECT *, CASE WHEN p_size % 7 = 0 THEN 'read-only' WHEN v IS NULL THEN 'no value of this kind' WHEN TRY_CAST(v AS DOUBLE) > high THEN 'outside the range' END AS error FROM s)""")
def validate_spec(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("path"), F.col("l_quantity").cast("bigint").cast("string").alias("value"))
    out = P.validate(e, _specs(spark, sf))
    return out.select("l_orderkey", "l_linenumber", "path", "error", "stored", F.array_join("warnings", ",").alias("warnings"))


@query(f"""WITH e AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q, {_KIND} AS kind FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT l_orderkey, l_linenumber, kind, CASE kind WHEN 'switch' THEN CASE q WHEN 1 THEN 'true' END WHEN 'rotation' THEN CAST(q AS VARCHAR) WHEN 'fraction' THEN CASE q WHEN 1 THEN '1' END ELSE CAST(q AS VARCHAR) END AS human,
CASE kind WHEN 'switch' THEN CASE q WHEN 1 THEN 'on' END WHEN 'rotation' THEN CAST(q AS VARCHAR) || '%' WHEN 'fraction' THEN CASE q WHEN 1 THEN '1' END WHEN 'metered' THEN CAST(q AS VARCHAR) || ' ms' ELSE CAST(q AS VARCHAR) END AS label FROM e""")
def translate_kinds(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "lineitem").join(_specs(spark, sf), F.col("l_partkey") == F.col("path"))
    stored = V.to_stored(F.col("kind"), F.col("l_quantity").cast("bigint").cast("string"))
    e = e.withColumn("stored", stored)
    known = F.col("stored").isNotNull()
    return e.select("l_orderkey", "l_linenumber", "kind", F.when(known, V.from_stored(F.col("kind"), F.col("stored"))).alias("human"), F.when(known, V.described(F.col("kind"), F.col("stored"), F.col("unit"))).alias("label"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, round(greatest(least(round_even(l_quantity / 2.5, 0) * 2.5, 40.0), 3.0), 6) AS quantised, round(least(greatest((l_discount - 0.01) / 0.07, 0.0), 1.0), 9) AS unit,
round(0.01 + least(greatest(l_tax / 0.08, 0.0), 1.0) * 0.07, 9) AS decoded, CAST(round_even(least(greatest(l_tax / 0.08, 0.0), 1.0) * 4, 0) AS INTEGER) AS member FROM lineitem""")
def quantise_encode_decode(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("l_tax") / 0.08
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", V.quantised(F.col("l_quantity"), F.lit(2.5), F.lit(3.0), F.lit(40.0)).alias("quantised"), F.round(V.to_unit(F.col("l_discount"), F.lit(0.01), F.lit(0.08)), 9).alias("unit"),
        F.round(V.from_unit(u, F.lit(0.01), F.lit(0.08)), 9).alias("decoded"), V.member_index(u, F.lit(5)).alias("member"),
    )


@query("""WITH p AS (SELECT l_orderkey, l_partkey, max(l_quantity) AS hi, min(l_quantity) AS lo FROM lineitem GROUP BY ALL), a AS (SELECT l_orderkey, l_partkey, hi AS before FROM p WHERE hi > 10), b AS (SELECT l_orderkey, l_partkey, lo AS after FROM p WHERE lo < 40)
SELECT coalesce(a.l_orderkey, b.l_orderkey) AS l_orderkey, coalesce(a.l_partkey, b.l_partkey) AS l_partkey, before, after FROM a FULL JOIN b ON a.l_orderkey = b.l_orderkey AND a.l_partkey = b.l_partkey WHERE before IS NULL OR after IS NULL OR abs(before - after) > 0.005""")
def preset_diff_tolerant(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.max("l_quantity").alias("hi"), F.min("l_quantity").alias("lo"))
    a, b = p.filter("hi > 10").withColumnRenamed("hi", "v"), p.filter("lo < 40").withColumnRenamed("lo", "v")
    return P.differences(a, b, ["l_orderkey", "l_partkey"], "v", 0.005)


@query("""WITH f AS (SELECT l_partkey, l_returnflag || l_linestatus AS v, min((l_orderkey, l_linenumber, l_suppkey)) AS first FROM lineitem GROUP BY ALL)
SELECT l_partkey, string_agg(v, ',' ORDER BY first, v) AS observed, (SELECT count(DISTINCT l_orderkey) FROM lineitem x WHERE x.l_partkey = f.l_partkey) AS files FROM f GROUP BY l_partkey""")
def observed_catalog(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "lineitem").withColumn("v", F.concat("l_returnflag", "l_linestatus"))
    out = P.observed(e, ["l_partkey"], "v", ["l_orderkey", "l_linenumber", "l_suppkey"], "l_orderkey")
    return out.select("l_partkey", F.array_join("observed", ",").alias("observed"), "files")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag AS value, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 END AS member FROM lineitem""")
def enum_resolution(spark: SparkSession, sf: str) -> DataFrame:
    members = spark.createDataFrame([("flag", 0, " a "), ("flag", 1, "N")], "path string, member int, label string")
    e = table(spark, sf, "lineitem").select(F.lit("flag").alias("path"), "l_orderkey", "l_linenumber", "l_partkey", F.col("l_returnflag").alias("value"))
    return P.resolve_members(e, F.broadcast(members)).drop("path")


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN replace('{amp}Amp', '{amp}', p_brand) ELSE '{amp}Amp' END AS module, CASE WHEN p_size % 2 = 1 THEN 'no amp for a templated module' END AS error FROM part""")
def amp_templates(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").withColumn("module", F.lit("{amp}Amp"))
    return P.expand_prefix(p, F.expr("CASE WHEN p_size % 2 = 0 THEN p_brand END")).select("p_partkey", "module", "error")


@query("""WITH p AS (SELECT p_brand AS module, p_name || '/' || CAST(p_partkey AS VARCHAR) AS key, p_size % 3 = 0 AS sw, left(p_name, 3) AS stem FROM part), k AS (SELECT DISTINCT module, CASE WHEN sw THEN stem || 'Active' ELSE key END AS key, sw FROM p),
s AS (SELECT module, key AS gate, left(key, length(key) - 6) AS stem FROM k WHERE sw)
SELECT k.module, k.key, max(gate) AS gate FROM k JOIN s ON k.module = s.module WHERE NOT k.sw AND starts_with(k.key, s.stem) GROUP BY k.module, k.key""")
def prefix_gates(spark: SparkSession, sf: str) -> DataFrame:
    sw = F.expr("p_size % 3 = 0")
    key = F.when(sw, F.concat(F.expr("left(p_name, 3)"), F.lit("Active"))).otherwise(F.concat("p_name", F.lit("/"), F.col("p_partkey").cast("string")))
    p = table(spark, sf, "part").select(F.col("p_brand").alias("module"), key.alias("key"), F.when(sw, "switch").otherwise("metered").alias("kind")).distinct()
    return S.gates(p)


_LINKS = "links AS (SELECT 'c' || c_custkey AS child, 'n' || c_nationkey AS parent FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"


def _links(spark: SparkSession, sf: str) -> DataFrame:
    to = lambda t, a, b, x, y: table(spark, sf, t).select(F.concat(F.lit(a), F.col(x).cast("string")).alias("child"), F.concat(F.lit(b), F.col(y).cast("string")).alias("parent"))
    return to("customer", "c", "n", "c_custkey", "c_nationkey").unionByName(to("supplier", "s", "n", "s_suppkey", "s_nationkey")).unionByName(to("nation", "n", "r", "n_nationkey", "n_regionkey"))


@query(f"""WITH RECURSIVE {_LINKS}, up AS (SELECT child AS node, parent AS ancestor, 1 AS steps FROM links UNION ALL SELECT node, parent, steps + 1 FROM up JOIN links ON ancestor = child) SELECT node, ancestor, steps FROM up""")
def gate_chain(spark: SparkSession, sf: str) -> DataFrame:
    return S.ancestors(_links(spark, sf), "child", "parent")


@query(f"""WITH RECURSIVE {_LINKS}, up AS (SELECT child AS node, parent AS ancestor FROM links UNION ALL SELECT node, parent FROM up JOIN links ON ancestor = child)
SELECT 'c' || c_custkey AS path FROM customer WHERE 'c' || c_custkey NOT IN (SELECT node FROM up WHERE ancestor IN (SELECT 'n' || n_nationkey FROM nation WHERE n_nationkey % 4 = 0 UNION SELECT 'r' || r_regionkey FROM region WHERE r_regionkey = 2))""")
def active_dimensions(spark: SparkSession, sf: str) -> DataFrame:
    dims = table(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("path"))
    off = table(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("path"), F.expr("if(n_nationkey % 4 = 0, 'off', 'on')").alias("value"))
    off = off.unionByName(table(spark, sf, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("path"), F.expr("if(r_regionkey = 2, '0', '1')").alias("value")))
    return S.active(dims, S.ancestors(_links(spark, sf), "child", "parent"), off)


@query("""WITH a AS (SELECT DISTINCT o_orderpriority AS g, o_orderstatus AS s FROM orders), b AS (SELECT DISTINCT o_orderpriority AS g, CAST(o_custkey % 3 AS VARCHAR) AS m FROM orders)
SELECT a.g AS priority, 'mod=' || m || ',status=' || s AS topology FROM a JOIN b ON a.g = b.g""")
def topology_product(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    options = o.select(F.col("o_orderpriority").alias("priority"), F.lit("status").alias("dim"), F.col("o_orderstatus").alias("choice"))
    options = options.unionByName(o.select(F.col("o_orderpriority").alias("priority"), F.lit("mod").alias("dim"), F.expr("string(o_custkey % 3)").alias("choice"))).distinct()
    return S.topologies(options, "priority", "dim", "choice").select("priority", F.array_join("topology", ",").alias("topology"))


@query("""SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'F') THEN false WHEN bool_or(o_orderstatus = 'P') THEN NULL ELSE true END AS active FROM orders GROUP BY o_custkey""")
def eq_gate_state(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "orders").select("o_custkey", F.expr("CASE o_orderstatus WHEN 'F' THEN false WHEN 'O' THEN true END").alias("on"))
    return S.eq_state(g, "o_custkey", "on")


@query("""SELECT l_orderkey, string_agg(CAST(CAST(round(least(greatest(q / 50, 0), 1) * 1000) AS BIGINT) AS VARCHAR), ',' ORDER BY p) AS vector FROM (SELECT l_orderkey, l_partkey AS p, max(l_quantity) AS q FROM lineitem GROUP BY ALL) GROUP BY l_orderkey""")
def unit_vectors(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.max("l_quantity").alias("q")).withColumns({"lo": F.lit(0.0), "hi": F.lit(50.0)})
    v = S.unit_vectors(e, "l_orderkey", "l_partkey", "q", "lo", "hi")
    return v.select("l_orderkey", F.array_join(F.transform("vector", lambda u: F.round(u * 1000).cast("bigint").cast("string")), ",").alias("vector"))


@query("""SELECT o_orderkey, round(60000.0 / bpm, 6) AS quarter_ms, round(60000.0 / bpm * CASE o_orderkey % 6 WHEN 0 THEN 0.75 WHEN 1 THEN 1.0 / 3 WHEN 2 THEN 1 WHEN 3 THEN 0.375 WHEN 4 THEN 2.0 / 3 END, 6) AS note_ms FROM (SELECT o_orderkey, 40 + o_custkey % 160 AS bpm FROM orders)""")
def note_lengths(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array(*map(F.lit, ("1/8 dotted", "8thT", " Quarter  note ", "dotted 1/16", "quarters triplet", "dotted 1/8 triplet")))
    o = table(spark, sf, "orders").select("o_orderkey", (F.lit(40) + F.col("o_custkey") % 160).cast("double").alias("bpm"), F.element_at(names, (F.col("o_orderkey") % 6 + 1).cast("int")).alias("note"))
    return o.select("o_orderkey", F.round(timing.quarter_ms(F.col("bpm")), 6).alias("quarter_ms"), F.round(timing.note_ms(F.col("bpm"), F.col("note")), 6).alias("note_ms"))


_DIVISIONS = ", ".join(f"('{n}', {x!r})" for n, x in timing.divisions().items())


@query(f"""WITH o AS (SELECT o_orderkey, o_totalprice / 1000 AS ms, 40.0 + o_custkey % 160 AS bpm FROM orders), d AS (SELECT * FROM (VALUES {_DIVISIONS}) t(name, q)),
x AS (SELECT o_orderkey, name, abs(ms - q * 60000.0 / bpm) / (q * 60000.0 / bpm) AS gap FROM o, d) SELECT o.o_orderkey, (SELECT arg_min(name, (gap, name)) FROM x WHERE x.o_orderkey = o.o_orderkey AND gap <= 0.05) AS division FROM o""")
def nearest_divisions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", timing.nearest_division(F.col("o_totalprice") / 1000, (F.lit(40.0) + F.col("o_custkey") % 160)).alias("division"))


@query("""SELECT o_orderkey, sha256(o_orderstatus || chr(31) || CAST(o_custkey AS VARCHAR) || chr(31) || o_orderpriority) AS content_key FROM orders""")
def content_keys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", V.content_key(F.col("o_orderstatus"), F.col("o_custkey"), F.col("o_orderpriority")).alias("content_key"))


@query("""SELECT o_orderkey, 'a=' || printf('%.6f', o_totalprice) || ';b=' || o_orderstatus AS canonical FROM orders""")
def canonical_settings(spark: SparkSession, sf: str) -> DataFrame:
    m = F.create_map(F.lit("b"), F.col("o_orderstatus"), F.lit("a"), F.col("o_totalprice").cast("string"))
    return table(spark, sf, "orders").select("o_orderkey", V.canonical_settings(m).alias("canonical"))


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 1200.5 WHEN 1 THEN 2500 WHEN 2 THEN NULL WHEN 3 THEN 0 END AS shown, CASE o_orderkey % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false ELSE NULL END AS switch FROM orders""")
def shown_numbers(spark: SparkSession, sf: str) -> DataFrame:
    at = (F.col("o_orderkey") % 5 + 1).cast("int")
    shown, switch = F.array(*map(F.lit, ("1,200.5 Hz", "2.5 kHz", "30 L", "C", "inf"))), F.array(*map(F.lit, (" On", "0", "YES", "false", "maybe")))
    return table(spark, sf, "orders").select("o_orderkey", V.shown_number(F.element_at(shown, at), F.lit("hz")).alias("shown"), V.as_switch(F.element_at(switch, at)).alias("switch"))


@query("""SELECT e.event_id, e.event_type AS stored, l.event_id AS key_index FROM (SELECT *, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS p, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS pt FROM events) e JOIN events l ON l.event_id = e.p WHERE e.event_type = 'click' AND pt != 'click'""")
def key_value_lead(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window as W

    w = W.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf, "events").select("event_id", "event_type", F.lead("event_type").over(w).alias("stored"), F.lead("event_id").over(w).alias("value_id"))
    return e.filter("event_type != 'click' and stored = 'click'").select(F.col("value_id").alias("event_id"), "stored", F.col("event_id").alias("key_index"))


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN CAST(event_id AS VARCHAR) END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS module FROM events""")
def module_forward_fill(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window as W

    w = W.partitionBy("user_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    return table(spark, sf, "events").select("event_id", F.last(F.when(F.col("event_type") == "signup", F.col("event_id").cast("string")), ignorenulls=True).over(w).alias("module"))


@query("""SELECT item_id, sha256(text) AS sha, (length(text) + 49) // 50 AS parts FROM benchmark""")
def codec_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Texts as presets of short values: encoded, tokenised, put together again and read back as parameters."""
    part = F.expr("transform(sequence(0, (char_length(text) + 49) div 50 - 1), k -> substring(text, k * 50 + 1, 50))")
    value = lambda v: F.concat(F.unhex(F.concat(F.lit("01"), F.lpad(F.hex((F.octet_length(v) + 2).cast("bigint")), 2, "0"), F.lit("05"))), F.encode(v, "UTF-8"), F.unhex(F.lit("00")))
    key = F.concat(F.encode(F.lit("key"), "UTF-8"), F.unhex(F.lit("00")))
    made = table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("preset_id"), F.aggregate(F.transform(part, lambda v: F.concat(key, value(v))), F.expr("cast('' as binary)"), lambda s, x: F.concat(s, x)).alias("content"))
    again = presets.assemble(presets.tokens(made))
    p = presets.structure(presets.tokens(again))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "stored"))), lambda s: s["stored"]), "")
    return p.groupBy("preset_id").agg(F.sha2(text, 256).alias("sha"), F.count("*").alias("parts")).select(F.col("preset_id").cast("bigint").alias("item_id"), "sha", "parts")


@query("""SELECT id, layer, name FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY layer, id) AS r FROM (SELECT s_suppkey AS id, 0 AS layer, 'n' || s_nationkey AS name FROM supplier UNION ALL SELECT c_custkey, 1, 'n' || c_nationkey FROM customer)) WHERE r = 1""")
def union_dedupe_stable(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("name"))
    b = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("name"))
    return S.stable_dedupe(P.ordered_union(a, b), "name", ["layer", "id"]).select("id", "layer", "name")


@query("""SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'""")
def dropped_values(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "lineitem")
    return P.dropped(e.filter("l_returnflag = 'A'"), e.filter("l_returnflag = 'R'"), ["l_orderkey"])


@query("""SELECT l_partkey FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_returnflag) = (SELECT count(DISTINCT l_returnflag) FROM lineitem)""")
def shared_by_all(spark: SparkSession, sf: str) -> DataFrame:
    return P.shared_keys(table(spark, sf, "lineitem"), "l_returnflag", "l_partkey")
