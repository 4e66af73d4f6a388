"""Queries of trials, distances, benchmark statistics and signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.levels import butterworth_db
from ..operators import compare as C
from ..operators import inversion as I  # noqa: E741, N812
from ..operators import signals as G
from ..operators import statistics as M
from ..operators import trials as T
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


_SHAPE = "sqrt(list_avg(list_transform(d, lambda x: (x - m) * (x - m))))"


@query(f"""WITH p AS (SELECT t.vec_id AS target, e.vec_id AS entry, list_transform(list_zip(t.embedding, e.embedding), lambda x: x[1]::DOUBLE - x[2]::DOUBLE) AS d FROM embeddings t JOIN embeddings e ON t.label = e.label AND t.vec_id % 50 = 0 AND e.vec_id != t.vec_id),
s AS (SELECT *, list_avg(d) AS m FROM p), k AS (SELECT target, entry, {_SHAPE} AS distance FROM s)
SELECT target, entry, rank, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY distance, entry) AS rank FROM k) WHERE rank <= 5""")
def nearest_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The five nearest entries of the same topology for each query: every fiftieth row against all rows."""
    e = table(spark, sf, "embeddings")
    targets = e.filter("vec_id % 50 = 0").select("label", F.col("vec_id").alias("target"), F.col("embedding").alias("t"))
    entries = e.select("label", F.col("vec_id").alias("entry"), F.col("embedding").alias("e"))
    out = C.nearest_shapes(targets, entries, "label", "target", "entry", "t", "e", 5)
    return out.select("target", "entry", "rank", _r("distance"))


@query("""WITH p AS (SELECT a.vec_id, unnest(range(1, 65)) AS band, unnest(a.embedding)::DOUBLE - unnest(b.embedding)::DOUBLE AS d FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, band, round(d - avg(d) OVER (PARTITION BY vec_id), 6) AS delta FROM p""")
def band_delta_demeaned(spark: SparkSession, sf: str) -> DataFrame:
    long = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("p", "x")).select("vec_id", (F.col("p") + 1).cast("bigint").alias("band"), F.col("x").cast("double").alias("db"))
    return C.band_differences(long, long.withColumn("vec_id", F.col("vec_id") - 1), ["vec_id"], "band", "db").select("vec_id", "band", _r("delta"))


_W = C.PROFILES["unpaired-v1"]["weights"]
_PARTS = {"timbre": ("l_quantity / 50", "l_returnflag != 'N'"), "dynamics": ("l_discount * 10", "l_linestatus != 'O'"), "level": ("l_tax * 10", "l_tax > 0.02"), "complexity": ("l_tax", "true")}
_TOP = " + ".join(f"CASE WHEN {ok} THEN {_W[n]} * ({x}) ELSE 0 END" for n, (x, ok) in _PARTS.items() if _W[n])
_BOTTOM = " + ".join(f"CASE WHEN {ok} THEN {_W[n]} ELSE 0 END" for n, (x, ok) in _PARTS.items() if _W[n])


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN {_BOTTOM} > 0 THEN ({_TOP}) / ({_BOTTOM}) END, 6) AS scalar FROM lineitem""")
def weighted_scalar(spark: SparkSession, sf: str) -> DataFrame:
    values = {n: F.expr(f"CASE WHEN {ok} THEN {x} END") for n, (x, ok) in _PARTS.items()}
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(C.weighted(values, _W), 6).alias("scalar"))


@query(f"""WITH {TRIALS} SELECT run, count(*) AS trials, count(*) FILTER (error OR silent) AS failures, count(*) FILTER (error) AS errors, count(*) FILTER (silent) AS silent, round(sum(score), 1) AS wall_ms, round(count(*) FILTER (error OR silent) / count(*), 6) AS failure_rate FROM trials GROUP BY run""")
def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    return T.run_summary(trials(spark, sf), "run", F.expr("error or silent"), F.col("error"), F.col("silent"), "score")


@query(f"""WITH {TRIALS} SELECT run, arg_min(trial, (score, trial)) AS best_trial, min(score) AS best_score FROM trials WHERE NOT error AND NOT silent GROUP BY run""")
def best_trial_per_run(spark: SparkSession, sf: str) -> DataFrame:
    return T.best_trial(trials(spark, sf).filter("not error and not silent"), "run", "score", "trial")


@query(f"""WITH {TRIALS} SELECT run, k, trial, score FROM (SELECT *, row_number() OVER (PARTITION BY run, k ORDER BY trial DESC) AS n FROM trials WHERE NOT error AND NOT silent) WHERE n = 1""")
def latest_success(spark: SparkSession, sf: str) -> DataFrame:
    t = trials(spark, sf).withColumn("key", F.struct("run", "k"))
    return T.latest_success(t, "key", F.expr("not error and not silent"), "trial").select("run", "k", "trial", "score")


@query(f"""WITH {TRIALS} SELECT run, trial, min(CASE WHEN NOT error THEN score END) OVER (PARTITION BY run ORDER BY trial ROWS UNBOUNDED PRECEDING) AS best_so_far FROM trials""")
def convergence_best(spark: SparkSession, sf: str) -> DataFrame:
    t = trials(spark, sf).withColumn("ok_score", F.when(~F.col("error"), F.col("score")))
    return T.convergence(t, "run", "trial", "ok_score").select("run", "trial", "best_so_far")


@query("""SELECT doc_id AS trial_id, quality AS choice, source AS run, n_chars FROM labels JOIN documents USING (doc_id)""")
def verdict_join(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    return T.verdicts_with_trials(table(spark, sf, "labels"), d, "doc_id").select(F.col("doc_id").alias("trial_id"), F.col("quality").alias("choice"), F.col("source").alias("run"), "n_chars")


@query("""SELECT l_orderkey, count(*) AS rows FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus != 'P') GROUP BY l_orderkey""")
def foreign_key_orphans(spark: SparkSession, sf: str) -> DataFrame:
    parents = table(spark, sf, "orders").filter("o_orderstatus != 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return T.orphans(table(spark, sf, "lineitem"), parents, "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("rows"))


@query("""SELECT doc_id, min(quality) AS quality FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en') AND doc_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY doc_id""")
def appendable_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    old = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("doc_id"))
    return T.appendable(table(spark, sf, "labels"), table(spark, sf, "documents").filter("lang = 'en'"), "doc_id", old, ["doc_id"]).select("doc_id", "quality")


_RANGES = """r AS (SELECT label, f.i AS feature, min(f.x) AS low, max(f.x) AS high FROM (SELECT label, unnest([{'i': 'f1', 'x': embedding[1]::DOUBLE}, {'i': 'f2', 'x': embedding[2]::DOUBLE}, {'i': 'f3', 'x': embedding[3]::DOUBLE}]) AS f FROM embeddings) GROUP BY ALL)"""
_FEATURES = ["f1", "f2", "f3"]


def _features(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", "label", *(F.col("embedding")[k].cast("double").alias(f) for k, f in enumerate(_FEATURES)))


@query(f"""WITH {_RANGES} SELECT label, feature, low, high FROM r""")
def achievable_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return C.feature_ranges(_features(spark, sf), "label", _FEATURES)


@query(f"""WITH {_RANGES}, t AS (SELECT vec_id, label, unnest([{{'i': 'f1', 'x': embedding[1]::DOUBLE}}, {{'i': 'f2', 'x': embedding[2]::DOUBLE}}, {{'i': 'f3', 'x': embedding[3]::DOUBLE}}]) AS f FROM embeddings)
SELECT vec_id, r.feature, f.x AS x FROM t JOIN r ON (t.label + 1) % 10 = r.label AND t.f.i = r.feature WHERE f.x < low OR f.x > high""")
def outside_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """All rows against the ranges of the next topology."""
    f = _features(spark, sf)
    ranges = C.feature_ranges(f, "label", _FEATURES)
    return C.outside_ranges(f.withColumn("label", (F.col("label") + 1) % 10), ranges, "label", "vec_id", _FEATURES).select("vec_id", "feature", "x")


@query("""SELECT o_custkey, o_orderkey FROM orders a WHERE NOT EXISTS (SELECT 1 FROM orders b WHERE a.o_custkey = b.o_custkey AND b.o_totalprice <= a.o_totalprice AND b.o_orderdate <= a.o_orderdate AND (b.o_totalprice < a.o_totalprice OR b.o_orderdate < a.o_orderdate))""")
def pareto_front(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").withColumn("day", F.unix_micros(F.col("o_orderdate").cast("timestamp")))
    return C.front_of_two(o, ["o_custkey"], "day", "o_totalprice").select("o_custkey", "o_orderkey")


@query("""WITH c AS (SELECT o_custkey AS g, o_orderkey AS k, CASE WHEN o_orderstatus != 'P' THEN o_totalprice END AS x, CASE WHEN o_orderpriority < '4' THEN -o_totalprice % 1000 END AS y FROM orders)
SELECT g AS o_custkey, k AS o_orderkey FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE a.g = b.g AND a.k != b.k AND ((a.x IS NOT NULL AND b.x IS NOT NULL) OR (a.y IS NOT NULL AND b.y IS NOT NULL)) AND NOT coalesce(b.x > a.x + 1e-9, false) AND NOT coalesce(b.y > a.y + 1e-9, false) AND (coalesce(b.x < a.x - 1e-9, false) OR coalesce(b.y < a.y - 1e-9, false)))""")
def pareto_with_gaps(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.expr("CASE WHEN o_orderstatus != 'P' THEN o_totalprice END AS x"), F.expr("CASE WHEN o_orderpriority < '4' THEN -o_totalprice % 1000 END AS y"))
    return C.undominated(o, "o_custkey", "o_orderkey", ["x", "y"]).select("o_custkey", "o_orderkey")


_ARMS = f"{TRIALS}, o AS (SELECT kind AS arm, run AS target, avg(score) AS objective, bool_or(k % 10 = 0) AND count(*) < 2 AS failed, avg(k) AS mae, sum(score) AS wall FROM trials GROUP BY kind, run)"


def _outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return trials(spark, sf).groupBy(F.col("kind").alias("arm"), F.col("run").alias("target")).agg(F.avg("score").alias("objective"), F.expr("bool_or(k % 10 = 0) and count(*) < 2").alias("failed"), F.avg("k").alias("mae"), F.sum("score").alias("wall"))


@query(f"""WITH {_ARMS} SELECT arm, count(*) AS targets, count(*) FILTER (failed) AS failures, round(avg(objective) FILTER (NOT failed), 6) AS mean_objective, round(median(objective) FILTER (NOT failed), 6) AS median_objective, round(avg(mae) FILTER (NOT failed), 6) AS mean_mae,
round(sum(wall), 2) AS wall_ms, round(count(*) FILTER (failed) / count(*), 6) AS failure_rate FROM o GROUP BY arm""")
def arm_summary(spark: SparkSession, sf: str) -> DataFrame:
    return M.arm_summary(_outcomes(spark, sf), "arm", F.col("failed"), F.col("objective"), F.col("mae"), F.col("wall"))


@query(f"""WITH {_ARMS} SELECT a.target, a.arm, b.arm AS other, round(a.objective, 6) AS a, round(b.objective, 6) AS b FROM o a JOIN o b ON a.target = b.target AND a.arm < b.arm AND NOT a.failed AND NOT b.failed""")
def paired_arms(spark: SparkSession, sf: str) -> DataFrame:
    return M.paired(_outcomes(spark, sf), "arm", "target", "objective", F.col("failed")).select("target", "arm", "other", _r("a"), _r("b"))


@query(f"""WITH {_ARMS}, p AS (SELECT a.arm, b.arm AS other, avg(a.objective) AS mine, avg(b.objective) AS theirs, count(*) AS shared FROM o a JOIN o b ON a.target = b.target AND a.arm != b.arm AND NOT a.failed AND NOT b.failed GROUP BY ALL), s AS (SELECT arm, count(*) AS n, count(*) FILTER (failed) / count(*) AS rate FROM o GROUP BY arm)
SELECT p.arm, bool_and(mine < theirs AND shared >= 0.7 * n AND rate <= 0.1) AS ships FROM p JOIN s ON p.arm = s.arm GROUP BY p.arm""")
def ship_gate(spark: SparkSession, sf: str) -> DataFrame:
    o = _outcomes(spark, sf)
    summary = M.arm_summary(o, "arm", F.col("failed"), F.col("objective"), F.col("mae"), F.col("wall"))
    return M.ship_gate(M.paired(o, "arm", "target", "objective", F.col("failed")), summary, "arm")


@query("""SELECT l_suppkey, round(avg(CASE WHEN l_linestatus = 'O' THEN abs(l_discount * 10 - l_tax * 10) / (p_size / 50.0) END), 6) AS mae, round(avg(CASE WHEN l_linestatus != 'O' THEN CAST(round(l_quantity) % 3 = p_size % 3 AS INTEGER) END), 6) AS selector_accuracy FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey""")
def parameter_errors(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    cont = F.col("l_linestatus") == "O"
    truth, guess = F.when(cont, F.col("l_discount") * 10).otherwise(F.col("l_quantity") % 3), F.when(cont, F.col("l_tax") * 10).otherwise(F.col("p_size") % 3)
    return M.parameter_error(e, "l_suppkey", cont, truth, guess, F.lit(0.0), F.col("p_size") / 50.0).select("l_suppkey", _r("mae"), _r("selector_accuracy"))


@query("""SELECT l_orderkey, round(sqrt(avg((l_discount - 0.05) * (l_discount - 0.05))), 6) AS prior_deviation, round(avg(CAST(abs(l_discount - 0.05) > 0.02001 AS INTEGER)), 6) AS complexity FROM lineitem GROUP BY l_orderkey""")
def prior_deviation(spark: SparkSession, sf: str) -> DataFrame:
    out = M.prior_deviation(table(spark, sf, "lineitem"), "l_orderkey", F.lit(0.05), F.col("l_discount"), 0.02001)
    return out.select("l_orderkey", _r("prior_deviation"), _r("complexity"))


_MOVES = f"{TRIALS}, m AS (SELECT run AS path, CASE WHEN count(s) >= 2 THEN max(s) - min(s) WHEN count(s) = 1 THEN abs(max(s) - 50) END AS movement FROM (SELECT run, CASE WHEN NOT error AND k < 20 THEN score END AS s FROM trials) GROUP BY run)"


def _moves(spark: SparkSession, sf: str) -> DataFrame:
    t = trials(spark, sf).select(F.col("run").alias("path"), F.expr("CASE WHEN NOT error AND k < 20 THEN score END AS s"))
    return M.movement(t, "path", "s", F.lit(50.0))


@query(f"""WITH {_MOVES} SELECT path, round(movement, 6) AS movement FROM m""")
def screen_movement(spark: SparkSession, sf: str) -> DataFrame:
    return _moves(spark, sf).select("path", _r("movement"))


@query(f"""WITH {_MOVES} SELECT path, round(movement, 6) AS movement, rank FROM (SELECT *, row_number() OVER (ORDER BY movement, path) AS rank, count(*) OVER () AS n FROM m WHERE movement > 1) WHERE rank > floor(n * 0.25)""")
def screen_select(spark: SparkSession, sf: str) -> DataFrame:
    return M.screened(_moves(spark, sf), 1.0).select("path", _r("movement"), "rank")


_LEVELS = f"{TRIALS}, l AS (SELECT run, k % 3 AS level, avg(score) AS mean, max(score) - min(score) AS spread, count(score) AS n FROM trials GROUP BY ALL)"


def _levels(spark: SparkSession, sf: str) -> DataFrame:
    return M.replicates(trials(spark, sf).withColumn("level", F.col("k") % 3), "run", "level", "score")


@query(f"""WITH {_LEVELS} SELECT run, level, round(mean, 6) AS mean, round(spread, 6) AS spread, n FROM l""")
def replicate_levels(spark: SparkSession, sf: str) -> DataFrame:
    return _levels(spark, sf).select("run", "level", _r("mean"), _r("spread"), "n")


_SIGMA = "CASE n " + " ".join(f"WHEN {n} THEN {x}" for n, x in M.RANGE_TO_SIGMA.items()) + " END"
_WORST = f"{_LEVELS}, w AS (SELECT run, mean AS worst, level, spread / ({_SIGMA}) / sqrt(n) AS error FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY mean DESC, level DESC) AS r FROM l) WHERE r = 1)"


@query(f"""WITH {_WORST} SELECT run, round(worst, 6) AS worst, level, round(error, 6) AS error FROM w""")
def worst_level(spark: SparkSession, sf: str) -> DataFrame:
    return M.worst_level(_levels(spark, sf), "run", "level").select("run", _r("worst"), "level", _r("error"))


@query(f"""WITH {_WORST}, x AS (SELECT *, run % 10 AS g, row_number() OVER (PARTITION BY run % 10 ORDER BY worst, run) AS r, lead(worst) OVER (PARTITION BY run % 10 ORDER BY worst, run) AS nx, lead(error) OVER (PARTITION BY run % 10 ORDER BY worst, run) AS ne FROM w)
SELECT g, run, round(nx - worst, 6) AS gap, round(2 * sqrt(error * error + ne * ne), 6) AS resolution, coalesce(nx - worst <= 2 * sqrt(error * error + ne * ne), true) AS tied FROM x WHERE r = 1 AND nx IS NOT NULL""")
def indistinguishable(spark: SparkSession, sf: str) -> DataFrame:
    w = M.worst_level(_levels(spark, sf), "run", "level").withColumn("g", F.col("run") % 10)
    return M.indistinguishable(w, "g", "run").select("g", "run", _r("gap"), _r("resolution"), "tied")


@query("""SELECT l_suppkey, round(quantile_cont(l_extendedprice, 0.1), 6) AS p10, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.9), 6) AS p90 FROM lineitem GROUP BY l_suppkey""")
def percentiles(spark: SparkSession, sf: str) -> DataFrame:
    p = F.percentile("l_extendedprice", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(p.alias("p")).select("l_suppkey", *(F.round(F.col("p")[k], 6).alias(n) for k, n in enumerate(("p10", "p50", "p90"))))


@query("""SELECT l_suppkey, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(corr(l_extendedprice, l_quantity), 6) AS correlation FROM lineitem GROUP BY l_suppkey""")
def slope_and_correlation(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"), F.round(F.corr("l_extendedprice", "l_quantity"), 6).alias("correlation"))


@query("""WITH m AS (SELECT user_id, median(value) AS med FROM events GROUP BY user_id) SELECT user_id, round(med, 6) AS median, round(median(abs(value - med)), 6) AS mad FROM events JOIN m USING (user_id) GROUP BY user_id, med""")
def median_deviation(spark: SparkSession, sf: str) -> DataFrame:
    return M.median_deviation(table(spark, sf, "events"), "user_id", "value").select("user_id", _r("median"), _r("mad"))


@query("""SELECT count(*) AS n, round(sum(l_quantity), 2) AS s_l_quantity, round(sum(l_discount), 4) AS s_l_discount, round(sum(l_tax), 4) AS s_l_tax, round(sum(l_quantity * l_quantity), 2) AS x_l_quantity_l_quantity, round(sum(l_quantity * l_discount), 4) AS x_l_quantity_l_discount,
round(sum(l_discount * l_discount), 4) AS x_l_discount_l_discount, round(sum(l_quantity * l_tax), 4) AS y_l_quantity_l_tax, round(sum(l_discount * l_tax), 4) AS y_l_discount_l_tax FROM lineitem""")
def gram_sums(spark: SparkSession, sf: str) -> DataFrame:
    g = M.gram(table(spark, sf, "lineitem"), ["l_quantity", "l_discount"], ["l_tax"])
    two = {"s_l_quantity", "x_l_quantity_l_quantity"}
    return g.select("n", *(F.round(c, 2 if c in two else 4).alias(c) for c in g.columns if c != "n"))


@query("""WITH f AS (SELECT DISTINCT l_suppkey FROM lineitem), x AS (SELECT l_suppkey AS s, l_orderkey % 5 AS fold, l_quantity AS x, l_extendedprice AS y FROM lineitem),
t AS (SELECT a.s, a.fold, regr_slope(b.y, b.x) / (1 + 0.01 / count(*)) AS w, avg(b.x) AS mx, avg(b.y) AS my FROM (SELECT DISTINCT s, fold FROM x) a JOIN x b ON a.s = b.s AND a.fold != b.fold GROUP BY a.s, a.fold),
e AS (SELECT x.s, sum((x.y - my - w * (x.x - mx)) ** 2) AS res FROM x JOIN t ON x.s = t.s AND x.fold = t.fold GROUP BY x.s), v AS (SELECT s, count(*) * var_pop(y) AS tss FROM x GROUP BY s)
SELECT e.s AS l_suppkey, round(1 - res / tss, 5) AS r2 FROM e JOIN v ON e.s = v.s""")
def cross_validated_r2(spark: SparkSession, sf: str) -> DataFrame:
    return M.fold_r2(table(spark, sf, "lineitem"), "l_suppkey", F.col("l_orderkey"), ["l_quantity"], "l_extendedprice", 5).select("l_suppkey", F.round("r2", 5).alias("r2"))


@query("""WITH f AS (SELECT vec_id AS clip, unnest(range(0, 7)) AS frame, embedding FROM embeddings), s AS (SELECT clip, frame, embedding[frame * 8 + 1 : frame * 8 + 16]::DOUBLE[] AS x FROM f),
l AS (SELECT clip, frame, 10 * log10(greatest(list_sum(list_transform(x, lambda v: v * v)) / 16, 1e-30)) AS level FROM s) SELECT clip, frame, round(level, 6) AS level, level > max(level) OVER (PARTITION BY clip) - 3 AS heard FROM l""")
def frame_levels(spark: SparkSession, sf: str) -> DataFrame:
    clips = table(spark, sf, "embeddings").select(F.col("vec_id").alias("clip"), F.col("embedding").alias("samples"))
    levels = G.frame_levels(G.frames(clips, 16, 8)).select("clip", F.col("frame").cast("bigint").alias("frame"), "level")
    heard = G.sounding(levels, gate_db=3.0).select("clip", "frame", F.lit(True).alias("heard"))
    return levels.join(heard, ["clip", "frame"], "left").select("clip", "frame", _r("level"), F.coalesce("heard", F.lit(False)).alias("heard"))


@query("""WITH x AS (SELECT user_id, event_id, sum(CAST(event_type = 'click' AS INTEGER)) OVER w AS held, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING))
SELECT user_id, arg_min(event_id, (-held, event_id)) AS start, CAST(max(held) AS BIGINT) AS held FROM x WHERE n = 10 GROUP BY user_id""")
def densest_window(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("hit", F.col("event_type") == "click")
    return G.densest_window(e, "user_id", "event_id", "hit", 10)


@query("""WITH x AS (SELECT user_id, event_id, event_type = 'click' AS c, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS a FROM events), y AS (SELECT *, a - row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM x WHERE c), z AS (SELECT user_id, i, count(*) AS rows, min(event_id) AS start FROM y GROUP BY ALL)
SELECT user_id, max(rows) AS rows, arg_min(start, (-rows, start)) AS start FROM z GROUP BY user_id""")
def longest_run(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("hit", F.col("event_type") == "click")
    return G.longest_run(e, "user_id", "event_id", "hit")


@query("""SELECT user_id, round(sum(greatest(value - p, 0)), 6) AS flux FROM (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) GROUP BY user_id""")
def flux_lag(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window as W

    p = F.lag("value").over(W.partitionBy("user_id").orderBy("event_id"))
    e = table(spark, sf, "events").select("user_id", F.greatest(F.col("value") - p, F.lit(0.0)).alias("grown"))
    return e.groupBy("user_id").agg(F.round(F.sum("grown"), 6).alias("flux"))


def _samples(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x")).select("vec_id", "i", F.col("x").cast("double").alias("x"))


_SAMPLES = "s AS (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)"


@query(f"""WITH {_SAMPLES}, e AS (SELECT vec_id, sum(x * x) AS energy FROM s GROUP BY vec_id) SELECT a.vec_id, b.i - a.i AS lag, round(sum(a.x * b.x) / any_value(energy), 6) AS r FROM s a JOIN s b ON a.vec_id = b.vec_id AND b.i - a.i BETWEEN 1 AND 8 JOIN e ON e.vec_id = a.vec_id GROUP BY ALL""")
def autocorrelation_lags(spark: SparkSession, sf: str) -> DataFrame:
    return G.autocorrelation(_samples(spark, sf), "vec_id", "i", "x", 8).select("vec_id", F.col("lag").cast("bigint").alias("lag"), _r("r"))


_TONES = f"{_SAMPLES}, p AS (SELECT vec_id, c, sum(x * cos(2 * pi() * c * i / 64)) ** 2 + sum(x * sin(2 * pi() * c * i / 64)) ** 2 AS p FROM s, (SELECT unnest([2.0, 4.0, 6.0, 8.0])::DOUBLE AS c) GROUP BY ALL)"


@query(f"""WITH {_TONES} SELECT vec_id, c AS cycles, round(p * 4 / 4096, 9) AS power FROM p""")
def goertzel_bins(spark: SparkSession, sf: str) -> DataFrame:
    return G.goertzel(_samples(spark, sf), "vec_id", "i", "x", [2.0, 4.0, 6.0, 8.0], F.lit(64)).select("vec_id", "cycles", _r("power", 9))


@query(f"""WITH {_TONES} SELECT vec_id, round(100 * sqrt(sum(p) FILTER (c > 2) / sum(p) FILTER (c = 2)), 4) AS thd_percent FROM p GROUP BY vec_id""")
def harmonic_distortion(spark: SparkSession, sf: str) -> DataFrame:
    p = G.goertzel(_samples(spark, sf), "vec_id", "i", "x", [2.0, 4.0, 6.0, 8.0], F.lit(64))
    return G.distortion(p, "vec_id", 2.0).select("vec_id", _r("thd_percent", 4))


@query(f"""WITH {_SAMPLES} SELECT a.vec_id, round(10 * log10(greatest(avg((a.x - b.x) ** 2) / avg(a.x ** 2), 1e-30)), 6) AS residual_db FROM s a JOIN s b ON b.vec_id = a.vec_id + 1 AND a.i = b.i GROUP BY a.vec_id""")
def residuals(spark: SparkSession, sf: str) -> DataFrame:
    s = _samples(spark, sf)
    return G.residual_db(s, s.withColumn("vec_id", F.col("vec_id") - 1), "vec_id", "i", "x").select("vec_id", _r("residual_db"))


@query(f"""WITH {_SAMPLES} SELECT a.vec_id, round(sum((a.x - b.x) ** 2 / 4) / (sum((a.x + b.x) ** 2 / 4) + sum((a.x - b.x) ** 2 / 4)), 6) AS width, round(corr(a.x, b.x), 6) AS correlation FROM s a JOIN s b ON b.vec_id = a.vec_id + 1 AND a.i = b.i GROUP BY a.vec_id""")
def stereo_image(spark: SparkSession, sf: str) -> DataFrame:
    s = _samples(spark, sf)
    both = s.withColumnRenamed("x", "l").join(s.select((F.col("vec_id") - 1).alias("vec_id"), "i", F.col("x").alias("r")), ["vec_id", "i"])
    return G.stereo(both, "vec_id", "l", "r").select("vec_id", _r("width"), _r("correlation"))


_HP, _LP = [20.0, 80.0, 160.0], [4000.0, 8000.0, 16000.0]


@query(f"""WITH {_SAMPLES}, b AS (SELECT vec_id, 50 * pow(2, i / 8.0) AS hz, x FROM s), g AS (SELECT vec_id, hp, lp, x - 10 * log10(pow(hz / hp, 4) / (1 + pow(hz / hp, 4))) - 10 * log10(pow(lp / hz, 4) / (1 + pow(lp / hz, 4))) AS d FROM b, (SELECT unnest({_HP})::DOUBLE AS hp), (SELECT unnest({_LP})::DOUBLE AS lp)),
f AS (SELECT vec_id, hp, lp, round(sqrt(greatest(avg(d * d) - avg(d) * avg(d), 0)), 9) AS rms FROM g GROUP BY ALL) SELECT vec_id, arg_min(hp, (rms, hp, lp)) AS hpf, arg_min(lp, (rms, hp, lp)) AS lpf, round(min(rms), 6) AS rms FROM f GROUP BY vec_id""")
def corner_grid(spark: SparkSession, sf: str) -> DataFrame:
    b = _samples(spark, sf).withColumn("hz", 50 * F.pow(F.lit(2.0), F.col("i") / 8.0))
    return I.best_corners(b, "vec_id", "hz", "x", _HP, _LP).select("vec_id", "hpf", "lpf", _r("rms"))


@query(f"""WITH {_SAMPLES} SELECT vec_id, hz, round(sum(x / (1 + pow(2.8 * log2(hz / (50 * pow(2, i / 8.0))), 2))), 6) AS db FROM s, (SELECT unnest([100.0, 1000.0, 5000.0])::DOUBLE AS hz) GROUP BY ALL""")
def predicted_bands(spark: SparkSession, sf: str) -> DataFrame:
    b = _samples(spark, sf).withColumn("centre", 50 * F.pow(F.lit(2.0), F.col("i") / 8.0))
    return I.predicted_bands(b, "vec_id", "centre", "x", [100.0, 1000.0, 5000.0]).select("vec_id", "hz", _r("db"))


@query()
def bounded_band_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Bounded band gains for every curve of 64 points."""
    hz = [50 * 2 ** (k / 8) for k in range(64)]
    curves = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("curve"))
    return I.fit_bands(curves, I.bell_basis(hz, [62.5, 125, 250, 500, 1000, 2000, 4000, 8000]), -12.0, 12.0).select("vec_id", "gains")


@query()
def fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Measured records of clips: each embedding repeated to a signal of 4,096 samples."""
    clips = table(spark, sf, "embeddings").select(F.col("vec_id").alias("clip"), F.flatten(F.array_repeat("embedding", 64)).alias("samples"))
    return G.fingerprints(clips, 48_000)


@query("""SELECT event_id, coalesce(k >= 15, false) AS delay_active, CASE WHEN k >= 15 THEN least(greatest(value, 1.0), 2000.0) END AS delay_ms, CASE WHEN k >= 30 AND value / 50 > 0.1 THEN least(value / 50, 10.0) END AS reverb_s, CASE WHEN k > 0 AND value / 100 > 0.05 THEN 5.0 END AS tremolo_hz FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)""")
def time_effect_settings(spark: SparkSession, sf: str) -> DataFrame:
    t = trials(spark, sf).withColumn("c", F.col("k") / 100.0)
    s = I.time_settings(F.col("score"), F.col("c"), F.lit(0.3), F.col("score") / 50, F.col("c"), F.lit(5.0), F.col("score") / 100, F.col("c"))
    return t.select(F.col("trial").alias("event_id"), *(s[n].alias(n) for n in ("delay_active", "delay_ms", "reverb_s", "tremolo_hz")))


@query("""SELECT vec_id, round(10 * log10(pow(hz / 100, 4) / (1 + pow(hz / 100, 4))), 6) AS highpass_db FROM (SELECT vec_id, 20.0 + vec_id % 1000 AS hz FROM embeddings)""")
def filter_response(spark: SparkSession, sf: str) -> DataFrame:
    hz = F.lit(20.0) + F.col("vec_id") % 1000
    return table(spark, sf, "embeddings").select("vec_id", F.round(butterworth_db(hz, F.lit(100.0), True), 6).alias("highpass_db"))


@query("""WITH b AS (SELECT vec_id, unnest(range(0, 64)) AS band, unnest(embedding)::DOUBLE AS x FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(x) DESC, band) AS n FROM b), k AS (SELECT * FROM r WHERE n <= 5)
SELECT vec_id, band, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY band) AS INTEGER) AS place FROM k""")
def worst_bands(spark: SparkSession, sf: str) -> DataFrame:
    """The five largest deltas of each curve, put back in the order of their bands."""
    from pyspark.sql import Window as W

    s = _samples(spark, sf).withColumn("n", F.row_number().over(W.partitionBy("vec_id").orderBy(F.desc(F.abs("x")), "i"))).filter("n <= 5")
    return s.select("vec_id", F.col("i").cast("bigint").alias("band"), F.row_number().over(W.partitionBy("vec_id").orderBy("i")).alias("place"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(json_extract_string(props, '$.k') AS DOUBLE) * value AS product, length(props) AS n FROM events""")
def nested_numbers(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return table(spark, sf, "events").select("event_id", k.try_cast("int").alias("k"), (k.try_cast("double") * F.col("value")).alias("product"), F.length("props").cast("bigint").alias("n"))
