"""Audits of what a backend kept or moved, against catalogs and between states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import values as V
from ..session import cut

#: How far a published control has to move to count, and numbers may differ and be the same.
MOVED, SAME = 1e-9, 1e-9
#: Decibels that a band may lie below the loudest and still be told, and how many bands are told.
TOLD_DB, TOLD = 50.0, 5


def same_number(a: Column, b: Column) -> Column:
    x, y = V.number(a), V.number(b)
    return F.coalesce(F.abs(x - y) <= SAME, a == b, F.lit(False))


def moved_controls(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Controls (keys, value) of both sides that moved, with both values."""
    b = before.select(*keys, F.col("value").alias("was"))
    return after.select(*keys, F.col("value").alias("now")).join(b, keys).filter(F.abs(F.col("now") - F.col("was")) > MOVED)


def classified(attempts: DataFrame) -> DataFrame:
    """Attempts (was, wrote, kept, moved) with outcome: what one write did to the state and to the published controls."""
    outcome = (
        F.when(F.col("kept").isNull(), "unsupported")
        .when(F.col("moved") > 1, "ambiguous")
        .when(F.col("moved") == 1, "mapped")
        .when(same_number(F.col("kept"), F.col("was")), F.when(same_number(F.col("wrote"), F.col("was")), "no_op").otherwise("rejected"))
        .otherwise("state_only")
    )
    return attempts.withColumn("outcome", outcome)


def summarised(attempts: DataFrame, group: str) -> DataFrame:
    """(group, status, address) of classified attempts (moved, address, outcome); no movement is never a mapping."""
    a = attempts.groupBy(group).agg(
        F.max("moved").alias("moved"), F.count_distinct("address").alias("addresses"), F.min("address").alias("address"), F.count_distinct("outcome").alias("outcomes"), F.min("outcome").alias("only"), F.bool_or(F.col("outcome") == "state_only").alias("state")
    )
    status = F.when((F.col("moved") > 1) | (F.col("addresses") > 1), "ambiguous").when(F.col("addresses") == 1, "mapped").when(F.col("state"), "state_only").when(F.col("outcomes") == 1, F.col("only")).otherwise("inconclusive")
    return a.select(group, status.alias("status"), F.when(status == "mapped", F.col("address")).alias("address"))


def probe_values(current: DataFrame, seen: DataFrame, key: str, most: int = 4) -> DataFrame:
    """(key, rank, value): the values to probe a control with: the least and greatest seen, then those farthest from its own."""
    both = seen.select(key, F.col("value").alias("x")).distinct().join(current.select(key, F.col("value").alias("own")), key).filter(F.abs(F.col("x") - F.col("own")) > SAME)
    w = W.partitionBy(key)
    end = F.when(F.col("x") == F.min("x").over(w), 0).when(F.col("x") == F.max("x").over(w), 1).otherwise(2)
    ranked = both.withColumn("end", end)
    order = F.row_number().over(w.orderBy("end", F.desc(F.abs(F.col("x") - F.col("own"))), "x"))
    return ranked.withColumn("rank", order).filter(F.col("rank") <= most).select(key, "rank", F.col("x").alias("value"))


def not_kept(written: DataFrame, read: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Parameters that a state round trip lost or changed."""
    both = written.select(*keys, F.col(value).alias("written")).join(read.select(*keys, F.col(value).alias("read"), F.lit(True).alias("_there")), keys, "left")
    return both.filter(F.col("_there").isNull() | ~F.col("written").eqNullSafe(F.col("read"))).drop("_there")


def member_differences(declared: DataFrame, published: DataFrame, keys: list[str]) -> DataFrame:
    """Enum members whose declared and published labels differ, or that one side lacks."""
    both = declared.select(*keys, F.col("label").alias("declared")).join(published.select(*keys, F.col("label").alias("published")), keys, "full_outer")
    return both.filter(~F.col("declared").eqNullSafe(F.col("published")))


def coverage(specs: DataFrame, mapped: DataFrame, published: DataFrame, key: str, address: str) -> DataFrame:
    """Specs with bucket: mapped to a published control, to one that isn't published, or not reached."""
    m = mapped.select(key, address).distinct().join(published.select(address).distinct().withColumn("_p", F.lit(True)), address, "left")
    bucket = F.when(F.col(address).isNull(), "not reached").when(F.col("_p").isNull(), "unpublished").otherwise("mapped")
    return specs.join(m, key, "left").withColumn("bucket", bucket).drop("_p")


def matched_once(asked: DataFrame, log: DataFrame, group: str, key: str, value: str, tolerance: float = 1e-9) -> DataFrame:
    """Asked rows with the key of the only logged row of their group whose number is theirs within a relative tolerance; null if none or several are."""
    both = asked.join(log.select(group, F.col(key).alias("_key"), F.col(value).alias("_value")), group)
    both = both.filter(F.abs(F.col(value) - F.col("_value")) <= tolerance * F.greatest(F.abs(F.col(value)), F.abs(F.col("_value")), F.lit(1.0)))
    once = both.groupBy(*asked.columns).agg(F.count("*").alias("_n"), F.min("_key").alias("found")).filter("_n = 1").drop("_n")
    return asked.join(once, asked.columns, "left")


def selected_paths(selections: DataFrame, settings: DataFrame) -> DataFrame:
    """(preset, path): the one declared path whose every selection (path, control, expected) the settings (preset, control, value) meet; presets without exactly one are left out.

    An unset control fails its path: a null comparison counts as false.
    """
    presets = settings.select("preset", "control", V.selector_token(F.col("value")).alias("value"))
    wanted = selections.select("path", "control", V.selector_token(F.col("expected")).alias("expected"))
    need = wanted.groupBy("path").agg(F.count("*").alias("need"))
    met = presets.join(wanted, "control").filter(F.col("value") == F.col("expected")).groupBy("preset", "path").agg(F.count_distinct("control").alias("met"))
    full = met.join(need, "path").filter("met = need")
    return full.groupBy("preset").agg(F.count("*").alias("n"), F.min("path").alias("path")).filter("n = 1").drop("n")


def told_bands(deltas: DataFrame, group: str, centre: str) -> DataFrame:
    """The bands of the largest deviations among those near a target's loudest (target_db, delta_db), with their place by frequency."""
    loudest = deltas.groupBy(group).agg(F.max("target_db").alias("_peak"))
    near = deltas.join(loudest, group).filter(F.col("target_db") >= F.col("_peak") - TOLD_DB)
    rank = F.row_number().over(W.partitionBy(group).orderBy(F.desc(F.abs("delta_db")), centre))
    top = near.withColumn("_r", rank).filter(F.col("_r") <= TOLD)
    return top.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy(centre))).drop("_r", "_peak")


#: Fixed value: channels for which loudness weights are defined.
METERED_CHANNELS = 5


def caveats(regime: Column, harmonic: Column, delay: Column, rt60: Column, channels: Column, am_rate: Column | None = None, am: Column | None = None) -> Column:
    """What a report has to say about a measurement, as an array of notes."""
    am_rate, am = (F.lit(None).cast("double") if c is None else c for c in (am_rate, am))
    known = lambda c: F.coalesce(c, F.lit(0.0))
    return F.array_compact(
        F.array(
            F.when(regime.isin("mix", "separated_stem"), "the instrument isn't isolated"),
            F.when(known(harmonic) < 0.5, "distortion is unmeasured"),
            F.when(known(delay) < 0.3, "no delay repeat"),
            F.when(known(rt60) < 0.4, "reverberation is uncertain"),
            F.when(am_rate.isNotNull() & (known(am) < 0.75), "the amplitude modulation may be the rate of the notes"),
            F.when(F.coalesce(channels, F.lit(1)) < 2, "mono: width isn't measured"),
            F.when(F.coalesce(channels, F.lit(1)) > METERED_CHANNELS, "loudness was metered on the fold of all channels"),
        )
    )


def edge_runs(flags: DataFrame, group: str, order: str, flag: str) -> DataFrame:
    """How many rows have the flag inward from each end of a group's order."""
    up, down = W.partitionBy(group).orderBy(order), W.partitionBy(group).orderBy(F.desc(order))
    off = (~F.coalesce(F.col(flag), F.lit(False))).cast("int")
    x = flags.withColumns({"_low": F.sum(off).over(up), "_high": F.sum(off).over(down)})
    return x.groupBy(group).agg(F.count_if(F.col("_low") == 0).alias("low_run"), F.count_if(F.col("_high") == 0).alias("high_run"))


def without_files(parameters: DataFrame, custom: str = "10") -> DataFrame:
    """Parameters (module, key, value) without paths of custom responses: they are emptied, and selectors that point at them are reset."""
    path = F.col("key").isin("leftChosenIRFilePath", "rightChosenIRFilePath")
    mic = F.when(F.col("key") == "leftMicType", "0").when(F.col("key") == "rightMicType", "4")
    here = F.col("module") == "cabParameters"
    return parameters.withColumn("value", F.when(here & path, "").when(here & mic.isNotNull() & (F.col("value") == custom), mic).otherwise(F.col("value")))


#: Cells of a logarithmic scale in which numbers are looked up; each is wider than any tolerance up to COARSEST.
CELL, COARSEST = 4e-3, 1e-3


def resolved(asked: DataFrame, log: DataFrame, key: str, context: list[str], numbers: list[str], settings: str, tolerance: float = 1e-9) -> DataFrame:
    """Asked rows with the key of the only logged row that has their context, numbers and settings, else null, and how many have (hits).

    Numbers agree within a relative tolerance (absolute below 1), of settings (maps of texts) the logged ones have to be among the asked ones,
    with the same texts or numbers, and there have to be some. Null contexts and numbers match nothing. Each number is looked up in the cell that
    holds it and in a neighbour, if that is within the tolerance, so that no pair of rows is made that agrees in no cell.
    """
    if tolerance > COARSEST:
        raise ValueError(f"a tolerance of more than {COARSEST} needs wider cells")
    scale = lambda x: F.signum(x) * F.log1p(F.abs(x))
    reach = 1.5 * tolerance
    cell = lambda x: F.floor(scale(x) / CELL)
    ask = asked.withColumn("_row", F.monotonically_increasing_id())
    ask = cut(ask)
    probe = ask.select("_row", *context, *(F.col(n).alias(f"_ask_{n}") for n in numbers), F.col(settings).alias("_ask"))
    for n in numbers:
        x = scale(F.col(f"_ask_{n}").cast("double"))
        probe = probe.withColumn(f"_cell_{n}", F.explode(F.array_distinct(F.array(F.floor((x - reach) / CELL), F.floor((x + reach) / CELL)))))
    known = log.select(F.col(key).alias("_key"), *context, *(F.col(n).cast("double").alias(f"_log_{n}") for n in numbers), *(cell(F.col(n).cast("double")).alias(f"_cell_{n}") for n in numbers), F.col(settings).alias("_log"))
    both = probe.join(known, [*context, *(f"_cell_{n}" for n in numbers)])
    for n in numbers:
        a, b = F.col(f"_ask_{n}").cast("double"), F.col(f"_log_{n}")
        both = both.filter(F.abs(a - b) <= tolerance * F.greatest(F.lit(1.0), F.abs(a), F.abs(b)))
    keys = F.map_keys("_log")
    one = lambda k: V.same_number(V.number(F.try_element_at("_ask", k)), V.number(F.element_at("_log", k))) | F.try_element_at("_ask", k).eqNullSafe(F.element_at("_log", k))
    within = F.forall(keys, lambda k: F.coalesce(F.array_contains(F.map_keys("_ask"), k) & one(k), F.lit(False)))
    hits = both.filter((F.size("_log") > 0) & within).groupBy("_row").agg(F.count_distinct("_key").alias("hits"), F.min("_key").alias("found"))
    out = ask.join(hits, "_row", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return out.withColumn("found", F.when(F.col("hits") == 1, F.col("found"))).drop("_row")
