"""Parameters in long form: overlays, duplicates, joins with specs, validation, diffs and catalogs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import values as V


def path_of(module: Column, key: Column) -> Column:
    """The one spelling that parameters are joined by."""
    return F.when(F.coalesce(module, F.lit("")) == "", key).otherwise(F.concat(module, F.lit("/"), key))


def last_wins(entries: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """The value of the last entry of each key; order has to tell all entries of a key apart. One aggregation, no sort."""
    return entries.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def ordered_union(*layers: DataFrame) -> DataFrame:
    """Layers one after another, with their numbers as the column layer."""
    out = layers[0].withColumn("layer", F.lit(0))
    for k, x in enumerate(layers[1:], 1):
        out = out.unionByName(x.withColumn("layer", F.lit(k)))
    return out


def duplicated(entries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number."""
    return entries.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def missing(spec: DataFrame, parameters: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Entries of a spec that name no parameter."""
    return spec.join(parameters.select(*keys).distinct(), list(keys), "left_anti")


def expand_prefix(entries: DataFrame, prefix: Column, module: str = "module") -> DataFrame:
    """Replaces {amp} in modules; adds error where there is no prefix to put there."""
    asks = F.contains(F.col(module), F.lit("{amp}"))
    return entries.withColumn("error", F.when(asks & prefix.isNull(), "no amp for a templated module")).withColumn(
        module, F.when(asks & prefix.isNotNull(), F.replace(F.col(module), F.lit("{amp}"), prefix)).otherwise(F.col(module))
    )


def resolve_members(entries: DataFrame, members: DataFrame, value: str = "value") -> DataFrame:
    """Adds member, the stored number of an enum value given by number or name; members: (path, member, label).

    Values of an enum are few and rows with them many, so members of a bounded catalog come with a broadcast hint, which holds here.
    """
    tokens = members.select("path", "member", F.explode(F.array(V.normal_name(F.col("label")), F.col("member").cast("string"))).alias("token")).distinct()
    asked = entries.withColumn("token", V.selector_token(F.col(value).cast("string")))
    return asked.join(tokens, ["path", "token"], "left").drop("token")


def validate(entries: DataFrame, specs: DataFrame, allow_outside: bool = False) -> DataFrame:
    """Entries (path, value) with stored, error and warnings by the specs (path, kind, unit, low, high, writable, needs_review, encoding).

    The first rule that an entry breaks is its error and leaves stored null: unknown path, read-only, no value of the kind,
    below the unit's floor, outside the range (a warning where that is allowed).
    """
    e = entries.join(specs, "path", "left")
    # A column of its own, that rules and outputs read instead of working it out again.
    e = e.withColumn("_stored", V.to_stored(F.col("kind"), F.col("value"), F.col("encoding"))).withColumn("_x", V.number(F.col("_stored")))
    stored, x = F.col("_stored"), F.col("_x")
    out = V.outside(x, F.col("low"), F.col("high"))
    error = (
        F.when(F.col("kind").isNull(), "unknown")
        .when(~F.col("writable"), "read-only")
        .when(stored.isNull(), "no value of this kind")
        .when(V.below_floor(F.col("unit"), x), "not a possible value")
        .when(out & F.lit(not allow_outside), "outside the range")
    )
    warnings = F.array_compact(F.array(F.when(F.col("needs_review"), "guessed kind"), F.when(out & F.lit(allow_outside), "outside the range")))
    e = e.withColumns({"_error": error, "_warnings": warnings})
    return e.select(*entries.columns, F.when(F.col("_error").isNull(), stored).alias("stored"), F.col("_error").alias("error"), F.col("_warnings").alias("warnings"))


def differences(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str, tolerance: float) -> DataFrame:
    """Keys whose numbers differ by more than the tolerance, or that only one side has; full outer."""
    x, y = a.select(*keys, F.col(value).alias("before")), b.select(*keys, F.col(value).alias("after"))
    both = x.join(y, list(keys), "full_outer")
    return both.filter(F.col("before").isNull() | F.col("after").isNull() | (F.abs(F.col("before") - F.col("after")) > tolerance))


def observed(entries: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], file: str) -> DataFrame:
    """Per key: its distinct values in the order they were first seen, and how many files hold it.

    First sights are aggregated per (key, value) before values are gathered, so a group is as large as its distinct values.
    """
    first = entries.groupBy(*keys, value).agg(F.min(F.struct(*order)).alias("first"))
    seen = first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("first", value))), lambda s: s[value]).alias("observed"))
    files = entries.select(*keys, file).distinct().groupBy(*keys).agg(F.count("*").alias("files"))
    return seen.join(files, list(keys))


# Key endings that name a unit, keys of selectors, and keys of positions.
UNIT_HINTS = (
    ("(Hpf|Lpf|HighCut|LowCut|Rate)$", "hz"),
    (r"(EQBand\d+|MicLevel|Gain|Threshold)$", "db"),
    ("(PreDelay|Spread|Time)$", "ms"),
    ("Decay$", "seconds"),
    ("Tempo$", "bpm"),
    ("^transpose$", "semitones"),
)
SELECTOR_HINT, POSITION_HINT = "(Type|Mode|Note|Sync|selected[A-Z])", "(Position|Distance)$"


def infer_kinds(entries: DataFrame, keys: Sequence[str], key: str, value: str) -> DataFrame:
    """(keys, kind, unit, needs): a guessed kind for each parameter from its values and its key, the first rule that applies.

    needs says what a person has to look at: "review" of a guessed kind, "confirmation" of a selector's members, null for a
    switch, a path or a string.
    """
    x, text = V.number(F.col(value)), F.col(value).cast("string")
    every = lambda c: F.bool_and(F.coalesce(c, F.lit(False)))
    a = entries.groupBy(*keys).agg(
        every(text.isin("true", "false")).alias("_switch"),
        every(x.isNotNull()).alias("_number"),
        every(x == F.floor(x)).alias("_whole"),
        every(x.between(0, 1)).alias("_unit"),
    )
    name = F.col(key)
    unit = F.coalesce(*(F.when(name.rlike(pattern), u) for pattern, u in UNIT_HINTS))
    text_kind = F.when(name.contains("Path"), "path").otherwise("string")
    a = a.withColumn("_hint", F.when(F.col("_number") & ~F.col("_switch"), unit))
    kind = (
        F.when(F.col("_switch"), "switch")
        .when(~F.col("_number"), text_kind)
        .when(F.col("_hint").isNotNull(), "metered")
        .when(name.rlike(SELECTOR_HINT) & F.col("_whole"), "enum")
        .when(F.col("_unit"), F.when(name.rlike(POSITION_HINT), "fraction").otherwise("rotation"))
        .otherwise("metered")
    )
    a = a.withColumn("kind", kind)
    needs = F.when(F.col("kind") == "enum", "confirmation").when(F.col("kind").isin("metered", "fraction", "rotation"), "review")
    return a.select(*keys, "kind", F.col("_hint").alias("unit"), needs.alias("needs"))


#: Bytes of payloads that are understood, and parameters from which few distinct keys show another format.
WIDTHS, MANY, PER_KEY = (8,), 20, 4


def unsupported_shapes(presets: DataFrame, group: str, key: str, payload: str) -> DataFrame:
    """(group, reason) for presets that can't be drafted: payloads of unknown widths, or far fewer keys than parameters."""
    a = presets.groupBy(group).agg(
        F.bool_or(~F.octet_length(payload).isin(*WIDTHS)).alias("_odd"),
        F.count("*").alias("_n"),
        F.count_distinct(key).alias("_keys"),
    )
    reason = F.when(F.coalesce("_odd", F.lit(False)), "payloads of unknown widths").when((F.col("_n") > MANY) & (F.col("_keys") * PER_KEY < F.col("_n")), "few distinct keys")
    return a.select(group, reason.alias("reason")).filter("reason is not null")


def shown_presets(parameters: DataFrame, specs: DataFrame, seen: DataFrame) -> DataFrame:
    """Parameters (path, stored) with what a manifest and a catalog know of them; both sides may miss.

    specs: (path, kind, unit, low, high, writable, needs_review, needs_confirmation, members map); seen: (path, observed).
    """
    both = parameters.join(specs, "path", "left").join(seen, "path", "left")
    kind = F.coalesce("kind", F.lit("unknown"))
    member = F.get(F.map_values(F.map_filter("members", lambda k, _: k == F.col("stored"))), F.lit(0))
    display = F.coalesce(member, V.described(kind, F.col("stored"), F.col("unit")))
    return both.select(
        *parameters.columns, kind.alias("kind"), "unit", V.from_stored(kind, F.col("stored")).alias("human"), display.alias("display"), member.alias("member"), "low", "high",
        (~F.coalesce("writable", F.lit(True))).alias("read_only"), F.coalesce("needs_confirmation", F.lit(False)).alias("unconfirmed"), F.coalesce("needs_review", F.lit(False)).alias("guessed"), "observed",
    )


def seed_values(parameters: DataFrame, dimensions: DataFrame, header: Column, pack_header: str) -> DataFrame:
    """(preset, path, value, error) of a template's parameters (preset, path, stored) as a search begins with them.

    Only dimensions (path, kind) and the selected amp take part; a value that can't be read is left out, not guessed. A preset
    whose header is not the pack's gives one row with an error instead.
    """
    foreign = parameters.filter(~F.coalesce(header == pack_header, F.lit(False))).select("preset").distinct()
    error = foreign.select("preset", F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("value"), F.lit("another pack's preset").alias("error"))
    own = parameters.join(foreign, "preset", "left_anti")
    known = own.join(dimensions.select("path", "kind"), "path").select("preset", "path", V.from_stored(F.col("kind"), F.col("stored")).cast("string").alias("value"))
    amp = own.filter("path = 'selectedAmp'").select("preset", "path", F.col("stored").alias("value"))
    seeded = known.filter("path != 'selectedAmp' and value is not null").unionByName(amp)
    return seeded.withColumn("error", F.lit(None).cast("string")).unionByName(error)


def entry_faults(specs: DataFrame, spec: str, text: str) -> DataFrame:
    """(spec, place, module, key, value, error) for each entry of specs in JSON text; place is null for a fault of the whole.

    The first rule that breaks is the error: no JSON object, parameters that are no list, an entry that is no object, a field
    that is missing.
    """
    doc = F.try_parse_json(F.col(text))
    rows = specs.select(spec, doc.alias("_doc"))
    whole = F.when(F.col("_doc").isNull() | ~F.schema_of_variant("_doc").startswith("OBJECT"), "no JSON object")
    listed = F.try_variant_get("_doc", "$.parameters", "array<variant>")
    given = F.try_variant_get("_doc", "$.parameters", "variant")
    whole = whole.when(given.isNotNull() & listed.isNull(), "parameters are no list")
    rows = rows.select(spec, whole.alias("error"), listed.alias("_list"))
    bad = rows.filter("error is not null").select(spec, F.lit(None).cast("int").alias("place"), *(F.lit(None).cast("string").alias(c) for c in ("module", "key", "value")), "error")
    entries = rows.filter("error is null").select(spec, F.posexplode("_list").alias("place", "_e"))
    field = lambda f: F.try_variant_get("_e", f"$.{f}", "string")
    has = lambda f: F.coalesce(F.schema_of_variant("_e").rlike(rf"[<, ]{f}:"), F.lit(False))
    fault = F.when(~F.coalesce(F.schema_of_variant("_e").startswith("OBJECT"), F.lit(False)), "no object")
    for f in ("module", "key", "value"):
        fault = fault.when(~has(f), f"no {f}")
    return entries.select(spec, "place", field("module").alias("module"), field("key").alias("key"), field("value").alias("value"), fault.alias("error")).unionByName(bad)


def shared_keys(entries: DataFrame, group: str, value: str) -> DataFrame:
    """Values that every group has."""
    groups = entries.select(group).distinct().agg(F.count("*").alias("_all"))
    held = entries.select(group, value).distinct().groupBy(value).agg(F.count("*").alias("_n"))
    return held.join(F.broadcast(groups), F.expr("_n = _all")).select(value)  # one row


def dropped(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct rows of before that after lacks; nulls are equal."""
    return before.select(*columns).subtract(after.select(*columns))


def latest(entries: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    n = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return entries.withColumn("_n", n).filter("_n = 1").drop("_n")
