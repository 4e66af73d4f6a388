"""Signal paths: free-form calibration read into checked paths, or paths by the naming of amps, and their names by alias."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import parameters as P

# Members of a path's row, and the parameters of an amp by its naming.
LISTS = {"bands": "eq_band_controls", "enables": "eq_enable_controls"}
SINGLES = {"volume": "volume_control", "hpf": "eq_hpf_control", "lpf": "eq_lpf_control"}
MOST_BANDS = 31
NAMED = {
    "volume": ["{}Amp/{}Volume"],
    "bands": [f"{{}}EQ/{{}}EQBand{k}" for k in range(1, MOST_BANDS + 1)],
    "enables": ["{}EQ/{}EQActive", "eqParameters/sectionActive"],
    "hpf": ["{}EQ/{}EQHpf"],
    "lpf": ["{}EQ/{}EQLpf"],
    "output": ["parameters/outputGain"],
    "gate": ["parameters/gateActive"],
}
SELECTOR = "/selectedAmp"
PATH = ["pack", "name", "settings", "selection", "volume", "bands", "enables", "hpf", "lpf", "output"]


def canonical(path: Column) -> Column:
    """A parameter's path with a slash, which top-level ones begin with."""
    return F.when(F.contains(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path))


def _many(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the packs: it is never broadcast, however small its files are."""
    return df.hint("merge")


def _texts(v: str) -> str:
    """An object as a map of texts; null for what is no object."""
    return f"transform_values(try_variant_get({v}, '$', 'map<string,variant>'), (k, x) -> try_variant_get(x, '$', 'string'))"


def _object(v: str) -> tuple[Column, Column]:
    """The map of a member, empty where it is missing, and whether it is no object though it is there."""
    m = F.expr(_texts(v))
    return F.when(F.expr(f"{v} IS NULL"), F.expr("map()").cast("map<string,string>")).otherwise(m), F.expr(f"{v} IS NOT NULL") & m.isNull()


def _fault(wrong: Column, rule: str, detail: Column | None = None) -> Column:
    return F.when(wrong, F.struct(F.lit(rule).alias("rule"), (F.lit(None) if detail is None else detail).cast("string").alias("detail")))


def _string(v: str) -> tuple[Column, Column]:
    """The text of a member that names a parameter, and whether it is there without being such a text."""
    text = F.when(F.expr(f"schema_of_variant({v}) = 'STRING'"), F.nullif(F.expr(f"try_variant_get({v}, '$', 'string')"), F.lit("")))
    return text, F.expr(f"{v} IS NOT NULL AND NOT is_variant_null({v})") & text.isNull()


def _declared(top: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paths that calibrations declare, with what is wrong in their form."""
    d = top.selectExpr("pack", "try_variant_get(v, '$.signal_paths', 'map<string,variant>') AS rows", "try_variant_get(v, '$.settings', 'variant') AS s", "try_variant_get(v, '$.output_gain_control', 'variant') AS o")
    common, no_object = _object("s")
    output, no_text = _string("o")
    faults = F.array_compact(
        F.array(
            _fault(F.coalesce(F.size("rows") <= 0, F.lit(True)), "signal_paths is no object with members"),
            _fault(no_object, "calibration settings are no object"),
            _fault(no_text, "names no parameter", F.lit("output")),
        )
    )
    d = d.select("pack", "rows", common.alias("common"), output.alias("output"), faults.alias("faults"))
    of_packs = d.select("pack", F.lit(None).cast("string").alias("name"), F.inline("faults"))
    r = d.select("pack", "common", "output", F.explode("rows").alias("name", "row")).withColumn("m", F.expr("try_variant_get(row, '$', 'map<string,variant>')"))
    members = {"local": "settings", "selected": "selection_settings"} | LISTS | SINGLES
    r = r.withColumns({f"_{k}": F.expr(f"m['{m}']") for k, m in members.items()})
    local, local_bad = _object("_local")
    selected, selected_bad = _object("_selected")
    columns, wrong = {"local": local, "selection": selected}, [_fault(F.col("m").isNull(), "path is no object"), _fault(local_bad, "settings are no object"), _fault(selected_bad, "selection settings are no object")]
    for k in SINGLES:
        columns[k], bad = _string(f"_{k}")
        wrong.append(_fault(bad, "names no parameter", F.lit(k)))
    for k in LISTS:
        items = F.expr(f"try_variant_get(_{k}, '$', 'array<variant>')")
        names = F.transform(items, lambda x: F.when(F.schema_of_variant(x) == "STRING", F.nullif(F.try_variant_get(x, "$", "string"), F.lit(""))))
        columns[k] = F.coalesce(F.array_compact(names), F.array().cast("array<string>"))
        wrong += [
            _fault(F.col(f"_{k}").isNotNull() & items.isNull(), "controls are no list", F.lit(k)),
            _fault(F.exists(names, lambda x: x.isNull()), "list names no parameter", F.lit(k)),
            _fault(F.size(F.array_distinct(columns[k])) < F.size(columns[k]), "list repeats a control", F.lit(k)),
        ]
    r = r.select("pack", "name", "common", "output", *(c.alias(k) for k, c in columns.items()), F.array_compact(F.array(*wrong)).alias("wrong"))
    r = cut(r)
    twice = F.array_sort(F.array_intersect(F.map_keys("local"), F.map_keys("selection")))
    faults = F.concat("wrong", F.array_compact(F.array(_fault(F.size(twice) > 0, "set and selected by", F.array_join(twice, ",")))))
    own = F.map_filter("local", lambda k, v: ~F.array_contains(F.map_keys("selection"), k))
    rest = F.map_filter("common", lambda k, v: ~F.array_contains(F.array_union(F.map_keys("local"), F.map_keys("selection")), k))
    paths = r.withColumn("settings", F.map_concat(rest, own, "selection"))
    return paths.select(*PATH), of_packs.unionByName(r.select("pack", "name", F.inline(faults)))


def _by_amp(top: DataFrame, specs: DataFrame) -> DataFrame:
    """Paths of packs that declare none, from the parameters that their amps' names lead to."""
    amps = top.select("pack", F.posexplode("amps").alias("at", "display", "name")).filter("name is not null").groupBy("pack", "name").agg(F.min_by("display", "at").alias("display"))
    candidates = F.array(*(F.struct(F.lit(role).alias("role"), F.lit(k).alias("k"), F.lit(path).alias("path")) for role, all_ in NAMED.items() for k, path in enumerate(all_)))
    asked = amps.select("*", F.inline(candidates)).withColumn("path", F.replace("path", F.lit("{}"), "name"))
    found = asked.join(_many(specs.select("pack", "path")), ["pack", "path"], "left_semi")
    one = lambda role: F.max(F.when(F.col("role") == role, F.col("path")))
    some = lambda role: F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("k", "path"))))
    g = found.groupBy("pack", "name", "display").agg(*(one(r).alias(r) for r in ("volume", "hpf", "lpf", "output", "gate")), some("bands").alias("b"), some("enables").alias("e"))
    bands = F.transform(F.filter("b", lambda s, j: s["k"] == j), lambda s: s["path"])
    selection = F.create_map(F.lit(SELECTOR), "display")
    gate = F.when(F.col("gate").isNotNull(), F.create_map("gate", F.lit("false"))).otherwise(F.expr("map()").cast("map<string,string>"))
    g = g.select("*", bands.alias("bands"), F.transform("e", lambda s: s["path"]).alias("enables"), selection.alias("selection"), F.map_concat(selection, gate).alias("settings"))
    return g.filter("volume is not null or size(bands) > 0").select(*PATH)


def _refused(paths: DataFrame, specs: DataFrame, members: DataFrame) -> DataFrame:
    """Settings that their parameters can't take, and controls that aren't there or can't be written."""
    def control(role: str, name: Column, value: Column | None = None) -> Column:
        return F.struct(F.lit(role).alias("role"), name.alias("control"), (F.lit(None) if value is None else value).cast("string").alias("value"))

    def controls(role: str) -> Column:
        return F.transform(role, lambda c: control(role, c))

    settings = F.transform(F.map_entries("settings"), lambda e: control("setting", e["key"], e["value"]))
    asked = F.concat(settings, F.array(*(control(k, F.col(k)) for k in (*SINGLES, "output"))), *map(controls, LISTS))
    rows = paths.select("pack", "name", F.inline(asked)).filter("control is not null").withColumn("path", F.struct("pack", canonical(F.col("control")).alias("path")))
    key = F.struct("pack", canonical(F.col("path")).alias("path")).alias("path")
    named = P.resolve_members(rows, members.select(key, "member", "label")).withColumn("value", F.coalesce(F.col("member").cast("string"), "value"))
    # validate reads a value many times, and a filter would repeat its rules, so both sides of it are stored.
    named = cut(named.select("pack", "name", "role", "control", "path", "value"))
    is_setting, keyed = F.col("role") == "setting", specs.select(key, "kind", "unit", "low", "high", "writable", "needs_review", "encoding")
    settings = cut(P.validate(named.filter(is_setting), _many(keyed))).filter("error is not null")
    there = named.filter(~is_setting).join(_many(keyed), "path", "left")
    others = there.withColumn("error", F.when(F.col("kind").isNull(), "unknown").when(~F.col("writable"), "read-only")).filter("error is not null")
    out = ["pack", "name", F.concat(F.col("role"), F.lit(": "), "error").alias("rule"), F.col("control").alias("detail")]
    return settings.select(*out).unionByName(others.select(*out))


def signal_paths(manifests: DataFrame, specs: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The signal paths of packs, and the faults of packs that have none for it.

    manifests: (pack, calibration, amps), the calibration as JSON text and amps as a map from shown names to prefixes; specs: those of
    validate with a pack; members: (pack, path, member, label). Paths: (pack, name, settings, selection, volume, bands, enables, hpf,
    lpf, output); faults: (pack, name, rule, detail), name being null for a fault of the whole pack.

    A calibration with signal_paths declares them; without (missing or null), each prefix of amps is a path by its parameters' names. In
    settings the path's own win over common ones. A pack with any fault has no path; one with neither faults nor paths is a fault.
    What is read and what is wrong are written to the shared folder once, as several rules read them.
    """
    top = manifests.select("pack", "amps", "calibration", F.try_parse_json("calibration").alias("v"))
    broken = F.expr("calibration IS NOT NULL AND (v IS NULL OR NOT is_variant_null(v) AND try_variant_get(v, '$', 'map<string,variant>') IS NULL)")
    says = F.expr("try_variant_get(v, '$.signal_paths', 'variant')")
    top = top.select("*", broken.alias("broken"), F.coalesce(says.isNotNull() & ~F.is_variant_null(says), F.lit(False)).alias("declares"))
    declared, form = _declared(top.filter("declares"))
    known = specs.withColumn("path", canonical(F.col("path")))
    named = _by_amp(top.filter("not declares and not broken"), known)
    both = cut(declared.unionByName(named))
    checked = _refused(both.join(_many(top.filter("declares").select("pack")), "pack", "left_semi"), known, members)
    units = both.filter("output is not null").select("pack", "name", "output", canonical(F.col("output")).alias("path")).join(_many(known.select("pack", "path", "unit")), ["pack", "path"])
    no_db = units.filter(F.coalesce(F.lower("unit"), F.lit("")) != "db").select("pack", "name", F.lit("output is not in dB").alias("rule"), F.col("output").alias("detail"))
    nothing = F.lit(None).cast("string")
    unread = top.filter("broken").select("pack", nothing.alias("name"), F.lit("calibration is no object").alias("rule"), nothing.alias("detail"))
    faults = form.unionByName(checked).unionByName(no_db).unionByName(unread)
    empty = top.filter("not declares and not broken").select("pack").join(_many(both.select("pack")), "pack", "left_anti")
    faults = cut(faults.unionByName(empty.select("pack", nothing.alias("name"), F.lit("no signal path").alias("rule"), nothing.alias("detail"))))
    return both.join(_many(faults.select("pack").distinct()), "pack", "left_anti").select(*PATH), faults


def resolved(requests: DataFrame, paths: DataFrame, manifests: DataFrame) -> DataFrame:
    """requests (pack, asked) with name and selection of the path asked for, or null.

    Any case of a path's name, of a value that selects it, or of a shown name of its amp will do; of several paths the first by name.
    """
    own = F.concat(F.array("name"), F.map_values("selection"))
    aliases = paths.select("pack", "name", F.explode(own).alias("alias"))
    shown = manifests.select("pack", F.explode("amps").alias("alias", "name")).join(_many(paths.select("pack", "name")), ["pack", "name"], "left_semi")
    known = aliases.unionByName(shown).groupBy("pack", F.lower("alias").alias("token")).agg(F.min("name").alias("name"))
    found = requests.withColumn("token", F.lower("asked")).join(_many(known), ["pack", "token"], "left").drop("token")
    return found.join(_many(paths.select("pack", "name", "selection")), ["pack", "name"], "left").select(*requests.columns, "name", "selection")
