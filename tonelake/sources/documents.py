"""Catalogs, measurements and reports as JSON, read with explicit schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut

PARAMETER = (
    "struct<kind:string,unit:string,min:double,max:double,range_source:string,centre_hz:double,enum:string,members:map<string,string>,ui:string,note:string,"
    "writable:boolean,searchable:boolean,needs_confirmation:boolean,needs_review:boolean,switch_encoding:string>"
)
MANIFEST = (
    "pack_id string, display_name string, file_header string, switch_encoding string, enums map<string,map<string,string>>, amp_modules map<string,string>, "
    f"parameters map<string,{PARAMETER}>, search_conditions map<string,struct<selector:string,members:array<string>>>"
)
RECIPES = "pack_id string, layers map<string,map<string,struct<title:string,use_when:string,note:string,parameters:array<struct<module:string,key:string,value:string>>>>>"
ATLAS = "atlas_id string, fixed map<string,string>, entries array<struct<index:int,settings:map<string,double>,fingerprint:string>>"
#: Sections of a measurement, and the version that is read.
SECTIONS, VERSION = ("source", "spectrum", "dynamics", "harmonic", "time_fx", "modulation", "spatial", "cepstral"), 1


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).option("multiLine", True).option("mode", "FAILFAST").json(path)


def parameter_specs(manifests: DataFrame) -> DataFrame:
    """One row per parameter, with enum tables resolved by name and defaults filled in."""
    p = manifests.select("pack_id", "enums", "switch_encoding", F.explode("parameters").alias("path", "p"))
    slash = F.length("path") - F.length(F.substring_index("path", "/", -1))
    return p.select(
        "pack_id",
        F.when(slash > 0, F.expr("left(path, length(path) - length(substring_index(path, '/', -1)) - 1)")).otherwise("").alias("module"),
        F.substring_index("path", "/", -1).alias("key"),
        "path",
        "p.kind",
        "p.unit",
        F.col("p.min").alias("low"),
        F.col("p.max").alias("high"),
        F.coalesce(F.col("p.members"), F.try_element_at("enums", F.col("p.enum"))).alias("members"),
        F.coalesce("p.writable", F.lit(True)).alias("writable"),
        F.coalesce("p.searchable", F.lit(True)).alias("searchable"),
        F.coalesce("p.needs_review", F.lit(False)).alias("needs_review"),
        F.coalesce("p.switch_encoding", "switch_encoding", F.lit("text")).alias("encoding"),
    )


def recipe_entries(spark: SparkSession, path: str) -> DataFrame:
    """(pack_id, layer, recipe, seq, module, key, value) of all recipes."""
    r = spark.read.schema(RECIPES).option("multiLine", True).option("mode", "FAILFAST").json(path)
    one = r.select("pack_id", F.explode("layers").alias("layer", "recipes")).select("pack_id", "layer", F.explode("recipes").alias("recipe", "r"))
    return one.select("pack_id", "layer", "recipe", F.posexplode("r.parameters").alias("seq", "e")).select("pack_id", "layer", "recipe", "seq", "e.module", "e.key", "e.value")


def routed(presets: DataFrame, manifests: DataFrame, header: str = "header") -> DataFrame:
    """Presets with the pack of their header (the first by id); null where no pack has it. A catalog has few packs."""
    first = manifests.groupBy(F.col("file_header").alias(header)).agg(F.min("pack_id").alias("pack_id"))
    return presets.join(first, header, "left")


def measurement_faults(documents: DataFrame, json: str = "json") -> DataFrame:
    """Documents with fault: no object, another version, or sections that aren't known; null for the sound ones."""
    keys = F.json_object_keys(json)
    extra = F.array_except(keys, F.array(*map(F.lit, ("fingerprint_version", *SECTIONS))))
    version = F.get_json_object(json, "$.fingerprint_version").try_cast("int")
    fault = F.when(keys.isNull(), "not an object").when(version.isNull() | (version != VERSION), "version").when(F.size(extra) > 0, F.concat(F.lit("unknown "), F.array_join(F.array_sort(extra), ",")))
    return documents.withColumn("fault", fault)


#: Levels of documents that are opened before what is left is written.
OPENED = 5


def numeric_leaves(documents: DataFrame, key: str, json: str = "json") -> DataFrame:
    """(key, path, value): the finite numbers of JSON documents of any depth; paths name members and places in arrays.

    Booleans and texts aren't numbers. A null or malformed document has no leaves. Each round opens OPENED levels of all documents and
    is written once, until no object or array is left.
    """
    spark, out, first = documents.sparkSession, [], True
    level = documents.select(F.col(key).alias("doc"), F.lit("").alias("path"), F.try_parse_json(json).alias("v")).filter("v is not null")
    while True:
        for _ in range(OPENED):
            # A number stays as it is while objects and arrays beside it are opened: only rows of these have a place.
            opened = level.withColumnRenamed("v", "whole").lateralJoin(spark.tvf.variant_explode_outer(F.col("whole").outer()))
            name = F.coalesce("key", F.col("pos").cast("string"))
            path = F.when(F.col("pos").isNull(), F.col("path")).otherwise(name if first else F.concat("path", F.lit("/"), name))
            level = opened.select("doc", path.alias("path"), F.when(F.col("pos").isNull(), F.col("whole")).otherwise(F.col("value")).alias("v")).filter("v is not null")
            first = False
        level = level.withColumn("kind", F.schema_of_variant("v"))
        number = F.col("kind").isin("BIGINT", "DOUBLE", "FLOAT") | F.startswith("kind", F.lit("DECIMAL"))
        value = F.when(number, F.try_variant_get("v", "$", "double"))
        inner = (F.startswith("kind", F.lit("OBJECT")) | F.startswith("kind", F.lit("ARRAY"))) & ~F.to_json("v").isin("{}", "[]")
        # Variants can't be written as plain columns everywhere, so what is left goes on as JSON.
        level = cut(level.select("doc", "path", value.alias("value"), F.when(inner, F.to_json("v")).alias("rest")).filter("value is not null or rest is not null"))
        out.append(level.filter("value is not null and not isnan(value) and abs(value) != double('infinity')").select("doc", "path", "value"))
        left = level.filter("rest is not null")
        if not left.head(1):
            break
        level = left.select("doc", "path", F.parse_json("rest").alias("v"))
    leaves = out[0]
    for more in out[1:]:
        leaves = leaves.unionByName(more)
    return leaves.select(F.col("doc").alias(key), "path", "value")


def write_summaries(rows: DataFrame, path: str) -> None:
    """One JSON object a row."""
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.text(path)


ATLAS_DOCUMENT = "schema string, sample_count int, renderer struct<reproducible:boolean>, measurement_caveat string, dimensions array<string>, achievable_ranges map<string,struct<min:double,max:double>>, entries array<struct<settings:map<string,double>,fingerprint:string>>"


def atlas_faults(documents: DataFrame, key: str, json: str, schema: str, features: Sequence[str]) -> DataFrame:
    """(key, faults): every rule of an atlas that a document in JSON text breaks; none for a sound one.

    The rules: its schema, as many entries as it says, whether its renderer reproduces and what it says if not, unique
    dimensions, finite ranges of known features, and entries that set every dimension.
    """
    d = documents.select(key, F.from_json(json, ATLAS_DOCUMENT).alias("d")).select(key, "d.*")
    ranges = F.map_entries("achievable_ranges")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    sound = lambda e: finite(e["value"]["min"]) & finite(e["value"]["max"]) & (e["value"]["min"] <= e["value"]["max"])
    whole = lambda e: F.array_sort(F.map_keys(e["settings"])).eqNullSafe(F.array_sort("dimensions"))
    ok = lambda c: F.coalesce(c, F.lit(False))
    repeats = F.col("renderer.reproducible")
    rules = [
        ("schema", F.col("schema") == schema),
        ("sample count", F.size("entries") == F.col("sample_count")),
        ("renderer", repeats.isNotNull()),
        ("caveat", repeats.isNull() | repeats | (F.length("measurement_caveat") > 0)),
        ("dimensions", (F.size("dimensions") > 0) & (F.size(F.array_distinct("dimensions")) == F.size("dimensions"))),
        ("unknown feature", F.size(F.array_except(F.map_keys("achievable_ranges"), F.array(*map(F.lit, features)))) == 0),
        ("range", F.forall(ranges, lambda e: ok(sound(e)))),
        ("settings", F.forall("entries", lambda e: ok(whole(e)))),
    ]
    return d.select(key, F.array_compact(F.array(*(F.when(~ok(c), name) for name, c in rules))).alias("faults"))


def profiles(rows: DataFrame, json: str) -> DataFrame:
    """(profile, part, name, value): weights and scales of loss profiles in JSON text, as a table."""
    kind = "map<string,struct<weights:map<string,double>,scales:map<string,double>>>"
    one = rows.select(F.explode(F.from_json(json, kind)).alias("profile", "p"))
    part = lambda name: one.select("profile", F.lit(name).alias("part"), F.explode(f"p.{name}").alias("name", "value"))
    return part("weights").unionByName(part("scales"))


def same_provenance(runs: DataFrame, atlases: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, field, ran, measured) wherever a run's renderer isn't that of its atlas; null differs from a value."""
    both = runs.select(key, *(F.col(f).cast("string").alias(f"_a_{f}") for f in fields)).join(atlases.select(key, *(F.col(f).cast("string").alias(f"_b_{f}") for f in fields)), key)
    rows = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"_a_{f}").alias("ran"), F.col(f"_b_{f}").alias("measured")) for f in fields))
    return both.select(key, F.inline(rows)).filter("not (ran <=> measured)")
