"""Queries of the observed catalog kept up to date, and of signal paths in calibrations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import paths
from ..session import cut, delete_folder, new_folder
from ..sources import observed
from .tables import table

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


@query(
    """WITH e AS (SELECT CAST(l_orderkey AS VARCHAR) AS file, l_suppkey AS position, l_returnflag AS module, CAST(l_linenumber AS VARCHAR) AS key, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS value FROM lineitem),
s AS (SELECT module, key, value, count(DISTINCT file) AS files, min(struct_pack(f := file, p := position)) AS first FROM e GROUP BY ALL), n AS (SELECT module, key, count(DISTINCT file) AS all_files FROM e GROUP BY ALL)
SELECT module, key, value, files, first.f AS first_file, CAST(first.p AS BIGINT) AS first_position, all_files FROM s JOIN n USING (module, key)"""
)
def observed_catalog_kept(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as presets, merged into a catalog in three parts, one of them twice."""
    rows = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("file"), F.col("l_suppkey").alias("position"), F.col("l_returnflag").alias("module"), F.col("l_linenumber").cast("string").alias("key"), F.col("l_quantity").cast("long").cast("string").alias("value")
    )
    part = F.pmod(F.xxhash64("file"), F.lit(3))
    folder = new_folder(spark, "observed")
    for k in (2, 0, 1, 0):
        observed.merge(spark, folder, rows.filter(part == k))
    seen = observed.load(spark, folder).join(observed.load(spark, folder, "parameters").withColumnRenamed("files", "all_files"), ["module", "key"])
    out = cut(seen.select("module", "key", "value", "files", F.col("first.file").alias("first_file"), F.col("first.position").alias("first_position"), "all_files"))
    delete_folder(spark, folder)
    return out


_FAULTS = """WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS pack, p_size AS s FROM part), d AS (SELECT * FROM p WHERE s % 5 != 0),
faults AS (SELECT pack, 'lead' AS name, 'bands: unknown' AS rule, 'b0' AS detail FROM d WHERE s % 3 = 0 UNION ALL SELECT pack, 'lead', 'list repeats a control', 'bands' FROM d WHERE s % 3 = 1
UNION ALL SELECT pack, 'clean', 'volume: unknown', 'v0' FROM d WHERE s % 4 = 0 UNION ALL SELECT pack, unnest(['lead', 'clean']), 'output is not in dB', 'out' FROM d WHERE s % 7 = 0
UNION ALL SELECT pack, 'clean', 'setting: outside the range', 'drive' FROM d WHERE s > 40 UNION ALL SELECT pack, NULL, 'no signal path', NULL FROM p WHERE s % 5 = 0)"""


def _paths(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Parts as packs: most declare two paths, and their sizes say which rules these break."""
    part = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("pack"), F.col("p_size").alias("s"))
    text = """'{"output_gain_control": "out", "settings": {"drive": %d}, "signal_paths": {"lead": {"settings": {"drive": 7}, "eq_band_controls": ["b1", "b%d"]}, "clean": {"volume_control": "v%d"}}}'"""
    manifests = part.selectExpr("pack", f"CASE WHEN s % 5 != 0 THEN format_string({text}, s, s % 3, s % 4) END AS calibration", "CAST(map() AS map<string,string>) AS amps")
    specs = part.selectExpr("pack", "s", "explode(array('out', 'drive', 'b1', 'b2', 'v1', 'v2', 'v3')) AS path").selectExpr(
        "pack", "path", "'metered' AS kind", "CASE WHEN path = 'out' THEN CASE WHEN s % 7 = 0 THEN 'ms' ELSE 'dB' END END AS unit", "IF(path = 'drive', 0D, NULL) AS low", "IF(path = 'drive', 40D, NULL) AS high", "true AS writable", "false AS needs_review", "CAST(NULL AS STRING) AS encoding"
    )
    members = spark.createDataFrame([], "pack string, path string, member long, label string")
    return paths.signal_paths(manifests, specs, members)


@query(
    f"""{_FAULTS} SELECT * FROM (SELECT pack, 'lead' AS name, '7' AS drive, 'b1,b' || (s % 3) AS bands, NULL AS volume, 'out' AS output FROM d UNION ALL SELECT pack, 'clean', CAST(s AS VARCHAR), '', 'v' || (s % 4), 'out' FROM d)
WHERE pack NOT IN (SELECT pack FROM faults)"""
)
def declared_paths(spark: SparkSession, sf: str) -> DataFrame:
    """The paths of all packs whose calibration breaks no rule."""
    found, _ = _paths(spark, sf)
    return found.select("pack", "name", F.col("settings")["drive"].alias("drive"), F.array_join("bands", ",").alias("bands"), "volume", "output")


@query(f"{_FAULTS} SELECT * FROM faults")
def path_faults(spark: SparkSession, sf: str) -> DataFrame:
    """Every broken rule of every pack's calibration."""
    return _paths(spark, sf)[1]
