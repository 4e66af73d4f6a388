"""The observed catalog as tables that are kept up to date: what values parameters take in presets, and how many hold them.

A catalog is a folder of versions. A merge writes the next version beside the last, and a marker last of all: readers see a
whole version or the one before it. One merge runs at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import delete_folder, new_folder

SIGHT = "struct<file:string,position:long>"
SCHEMAS = {
    "sights": f"module string, key string, value string, first {SIGHT}, files long",
    "parameters": "module string, key string, files long",
    "files": "file string",
}
DONE = "DONE"


def _versions(spark: SparkSession, folder: str) -> tuple[list[str], list[str]]:
    """Whole versions and unfinished ones, each from old to new."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted(s.getPath().toString() for s in fs.listStatus(path)) if fs.exists(path) else []
    whole = [v for v in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{v}/{DONE}"))]
    return whole, [v for v in found if v not in whole]


def _read(spark: SparkSession, version: str | None, name: str, lenient: bool = False) -> DataFrame:
    if version is None:
        return spark.createDataFrame([], SCHEMAS[name])
    return spark.read.schema(SCHEMAS[name]).option("ignoreCorruptFiles", lenient).parquet(f"{version}/{name}")


def load(spark: SparkSession, folder: str, name: str = "sights") -> DataFrame:
    """A table of the newest whole version: sights, parameters or files.

    sights: (module, key, value, first, files), first being the least (file, position) that holds the value. Empty where there is
    no catalog; the catalog only advises, so files that can't be read count as empty.
    """
    whole, _ = _versions(spark, folder)
    return _read(spark, whole[-1] if whole else None, name, lenient=True)


def index(spark: SparkSession, folder: str) -> DataFrame:
    """(module, key, value, first): the values of each parameter; ordered by first, they stand as they were first seen."""
    return load(spark, folder).select("module", "key", "value", "first")


def summary(spark: SparkSession, folder: str) -> DataFrame:
    """One row: how many parameters were seen, across how many presets."""
    each = load(spark, folder, "parameters").select(F.lit(1).alias("p"), F.lit(0).alias("f")).unionByName(load(spark, folder, "files").select(F.lit(0).alias("p"), F.lit(1).alias("f")))
    return each.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("parameters"), F.coalesce(F.sum("f"), F.lit(0)).alias("presets"))


def merge(spark: SparkSession, folder: str, entries: DataFrame) -> None:
    """Adds entries (file, position, module, key, value) to the catalog.

    A file is known by its name and counts once: one that an earlier merge took is left out, whatever it holds now, and repeated
    rows of one change nothing. So any split of files into merges gives the same catalog. Rows without a file or a key are left
    out; a null module is the top level, ''; null is a value of its own. The last version stays until the next merge.
    """
    whole, broken = _versions(spark, folder)
    last = whole[-1] if whole else None
    rows = entries.select(
        F.col("file").cast("string").alias("file"), F.col("position").cast("long").alias("position"), F.coalesce("module", F.lit("")).alias("module"), "key", F.col("value").cast("string").alias("value")
    ).filter("file is not null and key is not null")
    fresh = rows.join(_read(spark, last, "files"), "file", "left_anti")
    scratch = new_folder(spark, "held")
    fresh.groupBy("file", "module", "key", "value").agg(F.min("position").alias("position")).write.parquet(scratch)
    held = spark.read.schema("file string, module string, key string, value string, position long").parquet(scratch)
    sights = held.select("module", "key", "value", F.struct("file", "position").cast(SIGHT).alias("first"), F.lit(1).cast("long").alias("files"))
    parameters = held.select("file", "module", "key").distinct().select("module", "key", F.lit(1).cast("long").alias("files"))
    number = max((int(v.rsplit("/v", 1)[1]) for v in whole + broken), default=0) + 1
    new = f"{folder.rstrip('/')}/v{number:010d}"
    both = _read(spark, last, "sights").unionByName(sights)
    both.groupBy("module", "key", "value").agg(F.min("first").alias("first"), F.sum("files").alias("files")).write.parquet(f"{new}/sights")
    both = _read(spark, last, "parameters").unionByName(parameters)
    both.groupBy("module", "key").agg(F.sum("files").alias("files")).write.parquet(f"{new}/parameters")
    _read(spark, last, "files").unionByName(held.select("file").distinct()).write.parquet(f"{new}/files")
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{new}/{DONE}")
    marker.getFileSystem(spark._jsc.hadoopConfiguration()).create(marker, False).close()
    for old in [*broken, *whole[:-1], scratch]:
        delete_folder(spark, old)
