"""A corpus pipeline of five stages over documents; see STAGES."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.llm.common import by_ids, delete_tables, documents, materialize, new_path, written
from tonelake.llm.decontamination import without_leaks
from tonelake.llm.mixing import places, with_places
from tonelake.llm.ngram_join import similar_components
from tonelake.llm.sharding import shard_mixed
from tonelake.llm.toxicity import without_toxic

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the severity model rejects.

    Null and empty texts and rows with a null id stay; an id that repeats goes with any of its rows. Without labels of both
    classes, or without rows, nothing is dropped.
    """
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: that with the smallest id.

    Rows with a null id stay, and so do null and empty texts, but for rows that repeat an id: of those the one stays whose text
    comes first, then whose other columns do.
    """
    found = materialize(similar_components(docs.select("doc_id", "text")), "components")
    gone = materialize(found.filter("doc_id != component_id").select("doc_id").distinct(), "gone")
    kept = by_ids(docs, gone, "doc_id", "left_anti")
    repeated = materialize(found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated")
    if not repeated.head(1):
        return kept
    first = F.min(F.struct("text", *(c for c in docs.columns if c not in ("doc_id", "text")))).alias("first")
    once = by_ids(kept, repeated, "doc_id", "left_semi").groupBy("doc_id").agg(first).select("doc_id", "first.*").select(*docs.columns)
    return by_ids(kept, repeated, "doc_id", "left_anti").unionByName(once)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item.

    Null and empty texts and rows with a null id stay; an id that repeats goes with any of its rows. Without items nothing is
    dropped.
    """
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix of their sources, and a written table of their slots in it.

    A null source is a source, a null text a byte; repeated rows each have their place; no rows give none.
    """
    return with_places(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every document, slots in the order of the mix.

    Null texts are of size 1 with a null text_crc32; repeated rows each have their slot; no rows give none.
    """
    return shard_mixed(docs, places(docs))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: The first stage fits a model, so SQL can't give the rows of run().
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; each stage's rows are written and read again, and deleted once the last stage's are written."""
    since = written()
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        path = new_path(spark, name)
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
    delete_tables(spark, since, path.rpartition("/")[0])
    return docs
