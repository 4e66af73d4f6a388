"""Reading tables, and the roles that their columns play for the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as trials: a run per user, errors and views as failed and silent, the property k as the replicate."""
    k = F.get_json_object("props", "$.k").try_cast("int")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run"), F.col("event_id").alias("trial"), F.col("value").alias("score"), (F.col("event_type") == "error").alias("error"), (F.col("event_type") == "view").alias("silent"), F.col("event_type").alias("kind"), k.alias("k"), "ts"
    )


#: The same in SQL, for use as a common table expression.
TRIALS = "trials AS (SELECT user_id AS run, event_id AS trial, value AS score, event_type = 'error' AS error, event_type = 'view' AS silent, event_type AS kind, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, ts FROM events)"


def line_order() -> list[str]:
    """Columns that tell lines apart: (l_orderkey, l_linenumber) repeats."""
    return ["l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus"]
