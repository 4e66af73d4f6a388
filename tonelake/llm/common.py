"""What the operators share: the shared work folder, bounded batches, size-checked joins, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Rows of one id column that may be broadcast (about 64 MB as a hash relation); beyond it joins shuffle.
BROADCAST_IDS = 1_000_000
#: Rows and bytes of a column that a Python worker turns into objects at once; one row may be longer.
PIECE_ROWS, PIECE_BYTES = 500, 8 << 20
#: Rows of one key from which a join takes the key apart from the others; keys with so many are few, so they are broadcast.
HEAVY = 1_000_000

_own_dir: str | None = None
#: Folders of written tables that nobody has deleted yet, oldest first.
_written: list[str] = []


def work_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; a temporary one only where none is set and the master is local."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    _own_dir = _own_dir or tempfile.mkdtemp(prefix="tonelake-")
    return f"file://{_own_dir}"


def new_path(spark: SparkSession, name: str) -> str:
    folder = f"{work_dir(spark)}/tonelake-{uuid.uuid4().hex}"
    _written.append(folder)
    return f"{folder}/{name}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back, which cuts the lineage there."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> int:
    """How many written tables stand in the list of this process."""
    return len(_written)


def delete_tables(spark: SparkSession, since: int = 0, keep: str = "") -> None:
    """Deletes the tables written since so many stood in the list, but for the one below the folder keep.

    Without arguments: all of this process, whose results may no longer be read then.
    """
    gone = [x for x in _written[since:] if x != keep]
    _written[since:] = [x for x in _written[since:] if x == keep]
    for folder in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def tidy(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator whose small result is written, after which the tables that it wrote on the way are deleted."""

    @wraps(operator)
    def run(df: DataFrame, *args, **kwargs) -> DataFrame:
        since = len(_written)
        out = materialize(operator(df, *args, **kwargs), operator.__name__)
        delete_tables(df.sparkSession, since, _written[-1])
        return out

    return run


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of the batches of at most PIECE_ROWS rows and PIECE_BYTES of the column (one row at least).

    Spark bounds a batch's bytes; what a worker makes of it as objects at once is bounded here, whatever the session's
    settings are. A batch without rows gives none.
    """
    for b in batches:
        values = b.column(column)
        if pa.types.is_string(values.type) or pa.types.is_binary(values.type):
            sizes = pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
        else:
            sizes = np.full(b.num_rows, values.nbytes // max(1, b.num_rows))
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < b.num_rows:
            to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE_BYTES, "right"))
            to = min(max(to, at + 1), at + PIECE_ROWS)
            yield b.slice(at, min(to, b.num_rows) - at)
            at = to


def by_ids(df: DataFrame, ids: DataFrame, key: str, how: str) -> DataFrame:
    """left_semi or left_anti join of df with a written table of ids (one column named key).

    The ids are broadcast only if there are at most BROADCAST_IDS of them, else both sides shuffle.
    """
    n = ids.count()
    if n == 0:
        return df if how == "left_anti" else df.limit(0)
    return df.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, key, how)


def copies(order: str) -> Column:
    """Numbers rows of one doc_id and one _hash of the text from 1, so that repeated rows can be told apart."""
    return F.row_number().over(W.partitionBy("doc_id", "_hash").orderBy(order))


def with_heavy(rows: DataFrame, by: DataFrame, key: str) -> DataFrame:
    """rows joined with the written table by (key, n, ...), where n is a key's number of rows.

    Keys of more than HEAVY rows are joined by broadcast, so that none of them meets in one task; there are at most as many
    as rows over HEAVY.
    """
    heavy = by.filter(F.col("n") > HEAVY)
    if not heavy.head(1):
        return rows.join(by.drop("n"), key)
    light = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(by.filter(F.col("n") <= HEAVY).drop("n"), key)
    return rows.join(F.broadcast(heavy.drop("n")), key).unionByName(light)


@tidy
def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of the undirected edges; component is its smallest node.

    Alternates large-star and small-star contraction until every node points at its root. Each round only aggregates a
    minimum per node and joins it back; a node with more than HEAVY neighbours, like the root of a giant component, is
    joined by broadcast, so that no node's neighbours meet in one task.
    Null ends and loops are ignored. An empty edge table gives an empty result.
    """
    e = (
        edges.filter((F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
        .distinct()
    )
    since = len(_written)
    e = materialize(e, "edges")
    seen, size = None, e.count()

    def least_of(rows: DataFrame, key: str, value: Column) -> DataFrame:
        found = rows.groupBy(key).agg(value.alias("m"), F.count("*").alias("n"))
        return materialize(found, "minima") if size > HEAVY else found

    def joined(rows: DataFrame, least: DataFrame, key: str) -> DataFrame:
        return with_heavy(rows, least, key) if size > HEAVY else rows.join(least.drop("n"), key)

    while True:
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = least_of(both, "u", F.least(F.min("v"), F.col("u")))
        large = joined(both.filter("v > u"), least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = materialize(large, "large") if size > HEAVY else large
        root = least_of(large, "hi", F.min("lo"))
        small = (
            joined(large, root, "hi")
            .filter("lo != m")
            .select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .unionByName(root.select("hi", F.col("m").alias("lo")))
            .distinct()
        )
        e = materialize(small, "edges")
        state = e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        delete_tables(e.sparkSession, since, _written[-1])
        if state == seen:
            break
        seen, size = state, state[0]
    nodes = e.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return nodes.unionByName(nodes.select(F.col("component").alias("node"), "component").distinct())


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
