"""Near duplicates among embeddings by an epsilon grid order join.

Unit vectors of a cosine of at least c are at most epsilon = sqrt(2 - 2c) apart, in any orthonormal projection too. Vectors
stand in the order of their epsilon cells on the leading principal directions, within their label, and are cut into blocks
of consecutive vectors. Intervals of blocks are joined recursively, level by level: a pair of intervals whose bounding boxes
are more than epsilon apart is dropped, any other is split, until pairs of blocks are left and compared by matrix products.
A box has a side for each direction and one for the length of what the directions leave out, as the lengths of two
vectors' remainders differ by no more than the remainders lie apart. The directions are fitted on a bounded sample; they only
decide how much is skipped, never what links. Pairs are compared by tiles: a task holds the few blocks of a tile and streams
the blocks that stand against them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import prepare
from .common import connected_components, materialize, pieces, tidy

COSINE = 0.98
#: Principal directions, those of them that order the vectors, and the numbers that the fitted sample may hold.
DIRECTIONS, CELLS, SAMPLE_NUMBERS = 12, 6, 1_000_000
#: Vectors and bytes that a block holds at most, and intervals that an interval is split into.
BLOCK, BLOCK_BYTES, FANOUT = 512, 1 << 17, 4
#: Blocks of a tile, and blocks in a row of which those against a tile are compared by one task.
TILE, STRETCH = 8, 512


def directions(vectors: np.ndarray) -> np.ndarray:
    """Leading principal directions (rows, orthonormal) of unit vectors; the first axes where there are none."""
    d = vectors.shape[1]
    if len(vectors) < 2:
        return np.eye(d)[: min(d, DIRECTIONS)]
    _, _, vt = np.linalg.svd(vectors - vectors.mean(0), full_matrices=False)
    return vt[: min(d, DIRECTIONS)]


def unit(vector: list | None) -> np.ndarray | None:
    """A vector scaled to length 1 in double precision; None if it is null, empty, zero or holds null or non-finite numbers."""
    if not vector or any(x is None for x in vector):
        return None
    v = np.array(vector, np.float64)
    if not np.isfinite(v).all() or not v.any():
        return None
    v = v / np.abs(v).max()
    return v / math.sqrt(v @ v)


def fitted(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Directions for the most frequent length, from a bounded sample: the smallest hashes of the ids."""
    size = vectors.groupBy("d").count().orderBy(F.desc("count"), "d").first()
    if not size or not size.d:
        return {}
    sample = vectors.filter(F.col("d") == size.d).orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(2, SAMPLE_NUMBERS // size.d)).collect()
    units = [u for r in sample if (u := unit(r.embedding)) is not None]
    return {size.d: directions(np.array(units))} if units else {}


def blocks_of(vectors: DataFrame, epsilon: float) -> DataFrame:
    """(part, n, label, d, lo, hi, ids, data): blocks in grid order, with their boxes and unit vectors as doubles."""
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(fitted(vectors))
    cells = [f"c{k}" for k in range(CELLS)]

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basis = shared.value
        for b in pieces(batches, "embedding"):
            rows = [(i, lab, u) for i, lab, v in zip(*(b.column(c).to_pylist() for c in ("vec_id", "label", "embedding")), strict=True) if (u := unit(v)) is not None]
            grid = np.zeros((len(rows), CELLS), np.int32)
            for k, (_, _, u) in enumerate(rows):
                p = (basis[len(u)] @ u if len(u) in basis else u)[:CELLS]
                grid[k, : len(p)] = np.floor(p / epsilon)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([len(r[2]) for r in rows], pa.int32())]
                + [pa.array(grid[:, k]) for k in range(CELLS)]
                + [pa.array([r[2].tobytes() for r in rows], pa.binary())],
                ["vec_id", "label", "d", *cells, "data"],
            )

    schema = f"vec_id long, label string, d int, {', '.join(f'{c} int' for c in cells)}, data binary"
    ordered = vectors.select("vec_id", "label", "embedding").mapInArrow(projected, schema)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = ["label", "d", *cells, "vec_id"]
    ordered = materialize(ordered, "projected").repartitionByRange(n, *key).sortWithinPartitions(*key)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basis, part, made, held, ids = shared.value, TaskContext.get().partitionId(), 0, None, []

        def closed(group: tuple, ids: list[int], data: list[bytes]) -> pa.RecordBatch:
            nonlocal made
            u = np.frombuffer(b"".join(data)).reshape(len(ids), group[1])
            p = u @ basis[group[1]].T if group[1] in basis else u[:, :DIRECTIONS]
            p = np.column_stack((p, np.sqrt(np.maximum(0, 1 - (p * p).sum(1)))))
            row = {"part": part, "n": made, "label": group[0], "d": group[1], "lo": p.min(0).tolist(), "hi": p.max(0).tolist(), "ids": ids, "data": u.tobytes()}
            made += 1
            return pa.RecordBatch.from_pylist([row], schema=_BLOCK)

        data: list[bytes] = []
        for b in batches:
            for i, label, d, v in zip(*(b.column(c).to_pylist() for c in ("vec_id", "label", "d", "data")), strict=True):
                if ids and (held != (label, d) or len(ids) >= max(1, min(BLOCK, BLOCK_BYTES // (8 * d)))):
                    yield closed(held, ids, data)
                    ids, data = [], []
                held = (label, d)
                ids.append(i)
                data.append(v)
        if ids:
            yield closed(held, ids, data)

    return materialize(ordered.select("vec_id", "label", "d", "data").mapInArrow(blocks, "part int, n long, label string, d int, lo array<double>, hi array<double>, ids array<long>, data binary"), "blocks")


_BLOCK = pa.schema(
    [("part", pa.int32()), ("n", pa.int64()), ("label", pa.string()), ("d", pa.int32()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64())), ("ids", pa.list_(pa.int64())), ("data", pa.binary())]
)


def close_blocks(blocks: DataFrame, epsilon: float) -> DataFrame:
    """(p, q) pairs of block numbers, p <= q, whose boxes are at most epsilon apart, by recursion over intervals."""
    reach = epsilon + 1e-6
    apart = f"aggregate(zip_with(zip_with(lo, hi2, (x, y) -> x - y), zip_with(lo2, hi, (x, y) -> x - y), (x, y) -> greatest(x, y, double(0))), double(0), (s, x) -> s + x * x) <= {reach * reach!r}"
    total = blocks.count()
    levels = 0
    while FANOUT**levels < total:
        levels += 1
    parts = None
    for level in range(levels, -1, -1):
        sides = blocks.select("label", "d", F.expr(f"seq div {FANOUT**level}").alias("node"), F.expr(f"seq div {FANOUT ** (level + 1)}").alias("parent"), F.posexplode(F.arrays_zip("lo", "hi")).alias("k", "x"))
        sides = sides.groupBy("label", "d", "node", "parent", "k").agg(F.min("x.lo").alias("lo"), F.max("x.hi").alias("hi"))
        nodes = sides.groupBy("label", "d", "node", "parent").agg(F.sort_array(F.collect_list(F.struct("k", "lo", "hi"))).alias("box")).select("label", "d", "node", "parent", F.col("box.lo").alias("lo"), F.col("box.hi").alias("hi"))
        nodes = materialize(nodes, f"level{level}")
        other = nodes.select("label", "d", F.col("node").alias("node2"), F.col("parent").alias("parent2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
        if parts is None:
            both = nodes.join(other, ["label", "d"])  # one node for each label at the top
        else:
            both = parts.join(nodes, (F.col("p") == F.col("parent")) & (parts.label == nodes.label) & (parts.d == nodes.d)).select("q", nodes.label, nodes.d, "node", "lo", "hi")
            both = both.join(other, (F.col("q") == F.col("parent2")) & (both.label == other.label) & (both.d == other.d)).select(both.label, both.d, "node", "node2", "lo", "hi", "lo2", "hi2")
        parts = materialize(both.filter("node <= node2").filter(apart).select("label", "d", F.col("node").alias("p"), F.col("node2").alias("q")), f"pairs{level}")
    return parts


def linked(a_ids: list, a: np.ndarray, b_ids: list, b: np.ndarray, same: bool, cosine: float) -> tuple[list, list, list]:
    """Ids with links between two blocks, the number of their links, and the least id of their component in this pair."""
    hit = a @ b.T >= cosine
    if same:
        np.fill_diagonal(hit, False)
    if not hit.any():
        return [], [], []
    x, y = np.array(a_ids), np.array(b_ids)
    far = np.iinfo(np.int64).max
    while True:
        to_x = np.minimum(x, np.where(hit, y, far).min(1))
        to_y = np.minimum(y, np.where(hit.T, to_x, far).min(1))
        if same:
            to_x = to_y = np.minimum(to_x, to_y)
        if (to_x == x).all() and (to_y == y).all():
            break
        x, y = to_x, to_y
    sides = [(a_ids, hit.sum(1), x)] + ([] if same else [(b_ids, hit.sum(0), y)])
    rows = [(i, int(n), int(r)) for ids, ns, rs in sides for i, n, r in zip(ids, ns, rs, strict=True) if n]
    return tuple(list(c) for c in zip(*rows, strict=True))


def links(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n, root) for each vector and pair of blocks in which it links; written."""
    spark = vectors.sparkSession
    prepare(spark)
    epsilon = math.sqrt(2 - 2 * cosine)
    blocks = blocks_of(vectors, epsilon)
    sizes = blocks.groupBy("part").agg(F.count("*").alias("size"))
    first = sizes.select("part", (F.sum("size").over(W.orderBy("part")) - F.col("size")).alias("first"))  # a row for each partition
    blocks = materialize(blocks.join(F.broadcast(first), "part").withColumn("seq", F.col("first") + F.col("n")), "numbered")
    pairs = close_blocks(blocks.select("label", "d", "seq", "lo", "hi"), epsilon)
    data = blocks.select(F.col("seq").alias("at"), "d", "ids", "data")
    against = pairs.groupBy(F.expr(f"p div {TILE}").alias("tile"), F.col("q").alias("at")).agg(F.collect_list("p").alias("ps"))  # at most TILE
    against = materialize(against.withColumn("stretch", F.expr(f"at div {STRETCH}")), "tiles")
    tiles = against.select("tile", "stretch", F.explode("ps").alias("at")).distinct()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = tiles.join(data, "at").select("tile", "stretch", F.lit(0).alias("kind"), "at", F.lit(None).cast("array<long>").alias("ps"), "d", "ids", "data")
    streamed = against.join(data, "at").select("tile", "stretch", F.lit(1).alias("kind"), "at", "ps", "d", "ids", "data")
    both = held.unionByName(streamed).repartition(n, "tile", "stretch").sortWithinPartitions("tile", "stretch", "kind", "at")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, key = {}, None
        for batch in pieces(batches, "data"):
            for tile, stretch, kind, at, ps, d, ids, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (tile, stretch):
                    blocks, key = {}, (tile, stretch)
                v = np.frombuffer(packed).reshape(-1, d)
                if kind == 0:
                    blocks[at] = ids, v
                    continue
                for p in ps:
                    out = linked(*blocks[p], ids, v, p == at, cosine)
                    if out[0]:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["vec_id", "n", "root"])

    return materialize(both.mapInArrow(compared, "vec_id long, n long, root long"), "links")


@tidy
def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors (vec_id, embedding, label).

    Vectors link if their labels and lengths are equal and their cosine, in double precision, is at least the given one. A null
    label, and a vector that is null, empty, zero or holds null or non-finite numbers, link with nothing. Rows that repeat
    an id are vectors of their own that share its counts; a null id links with nothing and isn't kept. Extra columns are
    ignored. An empty table gives no rows.
    """
    usable = vectors.filter("vec_id is not null and label is not null and embedding is not null")
    usable = usable.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col("embedding").cast("array<double>"), F.size("embedding").alias("d"))
    found = links(usable, cosine)
    counts = found.groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    component = connected_components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    out = vectors.select(F.col("vec_id").cast("long")).join(counts, "vec_id", "left").join(component.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near duplicates among all embeddings."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
