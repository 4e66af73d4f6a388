"""Hard negatives by norm-bucketed search.

Candidates stand in descending order of their norms and are cut into buckets. By Cauchy-Schwarz no score in a bucket is above
the product of the anchor's norm and the bucket's largest one. A bucket is left out where that lies below all that an anchor
still looks for: the lower limit of each of its windows or, once a window has its rows, the least of their scores. Windows
are searched twice over: for positives, a window without limits among rows of the same label; for negatives, a window of
scores for each positive among rows of other labels.

Anchors lie in tiles, buckets in stretches; a task holds one tile and streams one stretch. The first stretches, of the
longest vectors, are searched first, and what they give raises the limits by which tiles and stretches are then paired.
Scores are whole numbers: components are scaled and rounded down, and products are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import prepare
from .common import BROADCAST_IDS, materialize, pieces, tidy

#: Components times SCALE, rounded down, are what is multiplied.
SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: A negative's score in hundredths of the positive's.
LOW, HIGH = 50, 95
#: Vectors and bytes of a bucket and of a tile at most (one vector at least), and buckets of a stretch.
BUCKET, BUCKET_BYTES, TILE, TILE_BYTES, STRETCH = 512, 1 << 18, 2048, 1 << 22, 32
#: Anchors whose scores with a bucket are held at once.
HELD = 256
LEAST, MOST = -(2**63) + 2, 2**63 - 1


def scaled(vector: list[float], scale: int) -> np.ndarray:
    """Components times scale, rounded down, as whole doubles; a product beyond the doubles is the largest double."""
    with np.errstate(over="ignore"):
        return np.nan_to_num(np.floor(np.array(vector, np.float64) * scale))


def packed(v: np.ndarray) -> bytes:
    return (v.astype(np.int16) if not len(v) or np.abs(v).max() < 2**15 else v).tobytes()


def unpacked(data: list[bytes], d: int) -> np.ndarray:
    """Rows of packed() vectors, as doubles."""
    if not d:
        return np.zeros((len(data), 0))
    if all(len(x) == 2 * d for x in data):
        return np.frombuffer(b"".join(data), np.int16).reshape(-1, d).astype(np.float64)
    return np.array([np.frombuffer(x, np.int16 if len(x) == 2 * d else np.float64) for x in data], np.float64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole doubles; those beyond a long are held at its ends."""
    if not a.size or not b.size or np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2**53:
        return (a @ b.T).astype(np.int64)
    x = np.array([[int(v) for v in r] for r in a], object) @ np.array([[int(v) for v in r] for r in b], object).T
    return np.clip(x, LEAST, MOST).astype(np.int64)


def usable(vectors: DataFrame, scale: int) -> DataFrame:
    """The written (vec_id, label, d, norm, data) of the rows that take part; norms are rounded up."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "embedding"):
            out: list[tuple] = []
            for i, label, v in zip(*(b.column(c).to_pylist() for c in ("vec_id", "label", "embedding")), strict=True):
                if any(x is None for x in v) or not np.isfinite(v).all():
                    continue
                x = scaled(v, scale)
                with np.errstate(over="ignore"):
                    out.append((i, label, len(x), float(np.sqrt(x @ x)) * (1 + 1e-9), packed(x)))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out) if out else [()] * 5, _ROW, strict=True)], ["vec_id", "label", "d", "norm", "data"])

    chosen = vectors.filter("vec_id is not null and label is not null and embedding is not null")
    chosen = chosen.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col("embedding").cast("array<double>"))
    return materialize(chosen.mapInArrow(rows, "vec_id long, label string, d int, norm double, data binary"), "vectors")


_ROW = [pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.binary()]


def _blocks(rows: DataFrame, key: list, most: int, most_bytes: int, columns: list[str]) -> DataFrame:
    """Runs of rows of one group and length, in the order of the key, as rows of arrays; part and n number them."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, "group", "d", *key).sortWithinPartitions("group", "d", *key).select("group", "d", *columns)
    schema = ", ".join(["part int, n long, group string, d int", *(f"{c} array<{rows.schema[c].dataType.simpleString()}>" for c in columns)])
    types = pa.schema([("part", pa.int32()), ("n", pa.int64()), ("group", pa.string()), ("d", pa.int32()), *((c, pa.list_(_ARROW[rows.schema[c].dataType.simpleString()])) for c in columns)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held, rows = TaskContext.get().partitionId(), 0, None, []

        def closed() -> pa.RecordBatch:
            nonlocal made, rows
            out = {"part": part, "n": made, "group": held[0], "d": held[1], **{c: [r[k] for r in rows] for k, c in enumerate(columns, 2)}}
            made, rows = made + 1, []
            return pa.RecordBatch.from_pylist([out], schema=types)

        for b in pieces(batches, "data"):
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if rows and (held != r[:2] or len(rows) >= max(1, min(most, most_bytes // (8 * max(1, r[1]))))):
                    yield closed()
                held = r[:2]
                rows.append(r)
        if rows:
            yield closed()

    return materialize(ordered.mapInArrow(cut, schema), "blocks")


_WINDOWS = "array<struct<key:bigint,lo:bigint,hi:bigint>>"
_ARROW = {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64(), "binary": pa.binary(), _WINDOWS: pa.list_(pa.struct([("key", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())]))}


def buckets_of(vectors: DataFrame, group: Column) -> DataFrame:
    """(group, d, stretch, at, top, vec_id, label, data): buckets by descending norm, numbered within their group and length."""
    rows = vectors.withColumn("group", group)
    made = _blocks(rows, [F.desc("norm"), "vec_id"], BUCKET, BUCKET_BYTES, ["vec_id", "label", "norm", "data"])
    made = made.withColumn("top", F.array_max("norm")).drop("norm")
    order = W.partitionBy("group", "d").orderBy(F.desc("top"), "part", "n")  # a row for each bucket, without its vectors
    places = materialize(made.select("part", "n", "group", "d", "top").withColumn("at", F.row_number().over(order) - 1).select("part", "n", "at"), "places")
    return materialize(made.join(places, ["part", "n"]).withColumn("stretch", F.expr(f"at div {STRETCH}")).drop("part", "n"), "buckets")


class _Tile:
    """Anchors with their windows, and the best rows of each window among the buckets met so far."""

    def __init__(self, d: int, ids: list, labels: list, norms: list, data: list, windows: list, k: int, same: bool):
        self.d, self.k, self.same = d, k, same
        self.vectors, self.ids, self.labels, self.norms = unpacked(data, d), np.array(ids, np.int64), labels, np.array(norms)
        flat = [(of, w["key"], w["lo"], w["hi"]) for of, ws in enumerate(windows) for w in ws]
        self.of, self.keys, self.lo, self.hi = (np.array(c, np.int64) for c in zip(*flat, strict=True))
        self.first = np.searchsorted(self.of, np.arange(len(ids)))
        self.scores = np.full((len(flat), k), LEAST - 1, np.int64)
        self.found = np.full((len(flat), k), MOST, np.int64)

    def meet(self, top: float, ids: list, labels: list, data: list) -> None:
        least = np.maximum(self.lo, self.scores[:, -1])
        live = self.norms * top >= np.minimum.reduceat(least, self.first).astype(np.float64) * (1 - 1e-12)
        if not live.any():
            return
        codes = {x: k for k, x in enumerate(set(labels))}
        there, own = np.array([codes[x] for x in labels]), np.array([codes.get(x, -1) for x in self.labels])
        ids_, vectors = np.array(ids, np.int64), unpacked(data, self.d)
        live = np.flatnonzero(live)
        for at in range(0, len(live), HELD):
            part = live[at : at + HELD]
            w = np.flatnonzero(np.isin(self.of, part))
            row = np.searchsorted(part, self.of[w])
            scores = products(self.vectors[part], vectors)[row]
            may = (own[self.of[w], None] == there) if self.same else (own[self.of[w], None] != there)
            may &= (self.ids[self.of[w], None] != ids_) & (scores >= least[w, None]) & (scores <= self.hi[w, None])
            x, y = np.nonzero(may)
            if len(x):
                self._keep(w[x], scores[x, y], ids_[y])

    def _keep(self, w: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        changed = np.unique(w)
        w = np.concatenate((w, np.repeat(changed, self.k)))
        scores, ids = np.concatenate((scores, self.scores[changed].ravel())), np.concatenate((ids, self.found[changed].ravel()))
        order = np.lexsort((ids, -scores, w))
        w, scores, ids = w[order], scores[order], ids[order]
        begin = np.searchsorted(w, changed)
        take = begin[:, None] + np.arange(self.k)  # each window has k rows at least: those that it had
        self.scores[changed], self.found[changed] = scores[take], ids[take]

    def rows(self) -> pa.RecordBatch:
        w, k = np.nonzero(self.scores >= LEAST)
        return pa.RecordBatch.from_arrays([pa.array(self.keys[w]), pa.array(self.found[w, k]), pa.array(self.scores[w, k])], ["key", "vec_id", "score"])


def _searched(anchors: DataFrame, windows: DataFrame, buckets: DataFrame, k: int, same: bool, stretches: str) -> DataFrame:
    """(key, vec_id, score): up to k rows for each window and stretch of those named."""
    spark = anchors.sparkSession
    need = F.when(F.col("least") <= 0, F.lit(float("-inf"))).otherwise(F.col("least") / F.col("norm"))
    queries = windows.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("key", "lo", "hi"))).alias("windows"), F.min("lo").alias("least"))  # a few each
    queries = anchors.join(queries, "anchor").withColumn("need", need).withColumn("group", F.col("label") if same else F.lit(""))
    tiles = _blocks(queries, ["need", "anchor"], TILE, TILE_BYTES, ["vec_id", "label", "norm", "data", "windows", "need"])
    tiles = tiles.select("group", "d", F.expr("shiftleft(bigint(part), 40) + n").alias("tile"), F.array_min("need").alias("need"), "vec_id", "label", "norm", "data", "windows")
    ends = buckets.filter(stretches).groupBy("group", "d", "stretch").agg(F.max("top").alias("top"))
    heads = materialize(tiles.select("group", "d", "tile", "need"), "tile_heads")
    heads = F.broadcast(heads) if heads.count() <= BROADCAST_IDS else heads
    pairs = materialize(ends.join(heads, ["group", "d"]).filter("top >= need").select("group", "d", "stretch", "tile"), "tiles_by_stretch")
    none = lambda kind: F.lit(None).cast(kind)
    columns = ["tile", "stretch", "kind", "at", "d", "top", "vec_id", "label", "norm", "data", "windows"]
    held = pairs.select("tile", "stretch").join(tiles, "tile").withColumns({"kind": F.lit(0), "at": F.lit(0), "top": none("double")}).select(*columns)
    streamed = pairs.join(buckets, ["group", "d", "stretch"]).withColumns({"kind": F.lit(1), "norm": none("array<double>"), "windows": none(f"array<{_WINDOWS}>")}).select(*columns)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = held.unionByName(streamed).repartition(n, "tile", "stretch").sortWithinPartitions("tile", "stretch", "kind", "at").drop("kind", "at")

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, key = None, None
        for batch in pieces(batches, "data"):
            for t, s, d, top, ids, labels, norms, data, windows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (t, s):
                    if tile:
                        yield tile.rows()
                    tile, key = _Tile(d, ids, labels, norms, data, windows, k, same), (t, s)
                else:
                    tile.meet(top, ids, labels, data)
        if tile:
            yield tile.rows()

    return materialize(both.mapInArrow(met, "key long, vec_id long, score long"), "found")


def search(anchors: DataFrame, windows: DataFrame, buckets: DataFrame, k: int, same: bool) -> DataFrame:
    """The written (key, rank, vec_id, score): the first k rows of each window, by descending score, then by id.

    anchors: (anchor, vec_id, label, d, norm, data). windows: (key, anchor, lo, hi), scores from lo to hi. same: whether rows of the
    anchor's label are looked for, or of other labels. A row never meets rows of its own id.
    """
    found = _searched(anchors, windows, buckets, k, same, "stretch = 0")
    if buckets.filter("stretch > 0").head(1):
        full = found.groupBy("key").agg(F.min("score").alias("kth"), F.count("*").alias("n")).filter(f"n = {k}").select("key", "kth")
        left = materialize(windows.join(full, "key", "left").select("key", "anchor", F.greatest("lo", "kth").alias("lo"), "hi"), "windows")
        found = found.unionByName(_searched(anchors, left, buckets, k, same, "stretch > 0"))
    rank = F.row_number().over(W.partitionBy("key").orderBy(F.desc("score"), "vec_id"))  # k rows a stretch at most
    return materialize(found.withColumn("rank", rank).filter(f"rank <= {k}").select("key", "rank", "vec_id", "score"), "best")


@tidy
def hard_negatives(vectors: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for vectors (vec_id, embedding, label).

    anchors says which rows are anchors. An anchor's positives are its best-scored other rows of the same label; a positive's
    negatives are the best-scored rows of other labels whose scores are from low to high hundredths of the positive's. Equal scores
    fall by smaller id. Rows with a null id, label or vector, or with a null or non-finite component, take no part.
    Vectors of different lengths don't meet, and empty ones score 0. Rows that repeat an id are rows of their own that
    don't meet each other. Scores beyond a long are held at its ends. Extra columns are ignored. An empty table, an anchor without
    positives and a positive without negatives give no rows.
    """
    prepare(vectors.sparkSession)
    rows = usable(vectors, scale)
    chosen = materialize(rows.filter(anchors).withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    every = chosen.select(F.col("anchor").alias("key"), "anchor", F.lit(LEAST).alias("lo"), F.lit(MOST).alias("hi"))
    best = search(chosen, every, buckets_of(rows, F.col("label")), positives, True)
    exact = F.col("score").cast("decimal(38,0)")
    limits = {"lo": F.ceil(exact * low / 100).cast("long"), "hi": F.floor(exact * high / 100).cast("long")}
    pairs = best.select(F.col("key").alias("anchor"), F.col("vec_id").alias("positive_id"), "score", *(c.alias(x) for x, c in limits.items()))
    pairs = materialize(pairs.withColumn("key", F.monotonically_increasing_id()), "pairs")
    wanted = materialize(pairs.filter("lo <= hi").select("key", "anchor", "lo", "hi"), "wanted")
    found = search(chosen, wanted, buckets_of(rows, F.lit("")), negatives, False)
    named = pairs.join(chosen.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor").select("key", "anchor_id", "positive_id", F.col("score").alias("positive_score"))
    out = found.select("key", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(named, "key")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives for every embedding whose id is divisible by 50, with the labels of ids divisible by 7 moved on by one."""
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("label", moved), F.col("vec_id") % 50 == 0)
