"""Mixing sources to target weights by Pfair scheduling.

Each source's documents are cut into blocks of equal bytes. With a weight w, block i of a source may run from slot
floor(i / w) and has to before slot ceil((i + 1) / w); of the blocks released, the one with the earliest deadline runs.
As the weights sum to one, every deadline is met, and after any number of slots a source deviates from its share by less
than one block. Weights are taken as they are: releases and deadlines are exact in whole numbers, and nothing repeats, so
no error builds up. When a source runs out, the weights of the others are scaled up and a new phase begins: all blocks are
placed. One task makes the schedule and passes it on as it goes; it holds a few numbers a source, at most.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice
from math import lcm

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import copies, documents, materialize

BLOCK_BYTES = 65_536
#: Bytes of texts of a part of a source in which positions are counted apart, and so many parts at least.
RANGE_BYTES, LEAST_RANGES = 256 << 20, 256
#: Blocks of the schedule that are written at once.
SLOTS = 65_536
#: Rows of the positions or of the schedule that may be broadcast; beyond it joins shuffle.
BROADCAST_ROWS = 500_000
#: Target weights where none are given: bytes of the source to this power.
TEMPERATURE = 0.5


def whole(weights: list[float]) -> list[int]:
    """Whole numbers in exactly the ratios of the weights."""
    if not all(0 < w < float("inf") for w in weights):
        raise ValueError("weights have to be positive")
    exact = [Fraction(w) for w in weights]
    scale = lcm(*(x.denominator for x in exact))
    return [int(x * scale) for x in exact]


def slots(blocks: list[int], weights: list[float]) -> Iterator[tuple[int, int, int, int]]:
    """(source, block, phase, phase's first slot) of every slot in turn, under earliest deadline first; sources by place.

    A phase begins anew with the sources that are left. Those that haven't had a slot in it are all released and stand in
    the order of their weights, so that a new phase only costs as much as the one before it had slots.
    """
    part = whole(weights)
    idle = [(-part[s], s) for s, n in enumerate(blocks) if n]
    heapq.heapify(idle)
    total, done, start, phase = sum(part[s] for _, s in idle), [0] * len(blocks), 0, 0
    while idle:
        first: dict[int, int] = {}
        ready: list[tuple[int, int]] = []
        later: list[tuple[int, int]] = []
        at = 0
        while True:
            while later and later[0][0] <= at:
                s = heapq.heappop(later)[1]
                heapq.heappush(ready, (-(-(done[s] - first[s] + 1) * total // part[s]), s))
            if idle and (not ready or (-(total // idle[0][0]), idle[0][1]) < ready[0]):
                s = heapq.heappop(idle)[1]
                first[s] = done[s]
            else:
                s = heapq.heappop(ready)[1]
            yield s, done[s], phase, start
            done[s] += 1
            at += 1
            if done[s] == blocks[s]:
                break
            heapq.heappush(later, ((done[s] - first[s]) * total // part[s], s))
        total -= part[s]
        start += at
        phase += 1
        for s in first:
            if done[s] < blocks[s]:
                heapq.heappush(idle, (-part[s], s))


def schedule(blocks: dict[str, int], weights: dict[str, float]) -> tuple[list[tuple], list[tuple]]:
    """Phases (source, phase, first block, end block, first slot, period, blocks per period) and periods (source, phase, r, offset).

    A small mix as a whole. A period is longer than its phase, in the source's exact share; blocks per period over period is
    the share.
    """
    names = sorted(blocks)
    placed: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for slot, (s, block, phase, start) in enumerate(slots([blocks[s] for s in names], [weights[s] for s in names])):
        placed.setdefault((phase, s), []).append((block, slot - start, start))
    left, phases, periods = {s for s in names if blocks[s]}, [], []
    starts = {phase: v[0][2] for (phase, _), v in placed.items()}
    done = dict.fromkeys(names, 0)
    for phase in sorted(starts):
        total = sum(Fraction(weights[s]) for s in left)
        for s in sorted(left):
            got = placed.get((phase, names.index(s)), [])
            per = blocks[s] + 1
            phases.append((s, phase, done[s], done[s] + len(got), starts[phase], per * total / Fraction(weights[s]), per))
            periods += [(s, phase, r, x) for r, (_, x, _) in enumerate(got)]
            done[s] += len(got)
        left -= {s for s in left if done[s] == blocks[s]}
    return phases, periods


def _placed(totals: DataFrame, weights: dict[str, float] | None, block_bytes: int) -> DataFrame:
    """The schedule (_id, block, phase, slot) of the sources in totals (_id, _source, bytes), written by one task."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, names, sizes = [], [], []
        for b in batches:
            ids += b.column("_id").to_pylist()
            names += b.column("_source").to_pylist()
            sizes += b.column("bytes").to_pylist()
        least = min(weights.values()) if weights else 0
        target = [weights.get(s, least) for s in names] if weights else [n**TEMPERATURE for n in sizes]
        order = sorted(range(len(names)), key=names.__getitem__)  # equal deadlines fall by name
        made = slots([-(-sizes[k] // block_bytes) for k in order], [target[k] for k in order])
        at = 0
        while part := list(islice(made, SLOTS)):
            source, block, phase, _ = zip(*part)
            columns = [pa.array([ids[order[s]] for s in source], pa.int64()), pa.array(block, pa.int64()), pa.array(phase, pa.int32()), pa.array(range(at, at + len(part)), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["_id", "block", "phase", "slot"])
            at += len(part)

    return totals.select("_id", "_source", "bytes").coalesce(1).mapInArrow(rows, "_id long, block long, phase int, slot long")


def _source(column: str) -> Column:
    """The label of a source; null is a source of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("null"))


def _sized(df: DataFrame, row: Column, source: str, key: str, text: str) -> DataFrame:
    """The written (row, key, hash, size, name): what a row is called, and what the mix needs to know of it; the text isn't carried."""
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")
    return materialize(df.select(row.alias("row"), F.col(key).alias("key"), F.xxhash64(text).alias("hash"), size.alias("size"), _source(source).alias("name")), "sized")


def _slots_of(sized: DataFrame, weights: dict[str | None, float] | None, block_bytes: int) -> DataFrame:
    """(row, name, block, phase, slot) for every row of _sized()."""
    total = sized.agg(F.sum("size")).first()[0] or 0
    ranges = max(LEAST_RANGES, total // RANGE_BYTES)
    sized = sized.withColumn("range", F.pmod(F.xxhash64("key", "size"), F.lit(ranges)))
    parts = materialize(sized.groupBy("name", "range").agg(F.sum("size").alias("bytes")), "parts")
    totals = parts.groupBy("name").agg(F.sum("bytes").alias("bytes")).withColumn("_id", F.monotonically_increasing_id())
    totals = materialize(totals.withColumnRenamed("name", "_source"), "totals")
    named = {"null" if s is None else f"={s}": float(w) for s, w in weights.items()} if weights else None
    placed = materialize(_placed(totals, named, block_bytes), "slots")
    small = lambda t: F.broadcast(t) if t.count() <= BROADCAST_ROWS else t
    before = parts.select("name", "range", (F.sum("bytes").over(W.partitionBy("name").orderBy("range")) - F.col("bytes")).alias("before"))
    before = materialize(before.join(small(totals.select(F.col("_source").alias("name"), "_id")), "name"), "before")
    within = F.sum("size").over(W.partitionBy("name", "range").orderBy("key", "size", "hash").rowsBetween(W.unboundedPreceding, W.currentRow))
    numbered = sized.withColumn("within", within).join(small(before), ["name", "range"]).withColumn("block", F.expr(f"(before + within - size) div {block_bytes}"))
    return numbered.join(small(placed), ["_id", "block"]).select("row", "name", "block", "phase", "slot")


def mix(df: DataFrame, weights: dict[str | None, float] | None = None, source: str = "source", key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Adds _source, block, phase and slot to every row of df (columns of these names are replaced); slot orders the mix.

    A block of a source holds the rows whose texts begin within its block_bytes of the source's bytes, in the order of a hash
    of the key; a longer text fills the slots after it. weights are positive and by source, where those that are not listed
    weigh as much as the least listed; null is a source. They hold for any number of sources, each with its own place. A null text counts as one byte. Empty tables give empty results.
    Other columns are kept, whatever their names.
    """
    kept = [c for c in df.columns if c not in ("_source", "block", "phase", "slot")]
    row = F.struct(*(F.col(f"`{c}`") for c in kept))
    placed = _slots_of(_sized(df, row, source, key, text), weights, block_bytes)
    return placed.select("row.*", F.col("name").alias("_source"), "block", "phase", "slot")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slot of every document in the mix of all sources, with weights by temperature."""
    docs = documents(spark, sf_dir)
    row = F.struct("doc_id", "source", F.octet_length("text").alias("bytes"))
    return _slots_of(_sized(docs, row, "source", "doc_id", "text"), None, BLOCK_BYTES).select("row.*", "block", "phase", "slot")


#: Metadata of the key column that names the written table of places.
PLACES = "tonelake.mix"


def placed_rows(docs: DataFrame) -> DataFrame:
    """The written places (doc_id, _hash, _copy, mix_slot) of the documents in the mix; _copy tells rows of one id and text apart."""
    row = F.struct("doc_id", F.xxhash64("text").alias("_hash"))
    placed = _slots_of(_sized(docs, row, "source", "doc_id", "text"), None, BLOCK_BYTES).select("row.*", F.col("slot").alias("mix_slot"))
    return materialize(placed.withColumn("_copy", copies("mix_slot")), "places")


def mixed(docs: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """The documents with their columns, in the order of the mix within each partition and from one to the next.

    places are those of placed_rows(docs). Null texts count as one byte, and a null source is a source of its own. Equal rows each
    have their place. An empty table gives no rows; columns of any names are kept as they are.
    """
    places = placed_rows(docs) if places is None else places
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    plain = [F.col(f"`{f.name}`") for f in docs.schema if not f.dataType.simpleString().startswith("map")]
    rows = docs.select(row.alias("row"), F.col("doc_id").alias("key"), F.xxhash64("text").alias("hash"), F.xxhash64(*plain).alias("content"))
    small = lambda t: F.broadcast(t) if t.count() <= BROADCAST_ROWS else t
    same = F.expr("key <=> doc_id and hash = _hash")
    twice = materialize(places.filter("_copy = 2").select("doc_id", "_hash"), "twice")
    if twice.head(1):
        one = rows.join(small(twice), same, "left_anti").withColumn("copy", F.lit(1))
        copy = F.row_number().over(W.partitionBy("key", "hash").orderBy("content"))
        rows = one.unionByName(rows.join(small(twice), same, "left_semi").withColumn("copy", copy))
        same = same & F.expr("copy = _copy")
    placed = rows.join(small(places), same).select("row", "mix_slot", "key")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    end = (places.agg(F.max("mix_slot")).first()[0] or 0) + 1
    # Slots are bytes, nearly, so that equal runs of them are parts of equal size: no sampling is needed to cut them.
    ordered = placed.repartitionById(n, F.expr(f"int(mix_slot * {n} div {end})")).sortWithinPartitions("mix_slot", "key")
    return ordered.select("row.*")


def with_places(docs: DataFrame) -> DataFrame:
    """mixed(docs), with the slots of the mix written as a table that the key column's metadata names.

    Parquet files keep the metadata, so that the slots reach later stages though the columns stay what they are.
    """
    placed = placed_rows(docs)
    (path,) = {f.rpartition("/")[0] for f in placed.inputFiles()} or {None}
    return mixed(docs, placed).withMetadata("doc_id", docs.schema["doc_id"].metadata | {PLACES: path})


def places(docs: DataFrame) -> DataFrame | None:
    """The written table (doc_id, _hash, _copy, mix_slot) of documents that with_places() mixed; None for others."""
    path = docs.schema["doc_id"].metadata.get(PLACES)
    return docs.sparkSession.read.parquet(path) if path else None
