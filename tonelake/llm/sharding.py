"""Sharding by a minimax contiguous partition of content groups.

Documents with equal texts form one atomic group. Groups stand in the order of their content digests, so that the
partition is a set of cut digests and a document's shard is a plain comparison with them: no join carries it back.
The smallest feasible capacity is found by binary search, checking each capacity greedily over the prefix sums.
The driver only holds a summary of the prefix sums (a bounded number of bins) and zooms into the bins that the search
touches until every touched boundary is exact.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import copies, documents, materialize

SHARDS = 16
#: Digest buckets for prefix sums and position ranges; each is summed apart, and only their totals meet.
BUCKETS = 4096
#: Bins of the first summary and parts that a touched bin is split into.
BINS, PARTS = 8192, 64


class Boundaries:
    """Known group boundaries: bins (lo, hi, first, last), where first and last are the least and greatest prefix sums within."""

    def __init__(self, bins: list[tuple[int, int, int, int]], total: int):
        self.total = total
        self.load(bins)

    def load(self, bins: list[tuple[int, int, int, int]]) -> None:
        self.bins = sorted([(0, 0, 0, 0), *bins])
        self.first, self.last = [b[2] for b in self.bins], [b[3] for b in self.bins]
        self.wanted: set[int] = set()

    def floor(self, x: int) -> int:
        """The greatest boundary <= x, or a stand-in for it if x lies inside a bin that hides it."""
        k = bisect_right(self.first, x) - 1
        if self.last[k] <= x:
            return self.last[k]
        self.wanted.add(k)
        return self.first[k]

    def ceil(self, x: int) -> int:
        """The least boundary >= x, or a stand-in for it."""
        k = bisect_left(self.last, x)
        if k == len(self.bins):
            return self.total
        if self.first[k] >= x:
            return self.first[k]
        self.wanted.add(k)
        return self.last[k]


def greedy_fits(b: Boundaries, shards: int, capacity: int) -> bool:
    """Whether filling each shard as far as the capacity allows places all groups."""
    at = 0
    for _ in range(shards):
        if at >= b.total:
            return True
        to = b.floor(at + capacity)
        if to == at:
            return False
        at = to
    return at >= b.total


def minimax_cuts(b: Boundaries, shards: int, largest: int) -> tuple[int, list[int]]:
    """The smallest feasible capacity and the prefix sums to cut at.

    A shard ends at the boundary nearest to an equal share of what is left, moved into the range that the capacity
    allows it and the shards after it.
    """
    low, high = max(-(-b.total // shards), largest), -(-b.total // shards) + largest
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if greedy_fits(b, shards, mid) else (mid + 1, high)
    least = [b.total]
    for _ in range(shards - 1):
        least.append(b.ceil(max(0, least[-1] - low)))
    least.reverse()
    cuts, at = [], 0
    for k in range(shards - 1):
        goal = at + (b.total - at) // (shards - k)
        below, above = b.floor(goal), b.ceil(goal)
        to = below if goal - below <= above - goal else above
        at = max(at, least[k], min(to, b.floor(at + low)))
        cuts.append(at)
    return low, cuts


def with_content(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds _size (UTF-8 bytes plus 1; null: 1), _crc (null for a null text) and _digest (SHA-256; null like no text)."""
    return df.withColumns(
        {
            "_size": (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long"),
            "_crc": F.crc32(F.encode(text, "UTF-8")),
            "_digest": F.unhex(F.sha2(F.coalesce(F.encode(text, "UTF-8"), F.unhex(F.lit("00"))), 256)),
        }
    )


def prefix_sums(content: DataFrame) -> DataFrame:
    """One row per group: digest, size and the sum of sizes up to it in digest order, from sums per digest bucket."""
    groups = content.groupBy("_digest").agg(F.sum("_size").alias("size")).withColumn("bucket", _order_bucket("_digest"))
    within = W.partitionBy("bucket").orderBy("_digest").rowsBetween(W.unboundedPreceding, W.currentRow)
    groups = materialize(groups.withColumn("within", F.sum("size").over(within)), "groups")
    totals = groups.groupBy("bucket").agg(F.sum("size").alias("total"))
    before = totals.select("bucket", (F.sum("total").over(W.orderBy("bucket")) - F.col("total")).alias("before"))
    return groups.join(F.broadcast(before), "bucket").select("_digest", "size", (F.col("before") + F.col("within")).alias("prefix"))


def _order_bucket(digest: str) -> Column:
    """The leading 12 bits of a digest: bucket order is digest order."""
    return F.shiftright(F.conv(F.hex(F.substring(digest, 1, 2)), 16, 10).cast("int"), 4)


def _summary(sums: DataFrame, ranges: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Bins of the given (lo, hi, width) ranges of prefix sums, with the least and greatest prefix sum in each."""
    spark = sums.sparkSession
    table = spark.createDataFrame(ranges, "lo long, hi long, width long")
    coarse = max(1, max(hi for _, hi, _ in ranges) // BUCKETS + 1)
    table = table.withColumn("at", F.explode(F.sequence(F.expr(f"lo div {coarse}"), F.expr(f"hi div {coarse}"))))
    # The ranges are a bounded number of bins that one search touches.
    hit = sums.withColumn("at", F.expr(f"prefix div {coarse}")).join(F.broadcast(table), "at").filter("prefix > lo and prefix <= hi")
    rows = (
        hit.withColumn("bin", F.expr("(prefix - lo - 1) div width"))
        .groupBy("lo", "hi", "width", "bin")
        .agg(F.min("prefix").alias("first"), F.max("prefix").alias("last"))
        .collect()
    )
    return [(r.lo + r.bin * r.width, min(r.hi, r.lo + (r.bin + 1) * r.width), r.first, r.last) for r in rows]


def plan_cuts(sums: DataFrame, shards: int) -> tuple[int, list[int]]:
    """The capacity and the cut prefix sums for a table of prefix sums (columns size and prefix)."""
    top = sums.agg(F.max("prefix").alias("total"), F.max("size").alias("largest")).first()
    if not top.total:
        return 0, [0] * (shards - 1)
    width = max(1, -(-top.total // BINS))
    b = Boundaries(_summary(sums, [(0, top.total, width)]), top.total)
    while True:
        capacity, cuts = minimax_cuts(b, shards, top.largest)
        if not b.wanted:
            return capacity, cuts
        hidden = [b.bins[k] for k in b.wanted]
        found = _summary(sums, [(lo, hi, max(1, -(-(hi - lo) // PARTS))) for lo, hi, _, _ in hidden])
        b.load([x for k, x in enumerate(b.bins) if k and k not in b.wanted] + found)


def assign_shards(df: DataFrame, shards: int = SHARDS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Adds _size, _crc, _digest, shard and slot to every row of df (columns of these names are replaced).

    Equal texts share a shard; the largest shard is as small as a contiguous partition of the groups in digest order can
    make it; within that, cuts lie as near to equal shares as the capacity allows. Slots number a shard's rows from 0 without
    gaps, in the order of a digest of the key. A null text is of size 1, forms one group with other null texts and has a null
    _crc. Repeated rows are kept, each with its own slot, and rows without a key stand anywhere in their shard. An empty table
    gives an empty result.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c not in ("_size", "_crc", "_digest", "shard", "slot")]
    rows = df.select(F.struct(*kept).alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
    return _assign(with_content(rows, "text").drop("text"), shards, "key").select("row.*", "_size", "_crc", "_digest", "shard", "slot")


def _assign(content: DataFrame, shards: int, key: str, order: str | None = None) -> DataFrame:
    """Slots stand in the order of the column order, where one is given, or of a digest of the key."""
    sums = materialize(prefix_sums(content.select("_size", "_digest")), "prefix_sums")
    _, cuts = plan_cuts(sums, shards)
    ends = {r.prefix: bytes(r._digest) for r in sums.filter(F.col("prefix").isin(cuts)).select("prefix", "_digest").collect()}
    shard = F.lit(0)
    for c in cuts:
        shard = shard + (F.lit(1) if c == 0 else (F.col("_digest") > F.lit(ends[c])).cast("int"))
    ranges = BUCKETS // shards
    # Rows without a key can't be told apart but by their texts, so that they may stand anywhere and are dealt round.
    content = content.withColumn("_key", F.md5(F.col(key).cast("string")))
    spread = F.expr(f"if(_key is null, pmod(monotonically_increasing_id(), {ranges}), bigint(conv(substr(_key, 1, 4), 16, 10)) * {ranges} div 65536)")
    if order:
        end = (content.agg(F.max(order)).first()[0] or 0) + 1
        spread = F.expr(f"{order} * {ranges} div {end}")
    placed = content.withColumns({"shard": shard, "_range": spread.cast("int")})
    counts = materialize(placed.groupBy("shard", "_range").count(), "counts")
    first = counts.select("shard", "_range", (F.sum("count").over(W.partitionBy("shard").orderBy("_range")) - F.col("count")).alias("_first"))
    within = F.row_number().over(W.partitionBy("shard", "_range").orderBy(*([order] if order else []), "_key", key, "_digest"))
    # At most BUCKETS rows are broadcast.
    return (
        placed.withColumn("_within", within)
        .join(F.broadcast(first), ["shard", "_range"])
        .withColumn("slot", (F.col("_first") + F.col("_within") - 1).cast("long"))
        .drop("_range", "_first", "_within", "_key")
    )


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 15 under the law `bytes`."""
    return shard_rows(documents(spark, sf_dir))


def shard_rows(docs: DataFrame) -> DataFrame:
    """The shard, slot and content digests of every document, without its text; the text is read once.

    Null texts have a size of 1 and a null text_crc32; see assign_shards() for ties, repeats and empty tables.
    """
    content = materialize(with_content(docs.select("doc_id", "text")).drop("text"), "content")
    return _assign(content, SHARDS, "doc_id").select(
        "doc_id",
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def shard_mixed(docs: DataFrame, places: DataFrame | None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and mix_slot; a shard's slots stand in the order of the mix.

    places has the slots of the mix; without it slots are those of shard_rows() and mix_slot is null.
    """
    content = with_content(docs.select("doc_id", "text")).withColumn("_hash", F.xxhash64("text")).drop("text")
    if places is None:
        content = materialize(content.withColumn("mix_slot", F.lit(None).cast("long")), "content")
    else:
        content = materialize(content, "hashes").withColumn("_copy", copies("_digest")).alias("c")
        on = F.expr("c.doc_id <=> p.doc_id and c._hash = p._hash and c._copy = p._copy")
        content = materialize(content.join(places.alias("p"), on).select("c.*", "mix_slot"), "content")
    placed = _assign(content, SHARDS, "doc_id", None if places is None else "mix_slot")
    doc_id = F.col("doc_id").alias("doc_id", metadata={})  # it may name the table of places, which goes
    return placed.select(doc_id, F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), "shard", "slot", "mix_slot")
