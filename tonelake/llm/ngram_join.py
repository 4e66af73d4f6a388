"""Jaccard self-join on word shingles by grouped prefix filtering.

Any total order of shingles makes the prefix filter lossless: two sets of a Jaccard similarity of at least 0.8 share a
shingle among the first size // 5 + 1 of each. Here the order puts shingles that recur within blocks of documents last,
by their counts, and all others in the order of their hashes. Equal sets become one class, and classes with the same
prefix and size one group. Groups that share a prefix shingle are first verified against one centre per shingle, which
joins large sets of near copies without listing their pairs; then every remaining candidate pair between different
components is verified. The components are those of the full join; pairs inside a component are not listed.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from xxhash import xxh3_64_intdigest

from ..session import prepare
from .common import HEAVY, by_ids, connected_components, documents, materialize, pieces, tidy, with_heavy

WORDS = 5
#: Words whose hashes a Python worker remembers.
MEMO = 300_000
#: A shingle counts as recurring where so many documents of one block of BLOCK shingles hold it.
LOCAL_MIN, BLOCK = 3, 2_000_000
#: Recurring shingles that the order knows by their counts; the others keep hash order, which costs time, not links.
KNOWN = 1_000_000
#: A shingle that heads this many prefixes or more is counted as recurring, and the prefixes are made again, so many times at most.
LONG, AGAIN = 10_000, 3
#: Leading bits of a hash by which a worker first asks whether it may be known.
BITS = 22

_MULTIPLIERS = [np.uint64(2 * int.from_bytes(blake2b(bytes([k]), digest_size=8).digest(), "big") % 2**64 | 1) for k in range(WORDS)]


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[word] = h = xxh3_64_intdigest(word)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, so that the order of the hashes is that of no word."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: bytes | None, hashes: dict) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct shingles; fewer words than WORDS are one shingle, no words none.

    bytes.lower() and bytes.split() change and split at ASCII only.
    """
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < WORDS:
        return np.array([xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    h = np.array(list(map(hashes.__getitem__, words)), np.uint64)
    n = len(h) - WORDS + 1
    x = h[:n] * _MULTIPLIERS[0]
    for k in range(1, WORDS):
        x += h[k : n + k] * _MULTIPLIERS[k]
    x = np.sort(_mixed(x))
    return x[np.concatenate(([True], x[1:] != x[:-1]))]


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return pc.cast(batch.column("text"), pa.binary()).to_pylist()


def recurring(docs: DataFrame) -> DataFrame:
    """(h, n): shingles that at least LOCAL_MIN documents of a block hold, with the sum of their counts over all blocks."""

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(held), return_counts=True)
        keep = n >= LOCAL_MIN
        return pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(n[keep])], ["h", "n"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, size = _WordHashes(), [], 0
        for batch in pieces(batches):
            for text in _texts(batch):
                held.append(shingle_set(text, hashes))
                size += len(held[-1])
                if size >= BLOCK:
                    yield counted(held)
                    held, size = [], 0
        if held:
            yield counted(held)

    return docs.select("text").mapInArrow(blocks, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def known_counts(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of up to KNOWN of the most frequent recurring shingles, a bounded table; sorted by hash."""
    found = materialize(recurring(docs), "recurring")
    levels = found.groupBy(F.floor(F.log2("n") * 8).alias("level")).count().orderBy(F.desc("level")).collect()
    total, least = 0, None
    for r in levels:
        total += r["count"]
        if total > KNOWN:
            break
        least = r.level
    if least is None:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    rows = found.filter(F.floor(F.log2("n") * 8) >= least).orderBy("h").toPandas()
    h, n = rows.h.to_numpy(np.int64).view(np.uint64), rows.n.to_numpy(np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def _leading(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def prefix_of(shingles: np.ndarray, known: np.ndarray, counts: np.ndarray, maybe: np.ndarray) -> np.ndarray:
    """The first size // 5 + 1 shingles of a sorted set in the global order. maybe: whether a known hash has the leading BITS bits."""
    need = len(shingles) // 5 + 1
    at = np.flatnonzero(maybe[_leading(shingles)])
    if len(at):
        place = np.minimum(np.searchsorted(known, shingles[at]), len(known) - 1)
        hit = known[place] == shingles[at]
        at, place = at[hit], place[hit]
    if not len(at):
        return shingles[:need]
    rest = np.delete(shingles, at)
    if len(rest) >= need:
        return rest[:need]
    common = shingles[at][np.lexsort((shingles[at], counts[place]))]
    return np.concatenate((rest, common))[:need]


def ordered_signatures(docs: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The written signatures(), those of one document for each prefix, and the written postings() of these.

    A shingle may recur too thinly for one block of documents to show it, and still head many prefixes of a large table. Such
    shingles are counted in the prefixes themselves; those that head LONG or more join the known ones, and the prefixes are
    made again. The order of shingles never changes what is found.
    """
    known, counts = known_counts(docs)
    for again in range(AGAIN, -1, -1):
        signed = materialize(signatures(docs, key, known, counts), "signatures")
        rows = signed.filter("n > 0 and doc_id is not null")
        leaders = rows.groupBy("prefix_key").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
        others = materialize(rows.select("doc_id").join(leaders, "doc_id", "left_anti").distinct(), "others")
        lead = by_ids(rows, others, "doc_id", "left_anti")
        shared = materialize(postings(lead, known[counts >= HEAVY]), "postings")
        if not again:
            break
        long = shared.filter(F.col("times") >= LONG).select("h", F.col("times").alias("n")).distinct().orderBy(F.desc("n"), "h").limit(max(0, KNOWN - len(known))).toPandas()  # at most KNOWN rows
        h, n = long.h.to_numpy(np.int64).view(np.uint64), long.n.to_numpy(np.int64)
        new = ~np.isin(h, known)
        if not new.any():
            break
        known, counts = np.concatenate((known, h[new])), np.concatenate((counts, n[new]))
        order = np.argsort(known)
        known, counts = known[order], counts[order]
    return signed, lead, shared


def postings(lead: DataFrame, heavy: np.ndarray) -> DataFrame:
    """(h, pos, group, n, c, cn, times) for each shingle in the prefixes of two or more documents: its place, the document, the set's size, the centre and its set's size, the shingle's rows.

    The centre of a shingle's groups has the fewest rarer shingles before it: of near copies, the one changed least. Rows pass
    once, to their shingle's task, as most shingles stand alone. Those counted HEAVY times are summed up instead and meet their
    rows by broadcast; what no block of documents showed has few rows in each.
    """
    # A posting's place in its prefix and the set's size share a number, for the shuffle's sake.
    rows = lead.select(F.posexplode("prefix").alias("pos", "h"), F.col("doc_id").alias("group"), "n").select("h", "group", F.expr("shiftleft(bigint(pos), 32) + n").alias("place"))
    what = {"times": F.count("*"), "least": F.min("group"), "last": F.max("group"), "centre": F.min(F.struct("place", "group"))}
    hot = rows.sparkSession.createDataFrame([(h,) for h in heavy.view(np.int64).tolist()], "h long") if len(heavy) else None  # at most as many as rows over HEAVY
    light = rows.join(F.broadcast(hot), "h", "left_anti") if hot else rows
    found = light.select("*", *(x.over(W.partitionBy("h")).alias(k) for k, x in what.items())).filter("least != last")
    if hot:
        few = rows.join(F.broadcast(hot), "h", "left_semi")
        heads = few.groupBy("h").agg(*(x.alias(k) for k, x in what.items())).filter("least != last")
        found = found.unionByName(few.join(F.broadcast(heads), "h"))
    size = "{} & 4294967295"
    return found.select("h", F.expr("shiftright(place, 32)").alias("pos"), "group", F.expr(size.format("place")).alias("n"), F.col("centre.group").alias("c"), F.expr(size.format("centre.place")).alias("cn"), "times")


def signatures(docs: DataFrame, key: str, known: np.ndarray, counts: np.ndarray) -> DataFrame:
    """(doc_id, n, digest, prefix_key, prefix) of each document: set size, digests of the set and of its prefix, the prefix."""
    shared = docs.sparkSession.sparkContext.broadcast((known, counts))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = shared.value
        maybe = np.zeros(1 << BITS, bool)
        maybe[_leading(known)] = True
        hashes = _WordHashes()
        for batch in pieces(batches):
            sizes, digests, keys, prefixes = [], [], [], []
            for text in _texts(batch):
                s = shingle_set(text, hashes)
                p = prefix_of(s, known, counts, maybe) if len(s) else s
                sizes.append(len(s))
                digests.append(blake2b(s.tobytes(), digest_size=16).digest())
                keys.append(blake2b(p.tobytes(), digest_size=16, person=str(len(s)).encode()).digest())
                prefixes.append(p.view(np.int64))
            offsets = np.concatenate(([0], np.cumsum([len(p) for p in prefixes]))).astype(np.int32)
            flat = np.concatenate(prefixes) if prefixes else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                ["doc_id", "n", "digest", "prefix_key", "prefix"],
            )

    out = "doc_id long, n long, digest binary, prefix_key binary, prefix array<long>"
    return docs.select(F.col(key).cast("long").alias(key), "text").mapInArrow(rows, out)


def _sets(docs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """(doc_id, n, digest, shingles) of the documents whose ids are listed."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in pieces(batches):
            sets = [shingle_set(t, hashes) for t in _texts(batch)]
            offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            flat = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["doc_id", "shingles"])

    chosen = by_ids(docs.select(F.col(key).cast("long").alias("doc_id"), "text"), ids, "doc_id", "left_semi")
    return chosen.mapInArrow(rows, "doc_id long, shingles array<long>")


def _verified(pairs: DataFrame, docs: DataFrame, key: str, name: str) -> DataFrame:
    """Those of the (a, b) pairs of document ids whose sets have a Jaccard similarity of at least 0.8."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = materialize(_sets(docs, materialize(ids, f"{name}_ids"), key), f"{name}_sets")
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(right, "b")
    # A centre may have very many copies around it; sets of one id with several texts are so many rows.
    uses = pairs.groupBy("a").agg(F.count("*").alias("n"))
    heavy = uses.filter(F.col("n") > HEAVY).head(1)
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
    both = with_heavy(both, materialize(left.join(uses, "a"), f"{name}_centres"), "a") if heavy else both.join(left, "a")
    shared = both.select("a", "b", F.size("x").alias("nx"), F.size("y").alias("ny"), F.size(F.array_intersect("x", "y")).alias("same"))
    return materialize(shared.filter("100 * same >= 80 * (nx + ny - same)").select("a", "b"), f"{name}_links")


def _sizes_fit(na: str, nb: str) -> str:
    return f"5 * least({na}, {nb}) >= 4 * greatest({na}, {nb})"


def _overlap(na: str, nb: str) -> str:
    """How many shingles sets of these sizes share at a similarity of 0.8."""
    return f"((4 * ({na} + {nb}) + 8) div 9)"


def _needed(na: str, nb: str) -> str:
    """How many of them lie in both prefixes: the smaller surplus of the prefixes over the sets less the overlap."""
    return f"least({na} div 5 + 1 - {na}, {nb} div 5 + 1 - {nb}) + {_overlap(na, nb)}"


def _prefixes_overlap(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """Those of the (a, b, na, nb) pairs whose prefixes share as many shingles as similar sets' prefixes do."""
    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "pair_ids")
    prefixes = by_ids(signed.filter("n > 0").select("doc_id", "prefix"), ids, "doc_id", "left_semi")
    both = pairs.join(prefixes.select(F.col("doc_id").alias("a"), F.col("prefix").alias("x")), "a").join(prefixes.select(F.col("doc_id").alias("b"), F.col("prefix").alias("y")), "b")
    return both.filter(F.size(F.array_intersect("x", "y")) >= F.expr(_needed("na", "nb"))).select("a", "b").distinct()


@tidy
def similar_components(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs; docs has an integer key column and a text column.

    Documents link when their sets of 5-word shingles have a Jaccard similarity of at least 0.8; component_id is the
    smallest id reachable by links. A null, empty or blank text has an empty set and links with nothing. Rows that repeat
    an id are one document with several texts. A row with a null id gets the component of equal sets, else null. An empty
    table gives an empty result. Extra columns are ignored.
    """
    prepare(docs.sparkSession)
    signed, lead, shared = ordered_signatures(docs, key)
    rows = signed.select("doc_id", "n", "digest", "prefix_key").filter("n > 0")
    every = materialize(rows.groupBy("digest", "prefix_key", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    classes = every.filter("rep is not null").drop("copies")
    groups = classes.groupBy("prefix_key").agg(F.min("rep").alias("group"), F.count("*").alias("members"))
    members = materialize(classes.join(groups, "prefix_key").select("digest", "rep", "n", "group", "members"), "members")

    # Each group against the centres of its shingles, and each member of a group against its leader.
    starred = (
        shared.filter(f"group != c and {_sizes_fit('n', 'cn')}")
        .groupBy(F.least("group", "c").alias("a"), F.greatest("group", "c").alias("b"), F.expr("least(n, cn)").alias("x"), F.expr("greatest(n, cn)").alias("y"))
        .count()
        .filter(f"count >= {_needed('x', 'y')}")
    )
    stars = starred.select("a", "b").unionByName(members.filter("rep != group").select(F.col("group").alias("a"), F.col("rep").alias("b"))).distinct()
    stars = materialize(stars, "stars")
    links = _verified(stars, docs, key, "star")
    component = connected_components(links)

    # What still shares a prefix shingle (or a whole prefix) across components.
    placed = members.join(component.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "n", "group", "members", F.coalesce("component", "rep").alias("comp"))
    placed = materialize(placed, "placed")
    entries = shared.select("h", "pos", "group").join(placed, "group").select(F.lit(0).alias("kind"), "h", "pos", "rep", "n", "comp")
    entries = entries.unionByName(placed.filter("members > 1").select(F.lit(1).alias("kind"), F.col("group").alias("h"), F.lit(0).alias("pos"), "rep", "n", "comp"))
    mixed = entries.groupBy("kind", "h").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x != y").select("kind", "h")
    open_ = materialize(entries.join(mixed, ["kind", "h"], "left_semi"), "open")
    left = open_.select("kind", "h", F.col("pos").alias("pa"), F.col("rep").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ca"))
    right = open_.select("kind", "h", F.col("pos").alias("pb"), F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"))
    # The first shingle that a pair shares leaves room for the overlap behind it in both sets.
    room = f"na - pa >= {_overlap('na', 'nb')} and nb - pb >= {_overlap('na', 'nb')}"
    pairs = left.join(right, ["kind", "h"]).filter(f"a < b and ca != cb and {_sizes_fit('na', 'nb')} and {room}").select("a", "b", "na", "nb").distinct()
    pairs = _prefixes_overlap(materialize(pairs, "pairs"), signed)
    tried = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = materialize(pairs.join(tried, ["a", "b"], "left_anti"), "rest")
    if rest.head(1):
        component = connected_components(links.unionByName(_verified(rest, docs, key, "rest")))
    named = every.join(component.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("found"), F.col("copies").alias("n"))
    named = materialize(named, "named")
    of = signed.filter("n > 0").select("doc_id", F.col("n").alias("n_shingles"), "digest")
    grouped = with_heavy(of, named, "digest").select("doc_id", "n_shingles", F.coalesce("found", "doc_id").alias("component_id"))
    return grouped.unionByName(signed.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups of similar documents among all documents."""
    return similar_components(documents(spark, sf_dir).select("doc_id", "text"))
