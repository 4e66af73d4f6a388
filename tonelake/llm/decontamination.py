"""Benchmark decontamination by CGK embedding and bit-sampling LSH over item-sized windows, with exact edit verification.

A window of a document as long as an item is compared with that item. The CGK walk reads a string while it emits symbols
and steps on or stays by a hash of (walk, step, symbol), so that a small edit distance becomes a small Hamming distance
with constant probability; a table keeps a few sampled positions of one walk's output. Windows whose sample equals the
item's in any table are verified by edit distance. The samples are as long as still reach the target recall on copies
of the items with random edits inside other text, by the whole search. Windows are laid by characters: of one more pieces of
an item than edits are allowed, one is left whole in every leak, so that a window is laid at each piece's place. Those that
hold fewer of the item's short grams than that many edits leave are dropped. Neither step can lose a leak.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare
from .common import by_ids, documents, materialize, pieces

#: Edits a leak may have per character of the item, and the share of such leaks that the tables have to find.
EDITS, RECALL = 0.1, 0.95
WALKS, TABLES, SAMPLES = 8, 16, (8, 7, 6, 5, 4, 3, 2, 1)
#: Characters of a piece that are looked up at most, and bits of the table of their hashes.
SEED, SEED_BITS = 12, 22
#: Characters of the short grams, and hashes of them that are told apart.
GRAM, GRAM_HASHES = 4, 4096
#: Edited copies that the recall is measured on, at most, and their characters; LEAST of them in any case.
COPIES, COPY_CHARS, LEAST = 400, 200_000, 20
#: Windows of an item that begin within this part of its length are one.
APART = 256
#: Benchmark items and their characters that one pass over the documents compares; more take more passes.
ITEMS, ITEM_CHARS = 8_000, 4_000_000
#: Windows that a worker embeds at once, the bytes that it may need for them, and characters of documents searched at once.
PART, PART_BYTES, CHARS = 1_000, 64 << 20, 1_000_000
#: Steps of a walk after which its random bits begin again; only items of more than half as many characters get there.
STEPS = 8_192


def normal(text: str | None) -> str:
    """Lower case, with single spaces; empty for null."""
    return " ".join(text.lower().split()) if text else ""


def symbols(text: str) -> np.ndarray:
    """One byte for each code point: its low bits, 0 being left for the padding."""
    return (np.frombuffer(text.encode("utf-32-le"), np.uint32) % 255 + 1).astype(np.uint8)


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """A 32-bit hash of the q code points from each place on."""
    n = max(0, len(codes) - q + 1)
    out = np.zeros(n, np.uint32)
    for j in range(q):
        out *= np.uint32(0x01000193)
        out += codes[j : j + n]
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x9E3779B1)
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def step_bits(steps: int) -> np.ndarray:
    """The walks' fixed random bits, by step, walk and symbol; those of a step don't depend on the number of steps."""
    steps = min(steps, STEPS)
    return np.stack([np.random.default_rng([7, j]).integers(0, 2, (WALKS, 256), np.uint8) for j in range(steps)]) if steps else np.empty((0, WALKS, 256), np.uint8)


def embed(text: np.ndarray, start: np.ndarray, length: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """CGK outputs (step, walk, window) of the windows text[start : start + length], and a last step of padding."""
    steps = int(2 * length.max(initial=0))
    text = np.concatenate((text, np.zeros(1, np.uint8)))
    at = np.broadcast_to(start, (WALKS, len(start))).astype(np.int32)
    end = (start + length).astype(np.int32)
    walk = (np.arange(WALKS, dtype=np.int32) * 256)[:, None]
    out = np.zeros((steps + 1, WALKS, len(start)), np.uint8)
    for j in range(steps):
        out[j] = s = np.where(at < end, text.take(at, mode="clip"), 0)
        at += bits[j % STEPS].ravel().take(walk + s)
    return out


def sampled(out: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The symbols (window, walk, table, sample) at the steps that at (window, walk, table, sample) names."""
    window, walk = np.arange(out.shape[2])[:, None, None, None], np.arange(WALKS)[:, None, None]
    return out[np.minimum(at, out.shape[0] - 1), walk, window]


def positions(lengths: np.ndarray, samples: int) -> np.ndarray:
    """Sampled steps (item, walk, table, sample) for items of these lengths, among those that read them, not their padding."""
    share = np.random.default_rng([11, samples]).random((WALKS, TABLES, samples))
    return (share * 1.8 * lengths[:, None, None, None]).astype(np.int64)


def parts(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Runs of at most PART of the ascending sizes, of which the last times the run's length is at most most (one at least)."""
    at = 0
    while at < len(sizes):
        to = min(at + PART, len(sizes))
        while to - at > 1 and int(sizes[to - 1]) * (to - at) > most:
            to = at + max(1, min((to - at) // 2, most // max(1, int(sizes[to - 1]))))
        yield slice(at, to)
        at = to


def distance(item: str, text: str, peq: dict[str, int]) -> tuple[int, int]:
    """The least edit distance of item to any part of text, and the end of that part (bit-parallel dynamic programme)."""
    m = len(item)
    if not m:
        return 0, 0
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = mask, 0, m, m, 0
    for k, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & mask, pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = (ph << 1) & mask, (mh << 1) & mask
        pv, mv = mh | ~(xv | ph) & mask, ph & xv
        if score < best:
            best, end = score, k + 1
    return best, end


def _masks(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for k, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << k
    return out


def edited(item: str, edits: int, rng: random.Random) -> str:
    letters = sorted(set(item))
    out = list(item)
    for _ in range(edits):
        k, kind = rng.randrange(len(out)), rng.randrange(3)
        if kind == 0:
            out[k] = rng.choice(letters)
        elif kind == 1:
            out.insert(k, rng.choice(letters))
        elif len(out) > 1:
            del out[k]
    return "".join(out)


class Index:
    """A bounded block of benchmark items: their texts, pieces, short grams and table keys."""

    def __init__(self, items: list[tuple[int, str]], edits: float = EDITS, recall: float = RECALL):
        self.items = [(i, t) for i, t in sorted(items) if t]
        self.edits = edits
        self.grams = np.zeros((len(self.items), GRAM_HASHES), bool)
        pieces: dict[int, list[tuple[int, int, int]]] = {}
        for k, (_, text) in enumerate(self.items):
            codes = code_points(text)
            self.grams[k, gram_hashes(codes, GRAM) % GRAM_HASHES] = True
            n = min(len(text), int(edits * len(text)) + 1)
            q = min(SEED, len(text) // n)
            found = gram_hashes(codes, q)
            pieces.setdefault(q, []).extend((int(found[j * len(text) // n]), k, j * len(text) // n) for j in range(n))
        self.pieces = []
        for q, rows in sorted(pieces.items()):
            table = np.array(sorted(rows), np.int64)
            keys, first = np.unique(table[:, 0].astype(np.uint32), return_index=True)
            held = np.zeros(1 << SEED_BITS, bool)
            held[keys >> np.uint32(32 - SEED_BITS)] = True
            self.pieces.append((q, held, keys, np.append(first, len(table)), table[:, 1], table[:, 2]))
        self.bits = step_bits(2 * max((len(t) for _, t in self.items), default=0))
        self.masks = [_masks(t) for _, t in self.items]
        self.size = np.array([len(t) for _, t in self.items], np.int64)
        self.copies = int(min(COPIES, max(LEAST, COPY_CHARS // self.size.mean()))) if self.items else 0
        self.samples, self.keys = SAMPLES[-1], np.empty((0, WALKS, TABLES, 1), np.uint8)
        for n in SAMPLES if self.items else ():
            self.samples, self.keys = n, self._keys(n)
            share = self.reached()
            if share - 2 * (share * (1 - share) / self.copies) ** 0.5 >= recall:  # by chance too low, if anything
                break

    def _keys(self, samples: int) -> np.ndarray:
        out = np.empty((len(self.items), WALKS, TABLES, samples), np.uint8)
        order = np.argsort(self.size, kind="stable")
        for part in parts(self.size[order], PART_BYTES // (2 * WALKS)):
            k = order[part]
            text = symbols("".join(self.items[j][1] for j in k))
            start = np.cumsum(self.size[k]) - self.size[k]
            out[k] = sampled(embed(text, start, self.size[k], self.bits), positions(self.size[k], samples))
        return out

    def reached(self, seed: int = 5) -> float:
        """The share of edited copies at the largest allowed distance, inside other text, that the search finds; all lengths alike."""
        copies = self.copies
        rng, by = random.Random(seed), sorted(range(len(self.items)), key=lambda k: len(self.items[k][1]))
        picked = [by[int((j + rng.random()) * len(by) / copies)] for j in range(copies)]
        texts = []
        for k in picked:
            around = [self.items[rng.choice(by)][1] for _ in range(2)]
            text = self.items[k][1]
            texts.append(around[0][rng.randrange(len(around[0])) :] + edited(text, int(self.edits * len(text)), rng) + around[1][: rng.randrange(len(around[1]))])
        own = {(j, k) for j, k in enumerate(picked)}
        windows = [w for w in self.places(texts) if w[:2] in own]
        return len({(d, k) for d, k, _, _ in self.matches(texts, windows)}) / copies

    def places(self, texts: list[str]) -> list[tuple[int, int, int]]:
        """(document, item, start) windows of normalised documents; every leak has one within as many places as edits and an APARTth of the item."""
        codes = code_points("\n".join(texts))  # no normalised text holds a line break
        base = np.cumsum([0] + [len(t) + 1 for t in texts])
        out = []
        for q, held, keys, first, items, offsets in self.pieces:
            for lo in range(0, len(codes), CHARS):
                found = gram_hashes(codes[lo : lo + CHARS + q - 1], q)
                at = np.flatnonzero(held[found >> np.uint32(32 - SEED_BITS)])
                key = np.searchsorted(keys, found[at])
                same = keys[np.minimum(key, len(keys) - 1)] == found[at]
                at, key = at[same] + lo, key[same]
                n = first[key + 1] - first[key]
                row = np.repeat(first[key] - np.cumsum(n) + n, n) + np.arange(n.sum())
                at = np.repeat(at, n)
                doc = np.searchsorted(base, at, "right") - 1
                out.append(np.stack([doc, items[row], np.maximum(0, at - base[doc] - offsets[row])], 1))
        if not out or not (windows := np.concatenate(out)).size:
            return []
        windows = windows[np.lexsort(windows.T[::-1])]
        near = windows.copy()
        near[:, 2] //= self.size[windows[:, 1]] // APART + 1
        windows = windows[np.append(True, (near[1:] != near[:-1]).any(1))]
        return [tuple(w) for w in windows[self._filled(windows, codes, base)].tolist()]

    def _filled(self, windows: np.ndarray, codes: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Whether the text around a window holds as many short grams of its item as the allowed edits leave at least."""
        size = self.size
        edits = np.array([int(self.edits * n) for n in size.tolist()])
        around = edits + size // APART
        doc, item, start = windows.T
        lo = base[doc] + np.maximum(0, start - around[item])
        hi = np.minimum(base[doc] + start + size[item] + around[item], base[doc + 1] - 1) - GRAM + 1  # grams begin before it
        least = size[item] - GRAM + 1 - GRAM * edits[item]
        found = [gram_hashes(codes[k : k + CHARS + GRAM - 1], GRAM) % GRAM_HASHES for k in range(0, len(codes), CHARS)]
        hashes = np.concatenate([x.astype(np.uint16) for x in found] + [np.zeros(1, np.uint16)])
        out = least <= 0
        rest = np.flatnonzero(~out)
        rest = rest[np.argsort(hi[rest] - lo[rest], kind="stable")]
        for part in parts(np.maximum(0, hi - lo)[rest], PART_BYTES // 16):
            w = rest[part]
            place = lo[w][:, None] + np.arange(max(0, int((hi[w] - lo[w]).max())))
            held = self.grams[item[w][:, None], hashes[np.minimum(place, len(hashes) - 1)]] & (place < hi[w][:, None])
            out[w] = held.sum(1) >= least[w]
        return out

    def matches(self, texts: list[str], windows: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
        """(document, item, distance, start) of the best verified window of each pair; windows: (document, item, start)."""
        joined = symbols("".join(texts))
        base = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        hits: dict[tuple[int, int], list[int]] = {}
        windows = sorted(windows, key=lambda w: len(self.items[w[1]][1]))
        most = np.array([len(self.items[w[1]][1]) for w in windows], np.int64)
        for part in (windows[x] for x in parts(most, PART_BYTES // (2 * WALKS))):
            length = np.array([min(len(self.items[k][1]), len(texts[d]) - s) for d, k, s in part])
            start = np.array([base[d] + s for d, _, s in part])
            item = np.array([k for _, k, _ in part])
            found = sampled(embed(joined, start, length, self.bits), positions(self.size[item], self.samples))
            for w in np.flatnonzero((found == self.keys[item]).all(3).any((1, 2))):
                hits.setdefault(part[w][:2], []).append(part[w][2])
        best = []
        for (d, k), starts in sorted(hits.items()):
            text = self.items[k][1]
            edits = int(self.edits * len(text))
            slack = edits + len(text) // APART + 1
            verified, starts = [], sorted(starts)
            first = last = starts[0]
            for s in [*starts[1:], None]:  # windows that lie close together are one stretch of text
                if s is not None and s - last <= slack:
                    last = s
                    continue
                lo = max(0, first - slack)
                n, end = distance(text, texts[d][lo : last + len(text) + slack], self.masks[k])
                if n <= edits:
                    verified.append((n, lo + end))
                first = last = s
            if verified:
                best.append((d, k, *min(verified)))
        return best


def _pass(docs: DataFrame, items: list[tuple[int, str]], edits: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(Index(items, edits))  # about ITEMS items and ITEM_CHARS characters

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value

        def found(ids: list, texts: list[str]) -> pa.RecordBatch:
            out = [(ids[d], index.items[k][0], n, end) for d, k, n, end in index.matches(texts, index.places(texts))]
            return pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in range(4)], ["doc_id", "item_id", "edit_distance", "end"])

        ids, texts, size = [], [], 0
        for b in pieces(batches):
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                if t := normal(text):
                    ids.append(i)
                    texts.append(t)
                    size += len(t)
                    if size >= CHARS:
                        yield found(ids, texts)
                        ids, texts, size = [], [], 0
        yield found(ids, texts)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, "doc_id long, item_id long, edit_distance long, end long")


def leaks(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS) -> DataFrame:
    """(doc_id, item_id, edit_distance, end) for each document row and benchmark item within the allowed edit distance.

    Both are compared in lower case with single spaces; end counts code points of that form of the document. Null, empty
    and blank texts match nothing; rows with a null item_id are ignored. Repeated documents each give their rows, repeated
    items one row each. Extra columns are ignored, and empty tables give no rows. Each pass over the documents takes a block
    of about ITEMS items and ITEM_CHARS characters of them.
    """
    prepare(docs.sparkSession)
    rows = benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text")
    held = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(1, -(-held[0] // (ITEMS // 2)), -(-held[1] // (ITEM_CHARS // 2)))
    out = None
    for k in range(blocks):
        block = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else rows
        part = _pass(docs, [(r.item_id, normal(r.text)) for r in block.collect()], edits)
        out = part if out is None else out.unionByName(part)
    return out


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    return leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, with their columns; an id goes with any of its rows."""
    bad = materialize(leaks(docs, benchmark).filter("doc_id is not null").select("doc_id").distinct(), "leaks")
    return by_ids(docs, bad, "doc_id", "left_anti")
