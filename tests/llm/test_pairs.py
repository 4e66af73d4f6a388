"""The joins against brute force over all pairs."""

from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pytest

from tonelake.llm import common, embedding_dedup, ngram_join
from tonelake.llm.common import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def components(nodes, links):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), c) for i, c in components(sets, links).items()}


def corpus(seed: int, n: int = 220) -> list[tuple[int, str | None]]:
    """Copies, chains of near copies around the limit, and passages that many documents share."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeÉß", k=rng.randrange(1, 5)))
    passage = [word() for _ in range(30)]
    bases = [[word() for _ in range(rng.randrange(3, 120))] for _ in range(12)]
    rows: list[tuple[int, str | None]] = [(0, None), (1, ""), (2, " \t\n"), (3, "One two"), (4, "one TWO "), (5, "one"), (6, "lang " * 3000), (7, "lang " * 3100)]
    for i in range(8, n):
        w = list(rng.choice(bases))
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = word()
        if rng.random() < 0.3:
            w = passage + w[: rng.randrange(0, 12)]
        if rng.random() < 0.2:
            w += [word() for _ in range(rng.randrange(20))]
        rows.append((i, rng.choice([" ", "\n", "  "]).join(w)))
    return rows


@pytest.mark.parametrize("seed", [1])
def test_ngram_join(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).withColumnRenamed("lang", "component_id").withColumnRenamed("source", "n")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_components(docs).collect()}
    assert got == brute(rows)
    assert len({c for _, c in got.values()}) < len(rows)


def test_ngram_join_with_recurring_shingles(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LOCAL_MIN", 2)
    rows = corpus(3, 120)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_components(docs).collect()} == brute(rows)


def test_ngram_join_with_heavy_keys(spark, monkeypatch):
    """Long prefix lists are ordered anew, and keys with many rows are joined apart."""
    monkeypatch.setattr(ngram_join, "LONG", 5)
    monkeypatch.setattr(common, "HEAVY", 4)
    monkeypatch.setattr(common, "BROADCAST_IDS", 3)
    monkeypatch.setattr(ngram_join, "AGAIN", 1)
    rows = corpus(4, 90)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_components(docs).collect()} == brute(rows)


def test_operators_leave_settings_and_folders(spark):
    before, written = dict(spark.conf.getAll), len(common._written)
    embedding_dedup.near_duplicates(spark.createDataFrame(vectors(9, 60), "vec_id long, embedding array<float>, label int")).collect()
    assert dict(spark.conf.getAll) == before and len(common._written) == written + 1
    common.delete_tables(spark, written)
    assert len(common._written) == written


def test_ngram_join_edge_tables(spark):
    assert ngram_join.similar_components(spark.createDataFrame([], SCHEMA)).collect() == []
    t = "a b c d e f g"
    docs = spark.createDataFrame([(5, t), (5, t), (3, t), (None, t), (None, "x y"), (None, None)], "doc_id long, text string")
    got = sorted(map(tuple, ngram_join.similar_components(docs).collect()), key=str)
    assert got == sorted([(5, 3, 3), (5, 3, 3), (3, 3, 3), (None, 3, 3), (None, 1, None), (None, 0, None)], key=str)


def test_prefix_orders_recurring_shingles_last():
    s = np.array([5, 7, 9, 11, 13, 15], np.uint64) << np.uint64(50)
    known, counts = s[[0, 2]], np.array([9, 4])
    maybe = np.zeros(1 << ngram_join.BITS, bool)
    maybe[ngram_join._leading(known)] = True
    assert ngram_join.prefix_of(s, known, counts, maybe).tolist() == s[[1, 3]].tolist()
    few = s[:3]
    assert ngram_join.prefix_of(few, s[:3], np.array([3, 2, 1]), np.ones(1 << ngram_join.BITS, bool)).tolist() == [few[2]]


def vectors(seed: int, n: int = 260):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(40, 8))
    rows = []
    for i in range(n):
        v = base[rng.integers(40)] + rng.normal(size=8) * rng.choice([0, 0.02, 0.2])
        rows.append((i, (v * rng.choice([1, 3, 1e-3])).astype(np.float32).tolist(), int(rng.integers(2))))
    nan, inf = float("nan"), float("inf")
    rows += [(n, None, 0), (n + 1, [0.0] * 8, 0), (n + 2, [nan] + [1.0] * 7, 0), (n + 3, [inf] * 8, 1), (n + 4, [None] + [1.0] * 7, 1), (n + 5, [1.0, 2.0], 0), (n + 6, [2.0, 4.0], 0), (n + 7, rows[0][1], None), (n + 8, [], 1)]
    return rows


def brute_vectors(rows):
    ok = {i: (np.array(v, float), lab) for i, v, lab in rows if v and None not in v and lab is not None and np.isfinite(v).all() and np.any(v)}
    near = lambda a, b: len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.98
    links = [(i, j) for i, j in itertools.combinations(sorted(ok), 2) if ok[i][1] == ok[j][1] and near(ok[i][0], ok[j][0])]
    comp = components([r[0] for r in rows], links)
    return {i: (sum(i in x for x in links), comp[i], comp[i] == i) for i in comp}


@pytest.mark.parametrize("block", [3, 512])
def test_embeddings(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rows = vectors(block)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df).collect()}
    want = brute_vectors(rows)
    assert got == want
    assert sum(n for n, _, _ in want.values()) > 100


def test_embeddings_empty(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def test_connected_components(spark):
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(30)] + [(rng.randrange(40, 200), rng.randrange(40, 200)) for _ in range(120)] + [(300, k) for k in range(301, 340)] + [(7, 7), (1, None)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if b is not None and a != b]
    assert got == components({x for e in real for x in e}, real)
