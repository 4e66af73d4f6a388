"""The mix against exact target weights, and with many sources."""

from __future__ import annotations

from fractions import Fraction

import pytest

from tonelake.llm import mixing


@pytest.mark.parametrize(("blocks", "weights"), [([900, 100], [0.9, 0.1]), ([3000, 10], [0.999, 0.001]), ([3000] + [150] * 19, [8.0**0.5] + [1.0] * 19)])
def test_shares_hold_against_target_weights(blocks, weights):
    names = [f"s{k:02}" for k in range(len(blocks))]
    phases, periods = mixing.schedule(dict(zip(names, blocks)), dict(zip(names, weights)))
    table = {(s, p, r): x for s, p, r, x in periods}
    placed = sorted((start + k // per * period + table[s, p, k % per], s, p, start) for s, p, first, end, start, period, per in phases for k in range(end - first))
    assert [x[0] for x in placed] == list(range(sum(blocks)))
    active = {}
    for s, p, *_ in phases:
        active.setdefault(p, []).append(s)
    target, seen = dict(zip(names, map(Fraction, weights))), {}
    for slot, s, p, start in placed:
        seen[s, p] = seen.get((s, p), 0) + 1
        total = sum(target[x] for x in active[p])
        assert all(abs(seen.get((x, p), 0) - target[x] / total * (slot + 1 - start)) < 1 for x in active[p])


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_many_sources_keep_their_weights(spark, monkeypatch, broadcast):
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", broadcast)
    df = spark.range(1800).selectExpr("id as doc_id", "repeat('t', 99) as text", "if(id < 1200, concat('site', id % 300), if(id < 1500, 'heavy', null)) as source")
    got = mixing.mix(df, {"heavy": 300.0, None: 300.0, "site0": 1.0}, block_bytes=100).collect()
    assert sorted(r.doc_id for r in got) == list(range(1800))
    assert len({r._source for r in got}) == 302 and {r._source for r in got if r.source is None} == {"null"}
    assert sorted(r.slot for r in got) == list(range(1800))
    first = sorted((r for r in got if r.phase == 0), key=lambda r: r.slot)
    seen: dict = {}
    for r in first:
        seen[r.source] = seen.get(r.source, 0) + 1
        for s in ("heavy", None, "site0", "site299"):
            weight = 300 if s in ("heavy", None) else 1
            assert abs(seen.get(s, 0) - weight / 900 * (r.slot + 1)) < 1 + 1e-9
    assert len(first) > 300


def test_columns_of_any_names_are_kept(spark):
    """Names that the work uses itself, repeated rows that differ elsewhere, and names with dots."""
    from tonelake.llm import sharding

    names = ["_source", "_bytes", "_range", "_text", "_within", "_before", "_id", "row", "key", "hash", "size", "name", "range", "block", "phase", "slot", "copy", "content", "mix_slot", "_hash", "_copy", "_size", "_key", "_first", "a.b"]
    rows = [(k // 2, None if k == 7 else f"text {k // 3}", "ab"[k % 2], *(f"{k}{n}" for n in names)) for k in range(30)]
    df = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", "source string", *(f"`{n}` string" for n in names)]))
    assert sorted(map(str, mixing.mixed(df).collect())) == sorted(map(str, df.collect()))
    got = mixing.mix(df)
    assert set(got.columns) == set(df.columns) and sorted(r["a.b"] + r["_range"] for r in got.collect()) == sorted(r[-1] + r[5] for r in rows)
    placed = sharding.assign_shards(df, 3)
    assert set(placed.columns) == set(df.columns) | {"_crc", "_digest", "shard"} and sorted(r["_range"] + r["_key"] for r in placed.collect()) == sorted(r[5] + r[-3] for r in rows)
