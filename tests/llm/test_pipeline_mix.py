"""The mix takes effect on the pipeline's rows."""

from __future__ import annotations

import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _rows(spark, docs, tmp_path, names):
    stages = dict(corpus_pipeline.STAGES)
    for k, name in enumerate(names):
        docs = stages[name](spark, docs, "")
        docs.write.parquet(f"{tmp_path}/{len(names)}-{k}")
        docs = spark.read.parquet(f"{tmp_path}/{len(names)}-{k}")
    return docs.collect()


def test_mix_orders_the_shards(spark, tmp_path):
    rows = [(i, f"text {i} " + "x" * 9000, "en", "abc"[i % 7 % 3], 1) for i in range(300)]
    rows += [(7, None, "en", "a", 1), (None, "y" * 70000, "en", None, 1)] * 2
    docs = spark.createDataFrame(rows, DOCS)
    with_mix, without = _rows(spark, docs, tmp_path, ["mixing", "sharding"]), _rows(spark, docs, tmp_path, ["sharding"])
    assert len(with_mix) == len(without) == len(rows)
    assert not spark.read.parquet(f"{tmp_path}/2-1").schema["doc_id"].metadata
    shard = lambda got: sorted((str(r.doc_id), r.text_crc32 or 0, r.shard) for r in got)
    assert shard(with_mix) == shard(without)
    place = lambda got: sorted((str(r.doc_id), r.text_crc32 or 0, r.slot) for r in got)
    assert place(with_mix) != place(without)
    by: dict = {}
    for r in sorted(with_mix, key=lambda r: r.slot):
        by.setdefault(r.shard, []).append(r)
    for v in by.values():
        assert [r.slot for r in v] == list(range(len(v)))
        assert [r.mix_slot for r in v] == sorted(r.mix_slot for r in v)
