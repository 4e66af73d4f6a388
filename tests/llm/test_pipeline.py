"""The pipeline's stages in a row, each against what it may do and against plain versions of its decisions."""

from __future__ import annotations

import sys
import zlib
from pathlib import Path

import corpus_pipeline
from tonelake.llm import decontamination, toxicity

sys.path.insert(0, str(Path(__file__).parent))
from test_pairs import brute  # noqa: E402

SF = "/root/testdata/sf0.001"
EMPTY = "doc_id long, text string, lang string, source string, n_chars long"


def leaked(text, items):
    """Whether some part of a text lies within the allowed distance of an item, by the distance to every part."""
    text = decontamination.normal(text)
    return any(decontamination.distance(i, text, decontamination._masks(i))[0] <= int(decontamination.EDITS * len(i)) for i in items)


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, states = docs.columns, [docs.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF)
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        states.append(docs.collect())
        assert k == 4 or docs.columns == columns
    first, clean, single, pure, mixed, placed = states
    model = toxicity.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    assert {r.doc_id for r in clean} == {r.doc_id for r in first if sum(model.exceed(model.score(toxicity.words_of(r.text)))) < toxicity.REJECT}
    groups = brute([(r.doc_id, r.text) for r in clean])
    assert {r.doc_id for r in single} == {i for i, (_, c) in groups.items() if i == c}
    items = [decontamination.normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {r.doc_id for r in pure}
    assert all((r.doc_id in kept) != leaked(r.text, items) for r in single if len(r.text or "") < 3000)
    assert kept <= {r.doc_id for r in single} and sorted(map(tuple, mixed)) == sorted(map(tuple, pure))
    assert {r.doc_id for r in placed} == kept and len(placed) == len(pure)
    text = {r.doc_id: r.text or "" for r in pure}
    by: dict = {}
    for r in sorted(placed, key=lambda r: r.slot):
        assert (r.size, r.text_crc32) == (len(text[r.doc_id].encode()) + 1, zlib.crc32(text[r.doc_id].encode()))
        by.setdefault(r.shard, []).append(r)
    assert all([r.slot for r in v] == list(range(len(v))) and [r.mix_slot for r in v] == sorted(r.mix_slot for r in v) for v in by.values())


def test_repeated_rows_leave_one(spark):
    rows = [(1, "b b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (3, None), (3, None), (None, "x"), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.near_duplicates(spark, docs, SF).collect()
    assert sorted((r.doc_id for r in got), key=str) == sorted([1, 3, None, None], key=str)
    assert next(r.text for r in got if r.doc_id == 1) == "a b c d e f"


def test_stages_of_nothing(spark, tmp_path):
    docs = spark.createDataFrame([], EMPTY)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF)
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.collect() == []
