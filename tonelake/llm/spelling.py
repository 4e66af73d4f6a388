"""Spelling variants by an even-partition pigeonhole join.

Words one edit apart have lengths that differ by one at most. Of a word that is cut into two even segments, an edit leaves one
as it is. So each word is indexed under both its segments and its length, and probes the words of its own length and those that
are one shorter with its prefix and its suffix of their segments' lengths: a suffix stands one place further on where the
probe is longer. Where a segment is so frequent that its pairs would be too many, what the segment leaves of the words is cut
evenly in its turn, as the edit lies in it: a frequent segment is never joined by itself. Candidates are deduplicated and
verified.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare
from .common import BROADCAST_IDS, documents, materialize, pieces, tidy, with_heavy

#: Runs of letters, once A-Z are lower-cased.
RUNS = "[a-zÀ-ÿ]+"
#: Runs whose crc32 together with the document's id this number divides lose a letter.
DROP = 97
LENGTH, COUNT = 5, 3
#: A form has at least so many times the word's occurrences.
TIMES = 2
#: Distinct words that a worker holds.
HELD = 200_000
#: Pairs of index and probe rows of one segment beyond which what the segment leaves is cut again.
PAIRS = 10_000


def words(docs: DataFrame, drop: int = DROP, length: int = LENGTH, least: int = COUNT) -> DataFrame:
    """The written (word, n): all words of at least length code points and least occurrences in the whole texts.

    A null text has no words; a null id counts as an empty one; rows that repeat are counted each. Workers count the words of many
    texts before they pass them on.
    """
    prepare(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, found = re.compile(RUNS).findall, Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])
            found.clear()
            return out

        for b in pieces(batches):
            for i, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True):
                seed = crc32(f"{i}:".encode())
                for run, n in Counter(find(text.lower().decode())).items():  # bytes are lower-cased in A-Z alone
                    h = crc32(run.encode(), seed)
                    if not h % drop:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                    if len(run) >= length:
                        found[run] += n
                if len(found) > HELD:
                    yield flush()
        yield flush()

    texts = docs.filter("text is not null").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.col("text").cast("binary").alias("text"))
    return materialize(texts.mapInArrow(rows, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(f"n >= {least}"), "words")


def segments(rows: DataFrame) -> DataFrame:
    """Rows under both segments of what is left of their words: path says what stands outside rest, m the indexed length of it."""
    first = F.expr("m div 2")
    head = F.struct(F.concat("path", F.lit("<"), F.expr("left(rest, m div 2)")).alias("path"), F.expr("substring(rest, m div 2 + 1)").alias("rest"), (F.col("m") - first).alias("m"))
    tail = F.struct(F.concat("path", F.lit(">"), F.expr("right(rest, m - m div 2)")).alias("path"), F.expr("left(rest, length(rest) - (m - m div 2))").alias("rest"), first.alias("m"))
    return rows.withColumn("part", F.explode(F.array(head, tail))).select("side", "word", "part.*")


def near_words(vocabulary: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """The written (a, b), each pair once: words of the written vocabulary (word, ...) that are exactly one edit apart."""
    size = F.length("word")

    def side(name: str, m: Column) -> DataFrame:
        return vocabulary.select(F.lit(name).alias("side"), "word", m.cast("string").alias("path"), F.col("word").alias("rest"), m.alias("m"))

    # Words of one length stand on both sides, so each pair of them is met from either; words of one letter are one shorter.
    rows = segments(side("index", size).unionByName(side("probe", size)).unionByName(side("probe", size - 1)))
    found: list[DataFrame] = []
    while True:
        rows = materialize(rows, "segments")
        counts = rows.groupBy("path").agg(F.count_if(F.col("side") == "index").alias("x"), F.count_if(F.col("side") == "probe").alias("y"), F.max("m").alias("m"))
        counts = materialize(counts.filter("x > 0 and y > 0"), "segment_counts")
        # What is left of an indexed word is one letter or none: so many pairs at most as the alphabet allows.
        again = F.col("x") * F.col("y") > F.when(F.col("m") > 1, F.lit(pairs)).otherwise(F.lit(float("inf")))
        direct = rows.join(counts.filter(~again).select("path"), "path", "left_semi")
        index = direct.filter("side = 'index'").select("path", F.col("word").alias("a"))
        probe = direct.filter("side = 'probe'").select("path", F.col("word").alias("b"))
        met = index.join(probe, "path").filter((F.length("a") < F.length("b")) | (F.col("a") < F.col("b"))).select("a", "b")
        found.append(materialize(met.filter(F.levenshtein("a", "b", 1) == 1).distinct(), "near"))
        often = counts.filter(again).select("path")
        if not often.head(1):
            break
        often = F.broadcast(often) if often.count() <= BROADCAST_IDS else often
        rows = segments(rows.join(often, "path", "left_semi"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return materialize(out.distinct(), "near_words")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for the (word, form) rows: the last word that the forms lead to. Paths end, and halve in each round."""
    step = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = step.groupBy("root").agg(F.count("*").alias("n")).join(step.select(F.col("word").alias("root"), F.col("root").alias("next")), "root")
        further = materialize(further, "further")
        if not further.head(1):
            return step
        on = with_heavy(step, further, "root").select("word", F.col("next").alias("root"))
        step = materialize(on.unionByName(step.join(further.select("root"), "root", "left_anti").select("word", "root")), "roots")


@tidy
def spelling_variants(docs: DataFrame, drop: int = DROP, length: int = LENGTH, least: int = COUNT, times: int = TIMES, pairs: int = PAIRS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of docs (doc_id, text).

    Words are maximal runs of Latin letters, lower-cased in A-Z, some short of a letter, of at least length code points and
    least occurrences. A word's form is the word one edit away that occurs most, first in code-point order among equals, if that is
    at least times as often as the word itself; root is the last word that forms lead to, the word itself where it has none.
    Null and empty texts have no words, a null id counts as an empty one, rows that repeat count each, a long text is read whole.
    No words give no rows. Extra columns are ignored.
    """
    known = words(docs, drop, length, least)
    pair = near_words(known.select("word"), pairs)
    both = pair.select(F.col("a").alias("word"), F.col("b").alias("other")).unionByName(pair.select(F.col("b").alias("word"), F.col("a").alias("other")))
    counted = materialize(both.join(known.select(F.col("word").alias("other"), F.col("n").alias("form_n")), "other"), "counted")
    best = counted.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("less"), F.col("other").alias("form"))).alias("best"))
    near = materialize(known.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "best.form", (-F.col("best.less")).alias("form_n")), "best")
    fits = F.col("form_n") >= times * F.col("n")
    named = near.select("word", F.when(fits, F.col("form")).alias("form"), "n", "n_near", F.when(fits, F.col("form_n")).alias("form_n"))
    root = roots(named.filter("form is not null").select("word", "form"))
    return named.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spelling variants among the words of all documents."""
    return spelling_variants(documents(spark, sf_dir).select("doc_id", "text"))
