"""Toxicity severity by cumulative-link ordinal regression.

P(grade <= k) = sigmoid(theta_k - w . x): one weight vector for all thresholds theta_1 < theta_2 < ..., over the presence
of words. The expected severity is the sum over k of P(grade > k).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare
from .common import by_ids, documents, materialize, pieces

#: Labelled documents to fit on, half of each class where there are as many: the smallest hashes of their ids.
TRAIN_ROWS = 8_000
#: Words that become features: at least MIN_DOCS training documents hold them, and their log-odds differ by MIN_Z errors.
FEATURES, MIN_DOCS, MIN_Z = 4_096, 5, 3.5
#: Grades 1, 2 and 3 of toxic training documents part at these quantiles of their count of distinct cue words.
SPLITS = (1 / 3, 2 / 3)
L2, STEPS, RATE = 1e-3, 400, 0.1
#: Expected severity from which a document is rejected.
REJECT = 0.5

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> set[str]:
    """Distinct lower-case runs of letters; none for a null or empty text."""
    return set(_WORD.findall(text.lower())) if text else set()


@dataclass(frozen=True)
class OrdinalModel:
    weights: dict[str, float]
    thresholds: tuple[float, ...]

    def score(self, words: set[str]) -> float:
        return sum(self.weights[w] for w in sorted(words & self.weights.keys()))

    def exceed(self, score: float) -> list[float]:
        """P(grade > k) for each threshold."""
        return [float(1 / (1 + np.exp(np.clip(t - score, -500, 500)))) for t in self.thresholds]


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, grades: np.ndarray, features: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds for binary features given as (row, column) pairs, by Adam on the penalised likelihood."""
    n, top = len(grades), int(grades.max(initial=0))
    shares = np.array([np.clip((grades <= k).mean(), 1e-3, 1 - 1e-3) for k in range(top)])
    first = np.log(shares / (1 - shares))
    z = np.concatenate((np.zeros(features), first[:1], np.log(np.maximum(np.diff(first), 1e-2))))
    m, v = np.zeros_like(z), np.zeros_like(z)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -500, 500)))
    for step in range(1, STEPS + 1):
        w, theta = z[:features], np.cumsum(np.concatenate((z[features : features + 1], np.exp(z[features + 1 :]))))
        s = np.bincount(rows, weights=w[cols], minlength=n)
        edge = np.concatenate(([-np.inf], theta, [np.inf]))
        hi, lo = sigmoid(edge[grades + 1] - s), sigmoid(edge[grades] - s)
        p = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
        g_theta = np.array([-(d_hi[grades == k].sum() - d_lo[grades == k + 1].sum()) / n for k in range(top)])
        g_w = np.bincount(cols, weights=((d_hi - d_lo) / n)[rows], minlength=features) + L2 * w
        g = np.concatenate((g_w, [g_theta.sum()], [g_theta[k:].sum() * np.exp(z[features + k]) for k in range(1, top)]))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        z = z - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return z[:features], np.cumsum(np.concatenate((z[features : features + 1], np.exp(z[features + 1 :]))))


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, toxic, words) of at most rows labelled documents; labels contradicting for one id count as toxic."""
    one = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = [one.filter(c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows // 2) for c in ("toxic > 0", "toxic <= 0")]
    picked = materialize(picked[0].unionByName(picked[1]), "picked")
    found = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(picked), "doc_id")  # at most rows rows

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            bags = [sorted(words_of(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), pa.array(bags, pa.list_(pa.string()))], ["doc_id", "toxic", "words"])

    return found.select("doc_id", F.col("toxic").cast("int"), "text").mapInArrow(words, "doc_id long, toxic int, words array<string>")


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> OrdinalModel:
    """A model of toxicity grades 0 to 3 from binary labels.

    The labels hold one bit, so the grades of toxic documents are thirds of their number of distinct cue words, where a cue
    is a feature word whose log-odds point to the toxic class. Without documents of both classes the model has no feature
    and rejects nothing.
    """
    sample = materialize(training_sample(docs, labels, rows), "training")
    sizes = {r.toxic: r["count"] for r in sample.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return OrdinalModel({}, (50.0, 51.0, 52.0))
    held = sample.select(F.explode("words").alias("word"), (F.col("toxic") > 0).cast("int").alias("toxic"))
    held = held.groupBy("word").agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).filter(F.col("n") >= MIN_DOCS)
    a, b = F.col("t") + 0.5, F.col("n") - F.col("t") + 0.5
    odds = F.log(a / (n1 - F.col("t") + 0.5)) - F.log(b / (n0 - F.col("n") + F.col("t") + 0.5))
    error = F.sqrt(1 / a + 1 / b)
    chosen = held.withColumn("z", odds / error).filter(F.abs("z") >= MIN_Z).orderBy(F.desc(F.abs("z")), "word").limit(FEATURES).collect()
    if not chosen:
        return OrdinalModel({}, (50.0, 51.0, 52.0))
    index = {r.word: k for k, r in enumerate(chosen)}
    cue = np.array([r.z > 0 for r in chosen])
    kept = F.array_intersect("words", F.lit(list(index)))
    bags = sample.select("doc_id", "toxic", kept.alias("words")).orderBy("doc_id", "toxic").collect()  # at most rows short lists
    at = [(i, index[w]) for i, r in enumerate(bags) for w in r.words]
    rows_, cols = (np.array(x, np.int64) for x in (zip(*at) if at else ((), ())))
    toxic = np.array([r.toxic > 0 for r in bags])
    cues = np.bincount(rows_, weights=cue[cols].astype(float), minlength=len(bags))
    cuts = np.quantile(cues[toxic], SPLITS)
    grades = np.where(toxic, 1 + (cues[:, None] > cuts).sum(1), 0)
    present = np.unique(grades)
    weights, theta = fit_ordinal(rows_, cols, np.searchsorted(present, grades), len(index))
    return OrdinalModel({w: float(weights[k]) for w, k in index.items()}, tuple(float(x) for x in theta))


def score(docs: DataFrame, model: OrdinalModel, reject: float = REJECT) -> DataFrame:
    """(doc_id, expected_severity, severity, toxic) for every row; a null or empty text has no features.

    severity is the number of thresholds that are exceeded with a probability of at least one half.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in pieces(batches):
            p = [model.exceed(model.score(words_of(t))) for t in b.column("text").to_pylist()]
            expected = [sum(x) for x in p]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(expected, pa.float64()), pa.array([sum(y >= 0.5 for y in x) for x in p], pa.int32()), pa.array([e >= reject for e in expected], pa.bool_())],
                ["doc_id", "expected_severity", "severity", "toxic"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, "doc_id long, expected_severity double, severity int, toxic boolean")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of all documents, with the model fitted on a bounded sample of labelled ones."""
    prepare(spark)
    docs = documents(spark, sf_dir)
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the model fitted on labels doesn't reject, with their columns; an id goes with any of its rows."""
    prepare(docs.sparkSession)
    bad = materialize(score(docs, fit(docs, labels)).filter("toxic and doc_id is not null").select("doc_id").distinct(), "toxic")
    return by_ids(docs, bad, "doc_id", "left_anti")
