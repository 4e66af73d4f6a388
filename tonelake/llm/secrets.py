"""Secret scans: patterns, and character Markov models of random strings against ordinary identifiers.

Two first-order models over the characters of tokens, one of random strings and one of ordinary words and identifiers, are
trained on labelled samples: made strings and matched values here, a sample's shorter words and identifiers of many spellings
there. A token is reported where its log-likelihood ratio favours the random model, and every match of
the patterns carries the ratio of its secret part.
"""

from __future__ import annotations

import importlib
import random
import re
import string
import sys
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare
from .common import documents, materialize, pieces

# The base patterns and the lengths that their matches need.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_MIN, ACCESS_MIN, HEX_MIN = 8, 16, 32
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "markov")

#: Tokens that the models judge, the nats a character and in all by which the random model has to win.
TOKEN_MIN, PER_CHARACTER, IN_ALL = 12, 0.35, 12.0
TOKEN = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{TOKEN_MIN},}}={{0,2}}")
IDENTIFIER = re.compile(r"[A-Za-z0-9+/_-]{4,}")
#: Documents of the training sample (the smallest hashes of their ids), and random strings made for it.
TRAIN_ROWS, RANDOM_STRINGS = 4_000, 4_000
ALPHABETS = (string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "_-", string.ascii_lowercase + string.digits, string.hexdigits[:16])
SMOOTHING = 0.5
#: Modules of the standard library whose names are labelled samples of identifiers, and how many joints are made of their words.
NAMED = ("argparse", "ast", "asyncio", "collections", "concurrent.futures", "configparser", "email.message", "http.client", "http.server", "io", "logging", "os", "pathlib", "shutil", "socket", "ssl", "string", "subprocess", "tarfile", "threading", "unittest.mock", "urllib.request", "xml.dom.minidom", "zipfile")
JOINTS = 12_000
WORD = re.compile("[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass(frozen=True, order=True)
class Span:
    """A match in code points, end exclusive; value is where its secret part begins."""

    start: int
    order: int
    end: int
    value: int

    @property
    def kind(self) -> str:
        return KINDS[self.order]


def base_spans(text: str) -> list[Span]:
    """The base patterns' matches, leftmost and non-overlapping within a kind."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [Span(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_MIN]
    if "AKIA" in text:
        out += [Span(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_MIN]
    if any(len(w) >= HEX_MIN for w in text.split()):
        out += [Span(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text) if m.end() - m.start() >= HEX_MIN]
    return out


def _codes(token: str) -> np.ndarray:
    return np.frombuffer(token.encode("latin-1"), np.uint8) & 127


class MarkovPair:
    """Log-likelihood ratios by pair of characters, from counts (label, a, b) -> n; label 1 is random. 0 begins a token."""

    def __init__(self, counts: dict[tuple[int, int, int], int]):
        tables = np.full((2, 128, 128), 0.0)
        for (label, a, b), n in counts.items():
            tables[label, a, b] += n
        size = len(set(string.ascii_letters + string.digits + "+/_=-"))
        logs = [np.log((t + SMOOTHING) / (t.sum(1, keepdims=True) + SMOOTHING * size)) for t in tables]
        self.ratio = logs[1] - logs[0]

    def score(self, token: str) -> float:
        c = _codes(token)
        return float(self.ratio[np.concatenate(([0], c[:-1])), c].sum())

    def secret(self, token: str) -> bool:
        s = self.score(token)
        return s >= IN_ALL and s >= PER_CHARACTER * len(token)


def _pairs(token: str, label: int) -> Iterator[tuple[int, int, int]]:
    c = _codes(token).tolist()
    return zip([label] * len(c), [0, *c[:-1]], c, strict=True)


def ordinary(text: str) -> list[str]:
    """Words and identifiers too short to be judged themselves, numbers, and words of letters in the case of words."""
    return [t for t in IDENTIFIER.findall(text) if len(t) < TOKEN_MIN or t.isdigit() or t.isalpha() and (t[1:].islower() or t.isupper())]


def random_strings(n: int = RANDOM_STRINGS, seed: int = 17) -> list[str]:
    """Made samples of the random class; those of two seeds are independent."""
    rng = random.Random(seed)
    return ["".join(rng.choices(ALPHABETS[k % len(ALPHABETS)], k=rng.randrange(TOKEN_MIN, 49))) for k in range(n)]


def _joint(parts: list[str], style: int) -> str:
    """Words written as one identifier: snake, kebab or path, capitals within, an acronym first, or all in capitals."""
    if style < 4:
        return ("_", "-", "/", "_")[style].join(parts)
    if style < 6:
        return "".join([parts[0] if style == 4 else parts[0].title(), *(w.title() for w in parts[1:])])
    return parts[0][:4].upper() + "".join(w.title() for w in parts[1:]) if style == 6 else "_".join(parts).upper()


def identifiers(seed: int = 29) -> list[str]:
    """Labelled samples of the ordinary class: names of the standard library, and joints of their words with numbers here and there."""
    names = set(sys.stdlib_module_names)
    for m in NAMED:
        for name, value in vars(importlib.import_module(m)).items():
            names |= {name, *(vars(value) if isinstance(value, type) else ())}
    names = {n for n in names if isinstance(n, str) and n.isascii()}
    words = sorted({w.lower() for n in names for w in WORD.findall(n) if len(w) > 1})
    rng = random.Random(seed)
    out = sorted(names)
    for k in range(JOINTS):
        parts = rng.choices(words, k=rng.randrange(2, 7))
        for at in range(1, len(parts)):
            if rng.random() < 0.15:
                parts[at] = rng.choice([str(rng.randrange(10 ** rng.randrange(1, 5))), parts[at] + str(rng.randrange(100)), "v" + str(rng.randrange(20))])
        if k % 24 == 2:
            parts[0] = "/" + parts[0]
        out.append(_joint(parts, k % 8))
    return out


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> MarkovPair:
    """The models from at most rows documents.

    Random samples are the values that the base patterns match there and made strings; ordinary samples are the
    shorter words and identifiers outside them, and labelled identifiers, which weigh as much as all of those together.
    Only counts of character pairs reach the driver.
    """
    spark = docs.sparkSession
    ids = materialize(docs.select("doc_id").filter("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).distinct(), "sample")
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # at most rows ids

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for b in pieces(batches):
            for text in b.column("text").to_pylist():
                text, at = text or "", 0
                for span in sorted(base_spans(text)):
                    for t in ordinary(text[at : span.start]):
                        n.update(_pairs(t, 0))
                    for t in TOKEN.findall(text[span.value : span.end]):
                        n.update(_pairs(t, 1))
                    at = max(at, span.end)
                for t in ordinary(text[at:]):
                    n.update(_pairs(t, 0))
        rows = [(*k, v) for k, v in n.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(4)], ["label", "a", "b", "n"])

    found = sample.select("text").mapInArrow(counted, "label long, a long, b long, n long").groupBy("label", "a", "b").agg(F.sum("n").alias("n"))
    counts: Counter = Counter({(r.label, r.a, r.b): r.n for r in found.collect()})
    for t in random_strings():
        counts.update(_pairs(t, 1))
    return MarkovPair(dict(counts + weighed(counts)))


def weighed(counts: Counter) -> Counter:
    """Counts of the labelled identifiers, as many times over as makes them no fewer than the ordinary pairs counted so far."""
    named = Counter(p for t in identifiers() for p in _pairs(t, 0))
    times = max(1, -(-sum(n for (label, _, _), n in counts.items() if label == 0) // named.total()))
    return Counter({p: n * times for p, n in named.items()})


def _apart(spans: list[Span]) -> tuple[list[int], list[int]]:
    """Starts and ends of the union of sorted spans."""
    starts, ends = [], []
    for s in spans:
        if ends and s.start <= ends[-1]:
            ends[-1] = max(ends[-1], s.end)
        else:
            starts.append(s.start)
            ends.append(s.end)
    return starts, ends


def scan_text(text: str | None, model: MarkovPair | None) -> list[tuple[Span, float | None]]:
    """All spans by start, then kind, with the ratios of their secret parts: the base ones, and tokens that look random.

    Without a model there are base spans alone, and no ratios. A token that overlaps a base span adds none of its own. The work is in proportion to the text, up to a logarithm.
    """
    if not text:
        return []
    base = sorted(base_spans(text))
    if model is None:
        return [(s, None) for s in base]
    out = [(s, model.score(text[s.value : s.end])) for s in base]
    if any(len(w) >= TOKEN_MIN for w in text.split()):
        starts, ends = _apart(base)
        for m in TOKEN.finditer(text):
            k = bisect_left(ends, m.start() + 1)
            if (k == len(ends) or starts[k] >= m.end()) and model.secret(m[0]):
                out.append((Span(m.start(), 3, m.end(), m.start()), model.score(m[0])))
    return sorted(out)


def scan(docs: DataFrame, model: MarkovPair | None) -> DataFrame:
    """(doc_id, found) for every row, found being an array of (kind, start, end, text, ratio) in code points, end exclusive.

    ratio is the log-likelihood ratio of the secret part, in nats; above zero the random model has won. A null or empty text
    has no span. Repeated rows each get theirs. Extra columns are ignored. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = {"kind": pa.string(), "start": pa.int64(), "end": pa.int64(), "text": pa.string(), "ratio": pa.float64()}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in pieces(batches):
            found = [[{"kind": s.kind, "start": s.start, "end": s.end, "text": t[s.start : s.end], "ratio": r} for s, r in scan_text(t, model)] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.list_(pa.struct(list(fields.items()))))], ["doc_id", "found"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, "doc_id long, found array<struct<kind:string,start:long,end:long,text:string,ratio:double>>")


_SPAN = "x -> concat_ws(':', x.kind, string(x.start), string(x.end))"
#: Columns of base spans, from found.
BASE = (
    "doc_id",
    *(f"bigint(size(filter(found, x -> x.kind = '{k}'))) AS n_{k}" for k in KINDS[:3]),
    f"sha2(array_join(transform(filter(found, x -> x.kind != 'markov'), {_SPAN}), ','), 256) AS base_sha256",
)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of all documents, as counts and digests of their spans.

    n_markov counts the spans that the models add, n_random the base spans that they would have reported too.
    """
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return scan(docs, train(docs)).selectExpr(
        *BASE,
        f"array_join(transform(found, {_SPAN}), ',') AS spans",
        "bigint(size(filter(found, x -> x.kind = 'markov'))) AS n_markov",
        f"bigint(size(filter(found, x -> x.kind != 'markov' and x.ratio >= {IN_ALL}))) AS n_random",
    )


def secrets_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base spans of op6 by a scan without models, which SQL can express too."""
    return scan(documents(spark, sf_dir).select("doc_id", "text"), None).selectExpr(*BASE)
