"""Spelling variants against all pairs of words."""

from __future__ import annotations

import random
import re
from collections import Counter
from zlib import crc32

import pytest

from tonelake.llm import spelling

SCHEMA = "doc_id long, text string, path string, n long, word string"


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    return any((a[:k] + a[k + 1 :] == b[:k] + b[k + 1 :]) if len(a) == len(b) else a == b[:k] + b[k + 1 :] for k in range(len(b)))


def brute(rows, drop=97, length=5, least=3):
    counts: Counter = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if i is None else i}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if h % drop == 0 else w] += 1
    n = {w: c for w, c in counts.items() if len(w) >= length and c >= least}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {w: min(xs, key=lambda x: (-n[x], x)) for w, xs in near.items() if xs and max(n[x] for x in xs) >= 2 * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out)


def variants(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    return sorted(tuple(r) for r in spelling.spelling_variants(df, **more).select("word", "form", "root", "n", "n_near", "form_n").collect())


def corpus(seed: int) -> list[tuple[int | None, str | None]]:
    rng = random.Random(seed)
    base = ["".join(rng.choices("abé", k=rng.randrange(4, 9))) for _ in range(60)] + ["prefix" + "".join(rng.choices("abc×", k=rng.randrange(0, 5))) for _ in range(60)]
    words = [w for w in base for _ in range(rng.choice([1, 2, 4, 9, 30]))]
    rows: list[tuple[int | None, str | None]] = [(k, " ".join(rng.choices(words, k=60)).title()) for k in range(60)]
    return rows + [(61, None), (62, ""), (None, "null ident null ident null ident"), (63, "x" * 3000 + " "), (64, ("longer-" * 4000)), (5, rows[5][1]), (5, rows[5][1])]


@pytest.mark.parametrize(("seed", "pairs"), [(0, spelling.PAIRS), (1, 4)])
def test_equals_all_pairs(spark, seed, pairs):
    rows = corpus(seed)
    want = brute(rows, drop=7)
    got = variants(spark, rows, drop=7, pairs=pairs)
    assert got == want and any(r[1] and r[1] != r[2] for r in got)


def test_no_words(spark):
    assert variants(spark, []) == [] and variants(spark, [(1, None), (2, "ab cd")]) == []


def test_short_words(spark):
    """Words of any length, down to one letter."""
    rows = [(k, "a b ab ba abc aab é éa") for k in range(3)]
    assert variants(spark, rows, length=1) == brute(rows, length=1)
    assert variants(spark, rows, length=1, pairs=0) == brute(rows, length=1)
