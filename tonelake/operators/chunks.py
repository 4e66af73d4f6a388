"""Clips as rows of chunks: (clip, chunk, samples), chunks gapless from 0 and all of one length but a clip's last.

What crosses a chunk's borders comes from the chunks around it by a window over the clip, a few chunks at a time, so that a clip
of any length is worked on in parts. Null samples aren't allowed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import prepare
from .calibration import TRUSTED


def chunked(clips: DataFrame, length: int, clip: str = "clip", samples: str = "samples") -> DataFrame:
    """The chunks of clips (clip, samples array), for clips that fit a row; an empty clip has none."""
    n = F.ceil(F.size(samples) / length).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return clips.select(clip, samples, F.explode(at).alias("chunk")).select(F.col(clip).alias("clip"), F.col("chunk").cast("long").alias("chunk"), F.slice(samples, F.col("chunk") * length + 1, length).cast("array<double>").alias("samples"))


def _around(chunks: DataFrame, before: int, after: int) -> Column:
    """The samples of a chunk and of so many chunks before and after it."""
    near = W.partitionBy("clip").orderBy("chunk").rowsBetween(-before, after)
    return F.flatten(F.collect_list("samples").over(near))


def frames(chunks: DataFrame, length: int, size: int, hop: int) -> DataFrame:
    """(clip, frame, samples): overlapping whole frames of clips, each made where it begins; frames equal those of whole clips."""
    span = -(-(size - 1) // length)
    x = chunks.select("clip", "chunk", F.size("samples").alias("own"), _around(chunks, 0, span).alias("all"))
    first = F.ceil(F.col("chunk") * length / hop)
    last = F.floor((F.col("chunk") * length + F.least(F.col("own") - 1, F.size("all") - size)) / hop)
    x = x.select("clip", "chunk", "all", first.alias("first"), last.alias("last")).filter("last >= first")
    x = x.select("clip", "chunk", "all", F.explode(F.sequence("first", "last")).alias("frame"))
    return x.select("clip", "frame", F.slice("all", (F.col("frame") * hop - F.col("chunk") * length + 1).cast("int"), size).alias("samples"))


def sums(chunks: DataFrame) -> DataFrame:
    """(clip, n, mean, energy): energy is about the mean."""
    fold = lambda f: F.aggregate("samples", F.lit(0.0), f)
    s = chunks.groupBy("clip").agg(F.sum(F.size("samples")).alias("n"), F.sum(fold(lambda a, x: a + x)).alias("s"), F.sum(fold(lambda a, x: a + x * x)).alias("q"))
    return s.select("clip", "n", (F.col("s") / F.col("n")).alias("mean"), F.greatest(F.col("q") - F.col("s") * F.col("s") / F.col("n"), F.lit(0.0)).alias("energy"))


def aligned(a: DataFrame, b: DataFrame, length: int, reach: int) -> DataFrame:
    """(clip, offset, fraction, r, polarity, trusted): by how many samples b is late against a, and a fraction from -0.5 to 0.5.

    Each chunk of a meets the samples of b within reach of it by one Fourier product, and the products are summed over chunks by lag.
    The strongest correlation of either sign stands, the smallest lag of equals; a parabola through it and its neighbours gives the
    fraction. Clips of one side only are left out; without energy on both sides nothing is late, r is 0 and not trusted.
    """
    prepare(a.sparkSession)
    span = -(-reach // length)
    sa, sb = sums(a), sums(b)
    around = b.select("clip", "chunk", _around(b, span, span).alias("y"), F.least(F.col("chunk"), F.lit(span)).alias("before"))
    # Chunks of a beyond the end of b still meet its last samples.
    ends = b.groupBy("clip").agg(F.max("chunk").alias("last"))
    x = a.join(ends, "clip").filter(F.col("chunk") <= F.col("last") + span).withColumn("at", F.least("chunk", "last"))
    both = x.join(around.select("clip", F.col("chunk").alias("at"), "y", "before"), ["clip", "at"])
    both = both.join(sa.select("clip", F.col("mean").alias("ma")), "clip").join(sb.select("clip", F.col("mean").alias("mb")), "clip")
    start = ((F.col("at") - F.col("before") - F.col("chunk")) * length).cast("int")  # of y, counted from the chunk's first sample

    @F.pandas_udf("array<double>")
    def products(x: pd.Series, y: pd.Series, start: pd.Series, ma: pd.Series, mb: pd.Series) -> pd.Series:
        out = []
        for u, v, s, m, k in zip(x, y, start, ma, mb, strict=True):
            u = np.asarray(u, float) - m
            held = np.zeros(len(u) + 2 * reach)  # b from reach samples before the chunk to reach after it
            lo, hi = max(s, -reach), min(s + len(v), len(u) + reach)
            if hi > lo:
                held[lo + reach : hi + reach] = np.asarray(v[lo - s : hi - s], float) - k
            size = 1 << int(np.ceil(np.log2(len(held) + len(u))))
            c = np.fft.irfft(np.fft.rfft(held, size) * np.conj(np.fft.rfft(u, size)), size)
            out.append(c[: 2 * reach + 1])
        return pd.Series(out)

    each = both.select("clip", F.posexplode(products("samples", "y", start, "ma", "mb")).alias("lag", "c"))
    lags = each.groupBy("clip", (F.col("lag") - reach).alias("lag")).agg(F.sum("c").alias("c"))
    w = W.partitionBy("clip").orderBy("lag")  # 2 * reach + 1 rows a clip
    lags = lags.withColumns({"before": F.abs(F.lag("c").over(w)), "after": F.abs(F.lead("c").over(w))})
    best = lags.groupBy("clip").agg(F.max(F.struct(F.abs("c").alias("m"), (-F.abs("lag")).alias("near"), (-F.col("lag")).alias("sign"), "lag", "c", "before", "after")).alias("t"))
    norm = sa.select("clip", F.col("energy").alias("ea")).join(sb.select("clip", F.col("energy").alias("eb")), "clip").select("clip", F.sqrt(F.col("ea") * F.col("eb")).alias("norm"))
    curve = F.col("t.before") - 2 * F.col("t.m") + F.col("t.after")
    fraction = F.coalesce(F.when(curve != 0, F.greatest(F.least(0.5 * (F.col("t.before") - F.col("t.after")) / curve, F.lit(0.5)), F.lit(-0.5))), F.lit(0.0))
    r = F.when(F.col("norm") > 0, F.col("t.c") / F.col("norm")).otherwise(0.0)
    sound = F.col("norm") > 0
    out = best.join(norm, "clip").select("clip", F.when(sound, F.col("t.lag")).otherwise(0).cast("long").alias("offset"), F.when(sound, fraction).otherwise(0.0).alias("fraction"), r.alias("r"))
    return out.withColumns({"polarity": F.when(F.col("r") < 0, -1).otherwise(1), "trusted": F.abs("r") >= TRUSTED})


def shifted(chunks: DataFrame, delays: DataFrame, length: int, halo: int) -> DataFrame:
    """Chunks delayed by (clip, delay) samples, whole and fractional, with zeros from outside the clip; chunks keep their places.

    The fraction is a turn of phase over the chunk and halo samples around it, which fade in and out, so that the turn doesn't run
    round the block. |delay| has to be at most halo. Clips without a delay are left out.
    """
    prepare(chunks.sparkSession)
    span = -(-2 * halo // length)
    x = chunks.select("clip", "chunk", F.size("samples").alias("own"), _around(chunks, span, span).alias("all"), (F.least("chunk", F.lit(span)) * length).cast("int").alias("before"))

    @F.pandas_udf("array<double>")
    def moved(own: pd.Series, near: pd.Series, before: pd.Series, delay: pd.Series) -> pd.Series:
        out = []
        for n, v, s, d in zip(own, near, before, delay, strict=True):
            block = np.zeros(n + 4 * halo)
            lo, hi = max(-2 * halo, -s), min(n + 2 * halo, len(v) - s)
            block[lo + 2 * halo : hi + 2 * halo] = np.asarray(v[lo + s : hi + s], float)
            fade = np.sin(np.linspace(0, np.pi / 2, halo)) ** 2
            block[:halo] *= fade
            block[len(block) - halo :] *= fade[::-1]
            f = np.fft.rfftfreq(len(block))
            out.append(np.fft.irfft(np.fft.rfft(block) * np.exp(-2j * np.pi * f * d), len(block))[2 * halo : 2 * halo + n])
        return pd.Series(out)

    return x.join(delays.select("clip", "delay"), "clip").select("clip", "chunk", moved("own", "all", "before", "delay").alias("samples"))


def put_in_line(b: DataFrame, found: DataFrame, length: int, halo: int) -> DataFrame:
    """b moved onto its reference by what aligned() found, its polarity put right; a clip that isn't trusted stays as it is."""
    late = F.when(F.col("trusted"), -(F.col("offset") + F.col("fraction"))).otherwise(0.0)
    sign = F.when(F.col("trusted"), F.col("polarity")).otherwise(1)
    moved = shifted(b, found.select("clip", late.alias("delay")), length, halo)
    return moved.join(found.select("clip", sign.alias("sign")), "clip").select("clip", "chunk", F.transform("samples", lambda x: x * F.col("sign")).alias("samples"))
