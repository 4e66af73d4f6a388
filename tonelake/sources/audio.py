"""WAV clips as rows of samples."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare

CLIP = "clip string, sha256 string, rate int, channels int, samples array<float>, error string"


def decode(data: bytes) -> tuple[int, int, np.ndarray]:
    """Rate, channels and mono samples of PCM WAV bytes; raises ValueError for other content."""
    try:
        with wave.open(io.BytesIO(data)) as w:
            rate, channels, width, raw = w.getframerate(), w.getnchannels(), w.getsampwidth(), w.readframes(w.getnframes())
    except (wave.Error, EOFError) as e:
        raise ValueError(str(e)) from None
    if width not in (2, 4):
        raise ValueError(f"{8 * width}-bit samples")
    x = np.frombuffer(raw, "<i2" if width == 2 else "<i4").astype(np.float64) / float(1 << (8 * width - 1))
    return rate, channels, x.reshape(-1, channels).mean(1)


def read_clips(spark: SparkSession, path: str) -> DataFrame:
    """(clip, sha256, rate, channels, samples, error) of the WAV files below a path; what can't be read has an error."""
    prepare(spark)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for clip, data, sha in zip(*(b.column(c).to_pylist() for c in ("path", "content", "sha256")), strict=True):
                row = {"clip": clip, "sha256": sha, "rate": None, "channels": None, "samples": None, "error": None}
                try:
                    rate, channels, x = decode(data)
                    row |= {"rate": rate, "channels": channels, "samples": x.astype(np.float32).tolist()}
                except ValueError as e:
                    row["error"] = str(e)
                yield pa.RecordBatch.from_pylist([row], schema=_SCHEMA)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path)
    return files.select("path", "content", F.sha2("content", 256).alias("sha256")).mapInArrow(rows, CLIP)


_SCHEMA = pa.schema([("clip", pa.string()), ("sha256", pa.string()), ("rate", pa.int32()), ("channels", pa.int32()), ("samples", pa.list_(pa.float32())), ("error", pa.string())])
