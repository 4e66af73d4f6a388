"""Binary preset files as long tables, and back.

A file is a run of NUL-terminated strings. A value follows its key behind a prefix of three bytes: 01, a length, and 05 for
text (the length counts the text and two more), 04 for an eight-byte little-endian double or 06 for opaque bytes. Every byte of
a file belongs to one token, so that the tokens' bytes joined are the file.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.values import number_text
from ..session import prepare

TOKENS = "preset_id string, idx int, raw_prefix binary, value string, terminator binary, payload binary"
#: The bytes of a text value at most, and the key whose value names the module of the keys after it.
VALUE_BYTES, MODULE_KEY = 253, "subModels"


def tokenize(data: bytes) -> list[tuple[bytes, str | None, bytes, bytes | None]]:
    """(prefix, value, terminator, payload) of each token; payload is set for doubles and opaque values."""
    out, at = [], 0
    while at < len(data):
        kind = data[at + 2] if data[at] == 1 and at + 2 < len(data) else None
        size = data[at + 1] if kind is not None else 0
        if kind == 5 and size >= 2 and data[at + 1 + size : at + 2 + size] == b"\x00":
            text = _text(data[at + 3 : at + 1 + size])
            if text is not None:
                out.append((data[at : at + 3], text, b"\x00", None))
                at += size + 2
                continue
        if kind in (4, 6) and size == 9 and at + 11 < len(data) and data[at + 11] == 0:
            payload = data[at + 3 : at + 11]
            out.append((data[at : at + 3], None, b"\x00", payload))
            at += 12
            continue
        end = data.find(b"\x00", at)
        end = len(data) if end < 0 else end
        text = _text(data[at:end])
        out.append((b"" if text is not None else data[at:end], text or "", data[end : end + 1], None))
        at = end + 1
    return out


def _text(data: bytes) -> str | None:
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return None


def encode_text(value: str) -> bytes:
    """A text value with its prefix and terminator; raises ValueError for one that the length byte can't tell, or with a NUL."""
    data = value.encode()
    if len(data) > VALUE_BYTES or b"\x00" in data:
        raise ValueError(f"a value of {len(data)} bytes")
    return bytes([1, len(data) + 2, 5]) + data + b"\x00"


def read_presets(spark: SparkSession, path: str) -> DataFrame:
    """(preset_id, content) of the preset files below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("preset_id"), "content")


def tokens(presets: DataFrame) -> DataFrame:
    """One row per token of presets (preset_id, content); see TOKENS."""
    prepare(presets.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                t = tokenize(data or b"")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i] * len(t), pa.string()), pa.array(range(len(t)), pa.int32())] + [pa.array([x[c] for x in t], pa.string() if c == 1 else pa.binary()) for c in range(4)],
                    ["preset_id", "idx", "raw_prefix", "value", "terminator", "payload"],
                )

    return presets.select(F.col("preset_id").cast("string"), "content").mapInArrow(rows, TOKENS)


def token_bytes():
    """The bytes of a token's row."""
    return F.concat(F.col("raw_prefix"), F.coalesce(F.col("payload"), F.encode("value", "UTF-8")), F.col("terminator"))


def assemble(token_rows: DataFrame) -> DataFrame:
    """(preset_id, content): the files that tokens came from. A preset is one file, so its tokens fit a row."""
    parts = token_rows.groupBy("preset_id").agg(F.array_sort(F.collect_list(F.struct("idx", token_bytes().alias("b")))).alias("t"))
    return parts.select("preset_id", F.aggregate("t", F.expr("cast('' as binary)"), lambda s, x: F.concat(s, x["b"])).alias("content"))


def structure(token_rows: DataFrame) -> DataFrame:
    """(preset_id, ord, module, key, stored, key_index, value_index): keys with the values that follow them.

    A value token has a prefix; the module is the last value of MODULE_KEY before a key, found by a running window.
    """
    w = W.partitionBy("preset_id").orderBy("idx")
    is_value = F.col("payload").isNotNull() | (F.col("raw_prefix").substr(3, 1) == F.expr("X'05'"))
    t = token_rows.withColumn("is_value", F.coalesce(is_value, F.lit(False)))
    t = t.withColumns({"next": F.lead("is_value").over(w), "stored": F.lead(F.coalesce("value", F.hex("payload"))).over(w)})
    keys = t.filter("not is_value and next")
    module = F.last(F.when(F.col("value") == MODULE_KEY, F.col("stored")), ignorenulls=True).over(w)
    keys = keys.withColumns({"module": F.coalesce(module, F.lit("")), "ord": F.row_number().over(w) - 1})
    return keys.filter(F.col("value") != MODULE_KEY).select("preset_id", "ord", "module", F.col("value").alias("key"), "stored", F.col("idx").alias("key_index"), (F.col("idx") + 1).alias("value_index"))


def set_values(token_rows: DataFrame, changes: DataFrame) -> DataFrame:
    """Tokens with the text values at (preset_id, idx) replaced, their length bytes put right; too long a value stops the query."""
    new = F.encode("new", "UTF-8")
    size = F.octet_length(new)
    fits = F.when(size > VALUE_BYTES, F.raise_error(F.lit("a value is longer than its length byte can tell"))).otherwise(size + 2)
    prefix = F.unhex(F.concat(F.lit("01"), F.lpad(F.hex(fits.cast("long")), 2, "0"), F.lit("05")))
    both = token_rows.join(changes.select("preset_id", "idx", "new"), ["preset_id", "idx"], "left")
    return both.withColumns({"raw_prefix": F.when(F.col("new").isNotNull(), prefix).otherwise(F.col("raw_prefix")), "value": F.coalesce("new", "value")}).drop("new")


def double_text(payload: Column) -> Column:
    """A double's payload (8 bytes, the least significant first) as plain text; null for other widths and for non-numbers."""
    prepare(SparkSession.getActiveSession())

    @F.pandas_udf("double")
    def value(b: pd.Series) -> pd.Series:
        return b.map(lambda x: struct.unpack("<d", x)[0] if x is not None and len(x) == 8 else None).astype("float64")

    x = value(payload)
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), number_text(x))


def double_payload(x: Column) -> Column:
    """The 8 bytes that hold a number, the least significant first; null for null."""
    prepare(SparkSession.getActiveSession())

    @F.pandas_udf("binary")
    def packed(v: pd.Series) -> pd.Series:
        return v.map(lambda y: None if pd.isna(y) else struct.pack("<d", y)).astype(object)

    return packed(x.cast("double"))


def set_numbers(token_rows: DataFrame, changes: DataFrame) -> DataFrame:
    """Tokens with the numbers of binary values at (preset_id, idx) replaced; their width stays, whatever the number.

    A change of a token without an 8-byte payload stops the query.
    """
    both = token_rows.join(changes.select("preset_id", "idx", "new"), ["preset_id", "idx"], "left")
    fits = F.when(F.col("new").isNull(), F.col("payload")).when(F.octet_length("payload") == 8, double_payload(F.col("new")))
    checked = F.when(F.col("new").isNotNull() & ~F.coalesce(F.octet_length("payload") == 8, F.lit(False)), F.raise_error(F.lit("no double stands there")).cast("binary")).otherwise(fits)
    return both.withColumn("payload", checked).drop("new")


def param_records(token_rows: DataFrame) -> DataFrame:
    """(preset_id, ord, id, stored, number): the PARAM records of presets that name parameters by a field of a record.

    A record is the token PARAM, perhaps with a counting byte before its name, then id and its text, then perhaps value and a
    text or a double. A record without a value is a row with null stored.
    """
    w = W.partitionBy("preset_id").orderBy("idx")
    text = F.regexp_replace("value", "^[\\x01-\\x1f]+", "")  # counting bytes
    is_record = F.coalesce(text.rlike("^[\\x21-\\x7e]?PARAM$"), F.lit(False))
    t = token_rows.withColumns({"record": F.sum(is_record.cast("int")).over(w), "next": F.lead("value").over(w), "next_payload": F.lead("payload").over(w)})
    t = t.filter("record > 0")
    first = lambda name, c: F.min(F.when(text == name, F.struct("idx", c.alias("v"))))
    out = t.groupBy("preset_id", "record").agg(first("id", F.col("next")).alias("i"), first("value", F.col("next")).alias("s"), first("value", F.col("next_payload")).alias("p"))
    number = double_text(F.col("p.v"))
    return out.filter("i is not null").select("preset_id", (F.col("record") - 1).alias("ord"), F.col("i.v").alias("id"), F.coalesce(number, F.col("s.v")).alias("stored"), number.try_cast("double").alias("number"))
