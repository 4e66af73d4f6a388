"""Chat formatting of typed content parts.

A visitor flattens the text, image, audio and document parts of a turn, in order, into one segment of text: texts with
their control strings escaped, attachments as placeholders. It records each attachment's reference and the tokens that its
placeholder expands to. A conversation's formatted text is its segments in order; a segment stands alone, so that turns
are formatted where they lie. Escaping adds a backslash inside every control string and is undone exactly.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare
from .common import pieces

#: Marks of the template, and placeholders by type of attachment.
OPEN, BODY, CLOSE = "<|turn|>", "<|text|>", "<|end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
#: Tokens that attachments expand to: of an image per square of PATCH pixels, of a second of audio, of a document's page.
PATCH, AUDIO_TOKENS, PAGE_TOKENS = 28, 25, 512
#: A control string, less its first character and the backslashes that escape it: of this template and of common others.
_REST = r"\\*(?=\||/?s>|unk>|pad>|/?SYS>>|/?INST\])"
_ESCAPE = re.compile(rf"([<\[])(?={_REST})")
_UNESCAPE = re.compile(rf"([<\[])\\(?={_REST})")
_SEGMENT = re.compile(rf"{re.escape(OPEN)}(.*?){re.escape(BODY)}(.*){re.escape(CLOSE)}\n", re.DOTALL)

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
TURN = "conv_id long, turn long, role string, segment string, loss_start long, loss_end long, attachments array<struct<type:string,ref:string,at:long,tokens:long>>, text_tokens long, expanded_tokens long"


def escape(text: str) -> str:
    """Text without control strings, from which unescape gives it back."""
    return _ESCAPE.sub(r"\1\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def words(text: str) -> int:
    """The default token count of a text: runs of word characters and single other characters that aren't space."""
    return len(re.findall(r"\w+|[^\w\s]", text))


@dataclass
class Flattener:
    """Visits the parts of one turn."""

    out: list[str] = field(default_factory=list)
    at: int = 0
    attachments: list[dict] = field(default_factory=list)
    text_tokens: int = 0

    def visit(self, part: dict) -> None:
        """A part of another type, or null, counts as its text."""
        getattr(self, f"visit_{part['type']}", self.visit_text)(part) if part else None

    def visit_text(self, part: dict) -> None:
        text = part.get("text") or ""
        self.text_tokens += words(text)
        self._put(escape(text))

    def visit_image(self, part: dict) -> None:
        self._attach(part, math.ceil(max(1, part.get("width") or 1) / PATCH) * math.ceil(max(1, part.get("height") or 1) / PATCH))

    def visit_audio(self, part: dict) -> None:
        seconds = part.get("seconds") or 0
        self._attach(part, math.ceil(seconds * AUDIO_TOKENS) if math.isfinite(seconds) else 1)

    def visit_document(self, part: dict) -> None:
        self._attach(part, (part.get("pages") or 1) * PAGE_TOKENS)

    def _attach(self, part: dict, tokens: int) -> None:
        self.attachments.append({"type": part["type"], "ref": part.get("ref"), "at": self.at, "tokens": max(1, tokens)})
        self._put(PLACEHOLDERS[part["type"]])

    def _put(self, text: str) -> None:
        self.out.append(text)
        self.at += len(text)


def format_turn(role: str | None, parts: list[dict] | None, learn: frozenset[str] = frozenset({"assistant"})) -> dict:
    """A turn's segment, the span of it under the loss mask (code points; null for roles not learned), attachments and tokens."""
    head = f"{OPEN}{escape(role or '')}{BODY}"
    v = Flattener(at=len(head))
    for part in parts or []:
        v.visit(part)
    body = "".join(v.out)
    learned = role in learn
    return {
        "segment": f"{head}{body}{CLOSE}\n",
        "loss_start": len(head) if learned else None,
        "loss_end": len(head) + len(body) if learned else None,
        "attachments": v.attachments,
        "text_tokens": v.text_tokens,
        "expanded_tokens": v.text_tokens + sum(a["tokens"] for a in v.attachments),
    }


def read_segment(segment: str) -> tuple[str, str]:
    """(role, text) of a segment; attachments stay as placeholders. Raises ValueError for what is no single segment."""
    m = _SEGMENT.fullmatch(segment)
    if not m or any(x in m[2] for x in (OPEN, BODY, CLOSE)):
        raise ValueError(f"no segment: {segment[:80]!r}")
    return unescape(m[1]), unescape(m[2])


def format_turns(turns: DataFrame) -> DataFrame:
    """One row per turn (see TURN) of turns (conv_id, turn, role, parts), parts being an array of PART.

    Null parts and null texts are empty, a null role is an empty one. A size that is null, zero, negative or not a number
    counts like the least attachment. Repeated turns are kept. Extra columns are ignored. An empty table gives no rows.
    """
    prepare(turns.sparkSession)
    made = pa.struct([("type", pa.string()), ("ref", pa.string()), ("at", pa.int64()), ("tokens", pa.int64())])
    kinds = {"segment": pa.string(), "loss_start": pa.int64(), "loss_end": pa.int64(), "attachments": pa.list_(made), "text_tokens": pa.int64(), "expanded_tokens": pa.int64()}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "parts"):
            out = [format_turn(r, p) for r, p in zip(b.column("role").to_pylist(), b.column("parts").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("conv_id", "turn", "role")] + [pa.array([x[c] for x in out], t) for c, t in kinds.items()], ["conv_id", "turn", "role", *kinds])

    return turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("parts").cast(f"array<{PART}>")).mapInArrow(rows, TURN)


def read_conversations(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, read back from its segments.

    A digest takes a conversation's turns in order, so a task streams through its conversations and holds one turn at a time;
    formatting, which does the work, isn't bound to conversations. Equal turn numbers stand in the order of role and segment.
    """
    out = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None

        def done(s: list) -> list:
            return [s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]]

        for b in pieces(batches, "segment"):
            closed = []
            for conv, segment, start, end in zip(*(b.column(c).to_pylist() for c in ("conv_id", "segment", "loss_start", "loss_end")), strict=True):
                if state is None or state[0] != conv:
                    closed += [done(state)] if state else []
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = read_segment(segment)
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                if start is not None:
                    learned = unescape(segment[start:end])
                    state[3] += len(learned)
                    state[4].update(learned.encode())
                state[5] += len(segment)
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in closed], t) for c, t in enumerate(kinds)], names)
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(done(state), kinds, strict=True)], names)

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    n = int(formatted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = formatted.select("conv_id", "turn", "role", "segment", "loss_start", "loss_end").repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "segment")
    return ordered.mapInArrow(rows, out)


#: A conversation whose texts are control strings of another template.
HOSTILE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and HOSTILE, formatted and read back."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(spark.createDataFrame(HOSTILE, "conv_id long, turn long, role string, text string"))
    part = F.expr("array(named_struct('type', 'text', 'text', coalesce(text, ''), 'ref', null, 'width', null, 'height', null, 'seconds', null, 'pages', null))").cast(f"array<{PART}>")
    return read_conversations(format_turns(turns.select("conv_id", "turn", "role", part.alias("parts"))))
