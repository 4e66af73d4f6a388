"""Edit-aware token counts.

A document's pre-tokens are kept in leaves of a segment tree that sums their characters and tokens. Byte-pair merges don't
cross pre-tokens, and where a pre-token ends is decided by at most two characters after it, so an edit is re-encoded
from a boundary two characters before it until a boundary meets an old leaf's again; the sums on the paths from those
leaves to the root are updated and nothing else is read. trees() writes the leaves as a table, which edit_trees() takes on
with a table of edits: round after round, only what edits touch is encoded again.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare
from .common import by_ids, documents, materialize
from .common import pieces as slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-token pattern of the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens in a leaf, and pre-tokens whose counts a worker remembers.
LEAF, MEMO = 32, 200_000
#: Bytes that a vocabulary's file may have, which is sent to all workers.
VOCABULARY_BYTES = 64 << 20

_PRE = regex.compile(PATTERN)

Edit = tuple[int, int, str]


class Counter(dict):
    """Token counts by pre-token, remembered up to MEMO."""

    def __init__(self, vocabulary: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.encoding = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, piece: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[piece] = n = len(self.encoding.encode_ordinary(piece))
        return n


def read_vocabulary(path: str) -> bytes:
    """The vocabulary's file as the driver sees it."""
    with open(path, "rb") as f:
        data = f.read(VOCABULARY_BYTES + 1)
    if len(data) > VOCABULARY_BYTES:
        raise ValueError(f"{path} has more than {VOCABULARY_BYTES} bytes")
    return data


class TokenTree:
    """A text in leaves of whole pre-tokens, with a complete binary tree of (characters, tokens) sums above them."""

    def __init__(self, text: str, count: Callable[[str], int], leaf: int = LEAF):
        pieces = _PRE.findall(text)
        self.pieces = len(pieces)
        groups = [pieces[k : k + leaf] for k in range(0, len(pieces), leaf)] or [[]]
        self._grow(["".join(g) for g in groups], [sum(map(count, g)) for g in groups], count)

    @classmethod
    def of_leaves(cls, texts: list[str], tokens: list[int], count: Callable[[str], int]) -> TokenTree:
        """The tree of kept leaves; nothing is encoded."""
        tree = cls.__new__(cls)
        tree.pieces = 0
        tree._grow(texts or [""], tokens or [0], count)
        return tree

    def _grow(self, texts: list[str], tokens: list[int], count: Callable[[str], int]) -> None:
        self.count, self.encoded, self.texts = count, 0, list(texts)
        self.size = 1 << (len(texts) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        self.chars[self.size : self.size + len(texts)] = map(len, texts)
        self.tokens[self.size : self.size + len(texts)] = tokens
        for k in range(self.size - 1, 0, -1):
            self._sum(k)

    def leaves(self, most: int = 4 * LEAF) -> list[tuple[str, int]]:
        """(text, tokens) of the leaves that hold text; one that has grown beyond so many pre-tokens is split into leaves."""
        out = []
        for text, n in zip(self.texts, self.tokens[self.size :], strict=False):
            pieces = _PRE.findall(text) if len(text) > most else []
            if len(pieces) > most:
                groups = [pieces[k : k + LEAF] for k in range(0, len(pieces), LEAF)]
                out += [("".join(g), sum(map(self.count, g))) for g in groups]
            elif text:
                out.append((text, n))
        return out or [("", 0)]

    def _sum(self, k: int) -> None:
        self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
        self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def text(self) -> str:
        return "".join(self.texts)

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds the character at this offset (the last with text for the end) and the leaf's first offset."""
        at, k, start = min(at, self.chars[1] - 1), 1, 0
        while k < self.size:
            k *= 2
            if at - start >= self.chars[k]:
                start += self.chars[k]
                k += 1
        return k - self.size, start

    def _set(self, leaf: int, text: str, tokens: int) -> None:
        self.texts[leaf] = text
        k = self.size + leaf
        self.chars[k], self.tokens[k] = len(text), tokens
        while k > 1:
            k //= 2
            self._sum(k)

    def edit(self, start: int, end: int, new: str) -> None:
        """Puts new in place of the characters from start to end."""
        if not self.chars[1]:
            self._encode(0, new, len(self.texts))
            return
        # A pre-token is decided by at most two characters after it, so one that ends two before the edit stands.
        first, at = self.find(max(0, start - 2))
        last, _ = self.find(max(start, end - 1))
        text = "".join(self.texts[first : last + 1])
        self._encode(first, text[: start - at] + new + text[end - at :], last + 1)

    def _encode(self, first: int, text: str, after: int) -> None:
        """Encodes text into leaf first, taking in leaves from after on until a boundary of its pre-tokens is a leaf's end."""
        while True:
            context, k = "", after
            while k < len(self.texts) and len(context) < 2:
                context += self.texts[k]
                k += 1
            pieces, at = [], 0
            for m in _PRE.finditer(text + context):
                if m.end() > len(text):
                    break
                pieces.append(m[0])
                at = m.end()
            if at == len(text):
                break
            text, after = text + context, k
        self.encoded += len(pieces)
        self._set(first, text, sum(map(self.count, pieces)))
        for k in range(first + 1, after):
            if self.texts[k]:
                self._set(k, "", 0)


def edit_counts(docs: DataFrame, edits: Callable[[str], list[Edit]], vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, n_edits, n_tokens_after, n_pretokens, n_reencoded) for every row of docs (doc_id, text).

    edits gives a text's edits (start, end, new) in code points of the text as it was, in any order; one that overlaps an
    earlier one or reaches past the text is left out and not counted. A null text is empty. Repeated rows each get a row.
    Extra columns are ignored. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    names = ["doc_id", "n_tokens", "n_edits", "n_tokens_after", "n_pretokens", "n_reencoded"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter(shared.value)
        for b in slices(batches):
            out = [count_edited(t or "", edits(t or ""), counts.__getitem__) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([x[c] for x in out], pa.int64()) for c in range(5))], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, ", ".join(f"{c} long" for c in names))


def count_edited(text: str, edits: list[Edit], count: Callable[[str], int]) -> tuple[int, int, int, int, int]:
    """Tokens before, edits made, tokens after, pre-tokens before and pre-tokens encoded again."""
    tree = TokenTree(text, count)
    before = tree.total
    return before, apply_edits(tree, edits), tree.total, tree.pieces, tree.encoded


def apply_edits(tree: TokenTree, edits: list[Edit]) -> int:
    """Makes the edits that neither overlap an earlier one nor reach past the text, and returns their number."""
    chosen, reach, length = [], 0, tree.chars[1]
    for e in sorted(edits):
        if reach <= e[0] <= e[1] <= length:
            chosen.append(e)
            reach = e[1]
    for e in reversed(chosen):
        tree.edit(*e)
    return len(chosen)


LEAVES = "doc_id long, version long, leaf int, text string, tokens long"


def trees(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """The leaves of the trees of all rows of docs (doc_id, text), see LEAVES.

    version is a hash of the text as it was at first, so that rows of one id with different texts are documents of their own;
    equal rows are one document. A null or empty text has one empty leaf, a null id stays null. Extra columns are ignored.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter(shared.value)
        for b in slices(batches):
            for doc, version, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "version", "text")), strict=True):
                yield _leaf_rows(doc, version, TokenTree(text or "", counts.__getitem__))

    made = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("version"), "text").mapInArrow(rows, LEAVES)
    return made.dropDuplicates(["doc_id", "version", "leaf"])


def _leaf_rows(doc: int | None, version: int, tree: TokenTree) -> pa.RecordBatch:
    texts, tokens = zip(*tree.leaves(), strict=True)
    n = len(texts)
    columns = [pa.array([doc] * n, pa.int64()), pa.array([version] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(texts), pa.array(tokens, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "version", "leaf", "text", "tokens"])


def edit_trees(leaves: DataFrame, edits: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """The leaves after edits (doc_id, start, end, new), in code points of the texts as the leaves have them.

    leaves is a written table of trees() or of this function. Only documents with edits meet them, and only the leaves that
    an edit touches, with boundary context, are encoded again; all others keep their counts. Edits that overlap an earlier
    one, reach past the text, or hold a null id or place are left out; a null new text is empty. Equal edits are made once.
    """
    prepare(leaves.sparkSession)
    shared = leaves.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    edits = edits.filter("doc_id is not null and start is not null and `end` is not null")
    edits = edits.select(F.col("doc_id").cast("long"), F.col("start").cast("long"), F.col("end").cast("long"), F.coalesce("new", F.lit("")).alias("new")).distinct()
    edits = materialize(edits.join(leaves.select("doc_id", "version").distinct(), "doc_id"), "edits")
    ids = materialize(edits.select("doc_id").distinct(), "edited")
    if not ids.head(1):
        return leaves

    def edited(kept: pa.Table, made: pa.Table) -> pa.Table:
        order = kept.sort_by("leaf")
        counts = _counter(shared.value)
        tree = TokenTree.of_leaves(order["text"].to_pylist(), order["tokens"].to_pylist(), counts.__getitem__)
        apply_edits(tree, list(zip(*(made[c].to_pylist() for c in ("start", "end", "new")), strict=True)))
        return pa.Table.from_batches([_leaf_rows(kept["doc_id"][0].as_py(), kept["version"][0].as_py(), tree)])

    touched = by_ids(leaves, ids, "doc_id", "left_semi").select(*leaves.columns)
    new = touched.groupBy("doc_id", "version").cogroup(edits.groupBy("doc_id", "version")).applyInArrow(edited, LEAVES)
    return by_ids(leaves, ids, "doc_id", "left_anti").select(*leaves.columns).unionByName(new)


@lru_cache(maxsize=1)
def _counter(vocabulary: bytes) -> Counter:
    return Counter(vocabulary)


def totals(leaves: DataFrame) -> DataFrame:
    """(doc_id, version, chars, n_tokens) of every document from the sums of its leaves."""
    return leaves.groupBy("doc_id", "version").agg(F.sum(F.length("text")).alias("chars"), F.sum("tokens").alias("n_tokens"))


_MAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")
_NUMBER = re.compile(r"\+?[0-9][0-9 ().-]{7,}[0-9]")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")


def redactions(text: str) -> list[Edit]:
    """Edits that put a mark in place of e-mail addresses, long groups of digits and access keys."""
    out = [(m.start(), m.end(), "[NUMBER]") for m in _NUMBER.finditer(text)]
    if "@" in text:
        out += [(m.start(), m.end(), "[MAIL]") for m in _MAIL.finditer(text)]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "[KEY]") for m in _ACCESS.finditer(text)]
    return out


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents before and after redactions()."""
    return edit_counts(documents(spark, sf_dir), redactions)
