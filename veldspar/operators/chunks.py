"""Structure-aware chunks of long documents.

The cursor of greedy chunking is sequential, so each document is one row of an Arrow batch
and documents are spread over tasks. Boundaries are looked up by bisection.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veldspar.functions.registers import RANGE_HEADINGS

MAX_CHARS, CONTEXT_CHARS, LEAST_BISECTED = 12_000, 1_500, 8_000

#: Boundaries by preference: after a blank line, before a sheet, before a range of circuits, after any line.
BLANK, SHEET, RANGE, LINE = range(4)

_RANGES = [regex.compile(p.replace("(?iU)", "(?i)")) for p in RANGE_HEADINGS]


class ContextTooLarge(ValueError):
    """A chunk is too short to be cut in two."""


@dataclass
class Structure:
    """Offsets of a text's boundaries by preference, and its headings in order."""

    boundaries: list[list[int]] = field(default_factory=lambda: [[], [], [], []])
    headings: list[tuple[int, int, str]] = field(default_factory=list)

    def preferred(self, start: int, limit: int) -> int | None:
        """The last boundary in (start, limit] of the best kind that has one."""
        for offsets in self.boundaries:
            k = bisect.bisect_right(offsets, limit)
            if k and offsets[k - 1] > start:
                return offsets[k - 1]
        return None

    def balanced(self, lower: int, upper: int, middle: int) -> int | None:
        """The boundary nearest the middle, the earlier of two, of the best kind that has one in [lower, upper]."""
        for offsets in self.boundaries:
            k = bisect.bisect_left(offsets, middle)
            near = [o for o in offsets[max(k - 1, 0) : k + 1] if lower <= o <= upper]
            if near:
                return min(near, key=lambda o: (abs(o - middle), o))
        return None

    def prefix(self, cursor: int, most: int | None) -> str:
        """The sheet and range headings that hold at a cursor, unless they fill a chunk."""
        k = bisect.bisect_left(self.headings, (cursor,))
        at = self.headings[k][1] if k < len(self.headings) and self.headings[k][0] == cursor else None
        if at == SHEET:
            return ""
        sheet = ranged = None
        for _, kind, text in reversed(self.headings[:k]):
            if kind == SHEET:
                sheet = text
                break
            ranged = ranged or text
        lines = [t for t in (sheet, None if at == RANGE else ranged) if t]
        out = "".join(f"{t}\n" for t in lines)
        return out if most is None or len(out) < most else ""


def structure(text: str) -> Structure:
    """Scan a text's lines once."""
    out, offset = Structure(), 0
    for line in text.split("\n"):
        ended = offset + len(line) < len(text)
        bare = line.removesuffix("\r").strip()
        kind = SHEET if bare == "=== CSV ===" or bare.startswith("=== Sheet:") else RANGE if any(p.match(bare) for p in _RANGES) else None
        if kind is not None:
            if offset:
                out.boundaries[kind].append(offset)
            out.headings.append((offset, kind, bare))
        offset += len(line) + ended
        if ended:
            out.boundaries[LINE if bare else BLANK].append(offset)
    return out


def split(text: str, max_chars: int = MAX_CHARS) -> list[str]:
    """Greedy chunks of at most ``max_chars`` characters, each begun by the headings that hold there."""
    if not text or max_chars <= 0:
        return []
    scanned, out, cursor = structure(text), [], 0
    while cursor < len(text):
        prefix = scanned.prefix(cursor, max_chars)
        limit = min(cursor + max_chars - len(prefix), len(text))
        end = limit if limit == len(text) else scanned.preferred(cursor, limit) or limit
        out.append(prefix + text[cursor:end])
        cursor = end
    return out


def bisect_text(text: str) -> tuple[str, str]:
    """Two halves of a chunk at the best boundary of its middle half; the second begins with its headings."""
    n = len(text)
    if n <= LEAST_BISECTED:
        raise ContextTooLarge(f"{n} characters")
    scanned = structure(text)
    lower = n // 4
    at = scanned.balanced(max(lower, 1), min(n - lower, n - 1), n // 2)
    at = n // 2 if at is None else at
    left, right = text[:at], scanned.prefix(at, None) + text[at:]
    if not left or len(right) >= n:
        raise ContextTooLarge(f"{n} characters")
    return left, right


def chunk(docs: DataFrame, max_chars: int = MAX_CHARS, context_chars: int = CONTEXT_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Chunks of documents: doc_id, index, text, prior_context (the end of the chunk before; null for the first, or for no context)."""

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                parts = split(batch.column(1)[k].as_py() or "", max_chars)
                if parts:
                    prior = [None, *(p[-context_chars:] if context_chars > 0 else None for p in parts[:-1])]
                    names = pa.repeat(batch.column(0)[k], len(parts))
                    yield pa.RecordBatch.from_arrays([names, pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.string()), pa.array(prior, pa.string())], ["doc_id", "index", "text", "prior_context"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(chunked, f"doc_id {kind}, index int, text string, prior_context string")


def bisected(chunks: DataFrame, context_chars: int = CONTEXT_CHARS) -> DataFrame:
    """Each chunk as two halves, or as it is with ``too_small``; later chunks are numbered on."""

    def halved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                try:
                    left, right = bisect_text(r["text"])
                except ContextTooLarge:
                    rows.append((r["doc_id"], r["index"], 0, r["text"], r["prior_context"], True))
                    continue
                rows.append((r["doc_id"], r["index"], 0, left, r["prior_context"], False))
                rows.append((r["doc_id"], r["index"], 1, right, left[-context_chars:] if context_chars > 0 else None, False))
            types = (batch.column(0).type, pa.int32(), pa.int32(), pa.string(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, types, strict=True)], ["doc_id", "index", "half", "text", "prior_context", "too_small"])

    kind = chunks.schema["doc_id"].dataType.simpleString()
    halves = chunks.select("doc_id", "index", "text", "prior_context").mapInArrow(halved, f"doc_id {kind}, index int, half int, text string, prior_context string, too_small boolean")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("index", "half")) - 1
    return halves.select("doc_id", place.alias("index"), "text", "prior_context", "too_small")


def prior_context(chunks: DataFrame, context_chars: int = CONTEXT_CHARS) -> DataFrame:
    """The end of the chunk before, from chunks already cut."""
    before = F.lag("text").over(Window.partitionBy("doc_id").orderBy("index"))
    return chunks.withColumn("prior_context", F.when(F.lit(context_chars > 0), F.right(before, F.lit(context_chars))))
