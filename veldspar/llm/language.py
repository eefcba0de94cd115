"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A trigram's vector binds its three letters'
vectors, each permuted (rolled) by its position, by multiplication. A document bundles
(sums) its trigrams' vectors; a language's prototype bundles its training documents, each
scaled to length SCALE. A document gets the language whose prototype has the greatest
cosine with it.

Prototypes are sums of integers over all training rows, so their values do not depend on
how rows are dealt. What reaches the driver is one vector of DIMENSIONS for each language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veldspar.llm.textkit import mix64, slices, text_bytes

DIMENSIONS = 512
SCALE = 10_000
SLICE_BYTES = 1 << 19  #: Of texts that are bundled at a time, or one longer text.
GRAMS = 1 << 14  #: Trigrams whose vectors are in memory at a time.
UNDETERMINED = "und"
_PAD = 0x20


def _letters(points: np.ndarray) -> np.ndarray:
    """Whether each code point is a letter."""
    out = np.zeros(len(points), bool)
    seen = np.zeros(0x110000, bool)
    seen[points] = True
    for p in np.flatnonzero(seen):
        if not chr(p).isalpha():
            seen[p] = False
    return np.logical_and(seen[points], True, out=out)


def letter_vectors(points: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Random +1/-1 vectors, one row a code point; the space between words has one as well."""
    seeds = mix64(points.astype(np.uint64) + np.uint64(0xA5A5))
    bits = mix64((seeds[:, None] + np.arange(dimensions // 64, dtype=np.uint64)[None] * np.uint64(0x9E3779B97F4A7C15)).ravel())
    return np.unpackbits(bits.view(np.uint8).reshape(len(points), -1), axis=1)[:, :dimensions].astype(np.int8) * 2 - 1


def document_vectors(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int, dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """Bundled trigram vectors of whole documents, and their numbers of letters."""
    raw = [data[offsets[d] : offsets[d + 1]].tobytes().decode("utf-8", "replace").lower() for d in range(lo, hi)]
    joined = np.frombuffer("".join(f" {t} " for t in raw).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(raw)), np.fromiter(map(len, raw), np.int64, len(raw)) + 2)
    letter = _letters(joined)
    count = np.bincount(owner[letter], minlength=hi - lo)
    points = np.where(letter, joined, _PAD)
    keep = np.ones(len(points), bool)
    keep[1:] = letter[1:] | letter[:-1] | (owner[1:] != owner[:-1])  # one space between words, and one at either end of a document
    points, owner = points[keep], owner[keep]
    out = np.zeros((hi - lo, dimensions), np.float32)
    if not letter.any():  # else some document has a letter between its two spaces
        return out, count
    alphabet, at = _dense(points)
    same = owner[:-2] == owner[2:]
    base = len(alphabet)  # 1.2 million at most, so codes are below 2**61
    own, code = owner[:-2][same], ((at[:-2] * base + at[1:-1]) * base + at[2:])[same]
    wide, names = base**3, None
    if wide * (hi - lo) >= 1 << 62:
        names, code = np.unique(code, return_inverse=True)
        wide = len(names)
    key = np.sort(own * wide + code)
    edge = np.flatnonzero(np.diff(key, prepend=-1))
    times = np.diff(np.append(edge, len(key))).astype(np.float32)
    doc, code = np.divmod(key[edge], wide)
    grams, which = np.unique(code, return_inverse=True)
    grams = grams if names is None else names[grams]
    letters = letter_vectors(alphabet, dimensions)
    first, second = np.roll(letters, 2, 1), np.roll(letters, 1, 1)
    for g in range(0, len(grams), GRAMS):
        some = grams[g : g + GRAMS]
        vectors = first[some // base**2] * second[some // base % base] * letters[some % base]
        inside = np.flatnonzero((which >= g) & (which < g + GRAMS))
        bounds = np.searchsorted(doc[inside], np.arange(hi - lo + 1))
        for d in np.flatnonzero(np.diff(bounds)):
            at = inside[bounds[d] : bounds[d + 1]]
            out[d] += times[at] @ vectors[which[at] - g].astype(np.float32)  # whole numbers, so the order is of no matter
    return out, count


def _dense(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    seen = np.zeros(0x110000, bool)
    seen[points] = True
    alphabet = np.flatnonzero(seen)
    place = np.zeros(0x110000, np.int64)
    place[alphabet] = np.arange(len(alphabet))
    return alphabet, place[points]


def _unit(vectors: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    return vectors / np.where(norm > 0, norm, 1)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Prototypes of the languages of all rows with a language and a letter."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            data, offsets = text_bytes(batch.column(0))
            for lo, hi in slices(offsets, SLICE_BYTES):
                vectors, count = document_vectors(data, offsets, lo, hi, dimensions)
                scaled = np.rint(_unit(vectors) * SCALE).astype(np.int64)
                for lang in set(langs[lo:hi]):
                    rows = (langs[lo:hi] == lang) & (count > 0)
                    total[lang] = total.get(lang, 0) + scaled[rows].sum(0)
        for lang, vector in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dimensions), pa.array(np.arange(dimensions, dtype=np.int32)), pa.array(vector, pa.int64())], ["lang", "at", "value"])

    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null")
    parts = rows.mapInArrow(sums, "lang string, at int, value bigint").groupBy("lang", "at").agg(F.sum("value").alias("value"))
    found: dict[str, np.ndarray] = {}
    for r in parts.collect():  # languages x dimensions rows
        found.setdefault(r["lang"], np.zeros(dimensions))[r["at"]] = r["value"]
    return {k: v for k, v in sorted(found.items()) if v.any()}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", carry: Column | None = None) -> DataFrame:
    """One row per input row: doc_id, lang_pred, score.

    The score is the cosine with the best prototype, 0 at least. A text that is null or
    has no letter is ``und`` with score 0, and so is every text if there are no prototypes;
    of equal cosines the first language in sort order wins. A text's vector is its own: it does
    not depend on other rows. Texts are read whole, however long. Repeated rows give repeated
    rows; extra columns are ignored; a value ``carry`` is passed on as ``carried``, and
    with it text; an empty table gives an empty table.
    """
    langs, passing = list(prototypes), carry is not None
    dimensions = len(next(iter(prototypes.values()))) if langs else DIMENSIONS
    matrix = _unit(np.array(list(prototypes.values()))).T if langs else np.zeros((dimensions, 0))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for lo, hi in slices(offsets, SLICE_BYTES):
                vectors, count = document_vectors(data, offsets, lo, hi, dimensions)
                cosine = _unit(vectors) @ matrix
                known = (count > 0) & bool(langs)
                best = cosine.argmax(1) if langs else np.zeros(hi - lo, int)
                names = [langs[b] if k else UNDETERMINED for b, k in zip(best, known, strict=True)]
                scores = np.where(known, np.clip(cosine.max(1, initial=0), 0, 1), 0.0)
                part = batch.slice(lo, hi - lo)
                rest = dict(zip(part.schema.names, part.columns, strict=True))
                if not passing:
                    rest.pop("text")
                yield pa.RecordBatch.from_pydict(rest | {"lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64())})

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *([] if carry is None else [carry.alias("carried")]))
    schema = T.StructType([*(f for f in rows.schema if f.name != "text" or carry is not None), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(predict, schema)


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves ``part``; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))
