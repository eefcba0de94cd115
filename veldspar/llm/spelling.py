"""Spelling variants: words one edit apart, by a symmetric-delete join.

Every word emits itself and its distinct single deletions under 64-bit keys. Two words that
differ by one inserted, deleted or replaced character share exactly one of these texts: a
replacement the text without that place, an insertion the shorter word itself. So the equi-join
of equal keys meets each such pair once, and what it meets besides is dropped on the exact texts.

Keys are computed from running sums, so a word of any length emits one small row a deletion, never
the deleted texts. A key has at most one word for each letter and place, however large the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldspar.llm.scratch import Scratch
from veldspar.llm.textkit import mix64, slices

LETTERS = "A-Za-zÀ-ÿ"
LEAST_LETTERS, LEAST_COUNT, RATIO = 6, 5, 5
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Letters of words whose keys are made at a time; a longer word is a slice of its own.
SLICE_LETTERS = 1 << 18

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SIZE = np.uint64(0xD1B54A32D192ED03)


def ascii_lower(word: Column) -> Column:
    """A to Z in lower case; other letters stay. Texts of one byte a letter go the short way."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, UPPER, UPPER.lower()))


def without(word: Column, place: Column) -> Column:
    """The word without the character at ``place``, from 0."""
    return F.concat(F.substring(word, F.lit(1), place), F.substring(word, place + 2, F.length(word)))


def shuffled(rows: DataFrame) -> DataFrame:
    """The rows, never to be broadcast: Spark sizes what Python makes of a table by the table's file, so it may take millions of keys for a few."""
    return rows.hint("merge")


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: str = LETTERS, least: int = LEAST_LETTERS) -> DataFrame:
    """Rows doc_id, word: every maximal run of at least ``least`` letters of whole texts, A to Z in lower case. Null texts have none."""
    found = F.regexp_extract_all(F.col(text_col), F.lit(f"[{letters}]{{{least},}}"), F.lit(0))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.explode(found).alias("word"))
    return rows.select("doc_id", ascii_lower(F.col("word")).alias("word"))


def counted(rows: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """Distinct words (word, n) that occur at least ``least`` times. Counts are added up before the shuffle, so a frequent word is no hot key."""
    return rows.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def _deletion_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, words = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
        size = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        bounds = np.concatenate([[0], np.cumsum(size)])
        for lo, hi in slices(bounds, SLICE_LETTERS):
            letters = np.frombuffer("".join(words.slice(lo, hi - lo).to_pylist()).encode("utf-32-le"), np.uint32)
            yield _keys(ids[lo:hi], size[lo:hi], letters)


def _keys(ids: np.ndarray, size: np.ndarray, letters: np.ndarray) -> pa.RecordBatch:
    """Rows key, id, first, last: each word itself (first and last -1), and each distinct deletion with the places that give it."""
    total, end = len(letters), np.cumsum(size)
    start = end - size
    power = np.full(total + 1, _BASE, np.uint64)
    inverse = np.full(total + 1, _INVERSE, np.uint64)
    power[0] = inverse[0] = 1
    power, inverse = np.multiply.accumulate(power), np.multiply.accumulate(inverse)
    added = np.zeros(total + 1, np.uint64)
    np.cumsum(mix64(letters.astype(np.uint64) + np.uint64(1)) * power[:total], out=added[1:])
    of = np.repeat(np.arange(len(ids)), size)
    fresh = np.ones(total, bool)
    fresh[1:] = (letters[1:] != letters[:-1]) | (of[1:] != of[:-1])
    place = np.flatnonzero(fresh)
    last = np.append(place[1:], total) - 1
    of = of[place]
    left = added[place] - added[start[of]] + (added[end[of]] - added[place + 1]) * _INVERSE
    own = mix64((added[end] - added[start]) * inverse[start] + size.astype(np.uint64) * _SIZE)
    cut = mix64(left * inverse[start[of]] + (size[of] - 1).astype(np.uint64) * _SIZE)
    none = np.full(len(ids), -1)
    columns = [np.concatenate([own, cut]).view(np.int64), np.concatenate([ids, ids[of]]), np.concatenate([none, place - start[of]]).astype(np.int32), np.concatenate([none, last - start[of]]).astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "id", "first", "last"])


def near_pairs(words: DataFrame) -> DataFrame:
    """Pairs (id, word, n, other_id, other, other_n) of ``words`` (id, word, n; both distinct) that are exactly one edit apart, each once."""
    keys = words.select("id", "word").mapInArrow(_deletion_keys, "key bigint, id bigint, first int, last int")
    a, b = (keys.select("key", *(F.col(c).alias(f"{side}_{c}") for c in ("id", "first", "last"))) for side in "ab")
    whole = (F.col("a_first") < 0) | (F.col("b_first") < 0)
    meet = whole | ((F.col("a_first") <= F.col("b_last")) & (F.col("b_first") <= F.col("a_last")))
    pairs = a.join(shuffled(b), "key").where((F.col("a_id") < F.col("b_id")) & meet)
    pairs = pairs.select(F.col("a_id").alias("id"), F.col("b_id").alias("other_id"), "a_first", "b_first", F.greatest("a_first", "b_first").alias("place"))
    pairs = pairs.join(shuffled(words.select("id", "word", "n")), "id")
    pairs = pairs.join(shuffled(words.select(F.col("id").alias("other_id"), F.col("word").alias("other"), F.col("n").alias("other_n"))), "other_id")
    rest = lambda word, first: F.when(F.col(first) < 0, F.col(word)).otherwise(without(F.col(word), F.col("place")))
    exact = (F.col("word") != F.col("other")) & (rest("word", "a_first") == rest("other", "b_first"))
    return pairs.where(exact).select("id", "word", "n", "other_id", "other", "other_n")


def variants(counts: DataFrame, ratio: int = RATIO) -> DataFrame:
    """One row per word of ``counts`` (word, n): word, form, root, n, n_near, form_n.

    A word's form is its near word of largest n, of equals the smallest in code-point order, if
    that n is at least ``ratio`` times its own; else null, as is form_n. Its root is where forms
    lead in the end, the word itself if it has none. n_near counts its near words, each exactly
    one inserted, deleted or replaced character away.

    No join is a broadcast, so the driver holds nothing that grows with the words.

    Words must be distinct, as ``counted`` gives them; a null word or n takes no part, the empty
    word is near every word of one letter, and a word may have any length. Other columns are
    ignored, whatever their names. No words give no rows. Roots are found by doubling: a form
    has ``ratio`` times its variant's n, so chains are short and the rounds few.
    """
    scratch = Scratch(counts.sparkSession, "spelling")
    rows = counts.select("word", "n").where("word is not null and n is not null")
    words = scratch.save(rows.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")
    pairs = near_pairs(words)
    sides = F.array(
        F.struct("id", F.col("other_id"), F.col("other"), F.col("other_n")),
        F.struct(F.col("other_id").alias("id"), F.col("id").alias("other_id"), F.col("word").alias("other"), F.col("n").alias("other_n")),
    )
    near = pairs.select(F.explode(sides).alias("x")).select("x.*")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"), F.col("other_id").alias("form_id"))).alias("best")
    near = near.groupBy("id").agg(F.count(F.lit(1)).alias("n_near"), best)
    chosen = -F.col("best.less") >= ratio * F.col("n")
    formed = words.join(shuffled(near), "id", "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(chosen, F.col("best.form")).alias("form"), F.when(chosen, F.col("best.form_id")).alias("form_id"), F.when(chosen, -F.col("best.less")).alias("form_n"),
    )
    formed = scratch.save(formed, "formed")
    roots = _roots(formed.where("form_id is not null").select("id", F.col("form_id").alias("root_id")), scratch)
    named = roots.join(shuffled(words.select(F.col("id").alias("root_id"), F.col("word").alias("root"))), "root_id").select("id", "root")
    return formed.join(shuffled(named), "id", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(links: DataFrame, scratch: Scratch) -> DataFrame:
    """Follow links (id, root_id) to their ends: each round doubles the steps taken."""
    rounds, going = 0, not links.isEmpty()
    while going:
        further = links.select(F.col("id").alias("root_id"), F.col("root_id").alias("next_id"))
        moved = links.join(shuffled(further), "root_id", "left").select("id", F.coalesce("next_id", "root_id").alias("root_id"), F.col("next_id").isNotNull().alias("moved"))
        moved = scratch.save(moved, f"roots{rounds}")
        scratch.drop(f"roots{rounds - 1}")
        going = not moved.where("moved").isEmpty()
        links, rounds = moved.select("id", "root_id"), rounds + 1
    return links
