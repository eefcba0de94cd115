"""Many fixed texts at once: rules and secrets as tables, found in one pass over each text.

A table of needles becomes an Aho-Corasick automaton, built once in each Python worker from a
broadcast list, so the plan does not grow with the table and a text is read once however many needles
there are. A table may have up to MOST needles; that is checked before it is broadcast.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = 1_000_000
MARK = "[REDACTED]"

_built: dict[str, ahocorasick.Automaton] = {}


def _shared(needles: DataFrame) -> Broadcast:
    """(token, needles as (text, ranks)) of a table (ord, needle): ranks count distinct ord from 0. Empty and null needles go."""
    rows = needles.select("ord", "needle").where("needle <> ''").limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} needles")
    held: dict[str, list[int]] = {}
    for r in sorted(rows):
        held.setdefault(r.needle, []).append(r.ord)
    return needles.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, list(held.items())))


def _automaton(shared: Broadcast) -> ahocorasick.Automaton | None:
    token, needles = shared.value
    if token not in _built:
        _built.clear()
        out = ahocorasick.Automaton()
        for text, ords in needles:
            out.add_word(text, (len(text), ords))
        if needles:
            out.make_automaton()
        _built[token] = out
    return _built[token] if needles else None


def found(frame: DataFrame, text: Column, needles: DataFrame, name: str = "found") -> DataFrame:
    """The frame with ``name``: the sorted ords of the needles (ord, needle) that the text holds; none for a null text."""
    shared = _shared(needles)

    def hits(texts: pa.Array) -> pa.Array:
        find = _automaton(shared)
        return pa.array([[] if t is None or find is None else sorted({o for _, (_, ords) in find.iter(t) for o in ords}) for t in texts.to_pylist()], pa.list_(pa.int64()))

    return frame.withColumn(name, F.arrow_udf(hits, "array<bigint>")(text))


def _kept(find: ahocorasick.Automaton, text: str) -> Iterator[tuple[int, int]]:
    """Places to replace, in order: needles of smaller ord first, each from left to right, in what no one before has taken."""
    taken: list[tuple[int, int]] = []
    ends: set[int] = set()
    for _, start, stop in sorted((ords[0], end - size + 1, end + 1) for end, (size, ords) in find.iter(text)):
        if ends.isdisjoint(range(start, stop)):
            ends.update(range(start, stop))
            taken.append((start, stop))
    return iter(sorted(taken))


def redacted(frame: DataFrame, column: str, secrets: DataFrame, mark: str = MARK) -> DataFrame:
    """The frame with every secret of the table (ord, needle) replaced in ``column``.

    Of secrets that overlap the one of smaller ord is replaced, of one secret's places the first; marks are
    not looked into again. Null texts stay null; empty secrets are none.
    """
    shared = _shared(secrets)

    def replaced(texts: pa.Array) -> pa.Array:
        find, out = _automaton(shared), []
        for t in texts.to_pylist():
            if t is None or find is None:
                out.append(t)
                continue
            parts, at = [], 0
            for start, stop in _kept(find, t):
                parts += [t[at:start], mark]
                at = stop
            out.append("".join([*parts, t[at:]]))
        return pa.array(out, pa.string())

    return frame.withColumn(column, F.arrow_udf(replaced, "string")(F.col(column)))


def categorised(rows: DataFrame, rules: DataFrame, texts: dict[str, Column], default: str) -> DataFrame:
    """The frame with ``category``: that of the rule (ord, place, needle, category) of smallest ord whose needle stands in its place, else ``default``.

    ``texts`` has the text of each place. Rules of one ord must be of one category.
    """
    first = []
    for k, (place, text) in enumerate(texts.items()):
        rows = found(rows, text, rules.where(F.col("place") == place), f"_found{k}")
        first.append(F.array_min(f"_found{k}"))
    names = rules.select(F.col("ord").alias("_first"), F.col("category").alias("_category")).distinct()
    rows = rows.withColumn("_first", F.least(*first) if len(first) > 1 else first[0]).drop(*(f"_found{k}" for k in range(len(first))))
    out = rows.join(F.broadcast(names), "_first", "left")  # MOST rows a place at most
    return out.withColumn("category", F.coalesce("_category", F.lit(default))).drop("_first", "_category")
