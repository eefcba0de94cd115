"""Mixing sources to target weights by pivotal dependent rounding.

Each source has a target number of words, so each of its documents should be taken
target / size times on average. The whole part is certain; the fraction is rounded by
the pivotal method: of two documents with fractional shares, one random transfer of words
moves mass from one to the other until one share is 0 or 1, and the other goes on. A
transfer keeps the sum of words, so a source misses its target by at most the one share
that is left at the end.

The documents of a source are dealt by a hash of their id into groups of about GROUP_ROWS;
each group leaves one residual, and FAN_IN residuals at a time meet in the next level of
a reduction tree. Order and random numbers are hashes of ids, so reruns agree. An id that
more than GROUP_ROWS rows of a source repeat (or lack) is dealt further by their places in
the stored table, so no group is larger for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veldspar.llm.scratch import Scratch

GROUP_ROWS = 2000
FAN_IN = 64
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_COPIES = 2
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """One row per source: source, source_size, n_docs, target.

    Sources by code point, null last, take ``weights`` in turn and share ``share`` times
    all words; no target is above ``most`` times its source's size, and what is above goes
    to the others by weight. The fixed point of that is target = min(most * size, level *
    weight): sources are filled in the order of most * size / weight. The windows hold one
    row per source, not the documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("weight", F.element_at(cycle, (rank % len(weights)) + 1)).withColumn("most", F.col("source_size") * float(most))
    filled = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, onward = filled.rowsBetween(Window.unboundedPreceding, -1), filled.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) * float(share) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    per = per.withColumn("level", level).withColumn("level", F.max("level").over(everything))  # it rises until the first source with room
    return per.withColumn("target", F.least("most", F.greatest(F.lit(0.0), F.col("level") * F.col("weight")))).select("source", "source_size", "n_docs", "target")


def _uniform(*parts: np.ndarray) -> np.ndarray:
    from veldspar.llm.textkit import mix64

    x = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        x = mix64(x + p.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return (x >> np.uint64(11)).astype(float) / float(1 << 53)


def _pivot(table: pa.Table, last: bool) -> pa.Table:
    """Round the shares of a group; one row stays fractional unless this is the last level."""
    table = table.take(pa.array(np.lexsort([table["part"].to_numpy(), table["size"].to_numpy(), table["key"].to_numpy()])))
    size, part, extra = table["size"].to_numpy().astype(float), table["part"].to_numpy().copy(), table["extra"].to_numpy().copy()
    key = table["key"].to_numpy()
    u, live = _uniform(key, np.arange(len(key))), -1
    for j in np.flatnonzero((part > 0) & (part < 1)):
        if live < 0:
            live = j
            continue
        i = live
        up = min(size[i] - size[i] * part[i], size[j] * part[j])  # words that i can gain
        down = min(size[i] * part[i], size[j] - size[j] * part[j])
        move = up if u[j] * (up + down) < down else -down
        a, b = part[i] + move / size[i], part[j] - move / size[j]
        a, b = (0.0 if x < 1e-9 else 1.0 if x > 1 - 1e-9 else x for x in (a, b))
        part[i], part[j] = a, b
        live = i if 0 < a < 1 else j if 0 < b < 1 else -1
    if last and live >= 0:
        part[live] = float(u[live] < part[live])
    whole = (part == 0) | (part == 1)
    extra = np.where(whole, part.astype(np.int64), extra)
    out = table.set_column(table.schema.get_field_index("part"), "part", pa.array(part))
    return out.set_column(out.schema.get_field_index("extra"), "extra", pa.array(extra)).append_column("open", pa.array(~whole))


def _level(rows: DataFrame, last: bool) -> DataFrame:
    def rounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        yield from _pivot(table, last).combine_chunks().to_batches()

    columns = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    return rows.groupBy("source", "bucket").applyInArrow(rounded, f"{columns}, open boolean")


def mix_sizes(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """Decide copies for rows (doc_id, source, size): adds source_size, target, copies.

    One row per input row. Rows of size 0 are never taken. Rows that repeat an id are
    separate documents; a null id, source or size (counted as 0) is a value like others.
    Reruns over a stored table agree; where no id is repeated more than GROUP_ROWS times, so
    do those over its rows in any order. Extra columns are ignored, but ``row`` is passed on;
    an empty table gives an empty table.
    """
    spark = sizes.sparkSession
    row = ["row"] if "row" in sizes.columns else []
    scratch = Scratch(spark, "mixing")
    sizes = sizes.select("doc_id", "source", F.coalesce("size", F.lit(0)).cast("long").alias("size"), *row)
    sizes = scratch.save(sizes.withColumns({"key": F.xxhash64("doc_id", F.lit("mixing")), "place": F.monotonically_increasing_id()}), "sizes")
    targets = scratch.save(source_targets(sizes, weights, share, most), "targets")
    deepest = targets.agg(F.max("n_docs")).first()[0] or 0
    rows = sizes.withColumnRenamed("source", "own").join(targets, F.col("own").eqNullSafe(F.col("source"))).drop("own")
    copies = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    often = sizes.groupBy(F.col("source").alias("its"), F.col("key").alias("hot")).agg(F.count(F.lit(1)).alias("times")).where(F.col("times") > GROUP_ROWS)
    rows = rows.join(often, F.col("source").eqNullSafe(F.col("its")) & (F.col("key") == F.col("hot")), "left")
    dealt = F.when(F.col("times").isNull(), F.col("key")).otherwise(F.xxhash64("key", "place"))
    rows = rows.withColumn("copies", copies).withColumns({
        "whole": F.floor("copies"), "part": F.col("copies") - F.floor("copies"), "extra": F.lit(0).cast("long"),
        "bucket": F.pmod(dealt, F.ceil(F.col("n_docs") / GROUP_ROWS)), "buckets": F.ceil(F.col("n_docs") / GROUP_ROWS),
    }).drop("copies", "its", "hot", "times", "place")
    groups, level, done = -(-deepest // GROUP_ROWS), 0, None
    while True:
        now = scratch.save(_level(rows, groups <= 1), f"level{level}")
        settled = now.where("not open").drop("open")
        done = settled if done is None else done.unionByName(settled)
        if groups <= 1:
            break
        rows = now.where("open").drop("open").withColumn("bucket", F.floor(F.col("bucket") / FAN_IN))
        groups, level = -(-groups // FAN_IN), level + 1
    return done.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.col("extra")).alias("copies"), *row)


def document_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """doc_id, source and size in words of whole texts, and ``row_col`` as row; a null text has none."""
    row = [F.col(row_col).alias("row")] if row_col else []
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *row)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES, row_col: str | None = None) -> DataFrame:
    """Copies of every document: doc_id, source, size, source_size, target, copies, and ``row_col`` as row. See ``mix_sizes``."""
    return mix_sizes(document_sizes(docs, id_col, text_col, source_col, row_col), weights, share, most)
