"""Hard-negative mining: scores of anchors and rows by block matrix multiplication, in two dimensions.

Rows are dealt into blocks of BLOCK_ROWS, anchors into blocks of ANCHOR_ROWS, and both are cut into
chunks of CHUNK dimensions. A block of anchors is copied to every block of rows that it must meet, cell
by cell of the grid; each cell multiplies one chunk to a partial tile of int64 scores; the partial
tiles of a cell are shuffled together and added up; and each whole tile is reduced to its few best
rows an anchor before anything else is shuffled.

Blocks hold rows of one bucket of labels. So positives, which share their anchor's label, come from
tiles within a bucket, and negatives from the other tiles and from buckets of several labels: where no
two labels share a bucket, no pair is scored twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldspar.llm.scratch import Scratch

BLOCK_ROWS, ANCHOR_ROWS, CHUNK, BUCKETS = 4096, 256, 32, 64
POSITIVES, NEGATIVES, WINDOW = 5, 5, (80, 100)

_HEAD = "ids binary, labels binary, rows binary"
_BLOCK = f"bucket int, block int, chunk int, n int, {_HEAD}, matrix binary"
_GOAL = "struct<at:int,slot:int,id:bigint,score:bigint>"
_CELL = ["a_bucket", "a_block", "bucket", "block"]
_PARTIAL = f"a_bucket int, a_block int, bucket int, block int, chunk int, a_n int, n int, {', '.join(f'{side}{c}' for side in ('a_', '') for c in _HEAD.split(', '))}, goals array<{_GOAL}>, scores binary"
#: Whole numbers below this are exact in floating point, sums of them included.
_EXACT = 2.0**53
_WORST = np.iinfo(np.int64).max


def fixed_point(vector: Column, scale: int = 256) -> Column:
    """Each component as floor(scale * x); null if the vector or a component is null or not finite. What 64 bits can't hold becomes the nearest end of their range."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    over, under = F.lit(2**63 - 1), F.lit(-(2**63))
    whole = F.transform(wide, lambda x: F.when(x * scale >= 2.0**63, over).when(x * scale <= -(2.0**63), under).otherwise(F.floor(x * scale)))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(True)), whole)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b transposed in int64. Floating point stands in where all its sums are whole numbers that it holds exactly."""
    x, y = a.astype(float), b.astype(float)
    if a.size and b.size and np.abs(x).max() * np.abs(y).max() * a.shape[1] < _EXACT:
        return (x @ y.T).astype(np.int64)
    return a @ b.T


def best(scores: np.ndarray, good: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) of the ``k`` largest good scores of each row, of equals the first columns."""
    order = np.where(good, ~scores, _WORST)  # ~x falls as x grows and can't overflow
    if order.shape[1] > k:
        edge = np.partition(order, k - 1, axis=1)[:, k - 1 : k]
        good = good & (order <= edge)
    at, column = np.nonzero(good)
    turn = np.lexsort((column, order[at, column], at))
    at, column = at[turn], column[turn]
    begin = np.searchsorted(at, at)
    keep = np.arange(len(at)) - begin < k
    return at[keep], column[keep]


def _packed(chunk: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("id", "ascending"), ("row", "ascending")]).combine_chunks()
        vectors = rows["vector"].combine_chunks()
        sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
        matrix = np.zeros((len(sizes), max(int(sizes.max()), 1)), np.int64)  # a shorter vector goes on with zeros
        matrix[np.arange(matrix.shape[1]) < sizes[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
        head = [rows[c].to_numpy().astype(np.int64).tobytes() for c in ("id", "label", "row")]
        out = [(key[0].as_py(), key[1].as_py(), c // chunk, len(sizes), *(head if c == 0 else (None,) * 3), np.ascontiguousarray(matrix[:, c : c + chunk]).tobytes()) for c in range(0, matrix.shape[1], chunk)]
        kinds = [*[pa.int32()] * 4, *[pa.binary()] * 4]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in _BLOCK.split(", ")])

    return pack


def _multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial tiles: the rest of each row, and the scores of its two chunks."""
    for batch in batches:
        for r in range(batch.num_rows):
            row = batch.slice(r, 1)
            a, b = (np.frombuffer(row[c][0].as_buffer(), np.int64).reshape(row[n][0].as_py(), -1) for c, n in (("a_matrix", "a_n"), ("matrix", "n")))
            shared = min(a.shape[1], b.shape[1])
            scores = pa.array([product(a[:, :shared], b[:, :shared]).tobytes()], pa.binary())
            names = [x.split()[0] for x in _PARTIAL.split(", ")][:-1]
            yield pa.RecordBatch.from_arrays([*(row[c] for c in names), scores], [*names, "scores"])


class _Tile:
    """The scores of one cell, added up over its chunks as they come."""

    def __init__(self, batches: Iterator[pa.RecordBatch]) -> None:
        self.scores, self.goals = None, None
        for batch in batches:
            for r in range(batch.num_rows):
                part = np.frombuffer(batch["scores"][r].as_buffer(), np.int64).reshape(batch["a_n"][r].as_py(), batch["n"][r].as_py())
                self.scores = part.copy() if self.scores is None else self.scores.__iadd__(part)
                if batch["chunk"][r].as_py() == 0:
                    self.a_ids, self.a_labels, self.a_rows, self.ids, self.labels, self.rows = (np.frombuffer(batch[f"{side}{c}"][r].as_py(), np.int64) for side in ("a_", "") for c in ("ids", "labels", "rows"))
                    self.goals = batch["goals"][r].as_py()


_FOUND = "a_bucket int, a_block int, at int, slot int, anchor_id bigint, positive_id bigint, positive_score bigint, id bigint, row bigint, score bigint"


def _rows(key: tuple, at: np.ndarray, slot: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    arrays = [pa.array(np.full(len(at), k.as_py(), np.int32)) for k in key[:2]] + [pa.array(x.astype(np.int32)) for x in (at, slot)]
    return pa.RecordBatch.from_arrays(arrays + [pa.array(x.astype(np.int64)) for x in columns], [x.split()[0] for x in _FOUND.split(", ")])


def _positives(k: int) -> Callable[[tuple, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def reduce(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _Tile(batches)
        good = (t.a_labels[:, None] == t.labels[None]) & (t.a_rows[:, None] != t.rows[None])
        at, column = best(t.scores, good, k)
        none = np.zeros(len(at), np.int64)
        yield _rows(key, at, none, t.a_ids[at], none, none, t.ids[column], t.rows[column], t.scores[at, column])

    return reduce


def _negatives(k: int, window: tuple[int, int]) -> Callable[[tuple, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def reduce(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _Tile(batches)
        other = t.a_labels[:, None] != t.labels[None]
        ends = np.iinfo(np.int64)
        for slot in sorted({g["slot"] for g in t.goals or ()}):
            goals = [g for g in t.goals if g["slot"] == slot]
            rows = np.array([g["at"] for g in goals])
            # Bounds as Python integers, so that no product of a score overflows.
            low = np.array([min(max(-(-window[0] * g["score"] // 100), ends.min), ends.max) for g in goals], np.int64)
            high = np.array([min(max(window[1] * g["score"] // 100, ends.min), ends.max) for g in goals], np.int64)
            scores = t.scores[rows]
            at, column = best(scores, other[rows] & (scores >= low[:, None]) & (scores <= high[:, None]), k)
            ids, wanted = np.array([g["id"] for g in goals]), np.array([g["score"] for g in goals])
            yield _rows(key, rows[at], np.full(len(at), slot), t.a_ids[rows[at]], ids[at], wanted[at], t.ids[column], t.rows[column], scores[at, column])

    return reduce


def _first(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The ``k`` best rows of each group, with their rank from 1. Every tile has left ``k`` at most."""
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW,
    block_rows: int = BLOCK_ROWS, anchor_rows: int = ANCHOR_ROWS, chunk: int = CHUNK, buckets: int = BUCKETS,
) -> DataFrame:
    """Hard negatives of anchors: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` has id bigint, label bigint, vector array<bigint> and anchor boolean. A score is the inner
    product with the anchor; higher ones come first, equal ones by smaller id. An anchor's positives are
    its ``n_positives`` best other rows of its label. For each, the ``n_negatives`` best rows of other
    labels follow whose score is at least window[0] and at most window[1] hundredths of the positive's.

    Rows with a null id, label, vector or component take no part; a null anchor is none. Rows that repeat
    an id are rows of their own, so an anchor given twice has its results twice. Of two vectors of
    unlike length the shorter goes on with zeros. Scores are exact within 64 bits and wrap beyond.
    Vectors all alike, a label with a third of all rows, or an empty table need no care. Other columns
    are ignored. ``rows`` must replay the same rows in the same order, as a stored table does.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "negatives")
    known = rows.select("id", "label", "vector", "anchor", F.monotonically_increasing_id().alias("row"), F.pmod(F.hash("label"), F.lit(buckets)).alias("bucket"))
    known = known.where("id is not null and label is not null and vector is not null and not exists(vector, x -> x is null)")
    counts = known.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"), F.count_if("anchor").alias("anchors"))
    counts = counts.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("anchors").alias("anchors"), F.count(F.lit(1)).alias("labels")).collect()  # ``buckets`` rows at most
    sizes = {r.bucket: -(-r.n // block_rows) for r in counts}
    a_sizes = {r.bucket: -(-r.anchors // anchor_rows) for r in counts}
    mixed = {r.bucket for r in counts if r.labels > 1}

    def blocks(part: DataFrame, into: dict[int, int], name: str) -> DataFrame:
        per = F.get(F.array(*(F.lit(max(into.get(b, 1), 1)) for b in range(buckets))), F.col("bucket"))
        part = part.withColumn("block", F.pmod(F.xxhash64("row"), per).cast("int")).select("bucket", "block", "id", "label", "row", "vector")
        return scratch.save(part.groupBy("bucket", "block").applyInArrow(_packed(chunk), _BLOCK), name)

    all_blocks = blocks(known, sizes, "blocks")
    anchors = blocks(known.where("anchor"), a_sizes, "anchors")
    anchors = anchors.select(*(F.col(c).alias(f"a_{c}") if c != "chunk" else F.col(c) for c in anchors.columns))

    def tiles(sides: DataFrame, same: bool) -> DataFrame:
        """Partial tiles of the cells within a bucket, or of those that can hold two labels."""
        targets = F.array(*(F.struct(F.lit(b).alias("bucket"), F.lit(n).alias("n"), F.lit(b in mixed).alias("mixed")) for b, n in sizes.items()))
        if not sizes:
            targets = F.array().cast("array<struct<bucket:int,n:int,mixed:boolean>>")
        wanted = F.filter(targets, lambda t: t["bucket"] == F.col("a_bucket") if same else (t["bucket"] != F.col("a_bucket")) | t["mixed"])
        cells = sides.withColumn("to", F.explode(wanted)).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("to.n") - 1))).withColumn("bucket", F.col("to.bucket")).drop("to")
        met = cells.join(all_blocks, ["bucket", "block", "chunk"])
        names = [x.split()[0] for x in _PARTIAL.split(", ")][:-1]
        return met.select(*names, "a_matrix", "matrix").mapInArrow(_multiplied, _PARTIAL).groupBy(*_CELL)

    bare = anchors.withColumn("goals", F.lit(None).cast(f"array<{_GOAL}>"))
    found = _first(tiles(bare, True).applyInArrow(_positives(n_positives), _FOUND), ["a_bucket", "a_block", "at"], n_positives)
    goals = found.groupBy("a_bucket", "a_block").agg(F.collect_list(F.struct("at", F.col("rank").alias("slot"), "id", "score")).cast(f"array<{_GOAL}>").alias("goals"))  # of one block of anchors
    goals = scratch.save(goals, "goals")
    aimed = anchors.join(goals, ["a_bucket", "a_block"]).withColumn("goals", F.when(F.col("chunk") == 0, F.col("goals")))
    mined = _first(tiles(aimed, False).applyInArrow(_negatives(n_negatives, window), _FOUND), ["a_bucket", "a_block", "at", "slot"], n_negatives)
    return mined.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
