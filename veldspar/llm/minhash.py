"""Near-duplicate groups with SetSketch registers.

A document's set is its distinct word shingles, as 64-bit hashes. Its sketch has REGISTERS
registers: register i is the exponentially spaced rank 1 - log_BASE(x) of the least
exponential value x that the set's elements have under hash i, truncated to 0..LEVELS. Sketches
of unions are element-wise maxima, and two registers agree about as often as the sets overlap.

1. Documents with one and the same set form a class; classes go on.
2. A few registers at a time make a band; classes that share a band are candidates. Bands
   have as many registers as let them miss a pair at the threshold with a chance of MISSED
   at most: five at 0.8, six at 0.85. More similar pairs are missed far less.
3. Within a shared band each class is compared with one leader; the pair's similarity is
   estimated from all registers and both set sizes by maximum likelihood, and each class
   keeps the leader that suits it best. Those pairs are confirmed on full sets. This takes
   one pair a class however large a band is.
4. Bands whose classes still belong to several groups are compared block by block, across
   groups only, by estimate and then on full sets, within the task that has the blocks. So
   no link that would join two groups is lost for the size of a band, large groups of copies
   are joined before any block is formed, blocks of one group never meet, and pairs are
   never rows. Blocks are bounded by the sizes of their sets.
5. Links make groups by label propagation with pointer jumping.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldspar.llm.scratch import Scratch
from veldspar.llm.textkit import each_slice, mix64

REGISTERS = 144
MISSED = 2e-5
BASE = 1.02
RATE = 20.0
LEVELS = 1500
#: Hashes of the sets in a block of a band, each set counting ROW_WEIGHT more for its registers. Bounds a task's memory, not its pairs.
BLOCK_WEIGHT = 1 << 18
ROW_WEIGHT = 72
#: Of the bitmap by which the scan finds the texts of candidates: 16 MB at most are broadcast.
FILTER_BITS = 1 << 26
#: A pair goes on to full sets if its estimate is at most so far below the threshold: four standard deviations of the estimate.
MARGIN = 4.0

_SEEDS = mix64(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_hashes(word_hashes: np.ndarray, words: int) -> np.ndarray:
    """Hashes of runs of ``words`` words, or of the whole sequence if it is shorter."""
    n = len(word_hashes)
    width = min(words, n)
    if not width:
        return np.zeros(0, np.uint64)
    out = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        out = mix64(out + word_hashes[k : n - width + 1 + k] + np.uint64(k + 1))
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Registers of a non-empty set."""
    least = np.empty(REGISTERS, np.uint64)
    for i, seed in enumerate(_SEEDS):
        least[i] = ((hashes ^ seed) * (seed | np.uint64(1))).min()
    x = -np.log1p(-(least.astype(float) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(np.maximum(x, 1e-300)) / np.log(BASE)), 0, LEVELS).astype("<u2")


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard similarity of row pairs of registers by maximum likelihood, given the set sizes.

    Of two sets with shares u and v of the summed sizes, a register is greater on the first
    side with probability p(u - vJ), on the second with p(v - uJ), p(x) = -log_BASE(1 - x(BASE-1)/BASE).
    The best J of a grid is refined once by a finer grid.
    """
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    u = na / (na + nb)
    v = 1 - u
    most = np.minimum(u / v, v / u)

    def likelihood(j: np.ndarray) -> np.ndarray:
        p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
        up, down = p(u[:, None] - v[:, None] * j), p(v[:, None] - u[:, None] * j)
        tiny = 1e-12
        return more[:, None] * np.log(up + tiny) + less[:, None] * np.log(down + tiny) + same[:, None] * np.log(np.maximum(1 - up - down, tiny))

    coarse = np.linspace(0, 1, 41)[None] * most[:, None]
    best = np.take_along_axis(coarse, likelihood(coarse).argmax(1)[:, None], 1)
    fine = np.clip(best + np.linspace(-1, 1, 21)[None] * most[:, None] / 40, 0, most[:, None])
    return np.take_along_axis(fine, likelihood(fine).argmax(1)[:, None], 1)[:, 0]


def band_rows(similarity: tuple[int, int]) -> int:
    """Registers of a band: the most for which a pair at the threshold is hardly ever missed."""
    s = similarity[0] / similarity[1]
    return max((r for r in range(1, 13) if (1 - s**r) ** (REGISTERS // r) <= MISSED), default=1)


def least_estimate(similarity: tuple[int, int]) -> float:
    s = similarity[0] / similarity[1]
    return s - MARGIN * (s * (1 - s) / REGISTERS) ** 0.5


def set_key(own: np.ndarray) -> bytes:
    """Two independent 64-bit sums of a set, and its size."""
    return np.array([mix64(own).sum(), mix64(own ^ np.uint64(0x5BF03635)).sum(), len(own)], "<u8").tobytes()


def _sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n, set_key and registers; n = 0 has neither key nor registers."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, found in each_slice(batch.column(1), lower=True):
                hashes, sizes, keys, registers = found.hashes(), [], [], []
                for d in range(hi - lo):
                    own = shingle_hashes(hashes[found.first[d] : found.first[d + 1]], words)
                    sizes.append(len(own))
                    if len(own):
                        keys.append(set_key(own))
                        registers.append(sketch(own).tobytes())
                    else:
                        keys.append(None)
                        registers.append(None)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(registers, pa.binary())], ["doc_id", "n", "set_key", "registers"])

    return docs.mapInArrow(sketched, "doc_id bigint, n bigint, set_key binary, registers binary")


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, REGISTERS)


def _estimated(pairs: DataFrame) -> DataFrame:
    """Add ``estimate`` to rows (a, b, na, nb, ra, rb) and drop the registers."""

    def estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ra, rb = _registers(batch.column("ra")), _registers(batch.column("rb"))
                na, nb = (batch.column(c).to_numpy().astype(float) for c in ("na", "nb"))
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(estimate(ra, rb, na, nb))], ["a", "b", "estimate"])

    return pairs.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(estimated, "a bigint, b bigint, estimate double")


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """node and shingles (packed sorted 64-bit hashes) of the classes ``wanted`` (node, rep, set_key).

    A bitmap of FILTER_BITS bits of the wanted ids goes to the scan of the texts, so that
    few others are read further. It may let some pass; the join on set_key does not.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, found in each_slice(batch.column(0), lower=True):
                hashes, keys, sets = found.hashes(), [], []
                for d in range(hi - lo):
                    own = shingle_hashes(hashes[found.first[d] : found.first[d + 1]], words)
                    keys.append(set_key(own))
                    sets.append(own.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], ["key", "shingles"])

    place = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    bit = F.expr("shiftleft(1L, cast(place & 63 as int))")
    bitmap = wanted.select(place("rep").alias("place")).groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    near = docs.withColumn("place", place("doc_id")).join(F.broadcast(bitmap), F.shiftright("place", 6) == F.col("word")).where(F.col("bits").bitwiseAND(bit) != 0)  # FILTER_BITS / 64 rows at most
    found = near.select("text").mapInArrow(packed, "key binary, shingles binary")
    return found.join(wanted.select("node", F.col("set_key").alias("key")), "key").select("node", "shingles").dropDuplicates(["node"])


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) of classes whose full sets are similar enough."""
    top, bottom = similarity

    def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                shared = np.intersect1d(x, y, assume_unique=True).size
                keep.append(bottom * shared >= top * (len(x) + len(y) - shared) > 0)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(sets.toDF("b", "sb"), "b").join(sets.toDF("a", "sa"), "a")
    return joined.select("a", "b", "sa", "sb").mapInArrow(confirmed, "a bigint, b bigint")


def _blocks(rows: DataFrame) -> DataFrame:
    """Rows (band, at, node, component, n) once for each pair of blocks that they are in: adds key and right.

    A group that outweighs BLOCK_WEIGHT has blocks of its own, which never meet each other;
    smaller groups are dealt into blocks of about that weight. ``key`` is a pair of blocks of
    a band, ``right`` tells on which side of it the row is.
    """
    weight = F.col("n") + ROW_WEIGHT
    groups = rows.groupBy("band", "component").agg(F.sum(weight).alias("weight"))
    large = F.col("weight") >= BLOCK_WEIGHT
    small = groups.groupBy("band").agg(F.coalesce(F.sum(F.when(~large, F.col("weight"))), F.lit(0)).alias("small"))
    bucket = -1 - F.pmod(F.xxhash64("component"), F.greatest(F.lit(1), F.ceil(F.col("small") / BLOCK_WEIGHT)))
    groups = groups.join(small, "band").select("band", "component", F.when(large, F.col("component")).otherwise(bucket).alias("part"), F.when(large, F.ceil(F.col("weight") / BLOCK_WEIGHT)).otherwise(1).alias("blocks"))
    parts = groups.select("band", "part", "blocks").distinct()
    one, two = parts.toDF("band", "p", "ps"), parts.toDF("band", "q", "qs")
    pairs = one.join(two, "band").where("p < q or (p = q and p < 0)")
    pairs = pairs.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("ps") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("qs") - 1)))
    pairs = pairs.withColumn("key", F.struct("band", "p", "i", "q", "j"))
    sides = pairs.select("band", F.col("p").alias("part"), F.col("i").alias("block"), "key", F.lit(False).alias("right"))
    sides = sides.union(pairs.where("p <> q").select("band", F.col("q").alias("part"), F.col("j").alias("block"), "key", F.lit(True).alias("right")))
    placed = rows.join(groups, ["band", "component"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    return placed.join(sides, ["band", "part", "block"]).drop("part", "block", "blocks")


def _across(rows: DataFrame, floor: float, similarity: tuple[int, int]) -> DataFrame:
    """Confirmed links across groups within pairs of blocks.

    A pair is looked at in the first band that it shares. Pairs that the estimate lets pass
    are confirmed on the full sets; classes that a link of these blocks has joined are not
    compared again, so a pair of blocks gives fewer links than it has classes.
    """
    (top, bottom), height = similarity, band_rows(similarity)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))  # two blocks at most
        one, band = table["key"][0].as_py(), table["at"][0].as_py()
        itself = one["p"] == one["q"]
        node, n, side = (table[c].to_numpy() for c in ("node", "n", "right"))
        names, group = np.unique(table["component"].to_numpy(), return_inverse=True)
        registers = _registers(table["registers"])
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in table["shingles"]]
        slices = registers[:, : REGISTERS // height * height].reshape(len(registers), -1, height)
        left, right = np.flatnonzero(~side), np.flatnonzero(side | itself)
        joined = np.arange(len(names))
        found = []
        for k in left:
            others = right[(joined[group[right]] != joined[group[k]]) & ((node[right] > node[k]) if itself else True)]
            others = others[bottom * np.minimum(n[others], n[k]) >= top * np.maximum(n[others], n[k])]
            if not len(others):
                continue
            equal = (slices[others] == slices[k]).all(2)
            others = others[equal.argmax(1) == band]
            if not len(others):
                continue
            mine = np.repeat(registers[k][None], len(others), 0)
            likely = estimate(mine, registers[others], np.full(len(others), float(n[k])), n[others].astype(float))
            for o in others[np.argsort(-likely, kind="stable")[: int((likely >= floor).sum())]]:
                if joined[group[o]] == joined[group[k]]:
                    continue
                shared = np.intersect1d(sets[k], sets[o], assume_unique=True).size
                if bottom * shared >= top * (n[k] + n[o] - shared):
                    found.append((min(node[k], node[o]), max(node[k], node[o])))
                    joined[joined == joined[group[o]]] = joined[group[k]]
        a, b = zip(*found, strict=True) if found else ([], [])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.groupBy("key").applyInArrow(pairs, "a bigint, b bigint")


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, component: the smallest node that each node of ``links`` (a, b) reaches.

    Labels flow along links and jump to the label of their label, so a chain of n links
    takes about log n rounds. Each round is written, which cuts the lineage.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = scratch.save(both, f"{name}-edges")
    labels = scratch.save(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("component")), f"{name}-0")
    turn = 0
    while True:
        turn += 1
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("nearest"))
        moved = labels.join(near, "node").select("node", F.least("component", "nearest").alias("component"), F.col("component").alias("old"))
        moved = scratch.save(moved, f"{name}-{turn}-moved")
        target = moved.select(F.col("node").alias("component"), F.col("component").alias("further"))
        jumped = moved.join(target, "component").select("node", F.col("further").alias("component"), "old")
        after = scratch.save(jumped, f"{name}-{turn}")
        scratch.drop(f"{name}-{turn}-moved", f"{name}-{turn - 1}")
        changed = after.where("component <> old").limit(1).count()
        labels = after.drop("old")
        if not changed:
            scratch.drop(f"{name}-edges")
            return labels


def near_duplicates(docs: DataFrame, words: int = 5, similarity: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Words are lower-cased in A-Z. Documents are linked when bottom * |intersection| >= top *
    |union| of their sets of ``words``-word shingles, (top, bottom) being ``similarity``; with
    fewer words the whole sequence is the one shingle. component_id is the smallest id
    reachable, kept tells whether it is the document's own.

    A null or empty text, or one without words, has no shingles and is linked with nothing.
    Rows that repeat an id are documents of their own, whose classes only links join; rows
    without an id are left alone: component_id null, kept. Extra columns are ignored; an
    empty table gives an empty table. ``docs`` is read three times and must give the same
    rows each time (a stored table does).

    Links are found as far as they join groups: counting those within a group of near copies
    would take all pairs of it.
    """
    scratch = Scratch(docs.sparkSession, "near-duplicates")
    floor = least_estimate(similarity)
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    sketches = scratch.save(_sketches(docs, words), "sketches")
    known = sketches.where("n > 0 and doc_id is not null")
    classes = known.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("registers").alias("registers"))
    classes = scratch.save(classes.withColumn("node", F.monotonically_increasing_id()), "classes")  # a number that the write makes lasting
    names, side = classes.select("node", "rep", "set_key"), classes.select("node", "n", "registers")

    height = band_rows(similarity)
    width = 2 * height
    keys = F.transform(F.sequence(F.lit(0), F.lit(REGISTERS // height - 1)), lambda i: F.xxhash64(F.substring("registers", i * width + 1, F.lit(width)), i))
    bands = classes.select("node", "rep", "copies", F.posexplode(keys).alias("at", "band"))
    leader = F.min(F.struct((-F.col("copies")).alias("fewest"), "rep", F.col("node").alias("leader")))
    shared = bands.groupBy("band").agg(F.count(F.lit(1)).alias("members"), leader.alias("first")).where("members > 1").select("band", "first.leader")
    members = scratch.save(bands.select("node", "at", "band").join(scratch.save(shared, "shared"), "band"), "members")
    scratch.drop("shared")
    pairs = members.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    pairs = pairs.join(side.toDF("b", "nb", "rb"), "b").join(side.toDF("a", "na", "ra"), "a")
    best = _estimated(pairs).where(F.col("estimate") >= floor).groupBy("b").agg(F.max(F.struct("estimate", (-F.col("a")).alias("minus"))).alias("best"))
    best = scratch.save(best.select((-F.col("best.minus")).alias("a"), "b"), "best")
    wanted = names.join(best.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node")
    sets = scratch.save(_sets(docs, wanted, words), "best-sets")
    links = scratch.save(_confirmed(best, sets, similarity), "links")
    scratch.drop("best", "best-sets")
    groups = components(links, scratch, "groups")

    named = lambda groups: groups.withColumnRenamed("component", "found")
    grouped = members.select("band", "at", "node").join(named(groups), "node", "left").select("band", "at", "node", F.coalesce("found", "node").alias("component"))
    grouped = scratch.save(grouped, "grouped")
    scratch.drop("members")
    mixed = grouped.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("band")
    rows = scratch.save(grouped.join(mixed, "band").join(classes.select("node", "n"), "node"), "open")
    scratch.drop("grouped")
    sets = scratch.save(_sets(docs, names.join(rows.select("node").distinct(), "node"), words), "open-sets")
    blocks = _blocks(rows).join(side.drop("n"), "node").join(sets, "node").select("key", "at", "right", "node", "component", "n", "registers", "shingles")
    links = scratch.save(links.union(_across(blocks, floor, similarity)), "all-links")
    scratch.drop("open", "open-sets", "links")
    groups = components(links, scratch, "all-groups")

    named = names.join(named(groups), "node", "left").select("rep", "set_key", F.coalesce("found", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = scratch.save(named.join(least, "component").select(F.col("set_key").alias("key"), "component_id"), "named")
    scratch.drop("classes", "all-links")
    rows = sketches.select("doc_id", F.col("n").alias("n_shingles"), "set_key")
    known = F.col("set_key").isNotNull() & F.col("doc_id").isNotNull()
    out = rows.where(known).join(named, F.col("set_key") == F.col("key")).select("doc_id", "n_shingles", "component_id")
    out = out.unionByName(rows.where(~known).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.select("*", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
