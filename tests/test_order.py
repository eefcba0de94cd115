"""Orbits and numbering against loops, also where one group holds everything."""

import random
import time

import pytest
from pyspark.sql import functions as F

from veldspar.operators import order, registers
from veldspar.scratch import Scratch


def test_orbit_equals_following_steps(spark):
    rng = random.Random(2)
    rows, want = [], set()
    for doc in range(4):
        n = [1, 7, 40, 300][doc]
        to = {i: rng.choice([i + 1, i + 1, i + 3, None]) for i in range(n)}
        led = {t for t in to.values() if t is not None}
        starts = {i for i in range(n) if i not in led and rng.random() < 0.7}
        rows += [(doc, i, t if t is not None and t < n else None, i in starts) for i, t in to.items()]
        for s in starts:
            while s is not None and s < n:
                want.add((doc, s))
                s = to[s]
    scratch = Scratch(spark, "test-orbit")
    nodes = spark.createDataFrame(rows, "doc int, at long, to long, start boolean")
    got = [tuple(r) for r in order.orbit(nodes, ["doc"], scratch).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert order.orbit(nodes.limit(0), ["doc"], scratch, "none").collect() == []
    scratch.close()


def test_numbers_run_through_the_ranges_of_a_hot_key(spark):
    rng = random.Random(3)
    rows = [(None if i % 9 == 0 else "hot" if i % 3 else str(i % 4), rng.randint(0, 50), i) for i in range(3000)]
    got = order.numbered(spark.createDataFrame(rows, "k string, x int, i int"), ["k"], [-F.col("x"), F.col("i")], Scratch(spark, "test-numbered")).collect()
    want = {}
    for k, _, i in sorted(rows, key=lambda r: (-r[1], r[2])):
        want.setdefault(k, []).append(i)
    assert len(got) == len(rows) and all(want[r.k][r.nth - 1] == r.i for r in got)


def _merged(spark, frame):
    rows = frame.select("doc_id", "batch_ord", "row_ord", F.lit("valid").alias("status"), F.array(F.col("row_ord").cast("string"), F.lit("1"), F.lit("Ua"), F.lit("V"), F.col("address").cast("string"), F.col("kind").cast("string"), *(F.lit(x) for x in ("1", "1", "1", "3", "", "1"))).alias("fields"))
    return registers.merge(rows)


def _greedy(rows):
    """Row numbers of the records that a pass over sorted records keeps."""
    held_to, at, bits, kept = -1, None, False, []
    for address, width, n, kind in rows:
        if address > held_to:
            held_to, at, bits = address + width - 1, address, kind <= 3
            kept.append(n)
        elif address == at and bits and kind <= 3:
            kept.append(n)
    return kept


@pytest.mark.parametrize("seed", range(2))
def test_merge_of_touching_records_and_cell_borders(spark, seed):
    """Documents whose records touch across the borders of cells, in several sizes."""
    rng = random.Random(seed)
    rows = []
    for doc, (low, high, n) in enumerate([(0, 30, 40), (registers.CELL - 12, registers.CELL + 12, 60), (2**63 - 4, 2**63 + 4, 9), (0, 3 * registers.CELL, 4000), (5, 5, 30)]):
        rows += [(doc, rng.randrange(3), k, rng.randint(low, high), rng.choice([1, 2, 3, 6, 6, 8, 10]) if seed else rng.choice([8, 10])) for k in range(n)]
    # Two registers at every address: what a cell leaves held depends on what it was entered with, through all cells.
    rows += [(5, 0, k, 17 + k, 8) for k in range(6 * registers.CELL)]
    frame = spark.createDataFrame([(d, b, k, str(a), t) for d, b, k, a, t in rows], "doc_id int, batch_ord int, row_ord int, address string, kind int")
    got = {}
    for r in _merged(spark, frame).where("status = 'kept'").collect():
        got.setdefault(r.doc_id, []).append((r.ord, int(r.address), int(r.fields[5])))
    width = {8: 2, 10: 4}
    for doc in range(6):
        seen, once = set(), []
        for _, b, k, a, t in sorted((r for r in rows if r[0] == doc), key=lambda r: (r[1], r[2])):
            if (a, t) not in seen:
                seen.add((a, t))
                once.append((a, width.get(t, 1), (b, k), t))
        kept = set(_greedy(sorted(once)))
        want = [(i, a, t) for i, (a, _, _, t) in enumerate(sorted(r for r in once if r[2] in kept), 1)]
        assert sorted(got[doc]) == want


def test_one_island_of_a_million_records_is_many_tasks(spark):
    """Every record touches the next: one document, one island. No task holds more than its share."""
    n = 1_000_000
    kind = F.when(F.col("id") % 3 == 0, 10).otherwise(F.when(F.col("id") % 3 == 1, 8).otherwise(6))
    frame = spark.range(n).select(F.lit(1).alias("doc_id"), F.lit(0).alias("batch_ord"), F.col("id").cast("int").alias("row_ord"), F.col("id").alias("address"), kind.alias("kind"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        began = time.time()
        merged = _merged(spark, frame).where("status = 'kept'").select("ord", F.col("address").cast("long").alias("address"))
        got = merged.agg(F.count(F.lit(1)).alias("n"), F.sum("address").alias("sum"), F.max("ord").alias("last"), F.sum(F.pmod(F.col("ord") * F.col("address"), F.lit(997))).alias("mix")).first()
        assert time.time() - began < 240
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    kept = _greedy((a, (4, 2, 1)[a % 3], a, (10, 8, 6)[a % 3]) for a in range(n))
    assert tuple(got) == (len(kept), sum(kept), len(kept), sum(i * a % 997 for i, a in enumerate(kept, 1)))


def test_rows_numbered_without_keys_and_falling(spark, monkeypatch):
    """One group of all rows, some columns falling; no task sorts all of it."""
    frame = spark.range(2000).select((F.col("id") % 7).alias("a"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("b"))
    found = order.numbered(frame, [], [F.col("a"), F.col("b")], Scratch(spark, "test-falling"), falling=(1,))
    rows = sorted(sorted(((k % 7, f"n{k}") for k in range(2000)), key=lambda r: r[1], reverse=True), key=lambda r: r[0])
    assert [(r.a, r.b) for r in found.orderBy("nth").collect()] == rows
    assert [r.nth for r in found.orderBy("nth").collect()] == list(range(1, 2001))


def test_names_are_placed_by_ranges(spark):
    from veldspar.plans import queries

    seen = queries.log_file_names(spark, "/root/testdata/sf0.001")
    plan = seen._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number() windowspecdefinition(_part" in plan and "row_number() windowspecdefinition(name" not in plan


def test_running_folds_over_spans(spark):
    rows = [(k, p, None if p % 4 == 1 else (p * 7) % 11) for k in ("a", "b") for p in range(-1, 23 if k == "a" else 2)]
    frame = spark.createDataFrame(rows, "k string, place long, v long").repartition(3)
    for span in (1, 5, 100):
        for fold, both in ((F.sum, sum), (F.max, max)):
            got = {(r.k, r.place): r.out for r in order.running(frame, ["k"], "place", F.col("v"), fold, "out", span).collect()}
            want = {(k, p): [v for k2, q, v in rows if k2 == k and q < p and v is not None] for k, p, _ in rows}
            assert got == {x: both(v) if v else None for x, v in want.items()}
