"""Streams with late, split and repeated input against a batch over all of it."""

import random

import pytest
from pyspark.sql import functions as F

from veldspar.operators import logs
from veldspar.streaming import ordered

ENTRY = "file_ord int, line_no long, ts string, thread string, message string"


def _ts(ms):
    seconds, ms = divmod(ms, 1000)
    return f"2026-01-02 {seconds // 3600:02}:{seconds // 60 % 60:02}:{seconds % 60:02}.{ms:03}"


@pytest.fixture(scope="module")
def events():
    rng = random.Random(5)
    rows, ms = [], 3_600_000
    for k in range(300):
        ms += rng.choice([1, 500, 20_000, 90_000])
        kind = rng.choice(["[DISPATCH-START] rule=1", f"[DISPATCH-END] rule=1 cost={rng.choice([5, 10_000, 10_001, 99_999])}ms", "[DISPATCH-END] rule=2", "other"])
        rows.append((0, k, _ts(ms), f"exec-{rng.randrange(3)}", kind))
    return rows


def _ran(spark, tmp_path, events, query, mode, seed=1, batches=3):
    """Batches of events, shuffled within nine neighbours so that some come late, then one far ahead that moves the watermark past all."""
    rng = random.Random(seed)
    order = sorted(range(len(events)), key=lambda k: k + rng.randrange(9))
    folder = tmp_path / f"in{seed}"
    size = -(-len(order) // batches)
    parts = [[events[k] for k in order[a : a + size]] for a in range(0, len(order), size)]
    ahead = [(9, k, _ts(80_000_000 + k * 1000), "ahead", "[DISPATCH-END] rule=3") for k in range(2)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for part in [*parts, ahead[:1], ahead[1:]]:
            spark.createDataFrame(part, ENTRY).coalesce(1).write.mode("append").json(str(folder))
            stream = spark.readStream.schema(ENTRY).json(str(folder))
            kept = lambda frame, k: frame.withColumn("batch", F.lit(k)).write.mode("append").parquet(str(tmp_path / f"out{seed}"))
            run = query(stream).writeStream.foreachBatch(kept).outputMode(mode).option("checkpointLocation", str(tmp_path / f"check{seed}"))
            run.trigger(availableNow=True).start().awaitTermination(120)
        return spark.read.parquet(str(tmp_path / f"out{seed}"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_pairs_of_a_stream_equal_the_batch(spark, tmp_path, events):
    got = _ran(spark, tmp_path, events, lambda s: ordered.stuck_threads(s, late="30 minutes"), "append")
    want = logs.stuck_threads(spark.createDataFrame(events, ENTRY))
    columns = ["thread", "start_time", "end_time", "duration_ms"]
    rows = sorted(map(tuple, want.select(columns).collect()))
    assert rows and sorted(map(tuple, got.select(columns).collect())) == rows


def test_runs_of_a_stream_equal_the_batch(spark, tmp_path, events):
    got = _ran(spark, tmp_path, events, lambda s: ordered.heatmap(s, late="30 minutes"), "append", 2).where("file_ord = 0")
    want = logs.heatmap(spark.createDataFrame(events, ENTRY))
    rows = sorted((r.run, r.hour, r.entries) for r in want.collect())
    assert len(rows) > 3 and sorted((r.run, r.hour, r.entries) for r in got.collect()) == rows


def test_latest_values(spark, tmp_path, events):
    got = _ran(spark, tmp_path, events, lambda s: ordered.latest(s, "thread", "line_no", late="30 minutes", kept=5), "update", 3)
    last = got.groupBy("thread").agg(F.max_by("values", "batch").alias("values")).where("thread <> 'ahead'").collect()
    want = {}
    for _, k, _, thread, _ in events:
        want[thread] = [*want.get(thread, []), str(k)][-5:]
    assert {r.thread: r["values"] for r in last} == want


def test_open_starts_are_forgotten():
    pairs = ordered.Pairs(10, 1000)
    state, out = pairs.fold(None, (5000, 0, 0, "+a", None))
    assert not out and pairs.wake(state) == 6001 and pairs.idle(state, 6000) == state and pairs.idle(state, 6001) is None
    assert pairs.fold(state, (5900, 0, 1, "-b", 11)) == (None, [("a", "b", 11)]) and pairs.fold(state, (6001, 0, 1, "-b", 11)) == (None, [])
