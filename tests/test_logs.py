"""Log operators on hand-made lines."""

import random

import pytest

from veldspar.functions import logs as fn
from veldspar.operators import logs

LINE = "2026-07-20 16:5{m}:00.00{k} [INFO][{t}][com.app.{c}:{n}] {msg}"


def _lines(spark, *files):
    rows = [(f, n, line) for f, lines in enumerate(files) for n, line in enumerate(lines)]
    return spark.createDataFrame(rows, "file_ord int, line_no long, line string")


def test_parsing_and_stacks(spark):
    lines = _lines(
        spark,
        ["\tat orphan", LINE.format(m=1, k=1, t="a b", c="X", n="12", msg="hi\rthere"), "Caused by: x", "\tat one", "junk", "", LINE.format(m=1, k=2, t="t2", c="Y", n="99999999999", msg="")],
        ["\tat belongs to nothing here", "  " + LINE.format(m=2, k=3, t="t3", c="Z", n="7", msg="中文 msg") + "  "],
    )
    got = sorted((r.file_ord, r.line_no, r.thread, r["class"], r.line, r.message, r.has_stack) for r in logs.entries(lines).collect())
    assert got == [(0, 1, "a b", "com.app.X", 12, "hi\rthere", True), (1, 1, "t3", "com.app.Z", 7, "中文 msg", False)]  # an empty message needs its space, which trimming takes


@pytest.mark.parametrize("block", [1, 2, 3, 100_000])
def test_stacks_and_runs_do_not_depend_on_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(logs, "BLOCK_LINES", block)
    rng = random.Random(3)
    files = []
    for _ in range(3):
        lines = []
        for k in range(60):
            kind = rng.random()
            lines.append("\tat x" if kind < 0.3 else "junk" if kind < 0.5 else f"2026-07-20 1{rng.choice('01')}:{rng.choice(['05', '15', '16', '29'])}:00.000 [INFO][t][c:1] m{k}")
        files.append(lines)
    want, runs = [], []
    for f, lines in enumerate(files):
        last = None
        for n, line in enumerate(lines):
            if line.startswith("\t"):
                if last is not None:
                    want[last] = (*want[last][:2], True)
            elif line != "junk":
                last = len(want)
                want.append((f, n, False))
                key = f"{line[:14]}{int(line[14:16]) // 10 * 10:02d}"
                if runs and runs[-1][0] == key:
                    runs[-1][1] += 1
                else:
                    runs.append([key, 1])
    rows = logs.entries(_lines(spark, *files))
    assert sorted((r.file_ord, r.line_no, r.has_stack) for r in rows.collect()) == want
    assert [[r.hour, r.entries] for r in logs.heatmap(rows).collect()] == runs
    assert sorted(map(tuple, logs.parsed(_lines(spark, *files)).collect())) == sorted(tuple(r)[:-1] for r in rows.collect())


@pytest.mark.parametrize("block", [1, 3, 100_000])
def test_stuck_threads_do_not_depend_on_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(logs, "BLOCK_LINES", block)
    rng = random.Random(5)
    files, want, open_at = [], [], {}
    for _ in range(3):
        lines = []
        for _ in range(50):
            thread, start, cost = rng.choice("ab"), rng.random() < 0.5, rng.choice([9000, 10_001, 20_000])
            ts = f"2026-07-20 10:00:{rng.randrange(60):02d}.{rng.randrange(1000):03d}"
            lines.append(f"{ts} [INFO][{thread}][c:1] " + ("[DISPATCH-START]" if start else f"[DISPATCH-END] cost={cost}ms"))
            if not start and open_at.get(thread) and cost > 10_000:
                want.append((thread, open_at[thread], ts, cost))
            open_at[thread] = ts if start else None
        files.append(lines)
    got = logs.stuck_threads(logs.parsed(_lines(spark, *files))).collect()
    assert sorted(map(tuple, got)) == sorted(want) and want


def test_categories_and_extraction(spark):
    cases = [
        ("RequestRouterAspect", "device not register", "HttpRequest"),
        ("X", "device not register [DISPATCH-END]", "DeviceNotRegistered"),
        ("AlgorithmHandler", "Clear leak clients end: 0", "Other"),
        ("X", "Clear leak clients end: 3", "ConnectionLeak"),
        ("X", "Clear leak clients end: 3000000000", "Other"),
        ("AlgorithmHandler", "boom", "ByteBufError"),
        ("FrEnergyServiceImpl", "boom", "EnergyProcessError"),
        ("X", "disabled ruleId=17 x", "DispatchDisabled"),
        ("X", "nothing", "Other"),
    ]
    frame = spark.createDataFrame(cases, "class string, message string, want string")
    from pyspark.sql import functions as F

    assert all(r.got == r.want for r in frame.select("want", fn.category(F.col("class"), F.col("message")).alias("got")).collect())
    texts = spark.createDataFrame([("sn 12345678901234 x123456789012345 123456789012345中 and 98765432109876",), ('"name":"p1","name":"42","name":"p2" [DISPATCH-END] cost=1ms cost=25ms',)], "m string")
    got = texts.select(fn.serials(F.col("m")), fn.projects(F.col("m")), fn.dispatch_cost(F.col("m"))).collect()
    assert got[0][0] == ["12345678901234", "98765432109876"] and got[0][2] is None
    assert got[1][1] == ["p1", "p2"] and int(got[1][2]) == 25


def test_stuck_threads(spark):
    msg = [("a", "[DISPATCH-START]"), ("a", "[DISPATCH-START] again"), ("b", "[DISPATCH-END] cost=99999ms"), ("a", "[DISPATCH-END] cost=64195ms"), ("a", "[DISPATCH-END] cost=70000ms"), ("b", "[DISPATCH-START]"), ("b", "[DISPATCH-END]"), ("b", "[DISPATCH-END] cost=20000ms"), ("c", "[DISPATCH-START]"), ("c", "[DISPATCH-END] cost=10000ms")]
    rows = logs.entries(_lines(spark, [LINE.format(m=1, k=k % 10, t=t, c="X", n=1, msg=m) for k, (t, m) in enumerate(msg)]))
    assert [(r.thread, r.start_time[-3:], r.end_time[-3:], r.duration_ms) for r in logs.stuck_threads(rows).collect()] == [("a", "001", "003", 64195)]
    assert logs.summary(rows).first().entry_count == 10


def test_report_counts_stacks_without_texts(spark, monkeypatch):
    """Stack lines mark the entry before them, once, across blocks too; the count needs no text and is that of entries."""
    monkeypatch.setattr(logs, "BLOCK_LINES", 3)
    entry, stack = "2026-01-02 03:04:05.678 [INFO][t][a.B:1] auth failed", "\tat x"
    text = lambda marks: [(f, n, {"e": entry, "s": stack, "-": "noise"}[c]) for f, line in enumerate(marks) for n, c in enumerate(line)]
    for marks in (["ees", "s"], ["eesssssse", "sse"], ["e-ss-s-s", "-e-", "eee" "sss" "---" "s"], ["ess" "s", "ee" "-" "s"], ["---"]):
        lines = spark.createDataFrame(text(marks), "file_ord int, line_no bigint, line string").repartition(3)
        want = logs.entries(lines).where("has_stack").count()
        assert logs._stacks(logs._noted(lines)).first().stacks == want
        said = {r.nth: r.line for r in logs.report(lines).where("section = 'overview'").collect()}
        entries = sum(m.count("e") for m in marks)
        assert said[2].startswith(f"- 总行数: {entries + want}, 条目: {entries}, ")


def test_report_parses_each_line_once(spark):
    """No section goes back to the lines."""
    read = spark.sparkContext.accumulator(0)
    lines = [(0, n, "2026-01-02 03:04:05.678 [INFO][t][a.B:1] disabled ruleId=7 sn 12345678901234") for n in range(5)]

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    found = spark.createDataFrame(lines, "file_ord int, line_no bigint, line string").mapInArrow(counted, "file_ord int, line_no bigint, line string")
    rows = logs.report(found).collect()
    assert read.value == 5 and {r.section.split(":")[0] for r in rows} == {"overview", "categories", "heatmap", "serials", "rules", "samples"}
