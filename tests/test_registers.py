"""Register tables and catalogues on hand-made records."""

import random

from pyspark.sql import functions as F

from veldspar.functions import registers as fn
from veldspar.operators import registers

CATALOG = [(0, "Ua", "voltage"), (1, "UA", "shadowed"), (2, "Ep", "energy")]


def _sanitize(spark, rows):
    frame = spark.createDataFrame([(1, 0, k, r) for k, r in enumerate(rows)], "doc_id int, batch_ord int, row_ord int, fields array<string>")
    return registers.sanitize(frame, spark.createDataFrame(CATALOG, "ord int, code string, meaning string"))


def _row(**changes):
    base = dict(zip(fn.COLUMNS, ["1", "1", "Ua", "V", "100", "6", "1", "1", "1", "3", "", "1"], strict=True)) | changes
    return [base[c] for c in fn.COLUMNS]


def test_scalars(spark):
    cases = {"0x0800": 2048, "0X1f": 31, "0301H": 769, "12h": 18, " 42 ": 42, "+7": 7, "": None, "12x": None, "0x": None, "H": None, "18446744073709551615": 2**64 - 1, "18446744073709551616": None, "0x" + "0" * 20 + "f": 15}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", fn.address(F.col("t")).alias("a")).collect()
    assert {r.t: None if r.a is None else int(r.a) for r in got} == cases
    names = {
        "CH2_Ua": (2, "Ua"), "channel 3: Ia": (3, "Ia"), "第十二路 Ua": (12, "Ua"), "二十号回路电压": (20, "电压"), "回路5-": None, "回路5 Ua": (5, "Ua"), "DOC_ DOC_CH1 Ep": (1, "Ep"),
        "CH1Total": None, "CH1-4": None, "CH一百Ua": (1, "百Ua"), "CH十十a": None, "CH0 a": None, "CH1": None, "plain": None, "第1路至第4路": None,
    }
    got = spark.createDataFrame([(k,) for k in names], "t string").select("t", fn.circuit(F.col("t")).alias("c")).collect()
    assert {r.t: None if r.c is None else tuple(r.c) for r in got} == names
    assert fn.numerals()["九十九"] == 99 and fn.numerals()["一十"] == 10 and len(fn.numerals()) == 109
    heads = {"CH1-CH12 Registers": True, "第1路至第4路遥测数据": True, "Channel 1 to 4": True, "CH1 Ua": False, "1-4": True, "回路一~回路四": False}
    got = spark.createDataFrame([(k,) for k in heads], "t string").select("t", fn.is_range_heading(F.col("t")).alias("h")).collect()
    assert {r.t: r.h for r in got} == heads
    texts = {"```csv\na,b\n1,2\n```": "a,b\n1,2", "a": "a", "```\nx": "```\nx", " ```x\r\ny\r\n```\n ": "y"}
    got = spark.createDataFrame([(k,) for k in texts], "t string").select("t", fn.without_fence(F.col("t")).alias("x")).collect()
    assert {r.t: r.x for r in got} == texts
    stems = {"a<b>:c. ": "abc", "CON": "_CON", "com1": "_com1", "..": "output", "x": "x"}
    got = spark.createDataFrame([(k,) for k in stems], "t string").select("t", fn.safe_stem(F.col("t")).alias("x")).collect()
    assert {r.t: r.x for r in got} == stems


def test_sanitize(spark):
    rows = [list(fn.COLUMNS), ["流水号", "组号", "参数名", *[""] * 9], _row(data_name=" ua "), _row(id="2", group="0", data_name="CH3_ep"), _row(id="x"), ["1", "2"], _row(data_name="CH1-4"), _row(data_name="DOC_ other"), _row(data_name=" DOC_")]
    whole = ["9", "2", "Ua", "0x0800", "6", "1", "1", "1", "3", "", "1"]
    rows += [whole, [*whole[:10], "x"]]
    got = _sanitize(spark, rows).orderBy("row_ord").collect()
    seen = [(r.status, *([*r.fields, None][1:3]), len(r.warnings), r.repaired) for r in got]
    assert seen == [
        ("valid", "1", "Ua", 0, False), ("valid", "3", "Ep", 0, False), ("rejected", "1", "Ua", 1, False), ("rejected", "2", None, 1, False),
        ("valid", "1", "CH1-4", 1, False), ("valid", "1", "DOC_other", 0, False), ("valid", "1", "DOC_", 1, False), ("valid", "2", "Ua", 1, True), ("rejected", "2", "Ua", 1, False),
    ]
    assert got[7].fields[3:5] == ["", "2048"] and got[8].status == "rejected"
    counts = registers.diagnostics(_sanitize(spark, rows)).first()
    assert (counts.valid_records, counts.repaired_missing_unit, counts.rejected_records, counts.column_counts) == (6, 1, 3, {2: 1, 11: 2, 12: 6})


def test_merge_equals_a_greedy_pass(spark):
    rng = random.Random(8)
    rows = []
    for k in range(400):
        kind = rng.randint(1, 12)
        address = rng.choice([str(rng.randint(0, 60)), str(rng.randint(1000, 1300)), "0x10"])
        rows.append((k % 3, k % 2, k, _row(id=str(k), reg_add=address, reg_type=str(kind), unit=rng.choice("ab"))))
    frame = spark.createDataFrame(rows, "doc_id int, batch_ord int, row_ord int, fields array<string>")
    sanitized = frame.selectExpr("*", "'valid' status")
    got = {}
    for r in registers.merge(sanitized).where("status = 'kept'").collect():
        got.setdefault(r.doc_id, []).append((r.ord, *r.fields))
    for doc in range(3):
        seen, listed = set(), []
        for _, batch, at, fields in sorted((r for r in rows if r[0] == doc), key=lambda r: (r[1], r[2])):
            if tuple(fields[1:]) not in seen:
                seen.add(tuple(fields[1:]))
                listed.append(fields)
        info = lambda f: (int(f[4]) if f[4].isdigit() else None, {8: 2, 9: 2, 12: 2, 10: 4, 11: 4}.get(int(f[5]), 1), int(f[5]))
        listed = [f for _, f in sorted(enumerate(listed), key=lambda x: (info(x[1])[0] is None, info(x[1])[0] or 0, info(x[1])[1], x[0]))]
        held, kept = [], []
        for f in listed:
            address, width, kind = info(f)
            if address is not None:
                clash = [h for h in held if address <= h[1] and address + width - 1 >= h[0]]
                if clash and not all(h[0] == address and kind <= 3 and h[2] <= 3 for h in clash):
                    continue
                held.append((address, address + width - 1, kind))
            kept.append(f[1:])
        assert sorted(got[doc]) == [(k, str(k), *f) for k, f in enumerate(kept, 1)]


def test_catalogue(spark):
    entries = [(0, "Ua", "A"), (1, "Ia", "I"), (2, "Ua", "B"), (3, "Ua", "A"), (4, "", "x"), (5, "Ub", " "), (6, "Ia", "J / K"), (7, "Ia", "K")]
    found = registers.catalog(spark.createDataFrame(entries, "ord int, code string, meaning string"))
    assert sorted((r.code, r.meaning) for r in found.collect()) == [("Ia", "I / J / K"), ("Ua", "A / B")]
    assert registers.reference_lines(found, 12).first().reference == "Ua=A / B\nIa=I / J / K"
    lines = ["| 序号 | 名称 | 含义 |", "|---|---|---|", "| 1 | Ua | A<br>phase > x |", "| | Ib | only two |", "| 2 | .skip | y |", "text"]
    got = registers.markdown_entries(spark.createDataFrame(list(enumerate(lines)), "ord int, line string")).collect()
    assert [(r.code, r.meaning) for r in got] == [("Ua", "A phase  x")]
