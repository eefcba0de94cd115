"""Delimited text in blocks against Python's csv, and delimiters against the rule for one text."""

import csv
import gzip
import io
import random

import pytest
from pyspark.sql import functions as F

from veldspar.operators import delimited, order
from veldspar.scratch import Scratch
from veldspar.sources import files, text


def _rows(data, delimiter=","):
    csv.field_size_limit(1 << 30)
    return [r for r in csv.reader(io.StringIO(data, newline=""), delimiter=delimiter) if r]


def _noise(rng, n):
    return "".join(rng.choice('""",,;\n\r a中') for _ in range(n))


def _table(rng, n):
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=rng.choice(["\n", "\r\n"]))
    for _ in range(n):
        writer.writerow(["".join(rng.choice('a"b,\n\r é') for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 5))])
    return out.getvalue()


def test_states_of_a_block(monkeypatch):
    rng = random.Random(0)
    for run in (1, 3, 512):
        monkeypatch.setattr(delimited, "RUN", run)
        for _ in range(200):
            data = _noise(rng, rng.randint(0, 40)).encode()
            for start in range(4):
                state, ends = start, []
                for k, c in enumerate(data):
                    kind = delimited.QUOTE if c == 0x22 else delimited.DELIMITER if c == 0x2C else delimited.NEWLINE if c in (10, 13) else delimited.OTHER
                    if kind == delimited.NEWLINE and state != delimited.QUOTED:
                        ends.append(k + 1)
                    state = int(delimited.NEXT[state][kind])
                assert delimited.ways(data, ",")[start] == state
                assert delimited.record_ends(data, ",", start).tolist() == ends


@pytest.mark.parametrize("size", [3, 50])
def test_records_of_blocks_equal_csv(spark, size):
    rng = random.Random(size)
    texts = ["", "\n\n", "a", '"', '"open\nquote, ', "﻿\"x\"\"y\",1\r\n2", 'a"b,c""d\n"e"f,g\n', *(_noise(rng, rng.randint(0, 90)) for _ in range(25)), *(_table(rng, rng.randint(1, 15)) for _ in range(15)), '"' + "long\n" * 60 + '",1\n2']
    blocks = []
    for k, t in enumerate(texts):
        data = t.encode()
        blocks += [(k, b, data[at : at + size], "clash") for b, at in enumerate(range(0, max(len(data), 1), size))]
    frame = spark.createDataFrame(blocks, "doc int, block long, data binary, nth string").repartition(3)
    got = {}
    for r in delimited.records(frame, ["doc"]).collect():
        got.setdefault(r.doc, {})[r.row_ord] = r.fields
    for k, t in enumerate(texts):
        want = _rows(t.removeprefix("﻿"))
        assert got.get(k, {}) == dict(enumerate(want)), t


def test_scan_of_many_places(spark):
    rng = random.Random(6)
    rows, want = [], set()
    for key, n in (("a", 1), ("b", 30), (None, 3)):
        way = 0
        for place in range(n):
            out = [rng.randrange(3) for _ in range(3)]
            rows.append((key or "c", place, out))
            want.add((key or "c", place, way))
            way = out[way]
    maps = spark.createDataFrame(rows, "key string, place long, out array<int>")
    for fan in (2, 5, 256):
        assert {tuple(r) for r in order.entered(maps, ["key"], Scratch(spark, "test-scan"), fan).collect()} == want
    assert order.entered(maps.limit(0), ["key"], Scratch(spark, "test-scan")).collect() == []


def test_one_file_in_many_tasks(spark, tmp_path, monkeypatch):
    rng = random.Random(9)
    one, two = "﻿" + _table(rng, 3000), _table(rng, 30).replace(",", ";") + "x;y\n" * 40
    (tmp_path / "one.csv").write_bytes(one.encode())
    (tmp_path / "two.CSV").write_bytes(two.encode())
    (tmp_path / "three.csv.gz").write_bytes(gzip.compress(b'a,"b\nc"\n1,2\n'))
    (tmp_path / "note.txt").write_text("a,b")
    for most in (100_000, 0):
        monkeypatch.setattr(delimited, "MOST_BROADCAST", most)
        got = {}
        for r in files.delimited(spark, str(tmp_path), block_bytes=1000, range_bytes=8000).collect():
            got.setdefault(r.path.rpartition("/")[2], {})[r.row_ord] = r.fields
        sign = text.sniff_delimiter(two[:900])
        assert got == {"one.csv": dict(enumerate(_rows(one[1:]))), "two.CSV": dict(enumerate(_rows(two, sign))), "three.csv.gz": {0: ["a", "b\nc"], 1: ["1", "2"]}}
    (tmp_path / "bad.csv").write_bytes(b"a,b\n\xff\xfe,c\n1,2\n")
    with pytest.raises(Exception, match="not UTF-8"):
        files.delimited(spark, str(tmp_path), block_bytes=1000).collect()


def test_delimiters_equal_the_rule_for_one_text(spark):
    rng = random.Random(4)
    texts = ["", None, "a", "\n", '"a,b"|c\n"d,e"|f\n', "1,5;2;3\n4;5;6\n", "a\tb\n1\t2\n", ' ,\n"x"\n', *("".join(rng.choice('ab",;\t|\n  ') for _ in range(rng.randint(1, 80))) for _ in range(120)), *(_table(rng, 90).replace(",", rng.choice(",;|\t")) for _ in range(6))]
    frame = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc int, text string, n string").repartition(4)
    got = {r.doc: r.delimiter for r in delimited.sniffed(frame, ["doc"]).collect()}
    assert got == {k: text.sniff_delimiter(t or "") for k, t in enumerate(texts)}
    blocks = delimited.blocks_of(frame, ["doc"], chars=7).join(delimited.sniffed(frame, ["doc"]), "doc")
    rows = delimited.records(blocks, ["doc"], None).groupBy("doc").agg(F.count(F.lit(1)).alias("n")).collect()
    assert {r.doc: r.n for r in rows} == {k: n for k, t in enumerate(texts) if (n := len(_rows(t or "", got[k])))}


def test_many_blocks_are_followed_side_by_side(monkeypatch):
    rng = random.Random(11)
    for run in (1, 3, 512):
        monkeypatch.setattr(delimited, "RUN", run)
        blocks = [_noise(rng, rng.randint(0, 60)).encode() for _ in range(80)] + [b"", b'"' * 1500 + b"\n"]
        signs = [rng.choice(",;|") for _ in blocks]
        entered = [rng.randrange(4) for _ in blocks]
        found = delimited.all_ways(blocks, signs)
        ends = delimited.all_ends(blocks, signs, entered)
        for k, (data, sign, start) in enumerate(zip(blocks, signs, entered, strict=True)):
            assert (found[:, k] & 3).tolist() == delimited.ways(data, sign)
            assert ends[k].tolist() == delimited.record_ends(data, sign, start).tolist()
            assert (found[:, k] >= delimited.ENDED).tolist() == [len(delimited.record_ends(data, sign, s)) > 0 for s in range(4)]


def test_records_of_small_blocks_are_followed_in_few_calls(monkeypatch):
    blocks, calls = [b"a,b\n" * 20] * 2000, []
    runs = delimited._runs
    monkeypatch.setattr(delimited, "_runs", lambda kinds: calls.append(kinds.shape) or runs(kinds))
    delimited.all_ends(blocks, [","] * 2000, [0] * 2000)
    assert calls == [(delimited.RUN, 2000)]
    assert [p.stop - p.start for p in delimited._parts([b"x" * delimited.TOGETHER, b"", b"y"])] == [3] and list(delimited._parts([])) == []
