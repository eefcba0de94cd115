"""Files read by byte ranges against files read whole."""

import gzip
import io
import random

import pytest
from pyspark.sql import functions as F

from veldspar.sources import files, ranges
from veldspar.sources.text import decode_log


def _whole(path):
    data = path.read_bytes()
    text = decode_log(gzip.decompress(data) if path.name.lower().endswith(".gz") else data).split("\n")
    return [t.removesuffix("\r") for t in (text[:-1] if not text[-1] else text)]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 1000])
def test_every_line_has_one_owner(monkeypatch, size):
    rng = random.Random(size)
    for chunk in (1, 5, 4096):
        monkeypatch.setattr(ranges, "CHUNK_BYTES", chunk)
        for _ in range(30):
            data = bytes(rng.choice(b"ab\n\r") for _ in range(rng.randint(0, 60)))
            parts = [b"".join(ranges.owned(io.BytesIO(data), a, min(a + size, len(data)))) for a in range(0, len(data), size)]
            assert b"".join(parts) == data
            lines = [raw for k, a in enumerate(range(0, len(data), size)) for b in ranges._lines(0, a, ranges.owned(io.BytesIO(data), a, min(a + size, len(data)))) for raw in b.column(3).to_pylist()]
            split = data.split(b"\n")
            assert lines == [x.removesuffix(b"\r") for x in (split[:-1] if not split[-1] else split)]
            counted = [ranges._counted(0, "", a, ranges.owned(io.BytesIO(data), a, min(a + size, len(data)))).column(3)[0].as_py() for a in range(0, len(data), size)]
            assert sum(counted) == len(lines)


def test_log_folder_by_ranges(spark, tmp_path, monkeypatch):
    rng = random.Random(1)
    line = lambda k: " ".join(rng.choice(["中文", "plain", "é", "x" * 50]) for _ in range(k)) + rng.choice(["\n", "\r\n"])
    (tmp_path / "a.log").write_bytes("".join(line(rng.randint(0, 9)) for _ in range(400)).encode())
    (tmp_path / "b.LOG").write_bytes("".join(line(rng.randint(0, 9)) for _ in range(300)).replace("é", "e").encode("gb18030"))
    (tmp_path / "c.log").write_bytes(b"caf\xe9 \xff\nplain\r\n\n\xc4")
    (tmp_path / "d.log.GZ").write_bytes(gzip.compress("".join(line(3) for _ in range(200)).encode()) + gzip.compress("tail �".encode()))
    (tmp_path / "empty.log").write_bytes(b"")
    (tmp_path / "note.txt").write_bytes(b"no log")
    (tmp_path / "below.log").mkdir()
    want = [(k, n, t) for k, p in enumerate(sorted(p for p in tmp_path.iterdir() if p.is_file() and p.suffix != ".txt")) for n, t in enumerate(_whole(p))]
    for size in (701, 1 << 20):
        rows = files.log_lines(spark, str(tmp_path), size)
        assert sorted((r.file_ord, r.line_no, r.line) for r in rows.collect()) == want
    assert {r.path.rpartition("/")[2] for r in rows.select("path").distinct().collect()} == {"a.log", "b.LOG", "c.log", "d.log.GZ"}
    monkeypatch.setattr(files, "MOST_BROADCAST", 0)  # lines meet their range in a shuffle
    assert sorted((r.file_ord, r.line_no, r.line) for r in files.log_lines(spark, str(tmp_path), 5000).collect()) == want
    (tmp_path / "broken.gz").write_bytes(b"no gzip")
    with pytest.raises(Exception, match="broken.gz"):
        files.log_lines(spark, str(tmp_path)).collect()


def test_names_of_all_kinds(spark, tmp_path):
    folder = tmp_path / "a b%20c"
    folder.mkdir()
    for name in ("x y.log", "电压#1.log", "50%.log"):
        (folder / name).write_text(f"{name}\n")
    for path in (str(folder), f"file://{folder}"):
        assert {r.line for r in files.log_lines(spark, path).collect()} == {"x y.log", "电压#1.log", "50%.log"}


def test_one_large_file_is_many_tasks(spark, tmp_path):
    """200 MB in ranges of 8 MB: every line in its place, no task with more than its range."""
    piece = "".join(f"2026-07-20 16:50:00.001 [INFO][exec-{k % 8}][com.app.Worker:{k}] message {k}\n" for k in range(10_000)).encode()
    with open(tmp_path / "one.log", "wb") as f:
        for _ in range(200_000_000 // len(piece)):
            f.write(piece)
    copies = 200_000_000 // len(piece)
    rows = files.log_lines(spark, str(tmp_path), 8 << 20)
    assert rows.select("line").rdd.getNumPartitions() >= 20
    own = F.regexp_extract("line", "message ([0-9]+)$", 1).cast("long")
    got = rows.agg(F.count(F.lit(1)).alias("n"), F.max("line_no").alias("last"), F.count_if(own != F.col("line_no") % 10_000).alias("wrong"), F.count_distinct("line_no").alias("places")).first()
    assert tuple(got) == (copies * 10_000, copies * 10_000 - 1, 0, copies * 10_000)


def test_blocks(spark, tmp_path):
    data = bytes(range(256)) * 40
    (tmp_path / "a.csv").write_bytes(data)
    (tmp_path / "b.csv.gz").write_bytes(gzip.compress(data[:5000]))
    spark.dataSource.register(ranges.FileRanges)
    got = spark.read.format("file_ranges").options(mode="blocks", suffixes=".csv,.gz", bytes=3000, block_bytes=700).load(str(tmp_path)).orderBy("file_ord", "block").collect()
    for k, want in ((0, data), (1, data[:5000])):
        mine = [r for r in got if r.file_ord == k]
        assert [r.block for r in mine] == list(range(len(mine))) and b"".join(r.data for r in mine) == want and all(len(r.data) == 700 for r in mine[:-1])
