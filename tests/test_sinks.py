"""Files written all together or not at all."""

import csv

import pytest
from pyspark.sql import functions as F

from veldspar.functions.registers import COLUMNS
from veldspar.sources import sinks


def _merged(spark, docs, n=5):
    rows = [(d, k, "conflict" if k == 3 else "kept", [str(k), "1", f'na"me, {d}', *[""] * 9]) for d in docs for k in range(1, n + 1)]
    return spark.createDataFrame(rows, "doc_id long, ord long, status string, fields array<string>").repartition(3)


def _found(folder):
    return {p.name: list(csv.reader(p.read_text(encoding="utf-8").splitlines())) for p in sorted(folder.iterdir())}


def test_files_of_documents(spark, tmp_path):
    stems = spark.createDataFrame([(1, "same"), (2, "same"), (3, 'b<a>d:"'), (9, "no such")], "doc_id long, stem string")
    merged = _merged(spark, [1, 2, 3, 4])
    for run in (1, 2):
        sinks.write_register_files(merged, stems, str(tmp_path / "out"), "20260102_030405")
        got = _found(tmp_path / "out")
        assert len(got) == 4 * run
        names = sorted(n.rpartition("_")[0] for n in got)
        assert names == sorted(["bad_20260102_030405", "output_20260102_030405", "same_20260102_030405", "same_20260102_030405"] * run)
    for rows in got.values():
        assert rows[0] == ["﻿id", *COLUMNS[1:]] and [r[0] for r in rows[1:]] == ["1", "2", "4", "5"]
    assert sorted({rows[1][2] for rows in got.values()}) == [f'na"me, {d}' for d in (1, 2, 3, 4)]


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    merged = _merged(spark, range(20), 50)
    bad = merged.withColumn("fields", F.when((F.col("doc_id") == 7) & (F.col("ord") == 49), F.raise_error(F.lit("broken record")).cast("array<string>")).otherwise(F.col("fields")))
    stems = spark.createDataFrame([], "doc_id long, stem string")
    with pytest.raises(Exception, match="broken record"):
        sinks.write_register_files(bad, stems, str(tmp_path / "out"), "s")
    assert not list((tmp_path / "out").rglob("*")) if (tmp_path / "out").exists() else True
    sinks.write_register_files(merged, stems, str(tmp_path / "out"), "s")
    assert len(_found(tmp_path / "out")) == 20
    sinks.write_register_files(merged.limit(0), stems, str(tmp_path / "out"), "s")
    assert len(_found(tmp_path / "out")) == 20


def test_names_are_never_taken_twice(spark, tmp_path, monkeypatch):
    from veldspar.sources import named_files

    writer = named_files.NamedFilesWriter({"path": str(tmp_path / "out"), "stamp": "s"})
    task = writer.write(iter([spark.createDataFrame([(d, "x", "line")], named_files.SCHEMA).first() for d in "ab"]))

    class Fixed:
        hex = "abcdef0123"

    monkeypatch.setattr(named_files.uuid, "uuid4", lambda: Fixed)
    with pytest.raises(FileExistsError):
        writer.commit([task, None])
    assert [p.name for p in (tmp_path / "out").glob("*.csv")] == ["x_s_abcdef.csv"]
    with pytest.raises(ValueError, match="never overwritten"):
        named_files.NamedFiles({"path": "x", "stamp": "s"}).writer(None, True)
