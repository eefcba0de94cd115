"""File sources, office documents, chunks, the model hook and streams."""

import gzip
import io
import random
import zipfile

import pytest

from veldspar.operators import chunks, logs, model_hook
from veldspar.sources import files, office, text


def _zip(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name.replace("__", "/").replace("_DOT_", "."), body)
    return out.getvalue()


def test_log_folder(spark, tmp_path):
    (tmp_path / "a.log").write_bytes("2026-07-20 16:50:00.001 [INFO][t][c:1] 中文\r\n\tat x\n".encode("gb18030"))
    (tmp_path / "b.LOG.GZ").write_bytes(gzip.compress("2026-07-20 16:50:00.002 [INFO][t][c:1] b".encode()))
    (tmp_path / "c.txt").write_text("no")
    rows = files.log_lines(spark, str(tmp_path))
    got = logs.entries(rows).orderBy("file_ord").collect()
    assert [(r.file_ord, r.message, r.has_stack) for r in got] == [(0, "中文", True), (1, "b", False)]


def test_delimiters():
    assert text.sniff_delimiter("a,b\n1,2\n") == ","
    assert text.sniff_delimiter("a;b;c\n1,5;2;3\n4;5;6\n") == ";"
    assert text.sniff_delimiter("a\tb\n1\t2\n") == "\t"
    assert text.sniff_delimiter('"a,b"|c\n"d,e"|f\n') == "|"
    assert text.sniff_delimiter("") == ","
    assert text.quote_marks('"a""b",c"d,"e"x\n', ",") == (2, 2, 2)
    assert text.decode_csv("é".encode("utf-16")) == "é" and text.decode_csv("电压,1".encode("gb18030")) == "电压,1"
    with pytest.raises(text.ParseFailed):
        text.decode_csv(b"\xef\xbb\xbf\xff")


def test_documents(spark, tmp_path):
    word = "<w:document xmlns:w='w'><w:body><w:p><w:r><w:t>Head</w:t><w:tab/><w:t>line</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:t>a</w:t></w:p><w:p><w:t>b</w:t></w:p></w:tc><w:tc><w:p><w:t>c</w:t></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl><w:p/><w:p><w:t>Tail &amp; end</w:t></w:p></w:body></w:document>"
    (tmp_path / "w.docx").write_bytes(_zip(word__document_DOT_xml=word))
    sheet = "<worksheet xmlns='s'><sheetData><row r='2'><c r='B2' t='s'><v>0</v></c><c r='D2'><v>2.0</v></c></row><row r='4'><c r='B4' s='1'><v>45000.5</v></c><c r='C4' t='b'><v>1</v></c><c r='D4' s='2'><v>1.25</v></c><c r='E4'><v>0.1</v></c></row></sheetData></worksheet>"
    book = "<workbook xmlns='s' xmlns:r='r'><sheets><sheet name='One' r:id='x1'/></sheets></workbook>"
    parts = {
        "xl__workbook_DOT_xml": book, "xl___rels__workbook_DOT_xml_DOT_rels": "<Relationships><Relationship Id='x1' Target='worksheets/s.xml'/></Relationships>", "xl__worksheets__s_DOT_xml": sheet,
        "xl__sharedStrings_DOT_xml": "<sst xmlns='s'><si><t>na</t><r><t>me</t></r></si></sst>", "xl__styles_DOT_xml": "<styleSheet xmlns='s'><cellXfs><xf numFmtId='0'/><xf numFmtId='22'/><xf numFmtId='46'/></cellXfs></styleSheet>",
    }
    (tmp_path / "x.xlsx").write_bytes(_zip(**parts))
    (tmp_path / "t.csv").write_text("﻿a;b\n\n1; 2 ;\n", encoding="utf-8")
    for name, data in (("bad.docx", b"x"), ("old.doc", b"x"), ("n.bin", b"x"), ("blank.csv", b" ;\n")):
        (tmp_path / name).write_bytes(data)
    got = {r.path.rpartition("/")[2]: (r.status, r.text) for r in files.documents(spark, str(tmp_path)).collect()}
    assert got["w.docx"] == ("ok", "Head\tline\na\nb\tc\nTail & end")
    assert got["x.xlsx"] == ("ok", "=== Sheet: One ===\nname\t\t2\n\n2023-03-15 12:00:00\tTRUE\t1 day, 6:00:00\t0.1")
    assert got["t.csv"] == ("ok", "=== CSV ===\na\tb\n1\t2")
    assert {k: v[0] for k, v in got.items() if v[1] is None} == {"bad.docx": "parse_failed", "old.doc": "legacy_doc_unsupported", "n.bin": "unsupported_format", "blank.csv": "no_extractable_text"}
    assert office.excel_datetime(0.5) == "12:00:00" and office.excel_datetime(1) == "1900-01-01 00:00:00" and office.excel_duration(2.0000115741) == "2 days, 0:00:01"


def test_catalogues(spark, tmp_path):
    (tmp_path / "c.csv").write_bytes("﻿x,ParamName,ParamCode\n1,电压,Ua\n2,,Ub\n3,U,Ua\n".encode())
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    (tmp_path / "m.md").write_text("| 1 | Ia | current |\n")
    found = files.naming_catalog(spark, str(tmp_path / "c.csv"), str(tmp_path / "m.md"))
    assert [(r.code, r.meaning) for r in found.collect()] == [("Ua", "电压 / U")]
    assert [r.code for r in files.naming_catalog(spark, str(tmp_path / "bad.csv"), str(tmp_path / "m.md")).collect()] == ["Ia"]
    names = ["app.log", "app.2.log", "app.10.log", "app.log.gz", "app.3.log.gz"]
    got = files.natural_order(spark.createDataFrame([(n,) for n in names], "name string")).collect()
    assert [r.name for r in got][-2:] == ["app.log.gz", "app.3.log.gz"] and [r.name for r in got].index("app.10.log") < [r.name for r in got].index("app.2.log")


def test_chunks(spark):
    assert chunks.split("", 10) == [] == chunks.split("x", 0)
    assert chunks.split("ab\n\ncd\nef\n", 8) == ["ab\n\n", "cd\nef\n"]
    body = "=== Sheet: S ===\nCH1-CH4 Registers\n" + "row of data\n" * 5
    got = chunks.split(body, 70)
    assert got[1].startswith("=== Sheet: S ===\nCH1-CH4 Registers\nrow") and max(map(len, got)) <= 70
    rng = random.Random(1)
    for _ in range(50):
        t = "".join(rng.choice(["a", "bb ", "\n", "\r\n", "\n\n", "=== CSV ===\n", "CH1-4\n"]) for _ in range(60))
        for size in (5, 17, 40):
            parts = chunks.split(t, size)
            assert all(0 < len(p) <= size for p in parts)
    plain = "".join(rng.choice(["abc ", "\n"]) for _ in range(300))
    assert "".join(chunks.split(plain, 50)) == plain
    frame = spark.createDataFrame([(1, plain), (2, None), (3, "x" * 9000)], "doc_id int, text string")
    rows = chunks.chunk(frame, 50, 7).where("doc_id = 1").orderBy("index").collect()
    assert [r.prior_context for r in rows] == [None, *(r.text[-7:] for r in rows[:-1])]
    halves = chunks.bisected(chunks.chunk(frame)).where("doc_id = 3").orderBy("index").collect()
    assert [(len(r.text), r.too_small) for r in halves] == [(4500, False), (4500, False)]
    with pytest.raises(chunks.ContextTooLarge):
        chunks.bisect_text("x" * 8000)


def test_model_hook(spark):
    calls = []

    def model(prompt):
        calls.append(len(prompt))
        if len(prompt) > 5000:
            raise model_hook.ModelError(400, "Maximum context length is 5000")
        if len(calls) == 3:
            raise model_hook.ModelError(503)
        return " ok "

    assert model_hook.answers(model, "line\n" * 1900, lambda c, p: c) == ["ok", "ok"]
    assert calls[0] == 9500 and len(calls) == 4
    with pytest.raises(model_hook.ModelError):
        model_hook.answers(lambda p: (_ for _ in ()).throw(model_hook.ModelError(401)), "x", lambda c, p: c)
    assert model_hook.diagnose_empty("x", "length", None, None, 10) == "reasoning_exhausted"
    assert model_hook.diagnose_empty("", None, 10, None, 10) == "output_exhausted"
    got = model_hook.extract(spark.createDataFrame([(1, "a"), (2, None)], "doc_id int, text string"), str.upper, lambda c, p: c).collect()
    assert [(r.doc_id, r.csv, r.error) for r in got] == [(1, "A", None)]


def test_stream_equals_batch(spark, tmp_path):
    from veldspar.streaming import logs as stream

    lines = [f"2026-07-20 16:{m:02d}:00.000 [INFO][t{m % 2}][c:1] {'[DISPATCH-START]' if m % 4 < 2 else f'[DISPATCH-END] cost={m}000ms'}" for m in range(40)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("\n".join(lines) + "\n\tat x\n")
    rows = stream.entries(stream.lines(spark, str(tmp_path / "in")))
    for name, frame, mode in (("counts", stream.bucket_counts(rows), "complete"), ("stuck", stream.stuck_threads(rows), "append")):
        query = frame.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        query.processAllAvailable()
        query.stop()
    batch = logs.entries(spark.createDataFrame([(0, k, t) for k, t in enumerate(lines)], "file_ord int, line_no long, line string"))
    assert sorted(map(tuple, spark.table("stuck").collect())) == sorted(map(tuple, logs.stuck_threads(batch).collect()))
    assert sum(r.entries for r in spark.table("counts").collect()) == 40
