"""Encodings found by byte pairs, on texts whose encoding is known."""

import random

import numpy as np
from pyspark.sql import functions as F

from veldspar.sources import encodings, files

#: Words to invent texts from.
LATIN = "straße über können für señor mañana niño corazón été français où voilà garçon élève cœur the and of which between house water".split()
CHINESE = "电压 电流 有功功率 设备 登录 信息 错误 参数 缺失 网关 协议 转换 规则 调度 禁用 连接 泄漏 统计 报文 校验".split()


def _texts(rng, n):
    return [(" " if k % 2 else "").join(rng.choice(LATIN if k % 2 else CHINESE) for _ in range(rng.randint(8, 80))) for k in range(n)]


def test_labelled_texts_of_six_encodings(spark):
    rng = random.Random(3)
    model = encodings.train(spark.createDataFrame([(t,) for t in [*_texts(rng, 300), "", None]], "text string"))
    rows = []
    for t in _texts(rng, 400):
        fits = [e for e in encodings.CANDIDATES if t.encode(e, "ignore").decode(e) == t]
        rows.append((len(rows), t, rng.choice(fits)))
    assert len({e for *_, e in rows}) >= 6
    frame = encodings.encoded(spark.createDataFrame(rows, "k int, text string, encoding string"))
    found = encodings.detect(encodings.blocks_of(frame, ["k"], size=50).repartition(5), ["k"], model)
    got = {r.k: r.text for r in encodings.decoded(frame.drop("text", "encoding").join(found, "k")).collect()}
    right = sum(got[k] == t for k, t, _ in rows)
    assert len(got) == len(rows) and right >= 0.95 * len(rows), right


def test_scores_add_up_and_odd_input(spark):
    table = np.log(np.full((2, encodings.PAIRS), 0.25))
    table[1, [(97 << 8) + 98, encodings.PAIRS // 2 + (97 << 8) + 98]] = 0.0
    model = encodings.Model(("one", "two"), table)
    assert model.scores(b"").tolist() == [0, 0] and np.allclose(model.scores(b"abab"), [3 * np.log(0.25), np.log(0.25)])
    frame = spark.createDataFrame([("a", b"ab"), ("a", b"xx"), ("b", b"xx"), ("c", b""), ("d", None)], "k string, data binary")
    assert {r.k: r.encoding for r in encodings.detect(frame, ["k"], model).collect()} == {"a": "two", "b": "one", "c": "one", "d": "one"}
    blocks = encodings.blocks_of(frame, ["k"], size=1).where("k <> 'd'").collect()
    assert sorted((r.k, r.block, bytes(r.data)) for r in blocks if r.k != "a") == [("b", 0, b"x"), ("b", 1, b"x"), ("c", 0, b"")]
    assert encodings.detect(frame.limit(0), ["k"], model).collect() == []


def test_logs_in_an_encoding_that_is_neither(spark, tmp_path):
    rng = random.Random(4)
    model = encodings.train(spark.createDataFrame([(t,) for t in _texts(rng, 300)], "text string"))
    lines = [t for t in _texts(rng, 80) if t.isascii() or t[0] in "".join(LATIN)][:30]
    lines = [x for x in lines if x.encode("cp850", "ignore").decode("cp850") == x]
    (tmp_path / "a.log").write_bytes("\r\n".join(lines).encode("cp850"))
    (tmp_path / "b.log").write_bytes("电压 ok\n".encode())
    got = files.log_lines(spark, str(tmp_path), 1 << 12, model).orderBy("file_ord", "line_no").collect()
    assert [r.line for r in got] == [*lines, "电压 ok"]
    assert files.log_lines(spark, str(tmp_path)).where(F.col("file_ord") == 0).first().line != lines[0] or lines[0].isascii()


def test_a_lone_letter_is_read_as_its_line_suggests(spark):
    german, french = ["der erst Äen schen", "Äen pfen der sch"], ["le beau Çen voi", "Çen que le elle", "Éa le que", "le fête que"]
    rows = [(t, g) for g, lines in (("de", german), ("fr", french)) for t in lines for _ in range(20)] + [("the thing is\nof an other", None)] * 9
    model = encodings.train(spark.createDataFrame(rows, "text string, lang string"), encodings=("cp1252", "cp850", "mac_roman"), group_col="lang")
    texts = ["the thing\npfen Äen sch", "of an other\nque Çen elle\nthe thing", "Éa que"]
    for e, ks in (("cp850", (0, 1, 2)), ("mac_roman", (0, 1))):
        frame = encodings.encoded(spark.createDataFrame([(k, texts[k], e) for k in ks], "k int, text string, encoding string"))
        found = encodings.detect(encodings.blocks_of(frame, ["k"]), ["k"], model)
        assert {r.k: r.encoding for r in found.collect()} == dict.fromkeys(ks, e)


def test_a_capital_follows_a_full_stop_and_a_word_counts_once(spark):
    french, german = ["le beau éen voi. Que le", "que élle. Le fête", "Èen le. Que éa", "voi. Èen que"], ["der erst pfen. Äau der", "Äau schen der"]
    rows = [(t, g) for g, lines in (("de", german), ("fr", french)) for t in lines for _ in range(20)]
    model = encodings.train(spark.createDataFrame(rows, "text string, lang string"), encodings=("cp1252", "cp850", "mac_roman"), group_col="lang")
    texts = [("que le voi. Èonen le", "mac_roman"), ("Äau " * 40 + "der pfen", "cp850"), ("que éonen le", "cp1252"), ("Äau\n" + "erst Äau\n" * 40, "cp850")]
    frame = encodings.encoded(spark.createDataFrame([(k, *t) for k, t in enumerate(texts)], "k int, text string, encoding string"))
    found = {r.k: r.encoding for r in encodings.detect(encodings.blocks_of(frame, ["k"]), ["k"], model).collect()}
    assert found == {k: e for k, (_, e) in enumerate(texts)}
    assert encodings.Model(model.encodings, model.table, model.shares).scores(b"  ").tolist() == [0, 0, 0]


def test_all_texts_are_learnt(spark):
    """Of 40 000 texts of two kinds none is left out, so neither kind's pair is unseen and both weigh the same."""
    rows = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, "aa").otherwise("ab").alias("text"))
    odds = np.exp(encodings.train(rows, encodings=("cp1252",)).table[0, [(97 << 8) + 97, (97 << 8) + 98]])
    assert np.allclose(odds, 0.5, atol=1e-4)
