"""Rules and secrets as tables against a pass over each."""

import random

from pyspark.sql import functions as F

from veldspar.functions import logs as fn
from veldspar.operators import logs, needles


def test_categories_by_table_equal_the_expression(spark):
    rng = random.Random(2)
    marks = [t for _, _, texts in fn.RULES for t in texts] + ["Clear leak clients end: 0", "Clear leak clients end: 7", "plain", ""]
    pick = lambda: " ".join(rng.choice(marks) for _ in range(rng.randint(0, 2)))
    rows = spark.createDataFrame([(k, pick(), pick()) for k in range(600)], "k int, class string, message string").repartition(3)
    got = logs.categorised_by_table(rows, logs.rules(spark)).select("k", "category", fn.category(F.col("class"), F.col("message")).alias("want")).collect()
    assert len(got) == 600 and all(r.category == r.want for r in got) and len({r.want for r in got}) > 10
    table = spark.createDataFrame([(5, "message", "b", "late"), (1, "message", "abc", "early"), (5, "message", "zz", "late"), (2, "class", "b", "middle")], "ord bigint, place string, needle string, category string")
    some = spark.createDataFrame([("x", "abcd"), ("b", "b"), ("x", "zz"), (None, None), ("x", "x")], "class string, message string").coalesce(1)
    assert [r.category for r in needles.categorised(some, table, {"message": F.col("message"), "class": F.col("class")}, "none").collect()] == ["early", "middle", "late", "none", "none"]


def test_ten_thousand_secrets(spark):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("ab中") for _ in range(n))
    secrets = [word(rng.randint(1, 3)) if k < 4 else word(rng.randint(6, 12)) for k in range(10_000)] + ["", None]
    rng.shuffle(secrets)
    texts = [word(rng.randint(0, 60)) + rng.choice(secrets[:50] or [""]).__str__() for _ in range(60)] + ["", None]
    table = spark.createDataFrame([(k, s, "clash") for k, s in enumerate(secrets)], "ord bigint, needle string, text string")
    frame = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "k int, text string, ord string").repartition(3)

    def naive(text):
        free, marks = [True] * len(text), {}
        for s in secrets:
            at = text.find(s) if s else -1
            while at >= 0:
                if all(free[at : at + len(s)]):
                    free[at : at + len(s)] = [False] * len(s)
                    marks[at] = at + len(s)
                at = text.find(s, at + 1)
        out, at = "", 0
        while at < len(text):
            out, at = (out + needles.MARK, marks[at]) if at in marks else (out + text[at], at + 1)
        return out

    got = {r.k: r.text for r in needles.redacted(frame, "text", table).collect()}
    assert got == {k: None if t is None else naive(t) for k, t in enumerate(texts)}
    assert [r.text for r in needles.redacted(frame.where("k = 1"), "text", table.limit(0)).collect()] == [texts[1]]
    found = needles.found(frame, F.col("text"), table).collect()
    assert all(r.found == sorted(k for k, s in enumerate(secrets) if s and r.text and s in r.text) for r in found)
