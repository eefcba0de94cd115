"""Spelling variants, license notices and hard negatives against brute force, and on odd tables."""

import collections
import os
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pytest

pytest.importorskip("veldspar.llm")

from pyspark.sql import functions as F  # noqa: E402

from veldspar.llm import licenses, negatives, queries, spelling  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("id", "word", "n", "key", "label", "row", "block", "bucket", "form", "spans", "labels")


def _stored(spark, path, rows, schema, clashes=CLASHES):
    frame = spark.createDataFrame(rows, schema)
    for clash in set(clashes) - set(frame.columns):
        frame = frame.withColumn(clash, F.lit("clash"))
    frame.repartition(5).write.parquet(str(path))
    return spark.read.parquet(str(path))


def _lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        before, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, before + (x != y))
    return row[-1]


# Spelling


def _variants(counts, ratio=5):
    out = {}
    for w, n in counts.items():
        near = [(-m, v) for v, m in counts.items() if v != w and abs(len(v) - len(w)) <= 1 and _distance(v, w) == 1]
        m, form = min(near, default=(0, None))
        form = form if near and -m >= ratio * n else None
        out[w] = [form, None, n, len(near), -m if form else None]
    for w, row in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        row[1] = root
    return {w: tuple(r) for w, r in out.items()}


def _spelt(rows):
    n = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = _lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def test_spelling_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(3)
    base = ["".join(rng.choice("abé") for _ in range(rng.randint(5, 8))) for _ in range(60)]
    rows = []
    for i in range(300):
        words = [rng.choice(base[: rng.randint(1, 60)]) for _ in range(60)]
        words = [w.upper() if rng.random() < 0.1 and w.isascii() else w.replace("é", "É") if rng.random() < 0.05 else w for w in words]
        rows.append((i * 13 % 997, rng.choice([" ", "-", "1", "×", "你"]).join(words)))
    rows += [(None, "letters " * 5), (5000, None), (5001, ""), (5002, "q" * 400 + " ")] + [(6000, "repeated")] * 7
    docs = [(i, t, None, None, 0) for i, t in rows]
    _stored(spark, tmp_path / "documents.parquet", docs, DOCS)
    got = queries.op11_spelling(spark, str(tmp_path))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = _variants(_spelt(rows))
    assert len(want) > 40 and any(r[0] for r in want.values()) and "letters" in want and "repeated" in want
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got.collect()} == want


def test_spelling_chains_ties_and_hot_words(spark):
    # a chain of forms, a tie of largest n, words of one letter repeated, and words that share a key but are two edits apart
    counts = {"aaaaaaa": 1, "aaaaaaab": 5, "aaaaaabb": 25, "aaaaabbb": 200, "xbcdef": 50, "ybcdef": 50, "zbcdef": 10, "abcdefg": 9, "bacdefg": 9, "bcdefg": 1, "": 3, "k": 20, "m": 20, None: 4, "null n": None}
    got = {r.word: tuple(r)[1:] for r in spelling.variants(spark.createDataFrame([(w, n, "clash") for w, n in counts.items()], "word string, n bigint, id string")).collect()}
    known = {w: n for w, n in counts.items() if w is not None and n is not None}
    assert got == _variants(known) and got["aaaaaaa"][1] == "aaaaabbb" and got["zbcdef"][0] == "xbcdef" and got[""][0] == "k"
    assert spelling.variants(spark.createDataFrame([], "word string, n bigint")).collect() == []


def test_spelling_broadcasts_nothing(spark, monkeypatch):
    """Spark sizes keys by the file of the words, however many keys a word has; no join may send them to the driver."""
    plans, save = [], spelling.Scratch.save
    plan = lambda frame: frame._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(spelling.Scratch, "save", lambda self, frame, name: plans.append(plan(frame)) or save(self, frame, name))
    counts = {"aaaaaaa": 1, "aaaaaaab": 5, "aaaaaabb": 25, "aaaaabbb": 200}
    found = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n bigint"))
    plans.append(plan(found))
    assert sum(p.count("SortMergeJoin") for p in plans) >= 7 and "Broadcast" not in "".join(plans)
    assert {r.word: tuple(r)[1:] for r in found.collect()} == _variants(counts)


def test_spelling_of_long_words_takes_linear_time(spark):
    """Deletions of a long word are small rows, not copies of it."""
    rng = random.Random(8)
    long = "".join(rng.choice("abcdefgh") for _ in range(200_000))
    words = {long: 30, long[:70_000] + "x" + long[70_000:]: 5, long[:5] + "y" + long[6:]: 2, long[1:] + "a": 9, "a" * 100_000: 7, "a" * 100_001: 90}
    began = time.time()
    got = {r.word: (r.form, r.n_near) for r in spelling.variants(spark.createDataFrame(list(words.items()), "word string, n bigint")).collect()}
    assert time.time() - began < 60
    keys = list(words)
    assert [got[k] for k in keys] == [(None, 2), (long, 1), (long, 1), (None, 0), (keys[5], 1), (None, 1)]


# Licenses


def _notices(text, notices):
    """Runs of whole words within the errors, the best of those that overlap."""
    found = list(re.finditer("(?:[0-9A-Za-z]|[^\x00-\x7f])+", text or ""))
    words = [_lower(m[0]) for m in found]
    out = []
    for n in notices:
        spans = []
        for i in range(len(words)):
            for j in range(i, len(words)):
                run = " ".join(words[i : j + 1])
                if len(run) > len(n.phrase) + n.errors:
                    break
                if len(run) >= len(n.phrase) - n.errors and set(n.fixed) <= set(words[i : j + 1]) and (e := _distance(run, n.phrase)) <= n.errors:
                    spans.append((i, j, e))
        group = []
        for s in [*spans, (1 << 60, 0, 0)]:
            if group and s[0] > max(g[1] for g in group):
                e, i, j = min((e, i, j) for i, j, e in group)
                out.append((n.label, i, j - i + 1, found[i].start(), found[j].end(), text[found[i].start() : found[j].end()], e))
                group = []
            group.append(s)
    return sorted(out)


def _scanned(text):
    words = [_lower(w) for w in re.findall("(?:[0-9A-Za-z]|[^\x00-\x7f])+", text or "")]
    places = [(k, n.label) for n in licenses.BASE for k in range(len(words)) if words[k : k + len(n.phrase.split())] == n.phrase.split()]
    spans, base = _notices(text, licenses.NOTICES), sorted({label for _, label in places})
    share = lambda s: max(1 - s[6] / len(n.phrase) for n in licenses.NOTICES if n.label == s[0] and _distance(" ".join(_lower(w) for w in re.findall("(?:[0-9A-Za-z]|[^\x00-\x7f])+", s[5])), n.phrase) == s[6])
    at = [k for k, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(base), ",".join(sorted({*base, *(s[0] for s in spans)})), max([float(bool(places)), *map(share, spans)]), spans


@pytest.fixture(scope="module")
def noticed():
    rng = random.Random(12)
    texts = [None, "", " .,\n", "mit", "under the mit license", "x" * 3000, "Under The MIT\tlicense under the mit license cc by nc", "é under thé mit licence é", "under the\x80mit license", "cc by nc by nc cc-by-nc", "under the", "apache license version 3", "cc by nd"]
    for at in range(126):
        n = licenses.NOTICES[at % len(licenses.NOTICES)]
        phrase = list(n.phrase)
        for _ in range(rng.randint(0, n.errors + 2)):
            k, kind = rng.randrange(len(phrase)), rng.random()
            phrase[k : k + (kind < 0.7)] = rng.choice(["", "x", " ", "é", "t", "-"]) if kind < 0.7 else rng.choice(["q", " ", "ü", phrase[k]])
        fill = lambda: " ".join(rng.choice(["the", "mit", "under", "license", "версия", "by", "cc", "2", "gnu", "lorem,", "x\n"]) for _ in range(rng.randint(0, 12)))
        texts.append(f"{fill()} {''.join(phrase).title() if rng.random() < 0.3 else ''.join(phrase)}{rng.choice([' ', '.', ', '])}{fill()}")
    texts.append(" ".join(t for t in texts[:60] if t))
    return [(i % 90, t, None, None, 0) for i, t in enumerate(texts)]


def test_licenses_equal_brute_force(spark, tmp_path, noticed):
    docs = _stored(spark, tmp_path / "documents.parquet", noticed, DOCS)
    got = licenses.scan(docs).collect()
    key = lambda r: (r[0], str(r[1:]))
    plain = [(r.doc_id, *(r[c] for c in licenses.COLUMNS[:-2]), round(r.score, 12), sorted(tuple(s) for s in r.spans)) for r in got]
    want = [(i, *(s := _scanned(t))[:6], round(s[6], 12), s[7]) for i, t, *_ in noticed]
    assert sorted(plain, key=key) == sorted(want, key=key)
    assert sum(s[-1] > 0 for r in plain for s in r[-1]) > 20
    query = queries.op12_licenses(spark, str(tmp_path))
    assert query.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    assert sorted((tuple(r[:7]) for r in query.collect()), key=key) == sorted((r[:7] for r in want), key=key)


def test_licenses_fixed_words_and_empty_table(spark):
    rows = [(0, "apache license version 3"), (1, "Apache Licence, Version 2.0"), (2, "cc by nd"), (3, "c.c. by-nc"), (4, "under the bit license"), (5, "relased under the MTI license")]
    got = {r.doc_id: (r.base_labels, r.labels) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: ("", ""), 1: ("", "apache-2"), 2: ("", ""), 3: ("", "cc-by-nc"), 4: ("", ""), 5: ("", "")}
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_licenses_in_a_crowded_text_take_linear_time(spark):
    """A text of nothing but pieces of notices, and one run without a space."""
    rows = [(0, "license under the license " * 40_000), (1, "mitlicense" * 100_000), (2, "under the mit licence, " * 20_000)]
    began = time.time()
    got = {r.doc_id: (r.labels, len(r.spans)) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: ("", 0), 1: ("", 0), 2: ("mit", 20_000)} and time.time() - began < 60


# Hard negatives


def _negatives(rows, n_positives=5, n_negatives=5, window=(80, 100)):
    known = [(i, label, v, a) for i, label, v, a in rows if i is not None and label is not None and v is not None and None not in v]
    out = []
    for x, (i, label, v, a) in enumerate(known):
        if not a:
            continue
        scored = sorted(((-sum(p * q for p, q in zip(v, w, strict=False)), j, m == label) for y, (j, m, w, _) in enumerate(known) if y != x), key=lambda s: s[:2])
        for s, j, _ in [s for s in scored if s[2]][:n_positives]:
            fit = [(k, t) for t, k, same in scored if not same and window[0] * -s <= 100 * -t <= window[1] * -s]
            out += [(i, j, r + 1, k, -s, -t) for r, (k, t) in enumerate(fit[:n_negatives])]
    return sorted(out)


@pytest.mark.parametrize(("buckets", "block_rows", "anchor_rows", "chunk"), [(1, 16, 4, 3), (4, 7, 2, 2), (64, 4096, 256, 32)])
def test_hard_negatives_equal_brute_force(spark, tmp_path, buckets, block_rows, anchor_rows, chunk):
    rng = random.Random(4)
    rows = [(i, rng.choice([0, 0, 0, 1, 2, 3, -7]), [rng.randint(-3, 9) for _ in range(7)], i % 5 == 0) for i in range(120)]
    rows += [(5, 0, [1, 2, 3, 4, 5, 6, 7], True), (5, 1, [1, 2, 3, 4, 5, 6, 7], False), (10, 0, rows[10][2], True)]  # ids that repeat
    rows += [(200 + i, 1, [4] * 7, i < 2) for i in range(40)]  # one vector many times
    rows += [(None, 1, [1] * 7, True), (300, None, [1] * 7, True), (301, 1, None, True), (302, 1, [1, None], True), (303, 2, [], True), (304, 1, [9, 9], None), (305, 2, [5] * 9, True), (306, 77, [5] * 7, True)]
    rows += [(400, 5, [2**31, 2**29, 0, 1], True), (401, 5, [2**31, 0, 3, 1], False), (402, 6, [2**31 - 1, 2, 3, 1], False)]  # beyond exact floating point
    frame = _stored(spark, tmp_path / "rows", rows, "id long, label long, vector array<long>, anchor boolean", clashes=("bucket", "block", "row", "n", "score", "slot"))
    got = negatives.hard_negatives(frame, buckets=buckets, block_rows=block_rows, anchor_rows=anchor_rows, chunk=chunk)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == _negatives(rows)


def test_hard_negatives_of_empty_tables(spark):
    kinds = "id long, label long, vector array<long>, anchor boolean"
    assert negatives.hard_negatives(spark.createDataFrame([], kinds)).collect() == []
    assert negatives.hard_negatives(spark.createDataFrame([(1, 1, [1], False), (2, 1, [1], None)], kinds)).collect() == []
    assert negatives.hard_negatives(spark.createDataFrame([(1, 1, [1], True)], kinds)).collect() == []


def test_fixed_point(spark):
    rows = [([0.1, -0.1, 1e30, -1e30],), ([1.0, None],), (None,), ([float("nan")],), ([float("inf")],), ([],)]
    got = [r.v for r in spark.createDataFrame(rows, "x array<float>").select(negatives.fixed_point(F.col("x")).alias("v")).collect()]
    assert got == [[25, -26, 2**63 - 1, -(2**63)], None, None, None, None, []]


def test_best_of_tied_scores():
    scores = np.array([[3, 5, 5, 5, 1], [2, 2, 2, 2, 2], [9, 8, 7, 6, 5]])
    good = np.array([[1, 1, 0, 1, 1], [0, 1, 1, 1, 1], [0, 0, 0, 0, 0]], bool)
    at, column = negatives.best(scores, good, 2)
    assert list(zip(at.tolist(), column.tolist(), strict=True)) == [(0, 1), (0, 3), (1, 1), (1, 2)]
    assert negatives.product(np.array([[2**40, 3]]), np.array([[2**20, 1]])).tolist() == [[2**60 + 3]]


def test_queries_equal_their_sql(spark):
    """The contract's columns and rows of op11 and op13, held to their SQL on the smallest tables."""
    sf_dir = "/root/testdata/sf0.001"
    if not os.path.isdir(sf_dir):
        pytest.skip("the driver's tables are not here")
    db = duckdb.connect()
    for t in ("documents", "embeddings"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for name in ("op11_spelling", "op13_negatives"):
        found, frame = db.sql(queries.ORACLE_SQL[name]), queries.QUERIES[name](spark, sf_dir)
        assert sorted(found.columns) == sorted(frame.columns)
        want = collections.Counter(found.select(*(duckdb.ColumnExpression(c) for c in frame.columns)).fetchall())
        assert want and collections.Counter(map(tuple, frame.collect())) == want
