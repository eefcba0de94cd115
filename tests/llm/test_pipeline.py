"""The corpus pipeline against a brute-force version of its stages."""

import collections
import hashlib
import random
import re

import pytest

pytest.importorskip("veldspar.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from pyspark.sql import functions as F  # noqa: E402

from veldspar.llm import mixing  # noqa: E402
from veldspar.llm.queries import tokenizer_path  # noqa: E402

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(11)
    rows = []
    for i in range(40):
        words = [rng.choice(["alpha", "beta", "gamma", "delta"]) + rng.choice("abcdefgh") * rng.randint(0, 3) + str(rng.randrange(9)) for _ in range(rng.randint(5, 90))]
        rows.append(" ".join(words))
    rows += [None, "", "123 456 !!", *rows[:8], *(r.replace(" ", "\t", 2) for r in rows[8:12])]
    for r in rows[:12]:
        words = r.split(" ")
        words[len(words) // 2] = "other"
        rows.append(" ".join(words))
    path = tmp_path_factory.mktemp("sf")
    table = [(i, t, "en" if i % 4 else None, f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(rows)]
    spark.createDataFrame(table, COLUMNS).repartition(3).write.parquet(str(path / "documents.parquet"))
    return str(path)


def test_stages(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mixing", "bpe"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    now = {r.doc_id: r for r in docs.collect()}
    stage = dict(corpus_pipeline.STAGES)

    got = stage["language_id"](spark, docs, sf_dir)
    assert got.columns == docs.columns
    want = {i for i, r in now.items() if any(c.isalpha() for c in r.text or "")}
    assert {r.doc_id for r in got.collect()} == want and {r.lang for r in got.collect()} == {"en"}

    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t)
    first: dict[str, int] = {}
    for i in sorted(want):
        first.setdefault(norm(now[i].text), i)
    got = stage["exact_dedup"](spark, got, sf_dir)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == sorted(first.values())

    sets = {}
    for i in first.values():
        w = now[i].text.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}
    group = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            both = len(sets[a] & sets[b])
            if a < b and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((group[a], group[b]))
                group = {k: low if v == high else v for k, v in group.items()}
    got = stage["near_dedup"](spark, got, sf_dir)
    assert got.columns == docs.columns and {r.doc_id for r in got.collect()} == set(group.values())

    copies = {r.doc_id: r.copies for r in mixing.mix(got).collect()}
    mixed = stage["mixing"](spark, got, sf_dir)
    counts = collections.Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == docs.columns and counts == {i: c for i, c in copies.items() if c}

    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(tokenizer_path())
    final = stage["bpe"](spark, mixed, sf_dir).collect()
    assert len(final) == sum(counts.values())
    for r in final:
        ids = library.encode(now[r.doc_id].text, add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
    assert sorted((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, sf_dir).collect()) == sorted((r.doc_id, r.ids_sha256) for r in final)


def test_odd_tables(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(str(tmp_path / "empty" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).collect() == []
    rows = [(1, "one text here", None, None, None), (1, "one text here", None, None, None), (None, "another text", "en", "a", 1), (2, None, "en", "a", 1)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(tmp_path / "odd" / "documents.parquet"))
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()} <= {1, None}
    # All rows of a row, and columns whose names operators use themselves.
    rows = [(k % 20, " ".join(f"word{k % 20}x{j}" for j in range(30)), "en", "a", 1) for k in range(60)]
    clash = ("own", "row", "carried", "copies", "lang_pred", "text_sha256", "mix_copy", "component_id", "kept", "place", "col", "score", "_stored_row")
    docs = spark.createDataFrame(rows, COLUMNS)
    for name in clash:
        docs = docs.withColumn(name, F.concat(F.lit(f"{name} "), "doc_id"))
    docs.repartition(3).write.parquet(str(tmp_path / "clash" / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "clash" / "documents.parquet"))
    want = {r.doc_id: r for r in docs.distinct().collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, "")
        got = docs.collect()
        assert docs.columns == [*COLUMNS.replace(" long", "").replace(" string", "").split(", "), *clash]
        assert all(r == want[r.doc_id] for r in got), name
        if k < 3:
            assert collections.Counter(r.doc_id for r in got) == dict.fromkeys(range(20), 3 if k == 0 else 1)
    assert 28 <= len(got) <= 32 and max(collections.Counter(r.doc_id for r in got).values()) <= 2  # of 600 words 900


def test_stages_decide_by_row(spark, tmp_path):
    """Rows that share an id or have none are documents of their own to every stage."""
    stage = dict(corpus_pipeline.STAGES)

    def table(name, rows):
        spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    english, spanish = "the house and the garden with this that were there", "la casa y el jardin con esta que estaban donde"
    rows = [(i, english, "en", "a", 1) for i in range(8)] + [(i + 8, spanish, "es", "a", 1) for i in range(8)]
    got = stage["language_id"](spark, table("lang", [*rows, (None, english, None, "a", 1), (None, spanish, None, "a", 1), (None, "12 34", None, "a", 1)]), "")
    assert sorted((r.text, r.lang) for r in got.where("doc_id is null").collect()) == sorted([(english, "en"), (spanish, "es")]) and got.count() == 18

    long = " ".join(f"w{i}" for i in range(100))
    near = long.replace("w50", "other")
    twice = [(1, long, None, None, 1), (1, long, None, None, 1), (None, english, "en", "a", 1), (None, english, "en", "a", 1), (1, near, None, None, 1), (None, near, None, None, 1), (2, near + " end", None, None, 1)]
    got = stage["exact_dedup"](spark, table("exact", twice), "").collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted([(1, long), (0, english), (1, near), (2, near + " end")])
    got = stage["near_dedup"](spark, table("near", twice), "").collect()
    assert len(got) == 2 and sorted(r.doc_id or 0 for r in got) == [0, 1]

    many = [(7, f"word{i}", None, f"s{i % 3}", 1) for i in range(300)]
    docs = table("mix", many)
    want = {r.source: r.target for r in mixing.mix(docs).collect()}
    got = collections.Counter(r.source for r in stage["mixing"](spark, docs, "").collect())
    assert all(abs(got[s] - t) <= 1 for s, t in want.items())
