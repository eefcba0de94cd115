"""The llm operators against brute force, round trips and held-out accuracy, and on odd tables."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pytest

pytest.importorskip("veldspar.llm")

from pyspark.sql import functions as F  # noqa: E402

from veldspar.llm import bpe, exact_dedup, language, lm, minhash, mixing, quality, toxicity  # noqa: E402
from veldspar.llm.queries import tokenizer_path  # noqa: E402
from veldspar.llm.scratch import Scratch  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def _words(rng, n, vocabulary=400):
    return " ".join(f"{rng.choice('abcdefgh')}w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Texts with copies, near copies, nulls, empty, very long and odd ones; an id that repeats with its text."""
    rng = random.Random(5)
    base = [_words(rng, rng.randint(1, 120)) for _ in range(60)]
    texts = [*base, None, "", " \n\t ", "a", "A", "a b", "x" * 9000, _words(rng, 9000), "é ñ 你好 \U0001f600", "a\x1cb\x1dc"]
    for t in base[:20]:
        words = t.split(" ")
        for _ in range(3):
            w = list(words)
            for _ in range(max(1, len(w) // 60)):
                w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
        texts.append(t.replace(" ", " \n ", 1))
        texts.append(t)
    rows = [(i * 7 % 1009, t, "en" if i % 3 else None, f"s{i % 4}" if i % 11 else None, len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[3]]


@pytest.fixture(scope="module")
def docs(spark, corpus, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    frame = spark.createDataFrame(corpus, DOCS)
    for clash in ("name", "row", "salt", "key", "size", "copies", "label", "n"):
        frame = frame.withColumn(clash, F.lit("clash"))
    frame.repartition(5).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("block", [7, 2048])
def test_exact_dedup(docs, corpus, block):
    got = [r.asDict() for r in exact_dedup.exact_dedup(docs, block_chars=block).collect()]
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = collections.defaultdict(list)
    for r in corpus:
        groups[norm(r[1])].append(r[0])
    sizes = {hashlib.sha256(k.encode()).hexdigest(): (min(v), len(v)) for k, v in groups.items()}
    assert len(got) == len(corpus)
    for r in got:
        assert (r["keep_id"], r["group_size"]) == sizes[r["text_sha256"]]
    assert sum(r["kept"] for r in got) == len(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_exact_dedup_nulls_and_empty_table(spark, empty):
    got = exact_dedup.exact_dedup(spark.createDataFrame([(None, "a", None, None, 1), (4, "a", None, None, 1), (None, "b", None, None, 1)], DOCS)).collect()
    assert sorted((r.text_sha256[:2], r.keep_id, r.group_size, r.kept) for r in got) == sorted([("ca", 4, 2, False), ("ca", 4, 2, True), ("3e", None, 1, True)])
    assert exact_dedup.exact_dedup(empty).collect() == []


def _near_groups(rows, words, top, bottom):
    sets = {}
    for i, t, *_ in rows:
        w = WORD.findall(_lower(t))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a]:
                both = len(sets[a] & sets[b])
                if bottom * both >= top * (len(sets[a]) + len(sets[b]) - both) > 0:
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    return sets, {i: root(i) for i in sets}


@pytest.mark.parametrize(("words", "top"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, corpus, words, top):
    sets, groups = _near_groups(corpus, words, top, 100)
    got = minhash.near_duplicates(docs, words=words, similarity=(top, 100)).collect()
    assert len(got) == len(corpus)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), groups[r.doc_id], groups[r.doc_id] == r.doc_id)


@pytest.mark.parametrize("weight", [8 * 170, 170, 1 << 18])
def test_near_duplicates_of_a_hot_band(spark, monkeypatch, weight):
    """Copies with 0 to 12 changed words of 100: a few groups, in one band of many blocks, of a block a document, or of one block."""
    monkeypatch.setattr(minhash, "BLOCK_WEIGHT", weight)
    rng = random.Random(9)
    base = _words(rng, 100, 10**6).split(" ")
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(13)):
            w[rng.randrange(100)] = f"new{rng.randrange(10**6)}"
        rows.append((i, " ".join(w), None, None, 0))
    _, groups = _near_groups(rows, 3, 85, 100)
    got = minhash.near_duplicates(spark.createDataFrame(rows, DOCS), words=3, similarity=(85, 100)).collect()
    assert {r.doc_id: r.component_id for r in got} == groups
    assert 1 < len(set(groups.values())) < 60


def test_near_duplicates_odd_tables(spark, empty):
    assert minhash.near_duplicates(empty).collect() == []
    got = minhash.near_duplicates(spark.createDataFrame([(None, "a b c d e f", None, None, 0), (2, "a b c d e f", None, None, 0), (3, None, None, None, 0), (None, "g h", None, None, 0)], DOCS)).collect()
    assert sorted((r.doc_id or 0, r.component_id, r.kept) for r in got) == [(0, None, True), (0, None, True), (2, 2, True), (3, 3, True)]


def test_near_duplicates_with_an_id_of_unlike_texts(spark):
    """Classes are of texts, not of ids, so an id that two texts share joins nothing."""
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(5, a), (5, b), (2, f"{b} more"), (9, f"{a} more"), (9, f"{a} more")]
    got = minhash.near_duplicates(spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], DOCS))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == [(2, 57, 2), (5, 56, 2), (5, 56, 5), (9, 57, 5), (9, 57, 5)]


def test_estimate_is_close():
    rng = np.random.default_rng(3)
    for share in (0.3, 0.6, 0.85, 0.95):
        found = []
        for _ in range(20):
            n = 400
            both = int(n * share)
            x = rng.integers(1, 1 << 62, 2 * n - both, dtype=np.uint64)
            a, b = x[:n], x[n - both :]
            found.append(minhash.estimate(minhash.sketch(a)[None], minhash.sketch(b)[None], np.array([float(n)]), np.array([float(n)]))[0])
        assert abs(np.mean(found) - both / (2 * n - both)) < 0.05
    u = rng.integers(1, 1 << 62, 500, dtype=np.uint64)
    assert (np.maximum(minhash.sketch(u[:200]), minhash.sketch(u[100:])) == minhash.sketch(u)).all()


def test_mixing(spark, docs, corpus, empty):
    got = [r.asDict() for r in mixing.mix(docs).collect()]
    again = [r.asDict() for r in mixing.mix(docs.repartition(3)).collect()]
    assert sorted((r["doc_id"], r["copies"]) for r in got) == sorted((r["doc_id"], r["copies"]) for r in again)
    assert sorted((r["doc_id"], r["size"]) for r in got) == sorted((r[0], len(WORD.findall(r[1] or ""))) for r in corpus)
    sizes = collections.Counter()
    for r in got:
        sizes[r["source"]] += r["size"]
        assert 0 <= r["copies"] <= 2
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, full = {}, set()
    while len(target) < len(order):
        rest = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        level = rest / sum(weight[s] for s in order if s not in full)
        over = {s for s in order if s not in full and level * weight[s] > 2 * sizes[s]}
        if not over:
            target = {s: 2 * sizes[s] if s in full else level * weight[s] for s in order}
        full |= over
    for s in order:
        mine = [r for r in got if r["source"] == s]
        assert all(math.isclose(r["target"], target[s]) for r in mine)
        assert abs(sum(r["copies"] * r["size"] for r in mine) - target[s]) <= max(r["size"] for r in mine)
    assert mixing.mix(empty).collect() == []


def test_mixing_uses_the_tree(spark):
    rows = spark.range(9000).selectExpr("id doc_id", "case when id % 3 = 0 then 'a' else 'b' end source", "1 + id * 37 % 91 size")
    got = mixing.mix_sizes(rows).toPandas()
    for _, g in got.groupby("source"):
        assert abs((g["copies"] * g["size"]).sum() - g["target"].iloc[0]) <= 91
    assert len(got) == 9000


def test_mixing_of_a_hot_id(spark, monkeypatch):
    """An id on a third of the rows, and no id on another: groups stay small, targets are met, reruns agree."""
    monkeypatch.setattr(mixing, "GROUP_ROWS", 200)
    largest = []
    level = mixing._level

    def watched(rows, last):
        largest.append(max((r[0] for r in rows.groupBy("source", "bucket").count().select("count").collect()), default=0))
        return level(rows, last)

    monkeypatch.setattr(mixing, "_level", watched)
    rows = spark.range(9000).selectExpr("case when id % 3 = 0 then 7 when id % 3 = 1 then id end doc_id", "case when id % 2 = 0 then 'a' else 'b' end source", "1 + id * 37 % 91 size")
    got = mixing.mix_sizes(rows).toPandas()
    assert largest[0] < 400 and len(got) == 9000
    for _, g in got.groupby("source"):
        assert abs((g["copies"] * g["size"]).sum() - g["target"].iloc[0]) <= 91
    again = mixing.mix_sizes(rows).toPandas()
    order = ["source", "doc_id", "size", "copies"]
    assert got.sort_values(order)[order].reset_index(drop=True).equals(again.sort_values(order)[order].reset_index(drop=True))


def test_bpe_equals_the_library(spark, docs, empty):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(tokenizer_path())
    library.no_padding()
    library.no_truncation()
    texts = [r.text for r in docs.select("text").collect()] + ["<|startoftext|>Don't<|endoftext|> <|endo I'LL", "ΑΣ ΣΑΣ. İstanbul", "é ﬁ ① Ⅷ ½", "ạ́ ̀x", "ññ" * 300, "\x00\x85z　q"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in bpe.encode(frame, tokenizer_path()).collect()}
    for i, t in enumerate(texts):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(got[i].ids, "<u4").tolist() == want, t
        assert got[i].n_tokens == len(want)
        assert got[i].decoded == library.decode(want, skip_special_tokens=False)
    assert bpe.digests(bpe.encode(empty, tokenizer_path())).collect() == []


def test_bpe_merges_one_by_one_agree_with_the_guesses():
    vocab = bpe.Vocabulary(tokenizer_path())
    rng = random.Random(1)
    new = sorted({"".join(rng.choice("aeinrst") for _ in range(rng.randint(1, 14))) for _ in range(500)})
    assert vocab.encode_words(new) == [[vocab.ids[s] for s in vocab.merged(vocab.symbols(w))] for w in new]
    assert 0 < vocab.exact_merges < len(new)


def test_bpe_of_long_words():
    """Words that fail the checks and have no end in sight take about linear time."""
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(tokenizer_path())
    vocab, rng = bpe.Vocabulary(tokenizer_path()), random.Random(3)
    for n in (65, 66, 300, 5000):
        for letters in ("aeinrst", "ab", "éñ漢x"):
            word = "".join(rng.choice(letters) for _ in range(n))
            assert vocab.encode_words([word.lower()])[0] == library.encode(word, add_special_tokens=False).ids
            assert vocab.merged_long([vocab.ids[c] for c in vocab.symbols(word[:80])]) == [vocab.ids[s] for s in vocab.merged(vocab.symbols(word[:80]))]
    word = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=1 << 20))
    began = time.process_time()
    (packed,) = vocab.encode([word])
    assert time.process_time() - began < 60
    assert np.frombuffer(packed, "<u4").tolist() == library.encode(word, add_special_tokens=False).ids


def test_language(spark, empty):
    rng = random.Random(2)
    syllables = {"aa": ["ka", "to", "mi", "ru"], "bb": ["schl", "ung", "eit", "ver"], "cc": ["eau", "ment", "oux", "ille"]}
    rows = []
    for i in range(300):
        lang = rng.choice(list(syllables))
        text = " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 40)))
        rows.append((i, text.capitalize(), lang, "s", 0))
    frame = spark.createDataFrame(rows + [(1000, None, "aa", "s", 0), (1001, "12 !?", "bb", "s", 0), (1002, "", None, "s", 0)], DOCS)
    out = language.held_out(F.col("doc_id"), 4, 2)
    got = language.identify(frame, language.train(frame.where(~out))).join(frame, "doc_id").withColumn("held_out", out).collect()
    assert {r.doc_id: (r.lang_pred, r.score) for r in got if r.doc_id >= 1000} == dict.fromkeys((1000, 1001, 1002), ("und", 0.0))
    assert all(r.lang_pred == r.lang and 0 <= r.score <= 1 for r in got if r.doc_id < 1000)
    assert {r.doc_id for r in got if r.held_out} == {i for i in [*range(300), 1000, 1001, 1002] if zlib.crc32(str(i).encode()) % 4 == 2}
    assert language.identify(empty, language.train(empty)).collect() == []
    assert [r.lang_pred for r in language.identify(frame.limit(1), {}).collect()] == ["und"]


def test_language_vectors_by_hand(monkeypatch):
    """A text's vector is the sum of its trigrams' bound vectors, in whatever company and order it comes."""
    from veldspar.llm.textkit import text_bytes

    import pyarrow as pa

    def vectors(texts):
        data, offsets = text_bytes(pa.array(texts, pa.string()))
        return language.document_vectors(data, offsets, 0, len(texts))

    letter = lambda c: language.letter_vectors(np.array([ord(c)]))[0].astype(int)
    texts = ["abc def", "", "a", None, "12 !", "Été  12x", "ß. a", "abc def", "你好 abc", "x" * 5000, "z"]
    for grams in (2, 1 << 14):
        monkeypatch.setattr(language, "GRAMS", grams)
        got, count = vectors(texts)
        for k, t in enumerate(texts):
            plain = " " + re.sub(r"[^a-zéß你好]+", " ", (t or "").lower()).strip() + " "
            want = sum((np.roll(letter(a), 2) * np.roll(letter(b), 1) * letter(c) for a, b, c in zip(plain, plain[1:], plain[2:])), np.zeros(language.DIMENSIONS))
            if not plain.strip():
                want = want * 0
            assert (got[k] == want).all() and count[k] == len(plain.replace(" ", "")), t
            assert (vectors([t])[0][0] == got[k]).all() and (vectors(texts[::-1])[0][-1 - k] == got[k]).all()


def test_language_is_the_nearest_prototype(spark):
    texts = ["kato miru kato", "schlung eit verung", "mentoux eau", "kaung"]
    frame = spark.createDataFrame([(i, t, "abca"[i], None, 0) for i, t in enumerate(texts)], DOCS)
    prototypes = language.train(frame.where("doc_id < 3"))
    from veldspar.llm.textkit import text_bytes

    import pyarrow as pa

    data, offsets = text_bytes(pa.array(texts, pa.string()))
    vectors, _ = language.document_vectors(data, offsets, 0, 4)
    cosine = lambda x, y: float(x @ y / np.linalg.norm(x) / np.linalg.norm(y))
    for r in language.identify(frame, prototypes, carry=F.col("source")).collect():
        scores = {k: cosine(vectors[r.doc_id], v) for k, v in prototypes.items()}
        assert r.lang_pred == max(scores, key=scores.get) and math.isclose(r.score, max(0, max(scores.values())), rel_tol=1e-5) and r.carried is None


def test_lm(spark, docs, corpus, empty):
    out = language.held_out(F.col("doc_id"), 7, 2)
    vocabulary, automaton = lm.train(docs.where(~out), Scratch(spark, "t"), share=1e-4)
    got = lm.score(docs, vocabulary, automaton).collect()
    tokens = {r[0]: [*WORD.findall(_lower(r[1])), None] for r in corpus}
    counts = collections.Counter()
    for r in corpus:
        if zlib.crc32(str(r[0]).encode()) % 7 != 2:
            counts.update(tokens[r[0]])
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(corpus)
    for r in got:
        words = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(w in counts for w in words), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words), rel_tol=1e-9)
        assert r.score < 0
    # Arcs and failure mass of each state sum to one.
    a = automaton
    assert len(a.two)
    for h in np.unique(a.two // len(a.words)):
        arcs = np.flatnonzero(a.two // len(a.words) == h)
        kept = (10 ** a.two_arc[arcs]).sum()
        below = (10 ** a.base[a.two[arcs] % len(a.words)]).sum()
        assert math.isclose(kept + 10 ** a.fail_one[h] * (1 - below), 1, rel_tol=1e-6)
    nothing, bare = lm.train(empty, Scratch(spark, "t"))
    assert lm.score(empty, nothing, bare).collect() == []
    assert [r.n_tokens for r in lm.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), nothing, bare).collect()] == [3]


def test_lm_traversal_equals_a_walk_by_hand(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randint(1, 30))) for _ in range(80)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    vocabulary, _ = lm.train(frame, Scratch(spark, "t"), share=0.004)
    _, a = lm.train(frame, Scratch(spark, "t"), share=0.004)
    got = {r.doc_id: r.score for r in lm.score(frame, vocabulary, a).collect()}
    from veldspar.llm.textkit import text_bytes, words as cut

    import pyarrow as pa

    n = len(a.words)
    for i, t in enumerate(texts[:20]):
        data, offsets = text_bytes(pa.array([t]))
        hashes, _ = lm.tokens(cut(data, offsets, 0, 1, True))
        ids = [int(x) for x in lm._find(a.words, hashes.view(np.int64))]
        total, history = 0.0, ()
        two = {int(c): k for k, c in enumerate(a.two)}
        three = {int(c): k for k, c in enumerate(a.three)}
        for w in ids:
            state = history
            while True:
                if len(state) == 2:
                    place = two[state[0] * n + state[1]]
                    arc = three.get(place * n + w)
                    if arc is not None:
                        total += a.three_arc[arc]
                        break
                    total += a.fail_two[place]
                elif len(state) == 1:
                    arc = two.get(state[0] * n + w)
                    if arc is not None:
                        total += a.two_arc[arc]
                        break
                    total += a.fail_one[state[0]]
                else:
                    total += a.base[w]
                    break
                state = state[1:]
            history = (*history, w)[-2:]
            while len(history) == 2 and (two.get(history[0] * n + history[1]) is None or not a.has_two[two[history[0] * n + history[1]]]):
                history = history[1:]
        assert math.isclose(total, got[i], rel_tol=1e-9)


@pytest.mark.parametrize("bucket", [1 << 20, 900])
def test_lm_of_all_ngrams_equals_the_automaton(spark, docs, empty, monkeypatch, bucket):
    monkeypatch.setattr(lm, "BUCKET_TOKENS", bucket)
    monkeypatch.setattr(lm, "FLUSH_ROWS", bucket)
    out = language.held_out(F.col("doc_id"), 7, 2)
    train = docs.where(~out)
    base, bare = lm.train(train, Scratch(spark, "t"), share=1.0)
    vocabulary, a = lm.train(train, Scratch(spark, "t"), share=2 / bare.n_tokens)
    assert len(a.three) > 100 and a.three_counts.min() == 2
    want = sorted(lm.score(docs, vocabulary, a).collect(), key=str)
    for share in (1e-9, 5e-3, 1.0):  # the whole table is broadcast, a part of it, next to nothing
        got = sorted(lm.score_whole(docs, lm.train_whole(train, Scratch(spark, "t"), share=share), Scratch(spark, "t")).collect(), key=str)
        assert len(got) == len(want)
        for g, w in zip(sorted(got, key=lambda r: (r.doc_id, r.n_tokens)), sorted(want, key=lambda r: (r.doc_id, r.n_tokens)), strict=True):
            assert g[:4] == w[:4] and math.isclose(g.base_score, w.base_score, rel_tol=1e-9) and math.isclose(g.score, w.score, rel_tol=1e-9)
    # What is kept does not hang on the size of the corpus: a pair of words that occurs twice among many others.
    rows = [(0, "rare pair"), (1, "rare pair"), *((i, _words(random.Random(i), 300)) for i in range(2, 40))]
    big = spark.createDataFrame(rows * 100, "doc_id long, text string").where("doc_id > 1").unionByName(spark.createDataFrame(rows[:2], "doc_id long, text string"))
    model = lm.train_whole(big, Scratch(spark, "t"))
    assert model.n_tokens * lm.SHARE > 2
    pair = lm._joined(*(lm.tokens(next(iter(lm.each_slice(lm.pa.array([w]), lower=True)))[2])[0][:1] for w in ("rare", "pair"))).view(np.int64)[0]
    assert model.gains.where(F.col("key") == int(pair)).count() == 1
    nothing = lm.train_whole(empty, Scratch(spark, "t"))
    assert lm.score_whole(empty, nothing, Scratch(spark, "t")).collect() == []
    assert [r.n_tokens for r in lm.score_whole(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), nothing, Scratch(spark, "t")).collect()] == [3]


def test_quality_counts(spark, docs, corpus):
    x = quality.judge(docs, quality.grow(np.zeros((0, len(quality.FEATURES))), np.zeros(0)))
    odd = [(5000, "a b\na b\n\n \na b c\nd # $ |", None, None, 0), (5001, " ".join(map(str, range(9))) + " x " + " ".join(map(str, range(9))), None, None, 0)]
    got = {r.doc_id: r for r in x.collect()} | {r.doc_id: r for r in quality.judge(spark.createDataFrame(odd, DOCS), quality.grow(np.zeros((0, len(quality.FEATURES))), np.zeros(0))).collect()}
    for i, t, *_ in [*corpus, *odd]:
        t = t or ""
        words, seen, dup = WORD.findall(t), set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        windows = collections.Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
        cover = {k + j for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for j in range(8)}
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(cover))
        assert tuple(got[i][c] for c in quality.COUNTS) == want


def test_quality_trees_learn_and_are_monotone(spark, empty):
    rng = np.random.default_rng(1)
    x = rng.random((3000, len(quality.FEATURES)))
    bad = quality.FEATURES.index("symbols_per_word")
    y = ((x[:, bad] < 0.5) & (x[:, 1] > 0.2) | (rng.random(3000) < 0.05)).astype(float)
    trees = quality.grow(x[:2000], y[:2000])
    assert ((trees.score(x[2000:]) >= 0.5) == (y[2000:] > 0.5)).mean() > 0.93
    for feature in quality.MONOTONE:
        line = np.repeat(rng.random((50, 1, x.shape[1])), 21, 1)
        line[:, :, quality.FEATURES.index(feature)] = np.linspace(0, 1, 21)
        assert (np.diff(trees.score(line.reshape(-1, x.shape[1])).reshape(50, 21)) <= 1e-12).all()
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.verdict(quality.judge(empty, quality.train(empty, labels))).collect() == []


def test_toxicity(spark, empty):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(500):
        words = [_words(rng, 1, 200) + rng.choice(["ment", "tion", ""]) for _ in range(rng.randint(8, 60))]
        toxic = int(rng.random() < 0.3)
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(["zorkish", "quibbler", "fnordlet"]))
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 1, toxic))
    frame, known = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = language.held_out(F.col("doc_id"), 5, 0)
    machine = toxicity.train(frame, known.where(~out))
    got = {r.doc_id: r.score for r in toxicity.score(frame.where(out), machine).collect()}
    assert np.mean([(got[i] >= 0.5) == bool(t) for i, _, t in labels if i in got]) > 0.95
    odd = ["z.o.r.k.i.s.h qui-bbler", "z o r k i s h and quibb1er quibbller", None, "", "aw12 bw7 cw9tion dw4 ew77ment", "zorkish" * 2000]
    scores = [r.score for r in sorted(toxicity.score(spark.createDataFrame([(k, t) for k, t in enumerate(odd)], "doc_id long, text string"), machine).collect())]
    assert scores[0] > 0.5 and scores[1] > 0.5 and max(scores[2:5]) < 0.5 and all(0 <= s <= 1 for s in scores)
    one = toxicity.train(frame, known.where("toxic = 0"))
    assert all(r.score < 0.01 for r in toxicity.score(frame, one).collect())
    assert toxicity.score(empty, toxicity.train(empty, known)).collect() == []


def test_toxicity_triples_by_hand(monkeypatch):
    """Whole spans of any length and script, in one way or another."""
    def by_hand(span):
        symbol = [toxicity.EDGE, *(int(x) for x in toxicity.symbols(np.frombuffer(span.encode(), np.uint8))[0]), toxicity.EDGE]
        out = collections.Counter()
        for i in range(len(symbol)):
            for j in range(i + 1, min(i + toxicity.REACH, len(symbol))):
                for k in range(j + 1, min(i + toxicity.REACH, len(symbol))):
                    if symbol[i] and symbol[j] and symbol[k]:
                        out[(symbol[i] * 64 + symbol[j]) * 64 + symbol[k]] += toxicity.DECAY ** (k - i - 2)
        return out

    rng = random.Random(8)
    texts = ["a", "ab", "z.o.r", "éclair", "漢字漢字", "".join(rng.choice("abc.-é漢") for _ in range(70)), "".join(rng.choice("abc.-é漢") for _ in range(900))]
    raw = [t.encode() for t in texts]
    size = np.array([len(r) for r in raw])
    for long, piece in ((4096, 1 << 18), (40, 16), (0, 1)):
        monkeypatch.setattr(toxicity, "LONG", long)
        monkeypatch.setattr(toxicity, "PIECE", piece)
        owner, triple, weight = toxicity.triples(np.frombuffer(b"".join(raw), np.uint8), np.cumsum(size) - size, np.cumsum(size))
        for k, t in enumerate(texts):
            got = dict(zip(triple[owner == k].tolist(), weight[owner == k].tolist(), strict=True))
            want = by_hand(t)
            assert got.keys() == want.keys() and all(math.isclose(got[x], want[x], rel_tol=1e-9) for x in want)
        own = toxicity.kernel(texts, texts)
        assert np.allclose(np.diag(own)[[1, 2, 3, 5, 6]], 1) and (own <= 1 + 1e-9).all()


def test_runs_of_single_letters_end_with_their_document():
    from veldspar.llm.textkit import words

    def found(texts):
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])]).astype(np.int64)
        return toxicity.spans(words(data, offsets, 0, len(texts), True))

    texts = ["i d i o t", "a b", "c d e x f g h long i", "", "j k l", "m n", "plain words"]
    data, start, end, doc = found(texts)
    joined = [(int(d), data[a:b].tobytes().decode()) for a, b, d in zip(start, end, doc, strict=True) if a >= len("".join(texts))]
    assert joined == [(0, "idiot"), (2, "cdexfgh"), (4, "jkl")]
    began = time.time()
    assert len(found([" ".join("abcdefghijklm" * 8)] * 16_000)[0]) > 0
    assert time.time() - began < 10


@pytest.mark.parametrize("low, high", [(0, 2**64 - 1), (3 << 56, (3 << 56) + 2**57), (2**63 - 5000, 2**63 + 5000), (7, 8)])
def test_lookup_of_keys_that_begin_with_the_same_bits(low, high):
    """The keys of one bucket are spread over the index, so a search meets few others; keys beyond the range are not found."""
    rng = np.random.default_rng(5)
    table = np.unique(rng.integers(low, high, 3000, dtype=np.uint64))
    rng.shuffle(table)
    found = lm.Lookup(table.view(np.int64))
    odd = np.array([0, 1, low, max(low, 1) - 1, high, 2**64 - 1], np.uint64)
    keys = np.concatenate([table, odd, rng.integers(low, high, 3000, dtype=np.uint64)])
    place = {int(k): n for n, k in enumerate(table)}
    assert found.find(keys.view(np.int64)).tolist() == [place.get(int(k), -1) for k in keys]
    assert np.diff(found.start).max() < 20
