"""Language-model scoring with a weighted backoff automaton over word n-grams.

Counting is exact and covers every training text. Unigram counts of all tokens stay a
distributed table. An n-gram of two or three words becomes part of the automaton when it
makes up at least SHARE of all training tokens, so there are at most 1 / SHARE of each
order whatever the size of the corpus; that bound is what makes them safe to broadcast.
An n-gram can only be that frequent if its parts are, so each order is counted among the
survivors of the order before.

States are the histories that have arcs, and the empty history. A state's failure arc
carries the log of the mass that discounting its arcs leaves, and leads to the history
without its oldest word; an arc carries the log of its token's discounted share and of what
the failure arc would give it besides. The empty history gives every token log10((c + 1) / (N + V + 1)). After a
token the state is the longest suffix that is a state. As histories have two words at most,
numpy finds the state before every token of a slice of texts at once, in the order of the
text, and sums up the arcs taken.

Counts of tokens too rare for the broadcast table are joined: each such token of a text is
one row, so no task holds the vocabulary.

``train`` and ``score`` are this automaton in memory. ``train_whole`` and ``score_whole`` hold
every n-gram that occurs LEAST times, however large the corpus, in a distributed table.
The weight of a walk is a sum of one gain for each n-gram of the text: a word gives its base
and its failure arc, an n-gram with an arc what the arc is above the way it replaces, and
its own failure arc. So scoring is one join of n-grams with gains, in packed blocks: numpy
counts and looks up within buckets that Spark shuffles. Gains of the most frequent n-grams,
1 / SHARE of each order at most, are broadcast, which also leaves no hot key to the join.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldspar.llm.scratch import Scratch
from veldspar.llm.textkit import Words, each_slice, mix64

SHARE = 2e-6
LEAST = 2
DISCOUNT = 0.6
FLUSH_ROWS = 1 << 19
#: Longer n-grams are counted, and n-grams meet their gains, in buckets of about so many tokens, and these in so many turns: what lies on disk at once is a part of them.
BUCKET_TOKENS = 1 << 19
PASSES = 3
MEETINGS = 3
NONE = np.uint64(0)  #: In place of the word before the first.
END = np.uint64(0x656E64)


def tokens(found: Words) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of a slice, every document closed by END, and the index of its document."""
    n_docs = len(found.first) - 1
    word = np.ones(len(found.start) + n_docs, bool)
    word[found.first[1:] + np.arange(n_docs)] = False
    hashes = np.full(len(word), END)
    hashes[word] = found.hashes()
    return hashes, np.repeat(np.arange(n_docs), np.diff(found.first) + 1)


class Counter:
    """Sums of counts by integer key, merged when enough have come in."""

    def __init__(self) -> None:
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.pending = 0

    def add(self, keys: np.ndarray) -> None:
        keys, counts = np.unique(keys, return_counts=True)
        self.keys.append(keys)
        self.counts.append(counts)
        self.pending += len(keys)
        if self.pending > 2 * FLUSH_ROWS:
            self.merge()

    def merge(self) -> None:
        keys = np.concatenate(self.keys) if self.keys else np.zeros(0, np.int64)
        found, at = np.unique(keys, return_inverse=True)
        sums = np.bincount(at, np.concatenate(self.counts), len(found)).astype(np.int64) if len(found) else np.zeros(0, np.int64)
        self.keys, self.counts, self.pending = [found], [sums], 0

    def batches(self) -> Iterator[pa.RecordBatch]:
        self.merge()
        yield pa.RecordBatch.from_arrays([pa.array(self.keys[0], pa.int64()), pa.array(self.counts[0], pa.int64())], ["key", "c"])
        self.keys, self.counts = [], []


def _counted(docs: DataFrame, keys) -> DataFrame:  # noqa: ANN001
    """Counts of the integer keys that ``keys(hashes, owner)`` makes of the tokens of each slice."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Counter()
        for batch in batches:
            for _, _, found in each_slice(batch.column(0), lower=True):
                total.add(keys(*tokens(found)))
                if total.pending > 2 * FLUSH_ROWS:  # mostly new keys: memory stays bounded, Spark adds them up
                    yield from total.batches()
                    total = Counter()
        yield from total.batches()

    return docs.select("text").mapInArrow(counted, "key bigint, c bigint").groupBy("key").agg(F.sum("c").alias("c"))


def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of keys in a sorted table, -1 where they are not in it."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


class Lookup:
    """Places of keys in a table of ones well mixed from the least to the greatest, by an index of the leading bits of how far they are from the least.

    A bucket's keys lie in a narrow range: all begin with the same bits.
    """

    def __init__(self, table: np.ndarray) -> None:
        self.order = np.argsort(table.view(np.uint64))
        self.table = table.view(np.uint64)[self.order]
        self.least = self.table[0] if len(table) else np.uint64(0)
        far = int(self.table[-1] - self.least) if len(table) else 0
        bits = len(table).bit_length() + 2
        self.shift = np.uint64(max(0, far.bit_length() - bits))
        self.slots = (far >> int(self.shift)) + 1  # one more, which is empty, is for keys out of the range
        self.start = np.searchsorted((self.table - self.least) >> self.shift, np.arange(self.slots + 2, dtype=np.uint64)).astype(np.int32)
        self.crowded = np.diff(self.start) > 1

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of keys in the table as it was given, -1 where they are not in it."""
        keys = keys.view(np.uint64)
        if not len(self.table):
            return np.full(len(keys), -1)
        lead = np.minimum((keys - self.least) >> self.shift, np.uint64(self.slots)).astype(np.int64)
        at = np.minimum(self.start[lead], len(self.table) - 1)
        hit = self.table[at] == keys
        out = np.where(hit, self.order[at], -1)
        todo = np.flatnonzero(~hit & self.crowded[lead])
        at, end, keys = at[todo], self.start[lead[todo] + 1], keys[todo]
        while len(todo):
            going = np.flatnonzero(at + 1 < end)
            todo, at, end, keys = todo[going], at[going] + 1, end[going], keys[going]
            hit = self.table[at] == keys
            out[todo[hit]] = self.order[at[hit]]
            going = np.flatnonzero(~hit)
            todo, at, end, keys = todo[going], at[going], end[going], keys[going]
        return out


@dataclass
class Automaton:
    """Sorted arrays of the n-grams that are states or arcs. Words are ids in ``words``; -1 is any other token."""

    n_tokens: int
    n_types: int
    words: np.ndarray  # hashes of frequent tokens, as signed integers, sorted
    counts: np.ndarray
    two: np.ndarray  # codes of bigrams, sorted
    two_counts: np.ndarray
    three: np.ndarray  # codes of trigrams: bigram place * words + last word
    three_counts: np.ndarray

    def __post_init__(self) -> None:
        n = max(len(self.words), 1)
        self.base = np.log10((self.counts + 1) / (self.n_tokens + self.n_types + 1))
        first, last = np.divmod(self.two, n)
        self.two_arc, self.fail_one = self._weights(first, self.two_counts, self.counts, self.base[last])
        history, last = np.divmod(self.three, n)
        self.three_arc, self.fail_two = self._weights(history, self.three_counts, self.two_counts, self._lower(self.two[history] % n, last))
        self.has_two = np.bincount(history, minlength=len(self.two)) > 0

    def _lower(self, word: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Log-probability of tokens after one word."""
        at = _find(self.two, word * max(len(self.words), 1) + token)
        return np.where(at >= 0, self.two_arc[at], self.fail_one[word] + self.base[token]) if len(self.two) else self.base[token]

    def _weights(self, history, arcs, totals, lower):  # noqa: ANN001, ANN202
        """Log-weights of the arcs and of each history's failure arc, from the log-probabilities ``lower`` one word shorter."""
        total = np.maximum(totals, 1).astype(float)
        p = (arcs - DISCOUNT) / total[history] if len(arcs) else np.zeros(0)
        taken, n_arcs = np.bincount(history, arcs, len(totals)), np.bincount(history, minlength=len(totals))
        left = np.where(n_arcs > 0, (totals - taken + n_arcs * DISCOUNT) / total, 1.0)
        return np.log10(p + left[history] * 10**lower) if len(arcs) else p, np.log10(left)

    def score(self, hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log weight of each token without the base of tokens outside ``words``, and word ids."""
        n = max(len(self.words), 1)
        ids = _find(self.words, hashes.view(np.int64))
        out = np.where(ids >= 0, self.base[ids], 0.0) if len(self.words) else np.zeros(len(ids))
        before = np.full(len(ids), -1)
        before[1:] = np.where(owner[1:] == owner[:-1], ids[:-1], -1)
        one = np.flatnonzero(before >= 0)
        bigram = np.full(len(ids), -1)
        both = one[ids[one] >= 0]
        bigram[both] = _find(self.two, before[both] * n + ids[both])
        hit = bigram[one] >= 0
        if len(self.two):
            out[one] = np.where(hit, self.two_arc[bigram[one]], self.fail_one[before[one]] + out[one])
        history = np.full(len(ids), -1)
        history[1:] = np.where(owner[1:] == owner[:-1], bigram[:-1], -1)
        if len(self.three):
            two = np.flatnonzero(history >= 0)
            two = two[self.has_two[history[two]]]
            arc = np.where(ids[two] >= 0, _find(self.three, history[two] * n + ids[two]), -1)
            out[two] = np.where(arc >= 0, self.three_arc[arc], self.fail_two[history[two]] + out[two])
        return out, ids


def train(docs: DataFrame, scratch: Scratch, share: float = SHARE) -> tuple[DataFrame, Automaton]:
    """The table of all token counts (key, c), and the automaton of the frequent n-grams of ``docs`` (text)."""
    spark = docs.sparkSession
    vocabulary = scratch.save(_counted(docs, lambda hashes, owner: hashes.view(np.int64)), "vocabulary")
    n_tokens, n_types = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    least = max(1, int(np.ceil(share * n_tokens)))

    def frequent(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:  # 1 / share rows at most
        got = counts.where(F.col("c") >= least).toPandas().sort_values("key")
        return got["key"].to_numpy(np.int64), got["c"].to_numpy(np.int64)

    words, counts = frequent(vocabulary)
    n, shared = max(len(words), 1), spark.sparkContext.broadcast(words)

    def pair_codes(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
        ids = _find(shared.value, hashes.view(np.int64))
        ok = (ids[:-1] >= 0) & (ids[1:] >= 0) & (owner[:-1] == owner[1:])
        return ids[:-1][ok] * n + ids[1:][ok]

    two, two_counts = frequent(_counted(docs, pair_codes))
    pairs = spark.sparkContext.broadcast(two)

    def triple_codes(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
        ids = _find(shared.value, hashes.view(np.int64))
        known = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0) & (owner[:-1] == owner[1:]))
        bigram = np.full(len(ids), -1)
        bigram[known] = _find(pairs.value, ids[known] * n + ids[known + 1])
        ok = (bigram[:-1] >= 0) & (bigram[1:] >= 0)
        return bigram[:-1][ok] * n + ids[np.flatnonzero(ok) + 2]

    three, three_counts = frequent(_counted(docs, triple_codes))
    return vocabulary, Automaton(n_tokens, n_types, words, counts, two, two_counts, three, three_counts)


def score(docs: DataFrame, vocabulary: DataFrame, automaton: Automaton, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    A null text counts as empty and has the end token only. Rows that repeat an id are
    scored one by one. ``docs`` must replay the same rows in the same order (a stored table
    does). Extra columns are ignored; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(automaton)
    kind = docs.schema[id_col].dataType

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = model.value
        rare_base = np.log10(1 / (a.n_tokens + a.n_types + 1))
        for batch in batches:
            rows = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, found in each_slice(batch.column(2), lower=True):
                hashes, owner = tokens(found)
                weight, ids = a.score(hashes, owner)
                size = np.bincount(owner, minlength=hi - lo)
                rare = ids < 0
                n_rare = np.bincount(owner[rare], minlength=hi - lo)
                known = ~rare
                base = np.bincount(owner[known], a.base[ids[known]], hi - lo) + n_rare * rare_base if len(a.base) else n_rare * rare_base
                total = np.bincount(owner, weight, hi - lo) + n_rare * rare_base
                n_known = size - n_rare
                pair = np.stack([owner[rare], hashes[rare].view(np.int64)], 1)
                order = np.lexsort([pair[:, 1], pair[:, 0]])
                pair = pair[order]
                edge = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]).any(1)])) if len(pair) else np.zeros(0, np.int64)
                times = np.diff(np.append(edge, len(pair)))
                own = np.concatenate([np.arange(hi - lo), pair[edge, 0]])
                token = np.concatenate([mix64(rows[lo:hi].astype(np.uint64)).view(np.int64), pair[edge, 1]])
                head = np.arange(len(own)) < hi - lo
                put = lambda x, t: pa.array(np.concatenate([x, np.zeros(len(edge), x.dtype)]), t, mask=~head)
                names = pa.concat_arrays([batch.column(1).slice(lo, hi - lo), pa.nulls(len(edge), batch.column(1).type)])
                yield pa.RecordBatch.from_arrays([
                    pa.array(rows[lo + own]), names, pa.array(token), pa.array(np.where(head, 0, np.concatenate([np.zeros(hi - lo, np.int64), times]))),
                    put(size, pa.int64()), put(n_known, pa.int64()), put(base, pa.float64()), put(total, pa.float64()),
                ], ["row", "doc_id", "token", "times", "n_tokens", "n_known", "base", "total"])

    schema = f"row bigint, doc_id {kind.simpleString()}, token bigint, times bigint, n_tokens bigint, n_known bigint, base double, total double"
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(walked, schema)
    seen = rows.join(vocabulary, rows["token"] == vocabulary["key"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    gain = F.col("times") * F.log10(F.col("c") + 1)
    sums = seen.groupBy("row").agg(
        F.first("doc_id", ignorenulls=True).alias("doc_id"), F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.coalesce("n_known", F.lit(0)) + F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("n_known"),
        F.sum(F.coalesce("base", F.lit(0.0)) + gain).alias("base_score"), F.sum(F.coalesce("total", F.lit(0.0)) + gain).alias("score"),
    )
    return sums.select("doc_id", "n_tokens", "n_known", F.lit(automaton.n_tokens).cast("bigint").alias("train_tokens"), "base_score", "score")


def _joined(h: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Identity of the n-gram whose first n - 1 words are ``h`` and last n - 1 words are ``part``."""
    return mix64(mix64(h) + part * np.uint64(0x9E3779B97F4A7C15))


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """A bucket for each key, rising with it."""
    return ((keys.view(np.uint64) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _blocks(bucket: np.ndarray, columns: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """The buckets (sorted) that occur, and for each its columns of 64 bits, packed one after the other."""
    edge = np.flatnonzero(np.diff(bucket, prepend=-1))
    return pa.array(bucket[edge], pa.int32()), pa.array([columns[:, i:j].tobytes() for i, j in zip(edge, np.append(edge[1:], len(bucket)), strict=False)], pa.binary())


def _sent(bucket: np.ndarray, own: np.ndarray, key: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Like ``_blocks``, of documents in 32 bits and keys in 64."""
    edge = np.flatnonzero(np.diff(bucket, prepend=-1))
    return pa.array(bucket[edge], pa.int32()), pa.array([key[i:j].tobytes() + own[i:j].tobytes() for i, j in zip(edge, np.append(edge[1:], len(bucket)), strict=False)], pa.binary())


def _received(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Documents and keys of a block of ``_sent``."""
    n = len(data) // 12
    return np.frombuffer(data, np.uint32, n, 8 * n), np.frombuffer(data, np.uint64, n)


def _unpacked(data: pa.ChunkedArray, columns: int) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_py(), np.uint64).reshape(columns, -1) for x in data], 1)


def _summed(u: np.ndarray, v: np.ndarray, w: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct triples (u, v, w) with their counts and identities (key, pair)."""
    pair = _joined(v, w)
    key = _joined(_joined(u, v), pair)
    order = np.argsort(key)
    edge = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0])) if len(key) else np.zeros(0, np.int64)
    c = np.add.reduceat(c[order], edge) if len(edge) else c
    first = order[edge]
    return u[first], v[first], w[first], c, key[first], pair[first]


def _by_bucket(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that brings keys together by bucket and else leaves them as they are, and their buckets in it."""
    bucket = _bucket(keys, buckets)
    order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")  # 16 bits are sorted by their digits
    return order, bucket[order]


def _repeated(docs: DataFrame, least: int, buckets: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The n-grams of two and of three words that occur ``least`` times, as key, h, part and c: identities of the whole and of its parts.

    A token is counted with the two before it, in the bucket of the last two, so one shuffle
    counts both orders. Each task adds up FLUSH_ROWS of them before, so a frequent n-gram
    reaches its bucket no more often than that.
    """

    def counts(turn: int) -> DataFrame:
        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[np.ndarray] = []

            def block() -> pa.RecordBatch:
                u, v, w, c, _, pair = _summed(*np.concatenate(held, 1), np.ones(sum(x.shape[1] for x in held), np.uint64))
                order, bucket = _by_bucket(pair, buckets)
                return pa.RecordBatch.from_arrays(list(_blocks(bucket, np.stack([u, v, w, c])[:, order])), ["bucket", "data"])

            for batch in batches:
                for _, _, found in each_slice(batch.column(0), lower=True):
                    hashes, owner = tokens(found)
                    before = np.concatenate([[NONE, NONE], np.where(owner[2:] == owner[:-2], hashes[:-2], NONE)])[: len(hashes)]
                    mine = 1 + np.flatnonzero(owner[1:] == owner[:-1])
                    mine = mine[_bucket(_joined(hashes[mine - 1], hashes[mine]), buckets) % PASSES == turn]
                    held.append(np.stack([before[mine], hashes[mine - 1], hashes[mine]]))
                    if sum(x.shape[1] for x in held) > FLUSH_ROWS:
                        yield block()
                        held.clear()
            if held:
                yield block()

        def counted(table: pa.Table) -> pa.Table:
            sums = _summed(*_unpacked(table["data"], 4))
            by_pair = np.argsort(sums[-1])
            u, v, w, c, key, pair = (x[by_pair] for x in sums)
            edge = np.flatnonzero(np.concatenate([[True], np.diff(pair) != 0]))
            both = np.add.reduceat(c, edge)
            two, three = edge[both >= least], np.flatnonzero((c >= least) & (u != NONE))
            columns = [np.concatenate(x) for x in ((pair[two], key[three]), (v[two], _joined(u, v)[three]), (w[two], pair[three]), (both[both >= least], c[three]))]
            return pa.table([pa.array(np.repeat([2, 3], [len(two), len(three)]), pa.int32()), *(pa.array(x.view(np.int64)) for x in columns)], names=["words", "key", "h", "part", "c"])

        return docs.select("text").mapInArrow(packed, "bucket int, data binary").groupBy("bucket").applyInArrow(counted, "words int, key bigint, h bigint, part bigint, c bigint")

    grams = functools.reduce(DataFrame.unionByName, [scratch.save(counts(turn), f"grams-{turn}") for turn in range(PASSES)])
    return grams.where("words = 2").drop("words"), grams.where("words = 3").drop("words")


@dataclass
class Whole:
    """The gains of all n-grams that count (key, gain, base, known), and those of the frequent ones as sorted arrays.

    ``base`` is what a token is above an unseen one, and ``known`` 1 for words.
    """

    n_tokens: int
    n_types: int
    buckets: int
    gains: DataFrame
    head: np.ndarray
    head_values: np.ndarray  # gain, base, known of each


def train_whole(docs: DataFrame, scratch: Scratch, least: int = LEAST, share: float = SHARE) -> Whole:
    """The model of all words of ``docs`` (text) and all longer n-grams that occur ``least`` times."""
    vocabulary = scratch.save(_counted(docs, lambda hashes, owner: hashes.view(np.int64)), "vocabulary")
    n_tokens, n_types = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    unseen = 1.0 / (n_tokens + n_types + 1)
    none = float(np.log10(unseen))

    def states(grams: DataFrame, longer: DataFrame) -> DataFrame:
        """Add ``left``, the mass that the arcs of each n-gram leave; null where it has no arcs."""
        taken = longer.groupBy("h").agg(F.sum("c").alias("taken"), F.count(F.lit(1)).alias("arcs")).withColumnRenamed("h", "key")
        left = (F.col("c") - F.col("taken") + F.col("arcs") * DISCOUNT) / F.col("c")
        return grams.join(taken.hint("shuffle_hash"), "key", "left").withColumn("left", left).drop("taken", "arcs")

    def arcs(grams: DataFrame, shorter: DataFrame, name: str, *done: str) -> DataFrame:
        """Add ``q``, the probability of the arc, and ``gain``. An n-gram that counts has parts that count. Tables ``done`` go when ``grams`` is read."""
        history, lower = shorter.select(F.col("key").alias("h"), F.col("c").alias("total"), F.col("left").alias("spare")), shorter.select(F.col("key").alias("part"), F.col("q").alias("lower"))
        grams = scratch.save(grams.join(history.hint("shuffle_hash"), "h").withColumn("share", (F.col("c") - DISCOUNT) / F.col("total")).drop("h", "total"), f"{name}-shares")
        scratch.drop(*done)
        way = F.col("spare") * F.col("lower")
        grams = grams.join(lower.hint("shuffle_hash"), "part").withColumns({"q": F.col("share") + way, "gain": F.log10((F.col("share") + way) / way)})
        return scratch.save(grams.drop("part", "lower", "share", "spare", *(() if "left" in grams.columns else ("q",))), name)  # the longest are no part of others

    buckets = max(1, -(-n_tokens // BUCKET_TOKENS))
    two, three = _repeated(docs, least, buckets, scratch)
    one = vocabulary.withColumn("q", (F.col("c") + 1) * unseen).withColumn("gain", F.log10("q") - none)
    one = scratch.save(states(one, two), "one")
    scratch.drop("vocabulary")
    two = arcs(scratch.save(states(two, three), "two-left"), one, "two", "two-left")
    scratch.drop("two-shares")
    three = arcs(three, two, "three", *(f"grams-{turn}" for turn in range(PASSES)))
    scratch.drop("three-shares")
    failing = F.coalesce(F.log10("left"), F.lit(0.0))
    gains = one.select("key", "c", (F.col("gain") + failing).alias("gain"), F.col("gain").alias("base"), F.lit(1.0).alias("known"))
    for longer, own in ((two, failing), (three, F.lit(0.0))):
        gains = gains.unionByName(longer.select("key", "c", (F.col("gain") + own).alias("gain"), F.lit(0.0).alias("base"), F.lit(0.0).alias("known")))
    top = gains.where(F.col("c") >= max(least, int(np.ceil(share * n_tokens)))).toPandas().sort_values("key")  # 1 / share rows of each order at most
    return Whole(n_tokens, n_types, buckets, gains.drop("c"), top["key"].to_numpy(np.int64), top[["gain", "base", "known"]].to_numpy(float))


def score_whole(docs: DataFrame, model: Whole, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Like ``score``, by all n-grams of ``model``.

    Each slice of texts sends its n-grams, packed, to the buckets that hold their gains; what
    comes back is added up for each document. Frequent n-grams are looked up in the broadcast
    head on the spot, so a bucket has no hot key.
    """
    shared, buckets = docs.sparkSession.sparkContext.broadcast((model.head, model.head_values)), -(-2 * model.buckets // 3)  # wider ones than of counting: each returns a row for nearly every document
    least = F.lit(float(np.log10(1 / (model.n_tokens + model.n_types + 1))))

    def emitted(turn: int):  # noqa: ANN202
        """The n-grams of each slice that are in a bucket of this turn, and what the head gives for them; in the first turn also the tokens."""

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lookup, values = Lookup(shared.value[0]), shared.value[1]
            for batch in batches:
                rows = batch.column(0).to_numpy(zero_copy_only=False)
                for lo, hi, found in each_slice(batch.column(1), lower=True):
                    hashes, owner = tokens(found)
                    owner, n = owner.astype(np.uint32), hi - lo
                    one, pair = owner[1:] == owner[:-1], _joined(hashes[:-1], hashes[1:])
                    two = one[1:] & one[:-1]
                    keys, owners = [], []
                    for key, own in ((hashes, owner), (pair[one], owner[1:][one]), (_joined(pair[:-1][two], pair[1:][two]), owner[2:][two])):
                        mine = np.flatnonzero(_bucket(key, buckets).astype(np.uint32) % np.uint32(MEETINGS) == turn)
                        keys.append(key[mine])
                        owners.append(own[mine])
                    key, own = np.concatenate(keys), np.concatenate(owners)
                    at = lookup.find(key)
                    rest = np.flatnonzero(at < 0)
                    order, bucket = _by_bucket(key[rest], buckets)
                    names, data = _sent(bucket, own[rest[order]], key[rest[order]])
                    yield pa.RecordBatch.from_arrays([names, pa.array(np.full(len(names), rows[lo])), data, pa.nulls(len(names), pa.binary())], ["bucket", "slice", "grams", "sums"])
                    hit = np.flatnonzero(at >= 0)
                    sums = [np.bincount(own[hit], values[at[hit], k] if len(values) else None, n) for k in range(3)]
                    sums = np.stack([np.arange(n), *sums, np.diff(found.first) + 1 if turn == 0 else np.zeros(n)]).astype(float)
                    yield pa.RecordBatch.from_arrays([pa.array([int(rows[lo] % buckets)], pa.int32()), pa.array(rows[lo : lo + 1]), pa.nulls(1, pa.binary()), pa.array([sums.tobytes()], pa.binary())], ["bucket", "slice", "grams", "sums"])

        return emit

    def met(gains: pa.Table, texts: pa.Table) -> pa.Table:
        lookup, gain, base, known = Lookup(gains["key"].to_numpy()), gains["gain"].to_numpy(), gains["base"].to_numpy(), gains["known"].to_numpy() > 0
        out = []
        for data, sums in zip(texts["grams"], texts["sums"], strict=True):
            if sums.is_valid:
                out.append(sums.as_py())
                continue
            own, key = _received(data.as_py())
            at = lookup.find(key)
            hit = np.flatnonzero(at >= 0)
            mine, found = own[hit], at[hit]
            docs, word = np.flatnonzero(np.bincount(mine)), np.flatnonzero(known[found])  # only words have a base
            size = docs[-1] + 1 if len(docs) else 0
            sums = (np.bincount(mine, gain[found], size), np.bincount(mine[word], base[found[word]], size), np.bincount(mine[word], minlength=size))
            out.append(np.stack([docs, *(x[docs] for x in sums), np.zeros(len(docs))]).astype(float).tobytes())
        return pa.table([texts["slice"], pa.array(out, pa.binary())], names=["slice", "data"])

    def added(table: pa.Table) -> pa.Table:
        own, *values = _unpacked(table["data"], 5).view(np.float64)
        docs, place = np.unique(own.astype(np.int64), return_inverse=True)
        return pa.table([pa.array(docs + table["slice"][0].as_py()), *(pa.array(np.bincount(place, v, len(docs)).astype(float)) for v in values)], names=["row", "total", "above", "n_known", "n_tokens"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    table = model.gains.withColumn("bucket", F.shiftright(F.shiftrightunsigned("key", 32) * F.lit(buckets).cast("bigint"), 32).cast("int"))
    sums = []
    for turn in range(MEETINGS):
        mine = table.where(F.col("bucket") % MEETINGS == turn).groupBy("bucket")
        texts = rows.mapInArrow(emitted(turn), "bucket int, slice bigint, grams binary, sums binary").groupBy("bucket")
        sums.append(scratch.save(mine.cogroup(texts).applyInArrow(met, "slice bigint, data binary"), f"met-{turn}"))
    scored = functools.reduce(DataFrame.unionByName, sums).groupBy("slice").applyInArrow(added, "row bigint, total double, above double, n_known double, n_tokens double")
    scored = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id")).join(scored, "row")
    return scored.select(
        "doc_id", F.col("n_tokens").cast("bigint").alias("n_tokens"), F.col("n_known").cast("bigint").alias("n_known"), F.lit(model.n_tokens).cast("bigint").alias("train_tokens"),
        (F.col("above") + F.col("n_tokens") * least).alias("base_score"), (F.col("total") + F.col("n_tokens") * least).alias("score"),
    )
