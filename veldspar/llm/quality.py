"""Quality rules: gradient-boosted trees over document statistics.

The statistics come from whole texts in numpy. The trees are grown on a sample of at most
TRAIN_ROWS labelled rows, those with the smallest hashes of their ids, with histogram
splits and logistic loss; on the features of MONOTONE a split may only lower the score as
the feature grows. Trees are flattened into node arrays, and scoring walks all documents
through all trees at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldspar.llm.scratch import Scratch
from veldspar.llm.textkit import Words, each_slice, mix64

TRAIN_ROWS = 20_000
TREES, DEPTH, RATE, BINS, LEAST_ROWS = 40, 3, 0.2, 64, 10
WINDOW = 8
SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "mean_word", "symbols_per_word", "dup_lines", "repeat_words", "distinct_words", "lines_per_word", "upper", "digits", "ended_lines")
MONOTONE = {"symbols_per_word": -1, "dup_lines": -1, "repeat_words": -1}

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True


def _per(mark: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many marks lie in each of the ranges that ``bounds`` cut."""
    total = np.concatenate([[0], np.cumsum(mark)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key occurs twice or more, and whether it has occurred before."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice, again = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    again[order[1:]] = same
    return twice, again


def statistics(found: Words) -> tuple[np.ndarray, np.ndarray]:
    """COUNTS (integers) and FEATURES (floats) of each document of a slice."""
    data, bounds, n = found.data, found.bounds, len(found.bounds) - 1
    first, n_words = found.first, np.diff(found.first)
    hashes = found.hashes()
    letters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    in_words = np.concatenate([[0], np.cumsum(letters[found.end] - letters[found.start])])
    word_chars = in_words[first[1:]] - in_words[first[:-1]]
    symbols = _per(_IS_SYMBOL[data], bounds)

    line_mark = np.zeros(len(data) + 1, bool)
    line_mark[np.flatnonzero(data == 0x0A) + 1] = True
    line_mark[bounds[:-1]] = True
    line_start = np.flatnonzero(line_mark[:-1])
    line_end = np.append(line_start[1:], len(data))
    line_doc = np.searchsorted(bounds, line_start, side="right") - 1
    bare_end = np.where((line_end > line_start) & (data[np.maximum(line_end - 1, 0)] == 0x0A), line_end - 1, line_end) if len(line_start) else line_end
    words_in_line = np.searchsorted(found.start, line_end) - np.searchsorted(found.start, line_start)
    as_words = Words(data, bounds, line_start, bare_end, np.zeros(0, np.int64))
    with_word = words_in_line > 0
    line_key = mix64(as_words.hashes() + mix64(line_doc.astype(np.uint64) + np.uint64(1)))[with_word]
    _, again = _repeated(line_key)
    dup_lines = np.bincount(line_doc[with_word][again], minlength=n)
    lines = np.bincount(line_doc[with_word], minlength=n)
    last = data[found.end[np.searchsorted(found.start, line_end[with_word]) - 1] - 1] if with_word.any() else np.zeros(0, np.uint8)
    ended = np.bincount(line_doc[with_word][np.isin(last, np.frombuffer(b".!?:;\"')", np.uint8))], minlength=n)

    word_doc = np.repeat(np.arange(n), n_words)
    salt = mix64(word_doc.astype(np.uint64) + np.uint64(7))
    own = mix64(hashes + salt)
    distinct = n_words - np.bincount(word_doc[_repeated(own)[1]], minlength=n)
    repeat = np.zeros(n, np.int64)
    count = len(hashes) - WINDOW + 1
    if count > 0:
        window = salt[:count].copy()
        for k in range(WINDOW):
            window = mix64(window + hashes[k : count + k])
        inside = np.flatnonzero(word_doc[:count] == word_doc[WINDOW - 1 :])
        twice = inside[_repeated(window[inside])[0]]
        cover = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(cover, twice, 1)
        np.add.at(cover, twice + WINDOW, -1)
        repeat = np.bincount(word_doc[np.cumsum(cover[:-1]) > 0], minlength=n)

    upper = _per((data >= 0x41) & (data <= 0x5A), bounds)
    digits = _per((data >= 0x30) & (data <= 0x39), bounds)
    counts = np.stack([n_words, word_chars, symbols, dup_lines, repeat], 1).astype(np.int64)
    words, text_lines = np.maximum(n_words, 1), np.maximum(lines, 1)
    features = np.stack([np.log1p(n_words), word_chars / words, symbols / words, dup_lines / text_lines, repeat / words, distinct / words, lines / words, upper / words, digits / words, ended / text_lines], 1)
    return counts, features


@dataclass
class Trees:
    """Flattened trees: node i goes to ``left`` if its feature is at most ``cut``, else to ``left + 1``; leaves have feature -1."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of good quality for each row."""
        at = np.repeat(self.roots[None], len(x), 0)
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            f = self.feature[at]
            right = x[rows, np.maximum(f, 0)] > self.cut[at]
            at = np.where(f >= 0, self.left[at] + right, at)
        return 1 / (1 + np.exp(-(self.bias + self.value[at].sum(1))))


def grow(x: np.ndarray, y: np.ndarray, names: tuple[str, ...] = FEATURES, monotone: dict[str, int] = MONOTONE) -> Trees:
    """Fit trees to 0/1 labels. With no rows, or one label only, the score is its share.

    Monotonic constraints hold by refusing splits whose leaf values go the wrong way, and by
    keeping what grows below such a split on its side of the two values' midpoint.
    """
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    bias = float(np.log(share / (1 - share)))
    feature, cut, left, value, roots = [-1], [0.0], [0], [0.0], [0]
    if len(y) and 0 < y.mean() < 1:
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1)
        margin = np.full(len(y), bias)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            grad, curve = y - p, p * (1 - p)
            roots.append(len(feature))
            feature.append(-1), cut.append(0.0), left.append(0), value.append(0.0)
            todo = [(roots[-1], np.arange(len(y)), 0, -np.inf, np.inf)]
            while todo:
                node, rows, depth, low, high = todo.pop()
                g, h = grad[rows].sum(), curve[rows].sum()
                weight = float(np.clip(g / (h + 1), low, high))
                best = (1e-6, None)
                for f in range(x.shape[1]) if depth < DEPTH else ():
                    size = len(cuts[f]) + 1
                    gs = np.cumsum(np.bincount(binned[rows, f], grad[rows], size))[:-1]
                    hs = np.cumsum(np.bincount(binned[rows, f], curve[rows], size))[:-1]
                    ns = np.cumsum(np.bincount(binned[rows, f], minlength=size))[:-1]
                    a, b = np.clip(gs / (hs + 1), low, high), np.clip((g - gs) / (h - hs + 1), low, high)
                    gain = a * gs - a * a * (hs + 1) / 2 + b * (g - gs) - b * b * (h - hs + 1) / 2 - (weight * g - weight * weight * (h + 1) / 2)
                    ok = (ns >= LEAST_ROWS) & (len(rows) - ns >= LEAST_ROWS)
                    if sign := monotone.get(names[f], 0):
                        ok &= sign * (b - a) >= 0
                    if ok.any() and (top := np.where(ok, gain, -1).max()) > best[0]:
                        k = int(np.where(ok, gain, -1).argmax())
                        best = (top, (f, k, float(a[k]), float(b[k])))
                if best[1] is None:
                    value[node] = RATE * weight
                    margin[rows] += RATE * weight
                    continue
                f, k, a, b = best[1]
                feature[node], cut[node], left[node] = f, float(cuts[f][k]), len(feature)
                for _side in (0, 1):
                    feature.append(-1), cut.append(0.0), left.append(0), value.append(0.0)
                sign, middle = monotone.get(names[f], 0), (a + b) / 2
                goes = binned[rows, f] <= k
                below = (low, min(high, middle)) if sign > 0 else (max(low, middle), high) if sign < 0 else (low, high)
                above = (max(low, middle), high) if sign > 0 else (low, min(high, middle)) if sign < 0 else (low, high)
                todo.append((left[node], rows[goes], depth + 1, *below))
                todo.append((left[node] + 1, rows[~goes], depth + 1, *above))
    return Trees(np.array(feature), np.array(cut), np.array(left), np.array(value), np.array(roots), bias)


def sampled_labels(labels: DataFrame, column: str, rows: int) -> DataFrame:
    """doc_id and ``label`` of at most ``rows`` labelled rows, the smallest by a hash of the id; one label an id."""
    known = labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
    return known.orderBy(F.xxhash64("doc_id", F.lit(column)), "doc_id").limit(rows)


def labelled_texts(docs: DataFrame, labels: DataFrame, column: str, rows: int) -> DataFrame:
    """doc_id, text and label of at most ``rows`` labelled documents, stored once for all that learns from them.

    Of texts that share an id the least is taken, null only if there is no other.
    """
    chosen = sampled_labels(labels, column, rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # ``rows`` rows at most
    return Scratch(docs.sparkSession, f"labelled-{column}").save(texts.groupBy("doc_id", "label").agg(F.min("text").alias("text")), "texts")


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Trees:
    """Trees fitted to at most ``rows`` labelled documents. Their statistics, not their texts, reach the driver."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, found in each_slice(batch.column(1), lower=False):
                x = statistics(found)[1]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "label", "x"])

    got = labelled_texts(docs, labels, "quality", rows).select("doc_id", "text", "label").mapInArrow(measured, "doc_id bigint, label int, x array<double>").toPandas().sort_values("doc_id", kind="stable")
    x = np.array(got["x"].tolist(), float).reshape(-1, len(FEATURES))
    return grow(x, got["label"].to_numpy(float))


def judge(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, the COUNTS, and quality, the trees' score between 0 and 1.

    A null text has no words and is scored like an empty one. Texts are read whole, however
    long, and equal texts have equal scores. Repeated rows give repeated rows; extra columns are ignored; an empty table gives an empty table.
    """

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, found in each_slice(batch.column(1), lower=False):
                counts, x = statistics(found)
                columns = [pa.array(counts[:, k]) for k in range(len(COUNTS))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *columns, pa.array(trees.score(x))], ["doc_id", *COUNTS, "quality"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = ", ".join([f"doc_id {kind}", *(f"{c} bigint" for c in COUNTS), "quality double"])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(judged, schema)


def verdict(judged: DataFrame) -> DataFrame:
    """Add base_failed (too short or too repetitive) and kept."""
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return judged.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("quality") >= 0.5))
