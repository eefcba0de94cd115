"""Toxicity by a subsequence string-kernel SVM with Nystroem landmarks.

A text is cut at white space into spans; runs of single-letter spans ("i d i o t") also make
one span. A span's subsequences are its letter triples that lie within REACH characters of
each other, each weighing DECAY for every character skipped: letters, digits that stand for
letters, or inserted signs, which are never part of a triple themselves. The kernel of two spans
is the product of their triple weights, summed over equal triples and divided by the spans'
norms, whatever their lengths. A support vector machine over kernel values with MOST_LANDMARKS landmark spans at most, whitened by the
inverse root of the landmarks' own kernel matrix (Nystroem), separates insults from other spans.

As the kernel is a sum over triples, the machine's landmark weights collapse exactly into
one weight a triple, and scoring is a table lookup.

Labels are for documents, not spans. Training is for multiple instances: each document
offers the spans that look worst to the current model; those of clean documents are clean,
and of each toxic document the worst is toxic, as are others that toxic documents offer
often. The first model is the log-odds of triples. A document's score is a logistic
regression on its three worst spans, how many spans are toxic and how many there are.
Learning uses at most TRAIN_ROWS labelled documents, those with the smallest hashes of ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldspar.llm.quality import labelled_texts
from veldspar.llm.textkit import Words, each_slice, mix64

TRAIN_ROWS = 20_000
MOST_LANDMARKS = 256
OFFERED = 4
ROUNDS = 3
DECAY, REACH = 0.6, 5
LONG = 4096  #: A longer span's triples are counted for itself, in pieces of PIECE characters; its kernel is like any other's.
PIECE = 1 << 18
TAUGHT = 256  #: Bytes of the longest span that is learned from; such spans reach the driver.
SYMBOLS = 64
TOP = 3
FLOOR = 3.0
PARTS = 1 << 30  #: Shares are summed as integers, so the order of tasks does not matter.
SUMMARY = ("worst", "second", "third", "toxic_spans", "spans")

#: Signs that are written for letters.
STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}

EDGE = 63  #: The symbol of a span's beginning and end.

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[ord("a") : ord("z") + 1] = np.arange(1, 27)
for _sign, _letter in STANDS_FOR.items():
    _SYMBOL[ord(_sign)] = _SYMBOL[ord(_letter)]
_PAIRS = [(j, k) for j in range(1, REACH) for k in range(j + 1, REACH)]
_WEIGHTS = np.array([DECAY ** (k - 2) for _, k in _PAIRS])


def symbols(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbol of each character, and for each byte place the number of characters before it.

    Letters a to z and signs that stand for them are 1 to 26, characters beyond ASCII are
    hashed to 27 to 62, all others are 0.
    """
    heads = (data & 0xC0) != 0x80
    before = np.concatenate([[0], np.cumsum(heads)])
    at = np.flatnonzero(heads)
    out = _SYMBOL[data[at]]
    wide = np.flatnonzero(data[at] >= 0xC0)
    if len(wide):
        place = at[wide]
        code = data[place].astype(np.int64)
        for k in (1, 2, 3):
            follow = np.minimum(place + k, len(data) - 1)
            more = (place + k < len(data)) & (before[follow + 1] == before[place + 1])
            code = np.where(more, code * 131 + data[follow], code)
        out[wide] = 27 + code % 36
    return out, before


def triples(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Span, triple and summed weight of the distinct gapped letter triples of the spans, their edges included."""
    long = end - start > LONG
    rows = np.flatnonzero(~long)
    out = [(rows[o], t, w) for o, t, w in [_short(data, start[rows], end[rows])]]
    for k in np.flatnonzero(long):
        total = _whole(data[start[k] : end[k]])
        found = np.flatnonzero(total)
        out.append((np.full(len(found), k), found, total[found]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _gapped(symbol: np.ndarray, left: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each pair of gaps the places where a triple starts, the triples and their weight. ``left``: symbols of the span from each place on."""
    for j, k in _PAIRS:
        n = max(len(symbol) - k, 0)
        ok = np.flatnonzero((symbol[:n] > 0) & (left[:n] > k if left is not None else True))
        ok = ok[(symbol[ok + j] > 0) & (symbol[ok + k] > 0)]
        yield ok, (symbol[ok] * SYMBOLS + symbol[ok + j]) * SYMBOLS + symbol[ok + k], DECAY ** (k - 2)


def _short(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``triples`` of spans that are taken all at once."""
    letters, before = symbols(data)
    first = before[start]
    size = before[end] - first + 2
    owner = np.repeat(np.arange(len(start)), size)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    left = size[owner] - offset
    symbol = np.full(len(owner), EDGE)
    inner = (offset > 0) & (left > 1)
    symbol[inner] = letters[(first[owner] + offset - 1)[inner]]
    found = [(owner[ok] * SYMBOLS**3 + triple) * len(_PAIRS) + n for n, (ok, triple, _) in enumerate(_gapped(symbol, left))]
    key, code = np.divmod(np.sort(np.concatenate(found)), len(_PAIRS))
    edge = np.flatnonzero(np.diff(key, prepend=-1))
    owner, triple = np.divmod(key[edge], SYMBOLS**3)
    return owner, triple, np.add.reduceat(_WEIGHTS[code], edge) if len(edge) else np.zeros(0)


def _whole(data: np.ndarray) -> np.ndarray:
    """Summed weight of each triple of one span. Pieces overlap by what a triple can reach, so each triple is seen once."""
    letters, _ = symbols(data)
    symbol = np.concatenate([[EDGE], letters, [EDGE]])
    total = np.zeros(SYMBOLS**3)
    for at in range(0, len(symbol), PIECE):
        for ok, triple, weight in _gapped(symbol[at : at + PIECE + REACH - 1], None):
            total += np.bincount(triple[ok < PIECE], minlength=SYMBOLS**3) * weight
    return total


def spans(found: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts, ends and documents of the distinct spans of each document of a slice.

    Runs of at least three single-byte words are appended to the bytes as spans of their own.
    """
    start, end = found.start, found.end
    doc = np.repeat(np.arange(len(found.first) - 1), np.diff(found.first))
    data, extra = found.data, []
    single = (end - start == 1) & (_SYMBOL[data[start]] > 0) if len(start) else np.zeros(0, bool)
    other = np.diff(doc, prepend=-1) != 0  # a run ends with its document
    begins = single & (other | ~np.append(False, single[:-1])) if len(single) else single
    stops = single & (np.append(other[1:], True) | ~np.append(single[1:], False)) if len(single) else single
    begin, stop = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    long_run = stop - begin >= 3
    for a, b in zip(begin[long_run], stop[long_run], strict=True):
        extra.append((data[start[a:b]], doc[a]))
    hashes = found.hashes()
    key = mix64(hashes + mix64(doc.astype(np.uint64)))
    kept = np.sort(np.unique(key, return_index=True)[1]) if len(key) else np.zeros(0, np.int64)
    start, end, doc = start[kept], end[kept], doc[kept]
    if extra:
        tail = np.concatenate([e for e, _ in extra])
        size = np.array([len(e) for e, _ in extra])
        stop = len(data) + np.cumsum(size)
        data = np.concatenate([data, tail])
        start, end, doc = np.append(start, stop - size), np.append(end, stop), np.append(doc, [d for _, d in extra])
    return data, start, end, doc


@dataclass
class Machine:
    """Weights of triples and the intercept; of documents, weights of SUMMARY and their intercept."""

    weights: np.ndarray
    intercept: float
    summary: np.ndarray
    shift: float

    def spans(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        owner, triple, weight = triples(data, start, end)
        value = np.bincount(owner, weight * self.weights[triple], len(start))
        norm = np.sqrt(np.bincount(owner, weight * weight, len(start)))
        return value / np.maximum(norm, 1e-9) + self.intercept

    def documents(self, found: Words) -> np.ndarray:
        """SUMMARY of each document: its three greatest span values, how many are toxic, and how many there are.

        Places beyond the last span hold the intercept, or 0 if that is less; in a document without spans they hold -FLOOR.
        """
        data, start, end, doc = spans(found)
        n = len(found.first) - 1
        out = np.zeros((n, len(SUMMARY)))
        out[:, :TOP] = -FLOOR
        if len(start):
            out[np.unique(doc), :TOP] = min(self.intercept, 0.0)
            uniq, back = _distinct(data, start, end)
            value = self.spans(data, start[uniq], end[uniq])[back]
            order = np.lexsort([-value, doc])
            rank = np.arange(len(order)) - np.searchsorted(doc[order], doc[order])
            best = order[rank < TOP]
            out[doc[best], rank[rank < TOP]] = value[best]
            out[:, TOP] = np.log1p(np.bincount(doc[value > 0], minlength=n))
            out[:, TOP + 1] = np.log1p(np.bincount(doc, minlength=n))
        out[:, :TOP] = np.clip(out[:, :TOP], -FLOOR, FLOOR)
        return out

    def probability(self, summary: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(summary @ self.summary + self.shift, -30, 30)))


def _distinct(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each distinct span, and which of them each span is."""
    order = np.argsort(start, kind="stable")
    key = np.empty(len(start), np.uint64)
    key[order] = Words(data, np.array([0, len(data)]), start[order], end[order], np.zeros(0)).hashes()
    _, first, back = np.unique(key, return_index=True, return_inverse=True)
    return first, back


def _kernel_rows(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, triple, weight) of unit-norm triple weights of strings."""
    raw = [t.encode("utf-8") for t in texts]
    size = np.array([len(r) for r in raw], np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    owner, triple, weight = triples(data, np.cumsum(size) - size, np.cumsum(size))
    norm = np.sqrt(np.bincount(owner, weight * weight, len(raw)))
    return owner, triple, weight / np.maximum(norm, 1e-9)[owner]


def kernel(left: list[str], right: list[str]) -> np.ndarray:
    """Kernel values of two lists of spans."""
    owner, triple, weight = _kernel_rows(right)
    known = np.unique(triple)  # other triples add nothing
    table = np.zeros((len(known), len(right)))
    np.add.at(table, (np.searchsorted(known, triple), owner), weight)
    out = np.zeros((len(left), len(right)))
    owner, triple, weight = _kernel_rows(left)
    at = np.searchsorted(known, triple)
    hit = np.flatnonzero(known[np.minimum(at, len(known) - 1)] == triple) if len(known) else np.zeros(0, np.int64)
    hit = hit[np.argsort(owner[hit], kind="stable")]
    edges = np.searchsorted(owner[hit], np.arange(len(left) + 1))
    for i in range(len(left)):
        rows = hit[edges[i] : edges[i + 1]]
        if len(rows):
            out[i] = weight[rows] @ table[at[rows]]
    return out


def _fit(texts: list[str], labels: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, float]:
    """Triple weights and intercept of the machine for labelled spans; ``share`` orders the toxic landmarks."""
    toxic = sorted({t: s for t, y, s in zip(texts, labels, share, strict=True) if y}.items(), key=lambda x: (-x[1], x[0]))
    clean = sorted({t for t, y in zip(texts, labels, strict=True) if not y} - {t for t, _ in toxic})
    half = MOST_LANDMARKS // 2
    marks = [t for t, _ in toxic[:half]] + clean[:: max(1, len(clean) // half)][:half]
    own = kernel(marks, marks)
    values, vectors = np.linalg.eigh(own)
    good = values > 1e-6 * max(values.max(), 1e-12)
    white = vectors[:, good] / np.sqrt(values[good])
    x = kernel(texts, marks) @ white
    y = np.where(labels, 1.0, -1.0)
    cost = np.where(labels, (~labels).sum() / max(labels.sum(), 1), 1.0)
    cost = 10.0 * cost / cost.mean() / len(y)
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(30):  # Newton steps on the squared hinge; only rows inside the margin count
        gap = 1 - y * (x @ w + b)
        live = gap > 0
        z = np.column_stack([x[live], np.ones(live.sum())])
        c = 2 * cost[live]
        hess = z.T @ (z * c[:, None]) + np.diag([0.01] * x.shape[1] + [1e-9])
        new = np.linalg.solve(hess, z.T @ (c * y[live]))
        done = np.abs(new - np.append(w, b)).max() < 1e-8
        w, b = new[:-1], float(new[-1])
        if done:
            break
    owner, triple, weight = _kernel_rows(marks)
    return np.bincount(triple, weight * (white @ w)[owner], SYMBOLS**3), b


def _presence(texts: DataFrame) -> np.ndarray:
    """For clean and toxic documents, the summed shares of each document's spans that have each triple."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, SYMBOLS**3), np.int64)
        for batch in batches:
            labels = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, found in each_slice(batch.column(0), lower=True):
                data, start, end, doc = spans(found)
                if not len(start):
                    continue
                uniq, back = _distinct(data, start, end)
                owner, triple, _ = triples(data, start[uniq], end[uniq])
                share = np.rint(PARTS / np.bincount(doc, minlength=hi - lo).clip(1))
                for label in (0, 1):  # sums of a slice stay below 2**53, so they are exact
                    mass = np.bincount(back, share[doc] * (labels[lo:hi][doc] == label), len(uniq))
                    total[label] += np.bincount(triple, mass[owner], SYMBOLS**3).astype(np.int64)
        label, triple = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(triple, pa.int32()), pa.array(total[label, triple])], ["label", "triple", "n"])

    rows = texts.select("text", "label").mapInArrow(seen, "label int, triple int, n bigint").groupBy("label", "triple").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros((2, SYMBOLS**3))
    out[rows["label"], rows["triple"]] = rows["n"]
    return out / PARTS


def _offered(texts: DataFrame, machine: Machine, offered: int = OFFERED):  # noqa: ANN202
    """The worst spans of each training document: doc_id, label, span, value, ordered."""

    def worst(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            labels = batch.column(2).to_pylist()
            names = batch.column(0).to_pylist()
            for lo, _, found in each_slice(batch.column(1), lower=True):
                data, start, end, doc = spans(found)
                if not len(start):
                    continue
                uniq, back = _distinct(data, start, end)
                value = machine.spans(data, start[uniq], end[uniq])[back]
                order = np.lexsort([start, -value, doc])
                order = order[(end - start)[order] <= TAUGHT]
                rank = np.arange(len(order)) - np.searchsorted(doc[order], doc[order])
                for k in order[rank < offered]:
                    rows.append((names[lo + doc[k]], labels[lo + doc[k]], data[start[k] : end[k]].tobytes().decode("utf-8", "ignore"), float(value[k])))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.string(), pa.float64()), strict=True)], ["doc_id", "label", "span", "value"])

    got = texts.select("doc_id", "text", "label").mapInArrow(worst, "doc_id bigint, label int, span string, value double").toPandas()
    return got.sort_values(["doc_id", "value", "span"], ascending=[True, False, True], kind="stable")


def _summaries(texts: DataFrame, machine: Machine) -> tuple[np.ndarray, np.ndarray]:
    """SUMMARY and label of each training document."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, found in each_slice(batch.column(1), lower=True):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(list(machine.documents(found)), pa.list_(pa.float64()))], ["doc_id", "label", "x"])

    got = texts.select("doc_id", "text", "label").mapInArrow(summed, "doc_id bigint, label int, x array<double>").toPandas().sort_values("doc_id", kind="stable")
    return np.array(got["x"].tolist()).reshape(-1, len(SUMMARY)), got["label"].to_numpy(float)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and intercept of a ridge logistic regression, by Newton steps."""
    z = np.column_stack([x, np.ones(len(x))])
    w, ridge = np.zeros(z.shape[1]), np.diag([1.0] * x.shape[1] + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        move = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
        w = w + move
        if np.abs(move).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, rounds: int = ROUNDS) -> Machine:
    """A machine from at most ``rows`` labelled documents. Spans and summaries, not texts, reach the driver.

    With no labels, or labels of one kind only, every text gets the share of toxic labels.
    """
    texts = labelled_texts(docs, labels, "toxic", rows)
    n = {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    none = np.zeros(len(SUMMARY))
    if len(n) < 2:
        share = n.get(1, 0) / max(sum(n.values()), 1) if n else 0.0
        return Machine(np.zeros(SYMBOLS**3), 0.0, none, float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
    seen = _presence(texts)
    # Where toxic documents have a triple more often than clean ones; rare triples say little.
    weights = np.log((seen[1] + 1) / (n[1] + 100)) - np.log((seen[0] * n[1] / n[0] + 1) / (n[1] + 100))
    machine = Machine(np.where(seen.sum(0) > 0, weights, 0.0), 0.0, none, 0.0)
    for _ in range(rounds):
        got = _offered(texts, machine)
        clean = got[got["label"] == 0]
        against = clean["span"].value_counts() / n[0]
        toxic = got[got["label"] == 1]
        rate = toxic["span"].value_counts() / n[1]
        # A toxic document's worst span, and its others where they are toxic documents' own.
        own = rate.index.to_series().map(lambda s: rate[s] > 3 * against.get(s, 0.0))
        first = toxic.groupby("doc_id").head(1)
        some = sorted({s for s in first["span"] if own[s]} | {s for s in rate.index if own[s] and rate[s] * n[1] >= 3})
        other = sorted(set(clean["span"]) - set(some))
        if not some or not other:
            break
        spans_in, y = some + other, np.array([True] * len(some) + [False] * len(other))
        weights, intercept = _fit(spans_in, y, np.array([rate.get(t, 0.0) for t in spans_in]))
        machine = Machine(weights, intercept, none, 0.0)
    summary, shift = _logistic(*_summaries(texts, machine))
    return Machine(machine.weights, machine.intercept, summary, shift)


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score, the probability that the text is toxic.

    A text that is null, empty or without words gets a low score of its own. Texts and spans
    of any length are scored whole, in time about linear in the length; equal texts have equal
    scores. Repeated rows give repeated rows; extra columns are ignored; an empty table gives
    an empty table.
    """

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, found in each_slice(batch.column(1), lower=True):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(machine.probability(machine.documents(found)))], ["doc_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scored, f"doc_id {kind}, score double")
