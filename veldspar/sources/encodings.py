"""Encodings by byte pairs: which of several encodings bytes are most likely written in.

Texts are encoded every way; how often each byte follows each other makes a table of log probabilities for an
encoding, which is all that is learnt. Blocks of a file are scored on their own, in many tasks, and
the scores of a file are added up before it is decided, so a file may be of any size.

Where texts have a group, as their language, each group has tables of its own and a line is a mixture of the groups. So a lone
letter that pairs leave open is read as the rest of its line suggests. A space after a full stop is a byte of its own, as a capital
follows it. A word counts once a block, so an odd one doesn't outweigh the rest by being said often.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Candidates in order of preference: of equal scores, as pure ASCII has them, the first wins.
CANDIDATES = ("utf-8", "gb18030", "big5", "cp1252", "cp850", "mac_roman", "utf-16-le", "utf-16-be")
#: Pairs that begin at even places, then those at odd ones: so wide characters are told from each other by which byte comes first.
PAIRS = 2 << 16
#: Groups that have tables of their own, at most; the most frequent. All other texts are one more group.
GROUPS = 8
#: As many pairs after a byte as this, a group's table is half its own and half that of all texts.
PRIOR = 4.0
LINE = 10  #: The byte that begins a line; also stands before the first byte of a file.
SPACE, SENTENCE = 32, 30  #: A space that begins a sentence stands as a control byte that texts hardly have.
STOPS = np.array([46, 33, 63])


def _places(data: bytes, begins: bool) -> np.ndarray:
    """The pairs in their order, with that of the line begin and the first byte if the file ``begins`` with these bytes."""
    raw = np.frombuffer(data, np.uint8).astype(np.int64)
    if begins and len(raw):
        raw = np.concatenate([[LINE], raw])
    if len(raw):
        space = np.flatnonzero(raw[1:] == SPACE)
        raw[space[np.isin(raw[space], STOPS)] + 1] = SENTENCE
    pair = (raw[:-1] << 8) + raw[1:]
    pair[(0 if begins else 1) :: 2] += PAIRS // 2
    return pair


def _first(data: bytes) -> np.ndarray:
    """Which bytes are of a word that was not there before, or of the space or line end after it."""
    words = data.replace(b"\n", b" ").split(b" ")
    had: set[bytes] = set()
    fresh = [not (word in had or had.add(word)) for word in words]
    return np.repeat(fresh, [len(word) + 1 for word in words])[:-1]


@dataclass(frozen=True)
class Model:
    """Log probabilities of a byte after another, a row of PAIRS an encoding; with ``shares``, log shares of groups, such rows for each group."""

    encodings: tuple[str, ...]
    table: np.ndarray
    shares: np.ndarray | None = None

    def scores(self, data: bytes, begins: bool = False) -> np.ndarray:
        """Log likelihood of bytes in each encoding."""
        pair = _places(data, begins)
        if not len(pair):
            return np.zeros(len(self.encodings))
        if self.shares is None:
            held, counts = np.unique(pair, return_counts=True)
            return self.table[:, held] @ counts
        first = _first(data)[0 if begins else 1 :]
        line = np.cumsum((pair >> 8) & 255 == LINE)[first]
        pair, line = pair[first], np.flatnonzero(np.diff(line, prepend=-1))
        each = np.stack([[np.add.reduceat(row.take(pair), line) for row in rows] for rows in self.table]) + self.shares[:, None, None]
        return np.logaddexp.reduce(each, 0).sum(1)


def train(texts: DataFrame, text_col: str = "text", encodings: tuple[str, ...] = CANDIDATES, group_col: str | None = None) -> Model:
    """A model of all the texts. What an encoding can't write is left out of it.

    Pairs are counted within tasks; a row a group, encoding and pair reaches the driver, (GROUPS + 1) * len(encodings) * PAIRS at most.
    So do the groups, a row each and GROUPS at most.
    """
    group = F.lit("") if group_col is None else F.coalesce(F.col(group_col).cast("string"), F.lit(""))
    some = texts.select(F.col(text_col).alias("text"), group.alias("group")).where("text <> ''")
    own = [] if group_col is None else [r["group"] for r in some.groupBy("group").count().orderBy(F.desc("count"), "group").limit(GROUPS).collect()]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, place = np.zeros((len(own) + 1, len(encodings), PAIRS), np.int64), {g: k for k, g in enumerate(own)}
        for batch in batches:
            found = [place.get(g, len(own)) for g in batch.column(1).to_pylist()]
            for k, e in enumerate(encodings):
                pairs = [_places(text.encode(e, "ignore"), True) for text in batch.column(0).to_pylist()]
                for g in set(found):
                    total[g, k] += np.bincount(np.concatenate([p for p, at in zip(pairs, found, strict=True) if at == g]), minlength=PAIRS)
        g, k, pair = np.nonzero(total)
        columns = [pa.array(x.astype(np.int32)) for x in (g, k, pair)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(total[g, k, pair])], ["place", "encoding", "pair", "n"])

    found = some.mapInArrow(counted, "place int, encoding int, pair int, n bigint").groupBy("place", "encoding", "pair").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros((len(own) + 1, len(encodings), PAIRS))
    table[found["place"].to_numpy(int), found["encoding"].to_numpy(int), found["pair"].to_numpy(int)] = found["n"].to_numpy(float)
    narrow = [k for k, e in enumerate(encodings) if len("a".encode(e)) == 1]  # their pairs are the same wherever they begin
    table[:, narrow] = np.tile(table[:, narrow].reshape(len(own) + 1, len(narrow), 2, -1).sum(2), 2)
    each = table.reshape(len(own) + 1, len(encodings), 2 * 256, 256)
    whole = each.sum(0) + 0.01  # a pair never seen is unlikely, not impossible
    whole /= whole.sum(2, keepdims=True)
    if not own:
        return Model(encodings, np.log(whole).reshape(len(encodings), PAIRS))
    size = table[:, 0].sum(1)
    each = (each[size > 0] + PRIOR * whole) / (each[size > 0].sum(3, keepdims=True) + PRIOR)
    size = size[size > 0]
    return Model(encodings, np.log(each).reshape(-1, len(encodings), PAIRS), np.log(size / size.sum()))


def blocks_of(files: DataFrame, key: list[str], data_col: str = "data", size: int = 1 << 16) -> DataFrame:
    """Bytes (key, data) in blocks (key, block, data) of ``size`` bytes. Empty bytes are one empty block."""
    last = F.greatest(F.floor((F.octet_length(data_col) - 1) / size), F.lit(0)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), last), lambda k: F.substring(F.col(data_col), k * size + 1, F.lit(size)))
    return files.select(*key, F.posexplode(F.when(F.col(data_col).isNotNull(), parts)).alias("block", "data"))


def detect(blocks: DataFrame, key: list[str], model: Model) -> DataFrame:
    """One row per key: key, encoding. ``blocks`` has the key and data, parts of a file in any order.

    The encoding of the largest sum over all blocks is taken, of equal ones the first candidate. Pairs that
    a cut between blocks parts are not counted; blocks begin at even places of their file. If there is a column ``block``, block 0
    begins the file, and how likely its first byte begins a line is counted too. A key with no bytes, or null ones, gets the first candidate.
    """
    keys = [(f.name, f.dataType.simpleString()) for f in blocks.select(*key).schema]
    head, n = ", ".join(f"`{c}` {t}" for c, t in keys), len(key)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [model.scores(d or b"", b).tolist() for d, b in zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(out, pa.list_(pa.float64()))], [*key, "scores"])

    begins = F.col("block").eqNullSafe(0) if "block" in blocks.columns else F.lit(False)
    rows = blocks.select(*key, F.col("data").cast("binary").alias("data"), begins.alias("begins")).mapInArrow(scored, f"{head}, scores array<double>")
    sums = rows.groupBy(*key).agg(*(F.sum(F.get("scores", F.lit(k))).alias(f"_s{k}") for k in range(len(model.encodings))))
    best = F.greatest(*(F.col(f"_s{k}") for k in range(len(model.encodings))))
    chosen = F.lit(model.encodings[0])
    for k in reversed(range(len(model.encodings))):
        chosen = F.when(F.col(f"_s{k}") == best, model.encodings[k]).otherwise(chosen)
    return sums.select(*key, chosen.alias("encoding"))


def decoded(files: DataFrame, data_col: str = "data", encoding_col: str = "encoding") -> DataFrame:
    """The frame with ``text``: the bytes of each row read in its encoding, what is not in it as replacement characters."""

    def read(data: pa.Array, encoding: pa.Array) -> pa.Array:
        return pa.array([None if d is None or e is None else d.decode(e, "replace") for d, e in zip(data.to_pylist(), encoding.to_pylist(), strict=True)], pa.string())

    return files.withColumn("text", F.arrow_udf(read, "string")(F.col(data_col), F.col(encoding_col)))


def encoded(texts: DataFrame, encoding_col: str = "encoding", text_col: str = "text") -> DataFrame:
    """The frame with ``data``: texts written in the encoding of their row, what it lacks left out."""

    def write(text: pa.Array, encoding: pa.Array) -> pa.Array:
        return pa.array([None if t is None or e is None else t.encode(e, "ignore") for t, e in zip(text.to_pylist(), encoding.to_pylist(), strict=True)], pa.binary())

    return texts.withColumn("data", F.arrow_udf(write, "binary")(F.col(text_col), F.col(encoding_col)))
