"""Delimited text of any size, quoted as RFC 4180 says, as a parallel transducer.

Whether a line feed ends a record depends on all quotes before it. But a block of text, whatever it is
entered with, is a map of four states (field begins, plain, quoted, after a quote) to four, and maps
compose: blocks are reduced to their maps at once, a scan over the maps gives each block the state it is
entered in, and then each block finds its own records. A record that crosses blocks is put together
from its pieces; it alone is shuffled.

Rows are as Python's csv module reads them: a carriage return, a line feed or both end a record, empty lines are no rows, and a
quote within a plain field is a letter.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldspar.operators import order
from veldspar.scratch import Scratch
from veldspar.sources.text import DELIMITERS, SNIFFED_ROWS, ParseFailed, quote_marks

BEGIN, PLAIN, QUOTED, CLOSING = range(4)
OTHER, QUOTE, DELIMITER, NEWLINE, NOTHING = range(5)
#: The next state, by state and kind of byte.
NEXT = np.array([
    [PLAIN, QUOTED, BEGIN, BEGIN, BEGIN],
    [PLAIN, PLAIN, BEGIN, BEGIN, PLAIN],
    [QUOTED, CLOSING, QUOTED, QUOTED, QUOTED],
    [PLAIN, QUOTED, BEGIN, BEGIN, CLOSING],
], np.uint8)
#: Beside a state: a record has ended on the way to it.
ENDED = 4
#: NEXT of states with and without ENDED.
STEPS = np.concatenate([NEXT, NEXT | ENDED]).astype(np.uint8)
STEPS[[BEGIN, PLAIN, CLOSING], NEWLINE] |= ENDED
#: Bytes that are followed one after the other; so many rows of them are followed at once.
RUN = 512
MARK = b"\xef\xbb\xbf"
#: Bytes of blocks that are followed side by side, about.
TOGETHER = 1 << 22
MOST_BROADCAST = 100_000


def _kinds(blocks: list[bytes], delimiters: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Kinds of bytes, a column for each run of RUN bytes, the last of a block filled up; and the first run of each block, with their number."""
    first = np.cumsum([0, *(-(-len(data) // RUN) for data in blocks)])
    runs = np.full(first[-1] * RUN, NOTHING, np.uint8)
    tables = {}
    for sign in set(delimiters):
        tables[sign] = table = np.full(256, OTHER, np.uint8)
        table[ord('"')], table[ord(sign)] = QUOTE, DELIMITER
        table[[0x0A, 0x0D]] = NEWLINE
    for data, sign, at in zip(blocks, delimiters, first.tolist(), strict=False):
        runs[at * RUN : at * RUN + len(data)] = tables[sign][np.frombuffer(data, np.uint8)]
    return np.ascontiguousarray(runs.reshape(-1, RUN).T), first


def _runs(kinds: np.ndarray) -> np.ndarray:
    """For each run, the states that its four states lead to, and ENDED beside if a record ends on the way: shape (4, runs)."""
    state = np.repeat(np.arange(4, dtype=np.uint8)[:, None], kinds.shape[1], 1)
    flat = STEPS.ravel()
    for row in kinds:
        state = flat[state * np.uint8(STEPS.shape[1]) + row]
    return state


def _followed(runs: np.ndarray, first: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What blocks entered in states (shape (n, blocks)) lead to, with ENDED, and the states that their runs are entered in. Blocks go on side by side."""
    state, entered = state.astype(np.uint8), np.zeros((len(state), runs.shape[1]), np.uint8)
    many, longest = np.diff(first), 0
    order = np.argsort(-many, kind="stable")
    going = np.searchsorted(-many[order], -np.arange(many.max(initial=0)), side="left")  # how many blocks have a run of this place
    for longest, n in enumerate(going.tolist()):
        mine = order[:n]
        now, at = state[:, mine], first[mine] + longest
        entered[:, at] = now & 3
        state[:, mine] = runs[now & 3, at] | now & ENDED
    return state, entered


def all_ways(blocks: list[bytes], delimiters: list[str]) -> np.ndarray:
    """The states that the four states of each block lead to, with ENDED beside where a record ends in it: shape (4, blocks)."""
    kinds, first = _kinds(blocks, delimiters)
    return _followed(_runs(kinds), first, np.repeat(np.arange(4)[:, None], len(blocks), 1))[0]


def all_ends(blocks: list[bytes], delimiters: list[str], entered: list[int]) -> list[np.ndarray]:
    """For each block, entered in a state, the places just behind the bytes that end a record."""
    kinds, first = _kinds(blocks, delimiters)
    now = _followed(_runs(kinds), first, np.array(entered, np.uint8)[None])[1][0]
    ends = np.zeros(kinds.shape, bool)
    flat = STEPS.ravel()
    for j, row in enumerate(kinds):
        now = flat[(now & np.uint8(3)) * np.uint8(STEPS.shape[1]) + row]
        ends[j] = now >= ENDED
    places = np.flatnonzero(ends.T.ravel())
    cuts = np.searchsorted(places, first * RUN)
    return [places[i:j] - at * RUN + 1 for i, j, at in zip(cuts[:-1], cuts[1:], first.tolist(), strict=False)]


def ways(data: bytes, delimiter: str) -> list[int]:
    """The states that a block's four states lead to."""
    return (all_ways([data], [delimiter])[:, 0] & 3).tolist()


def record_ends(data: bytes, delimiter: str, entered: int) -> np.ndarray:
    """Places just behind the bytes that end a record, in a block entered in a state."""
    return all_ends([data], [delimiter], [entered])[0]


def _parts(blocks: list[bytes]) -> Iterator[slice]:
    """Blocks in turns of TOGETHER bytes, about."""
    start, held = 0, 0
    for k, data in enumerate(blocks):
        held += len(data)
        if held > TOGETHER:
            yield slice(start, k + 1)
            start, held = k + 1, 0
    if start < len(blocks):
        yield slice(start, len(blocks))


def _rows(data: bytes, delimiter: str) -> list[list[str]]:
    csv.field_size_limit(1 << 30)
    try:
        return [r for r in csv.reader(io.StringIO(data.decode("utf-8"), newline=""), delimiter=delimiter) if r]
    except UnicodeDecodeError as error:
        raise ParseFailed(f"delimited text that is not UTF-8: {error}") from error


def _unmarked(block: int, data: bytes) -> bytes:
    return data.removeprefix(MARK) if block == 0 else data


def records(blocks: DataFrame, key: list[str], delimiter: str | None = ",") -> DataFrame:
    """Records (key, row_ord, fields) of texts in blocks: key, block (0, 1, 2, ... without a gap) and data in UTF-8.

    Blocks may be cut anywhere, also within a character; a byte-order mark that begins block 0 goes. Without
    ``delimiter`` the blocks have it in a column of that name. Empty lines are no records; records
    may differ in width; an open quote at the end closes there. A null block counts as empty.
    """
    scratch = Scratch(blocks.sparkSession, "delimited")
    mark = F.col("delimiter") if delimiter is None else F.lit(delimiter)
    blocks = blocks.select(*key, F.col("block").cast("bigint").alias("block"), F.coalesce(F.col("data").cast("binary"), F.lit(b"")).alias("data"), mark.alias("delimiter"))
    keys = [(f.name, f.dataType.simpleString()) for f in blocks.select(*key).schema]
    head, n = ", ".join(f"`{c}` {t}" for c, t in keys), len(key)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, data, signs = (batch.column(n + k).to_pylist() for k in range(3))
            data = list(map(_unmarked, block, data))
            out = np.concatenate([np.zeros((0, 4), np.uint8), *(all_ways(data[p], signs[p]).T for p in _parts(data))])
            arrays = [pa.array((out & 3).tolist(), pa.list_(pa.int32())), pa.array((out >= ENDED).tolist(), pa.list_(pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: n + 1], *arrays], [*key, "place", "out", "ended"])

    maps = scratch.save(blocks.mapInArrow(mapped, f"{head}, place bigint, out array<int>, ended array<boolean>"), "maps")
    entries = maps.join(order.entered(maps, key, scratch), [*key, "place"]).select(*key, F.col("place").alias("block"), "way", F.get("ended", F.col("way")).alias("ends"))
    entries = order.running(scratch.save(entries, "entries"), key, "block", F.when(F.col("ends"), F.col("block")), F.max, "start")  # the block before in which a record ended last
    entries = scratch.save(entries.select(*key, "block", "way", F.coalesce("start", F.lit(-1)).alias("start")), "entered")
    small = entries.count() <= MOST_BROADCAST
    met = blocks.join(F.broadcast(entries) if small else entries, [*key, "block"])  # so that blocks stay where they are

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*key, "block", "nth", "fields", "piece", "start", "delimiter"]
        kinds = [pa.int64(), pa.list_(pa.string()), pa.binary(), pa.int64(), pa.string()]
        for batch in batches:
            block, data, signs, way, starts = (batch.column(n + k).to_pylist() for k in range(5))
            data = list(map(_unmarked, block, data))
            for p in _parts(data):
                rows: list[tuple] = []
                for r, ends in enumerate(all_ends(data[p], signs[p], way[p]), p.start):
                    text, sign = data[r], signs[r]
                    first, last = (int(ends[0]), int(ends[-1])) if len(ends) else (len(text), len(text))
                    if first:
                        rows.append((r, None, None, text[:first], starts[r], sign))  # goes on from the block before
                    if first < last:
                        rows += [(r, k, f, None, None, None) for k, f in enumerate(_rows(text[first:last], sign))]
                    if last < len(text):
                        rows.append((r, None, None, text[last:], block[r], sign))  # goes on in the next
                if rows:
                    at, *columns = zip(*rows, strict=True)
                    same = [batch.column(c).take(pa.array(at, pa.int64())) for c in range(n + 1)]
                    yield pa.RecordBatch.from_arrays([*same, *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names)

    found = scratch.save(met.select(*key, "block", "data", "delimiter", "way", "start").mapInArrow(cut, f"{head}, block bigint, nth bigint, fields array<string>, piece binary, start bigint, delimiter string"), "found")
    pieces = found.where("piece is not null")
    crossing = pieces.groupBy(*key, "start").agg(F.array_sort(F.collect_list(F.struct("block", F.col("piece").cast("string").alias("text")))).alias("parts"), F.first("delimiter").alias("delimiter"))  # of one record
    crossing = crossing.select(*key, "start", F.array_join(F.transform("parts", lambda p: p["text"]), "").cast("binary").alias("data"), "delimiter").where("octet_length(data) > 0")

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_rows(d, m) for d, m in zip(batch.column(n + 1).to_pylist(), batch.column(n + 2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: n + 1], pa.array([r[0] if r else None for r in rows], pa.list_(pa.string()))], [*key, "block", "fields"])

    crossing = crossing.mapInArrow(parsed, f"{head}, block bigint, fields array<string>").where("fields is not null")
    whole = found.where("fields is not null").select(*key, "block", "nth", "fields")
    crossing = scratch.save(crossing, "crossing")
    per = whole.select(*key, "block", F.lit(1).alias("n"), F.lit(0).alias("more")).unionByName(crossing.select(*key, "block", F.lit(0).alias("n"), F.lit(1).alias("more")))
    per = scratch.save(per.groupBy(*key, "block").agg(F.sum("n").alias("n"), F.sum("more").alias("more")), "sizes")
    per = order.running(per, key, "block", F.col("n") + F.col("more"), F.sum, "before").select(*key, "block", "n", F.coalesce("before", F.lit(0)).alias("before"))
    per = scratch.save(per, "counts")
    per = F.broadcast(per) if small else per
    rows = whole.unionByName(crossing.select(*key, "block", F.lit(None).cast("bigint").alias("nth"), "fields")).join(per, [*key, "block"])
    return rows.select(*key, (F.col("before") + F.coalesce("nth", "n")).alias("row_ord"), "fields")


def blocks_of(texts: DataFrame, key: list[str], text_col: str = "text", chars: int = 1 << 18) -> DataFrame:
    """Texts (key, text) as blocks (key, block, data) of ``chars`` characters. A null text is an empty one."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    pieces = F.when(text == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{chars}}}"), F.lit(0)))
    return texts.select(*key, F.posexplode(pieces).alias("block", "data")).withColumns({"block": F.col("block").cast("bigint"), "data": F.col("data").cast("binary")})


def delimiter_stats(texts: DataFrame, key: list[str], text_col: str = "text") -> DataFrame:
    """Per text and candidate delimiter: delimiter, n_rows, n_split, common, n_common, spread, errors, outside, quoted.

    The first rows of a text are taken (the SNIFFED_ROWS of them that have content): their number, those of several
    fields, the commonest width (the larger of two), how many have it, the mean squared distance from
    it, and of the quotes those misplaced, the delimiters outside and the fields quoted. Rows of widths
    come out of tasks; the statistics are aggregates.
    """
    keys = [(f.name, f.dataType.simpleString()) for f in texts.select(*key).schema]
    head, n = ", ".join(f"`{c}` {t}" for c, t in keys), len(key)

    def widths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(1 << 30)
        for batch in batches:
            out: list[tuple] = []
            for r, text in enumerate(batch.column(n).to_pylist()):
                for sign in DELIMITERS:
                    marks = quote_marks(text or "", sign)
                    out.append((r, sign, None, *marks))
                    rows = (x for x in csv.reader(io.StringIO(text or "", newline=""), delimiter=sign) if x)
                    sizes = [len(x) for _, x in zip(range(SNIFFED_ROWS), rows, strict=False) if len(x) > 1 or any(f.strip() for f in x)]
                    out += [(r, sign, w, None, None, None) for w in sizes]
            columns = list(zip(*out, strict=True)) or [()] * 6
            at = pa.array(columns[0], pa.int64())
            kinds = [pa.string(), *[pa.int32()] * 4]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in range(n)), *(pa.array(c, t) for c, t in zip(columns[1:], kinds, strict=True))], [*key, "delimiter", "width", "errors", "outside", "quoted"])

    rows = texts.select(*key, text_col).mapInArrow(widths, f"{head}, delimiter string, width int, errors int, outside int, quoted int")
    by = rows.groupBy(*key, "delimiter", "width").agg(F.count("width").alias("n"), *(F.max(c).alias(c) for c in ("errors", "outside", "quoted")))
    common = F.max(F.struct("n", "width"))
    stats = by.groupBy(*key, "delimiter").agg(
        F.sum("n").alias("n_rows"), F.sum(F.when(F.col("width") > 1, F.col("n")).otherwise(0)).alias("n_split"), common.alias("top"),
        F.collect_list(F.when(F.col("width").isNotNull(), F.struct("n", "width"))).alias("sizes"),  # as many as rows were taken, at most
        *(F.max(c).cast("bigint").alias(c) for c in ("errors", "outside", "quoted")),
    )
    width = F.coalesce(F.when(F.col("n_rows") > 0, F.col("top.width")), F.lit(0)).cast("bigint")
    stats = stats.withColumn("common", width)
    apart = F.aggregate("sizes", F.lit(0).cast("bigint"), lambda s, x: s + x["n"] * (x["width"] - F.col("common")) * (x["width"] - F.col("common")))
    n_common = F.when(F.col("n_rows") > 0, F.col("top.n")).otherwise(0).cast("bigint")
    return stats.select(*key, "delimiter", "n_rows", "n_split", "common", n_common.alias("n_common"), (apart / F.greatest("n_rows", F.lit(1))).alias("spread"), "errors", "outside", "quoted")


def sniffed(texts: DataFrame, key: list[str], text_col: str = "text") -> DataFrame:
    """The delimiter (key, delimiter) under which each text's first rows look most like a table.

    Candidates are ranked by, in turn: having columns at all; the share of rows with columns; the share
    of rows of the commonest width; the spread (less is better); that width; misplaced quotes (fewer
    are better); delimiters outside quotes; quoted fields; the order of the candidates. Shares of so few rows are equal as doubles just when they are.
    """
    stats = delimiter_stats(texts, key, text_col)
    total = F.greatest("n_rows", F.lit(1))
    rank = F.struct(F.col("common") > 1, F.col("n_split") / total, F.col("n_common") / total, -F.col("spread"), "common", -F.col("errors"), "outside", "quoted", -F.instr(F.lit(DELIMITERS), F.col("delimiter")))
    return stats.groupBy(*key).agg(F.max_by("delimiter", rank).alias("delimiter"))
