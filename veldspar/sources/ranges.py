"""Files by byte ranges: a data source whose one file is many tasks.

``spark.read.format("file_ranges")`` lists plain files of a folder and cuts them into ranges of bytes.
A range owns the lines that begin in it, and reads on to the end of the last one; so each line is
read once, whatever the cuts. Line numbers are known only after all ranges before are counted, so
there are three modes: ``counts`` gives a row a range, ``lines`` the lines with their place in the
range, and ``blocks`` the bytes as they are. Packed files (.gz in any case) can't be entered in the
middle: each is one range and one task, read as a stream.
"""

from __future__ import annotations

import codecs
import gzip
import json
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from veldspar.sources.text import ParseFailed

RANGE_BYTES, CHUNK_BYTES = 64 << 20, 4 << 20
SCHEMAS = {
    "counts": "file_ord int, path string, start bigint, lines bigint, utf8 boolean, gb18030 boolean",
    "lines": "file_ord int, start bigint, nth bigint, raw binary",
    "blocks": "file_ord int, block bigint, data binary",
}
LF, CR = 0x0A, 0x0D


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it. Names in it stand as they are, not escaped."""
    path = quote(path, safe="/:@?=&,+~") if ":/" in path else path
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def listed(path: str, suffixes: tuple[str, ...]) -> list[tuple[str, int]]:
    """Plain files of a folder (not of folders below) that end in one of ``suffixes`` in any case, or one file as it is; by path, with sizes."""
    system, inside = opened(path)
    info = system.get_file_info(inside)
    if info.type == pafs.FileType.File:
        return [(path, info.size)]
    if info.type != pafs.FileType.Directory:
        raise FileNotFoundError(path)
    found = [(f"{path.rstrip('/')}/{f.base_name}", f.size) for f in system.get_file_info(pafs.FileSelector(inside)) if f.type == pafs.FileType.File]
    return sorted((p, n) for p, n in found if p.lower().endswith(suffixes))


def is_packed(path: str) -> bool:
    return path.lower().endswith(".gz")


class Ranges(InputPartition):
    """Byte ranges (file_ord, path, start, end) of one task; a range of a packed file has no end."""


class FileRanges(DataSource):
    """Options: path, or files (JSON of paths and sizes); mode; suffixes (comma-joined); bytes (of a range), block_bytes."""

    @classmethod
    def name(cls) -> str:
        return "file_ranges"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("mode", "lines")]

    def reader(self, schema: object) -> DataSourceReader:
        return RangeReader(self.options)


class RangeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.mode = options.get("mode", "lines")
        self.bytes, self.block_bytes = int(options.get("bytes", RANGE_BYTES)), int(options.get("block_bytes", 1 << 20))
        if self.mode == "blocks":  # whole blocks a range
            self.bytes = max(1, self.bytes // self.block_bytes) * self.block_bytes
        if "files" in options:
            self.files = [tuple(f) for f in json.loads(options["files"])]
        else:
            self.files = listed(options["path"], tuple(options.get("suffixes", ".log,.gz").lower().split(",")))

    def partitions(self) -> list[InputPartition]:
        """Ranges in turn; small ones share a task."""
        out: list[list[tuple]] = [[]]
        held = 0
        for k, (path, size) in enumerate(self.files):
            cuts = [(0, None)] if is_packed(path) else [(a, min(a + self.bytes, size)) for a in range(0, size, self.bytes)]
            for a, b in cuts:
                wide = (size if b is None else b) - a
                if out[-1] and held + wide > self.bytes:
                    out.append([])
                    held = 0
                out[-1].append((k, path, a, b))
                held += wide
        return [Ranges(x) for x in out]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        for k, path, start, end in partition.value:
            system, inside = opened(path)
            with system.open_input_file(inside) as file:
                if self.mode == "blocks":
                    yield from _blocks(k, path, file, start, end, self.block_bytes)
                    continue
                chunks = _unpacked(path, file) if end is None else owned(file, start, end)
                if self.mode == "counts":
                    yield _counted(k, path, start, chunks)
                else:
                    yield from _lines(k, start, chunks)


def _chunks(file: BinaryIO) -> Iterator[bytes]:
    while chunk := file.read(CHUNK_BYTES):
        yield chunk


def _unpacked(path: str, file: BinaryIO) -> Iterator[bytes]:
    try:
        with gzip.GzipFile(fileobj=file) as stream:
            yield from _chunks(stream)
    except (OSError, EOFError, zlib.error) as error:
        raise ParseFailed(f"{path}: {error}") from error


def owned(file: BinaryIO, start: int, end: int) -> Iterator[bytes]:
    """The lines that begin in start : end, whole, as chunks. A line begins after a line feed, or where the file does."""
    at = max(start - 1, 0)
    file.seek(at)
    begun = start == 0
    for chunk in _chunks(file):
        a = 0
        if not begun:
            found = chunk.find(b"\n")
            if found < 0 and at + len(chunk) < end:
                at += len(chunk)
                continue
            if found < 0 or at + found + 1 >= end:
                return
            begun, a = True, found + 1
        stop = chunk.find(b"\n", max(end - 1 - at, a)) if at + len(chunk) >= end else -1
        yield chunk[a : stop + 1] if stop >= 0 else chunk[a:]
        if stop >= 0:
            return
        at += len(chunk)


def _counted(k: int, path: str, start: int, chunks: Iterator[bytes]) -> pa.RecordBatch:
    """Lines of a range, and whether they are UTF-8 (without a replacement character) and GB18030. Neither spans a line feed."""
    tries = {name: codecs.getincrementaldecoder(name)("strict") for name in ("utf-8", "gb18030")}
    lines, last = 0, LF
    for chunk in chunks:
        if not chunk:
            continue
        lines += chunk.count(b"\n")
        last = chunk[-1]
        for name in list(tries):
            try:
                if "�" in tries[name].decode(chunk) and name == "utf-8":
                    del tries[name]
            except UnicodeDecodeError:
                del tries[name]
    for name in list(tries):
        try:
            tries[name].decode(b"", True)
        except UnicodeDecodeError:
            del tries[name]
    row = [[k], [path], [start], [lines + (last != LF)], ["utf-8" in tries], ["gb18030" in tries]]
    kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, kinds, strict=True)], [x.split()[0] for x in SCHEMAS["counts"].split(", ")])


def _lines(k: int, start: int, chunks: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    nth, open_line = 0, []
    for chunk in chunks:
        cut = chunk.rfind(b"\n") + 1
        if cut:
            whole = np.frombuffer(b"".join([*open_line, chunk[:cut]]), np.uint8)
            batch = _lines_batch(k, start, nth, whole)
            nth, open_line = nth + batch.num_rows, []
            yield batch
        if cut < len(chunk):
            open_line.append(chunk[cut:])
    if open_line:
        yield _lines_batch(k, start, nth, np.frombuffer(b"".join([*open_line, b"\n"]), np.uint8))


def _lines_batch(k: int, start: int, nth: int, data: np.ndarray) -> pa.RecordBatch:
    """Lines of bytes that end in a line feed; that goes, and a carriage return before it."""
    feed = data == LF
    keep = ~feed
    keep[:-1] &= ~((data[:-1] == CR) & feed[1:])
    ends = np.cumsum(keep)[feed]
    if len(ends) and ends[-1] >= 1 << 31:
        raise ParseFailed("a line is longer than a value can be")
    n = len(ends)
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    raw = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[keep].tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, k, np.int32)), pa.array(np.full(n, start, np.int64)), pa.array(np.arange(nth, nth + n, dtype=np.int64)), raw], ["file_ord", "start", "nth", "raw"])


def _blocks(k: int, path: str, file: BinaryIO, start: int, end: int | None, size: int) -> Iterator[pa.RecordBatch]:
    """Blocks of ``size`` bytes of a range, numbered along the file."""
    if end is None:
        stream, left = b"", _unpacked(path, file)
        at = 0
        for chunk in left:
            stream += chunk
            while len(stream) >= size:
                yield _block(k, at, stream[:size])
                stream, at = stream[size:], at + 1
        if stream:
            yield _block(k, at, stream)
        return
    file.seek(start)
    for at in range(start, end, size):
        yield _block(k, at // size, file.read(min(size, end - at)))


def _block(k: int, at: int, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([at], pa.int64()), pa.array([data], pa.binary())], ["file_ord", "block", "data"])
