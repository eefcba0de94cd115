"""A sink of one file a document, committed as a whole.

``frame.write.format("named_files").mode("append")`` takes rows doc, stem, line, those of a document together and in
order, and writes ``{stem}_{stamp}_{six hex digits}.csv`` for each. Tasks write below a temporary folder of
the run; only when all have ended are the files of those that succeeded moved to their names. So a
task that fails or is run twice leaves nothing behind, and no reader sees half a run's file.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow.fs as pafs
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from veldspar.sources.ranges import opened

SCHEMA = "doc string, stem string, line string"
MARK = "﻿"
TRIES = 32


@dataclass
class Written(WriterCommitMessage):
    """Temporary files of a task and the stems of their names."""

    files: list[tuple[str, str]] = field(default_factory=list)


class NamedFiles(DataSource):
    """Options: path (the folder), stamp, header (the first line of every file)."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("named files are never overwritten: use mode append")
        if schema.names != ["doc", "stem", "line"]:
            raise ValueError(f"rows must be {SCHEMA}")
        return NamedFilesWriter(self.options)


class NamedFilesWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.stamp, self.header = options["path"].rstrip("/"), options["stamp"], options.get("header", "")
        self.work = f"{self.folder}/_unfinished-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Written:
        """One temporary file for each run of rows of a document."""
        out, now, file = Written(), None, None
        system, work = opened(self.work)
        system.create_dir(work, recursive=True)
        try:
            for row in iterator:
                if file is None or row.doc != now:
                    if file is not None:
                        file.close()
                    now, name = row.doc, uuid.uuid4().hex
                    file = system.open_output_stream(f"{work}/{name}")
                    out.files.append((name, row.stem))
                    file.write(f"{MARK}{self.header}".encode())
                file.write(f"\n{row.line}".encode())
        finally:
            if file is not None:
                file.close()
        return out

    def commit(self, messages: list[Written | None]) -> None:
        """Move the files of all tasks to their names. A name that is taken is never written again: other digits are tried."""
        system, folder = opened(self.folder)
        _, work = opened(self.work)
        for name, stem in sorted((f for m in messages if m for f in m.files), key=lambda f: f[1]):
            for _ in range(TRIES):
                place = f"{folder}/{stem}_{self.stamp}_{uuid.uuid4().hex[:6]}.csv"
                if system.get_file_info(place).type == pafs.FileType.NotFound:
                    system.move(f"{work}/{name}", place)
                    break
            else:
                raise FileExistsError(f"no free name for {stem}")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        """Nothing of a failed run stays."""
        self._clear()

    def _clear(self) -> None:
        system, work = opened(self.work)
        if system.get_file_info(work).type == pafs.FileType.Directory:
            system.delete_dir(work)
