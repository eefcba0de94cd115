"""File scans as DataFrames: logs to lines, documents to text, tables and catalogues to rows."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from veldspar.functions.registers import COLUMNS
from veldspar.operators import delimited as operators_delimited
from veldspar.operators import registers
from veldspar.sources import encodings, office, ranges
from veldspar.sources.text import ParseFailed, decode_resource, records

MOST_BYTES = 50 * 1024 * 1024
MOST_BROADCAST = 100_000


def _name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def is_log_name(name: Column) -> Column:
    """.log and .gz in any case."""
    return F.lower(name).rlike(r"\.(?:log|gz)$")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path)


def _ranges(spark: SparkSession, files: list[tuple[str, int]], mode: str, **options: int) -> DataFrame:
    spark.dataSource.register(ranges.FileRanges)
    return spark.read.format("file_ranges").options(mode=mode, files=json.dumps(files), **options).load()


@F.arrow_udf(StringType())
def _legacy(raw: pa.Array, encoding: pa.Array) -> pa.Array:
    return pa.array([None if r is None else r.decode(e, "replace") for r, e in zip(raw.to_pylist(), encoding.to_pylist(), strict=True)], pa.string())


def log_lines(spark: SparkSession, path: str, range_bytes: int = ranges.RANGE_BYTES, model: encodings.Model | None = None, suffixes: tuple[str, ...] = (".log", ".gz")) -> DataFrame:
    """Lines (file_ord, path, line_no, line) of the log files of a folder (those that end in one of ``suffixes``), files in the order of their paths.

    A plain file is read by ranges of ``range_bytes``, each a task, so one file may be of any size; a
    packed one (.gz in any case) is one task, read as a stream. A first pass counts the lines of each
    range, their running sum numbers the lines of the second; what meets them is a row a range. A line
    ends with a line feed; one carriage return before it goes too. A file is UTF-8 unless a line of it
    isn't or holds a replacement character, then GB18030 if all its lines are, else what a ``model``
    of encodings finds in its blocks, or Windows-1252 without one.
    """
    files = ranges.listed(path, suffixes)
    same = Window.partitionBy("file_ord")
    counts = _ranges(spark, files, "counts", bytes=range_bytes).select(
        "file_ord", "path", "start", (F.sum("lines").over(same.orderBy("start")) - F.col("lines")).alias("before"),
        F.when(F.min("utf8").over(same), "utf-8").when(F.min("gb18030").over(same), "gb18030").otherwise("cp1252").alias("encoding"),
    )
    if model is not None:
        guessed = encodings.detect(_ranges(spark, files, "blocks", bytes=range_bytes), ["file_ord"], model).withColumnRenamed("encoding", "guess")
        counts = counts.join(guessed, "file_ord", "left").withColumn("encoding", F.when(F.col("encoding") == "cp1252", F.coalesce("guess", "encoding")).otherwise(F.col("encoding"))).drop("guess")
    n_ranges = sum(1 if ranges.is_packed(p) else -(-size // range_bytes) for p, size in files)
    counts = F.broadcast(counts) if n_ranges <= MOST_BROADCAST else counts  # beyond it, lines are shuffled by their range
    rows = _ranges(spark, files, "lines", bytes=range_bytes).join(counts, ["file_ord", "start"])
    plain = F.col("encoding") == "utf-8"
    line = F.when(plain, F.col("raw").cast("string")).otherwise(_legacy(F.when(~plain, F.col("raw")), F.col("encoding")))
    return rows.select("file_ord", "path", (F.col("before") + F.col("nth")).alias("line_no"), line.alias("line"))


def document_status(name: Column, length: Column) -> Column:
    """ok, or why a file can't be read as a document."""
    kind = F.lower(F.regexp_extract(name, r"[^.]\.([^.]+)$", 1))
    return F.when(length == 0, "no_extractable_text").when(length > MOST_BYTES, "file_too_large").when(kind == "doc", "legacy_doc_unsupported").when(~kind.isin(*office.EXTRACTORS), "unsupported_format").otherwise("ok")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a folder: path, kind, status, text. Text is null unless the status is ok; too large files are not read, and Spark's scan lists no empty ones."""
    files = _files(spark, path)
    kind = F.lower(F.regexp_extract(_name(F.col("path")), r"[^.]\.([^.]+)$", 1))
    files = files.select("path", kind.alias("kind"), document_status(_name(F.col("path")), F.col("length")).alias("status"), "content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for kind, data in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                try:
                    text = office.EXTRACTORS[kind](data)
                    out.append(("ok", text) if text.strip() else ("no_extractable_text", None))
                except ParseFailed:
                    out.append(("parse_failed", None))
            status, text = zip(*out, strict=True) if out else ([], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(status, pa.string()), pa.array(text, pa.string())], ["path", "kind", "status", "text"])

    good = files.where("status = 'ok'").mapInArrow(read, "path string, kind string, status string, text string")
    return good.unionByName(files.where("status <> 'ok'").select("path", "kind", "status", F.lit(None).cast("string").alias("text")))


def record_rows(texts: DataFrame, text_col: str = "csv") -> DataFrame:
    """Records (the other columns, row_ord, fields) of CSV texts, a Markdown fence around them stripped."""
    from veldspar.functions.registers import without_fence

    others = [c for c in texts.columns if c != text_col]
    schema = texts.select(*others).schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows = records(batch.column(len(others))[k].as_py() or "")
                if rows:
                    same = [pa.repeat(batch.column(c)[k], len(rows)) for c in range(len(others))]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(range(len(rows)), pa.int32()), pa.array(rows, pa.list_(pa.string()))], [*others, "row_ord", "fields"])

    columns = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), "row_ord int", "fields array<string>"]
    return texts.select(*others, without_fence(F.col(text_col)).alias(text_col)).mapInArrow(cut, ", ".join(columns))


def delimited(spark: SparkSession, path: str, delimiter: str | None = None, block_bytes: int = 1 << 20, range_bytes: int = ranges.RANGE_BYTES) -> DataFrame:
    """Records (path, row_ord, fields) of the .csv files of a folder, packed (.csv.gz) or not, each file of any size.

    Files are read in blocks over many tasks (a packed one in one task). Without ``delimiter`` each
    file's is found from the first rows of its first block. Files must be UTF-8, with or without its mark;
    other encodings are an error here and are read by ``documents``.
    """
    listed = ranges.listed(path, (".csv", ".csv.gz"))
    blocks = _ranges(spark, listed, "blocks", bytes=range_bytes, block_bytes=block_bytes)
    names = spark.createDataFrame([(k, p) for k, (p, _) in enumerate(listed)], "file_ord int, path string")
    if delimiter is None:
        whole = F.regexp_replace(F.col("data").cast("string"), "^﻿", "")
        text = F.when(F.length(whole) < block_bytes // 4, whole).otherwise(F.regexp_replace(whole, r"[^\r\n]*\z", ""))  # no half row at the end
        signs = operators_delimited.sniffed(blocks.where("block = 0").select("file_ord", text.alias("text")), ["file_ord"])
        blocks = blocks.join(F.broadcast(signs) if len(listed) <= MOST_BROADCAST else signs, "file_ord")
    return operators_delimited.records(blocks, ["file_ord"], delimiter).join(names, "file_ord").select("path", "row_ord", "fields")


def register_map_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows (ord, the twelve columns) of a register map file. The first twelve headings must be the twelve columns; more may follow."""
    text = _files(spark, path).select(F.regexp_replace(F.decode("content", "UTF-8"), "^﻿+", "").alias("csv"))
    rows = record_rows(text)
    head = rows.where("row_ord = 0").select(F.transform(F.slice("fields", 1, len(COLUMNS)), F.trim).alias("head")).first()
    if head is None or head["head"] != list(COLUMNS):
        raise ParseFailed("the register map does not begin with the twelve columns")
    body = rows.where("row_ord > 0")
    if not body.where(F.size("fields") < len(COLUMNS)).isEmpty():
        raise ParseFailed("a row of the register map is too short")
    return body.select(F.col("row_ord").alias("ord"), *(F.get("fields", F.lit(k)).alias(c) for k, c in enumerate(COLUMNS)))


def _decoded(spark: SparkSession, path: str) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([decode_resource(d) for d in batch.column(0).to_pylist()], pa.string())], ["text"])

    return _files(spark, path).select("content").mapInArrow(read, "text string")


def catalog_csv(spark: SparkSession, path: str) -> DataFrame:
    """Entries (ord, code, meaning) of a catalogue file, by its headings ParamCode and ParamName in any order."""
    rows = record_rows(_decoded(spark, path), "text")
    head = rows.where("row_ord = 0").first()
    head = head["fields"] if head else []
    if "ParamCode" not in head or "ParamName" not in head:
        raise ParseFailed("the catalogue has no ParamCode and ParamName")
    pick = lambda name: F.coalesce(F.get("fields", F.lit(head.index(name))), F.lit(""))
    return rows.where("row_ord > 0").select(F.col("row_ord").alias("ord"), pick("ParamCode").alias("code"), pick("ParamName").alias("meaning"))


def catalog_markdown(spark: SparkSession, path: str) -> DataFrame:
    """Entries (ord, code, meaning) of the tables of a Markdown file."""
    lines = _decoded(spark, path).select(F.posexplode(F.split("text", "\n")).alias("ord", "line"))
    return registers.markdown_entries(lines)


def naming_catalog(spark: SparkSession, csv_path: str, markdown_path: str) -> DataFrame:
    """The catalogue of the CSV file, or of the Markdown file if that has no entries."""
    try:
        found = registers.catalog(catalog_csv(spark, csv_path))
        if not found.isEmpty():
            return found
    except ParseFailed:
        pass
    found = registers.catalog(catalog_markdown(spark, markdown_path))
    if found.isEmpty():
        raise ParseFailed("neither catalogue has entries")
    return found


def natural_parts(name: Column) -> list[Column]:
    """The columns that ``natural_key`` orders by; the second of them falls."""
    parts = F.split(F.regexp_replace(name, r"\.gz$", ""), r"\.")
    # Padded digits sort as numbers do. A high mark ends each key, so that in falling order the shorter of two names comes first.
    key = F.transform(parts, lambda p: F.when(p.rlike("^[0-9]+$"), F.concat(F.lit("0"), F.lpad(p, 20, "0"))).otherwise(F.concat(F.lit("1"), p)))
    return [name.endswith(".gz"), F.concat(key, F.array(F.lit("2"))), name]


def natural_key(name: Column) -> list[Column]:
    """What names are ordered by: plain ones before .gz, then dotted parts, numbers and words falling; of a name and one that goes on the shorter comes first."""
    packed, key, whole = natural_parts(name)
    return [packed, key.desc(), whole]


def natural_order(files: DataFrame, name_col: str = "name") -> DataFrame:
    """Files in natural order of their names."""
    return files.orderBy(*natural_key(F.col(name_col)))


def newest_first(files: DataFrame, name_col: str = "name") -> DataFrame:
    """Files by falling name, which for dated names puts the newest first."""
    return files.orderBy(F.col(name_col).desc())


def together(first: DataFrame, *more: DataFrame) -> DataFrame:
    """Rows of several listings, each once."""
    for other in more:
        first = first.unionByName(other)
    return first.distinct()


def search_names(files: DataFrame, wanted: str, name_col: str = "name") -> DataFrame:
    """Files whose names hold a text, in any case."""
    return files.where(F.lower(name_col).contains(wanted.strip().lower()))
