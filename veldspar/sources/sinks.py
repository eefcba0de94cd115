"""CSV and JSON sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldspar.functions.registers import COLUMNS, safe_stem
from veldspar.operators.registers import csv_line
from veldspar.sources.named_files import NamedFiles


def write_register_files(merged: DataFrame, stems: DataFrame, folder: str, stamp: str) -> None:
    """Write the kept records of each merged document as ``{stem}_{stamp}_{six hex digits}.csv`` in ``folder``.

    ``stems`` has doc_id and stem; documents without one are called output. A file begins with a
    byte-order mark and the twelve columns. Files appear all together when the last is written, never
    over an existing one; documents of equal stems differ in their digits. One task writes a whole file,
    row by row, so a document may have any size.
    """
    merged.sparkSession.dataSource.register(NamedFiles)
    kept = merged.where("status = 'kept'").select("doc_id", "ord", csv_line(F.col("fields")).alias("line"))
    named = stems.groupBy("doc_id").agg(safe_stem(F.coalesce(F.min("stem"), F.lit(""))).alias("stem"))
    rows = kept.join(named, "doc_id", "left").withColumn("stem", F.coalesce("stem", F.lit("output")))
    rows = rows.repartition("doc_id").sortWithinPartitions("doc_id", "ord").select(F.col("doc_id").cast("string").alias("doc"), "stem", "line")
    rows.write.format("named_files").mode("append").options(path=folder, stamp=stamp, header=",".join(COLUMNS)).save()


def write_register_rows(merged: DataFrame, folder: str) -> None:
    """Kept records of all documents as CSV part files with a header, for tables too large for one file."""
    kept = merged.where("status = 'kept'").select("doc_id", "ord", *(F.get("fields", F.lit(k)).alias(c) for k, c in enumerate(COLUMNS)))
    kept.repartitionByRange("doc_id", "ord").sortWithinPartitions("doc_id", "ord").write.mode("errorifexists").option("header", "true").csv(folder)


def as_json(frame: DataFrame, name: str = "json") -> DataFrame:
    """Each row as one JSON object."""
    return frame.select(F.to_json(F.struct(*frame.columns)).alias(name))


def as_csv(frame: DataFrame, name: str = "line") -> DataFrame:
    """Each row of strings as one CSV line, quoted only where needed."""
    return frame.select(csv_line(F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in frame.columns))).alias(name))
