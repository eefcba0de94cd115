"""Log analytics over a stream of lines."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspar.functions import logs as fn
from veldspar.operators import logs


def lines(spark: SparkSession, folder: str, files_a_trigger: int = 64) -> DataFrame:
    """Lines of the text files that appear in a folder."""
    return spark.readStream.option("maxFilesPerTrigger", files_a_trigger).text(folder).withColumnRenamed("value", "line")


def entries(stream: DataFrame) -> DataFrame:
    """Entries of a stream of lines, with ``time`` beside the timestamp's text; lines that are no entries are dropped. file_ord and line_no stay if they are there."""
    given = [c for c in logs.ORDER if c in stream.columns]
    place = (F.col(c) if c in given else F.lit(0).cast("bigint").alias(c) for c in logs.ORDER)
    rows = logs.parsed(stream.select(*place, "line")).select(*given, "ts", "thread", "class", "message")
    return rows.withColumn("time", F.to_timestamp("ts", "yyyy-MM-dd HH:mm:ss.SSS")).withColumn("category", fn.category(F.col("class"), F.col("message")))


def bucket_counts(rows: DataFrame, minutes: int = 10, late: str = "10 minutes") -> DataFrame:
    """Entries of each category and time bucket. Entries later than ``late`` behind the newest are left out."""
    counted = rows.withWatermark("time", late).groupBy(F.window("time", f"{minutes} minutes"), "category").agg(F.count(F.lit(1)).alias("entries"))
    return counted.select(F.col("window.start").alias("start"), "category", "entries")


def stuck_threads(rows: DataFrame, threshold_ms: int = 10_000) -> DataFrame:
    """Dispatch ends beyond the threshold whose thread's mark before is a start; each thread keeps the open start as state.

    Within a batch marks are ordered by time; across batches by arrival.
    """
    marks = rows.where(F.col("message").startswith("[DISPATCH-START]") | F.col("message").startswith("[DISPATCH-END]"))
    marks = marks.select("thread", "ts", F.col("message").startswith("[DISPATCH-START]").alias("starts"), fn.dispatch_cost(F.col("message")).cast("bigint").alias("cost"))

    def paired(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        opened = state.get[0] if state.exists else None
        out = []
        for mark in pd.concat(batches).sort_values("ts", kind="stable").itertuples():
            if mark.starts:
                opened = mark.ts
            else:
                if opened is not None and mark.cost == mark.cost and mark.cost is not None and mark.cost > threshold_ms:
                    out.append((key[0], opened, mark.ts, int(mark.cost)))
                opened = None
        state.update((opened,))
        yield pd.DataFrame(out, columns=["thread", "start_time", "end_time", "duration_ms"])

    schema = "thread string, start_time string, end_time string, duration_ms bigint"
    return marks.groupBy("thread").applyInPandasWithState(paired, schema, "opened string", "append", "NoTimeout")
