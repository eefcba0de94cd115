"""Intermediate tables in the folder that every executor can reach."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
#: Makes Spark delete the shuffle files of a query when it ends, rather than when the driver next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a fresh temporary one only for an unset local session."""
    path = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {SETTING} to a folder that the driver and all executors share")
    path = f"file://{tempfile.mkdtemp(prefix='veldspar-')}"
    spark.conf.set(SETTING, path)
    return path


@contextmanager
def _no_shuffle_left(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


class Scratch:
    """Tables of one operator call. ``save`` cuts lineage: what follows reads Parquet, not the plan before.

    So the shuffle files of a saved plan are never read again, and go when it is saved.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._paths: dict[str, str] = {}

    def save(self, frame: DataFrame, name: str) -> DataFrame:
        """Write ``frame`` and read it back."""
        path = f"{self.root}/{name}"
        with _no_shuffle_left(self.spark):
            frame.write.parquet(path)
        self._paths[name] = path
        return self.spark.read.schema(frame.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads; of names never saved nothing is done."""
        jvm = self.spark._jvm
        for name in filter(self._paths.__contains__, names):
            path = jvm.org.apache.hadoop.fs.Path(self._paths.pop(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
