"""What the operators share: tables, scratch folders, Arrow batches, words."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: ASCII white space; what separates words in the contracts of the queries.
WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: Rows that are turned into Python objects at a time.
SLICE_ROWS = 128

#: Bytes of an Arrow batch and of a scratch table's row group, which a task holds whole, the batch in the JVM and in Python.
BATCH_BYTES, GROUP_BYTES = 4 << 20, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder, read by Spark from whatever store holds it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application.

    They may run where the repository isn't on Python's path.
    """
    context = spark.sparkContext
    if getattr(context, "_tidewater_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="tidewater-"), "tidewater_package.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("tidewater", os.path.relpath(full, root)))
    context.addPyFile(path)
    context._tidewater_shipped = True


def map_batches(
    df: DataFrame,
    fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: str,
) -> DataFrame:
    """``mapInArrow`` with the package shipped first."""
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``rows`` rows, so that few texts are Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


@contextmanager
def small_batches(spark: SparkSession):
    """Arrow batches of at most BATCH_BYTES, or one row, in what is computed inside; the session's setting comes back after."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, was)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; one of our own only where that is unset and all runs on this machine."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not hasattr(spark.sparkContext, "_tidewater_scratch"):
        spark.sparkContext._tidewater_scratch = "file://" + tempfile.mkdtemp(prefix="tidewater-scratch-")
    return spark.sparkContext._tidewater_scratch


class Scratch:
    """Tables written in the shared folder to cut lineage; a lost executor loses none of them.

    Results read them when they're computed, so they stay until the application
    ends, or until ``clear`` is told that what came of them is written.
    """

    folders: list[str] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{scratch_root(spark)}/tidewater/{name}-{uuid.uuid4().hex}"
        self.n = 0
        where, files = self._file(self.path)
        files.mkdirs(where)
        files.deleteOnExit(where)
        Scratch.folders.append(self.path)

    def _file(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    @classmethod
    def mark(cls) -> int:
        return len(cls.folders)

    def clear(self, mark: int) -> None:
        """Delete the folders that were made since ``mark``."""
        while len(Scratch.folders) > mark:
            self.drop(Scratch.folders.pop())

    def new_path(self, label: str) -> str:
        self.n += 1
        return f"{self.path}/{self.n:04d}-{label}"

    def save(self, df: DataFrame, label: str) -> DataFrame:
        path = self.new_path(label)
        with small_batches(self.spark):
            df.write.option("parquet.block.size", GROUP_BYTES).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tidewater_path = path
        return out

    def drop(self, df: DataFrame | str | None) -> None:
        """Delete a table that nothing reads any more."""
        path = df if isinstance(df, str) else getattr(df, "_tidewater_path", None)
        if path:
            where, files = self._file(path)
            files.delete(where, True)
