"""Folders that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Removes the shuffle files of a query when it has ended: what it wrote is all that is read later.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Rows and bytes of a batch for Python, and rows that a Parquet reader decodes at once: batches of ten thousand long texts
#: would be held several times over in each worker, and outside the heap of its executor.
SMALL_BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
    "spark.sql.parquet.columnarReaderBatchSize": "512",
}
#: Bytes of a row group: what a writing task holds in the executor's heap.
ROW_GROUP = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Where none is set a folder of this session, on one machine only: elsewhere
    executors would write to their own disks and readers would miss rows, so that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.logoscope.scratch", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = f"file://{tempfile.mkdtemp(prefix='logoscope-')}"
        spark.conf.set("spark.logoscope.scratch", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/logoscope/{name}-{uuid.uuid4().hex}"


@contextmanager
def tidy_shuffles(spark: SparkSession):
    """Queries that end inside leave no shuffle files, and hand texts to Python a little at a time."""
    wanted = {CLEANUP: "true"} | SMALL_BATCHES
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def save(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to ``path`` and read again: lost executors then cost no recomputation."""
    spark = df.sparkSession
    with tidy_shuffles(spark):
        df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again. The cluster's owner cleans that folder."""
    return save(df, new_path(df.sparkSession, name))


def discard(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder through Spark's file system layer."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


class Workspace:
    """Tables of one job under a path of their own, deleted when the job's ``with`` block ends; ``kept`` ones stay, as
    the job's result is read from them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.number = spark, new_path(spark, name), 0
        self.of: dict[int, tuple[DataFrame, str]] = {}

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *error) -> None:
        discard(self.spark, self.path)

    def written(self, df: DataFrame, name: str) -> DataFrame:
        self.number += 1
        path = f"{self.path}/{self.number:04d}-{name}"
        back = save(df, path)
        self.of[id(back)] = (back, path)
        return back

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for df in tables:
            discard(self.spark, self.of.pop(id(df))[1])

    def kept(self, df: DataFrame, name: str) -> DataFrame:
        return written(df, name)


def give_back() -> None:
    """What this Python worker has freed goes back to the system; else an idle worker keeps its largest size."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    system = ctypes.CDLL(None)
    if hasattr(system, "malloc_trim"):
        system.malloc_trim(0)


_remembered: dict[str, dict] = {}


def remembered(kind: str) -> dict:
    """What tasks of one kind keep for each other in this Python worker. Workers outlive jobs, so what another kind of work
    has kept is dropped first and its memory goes back to the system: only one kind's tables are held at a time."""
    if _remembered and kind not in _remembered:
        _remembered.clear()
        give_back()
    return _remembered.setdefault(kind, {})


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
