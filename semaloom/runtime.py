"""Session helpers shared by every plan: checkpoints on the shared folder and code shipping."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ensure_shipped(spark: SparkSession) -> None:
    """Send this package to the executors once per application.

    Python functions are pickled by reference, so executors must be able to import
    ``semaloom`` even when the driver was started from another folder.
    """
    bound_batches(spark)
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="semaloom"), "semaloom_src.zip")
    with zipfile.ZipFile(out, "w") as z:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    sc.addPyFile(out)
    _SHIPPED.add(sc.applicationId)


#: Rows of an Arrow batch, and of a batch of the Parquet reader, where the session says nothing else:
#: texts may be long, and a batch is held whole, in the reader as one array that doubles as it grows.
BATCH_ROWS, READER_ROWS = 512, 512


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches and the Parquet reader's batches small unless the session has its own settings."""
    for name, usual, rows in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", BATCH_ROWS), ("spark.sql.parquet.columnarReaderBatchSize", "4096", READER_ROWS)):
        if spark.conf.get(name) == usual:
            spark.conf.set(name, str(rows))


def release() -> None:
    """Give memory that this process has freed back to the machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` for mapInArrow, releasing memory at its end: workers live on between tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            release()

    return run


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a local one only where it is unset and one machine does all work."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current is None:
        configured = sc.getConf().get("spark.checkpoint.dir", None)
        if not configured and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="semaloom-checkpoint-"))
        current = sc.getCheckpointDir()
    return current


def cut(df: DataFrame, small: bool = False) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage.

    ``small``: its rows are few and short beside what they are made from, so it is written by as
    many tasks as there are cores, one file each, instead of a file for every partition.
    """
    checkpoint_dir(df.sparkSession)
    if small:
        df = df.coalesce(max(1, df.sparkSession.sparkContext.defaultParallelism))
    return df.checkpoint(eager=True)


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt out by ``key`` if it has fewer partitions than the session has cores; as it is otherwise.

    A file that is read in one piece would keep one core busy. Large inputs come in many pieces and
    are not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
