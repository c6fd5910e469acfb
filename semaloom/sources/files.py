"""Source files and JSON lines as documents."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from semaloom.config import FILE_CAP_DEFAULT
from semaloom.functions.text import chunks

# Endings of source files.
EXTENSIONS = (".c", ".h", ".cpp", ".hpp", ".java", ".py", ".rs", ".go", ".js", ".ts")


class SourceFiles(DataSource):
    """``spark.read.format("source_files").option("path", ...)``: a folder's source files.

    Spark's own file readers leave out names that begin with an underscore, which source trees
    have; this one leaves out names that begin with a dot, symbolic links, and other endings. The
    folder must be reachable from all executors. Missing, empty and oversized files are left out.
    """

    @classmethod
    def name(cls) -> str:
        return "source_files"

    def schema(self) -> str:
        return "path string, length bigint, content binary"

    def reader(self, schema) -> SourceFilesReader:
        return SourceFilesReader(dict(self.options))


class _Group(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(len(paths))
        self.paths = paths


class SourceFilesReader(DataSourceReader):
    """Partitions are runs of files of about 32 MB."""

    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.endings = tuple(options.get("extensions", ",".join(EXTENSIONS)).split(","))
        self.most = int(options.get("maxbytes", options.get("maxBytes", FILE_CAP_DEFAULT)))

    def _walk(self) -> Iterator[tuple[str, int]]:
        for folder, folders, names in os.walk(self.root):
            folders[:] = sorted(f for f in folders if not f.startswith(".") and not os.path.islink(os.path.join(folder, f)))
            for name in sorted(names):
                path = os.path.join(folder, name)
                if not name.startswith(".") and name.endswith(self.endings) and not os.path.islink(path) and os.path.isfile(path):
                    size = os.path.getsize(path)
                    if 0 < size <= self.most:
                        yield path, size

    def partitions(self) -> list[InputPartition]:
        groups: list[InputPartition] = []
        paths: list[str] = []
        total = 0
        for path, size in self._walk():
            paths.append(path)
            total += size
            if total >= 32 << 20:
                groups.append(_Group(paths))
                paths, total = [], 0
        return [*groups, _Group(paths)]

    def read(self, partition: _Group) -> Iterator[pa.RecordBatch]:
        for path in partition.paths:
            try:
                with open(path, "rb") as f:
                    raw = f.read()
            except OSError:
                continue
            if raw:
                yield pa.RecordBatch.from_pydict({"path": [path], "length": [len(raw)], "content": [raw]}, pa.schema([("path", pa.string()), ("length", pa.int64()), ("content", pa.binary())]))


def source_files(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS, max_bytes: int = FILE_CAP_DEFAULT) -> DataFrame:
    """(path, length, content) of a folder's source files."""
    from semaloom.runtime import ensure_shipped

    ensure_shipped(spark)
    spark.dataSource.register(SourceFiles)
    return spark.read.format("source_files").option("path", root).option("extensions", ",".join(extensions)).option("maxBytes", str(max_bytes)).load()


def chunked(files: DataFrame, size: int, max_bytes: int = FILE_CAP_DEFAULT) -> DataFrame:
    """(path, chunk_no, content): files cut behind the ``}`` that follows every ``size`` bytes. Empty and oversized files have none."""
    fit = files.filter(F.octet_length("content").between(1, max_bytes))
    return fit.select("path", F.posexplode(chunks(F.col("content"), size)).alias("chunk_no", "content"))


def chunk_counts(files: DataFrame, chunk_rows: DataFrame) -> DataFrame:
    """(path, n): chunks of each file, 0 for files without any."""
    counts = chunk_rows.groupBy("path").agg(F.count("*").alias("n"))
    return files.select("path").join(counts, "path", "left").select("path", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, label, text) from lines ``{"id": ..., "path": ..., "text": ...}``."""
    return spark.read.schema("id BIGINT, path STRING, text STRING").json(path).select(F.col("id").alias("doc_id"), F.col("path").alias("label"), "text")
