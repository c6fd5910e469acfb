"""Bulk linear algebra on array columns: Arrow batches in NumPy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semaloom.config import EPSILON, INT8


def matrix(column: pa.Array, dim: int, kind: type = np.float64) -> np.ndarray:
    """The rows of an array column without nulls."""
    return np.asarray(column.flatten()).astype(kind, copy=False).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(1, keepdims=True))
    return np.where(size < EPSILON, x, x / np.where(size < EPSILON, 1.0, size))


def to_int8(x: np.ndarray) -> np.ndarray:
    """127 x, limited, rounded half to even. Nine decimals decide what a half is, so the order of sums does not."""
    wide = np.where(np.isfinite(x), x, 0.0) * INT8
    return np.rint(np.round(np.clip(wide, -INT8, INT8), 9)).astype(np.int8)


def lists(x: np.ndarray) -> pa.Array:
    n, dim = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * dim + 1, dim, dtype=np.int32)), pa.array(np.ascontiguousarray(x).ravel()))


def map_vectors(df: DataFrame, key: str, vector: str, dim: int, work, out: str) -> DataFrame:
    """(key, vector of ``out`` type): ``work`` turns a matrix into one of as many rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), lists(work(matrix(batch.column(1), dim)))], names=[key, vector])

    return df.select(key, vector).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, `{vector}` array<{out}>")


#: Up to so many dimensions sums are taken in the JVM, one object per row; above it in Arrow batches.
JVM_DIM = 32


def weighted_sum(rows: DataFrame, key: str, vector: str, weight: str, dim: int) -> DataFrame:
    """(key, vec): sum of weight x vector per key.

    Short vectors are summed by partial aggregation in the JVM. Long ones are dealt out and sorted by
    key, and each task adds up runs of equal keys batch by batch, so it holds one batch and one sum.
    """
    if dim <= JVM_DIM:
        from pyspark.ml.functions import array_to_vector, vector_to_array
        from pyspark.ml.stat import Summarizer

        scaled = rows.select(key, array_to_vector(F.transform(vector, lambda x: x.cast("double") * F.col(weight))).alias("_v"))
        return scaled.groupBy(key).agg(vector_to_array(Summarizer.sum(F.col("_v"))).alias("vec"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried = None, np.zeros(dim)
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column(0).dictionary_encode()
            index = codes.indices.to_numpy()
            starts = np.flatnonzero(np.concatenate(([True], index[1:] != index[:-1])))
            x = matrix(batch.column(1), dim) * batch.column(2).to_numpy()[:, None]
            sums = np.add.reduceat(x, starts)
            keys = codes.dictionary.take(pa.array(index[starts])).to_pylist()
            if last is not None and keys[0] == last[0]:
                sums[0] += carried
            elif last is not None:
                yield pa.RecordBatch.from_arrays([pa.array([last[0]], batch.schema.field(0).type), lists(carried[None])], names=[key, "vec"])
            if len(keys) > 1:
                yield pa.RecordBatch.from_arrays([pa.array(keys[:-1], batch.schema.field(0).type), lists(sums[:-1])], names=[key, "vec"])
            last, carried, kind = (keys[-1],), sums[-1].copy(), batch.schema.field(0).type
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last[0]], kind), lists(carried[None])], names=[key, "vec"])

    dealt = rows.select(key, vector, F.col(weight).cast("double").alias("_w")).repartition(F.col(key)).sortWithinPartitions(key)
    return dealt.mapInArrow(work, f"`{key}` {dict(rows.dtypes)[key]}, vec array<double>")


def mean_vector(rows: DataFrame, vector: str) -> np.ndarray | None:
    """Mean of a vector column: one row reaches the driver."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    got = rows.agg(Summarizer.mean(array_to_vector(F.col(vector))).alias("m"), F.count("*").alias("n")).first()
    return got["m"].toArray() if got["n"] else None
