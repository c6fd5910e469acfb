"""Vectors of tokens: a table, a blob file, or a stand-in made from digests.

A provider gives (token, vec ARRAY<DOUBLE>) for the tokens of a vocabulary, zeros for tokens it
knows nothing about. Tokens that a table lacks are composed of its longest pieces.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semaloom.config import EPSILON, INT8, SUBWORD_LENGTH, SUBWORD_PIECES

class DigestVectors:
    """A deterministic stand-in for trained vectors: component d of a token is a digest of ``token:d``, in -127..127."""

    def __init__(self, dim: int):
        self.dim = dim

    def vectors(self, vocab: DataFrame) -> DataFrame:
        one = lambda d: ((F.conv(F.substring(F.md5(F.concat("token", F.lit(":"), d.cast("string"))), 1, 8), 16, 10).cast("bigint") % 255 - 127) / float(INT8))
        return vocab.select("token", F.transform(F.sequence(F.lit(0), F.lit(self.dim - 1)), one).alias("vec"))


class TableVectors:
    """Vectors from a table (token, vec ARRAY<TINYINT>) in units of 1/127, with composed vectors for other tokens."""

    def __init__(self, table: DataFrame, dim: int, compose: bool = True):
        self.table, self.dim, self.compose = table, dim, compose

    def vectors(self, vocab: DataFrame) -> DataFrame:
        zeros = F.array_repeat(F.lit(0.0), self.dim)
        scaled = self.table.select("token", F.transform("vec", lambda x: x / float(INT8)).alias("_vec"))
        known = vocab.select("token").join(scaled, "token", "left")
        if not self.compose:
            return known.select("token", F.coalesce("_vec", zeros).alias("vec"))
        pieces = decompose(known.filter("_vec is null").select("token"), self.table.select("token"))
        at = pieces.select("token", F.posexplode("pieces").alias("n", "piece")).join(scaled.withColumnRenamed("token", "piece"), "piece")
        spread = at.select("token", F.posexplode("_vec").alias("d", "x")).groupBy("token", "d").agg(F.sum("x").alias("x"))
        sums = spread.groupBy("token").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda e: e["x"]).alias("_sum"))
        size = F.sqrt(F.aggregate("_sum", F.lit(0.0), lambda s, x: s + x * x))
        composed = sums.select("token", F.when(size >= EPSILON, F.transform("_sum", lambda x: x / size)).alias("_composed"))
        return known.join(composed, "token", "left").select("token", F.coalesce("_vec", "_composed", zeros).alias("vec"))


def decompose(tokens: DataFrame, vocabulary: DataFrame | list[str]) -> DataFrame:
    """(token, pieces): longest pieces of the vocabulary from left to right, at most 8 of at most 24 characters; others are skipped.

    A token's own substrings, at most 24 for each of its characters, are joined with the vocabulary,
    so no task holds it, whatever its size. A null token has no pieces.
    """

    def split(token: str, known: frozenset[str]) -> list[str]:
        out: list[str] = []
        at = 0
        while at < len(token) and len(out) < SUBWORD_PIECES:
            piece = next((token[at:end] for end in range(min(len(token), at + SUBWORD_LENGTH), at, -1) if token[at:end] in known), None)
            if piece:
                out.append(piece)
            at += len(piece) if piece else 1
        return out

    spark = tokens.sparkSession
    if isinstance(vocabulary, list):
        vocabulary = spark.createDataFrame([(t,) for t in vocabulary], "token string")
    asked = tokens.select("token").distinct()
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("token")))
    at = asked.filter("token is not null").withColumn("_at", F.explode(starts))
    at = at.withColumn("_n", F.explode(F.sequence(F.lit(1), F.least(F.lit(SUBWORD_LENGTH), F.greatest(F.lit(1), F.length("token") - F.col("_at") + 1)))))
    parts = at.select("token", F.expr("substring(token, _at, _n)").alias("_piece")).distinct()
    known = parts.join(vocabulary.select(F.col("token").alias("_piece")).distinct(), "_piece").groupBy("token").agg(F.collect_set("_piece").alias("_known"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = [split(t or "", frozenset(k or ())) for t, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pieces, pa.list_(pa.string()))], names=["token", "pieces"])

    return tokens.select("token").join(known, "token", "left").select("token", "_known").mapInArrow(work, "token string, pieces array<string>")


def read_blob(spark: SparkSession, raw: bytes, tokens: list[str], dim: int) -> DataFrame:
    """A table (token, vec) from ``<i32 count><i32 dim><count x dim int8>``, little-endian; refuses what does not fit."""
    if len(raw) < 8:
        raise ValueError("the blob has no header")
    count, width = struct.unpack_from("<ii", raw)
    if count != len(tokens) or width != dim or len(raw) < 8 + count * dim:
        raise ValueError(f"the blob holds {count} x {width} in {len(raw)} bytes, not {len(tokens)} x {dim}")
    table = np.frombuffer(raw, np.int8, count * dim, 8).reshape(count, dim)
    return spark.createDataFrame(pa.table({"token": pa.array(tokens), "vec": pa.array(list(table), pa.list_(pa.int8()))}))


class Projected:
    """Another provider's vectors, reduced by ``(x - mean) @ basis``."""

    def __init__(self, inner: DigestVectors | TableVectors, mean: np.ndarray, basis: np.ndarray):
        self.inner, self.mean, self.basis = inner, mean, basis
        self.dim = basis.shape[1]

    def vectors(self, vocab: DataFrame) -> DataFrame:
        mean, basis = self.mean, self.basis

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = np.asarray(batch.column(1).flatten()).reshape(-1, len(mean))
                zero = ~x.any(1, keepdims=True)
                y = np.where(zero, 0.0, (x - mean) @ basis)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(y), pa.list_(pa.float64()))], names=["token", "vec"])

        return self.inner.vectors(vocab).mapInArrow(work, "token string, vec array<double>")


def fit_pca(vectors: DataFrame, column: str, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, basis, explained share of variance) of the ``k`` main directions."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    rows = vectors.select(array_to_vector(F.transform(column, lambda x: x.cast("double"))).alias("x"))
    model = PCA(k=k, inputCol="x", outputCol="y").fit(rows)
    mean = rows.select(Summarizer.mean(F.col("x"))).first()[0].toArray()
    return mean, model.pc.toArray(), model.explainedVariance.toArray()
