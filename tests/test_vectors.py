import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from semaloom.functions import vectors as V
from semaloom.operators import dense


def one(spark, column, **arrays):
    row = spark.createDataFrame([tuple(arrays.values())], ", ".join(f"{k} array<double>" for k in arrays))
    return row.select(column).first()[0]


def test_cosine(spark):
    a, b = F.col("a"), F.col("b")
    assert one(spark, V.cosine(a, b), a=[1.0, 0.0], b=[0.0, 1.0]) == 0
    assert one(spark, V.cosine(a, b), a=[3.0, 4.0], b=[6.0, 8.0]) == 1
    assert one(spark, V.cosine(a, b), a=[0.0, 0.0], b=[6.0, 8.0]) == 0
    assert one(spark, V.cosine(a, b), a=None, b=[6.0, 8.0]) == 0


def test_normalize_and_add(spark):
    assert one(spark, V.normalize(F.col("a")), a=[3.0, 4.0]) == pytest.approx([0.6, 0.8])
    assert one(spark, V.normalize(F.col("a")), a=[0.0, 0.0]) == [0.0, 0.0]
    assert one(spark, V.add_scaled(F.col("a"), F.col("b"), 0.5), a=[1.0, 0.0], b=[2.0, 3.0]) == [2.0, 1.5]


def test_quantize(spark):
    values = [0.0, 1.0, -1.0, 2.0, -2.0, math.nan, math.inf, -math.inf, 0.5 / 127, 1.5 / 127, 2.5 / 127]
    got = one(spark, V.quantize(F.col("a")), a=values)
    assert got == [0, 127, -127, 127, -127, 0, 0, 0, 0, 2, 2]
    assert list(dense.to_int8(np.array(values))) == got


def test_inverse_magnitude_and_unit_score(spark):
    q = F.col("a").cast("array<tinyint>")
    assert one(spark, V.inv_mag(q), a=[3.0, 4.0]) == pytest.approx(0.2)
    assert one(spark, V.inv_mag(q), a=[0.0, 0.0]) == 0
    assert one(spark, V.unit_score(F.lit(1), F.lit(0.0), F.lit(1.0)), a=[0.0]) == 0
    assert one(spark, V.unit_score(F.lit(-1), F.lit(1.0), F.lit(1.0)), a=[0.0]) == 0
    assert one(spark, V.unit_score(F.lit(1), F.lit(1.0), F.lit(1.0)), a=[0.0]) == 1


def test_sparse(spark):
    q, b = F.col("a").cast("array<tinyint>"), F.col("b").cast("array<tinyint>")
    assert [tuple(e) for e in one(spark, V.sparsify(q, 3), a=[1.0, -5.0, 0.0, 5.0, 1.0])] == [(0, 1), (1, -5), (3, 5)]
    assert [tuple(e) for e in one(spark, V.sparsify(q, 3), a=[0.0, 0.0])] == []
    assert one(spark, V.sparse_dot(V.sparsify(q, 2), b), a=[1.0, -5.0, 0.0, 5.0], b=[9.0, 1.0, 9.0, 2.0]) == 5


def test_sparse_cosine(spark):
    maps = spark.createDataFrame([({0: 1.0, 1: 1.0}, {1: 1.0, 2: 1.0})], "a map<int,double>, b map<int,double>")
    assert maps.select(V.sparse_cosine(F.col("a"), F.col("b"))).first()[0] == pytest.approx(0.5)
    empty = spark.createDataFrame([({}, {1: 1.0})], "a map<int,double>, b map<int,double>")
    assert empty.select(V.sparse_cosine(F.col("a"), F.col("b"))).first()[0] == 0
