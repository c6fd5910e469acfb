"""Vector functions on arrays, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from semaloom.config import EPSILON, INT8


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    """Sum of products, in doubles."""
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def int8_dot(a: Column, b: Column) -> Column:
    """Sum of products, in integers."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("long") * y.cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in [-1, 1]; 0 for null and (nearly) zero vectors."""
    size = norm(a) * norm(b)
    return F.when(a.isNull() | b.isNull() | (size < EPSILON), F.lit(0.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / size)))


def normalize(v: Column) -> Column:
    """Unit vector; a (nearly) zero vector stays as it is."""
    return F.when(norm(v) < EPSILON, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x / norm(v)))


def add_scaled(target: Column, source: Column, scale: float | Column) -> Column:
    s = scale if isinstance(scale, Column) else F.lit(float(scale))
    return F.zip_with(target, source, lambda x, y: x.cast("double") + s * y.cast("double"))


def quantize(v: Column) -> Column:
    """127 x, limited to -127..127, rounded half to even; what is not finite becomes 0."""

    def one(x: Column) -> Column:
        wide = x.cast("double") * INT8
        odd = F.isnan(wide) | (F.abs(wide) == F.lit(float("inf"))) | wide.isNull()
        return F.when(odd, F.lit(0.0)).otherwise(F.rint(F.greatest(F.lit(-float(INT8)), F.least(F.lit(float(INT8)), wide)))).cast("tinyint")

    return F.transform(v, one)


def dequantize(q: Column) -> Column:
    return F.transform(q, lambda x: x / F.lit(float(INT8)))


def inv_mag(q: Column) -> Column:
    """1 / length of a quantized vector; 0 for the zero vector."""
    square = int8_dot(q, q)
    return F.when(square > 0, 1.0 / F.sqrt(square.cast("double"))).otherwise(F.lit(0.0))


def sparsify(q: Column, keep: int) -> Column:
    """The ``keep`` largest components other than 0 as (i, v) by index; of equal ones those with lower indices."""
    spots = F.filter(F.transform(q, lambda v, i: F.struct((-F.abs(v.cast("int"))).alias("m"), i.alias("i"), v.alias("v"))), lambda e: e["m"] != 0)
    return F.array_sort(F.transform(F.slice(F.array_sort(spots), 1, max(1, keep)), lambda e: F.struct(e["i"].alias("i"), e["v"].alias("v"))))


def sparse_dot(sparse: Column, dense: Column) -> Column:
    """Integer dot product of (i, v) pairs with a dense vector; indices beyond it count nothing."""
    inside = F.filter(sparse, lambda e: e["i"] < F.size(dense))
    return F.aggregate(inside, F.lit(0).cast("long"), lambda s, e: s + F.element_at(dense, e["i"] + 1).cast("long") * e["v"].cast("long"))


def unit_score(product: Column, inv_a: Column, inv_b: Column) -> Column:
    """(cosine + 1) / 2 in [0, 1]; 0 if either vector is zero."""
    return F.when((inv_a <= 0) | (inv_b <= 0), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (product * inv_a * inv_b + 1.0) / 2.0)))


def sparse_cosine(a: Column, b: Column) -> Column:
    """Cosine of two maps of term weights; 0 if either is empty or (nearly) zero."""
    weight = lambda m, k: F.coalesce(F.try_element_at(m, k), F.lit(0.0)).cast("double")
    product = F.aggregate(F.map_keys(a), F.lit(0.0), lambda s, k: s + weight(a, k) * weight(b, k))
    square = lambda m: F.aggregate(F.map_values(m), F.lit(0.0), lambda s, w: s + w.cast("double") * w.cast("double"))
    size = F.sqrt(square(a)) * F.sqrt(square(b))
    return F.coalesce(F.when(size > EPSILON, product / size), F.lit(0.0))
