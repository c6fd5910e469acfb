"""Enrichment of token vectors by the company they keep, in two passes over the documents' tokens.

A pass adds up 1 / distance x neighbour's vector where the tokens lie. Going by the table of all pairs
(``weights``) gives the same, but that table has several rows for each occurrence.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semaloom.config import HALF_WINDOW, INT8, PASS1_SHARE, PASS2_SHARE
from semaloom.operators import dense
from semaloom.operators.packed import CODES, Packed, bucket, opened, rows, shut
from semaloom.runtime import cut, lean, release


def weights(docs: DataFrame, half: int = HALF_WINDOW) -> DataFrame:
    """(t, n, w): sum of 1 / distance over all pairs of places at most ``half`` apart in a document.

    Pairs come from the token list itself, so there is no join; the sum is partial before its shuffle.
    """
    t = F.col("tokens")
    near = lambda i: F.filter(F.sequence(F.greatest(F.lit(1), i - half), F.least(F.size(t), i + half)), lambda j: j != i)
    one = lambda i: F.transform(near(i), lambda j: F.struct(F.element_at(t, i).alias("t"), F.element_at(t, j).alias("n"), (1.0 / F.abs(j - i)).alias("w")))
    pairs = docs.filter(F.size("tokens") > 0).select(F.inline(F.flatten(F.transform(F.sequence(F.lit(1), F.size(t)), one))))
    return pairs.filter("t is not null and n is not null").groupBy("t", "n").agg(F.sum("w").alias("w"))


#: Components of a vector that a task adds up at a time, and numbers that it holds while it does.
PART, HELD = 32, 1 << 22
#: What goes between tasks: vectors of buckets (block -1), vectors for blocks, sums for buckets; ``part`` counts from 0 by PART components.
SENT = "block long, part int, bucket int, data binary"


def _listed(x: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(x).ravel()), x.shape[1])


def _least(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the shortest type that holds them; anything else as it is."""
    whole = np.rint(x)
    if not np.array_equal(whole, x):
        return x
    top = np.abs(whole).max(initial=0)
    return whole.astype(next((t for t in (np.int8, np.int16, np.int32, np.int64) if top <= np.iinfo(t).max), np.float64))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Components in units of 1/127, as whole numbers if dividing those by 127 gives the same."""
    whole = np.rint(x * INT8)
    return _least(whole if np.array_equal(whole / INT8, x) else x * INT8)


def _values(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, column.type.list_size)


def stored(sources: DataFrame, docs: Packed, dim: int) -> DataFrame:
    """Vectors (token, vec ARRAY<DOUBLE>) by bucket, one row each {token, x}; x is the vector itself."""

    def pack(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        x = dense.matrix(group.column("vec").combine_chunks(), dim)
        data = shut(token=group.column("token").combine_chunks(), x=_listed(x))
        return pa.Table.from_batches([rows(SENT, [-1], [0], [key[0].as_py()], [data])])

    return sources.select("token", "vec", bucket("token", docs.buckets).alias("bucket")).groupBy("bucket").applyInArrow(pack, SENT)


def _answers(docs: Packed, held: DataFrame, scale: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """SENT: to each block the vectors of its tokens, in units of 1/127; zeros where there is none."""

    def answer(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        asked, known, x = [], pa.array([], pa.string()), None
        for block, data in zip(group.column("block").to_pylist(), group.column("data").to_pylist(), strict=True):
            if block < 0:
                got = opened(data)
                known, x = got.column("token"), scale(_values(got.column("x")))
            else:
                asked.append((block, opened(data).column("token")))
        if x is None:
            return pa.Table.from_batches([rows(SENT)])
        x = np.vstack([x, np.zeros((1, x.shape[1]), x.dtype)])
        out: list[tuple[int, int, int, bytes]] = []
        for block, tokens in asked:
            found = x[pc.index_in(tokens, value_set=known).fill_null(len(known)).to_numpy(zero_copy_only=False)]
            out += [(block, at // PART, key[0].as_py(), shut(token=tokens, x=_listed(found[:, at : at + PART]))) for at in range(0, x.shape[1], PART)]
        return pa.Table.from_batches([rows(SENT, *map(list, zip(*out, strict=True)))] if out else [rows(SENT)])

    asks = docs.rows.filter("bucket >= 0").select("block", F.lit(0).alias("part"), "bucket", "data")
    return held.unionByName(asks).groupBy("bucket").applyInArrow(answer, SENT)


def _sums(docs: Packed, answers: DataFrame, dim: int, half: int) -> DataFrame:
    """SENT: each block's sums over neighbours, for the buckets of its tokens, in units of 1 / (127 x the weights' common denominator).

    Vectors of whole numbers have whole sums, which are exact; so the order of addition does not show.
    """
    unit = math.lcm(*range(1, half + 1))
    parts = -(-dim // PART)

    def add(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        found = {b: data for b, data in zip(group.column("bucket").to_pylist(), group.column("data").to_pylist(), strict=True)}
        got, n = opened(found.pop(CODES)), opened(found.pop(CODES - 1)).column("n").to_numpy()
        if not found:
            return pa.Table.from_batches([rows(SENT)])
        codes = got.column(0).to_numpy()
        answered = [(b, opened(found[b])) for b in sorted(found)]
        x = np.concatenate([_values(a.column("x")) for _, a in answered]).astype(np.float64)
        size, width = x.shape
        x = np.vstack([x, np.zeros((1, width))])
        # documents parted by places without a token, so that no window reaches the next one
        place = np.full(len(codes) + half * (len(n) + 1), -1, np.int32)
        place[np.arange(len(codes)) + half * (1 + np.repeat(np.arange(len(n)), n))] = codes
        sums = np.zeros((size, width))
        step = max(8192, HELD // width)
        for lo in range(half, len(place) - half, step):
            hi = min(lo + step, len(place) - half)
            near = x[place[lo - half : hi + half]]
            m = hi - lo
            total = np.zeros((m, width))
            for d in range(1, half + 1):
                total += unit // d * (near[half - d : half - d + m] + near[half + d : half + d + m])
            own = place[lo:hi]
            total, own = total[own >= 0], own[own >= 0]
            for i in range(width):
                sums[:, i] += np.bincount(own, total[:, i], size)
        out, at = [], 0
        for b, a in answered:
            part = sums[at : at + a.num_rows]
            at += a.num_rows
            out.append((key[0].as_py(), key[1].as_py(), b, shut(token=a.column("token"), x=_listed(_least(part)))))
        release()
        return pa.Table.from_batches([rows(SENT, *map(list, zip(*out, strict=True)))])

    # a block's documents come as the bucket below that of its codes
    own = docs.rows.filter("bucket < 0").select("block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.when(F.col("bucket") == CODES, CODES).otherwise(CODES - 1).alias("bucket"), "data")
    return answers.unionByName(own).groupBy("block", "part").applyInArrow(add, SENT)


def _pass(docs: Packed, held: DataFrame, dim: int, scale: Callable[[np.ndarray], np.ndarray], work: Callable[[np.ndarray, np.ndarray], np.ndarray], half: int) -> DataFrame:
    """Vectors by bucket: ``work`` on those before and the sums of their neighbours'."""
    unit = math.lcm(*range(1, half + 1)) * INT8

    def total(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        blocks, datas = group.column("block").to_pylist(), group.column("data").to_pylist()
        if -1 not in blocks:
            return pa.Table.from_batches([rows(SENT)])
        own = opened(datas[blocks.index(-1)])
        known, a = own.column("token"), _values(own.column("x")).astype(np.float64)
        b = np.zeros(a.shape)
        for block, part, data in zip(blocks, group.column("part").to_pylist(), datas, strict=True):
            if block >= 0:
                got = opened(data)
                at = pc.index_in(got.column("token"), value_set=known)
                some = at.is_valid().to_numpy(zero_copy_only=False)
                x = _values(got.column("x"))
                b[at.drop_null().to_numpy(), part * PART : part * PART + x.shape[1]] += x[some]
        return pa.Table.from_batches([rows(SENT, [-1], [0], [key[0].as_py()], [shut(token=known, x=_listed(work(a, b / unit)))])])

    sums = _sums(docs, _answers(docs, held, scale), dim, half)
    return cut(held.unionByName(sums).groupBy("bucket").applyInArrow(total, SENT))


def _first(docs: Packed, sources: DataFrame, dim: int, half: int) -> DataFrame:
    return _pass(docs, cut(stored(sources, docs, dim)), dim, _scaled, lambda a, b: dense.to_int8(dense.unit(a + b)), half)


def _rows(held: DataFrame) -> DataFrame:
    """(token, q) of vectors by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                got = opened(data)
                yield pa.RecordBatch.from_arrays([got.column("token"), dense.lists(_values(got.column("x")))], names=["token", "q"])

    return held.select("data").mapInArrow(lean(run), "token string, q array<tinyint>")


def pass1(docs: Packed, sources: DataFrame, dim: int, half: int = HALF_WINDOW) -> DataFrame:
    """(token, q): source vector plus weighted neighbours, made unit and quantized."""
    return _rows(_first(docs, sources, dim, half))


def enrich(docs: Packed, sources: DataFrame, dim: int, half: int = HALF_WINDOW) -> DataFrame:
    """(token, q): 0.7 of the first pass and 0.3 of its neighbours' sum, which is quantized unscaled and so saturates."""

    def blend(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return dense.to_int8(dense.unit(PASS1_SHARE * a + PASS2_SHARE * dense.to_int8(b).astype(np.float64)))

    return _rows(_pass(docs, _first(docs, sources, dim, half), dim, lambda q: q, blend, half))
