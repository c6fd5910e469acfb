"""Exact inner-product top-k by ball trees.

Vectors are dealt to shards by a digest of their id; each shard builds one ball tree of bounded
size. A query first searches its home shard; the score of its k-th hit then goes along to all
other shards, where it prunes from the start. Nodes are taken in order of the upper bound
q.c + |q| r of the inner product, until the bound falls below the k-th score so far. Scores are
integers, and nothing is approximate.

Queries are replicated to the shards (a stated query set against all rows, in blocks); each task
holds one shard and one block of queries, both of bounded size.

Defined cases: vectors that are null, empty or hold null or non-finite components, and rows
without an id, take no part; vectors of another length than the query's are no candidates; rows
that carry the query's id are its own; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from semaloom.runtime import cut

#: Rows of a shard and queries of a block, at most; shards there are at least; rows of a leaf.
SHARD_ROWS, BLOCK_ROWS, LEAST_SHARDS, LEAF = 100_000, 20_000, 6, 64
SCALE = 1024


def clean(table: DataFrame, key: str, vector: str, scale: int | None) -> DataFrame:
    """(id, dim, vec) of the rows that take part; vec holds int64 of floor(scale * x), or (with no scale) doubles of vectors that are not zero."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims, out = [], [], []
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                column = part.column(1)
                lists = column.cast(pa.list_(pa.float64()))
                offsets = lists.offsets.to_numpy()
                child = lists.values
                flat = child.to_numpy(zero_copy_only=False) if child.null_count else np.asarray(child)
                for i, (key_, ok) in enumerate(zip(part.column(0).to_pylist(), column.is_valid().to_pylist(), strict=True)):
                    v = flat[offsets[i] : offsets[i + 1]]
                    if ok and key_ is not None and len(v) and np.isfinite(v).all() and (scale or v.any()):  # a null component reads as NaN
                        ids.append(key_)
                        dims.append(len(v))
                        out.append((np.floor(v * scale).astype("<i8") if scale else v.astype("<f8")).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], names=["id", "dim", "vec"])

    rows = table.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return rows.mapInArrow(work, "id long, dim int, vec binary")


class BallTree:
    """Nodes in preorder: center, radius, rows [lo, hi) of the reordered vectors, right child (0 for a leaf)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        self.nodes: list[tuple[np.ndarray, float, int, int, int]] = []
        points = vectors.astype(np.float64)
        at = np.arange(len(ids))
        stack = [(0, len(ids), -1)]
        rights: dict[int, int] = {}
        while stack:
            lo, hi, parent = stack.pop()
            number = len(self.nodes)
            if parent >= 0:
                rights[parent] = number
            rows = points[at[lo:hi]]
            center = rows.mean(0)
            away = ((rows - center) ** 2).sum(1)
            self.nodes.append((center, float(np.sqrt(away.max())), lo, hi, 0))
            if hi - lo > LEAF and away.max() > 0:
                a = rows[away.argmax()]
                b = rows[((rows - a) ** 2).sum(1).argmax()]
                side = rows @ (b - a)
                half = (hi - lo) // 2
                at[lo:hi] = at[lo:hi][np.argpartition(side, half)]
                stack += [(lo + half, hi, number), (lo, lo + half, -1)]  # the left child follows at once
        self.centers = np.array([n[0] for n in self.nodes])
        self.radii = np.array([n[1] for n in self.nodes])
        self.lo, self.hi = np.array([n[2] for n in self.nodes]), np.array([n[3] for n in self.nodes])
        self.right = np.zeros(len(self.nodes), np.int64)
        for k, v in rights.items():
            self.right[k] = v
        self.ids, self.vectors = ids[at], vectors[at]
        self._ready()

    def _ready(self) -> None:
        most = int(np.abs(self.vectors).max(initial=0))
        self.most = most
        self.points = self.vectors.astype(np.float64)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, centers=self.centers, radii=self.radii, lo=self.lo, hi=self.hi, right=self.right, ids=self.ids, vectors=self.vectors)
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> BallTree:
        tree = cls.__new__(cls)
        with np.load(io.BytesIO(raw)) as z:
            tree.centers, tree.radii, tree.lo, tree.hi, tree.right, tree.ids, tree.vectors = (z[k] for k in ("centers", "radii", "lo", "hi", "right", "ids", "vectors"))
        tree._ready()
        return tree

    def search(self, own: int, query: np.ndarray, bounds: np.ndarray, k: int, least: int | None) -> list[tuple[int, int]]:
        """The k best (score, id) of this shard, by score and smaller id; those below ``least`` may be missing."""
        exact = self.most * int(np.abs(query).max(initial=0)) * len(query) < 1 << 53  # then doubles hold every sum
        point = query.astype(np.float64)
        best: list[tuple[int, int]] = []  # a heap of (score, -id)
        queue = [(-bounds[0], 0)]
        while queue:
            bound, node = heapq.heappop(queue)
            floor = best[0][0] if len(best) == k else least
            if floor is not None and -bound < floor:
                break
            right = self.right[node]
            if right:
                heapq.heappush(queue, (-min(-bound, bounds[node + 1]), node + 1))
                heapq.heappush(queue, (-min(-bound, bounds[right]), int(right)))
                continue
            lo, hi = self.lo[node], self.hi[node]
            if exact:
                scores = (self.points[lo:hi] @ point).astype(np.int64)
            else:
                scores = np.array([sum(int(a) * int(b) for a, b in zip(v, query, strict=True)) for v in self.vectors[lo:hi]], dtype=object)
            for i in np.flatnonzero(scores >= floor) if floor is not None else range(len(scores)):
                hit = (int(scores[i]), -int(self.ids[lo + i]))
                if -hit[1] == own:
                    continue
                if len(best) < k:
                    heapq.heappush(best, hit)
                elif hit > best[0]:
                    heapq.heapreplace(best, hit)
        return [(s, -i) for s, i in best]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bounds of the inner product of each query with each node, with room for rounding."""
        q = queries.astype(np.float64)
        size = np.sqrt((q * q).sum(1))[:, None]
        reach = q @ self.centers.T + size * self.radii
        return reach + 1e-9 * (np.abs(reach) + size * (np.sqrt((self.centers**2).sum(1)) + self.radii)) + 1e-6


def _stack(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, dim)


def topk(vectors: DataFrame, queries: Column, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): ``vectors`` from :func:`clean`, ``queries`` a condition on its ``id``."""
    vectors = cut(vectors)
    n, n_queries = vectors.count(), vectors.filter(queries).count()
    shards = max(LEAST_SHARDS, -(-n // SHARD_ROWS))
    blocks = max(1, -(-n_queries // BLOCK_ROWS))
    shard = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        dim = key[1].as_py()
        tree = BallTree(rows.column("id").to_numpy(), _stack(rows.column("vec"), dim))
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "dim": pa.array([dim], pa.int32()), "tree": pa.array([tree.dump()], pa.binary())})

    def look(key: tuple, trees: pa.Table, asked: pa.Table) -> pa.Table:
        hits: list[tuple[int, int, int]] = []
        if trees.num_rows and asked.num_rows:
            tree = BallTree.load(trees.column("tree")[0].as_py())
            ids, least = asked.column("id").to_pylist(), asked.column("least").to_pylist()
            points = _stack(asked.column("vec"), asked.column("dim")[0].as_py())
            for at in range(0, len(ids), 256):
                for i, bounds in enumerate(tree.bounds(points[at : at + 256]), at):
                    hits += [(ids[i], v, s) for s, v in tree.search(ids[i], points[i], bounds, k, least[i])]
        columns = list(zip(*hits, strict=True)) or [(), (), ()]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), columns, strict=True)})

    trees = cut(vectors.withColumn("shard", shard).groupBy("shard", "dim").applyInArrow(build, "shard int, dim int, tree binary"))
    trees = trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = vectors.filter(queries).withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int")).dropDuplicates(["id", "vec"])

    def search(rows: DataFrame) -> DataFrame:
        keys = ("shard", "dim", "block")
        return trees.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(look, "query_id long, vec_id long, score long")

    home = cut(search(asked.withColumn("shard", shard).withColumn("least", F.lit(None).cast("long"))))
    kth = home.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    others = F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s != F.col("home"))
    rest = asked.withColumn("home", shard).join(kth, F.col("id") == F.col("query_id"), "left").withColumn("shard", F.explode(others))
    found = home.unionByName(search(rest.select("id", "dim", "vec", "block", F.col("shard").cast("int").alias("shard"), "least")))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_balltree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = clean(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", SCALE)
    return topk(vectors, F.pmod(F.col("id"), F.lit(100)) == 0, 10)


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 100 = 0
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""
