"""Connected components of a link table, by large-star and small-star rounds of joins.

Every round hooks each node to the smallest node it sees; the table stays as large as the links
are. A node with very many links is a hot join key of a plain join, which the planner can split;
no list of neighbours is ever gathered. Up to ``SMALL`` links (16 bytes each) one task does the
same by union-find.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semaloom.runtime import cut

#: Links that one task may take; beyond it the rounds run distributed.
SMALL = 100_000


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node of each one's component) of the links a - b, by hooking and halving."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    parent = np.arange(len(nodes))
    while True:
        px, py = parent[x], parent[y]
        apart = px != py
        if not apart.any():
            return nodes, nodes[parent]
        x, y, px, py = x[apart], y[apart], px[apart], py[apart]
        np.minimum.at(parent, np.maximum(px, py), np.minimum(px, py))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every node in ``links`` (a, b); component is the smallest reachable id."""
    links = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), small=True)
    if links.count() <= SMALL:

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = list(batches)
            if got:
                whole = pa.Table.from_batches(got)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in roots(whole.column(0).to_numpy(), whole.column(1).to_numpy())], names=["id", "component"])

        return cut(links.coalesce(1).mapInArrow(work, "id long, component long"))
    before = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        # large star: the larger neighbours of a node hook to the smallest node it sees
        large = cut(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        # small star: a node and its smaller neighbours hook to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        links = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        after = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == before:
            break
        before = after
    ends = links.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return ends.unionByName(links.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
