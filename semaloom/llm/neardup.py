"""Embedding near-duplicates by navigable small-world graphs.

Equal vectors are first made one class. Classes are dealt to shards of bounded size; each shard
gets a hierarchical navigable small-world graph. Every shard's vectors are searched for in every
shard's graph (each pair of shards in one task, in one direction). The search is a beam search,
run in lockstep over a block of queries. A query's beam widens while it is full of links. Each
task audits its recall on queries that brute force shows to have links, first alone and then
among all, and widens all beams until the audits pass; a beam that would meet most of a shard gives
way to brute force. What is found is verified by cosine in double precision.

A task returns two numbers per vector, its links and the smallest class it is joined to there:
rows grow with the vectors, never with the pairs of a group. Components are then united.

Defined cases: vectors that are null, empty, all zero or hold null or non-finite components link
with nothing and are components of their own; rows without an id are left out; vectors of
different length do not link; rows of one id count as one vector each; an empty table gives an
empty result; extra columns are dropped.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semaloom.llm.components import components, roots
from semaloom.llm.topk import clean
from semaloom.runtime import cut

#: Vectors of a shard at most, shards at least.
SHARD_ROWS, LEAST_SHARDS = 50_000, 6
#: Graph: links per node, beam while building, share of nodes on the next level.
LINKS, BUILD_BEAM, LEVEL = 16, 48, 16
#: Search: first beam, nodes expanded at a time, audited queries, recall that they must reach.
BEAM, WIDTH, AUDIT, RECALL = 32, 4, 128, 0.99
#: Slack of single precision below the threshold.
SLACK = 1e-4


class SmallWorld:
    """Levels of nodes, the lowest one first; each has node numbers and an adjacency table, -1 where empty."""

    def __init__(self, x: np.ndarray, seed: int = 1):
        self.x = x
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        order = np.random.default_rng(seed).permutation(len(x)).astype(np.int32)
        sizes = [len(x)]
        while sizes[-1] > 4 * LEVEL * LINKS:
            sizes.append(sizes[-1] // LEVEL)
        for size in reversed(sizes):  # from the top, so that lower levels are entered through higher ones
            self._level(order[:size])
        self.levels.reverse()

    def _level(self, members: np.ndarray) -> None:
        most = 2 * LINKS
        table = np.full((len(members), most), -1, np.int32)
        local = np.full(len(self.x), -1, np.int32)
        local[members] = np.arange(len(members))
        x = self.x[members]
        entries = None
        done = 0
        while done < len(members):
            size = min(max(done, 512), 1024, len(members) - done)
            fresh = np.arange(done, done + size)
            sims = x[fresh] @ x[fresh].T
            np.fill_diagonal(sims, -2)
            near = min(BUILD_BEAM // 2, size - 1)
            part = np.argpartition(-sims, near - 1, 1)[:, :near] if near else np.zeros((size, 0), np.int64)
            ids, sim = fresh[part], np.take_along_axis(sims, part, 1)
            if done:
                entries = self._entries(x[fresh], local, done)
                found, found_sim, _ = beam(x, table, x[fresh], entries, BUILD_BEAM, -2.0, done)
                ids, sim = np.concatenate([found, ids], 1), np.concatenate([found_sim, sim], 1)
            chosen = _diverse(x, ids, sim, LINKS)
            table[fresh, :LINKS] = chosen
            _link_back(x, table, fresh, chosen)
            done += size
        self.levels.append((members, table))

    def _entries(self, q: np.ndarray, local: np.ndarray, limit: int) -> np.ndarray:
        """Entry nodes of the level being built, numbered within it: the best of the level above."""
        if not self.levels:
            return np.tile(np.arange(min(8, limit)), (len(q), 1))
        members, table = self.levels[-1]
        sims = q @ self.x[members[: 4 * LEVEL * LINKS]].T
        best = np.argpartition(-sims, min(3, sims.shape[1] - 1), 1)[:, :4]
        if len(members) > 4 * LEVEL * LINKS:
            best = beam(self.x[members], table, q, best, 8, -2.0, len(members))[0][:, :4]
        out = local[members[np.maximum(best, 0)]]
        return np.where(out < limit, out, 0)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, x=self.x, **{f"m{i}": m for i, (m, _) in enumerate(self.levels)}, **{f"t{i}": t for i, (_, t) in enumerate(self.levels)})
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> SmallWorld:
        graph = cls.__new__(cls)
        with np.load(io.BytesIO(raw)) as z:
            graph.x = z["x"]
            graph.levels = [(z[f"m{i}"], z[f"t{i}"]) for i in range(sum(k[0] == "m" for k in z.files))]
        graph.lower = [(graph.x[m], t) for m, t in graph.levels]
        return graph

    def near(self, q: np.ndarray, width: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) pairs whose similarity is at least ``least``, as far as beams of ``width`` find them."""
        entries = None
        for i in range(len(self.levels) - 1, -1, -1):
            members, table = self.levels[i]
            x = self.lower[i][0]
            if entries is None:
                sims = q @ x[: 4 * LEVEL * LINKS].T
                entries = np.argpartition(-sims, min(7, sims.shape[1] - 1), 1)[:, :8]
            else:
                spot = np.empty(len(self.x), np.int64)
                spot[members] = np.arange(len(members))
                entries = np.where(above >= 0, spot[previous[np.maximum(above, 0)]], -1)
            if i:
                above, _, _ = beam(x, table, q, entries, 16, -2.0, len(members))
                above, previous = above[:, :8], members
        ids, sims, found = beam(x, table, q, entries, width, least, len(members))
        full = (sims >= least).all(1)
        if full.any() and width < len(members):  # a beam full of links may have more beyond it
            rows = np.flatnonzero(full)
            deeper = [self.near(q[part], width * 4, least) for part in np.array_split(rows, -(-len(rows) // 128))]
            keep = ~full[found[0]]
            a = np.concatenate([found[0][keep], *(part[d[0]] for part, d in zip(np.array_split(rows, -(-len(rows) // 128)), deeper, strict=True))])
            return a, np.concatenate([members[found[1][keep]], *(d[1] for d in deeper)])
        return found[0], members[found[1]]


def beam(x: np.ndarray, table: np.ndarray, q: np.ndarray, entries: np.ndarray, width: int, least: float, limit: int):
    """Best-first search of all queries in lockstep.

    Returns the beams (node numbers, similarities; best first, -1 where empty) and all seen (query, node) pairs of at least ``least``.
    """
    n, rows = len(q), np.arange(len(q))[:, None]
    width = min(width, limit)
    seen = np.zeros((n, limit), bool)
    hits_q, hits_n = [], []

    def meet(nodes: np.ndarray, row: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fresh = (nodes >= 0) & (nodes < limit)
        safe = np.where(fresh, nodes, 0)
        fresh &= ~seen[row, safe]
        seen[np.broadcast_to(row, nodes.shape)[fresh], safe[fresh]] = True
        ordered = np.sort(np.where(fresh, nodes, -1), 1)  # a node may be met twice in one step
        twice = np.zeros_like(fresh)
        twice[:, 1:] = ordered[:, 1:] == ordered[:, :-1]
        ids = np.where(twice, -1, ordered)
        sims = np.matmul(x[np.maximum(ids, 0)], queries[:, :, None])[:, :, 0]
        sims[ids < 0] = -9
        if least > -1:
            a, b = np.nonzero(sims >= least)
            hits_q.append(np.broadcast_to(row, ids.shape)[a, b])
            hits_n.append(ids[a, b])
        return ids, sims

    ids, sims = meet(entries.astype(np.int64), rows, q)
    if ids.shape[1] < width:
        pad = width - ids.shape[1]
        ids, sims = np.pad(ids, ((0, 0), (0, pad)), constant_values=-1), np.pad(sims, ((0, 0), (0, pad)), constant_values=-9)
    opened = ids < 0
    live = np.arange(n)
    while len(live):
        s = np.where(opened[live], -9, sims[live])
        step = min(max(WIDTH, width // 16), s.shape[1])
        pick = np.argpartition(-s, step - 1, 1)[:, :step] if step < s.shape[1] else np.tile(np.arange(step), (len(live), 1))
        value = np.take_along_axis(s, pick, 1)
        ok = value > -9
        go = ok.any(1)
        live, pick, ok = live[go], pick[go], ok[go]
        if not len(live):
            break
        l1 = live[:, None]
        at = np.where(ok, ids[l1, pick], -1)
        opened[l1, pick] = True
        nodes = np.where(at[:, :, None] >= 0, table[np.maximum(at, 0)], -1).reshape(len(live), -1)
        new_ids, new_sims = meet(nodes, l1, q[live])
        all_ids, all_sims = np.concatenate([ids[live], new_ids], 1), np.concatenate([sims[live], new_sims], 1)
        all_open = np.concatenate([opened[live], new_ids < 0], 1)
        keep = np.argpartition(-all_sims, ids.shape[1] - 1, 1)[:, : ids.shape[1]]
        ids[live], sims[live], opened[live] = (np.take_along_axis(v, keep, 1) for v in (all_ids, all_sims, all_open))
    order = np.argsort(-sims, 1, kind="stable")[:, :width]
    none = np.zeros(0, np.int64)
    found = (np.concatenate(hits_q), np.concatenate(hits_n)) if hits_q else (none, none)
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1), found


def _diverse(x: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates the neighbours to link: near ones that no chosen one is nearer to; then the nearest rest."""
    order = np.argsort(-sims, 1, kind="stable")[:, : 3 * most]
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    points = x[np.maximum(ids, 0)]
    within = np.matmul(points, points.transpose(0, 2, 1))
    n, width = ids.shape
    chosen = np.zeros((n, width), bool)
    count = np.zeros(n, np.int64)
    for j in range(width):
        crowded = ((within[:, j, :] > sims[:, j : j + 1]) & chosen).any(1)
        take = (ids[:, j] >= 0) & (sims[:, j] > -2) & ~crowded & (count < most)
        chosen[:, j] = take
        count += take
    rank = np.where(chosen, 0, 1) * width + np.arange(width)
    rank[(ids < 0) | (sims <= -2)] = 3 * width
    first = np.argsort(rank, 1)[:, :most]
    out = np.where(np.take_along_axis(rank, first, 1) < 3 * width, np.take_along_axis(ids, first, 1), -1)
    return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)


def _link_back(x: np.ndarray, table: np.ndarray, fresh: np.ndarray, chosen: np.ndarray) -> None:
    """Reverse links; a node with too many keeps a diverse choice."""
    source = np.repeat(fresh, chosen.shape[1])
    target = chosen.ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    nodes, first, counts = np.unique(target, return_index=True, return_counts=True)
    most = table.shape[1]
    for at in range(0, len(nodes), 512):
        part = slice(at, at + 512)
        width = int(min(counts[part].max(), 64))
        step = np.arange(width)
        index = first[part][:, None] + step
        new = np.where(step < counts[part][:, None], source[np.minimum(index, len(source) - 1)], -1)
        old = table[nodes[part]]
        new = np.where((new[:, :, None] == old[:, None, :]).any(2), -1, new)
        ids = np.concatenate([old, new], 1)
        over = (ids >= 0).sum(1) > most
        packed = np.take_along_axis(ids, np.argsort(ids < 0, 1, kind="stable"), 1)[:, :most]
        if over.any():
            full = ids[over]
            sims = np.matmul(x[np.maximum(full, 0)], x[nodes[part][over]][:, :, None])[:, :, 0]
            sims[full < 0] = -9
            packed[over] = _diverse(x, full, sims, most)
        table[nodes[part]] = packed


def _unit(raw: list[bytes], dim: int) -> np.ndarray:
    v = np.frombuffer(b"".join(raw), "<f8").reshape(-1, dim)
    scale = np.abs(v).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    v = v / scale
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _audited(x: np.ndarray, queries: np.ndarray, least: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """(queries, links): up to AUDIT random queries that brute force shows to have links, and which nodes those are.

    Queries are drawn until so many are found or all are looked at; a query that is itself a node (``same``) is not its own link.
    """
    order = np.random.default_rng(len(queries)).permutation(len(queries))
    sample, truth, count = [np.zeros(0, np.int64)], [np.zeros((0, len(x)), bool)], 0
    for at in range(0, len(order), AUDIT):
        part = order[at : at + AUDIT]
        links = (queries[part] @ x.T) >= least
        if same:
            links[np.arange(len(part)), part] = False
        some = np.flatnonzero(links.any(1))[: AUDIT - count]
        sample.append(part[some])
        truth.append(links[some])
        count += len(some)
        if count >= AUDIT:
            break
    return np.concatenate(sample), np.concatenate(truth)


def _passes(truth: np.ndarray, sample: np.ndarray, a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the pairs (a, b) have enough of the audited links: of all, and of a query's own on average, so that large groups do not hide small ones."""
    if not len(sample):
        return True
    row = np.full(int(max(sample.max(), a.max(initial=0))) + 1, -1)
    row[sample] = np.arange(len(sample))
    got = np.zeros_like(truth)
    at = row[a]
    got[at[at >= 0], b[at >= 0]] = True
    hits, links = (got & truth).sum(1), truth.sum(1)
    return bool(hits.sum() >= RECALL * links.sum() and (hits / links).mean() >= RECALL)


def _wider(width: int, size: int) -> int:
    """The next width; the whole shard's size where a beam would meet about as many nodes."""
    return size if 4 * LINKS * width >= size else 2 * width


def _search(graph: SmallWorld, single: np.ndarray, rows: np.ndarray, width: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) pairs of some queries; with a width of the shard's size by brute force, as a graph need not be connected."""
    if width < len(graph.x):
        a, b = graph.near(single[rows], width, least - SLACK)
    else:
        a, b = np.nonzero(single[rows] @ graph.x.T >= least - SLACK)
    return rows[a], b


def links_between(graph: SmallWorld, base: np.ndarray, queries: np.ndarray, least: float, same: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) pairs with a cosine of at least ``least``, with beams widened until the audits pass or all nodes are looked at; ``same``: the queries are the nodes."""
    single = queries.astype(np.float32)
    block = int(max(32, min(256, (32 << 20) // max(1, len(base)))))
    sample, truth = _audited(graph.x, single, least, same)
    width = BEAM
    while len(sample) and width < len(base) and not _passes(truth, sample, *_search(graph, single, sample, width, least)):
        width = _wider(width, len(base))
    while True:  # the second audit is of the pairs that go out
        parts = [_search(graph, single, np.arange(at, min(at + block, len(single))), width, least) for at in range(0, len(single), block)]
        a, b = (np.concatenate([np.zeros(0, np.int64), *(p[i] for p in parts)]) for i in (0, 1))
        if width >= len(base) or _passes(truth, sample, a, b):
            break
        width = _wider(width, len(base))
    pair = np.unique(a.astype(np.int64) * len(base) + b)
    a, b = pair // len(base), pair % len(base)
    keep = np.zeros(len(a), bool)
    for at in range(0, len(a), 65536):
        part = slice(at, at + 65536)
        keep[part] = np.einsum("ij,ij->i", queries[a[part]], base[b[part]]) >= least
    return a[keep], b[keep]


def near_duplicates(table: DataFrame, key: str, vector: str, least: float) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``table`` that has an id."""
    everything = table.select(F.col(key).cast("long").alias("vec_id")).filter("vec_id is not null")
    vectors = cut(clean(table, key, vector, None))
    classes = cut(vectors.groupBy("vec", "dim").agg(F.min("id").alias("id"), F.count("*").alias("copies")))
    n = classes.count()
    shards = max(LEAST_SHARDS, -(-n // SHARD_ROWS))
    dealt = classes.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        units = _unit(rows.column("vec").to_pylist(), key[1].as_py())
        graph = SmallWorld(units.astype(np.float32))
        one = {"index": pa.array([key[0].as_py()], pa.int32()), "dim": pa.array([key[1].as_py()], pa.int32()), "graph": pa.array([graph.dump()], pa.binary())}
        packed = {n: pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for n, v in (("ids", rows.column("id").to_numpy()), ("copies", rows.column("copies").to_numpy()), ("units", units))}
        return pa.table(one | packed)

    def look(key: tuple, graphs: pa.Table, asked: pa.Table) -> pa.Table:
        names = ("id", "links", "root")
        if not graphs.num_rows or not asked.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        dim, same = key[1].as_py(), key[0].as_py() == key[2].as_py()
        get = lambda t, c, kind: np.frombuffer(t.column(c)[0].as_py(), kind)
        graph = SmallWorld.load(graphs.column("graph")[0].as_py())
        ids, copies, base = get(graphs, "ids", "<i8"), get(graphs, "copies", "<i8"), get(graphs, "units", "<f8").reshape(-1, dim)
        q_ids, q_copies, queries = get(asked, "ids", "<i8"), get(asked, "copies", "<i8"), get(asked, "units", "<f8").reshape(-1, dim)
        a, b = links_between(graph, base, queries, least, same)
        if same:  # either end may have found the pair
            a, b = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
            pair = np.unique(a * len(base) + b)
            a, b = pair // len(base), pair % len(base)
        forth, back = np.zeros(len(q_ids), np.int64), np.zeros(len(ids), np.int64)
        np.add.at(forth, a, copies[b])
        np.add.at(back, b, q_copies[a])
        nodes, root = roots(q_ids[a], ids[b])
        own = np.concatenate([q_ids, ids]), np.concatenate([forth, back])
        own = own[0][own[1] > 0], own[1][own[1] > 0]
        where = np.searchsorted(nodes, own[0])
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, (own[0], own[1], root[where]), strict=True)})

    graphs = cut(dealt.select("id", "vec", "dim", "copies", "shard").groupBy("shard", "dim").applyInArrow(build, "index int, dim int, graph binary, ids binary, copies binary, units binary"))
    # shard a is looked up in index a, a + 1, ..., half way round: every pair of shards meets once
    turns = F.transform(F.sequence(F.lit(0), F.lit(shards // 2)), lambda t: F.when((t * 2 != shards) | (F.col("index") < shards // 2), F.pmod(F.col("index") + t, F.lit(shards))))
    fresh = [F.col(c).alias(c) for c in ("dim", "ids", "copies", "units")]  # new names for the planner: both sides come from one table
    asked = graphs.select(F.col("index").alias("shard"), *fresh, F.explode(F.filter(turns, lambda t: t.isNotNull())).alias("index"))
    met = asked.select(*[F.col(c).alias(c) for c in ("index", "dim", "shard")])
    keys = ("index", "dim", "shard")
    found = cut(graphs.join(met, ["index", "dim"]).groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(look, "id long, links long, root long"))
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    facts = classes.join(counts, "id", "left").join(joined, "id", "left").select(
        "vec", "dim", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")
    )
    linked = vectors.join(facts, ["vec", "dim"]).select(F.col("id").alias("vec_id"), "n_links", "component_id")
    alone = everything.join(vectors.select(F.col("id").alias("vec_id")), "vec_id", "left_anti").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op3_hnsw_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", 0.9)


OP3_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), u AS MATERIALIZED (
  SELECT vec_id, len(e) AS dim, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS e FROM v
), links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.dim = b.dim AND a.vec_id <> b.vec_id WHERE list_inner_product(a.e, b.e) >= 0.9
), reach AS (
  SELECT vec_id AS id, vec_id AS far FROM embeddings WHERE vec_id IS NOT NULL UNION SELECT id, b FROM reach JOIN links ON a = far
), counts AS (SELECT a AS id, count(*) AS n FROM links GROUP BY a), least AS (SELECT id, min(far) AS component FROM reach GROUP BY id)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component::BIGINT AS component_id, vec_id = component AS kept
FROM embeddings JOIN least ON least.id = vec_id LEFT JOIN counts ON counts.id = vec_id
"""
