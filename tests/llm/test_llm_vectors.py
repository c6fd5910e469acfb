"""Vector operators against brute force."""

import math

import numpy as np
from pyspark.sql import functions as F

from semaloom.llm import components, neardup, topk

KIND = "vec_id long, embedding array<float>, label int"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in rows], KIND).withColumn("id", F.lit("clash")).withColumn("dim", F.lit(1)).repartition(3)


def sample(n=700, dim=8, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x[50:90] = x[10] + rng.normal(size=(40, dim)).astype(np.float32) * 0.15
    x[100:120] = x[7]
    x[120:125] = 2 * x[7]
    rows = [(i, v) for i, v in enumerate(x)]
    odd = [(5000, None), (5001, []), (5002, [0.0] * dim), (5003, [math.nan] * dim), (5004, [None] + [1.0] * (dim - 1)), (5005, [math.inf] * dim), (5100, [1.0] * 3), (None, [1.0] * dim), (5200, [1e30] * dim)]
    return rows, odd


def usable(v):
    return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v)


def test_topk(spark):
    rows, odd = sample()
    every = rows + odd[:-1]
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.topk(topk.clean(table(spark, every), "vec_id", "embedding", 1024), F.pmod(F.col("id"), F.lit(100)) == 0, 10).collect())
    ints = {i: [math.floor(1024 * float(np.float32(x))) for x in v] for i, v in every if i is not None and usable(v)}
    want = []
    for q in ints:
        if q % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(ints[q], ints[c])), c) for c in ints if c != q and len(ints[c]) == len(ints[q]))[:10]
            want += [(q, k, c, -s) for k, (s, c) in enumerate(best, 1)]
    assert got == sorted(want)


def test_topk_ties_and_empty(spark):
    rows = [(i, [1.0, 0.5]) for i in range(0, 300)]
    got = topk.topk(topk.clean(table(spark, rows), "vec_id", "embedding", 1024), F.pmod(F.col("id"), F.lit(100)) == 0, 10).collect()
    assert [r["vec_id"] for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])) if r["query_id"] == 100] == list(range(10))
    assert topk.topk(topk.clean(table(spark, []), "vec_id", "embedding", 1024), F.pmod(F.col("id"), F.lit(100)) == 0, 10).count() == 0


def brute_links(rows, least):
    ids = [i for i, v in rows if i is not None]
    unit = {}
    for i, v in rows:
        if i is not None and usable(v) and any(v):
            x = np.array([float(np.float32(a)) for a in v])
            x = x / np.abs(x).max()
            unit[i] = x / np.linalg.norm(x)
    links = {i: {j for j in unit if j != i and i in unit and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least} for i in ids}
    out = {}
    for i in ids:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[i] = (len(links[i]), min(seen), min(seen) == i)
    return out


def test_near_duplicates(spark):
    rows, odd = sample()
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(table(spark, rows + odd), "vec_id", "embedding", 0.9).collect()}
    assert got == brute_links(rows + odd, 0.9)
    assert neardup.near_duplicates(table(spark, []), "vec_id", "embedding", 0.9).count() == 0


def test_recall_against_brute_force():
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(40, 32))
    x = np.concatenate([c + rng.normal(size=(int(n), 32)) * 0.18 for c, n in zip(centers, rng.integers(1, 300, 40))] + [rng.normal(size=(3000, 32))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = neardup.SmallWorld.load(neardup.SmallWorld(x.astype(np.float32)).dump())
    a, b = neardup.links_between(graph, x, x, 0.9)
    truth = x @ x.T >= 0.9
    assert truth[a, b].all() and len(a) >= 0.98 * truth.sum()


def planted(n=3000, dim=32, links=12):
    """Unit vectors of which only a few have a link, at places that evenly spaced samples do not have."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, dim))
    spaced = set(np.linspace(0, n - 1, neardup.AUDIT).astype(int).tolist())
    pairs = [(i, i + n // 2) for i in range(2, n // 2) if not {i, i + n // 2} & spaced][:links]
    for i, j in pairs:
        x[j] = x[i] + rng.normal(size=dim) * 0.1
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x, {p for i, j in pairs for p in ((i, j), (j, i))}


class Narrow:
    """A graph whose beams of less than ``enough`` find a vector itself only."""

    def __init__(self, x, enough):
        self.x, self.enough, self.widths = x.astype(np.float32), enough, []

    def near(self, q, width, least):
        self.widths.append(width)
        return np.nonzero(q @ self.x.T >= (least if width >= self.enough else 0.99999))


def test_audit_sees_rare_links():
    x, want = planted()
    half = len(x) // 2  # two shards: most queries have no link
    a, b = neardup.links_between(Narrow(x[:half], 64), x[:half], x[half:], 0.9)
    assert {(i + half, j) for i, j in zip(a.tolist(), b.tolist())} == {p for p in want if p[0] > p[1]}
    a, b = neardup.links_between(Narrow(x, 64), x, x, 0.9, same=True)  # one shard: each vector also finds itself
    assert {(i, j) for i, j in zip(a.tolist(), b.tolist()) if i != j} == want


def test_second_audit_widens_until_it_passes():
    x, want = planted()

    class Fickle(Narrow):
        """Finds everything when asked for the first time, as the first audit does."""

        def near(self, q, width, least):
            found = super().near(q, width, least)
            return found if len(self.widths) > 1 else np.nonzero(q @ self.x.T >= least)

    half = len(x) // 2
    for enough in (32, 64, 10**9):  # 10**9: no beam finds them, as in a graph that is not connected
        a, b = neardup.links_between(Fickle(x[:half], enough), x[:half], x[half:], 0.9)
        assert {(i + half, j) for i, j in zip(a.tolist(), b.tolist())} == {p for p in want if p[0] > p[1]}, enough


def test_components(spark, monkeypatch):
    rng = np.random.default_rng(9)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000, i) for i in range(1001, 1200)] + [(i, i + 1) for i in range(2000, 2030)]
    links = spark.createDataFrame(pairs, "a long, b long")
    nodes, root = components.roots(*(np.array(x) for x in zip(*[p for p in pairs if p[0] != p[1]])))
    want = dict(zip(nodes.tolist(), root.tolist()))
    for small in (10**6, 0):
        monkeypatch.setattr(components, "SMALL", small)
        assert {r["id"]: r["component"] for r in components.components(links).collect()} == want
    assert components.components(links.limit(0)).count() == 0
