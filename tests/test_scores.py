import numpy as np
import pytest
from pyspark.sql import functions as F

from semaloom.config import EngineConfig
from semaloom.operators import graph, metrics, scores
from semaloom.schemas import FUNCTIONS


def functions(spark, rows):
    return spark.createDataFrame(rows, FUNCTIONS)


def f(node, path="src/a.c", tfidf=None, ri=(1.0, 0.0), api=(0.0, 0.0)):
    return (node, path, tfidf if tfidf is not None else {0: 1.0, 1: 1.0}, list(ri), list(api), [0.0, 0.0], [0.0, 0.0], [0.0] * 25)


def test_combined(spark):
    rows = functions(spark, [f(0, api=(1.0, 1.0)), f(1, api=(1.0, 1.0)), f(2, "lib/b.c", {5: 1.0}, (0.0, 1.0)), f(3)])
    got = {r["node_id"]: r["score"] for r in scores.search(rows.filter("node_id = 0"), rows, 10).collect()}
    assert got[1] == pytest.approx(1.05 * 0.60) and got[2] == 0 and got[3] == pytest.approx(1.05 * 0.45)
    assert scores.search(rows.filter("node_id = 0"), rows, 10, 0.5).count() == 2
    assert [r["node_id"] for r in scores.search(rows.filter("node_id = 0"), rows, 2).collect()] == [0, 1]


def test_simple(spark):
    rows = functions(spark, [f(0), f(1), f(2, ri=(0.0, 0.0)), f(3, ri=(-1.0, 0.0))])
    one = rows.filter("node_id = 0")
    got = {r["node_id"]: r["score"] for r in scores.simple_search(one, rows, 10).collect()}
    assert got[1] == 1.0 and got[2] == pytest.approx(0.5 * 1.05) and got[3] == 0
    flat = {r["node_id"]: r["score"] for r in scores.rank_flat(one, rows, 10).collect()}
    assert flat == {0: 1.0, 1: 1.0, 2: 0.5, 3: 0.0}
    with pytest.raises(ValueError):
        scores.rank_flat(rows, rows, 2)


def test_all_pairs_and_diffusion(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(90, 4))
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = unit @ unit.T
    want = {(i, j) for i in range(90) for j in sorted((j for j in range(90) if j != i and sims[i, j] >= 0.75), key=lambda j: (-sims[i, j], j))[:10]}
    for block in (4096, 32):
        monkeypatch.setattr(graph, "BLOCK", block)
        edges = graph.all_pairs(rows, "id", "v", 4).collect()
        assert {(r["src"], r["dst"]) for r in edges} == want
    pair = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [5.0, 0.0])], "id long, v array<double>")
    edges = spark.createDataFrame([(0, 1), (1, 1)], "src long, dst long")
    got = {r["id"]: r["v"] for r in graph.diffuse(pair, edges, "id", "v", 2, 0.3).collect()}
    size = (0.7**2 + 0.3**2) ** 0.5
    assert got[0] == pytest.approx([0.7 / size, 0.3 / size]) and got[1] == [0.0, 1.0] and got[2] == [5.0, 0.0]
    assert {r["id"]: r["v"] for r in graph.diffuse(pair, edges, "id", "v", 2, 7.0).collect()}[0] == pytest.approx([0.0, 1.0])
    assert graph.attend(rows, "id", "v", 4, neighbours=3, rounds=2).count() == 90


def test_metrics(spark):
    ranked = spark.createDataFrame([(0, 1, 5, 0.9), (0, 2, 6, 0.8), (0, 3, 7, 0.7)], "query_id long, rank int, doc_id long, score double")
    judged = spark.createDataFrame([(0, 6, 2), (0, 7, 1), (0, 9, 1)], "query_id long, doc_id long, grade int")
    got = metrics.quality(ranked, judged, 3).first()
    dcg, best = 3 / np.log2(3) + 1 / np.log2(4), 3 + 1 / np.log2(3) + 1 / np.log2(4)
    assert (got["precision"], got["strict"], got["mrr"]) == (pytest.approx(2 / 3), pytest.approx(1 / 3), 0.5) and got["ndcg"] == pytest.approx(dcg / best)
    assert metrics.overlap(ranked, ranked.filter("rank < 3")).first()["overlap"] == 2
    assert metrics.differences(ranked, ranked.filter("rank < 3")).count() == 1
    assert EngineConfig().max_edges == 10 and F is not None
