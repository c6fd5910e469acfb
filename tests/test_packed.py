"""Documents in blocks and what is computed from them, against plain Python."""

import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from semaloom.operators import cooccurrence, dense, packed
from semaloom.runtime import checkpoint_dir

SCHEMA = "doc_id long, tokens array<string>"


@pytest.fixture
def blocks(spark, monkeypatch):
    """Blocks of a few documents."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(name)
    spark.conf.set(name, "7")
    monkeypatch.setattr(packed, "BLOCK_TOKENS", 200)
    yield
    spark.conf.set(name, usual)


def _docs(n=60, seed=5):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(80)] + ["é", "日本", ""]
    return [(k, [r.choice(words) if r.random() < 0.95 else None for _ in range(r.randint(0, 40))]) for k in range(n)] + [(n, [None]), (n + 1, []), (n + 2, ["alone"])]


def _want(docs, vectors, dim, passes):
    w = defaultdict(float)
    for _, tokens in docs:
        for i, t in enumerate(tokens):
            for j in range(max(0, i - 5), min(len(tokens), i + 6)):
                if i != j and t is not None and tokens[j] is not None:
                    w[t, tokens[j]] += 1 / abs(i - j)
    own = {t: np.array(v, float) for t, v in vectors.items()}

    def near(x):
        out = {t: np.zeros(dim) for t in own}
        for (t, n), s in w.items():
            if t in own and n in own:
                out[t] += s * x[n]
        return out

    sums = near(own)
    q = {t: dense.to_int8(dense.unit((own[t] + sums[t])[None]))[0] for t in own}
    if passes == 2:
        sums = near({t: x / 127 for t, x in q.items()})
        q = {t: dense.to_int8(dense.unit((0.7 * q[t] + 0.3 * dense.to_int8(sums[t][None])[0].astype(float))[None]))[0] for t in own}
    return {t: x.tolist() for t, x in q.items()}


@pytest.mark.parametrize("dim,whole", [(8, True), (8, False), (70, True)])
@pytest.mark.parametrize("passes", [1, 2])
def test_passes(spark, blocks, dim, whole, passes):
    """Several blocks, nulls that keep their places, vectors in several parts, and tokens without a vector."""
    docs, r = _docs(), np.random.default_rng(3)
    tokens = sorted({t for _, ts in docs for t in ts if t is not None} - {"w7"})
    vectors = {t: (r.integers(-127, 128, dim) / 127.0 if whole else r.normal(size=dim)).tolist() for t in tokens}
    held = packed.Packed(spark.createDataFrame(docs, SCHEMA).repartition(3))
    assert held.rows.filter(F.col("bucket") == packed.DOCS).count() > 3
    sources = spark.createDataFrame(list(vectors.items()), "token string, vec array<double>")
    work = cooccurrence.pass1 if passes == 1 else cooccurrence.enrich
    got = {x["token"]: x["q"] for x in work(held, sources, dim).collect()}
    assert got == _want(docs, vectors, dim, passes)


def test_tokens_and_count(spark, blocks):
    docs = _docs()
    held = packed.Packed(spark.createDataFrame(docs, SCHEMA).repartition(3))
    want = Counter(t for _, ts in docs for t in set(ts) if t is not None)
    assert {r["token"]: r["df"] for r in held.tokens().collect()} == want and held.tokens().count() == len(want)
    assert held.count() == len(docs)
    none = packed.Packed(spark.createDataFrame([], SCHEMA))
    assert none.count() == 0 and none.tokens().count() == 0


def test_texts_are_packed_as_their_tokens(spark, blocks):
    from semaloom.functions.text import tokenize
    from semaloom.operators.corpus import accepted

    texts = [(k, " ".join(t or "Ab.cD" for t in ts)) for k, ts in _docs()] + [(90, None), (91, "é a"), (92, "tok " * 600)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    want = {r["doc_id"]: r["tokens"] for r in accepted(docs.select("doc_id", tokenize(F.col("text"), False).alias("tokens"))).collect()}
    held = packed.Packed(docs)
    assert {r["doc_id"]: r["tokens"] for r in held.docs().collect()} == want and held.count() == len(want) > 40
    assert {r["token"]: r["df"] for r in held.tokens().collect()} == Counter(t for ts in want.values() for t in set(ts))


def _bytes(path):
    path = path.removeprefix("file:")
    return sum(os.path.getsize(os.path.join(folder, f)) for folder, _, files in os.walk(path) for f in files)


def test_passes_keep_no_row_for_a_pair(spark):
    """What is kept on disk follows the occurrences, not the pairs at most five places apart."""
    r = random.Random(1)
    words = [f"word{k}" for k in range(4000)]
    docs = spark.createDataFrame([(k, r.choices(words, k=300)) for k in range(300)], SCHEMA).repartition(2)
    before = _bytes(checkpoint_dir(spark))
    held = packed.Packed(docs)
    from semaloom.sources.token_vectors import DigestVectors

    assert cooccurrence.enrich(held, DigestVectors(8).vectors(held.tokens()), 8).count() == 4000
    assert _bytes(checkpoint_dir(spark)) - before < 20 * 300 * 300


def test_search_makes_no_index_it_does_not_need(spark, blocks):
    """An exhaustive search over an enriched corpus keeps neither postings nor terms; the index is made when asked for."""
    from semaloom.config import EngineConfig, Mode
    from semaloom.operators import corpus, search
    from semaloom.sources.token_vectors import DigestVectors

    rows = [(k, [t for t in ts if t != ""], f"f{k}") for k, ts in _docs() if ts]
    docs = spark.createDataFrame(rows, "doc_id long, tokens array<string>, label string").repartition(3)
    built = corpus.CorpusBuilder(spark, EngineConfig.of(8, ri=True, abbrev=False)).add_tokens(docs).finalize(DigestVectors(8))
    asked = spark.createDataFrame([(1, ["w1", "w2", "é"]), (2, ["alone"])], "query_id long, tokens array<string>")
    brute = search.search(built, asked, 3, Mode.BRUTE).collect()
    later = [object.__getattribute__(built, name) for name in ("postings", "forward")]
    assert len(brute) == 6 and all(isinstance(x, corpus.Later) and x.made is None for x in later)
    want = Counter((t, k) for k, ts, _ in rows for t in ts if t is not None)
    assert {(r["token"], r["doc_id"]): r["tf"] for r in built.postings.collect()} == want
    assert {r["doc_id"]: r["terms"] for r in built.forward.collect()} == {k: list(dict.fromkeys(t for t in ts if t is not None)) for k, ts, _ in rows}
    assert all(x.made is not None for x in later) and {r["doc_id"]: r["label"] for r in built.labels.collect()} == {k: label for k, _, label in rows}
