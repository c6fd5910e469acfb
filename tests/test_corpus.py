import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from semaloom.config import EngineConfig, Mode
from semaloom.functions.text import tokenize
from semaloom.operators import corpus as C
from semaloom.operators import search as S
from semaloom.sources.token_vectors import DigestVectors, Projected, TableVectors, decompose, fit_pca, read_blob

DEMO = ["handle request parse", "handle error log", "parse request body", "send response body", "open file read", "read file buffer", "write file buffer", "close file handle", "alloc memory buffer", "free memory page"]


def frame(spark, docs):
    return spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "doc_id long, tokens array<string>")


def build(spark, docs, **settings):
    config = EngineConfig.of(16, abbrev=False, **settings)
    return C.CorpusBuilder(spark, config).add_tokens(frame(spark, docs)).finalize(DigestVectors(16))


def ask(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "query_id long, text string")


def test_idf(spark):
    c = build(spark, [["handle", "request"], ["handle", "error"], ["log", "message"]])
    idf = {r["token"]: r["idf"] for r in c.vocab.collect()}
    assert c.n_docs == 3 and idf["log"] == pytest.approx(math.log(3)) and idf["handle"] == pytest.approx(math.log(1.5))


def test_first_seen(spark):
    got = {r[0]: r[1] for r in C.first_seen(frame(spark, [["alpha", "beta"], ["alpha", "gamma"], ["delta", "beta"]])).collect()}
    assert got == {"alpha": 0, "beta": 1, "gamma": 2, "delta": 3}


def test_token_at(spark):
    c = build(spark, [["alpha", "beta"], ["alpha", "gamma", None], ["delta", "beta"]])
    got = {r["token_id"]: r for r in c.tokens_at().collect()}
    assert [got[i]["token"] for i in range(4)] == ["alpha", "beta", "gamma", "delta"] and len(got) == 4
    one = c.token_at(2).first()
    assert one["token"] == "gamma" and one["idf"] == pytest.approx(math.log(3)) and len(one["vec"]) == 16
    assert c.token_at(4).count() == 0 and c.token_at(-1).count() == 0
    with pytest.raises(C.CorpusStateError):
        build(spark, [["alpha"]], index=False).token_at(0)


def test_sums_by_join_and_by_gathering_agree(spark, monkeypatch):
    docs = [t.split() for t in DEMO] + [["handle", None, "handle"]]
    a = {r["doc_id"]: (r["q"], r["inv_mag"]) for r in build(spark, docs).doc_vectors.collect()}
    monkeypatch.setattr(C, "GATHER_BYTES", 0)
    assert {r["doc_id"]: (r["q"], r["inv_mag"]) for r in build(spark, docs).doc_vectors.collect()} == a


def test_candidates_in_blocks_of_queries(spark, monkeypatch):
    """The same candidates whether queries are taken together or one by one; the limit is kept."""
    c = build(spark, [t.split() for t in DEMO] * 30)
    tokens = S.query_tokens(c, ask(spark, ["handle request file buffer", "read file", "memory", "nothing known"]))
    for find in (S.keyword_candidates, S.tfidf_candidates):
        whole = sorted(map(tuple, find(c, tokens, 40).collect()))
        monkeypatch.setattr(S, "QUERIES", 1)
        assert sorted(map(tuple, find(c, tokens, 40).collect())) == whole
        monkeypatch.undo()
        assert max(sum(r[0] == q for r in whole) for q in range(3)) == 40 and len({r[0] for r in whole}) == 3


def test_rejects(spark):
    docs = frame(spark, [["a1"], [], ["b1"] * 600, ["c1", None]])
    assert {r[0]: r[1] for r in C.doc_map(docs).collect()} == {0: 0, 1: -1, 2: -1, 3: 1}
    assert {r[1] for r in C.doc_map(docs, max_docs=1).collect()} == {-1}
    builder = C.CorpusBuilder(spark, EngineConfig.of(16)).add_tokens(docs)
    c = builder.finalize(DigestVectors(16))
    assert c.n_docs == 2 and builder.finalize(DigestVectors(16)) is c
    with pytest.raises(C.CorpusStateError):
        builder.add_tokens(docs)
    with pytest.raises(C.CorpusStateError):
        c.check(EngineConfig.of(16, idf=False))


def test_texts_are_tokenized_once(spark):
    texts = ask(spark, ["", "one", None, "two words", "a"]).select(F.col("query_id").alias("doc_id"), "text")
    docs = C.accepted(texts.withColumn("tokens", tokenize(F.col("text"), False)))
    assert docs.columns == ["doc_id", "text", "tokens"]
    assert {r["doc_id"]: r["tokens"] for r in docs.collect()} == {1: ["one"], 3: ["two", "words"]}
    assert docs._jdf.queryExecution().optimizedPlan().toString().count("substring_index") == 1


def test_accepted_keeps_null_tokens_and_drops_null_lists(spark):
    rows = spark.createDataFrame([(1, ["a", None]), (2, None), (3, []), (4, [None] * 3)], "doc_id long, tokens array<string>")
    assert sorted(r["doc_id"] for r in C.accepted(rows, 2).collect()) == [1]


def test_empty_and_single(spark):
    empty = C.CorpusBuilder(spark, EngineConfig.of(16)).finalize(DigestVectors(16))
    assert empty.n_docs == 0 and S.search(empty, ask(spark, ["x y"]), 3).count() == 0
    single = build(spark, [["handle", "request"]])
    assert [r["score"] for r in S.search(single, ask(spark, ["handle"]), 3, Mode.BRUTE).collect()] == [0.0]


def test_modes(spark):
    docs = [[w for w in t.split()] for t in DEMO]
    c = build(spark, docs)
    q = ask(spark, ["handle request file buffer", "unknown words only", ""])
    by = {m: sorted(tuple(r) for r in S.search(c, q, 8, m).collect()) for m in Mode}
    assert len([r for r in by[Mode.BRUTE] if r[0] == 0]) == 8
    assert all(r[3] == 0 for r in by[Mode.BRUTE] if r[0] == 1) and len([r for r in by[Mode.BRUTE] if r[0] == 1]) == 8
    for m in (Mode.AUTO, Mode.FAST, Mode.TFIDF):
        assert {r[0] for r in by[m]} == {0}
    scores = {r[2]: r[3] for r in S.search(c, ask(spark, ["handle request file buffer"]), 10, Mode.BRUTE).collect()}
    for m in (Mode.AUTO, Mode.FAST, Mode.TFIDF):
        assert all(scores[r[2]] == pytest.approx(r[3], abs=1e-12) for r in by[m])
    with_all = sorted((-s, d) for d, s in scores.items())
    assert [(d, s) for _, _, d, s in by[Mode.BRUTE] if _ is not None][:8] and [x[1] for x in with_all][:8] == [r[2] for r in by[Mode.BRUTE] if r[0] == 0]


def test_without_index(spark):
    c = build(spark, [["handle", "request"], ["process", "response"], ["read", "file"]], index=False)
    q = ask(spark, ["handle"])
    assert S.search(c, q, 2, Mode.FAST).count() == 0
    assert S.search(c, q, 2, Mode.AUTO).count() == 2 and S.search(c, q, 2, Mode.BRUTE).count() == 2
    assert [r["n"] for r in S.candidate_count(c, S.query_tokens(c, q)).collect()] == [0]


def test_same_documents_score_zero(spark):
    c = build(spark, [["handle", "request", "parse"]] * 50)
    got = S.search(c, ask(spark, ["handle request"]), 5, Mode.BRUTE).orderBy("rank").collect()
    assert [(r["doc_id"], r["score"]) for r in got] == [(i, 0.0) for i in range(5)]


def test_idf_changes_ranking(spark):
    docs = [["common", f"x{i}"] for i in range(5)] + [["rare", "alpha"], ["common", "alpha"]]
    weighed, plain = build(spark, docs), build(spark, docs, idf=False)
    a, b = ([tuple(r) for r in S.search(c, ask(spark, ["common alpha"]), 7).orderBy("rank").collect()] for c in (weighed, plain))
    assert a != b


def test_against_numpy(spark):
    docs = [t.split() for t in DEMO]
    c = build(spark, docs)
    src = {r["token"]: np.array(r["vec"]) for r in DigestVectors(16).vectors(c.vocab).collect()}
    unit = lambda v: v / np.linalg.norm(v)
    q8 = lambda v: np.rint(np.clip(v * 127, -127, 127))
    enr = {t: q8(unit(v)) for t, v in src.items()}
    df = {t: sum(t in set(d) for d in docs) for t in src}
    idf = {t: math.log(len(docs) / n) for t, n in df.items()}
    vec = np.array([unit(sum(idf[t] * enr[t] / 127 for t in d)) for d in docs])
    mean = vec.mean(0)
    want = np.array([q8(unit(v - mean)) for v in vec])
    got = {r["doc_id"]: np.array(r["q"]) for r in c.doc_vectors.collect()}
    assert np.allclose(c.doc_mean, mean) and all((got[i] == want[i]).all() for i in got)


def test_long_vectors_are_summed_alike(spark):
    from semaloom.operators import dense

    rng = np.random.default_rng(0)
    rows = [(f"k{i % 37}", [float(x) for x in rng.normal(size=40)], float(rng.normal())) for i in range(900)]
    table = spark.createDataFrame(rows, "k string, v array<double>, w double").repartition(5)
    want = {}
    for k, v, w in rows:
        want[k] = want.get(k, 0) + w * np.array(v)
    got = {r[0]: np.array(r[1]) for r in dense.weighted_sum(table, "k", "v", "w", 40).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    assert dense.weighted_sum(table.limit(0), "k", "v", "w", 40).count() == 0


def test_ri_and_sparse(spark):
    docs = [t.split() for t in DEMO]
    rich = build(spark, docs, ri=True)
    assert rich.enriched.count() == build(spark, docs).enriched.count()
    thin = build(spark, docs, sparse_nnz=4)
    assert all(sum(x != 0 for x in r["q"]) <= 4 for r in thin.doc_vectors.collect())
    assert S.search(thin, ask(spark, ["file buffer"]), 3, Mode.BRUTE).count() == 3


def test_subwords(spark):
    rows = spark.createDataFrame([("xxhash",), ("uint32",), ("zzz",), ("ab" * 20,)], "token string")
    got = {r[0]: r[1] for r in decompose(rows, ["xx", "x", "hash", "uint", "32", "ab"]).collect()}
    assert got["xxhash"] == ["xx", "hash"] and got["uint32"] == ["uint", "32"] and got["zzz"] == [] and got["ab" * 20] == ["ab"] * 8


def test_table_provider(spark):
    table = spark.createDataFrame([("xx", [127, 0]), ("hash", [0, 127])], "token string, vec array<tinyint>")
    vocab = spark.createDataFrame([("xx",), ("xxhash",), ("zzz",)], "token string")
    got = {r[0]: r[1] for r in TableVectors(table, 2).vectors(vocab).collect()}
    assert got["xx"] == [1.0, 0.0] and got["xxhash"] == pytest.approx([0.5**0.5, 0.5**0.5]) and got["zzz"] == [0.0, 0.0]


def test_blob(spark):
    raw = (2).to_bytes(4, "little") + (3).to_bytes(4, "little") + bytes([1, 2, 3, 255, 254, 253])
    got = {r[0]: list(r[1]) for r in read_blob(spark, raw, ["a", "b"], 3).collect()}
    assert got == {"a": [1, 2, 3], "b": [-1, -2, -3]}
    for bad in (raw[:-1], raw[:4], raw):
        with pytest.raises(ValueError):
            read_blob(spark, bad, ["a", "b"] if bad is not raw else ["a"], 3)


def test_pca(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 6)) * [5, 3, 1, 0.1, 0.1, 0.1]
    rows = spark.createDataFrame([(f"t{i}", [float(v) for v in r]) for i, r in enumerate(x)], "token string, v array<double>")
    mean, basis, share = fit_pca(rows, "v", 2)
    assert np.allclose(mean, x.mean(0)) and share.sum() > 0.9

    class Fixed:
        dim = 6

        def vectors(self, vocab):
            return rows.select("token", F.col("v").alias("vec"))

    got = {r[0]: r[1] for r in Projected(Fixed(), mean, basis).vectors(rows).collect()}
    assert np.allclose(got["t3"], (x[3] - mean) @ basis)


def test_settings():
    assert EngineConfig.of(256).weights.tfidf == 0.25 and EngineConfig().weights.ri == 0.25
    c = EngineConfig.from_env({"SEMALOOM_THRESHOLD": "0.5", "SEMALOOM_NO_IDF": "1", "SEMALOOM_MAX_FILE_SIZE": "999999999999"})
    assert c.threshold == 0.5 and not c.idf and c.abbrev and c.max_file_bytes == 256 << 20
    assert EngineConfig.from_env({"SEMALOOM_THRESHOLD": "7"}).threshold == 0.75
    assert EngineConfig.from_json(c.to_json()) == c and EngineConfig.of(16, sparse_nnz=99).sparse_nnz == 16
