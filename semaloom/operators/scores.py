"""Pairwise scores of described functions, rankings and searches by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semaloom.config import EPSILON, EngineConfig
from semaloom.functions import vectors as V
from semaloom.functions.text import proximity


def _clamp(score: Column) -> Column:
    finite = ~F.isnan(score) & (F.abs(score) != F.lit(float("inf"))) & score.isNotNull()
    return F.when(finite, F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))).otherwise(F.lit(0.0))


def simple_score(ri_a: Column, ri_b: Column, path_a: Column | None = None, path_b: Column | None = None) -> Column:
    """(cosine + 1) / 2 x proximity, in [0, 1]; a zero vector counts as cosine 0."""
    near = proximity(path_a, path_b) if path_a is not None and path_b is not None else F.lit(1.0)
    return _clamp((V.cosine(ri_a, ri_b) + 1.0) / 2.0 * near)


SIGNALS = ("ri", "api", "type", "deco")


def combined_score(a: str, b: str, config: EngineConfig) -> Column:
    """Proximity x weighted sum of six cosines, in [0, 1]; ``a`` (the query) and ``b`` are struct columns.

    api, type, deco and struct_profile count nothing where the query's own vector is (nearly) zero.
    """
    x, y = F.col(a), F.col(b)
    w = config.weights
    total = w.tfidf * V.sparse_cosine(x["tfidf"], y["tfidf"]) + w.ri * V.cosine(x["ri"], y["ri"])
    for name, weight, field in (("api", w.api, "api"), ("type", w.type, "type"), ("deco", w.deco, "deco"), ("struct", w.struct, "struct_profile")):
        own = V.dot(x[field], x[field])
        total = total + F.when(own > EPSILON, F.lit(weight) * V.cosine(x[field], y[field])).otherwise(F.lit(0.0))
    return _clamp(total * proximity(x["file_path"], y["file_path"]))


def _against(query: DataFrame, functions: DataFrame) -> DataFrame:
    """Every function beside the query, which is a single row and so is broadcast."""
    if query.limit(2).count() > 1:
        raise ValueError("one query row is expected")
    one = query.select(F.struct(*query.columns).alias("a"))
    return functions.select(F.struct(*functions.columns).alias("b")).crossJoin(F.broadcast(one))


def _ranked(scored: DataFrame, k: int | None, least: float | None) -> DataFrame:
    rows = scored.filter(F.col("score") >= least) if least is not None else scored
    return rows if k is None else rows.orderBy(F.desc("score"), F.asc("node_id")).limit(k)


def search(query: DataFrame, functions: DataFrame, k: int | None, least: float = 0.0, config: EngineConfig | None = None) -> DataFrame:
    """(node_id, score) of the k best by combined score of at least ``least``, or of all in any order where k is None; ``rank`` is a search from 0."""
    scored = _against(query, functions).select(F.col("b.node_id").alias("node_id"), combined_score("a", "b", config or EngineConfig()).alias("score"))
    return _ranked(scored, k, least)


def simple_search(query: DataFrame, functions: DataFrame, k: int | None, least: float = 0.0) -> DataFrame:
    """The same by simple score."""
    scored = _against(query, functions).select(F.col("b.node_id").alias("node_id"), simple_score(F.col("a.ri"), F.col("b.ri"), F.col("a.file_path"), F.col("b.file_path")).alias("score"))
    return _ranked(scored, k, least)


def rank_flat(query: DataFrame, functions: DataFrame, k: int) -> DataFrame:
    """The k best by vector alone; nothing is filtered."""
    scored = _against(query, functions).select(F.col("b.node_id").alias("node_id"), simple_score(F.col("a.ri"), F.col("b.ri")).alias("score"))
    return _ranked(scored, k, None)


def described(corpus, docs: DataFrame) -> DataFrame:
    """(doc_id, tfidf, ri) of documents (doc_id, tokens): term ids with IDF weights and the plain sum of token vectors."""
    from semaloom.operators import dense
    from semaloom.operators.corpus import first_seen

    ids = first_seen(docs)
    at = docs.select("doc_id", F.explode("tokens").alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("n"))
    weights = at.join(ids, "token").join(corpus.vocab, "token").groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("token_id").cast("int"), "idf")))).alias("tfidf"))
    sums = dense.weighted_sum(at.join(corpus.enriched, "token").withColumn("_w", F.col("n") / 127.0), "doc_id", "q", "_w", corpus.config.dim)
    return weights.join(sums.withColumnRenamed("vec", "ri"), "doc_id")
