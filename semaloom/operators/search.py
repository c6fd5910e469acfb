"""Search of a corpus: exhaustive, by postings, by TF-IDF candidates, and the choice between them.

All work on many queries at once. Results are ordered by (score descending, doc_id), a strict
total order, in every mode; the score of a document is the same in every mode.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from semaloom.config import CANDIDATES, Mode
from semaloom.functions import vectors as V
from semaloom.functions.text import tokenize
from semaloom.operators import dense
from semaloom.operators.corpus import Corpus
from semaloom.runtime import cut

#: Queries whose vectors are sent to the executors together; more are taken in blocks.
BLOCK = 8192


def query_tokens(corpus: Corpus, queries: DataFrame, text: str = "text") -> DataFrame:
    """(query_id, tokens) of texts."""
    return queries.select("query_id", tokenize(F.col(text), corpus.config.abbrev).alias("tokens"))


def _terms(corpus: Corpus, queries: DataFrame) -> DataFrame:
    """(query_id, token, n, idf) of the query tokens that the corpus knows; n counts repeats."""
    counted = queries.select("query_id", F.explode("tokens").alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("n"))
    return counted.join(corpus.vocab.select("token", "idf"), "token")


def query_vectors(corpus: Corpus, queries: DataFrame) -> DataFrame:
    """(query_id, q, inv_mag): IDF-weighted sum over tokens with repeats, made unit, centred, quantized; zero stays zero."""
    from semaloom.functions.vectors import inv_mag

    dim, mean = corpus.config.dim, corpus.doc_mean
    weight = F.col("n") * (F.col("idf") if corpus.config.idf else F.lit(1.0)) / 127.0
    rows = _terms(corpus, queries).join(corpus.enriched, "token").withColumn("_w", weight)
    sums = dense.weighted_sum(rows, "query_id", "q", "_w", dim)
    whole = queries.filter(F.size("tokens") > 0).select("query_id").join(sums, "query_id", "left").select("query_id", F.coalesce("vec", F.array_repeat(F.lit(0.0), dim)).alias("vec"))

    def work(x: np.ndarray) -> np.ndarray:
        x = dense.unit(x)
        if mean is not None:
            some = np.sqrt((x * x).sum(1, keepdims=True)) > 1e-10
            x = np.where(some, dense.unit(x - mean), x)
        return dense.to_int8(x)

    q = dense.map_vectors(whole, "query_id", "vec", dim, work, "tinyint").withColumnRenamed("vec", "q")
    return q.withColumn("inv_mag", inv_mag(F.col("q")))


def best(scored: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, doc_id, score): the k best of each query."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("doc_id"))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def _blocks(vectors: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, q, inv_mag) of at most BLOCK queries at a time."""
    vectors = cut(vectors)
    n = -(-vectors.count() // BLOCK)
    for i in range(n):
        got = (vectors if n == 1 else vectors.filter(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i)).toArrow()
        ids = got.column("query_id").to_numpy()
        if len(ids):
            yield ids, np.array(got.column("q").to_pylist(), np.float32), got.column("inv_mag").to_numpy()


def _unit_scores(products: np.ndarray, inv_q: np.ndarray, inv_d: np.ndarray) -> np.ndarray:
    scores = np.clip((products.astype(np.float64) * inv_q * inv_d + 1.0) / 2.0, 0.0, 1.0)
    return np.where((inv_q <= 0) | (inv_d <= 0), 0.0, scores)


def brute(corpus: Corpus, vectors: DataFrame, k: int) -> DataFrame:
    """The k best of all documents for each query; a zero query gives every document score 0.

    Products of int8 vectors are exact integers in single precision up to 1,040 dimensions, and
    in double precision beyond. Each batch of documents keeps its own k best before the shuffle.
    """
    if k <= 0:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, doc_id long, score double")
    exact = np.float32 if corpus.config.dim <= 1040 else np.float64
    parts = []
    for ids, q, inv in _blocks(vectors):
        shared = corpus.spark.sparkContext.broadcast((ids, q.astype(exact), inv))

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q, inv = shared.value
            for batch in batches:
                for at in range(0, batch.num_rows, 2048):
                    part = batch.slice(at, 2048)
                    docs, inv_d = part.column(0).to_numpy(), part.column(2).to_numpy()
                    d = dense.matrix(part.column(1), q.shape[1], exact)
                    for lo in range(0, len(ids), 512):
                        scores = _unit_scores(q[lo : lo + 512] @ d.T, inv[lo : lo + 512, None], inv_d[None, :])
                        # k-th best score of the batch: everything at least as good may be in the result
                        least = -np.partition(-scores, k - 1, 1)[:, k - 1 : k] if k < scores.shape[1] else -1.0
                        a, b = np.nonzero(scores >= least)
                        if len(a) > 4 * k * len(scores):  # many ties: keep those with the smallest ids
                            order = np.lexsort((docs[b], -scores[a, b], a))
                            a, b = a[order], b[order]
                            first = np.searchsorted(a, np.arange(len(scores)))
                            keep = np.arange(len(a)) - first[a] < k
                            a, b = a[keep], b[keep]
                        yield pa.RecordBatch.from_arrays([pa.array(ids[lo + a]), pa.array(docs[b]), pa.array(scores[a, b])], names=["query_id", "doc_id", "score"])

        parts.append(corpus.doc_vectors.select("doc_id", "q", "inv_mag").mapInArrow(work, "query_id long, doc_id long, score double"))
    if not parts:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, doc_id long, score double")
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return best(whole, k)


#: Queries that a scan of the documents' terms takes at a time.
QUERIES = 512


def _scan(corpus: Corpus, queries: DataFrame, limit: int, vectors: DataFrame | None, squared: bool) -> DataFrame:
    """(query_id, doc_id, score, vector): the ``limit`` best documents by weight of common terms, with their vector scores.

    Documents are scored where they lie: a task looks the queries' terms up in the index by
    document, and gives its own ``limit`` best of each query. So rows that are shuffled follow the
    limit, not the frequency of the terms. ``vector`` is null without ``vectors`` and for zero queries.
    """
    schema = "query_id long, doc_id long, score double, vector double"
    spark = corpus.spark
    if corpus.forward is None or limit <= 0:
        return spark.createDataFrame([], schema)
    terms = _terms(corpus, queries)
    asked = queries.select("query_id").distinct() if vectors is None else vectors.select("query_id", "q", "inv_mag")
    terms = cut(terms.join(asked, "query_id", "left") if vectors is not None else terms)
    blocks = -(-terms.select("query_id").distinct().count() // QUERIES)
    parts = []
    for i in range(blocks):
        got = (terms if blocks == 1 else terms.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)).toArrow().sort_by([("token", "ascending"), ("query_id", "ascending")])
        if not got.num_rows:
            continue
        ids, query = np.unique(got.column("query_id").to_numpy(), return_inverse=True)
        tokens = got.column("token").combine_chunks().dictionary_encode()
        idf, n = got.column("idf").to_numpy(), got.column("n").to_numpy()
        weight = n * idf * idf if squared else n * idf
        starts = np.searchsorted(tokens.indices.to_numpy(), np.arange(len(tokens.dictionary) + 1))
        mass = np.bincount(query, weight, len(ids))
        q = inv = None
        if vectors is not None:
            _, first = np.unique(query, return_index=True)
            rows = got.take(pa.array(first))
            q, inv = np.array(rows.column("q").to_pylist(), np.float64), rows.column("inv_mag").to_numpy()
        shared = spark.sparkContext.broadcast((ids, tokens.dictionary, starts, query, weight, mass, q, inv))

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, known, starts, query, weight, mass, q, inv = shared.value
            held: list[np.ndarray] = []
            count = 0

            def best_of() -> np.ndarray:
                rows = np.concatenate(held)
                rows = rows[np.lexsort((rows["doc"], -rows["score"], rows["query"]))]
                first = np.searchsorted(rows["query"], np.arange(len(ids)))
                return rows[np.arange(len(rows)) - first[rows["query"]] < limit]

            for batch in batches:
                for at in range(0, batch.num_rows, 2048):
                    part = batch.slice(at, 2048)
                    docs, lists = part.column(0).to_numpy(), part.column(1)
                    place = pc.index_in(lists.flatten(), value_set=known)
                    doc = np.repeat(np.arange(len(docs)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                    doc, place = doc[place.is_valid().to_numpy(zero_copy_only=False)], place.drop_null().to_numpy()
                    # every term of a document meets the queries that have it
                    many = starts[place + 1] - starts[place]
                    entry = np.arange(many.sum()) + np.repeat(starts[place] - np.concatenate(([0], np.cumsum(many)[:-1])), many) if len(place) else np.zeros(0, np.int64)
                    cell = query[entry] * len(docs) + np.repeat(doc, many)
                    sums = np.bincount(cell, weight[entry], len(ids) * len(docs))
                    a, b = np.divmod(np.flatnonzero(np.bincount(cell, minlength=len(ids) * len(docs))), len(docs))
                    score = sums[a * len(docs) + b]
                    if squared:
                        whole = mass[a]
                        with np.errstate(divide="ignore", invalid="ignore"):
                            score = np.where((whole > 0) & (score > 0), score / (np.sqrt(whole) * np.sqrt(score)), 0.0)
                    rows = np.empty(len(a), [("query", "i8"), ("doc", "i8"), ("score", "f8"), ("vector", "f8")])
                    # rounded, so that ties don't depend on the order of addition
                    rows["query"], rows["doc"], rows["score"], rows["vector"] = a, docs[b], np.round(score, 9), np.nan
                    if q is not None:
                        found = _unit_scores(q @ dense.matrix(part.column(2), q.shape[1]).T, inv[:, None], part.column(3).to_numpy()[None, :])
                        rows["vector"] = np.where(inv[a] > 0, found[a, b], np.nan)
                    held.append(rows)
                    count += len(rows)
                    if count > 2 * limit * len(ids):
                        held = [best_of()]
                        count = len(held[0])
            if held:
                rows = best_of()
                for at in range(0, len(rows), 65536):
                    part = rows[at : at + 65536]
                    vector = pa.array(part["vector"], mask=np.isnan(part["vector"]))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[part["query"]]), pa.array(part["doc"].copy()), pa.array(part["score"].copy()), vector], names=["query_id", "doc_id", "score", "vector"])

        columns = ["doc_id", "terms", "q", "inv_mag"] if vectors is not None else ["doc_id", "terms"]
        parts.append(corpus.forward.select(*columns).mapInArrow(work, schema))
    if not parts:
        return spark.createDataFrame([], schema)
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("doc_id"))
    return whole.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= limit).drop("_r")


def keyword_candidates(corpus: Corpus, queries: DataFrame, limit: int = CANDIDATES) -> DataFrame:
    """(query_id, doc_id, score): documents with a query token; score is the sum of their IDFs, repeats counted."""
    return _scan(corpus, queries, limit, None, False).drop("vector")


def tfidf_candidates(corpus: Corpus, queries: DataFrame, limit: int = CANDIDATES) -> DataFrame:
    """(query_id, doc_id, score): matched IDF mass over the geometric mean of query and matched mass."""
    return _scan(corpus, queries, limit, None, True).drop("vector")


def candidate_count(corpus: Corpus, queries: DataFrame) -> DataFrame:
    """(query_id, n): number of keyword candidates, at most the limit; 0 without index or known tokens."""
    counts = keyword_candidates(corpus, queries, corpus.config.candidates).groupBy("query_id").agg(F.count("*").alias("n"))
    return queries.select("query_id").join(counts, "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def rerank(corpus: Corpus, vectors: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """The k best of any candidates (query_id, doc_id) by vector score; queries with a zero vector have none."""
    asked = vectors.filter("inv_mag > 0").select("query_id", F.col("q").alias("_q"), F.col("inv_mag").alias("_inv"))
    rows = candidates.select("query_id", "doc_id").join(corpus.doc_vectors, "doc_id").join(asked, "query_id")
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (V.int8_dot(F.col("_q"), F.col("q")).cast("double") * F.col("_inv") * F.col("inv_mag") + 1.0) / 2.0))
    return best(rows.select("query_id", "doc_id", F.when(F.col("inv_mag") > 0, score).otherwise(F.lit(0.0)).alias("score")), k)


def search(corpus: Corpus, queries: DataFrame, k: int, mode: Mode | None = None, text: str = "text") -> DataFrame:
    """(query_id, rank, doc_id, score) for (query_id, text).

    BRUTE scans all documents. FAST ranks keyword candidates, as many as there are. AUTO does too,
    but scans for queries with fewer than k candidates; so does TFIDF with its own candidates.
    Queries without tokens have no results; those with a zero vector only in BRUTE, with score 0.
    """
    mode = corpus.config.mode if mode is None else mode
    tokens = cut(query_tokens(corpus, queries, text)) if "tokens" not in queries.columns else queries
    vectors = cut(query_vectors(corpus, tokens))
    if mode is Mode.BRUTE:
        return brute(corpus, vectors, k)
    limit = max(corpus.config.candidates, 0)
    found = _scan(corpus, tokens, limit, vectors, mode is Mode.TFIDF)
    if mode is not Mode.FAST:
        found = cut(found)
    ranked = best(found.filter("vector is not null").select("query_id", "doc_id", F.col("vector").alias("score")), k)
    if mode is Mode.FAST:
        return ranked
    counts = found.groupBy("query_id").count()
    some = vectors.filter("inv_mag > 0").join(counts, "query_id", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    scan = cut(some.filter(F.col("count") < k).select("query_id", "q", "inv_mag"))
    return ranked.join(scan.select("query_id"), "query_id", "left_anti").unionByName(brute(corpus, scan, k))
