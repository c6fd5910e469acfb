"""A corpus: documents' tokens, their statistics, and the vectors made of them.

A builder collects documents; ``finalize`` turns them into tables that stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from semaloom.config import MAX_TOKENS, EngineConfig
from semaloom.functions.text import tokenize
from semaloom.operators import cooccurrence, dense
from semaloom.operators.packed import Packed
from semaloom.runtime import cut


class CorpusStateError(RuntimeError):
    """A builder was used after its end, or settings differ from those it was built with."""


def accepted(docs: DataFrame, most: int = MAX_TOKENS) -> DataFrame:
    """Documents of 1 to ``most`` tokens; null tokens keep their places.

    The generator of one row keeps the optimizer from moving the filter below the projection that
    makes the tokens, where texts would be tokenized once for each bound and again for the result.
    """
    return docs.withColumn("tokens", F.explode(F.array("tokens"))).filter(F.size("tokens").between(1, most))


def doc_map(docs: DataFrame, order: str = "doc_id", most: int = MAX_TOKENS, max_docs: int | None = None) -> DataFrame:
    """(order, accepted number from 0 or -1). A batch that would go beyond ``max_docs`` is rejected whole."""
    ok = accepted(docs, most)
    if max_docs is not None and ok.count() > max_docs:
        return docs.select(order, F.lit(-1).cast("long").alias("doc_no"))
    # numbers are counts before: per range partition, then within it, so no task sees all documents
    ranged = ok.select(order).repartitionByRange(F.col(order)).withColumn("_p", F.spark_partition_id())
    ranged = cut(ranged)
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_p").count().withColumn("_base", F.coalesce(F.sum("count").over(before), F.lit(0))).select("_p", "_base")
    numbered = ranged.join(F.broadcast(offsets), "_p").withColumn("doc_no", F.row_number().over(Window.partitionBy("_p").orderBy(order)) - 1 + F.col("_base"))
    return docs.select(order).join(numbered.select(order, "doc_no"), order, "left").select(order, F.coalesce("doc_no", F.lit(-1)).cast("long").alias("doc_no"))


def positions(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, token) of every occurrence."""
    return docs.select("doc_id", F.posexplode("tokens").alias("pos", "token")).filter("token is not null")


def postings_of(docs: DataFrame) -> DataFrame:
    """(token, doc_id, tf): the inverted index with term frequencies."""
    return docs.select("doc_id", F.explode("tokens").alias("token")).filter("token is not null").groupBy("token", "doc_id").agg(F.count("*").alias("tf"))


def vocab_of(postings: DataFrame, n_docs: int) -> DataFrame:
    """(token, df, idf) with idf = ln(N / df)."""
    return with_idf(postings.groupBy("token").agg(F.count("*").alias("df")), n_docs)


def with_idf(counts: DataFrame, n_docs: int) -> DataFrame:
    return counts.withColumn("idf", F.log(F.lit(float(n_docs)) / F.col("df")) if n_docs else F.lit(0.0))


def first_seen(docs: DataFrame) -> DataFrame:
    """(token, token_id): ids from 0 by first occurrence. One row per token is ordered, by ranges."""
    first = positions(docs).groupBy("token").agg(F.min(F.struct("doc_id", "pos")).alias("_at")).select("token", F.col("_at.doc_id").alias("_d"), F.col("_at.pos").alias("_i"))
    ranged = cut(first.repartitionByRange("_d", "_i").withColumn("_p", F.spark_partition_id()))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_p").count().withColumn("_base", F.coalesce(F.sum("count").over(before), F.lit(0))).select("_p", "_base")
    within = Window.partitionBy("_p").orderBy("_d", "_i")
    return ranged.join(F.broadcast(offsets), "_p").select("token", (F.row_number().over(within) - 1 + F.col("_base")).cast("long").alias("token_id"))


class Later:
    """A table that is made when it is first asked for, and kept in the shared checkpoint folder then."""

    def __init__(self, make: Callable[[], DataFrame]):
        self.make, self.made = make, None

    def __call__(self) -> DataFrame:
        if self.made is None:
            self.made = cut(self.make())
        return self.made


@dataclass(frozen=True)
class Corpus:
    """The tables of a finished corpus; those of the index may be made ``Later``."""

    config: EngineConfig
    n_docs: int
    vocab: DataFrame
    postings: DataFrame | Later | None
    enriched: DataFrame
    doc_vectors: DataFrame
    doc_mean: np.ndarray | None
    labels: DataFrame | None = None
    #: (doc_id, terms, q, inv_mag): the index by document, for scoring where the documents lie.
    forward: DataFrame | Later | None = None

    def __getattribute__(self, name: str):
        got = object.__getattribute__(self, name)
        return got() if isinstance(got, Later) else got

    @property
    def spark(self) -> SparkSession:
        return self.vocab.sparkSession

    @property
    def n_tokens(self) -> int:
        return self.vocab.count()

    def label(self, doc_ids: DataFrame) -> DataFrame:
        """``doc_ids`` with their labels; null where there is none."""
        if self.labels is None:
            return doc_ids.withColumn("label", F.lit(None).cast("string"))
        return doc_ids.join(self.labels, "doc_id", "left")

    def token(self, token: str) -> DataFrame:
        """(token, idf, vec) of one token; no row if unknown."""
        from semaloom.functions.vectors import dequantize

        return self.vocab.filter(F.col("token") == token).join(self.enriched, "token").select("token", "idf", dequantize("q").alias("vec"))

    def tokens_at(self) -> DataFrame:
        """(token_id, token, idf, vec) of all tokens, numbered from 0 by first occurrence; needs the index."""
        from semaloom.functions.vectors import dequantize

        if self.forward is None:
            raise CorpusStateError("a corpus without an index does not know where tokens occur")
        ids = first_seen(self.forward.select("doc_id", F.col("terms").alias("tokens")))
        return ids.join(self.vocab, "token").join(self.enriched, "token").select("token_id", "token", "idf", dequantize("q").alias("vec"))

    def token_at(self, i: int) -> DataFrame:
        """(token_id, token, idf, vec) of the i-th token; no row if there is none."""
        return self.tokens_at().filter(F.col("token_id") == i)

    def check(self, config: EngineConfig) -> None:
        """Refuse settings that change vectors and differ from those of the build."""
        same = lambda c: (c.dim, c.idf, c.abbrev)
        if same(config) != same(self.config):
            raise CorpusStateError(f"the corpus was built with {same(self.config)}, not {same(config)}")


class CorpusBuilder:
    """Collects documents (doc_id, tokens[, label]); ``finalize`` may be called once or again with the same result."""

    def __init__(self, spark: SparkSession, config: EngineConfig | None = None):
        self.spark, self.config = spark, config or EngineConfig()
        self._docs: DataFrame | None = None
        self._corpus: Corpus | None = None

    def _add(self, docs: DataFrame) -> CorpusBuilder:
        if self._corpus is not None:
            raise CorpusStateError("documents cannot be added after finalize")
        docs = docs if "label" in docs.columns else docs.withColumn("label", F.lit(None).cast("string"))
        docs = accepted(docs.select("doc_id", "tokens", "label"))
        self._docs = docs if self._docs is None else self._docs.unionByName(docs)
        return self

    def add_tokens(self, docs: DataFrame) -> CorpusBuilder:
        """Documents that are token lists."""
        return self._add(docs)

    def add_texts(self, docs: DataFrame, text: str = "text") -> CorpusBuilder:
        """Documents that are texts or names."""
        return self._add(docs.withColumn("tokens", tokenize(F.col(text), self.config.abbrev)))

    def add_chunks(self, chunks: DataFrame) -> CorpusBuilder:
        """Chunks of files (doc_id, path, content); the path is the label."""
        text = F.decode("content", "ISO-8859-1")
        return self._add(chunks.select("doc_id", tokenize(text, self.config.abbrev).alias("tokens"), F.col("path").alias("label")))

    def finalize(self, provider) -> Corpus:
        """All tables, kept in the shared checkpoint folder."""
        if self._corpus is not None:
            return self._corpus
        config = self.config
        if provider.dim != config.dim:
            raise CorpusStateError(f"vectors have {provider.dim} dimensions, the corpus {config.dim}")
        empty = self._docs is None
        docs = self.spark.createDataFrame([], "doc_id long, tokens array<string>, label string") if empty else self._docs
        held = Packed(docs)
        n = held.count()
        if config.max_docs is not None and n > config.max_docs:
            raise CorpusStateError(f"{n} documents are more than {config.max_docs}")
        labelled = held.labels().count()
        if labelled not in (0, n):
            raise CorpusStateError("either all documents have labels or none has")
        vocab = cut(with_idf(held.tokens(), n))
        sources = provider.vectors(vocab)
        enriched = cut(cooccurrence.enrich(held, sources, config.dim) if config.ri else token_vectors(sources, config.dim))
        postings = Later(lambda: postings_of(held.docs()))
        if vocab.count() * config.dim <= GATHER_BYTES:
            units = gathered(held, vocab, enriched, config)
        else:
            units = summed(postings(), vocab, enriched, held.docs().select("doc_id"), config)
        vectors, mean = doc_vectors(units, n, config)
        corpus = Corpus(config, n, vocab, None, enriched, vectors, mean, held.labels() if labelled else None)
        if config.sparse_nnz:
            corpus = sparse(corpus)
        if config.index:
            terms = held.docs().select("doc_id", F.array_distinct(F.filter("tokens", lambda t: t.isNotNull())).alias("terms"))
            corpus = replace(corpus, postings=postings, forward=Later(lambda scored=corpus.doc_vectors: terms.join(scored, "doc_id")))
        self._corpus = corpus
        return self._corpus


def token_vectors(sources: DataFrame, dim: int) -> DataFrame:
    """(token, q): unit vectors, quantized."""
    return dense.map_vectors(sources, "token", "vec", dim, lambda x: dense.to_int8(dense.unit(x)), "tinyint").withColumnRenamed("vec", "q")


#: Token vectors of at most so many bytes are sent to the tasks that add them up; larger tables are joined with the postings.
GATHER_BYTES = 192 << 20
#: Tokens whose vectors are added up at a time.
GATHER_TOKENS = 16384


def gathered(docs: Packed, vocab: DataFrame, enriched: DataFrame, config: EngineConfig) -> DataFrame:
    """(doc_id, vec): IDF-weighted sums over occurrences, made unit. Every task looks its blocks' tokens up; nothing is shuffled."""
    dim = config.dim
    got = vocab.join(enriched, "token").select("token", "idf", "q").toArrow()
    idf = got.column("idf").to_numpy() if config.idf else np.ones(got.num_rows)
    shared = vocab.sparkSession.sparkContext.broadcast((got.column("token").combine_chunks(), idf / 127.0, dense.matrix(got.column("q").combine_chunks(), dim, np.int8)))

    def work(ids: pa.Array, n: np.ndarray, codes: np.ndarray, tokens: pa.Array) -> Iterator[pa.RecordBatch]:
        known, weight, q = shared.value
        places = np.concatenate((pc.index_in(tokens, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False), [-1]))
        ends = np.concatenate(([0], np.cumsum(n)))
        for lo in range(0, len(ids), 2048):
            some = n[lo : lo + 2048]
            place = places[codes[ends[lo] : ends[lo + len(some)]]]  # code -1 is the last place
            row = np.repeat(np.arange(len(some)), some)[place >= 0]
            place = place[place >= 0]
            sums = np.zeros((len(some), dim))
            for at in range(0, len(place), GATHER_TOKENS):
                p, r = place[at : at + GATHER_TOKENS], row[at : at + GATHER_TOKENS]
                first = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
                sums[r[first]] += np.add.reduceat(q[p] * weight[p, None], first)
            yield pa.RecordBatch.from_arrays([ids[lo : lo + 2048], dense.lists(dense.unit(sums))], names=["doc_id", "vec"])

    return cut(docs.map_blocks(work, f"doc_id {docs.id_type}, vec array<double>"))


def summed(postings: DataFrame, vocab: DataFrame, enriched: DataFrame, ids: DataFrame, config: EngineConfig) -> DataFrame:
    """The same by joining postings with token vectors, for vocabularies that no task should hold."""
    dim = config.dim
    weight = F.col("tf") * (F.col("idf") if config.idf else F.lit(1.0)) / 127.0
    rows = postings.join(vocab.select("token", "idf"), "token").join(enriched, "token").withColumn("_w", weight)
    sums = dense.weighted_sum(rows, "doc_id", "q", "_w", dim)
    whole = ids.join(sums, "doc_id", "left").select("doc_id", F.coalesce("vec", F.array_repeat(F.lit(0.0), dim)).alias("vec"))
    return cut(dense.map_vectors(whole, "doc_id", "vec", dim, dense.unit, "double"))


def doc_vectors(units: DataFrame, n: int, config: EngineConfig) -> tuple[DataFrame, np.ndarray | None]:
    """((doc_id, q, inv_mag), mean) of unit vectors: centred, quantized."""
    mean = dense.mean_vector(units, "vec") if n >= 2 else None
    return cut(quantized(units, "doc_id", config.dim, mean)), mean


def quantized(units: DataFrame, key: str, dim: int, mean: np.ndarray | None) -> DataFrame:
    """(key, q, inv_mag) of centred vectors."""
    from semaloom.functions.vectors import inv_mag

    centred = lambda x: dense.to_int8(x if mean is None else dense.unit(x - mean))
    q = dense.map_vectors(units, key, "vec", dim, centred, "tinyint").withColumnRenamed("vec", "q")
    return q.withColumn("inv_mag", inv_mag(F.col("q")))


def sparse(corpus: Corpus) -> Corpus:
    """The corpus with the largest components of token and document vectors alone; magnitudes follow what is kept."""
    from semaloom.functions.vectors import inv_mag

    keep, dim = corpus.config.sparse_nnz, corpus.config.dim

    def largest(x: np.ndarray) -> np.ndarray:
        order = np.argsort(-np.abs(x), axis=1, kind="stable")[:, :keep]
        out = np.zeros_like(x)
        np.put_along_axis(out, order, np.take_along_axis(x, order, 1), 1)
        return out.astype(np.int8)

    cut_q = lambda df, key: dense.map_vectors(df, key, "q", dim, largest, "tinyint")
    docs = cut_q(corpus.doc_vectors, "doc_id").withColumn("inv_mag", inv_mag(F.col("q")))
    return replace(corpus, enriched=cut(cut_q(corpus.enriched, "token")), doc_vectors=cut(docs))
