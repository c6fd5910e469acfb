"""Saving and loading of finished corpora: a Parquet folder per table and a description."""

from __future__ import annotations

import json
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semaloom.config import EngineConfig
from semaloom.operators.corpus import Corpus

VERSION = 4
_FIELDS = {"version", "config", "n_docs", "n_tokens", "has_mean", "has_labels", "has_index"}


class CorpusFormatError(ValueError):
    """A folder does not hold a corpus of this version, or its tables contradict each other."""


def _path(spark: SparkSession, name: str):
    return spark._jvm.org.apache.hadoop.fs.Path(name)


def _system(spark: SparkSession, name: str):
    return _path(spark, name).getFileSystem(spark._jsc.hadoopConfiguration())


def save(corpus: Corpus, folder: str) -> None:
    """Write all tables to a new folder within ``folder``, then name it in ``current``.

    ``current`` is replaced by a rename that overwrites, so a reader sees the old corpus or the new
    one, and a writer that dies leaves the old one. Folders that are no longer named are removed last.
    """
    spark = corpus.spark
    name = f"v{uuid.uuid4().hex}"
    temp = f"{folder.rstrip('/')}/{name}"
    about = {
        "version": VERSION, "config": json.loads(corpus.config.to_json()), "n_docs": corpus.n_docs, "n_tokens": corpus.n_tokens,
        "has_mean": corpus.doc_mean is not None, "has_labels": corpus.labels is not None, "has_index": corpus.postings is not None,
    }
    corpus.vocab.write.parquet(f"{temp}/vocab")
    corpus.enriched.write.parquet(f"{temp}/enriched")
    corpus.doc_vectors.write.parquet(f"{temp}/doc_vectors")
    if corpus.postings is not None:
        # clustered by token, so that a query's row groups are few
        corpus.postings.repartitionByRange("token").sortWithinPartitions("token", "doc_id").write.parquet(f"{temp}/postings")
        corpus.forward.write.parquet(f"{temp}/forward")
    if corpus.labels is not None:
        corpus.labels.write.parquet(f"{temp}/labels")
    if corpus.doc_mean is not None:
        spark.createDataFrame([([float(x) for x in corpus.doc_mean],)], "mean array<double>").write.parquet(f"{temp}/doc_mean")
    spark.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.text(f"{temp}/about")
    jvm, system = spark._jvm, _system(spark, folder)
    fresh = f"{folder.rstrip('/')}/{name}.current"
    out = system.create(_path(spark, fresh), True)
    out.write(bytearray(name.encode()))
    out.close()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), spark._jsc.hadoopConfiguration())
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    whole = lambda p: system.makeQualified(_path(spark, p))
    files.rename(whole(fresh), whole(f"{folder.rstrip('/')}/current"), over)
    for status in system.listStatus(_path(spark, folder)):
        if status.isDirectory() and status.getPath().getName() != name:
            system.delete(status.getPath(), True)


def current(spark: SparkSession, folder: str) -> str:
    """The folder of the tables that ``folder`` names."""
    return f"{folder.rstrip('/')}/{spark.read.text(f'{folder}/current', wholetext=True).first()[0].strip()}"


def load(spark: SparkSession, folder: str, check: bool = True) -> Corpus:
    """The corpus in ``folder``; its settings are adopted. Anything wrong raises CorpusFormatError."""
    try:
        folder = current(spark, folder)
        about = json.loads(spark.read.text(f"{folder}/about", wholetext=True).first()[0])
        if set(about) != _FIELDS:
            raise CorpusFormatError(f"unknown or missing fields: {sorted(set(about) ^ _FIELDS)}")
        if about["version"] != VERSION:
            raise CorpusFormatError(f"version {about['version']}, not {VERSION}")
        config = EngineConfig.from_json(json.dumps(about["config"]))
        table = lambda name: spark.read.parquet(f"{folder}/{name}")
        mean = np.array(table("doc_mean").first()["mean"]) if about["has_mean"] else None
        corpus = Corpus(
            config, about["n_docs"], table("vocab"), table("postings") if about["has_index"] else None, table("enriched"), table("doc_vectors"), mean,
            table("labels") if about["has_labels"] else None, table("forward") if about["has_index"] else None,
        )
    except CorpusFormatError:
        raise
    except Exception as e:
        raise CorpusFormatError(f"{folder} holds no readable corpus: {e}") from e
    if check:
        validate(corpus, about["n_tokens"])
    return corpus


def validate(corpus: Corpus, n_tokens: int | None = None) -> None:
    """Raise CorpusFormatError if the tables contradict each other. Each rule is one distributed query."""
    dim, n = corpus.config.dim, corpus.n_docs

    def none(bad: DataFrame, what: str) -> None:
        if not bad.isEmpty():
            raise CorpusFormatError(what)

    if n < 0 or (n_tokens is not None and corpus.vocab.count() != n_tokens):
        raise CorpusFormatError("the number of tokens differs from the description")
    if corpus.doc_mean is not None and (len(corpus.doc_mean) != dim or not np.isfinite(corpus.doc_mean).all()):
        raise CorpusFormatError("the mean vector is not finite or has another dimension")
    if (corpus.doc_mean is not None) != (n >= 2):
        raise CorpusFormatError("a mean vector goes with two documents or more")
    none(corpus.vocab.filter("token is null or df < 1 or idf is null or isnan(idf)").limit(1), "a token has no valid counts")
    none(corpus.vocab.filter(F.col("df") > n).limit(1), "a token is in more documents than there are")
    none(corpus.vocab.groupBy("token").count().filter("count > 1").limit(1), "a token is listed twice")
    none(corpus.enriched.filter((F.size("q") != dim) | F.col("q").isNull()).limit(1), "a token vector has another dimension")
    none(corpus.enriched.join(corpus.vocab, "token", "left_anti").limit(1), "a token vector has no token")
    bad = (F.size("q") != dim) | F.col("q").isNull() | F.col("inv_mag").isNull() | F.isnan("inv_mag") | (F.col("inv_mag") < 0) | (F.col("inv_mag") == float("inf"))
    none(corpus.doc_vectors.filter(bad).limit(1), "a document vector is not valid")
    if corpus.doc_vectors.count() != n or corpus.doc_vectors.select("doc_id").distinct().count() != n:
        raise CorpusFormatError("documents and their vectors differ in number")
    if corpus.postings is not None:
        none(corpus.postings.groupBy("token", "doc_id").count().filter("count > 1").limit(1), "a posting is listed twice")
        none(corpus.postings.join(corpus.vocab, "token", "left_anti").limit(1), "a posting has no token")
        none(corpus.postings.join(corpus.doc_vectors, "doc_id", "left_anti").limit(1), "a posting has no document")
        listed = corpus.forward.select("doc_id", F.explode("terms").alias("token"))
        if corpus.forward.count() != n or listed.count() != corpus.postings.count() or not listed.join(corpus.postings, ["doc_id", "token"], "left_anti").isEmpty():
            raise CorpusFormatError("the indexes by token and by document differ")
    if corpus.labels is not None and (corpus.labels.count() != n or not corpus.labels.filter("label is null").isEmpty()):
        raise CorpusFormatError("labels and documents differ in number")


def dump(results: DataFrame, path: str) -> None:
    """Write a ranking as text, one ``query_id rank doc_id score`` a line, scores with six decimals."""
    line = F.concat_ws(" ", F.col("query_id").cast("string"), F.col("rank").cast("string"), F.col("doc_id").cast("string"), F.format_string("%.6f", F.col("score")))
    results.repartitionByRange("query_id", "rank").sortWithinPartitions("query_id", "rank").select(line).write.mode("overwrite").text(path)
