"""Comparison of rankings: overlap, parity, and quality against graded judgments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """(query_id, overlap): documents that two rankings have in common."""
    both = a.select("query_id", "doc_id").join(b.select("query_id", "doc_id"), ["query_id", "doc_id"])
    queries = a.select("query_id").union(b.select("query_id")).distinct()
    return queries.join(both.groupBy("query_id").agg(F.count("*").alias("overlap")), "query_id", "left").select("query_id", F.coalesce("overlap", F.lit(0)).cast("long").alias("overlap"))


def differences(a: DataFrame, b: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Places where two rankings disagree in document or, beyond the tolerance, in score."""
    pair = a.select("query_id", "rank", F.col("doc_id").alias("doc_a"), F.col("score").alias("score_a")).join(
        b.select("query_id", "rank", F.col("doc_id").alias("doc_b"), F.col("score").alias("score_b")), ["query_id", "rank"], "full"
    )
    return pair.filter(~F.col("doc_a").eqNullSafe(F.col("doc_b")) | (F.abs(F.col("score_a") - F.col("score_b")) > tolerance))


def quality(ranking: DataFrame, judged: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, precision, strict, ndcg, mrr) at k for (query_id, doc_id, grade); strict counts grades of 2 and more."""
    top = ranking.filter(F.col("rank") <= k).join(judged, ["query_id", "doc_id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    gain = (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("rank") + 1)
    got = top.groupBy("query_id").agg(
        (F.sum((F.col("grade") >= 1).cast("int")) / k).alias("precision"),
        (F.sum((F.col("grade") >= 2).cast("int")) / k).alias("strict"),
        F.sum(gain).alias("_dcg"),
        F.max(F.when(F.col("grade") >= 1, 1.0 / F.col("rank"))).alias("_mrr"),
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("grade"), F.asc("doc_id"))
    ideal = judged.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).groupBy("query_id").agg(F.sum(gain).alias("_ideal"))
    return got.join(ideal, "query_id", "left").select(
        "query_id", "precision", "strict", F.when(F.col("_ideal") > 0, F.col("_dcg") / F.col("_ideal")).otherwise(F.lit(0.0)).alias("ndcg"), F.coalesce("_mrr", F.lit(0.0)).alias("mrr")
    )
