"""Mixing sources to target weights by Pareto order sampling.

Each source gets a share of all words by its weight, at most ``cap`` times its own words; what a
source cannot take is shared again by weight. A document's expected number of copies is its
source's target over its size, raised for long documents and lowered for short ones so that the
source's words still add up to its target: ``ratio + spread * (favour - mean favour)``, where the
favour grows with the document's size from 0 towards 1, the mean is weighted by size, and the
spread keeps all numbers of copies between 0 and the cap. The whole copies are certain. The
fraction is an inclusion probability that differs by document: documents are ranked by random
odds over inclusion odds, and the first ones are taken until the words come nearest to the target
(an error of half a document at most).

The random number is a digest of seed and doc_id, so reruns and lost tasks agree. Favours are
integers, so that sums do not depend on their order. Running sums are two-level: sums of (source,
rank bucket), then ranks within a bucket, so a source with a third of all rows is spread over many
tasks; buckets follow the source's own odds, so they are of about equal size whatever the ratio.

Defined cases: a null text has size 0; null sources form one source, ordered last; a source
without words has target 0 and takes nothing; documents of equal size in one source differ in
their random number alone; repeated rows are documents of their own with equal rank
(``mixed_documents`` draws all or none of them); an empty
table gives an empty result; extra columns are dropped by ``mix`` and kept by ``mixed_documents``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semaloom.llm import textkit
from semaloom.runtime import cut, lean

#: Ranks of a source are dealt over so many buckets.
BUCKETS = 1024
#: Words of a document that is favoured half as much as the longest; steps of favour; share of the widest spread that is used.
HALF, STEPS, SPREAD = 300, 1024, 0.5
#: Sources that are broadcast with what documents need of them, at most (about 100 bytes each).
MOST_BROADCAST = 100_000


def uniform(doc_id: Column, seed: str) -> Column:
    """In (0, 1), from 52 bits of a digest: a double holds it exactly."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 52))


def favour(size: Column) -> Column:
    """0 for no words, towards STEPS for very many."""
    return F.floor(size * F.lit(STEPS) / (size + F.lit(HALF))).cast("long")


def targets(sizes: DataFrame, weights: list[float], cap: float) -> DataFrame:
    """(source, source_size, favoured, target) from (source, size): capped shares by water filling.

    A source is capped if its cap is below weight x level, where the level is what uncapped
    sources share. Sources are taken in order of cap / weight; the level is the rest of the
    total over the rest of the weights, and a source stays capped as long as its ratio is below.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * favour(F.col("size"))).alias("favoured"))
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    listed = F.array(*[F.lit(float(w)) for w in weights])
    weighed = totals.withColumn("_w", F.element_at(listed, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    by_ratio = Window.partitionBy(F.lit(0)).orderBy(F.col("source_size") * F.lit(float(cap)) / F.col("_w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(everything) - F.lit(float(cap)) * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (
        F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    )
    # a source fills up when its cap is not above its share at the level reached before it
    filled = weighed.withColumn("_level", level).withColumn("_full", F.col("source_size") * F.lit(float(cap)) <= F.col("_w") * F.col("_level"))
    final = F.min(F.when(~F.col("_full"), F.struct(F.col("source_size") * F.lit(float(cap)) / F.col("_w"), F.col("_level")))).over(everything)
    return filled.withColumn("_final", final["_level"]).select(
        "source", "source_size", "favoured", F.when(F.col("_full"), F.col("source_size") * F.lit(float(cap))).otherwise(F.col("_w") * F.col("_final")).alias("target")
    )


def _sized(docs: DataFrame, text: str, *kept: str) -> DataFrame:
    """The columns ``kept`` of ``docs`` (all, where none is named) and ``_size``, the number of words of each text."""
    rows = docs.select(*[F.col(f"`{c}`") for c in (*(kept or docs.columns), text)]) if kept else docs
    fields = rows.schema.fields[: len(kept)] if kept else rows.schema.fields
    at = len(kept) if kept else docs.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.columns[: len(fields)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(textkit.word_counts(batch.column(at)))], names=[*[f.name for f in fields], "_size"])

    return rows.mapInArrow(lean(work), T.StructType([*fields, T.StructField("_size", T.LongType())]))


def _ranked(rows: DataFrame, seed: str, cap: float) -> DataFrame:
    """Adds the whole copies, the inclusion probability of one more, the rank, and the source's own odds, to rows with size, source_size, favoured and target."""
    some = F.col("source_size") > 0
    ratio = F.when(some, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    mean = F.when(some, F.col("favoured") / F.col("source_size") / F.lit(float(STEPS))).otherwise(F.lit(0.0))
    rows = rows.withColumn("_ratio", ratio).withColumn("_mean", mean)
    low, high = F.col("_ratio") / F.col("_mean"), (F.lit(float(cap)) - F.col("_ratio")) / (F.lit(1.0) - F.col("_mean"))
    spread = F.when(F.col("_mean") > 0, F.lit(SPREAD) * F.greatest(F.lit(0.0), F.least(low, high))).otherwise(F.lit(0.0))
    copies = F.col("_ratio") + F.col("_spread") * (favour(F.col("size")) / F.lit(float(STEPS)) - F.col("_mean"))
    rows = rows.withColumn("_spread", spread).withColumn("_copies", F.least(F.lit(float(cap)), F.greatest(F.lit(0.0), copies)))
    rows = rows.withColumn("_whole", F.floor("_copies")).withColumn("_p", F.col("_copies") - F.floor("_copies")).withColumn("_u", uniform(F.col("doc_id"), seed))
    odds = (F.col("_u") / (1 - F.col("_u"))) / (F.col("_p") / (1 - F.col("_p")))
    part = F.col("_ratio") - F.floor("_ratio")
    usual = F.when(part > 0, (1 - part) / part).otherwise(F.lit(1.0))
    return rows.withColumn("_rank", F.when(F.col("_p") > 0, odds).otherwise(F.lit(0.0))).withColumn("_usual", usual)


def mix(docs: DataFrame, weights: list[float], cap: float = 3.0, seed: str = "mix", key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, favoured, target, copies, taken, again) per document.

    ``taken`` is copies times size; ``again`` says that a copy beyond the whole ones was drawn.
    """
    sizes = cut(_sized(docs, text, key, source).toDF("doc_id", "source", "size"))
    goals = targets(sizes, weights, cap)
    # a source is one row here, so this side is as small as the list of sources; Spark checks its size
    rows = _ranked(sizes.join(goals, sizes["source"].eqNullSafe(goals["source"]), "inner").drop(goals["source"]), seed, cap)
    rows = rows.withColumn("_b", F.floor(F.col("_rank") / (F.col("_usual") + F.col("_rank")) * BUCKETS).cast("int"))
    rows = rows.withColumn("_drawn", F.when(F.col("_p") > 0, F.col("size")).otherwise(F.lit(0)))
    sums = rows.groupBy("source", "_b").agg(F.sum("_drawn").alias("_sum"), F.sum(F.col("_whole") * F.col("size")).alias("_sure"))
    below = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sure = F.sum("_sure").over(Window.partitionBy("source"))
    sums = sums.select(F.col("source").alias("_s"), F.col("_b").alias("_sb"), F.coalesce(F.sum("_sum").over(below), F.lit(0)).alias("_base"), sure.alias("_all_sure"))
    rows = rows.join(sums, rows["source"].eqNullSafe(sums["_s"]) & (rows["_b"] == sums["_sb"]))
    within = Window.partitionBy("source", "_b").orderBy("_rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("_base") + F.coalesce(F.sum("_drawn").over(within), F.lit(0))
    left = F.col("target") - F.col("_all_sure")
    again = (F.col("_p") > 0) & (ahead + F.col("size") / 2 <= left)
    copies = (F.col("_whole") + F.when(again, 1).otherwise(0)).cast("long")
    return rows.select("doc_id", "source", "size", "source_size", "favoured", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), again.alias("again"))


def mixed_documents(docs: DataFrame, weights: list[float], cap: float = 3.0, seed: str = "mix", key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """All columns of ``docs``, each row as often as the mix takes it.

    What a source takes beyond the whole copies is a prefix of its ranking, so the last place
    taken, one row per source, is all that documents need to be joined with: no text is shuffled.
    """
    chosen = _ranked(mix(docs, weights, cap, seed, key, text, source), seed, cap)
    place = lambda: F.struct(F.col("_rank").alias("r"), F.col("doc_id").alias("d"), F.col("size").alias("s"))
    last = cut(chosen.groupBy("source").agg(
        F.first("source_size").alias("source_size"), F.first("favoured").alias("favoured"), F.first("target").alias("target"), F.max(F.when(F.col("again"), place())).alias("_last")
    ), small=True)
    last = F.broadcast(last) if last.count() <= MOST_BROADCAST else last
    names = docs.columns
    held = _sized(docs, text).select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(key).alias("doc_id"), F.col(source).alias("_source"), F.col("_size").alias("size"))
    rows = _ranked(held.join(last, held["_source"].eqNullSafe(last["source"])), seed, cap)
    drawn = F.col("_last").isNotNull() & (F.col("_p") > 0) & F.coalesce(place() <= F.col("_last"), F.lit(False))
    copies = (F.col("_whole") + F.when(drawn, 1).otherwise(0)).cast("int")
    return rows.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), copies))).select("_row.*")


def op6_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs, [1.0, 2.0, 3.0], 3.0).select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size, sum(size * (size * 1024 // (size + 300)))::BIGINT AS favoured FROM sizes GROUP BY source
), weighed AS (
  SELECT *, [1.0, 2.0, 3.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w FROM totals
), levels AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE - 3.0::DOUBLE * coalesce(sum(source_size) OVER before, 0)::DOUBLE)
            / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
  FROM weighed WINDOW before AS (ORDER BY source_size * 3.0::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), goals AS (
  SELECT source, source_size, favoured,
    CASE WHEN source_size * 3.0::DOUBLE <= w * level THEN source_size * 3.0::DOUBLE
         ELSE w * (SELECT arg_min(level, source_size * 3.0::DOUBLE / w) FROM levels WHERE source_size * 3.0::DOUBLE > w * level) END AS target
  FROM levels
), ratios AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS ratio,
    CASE WHEN source_size > 0 THEN favoured::DOUBLE / source_size / 1024.0::DOUBLE ELSE 0.0::DOUBLE END AS mean
  FROM goals
), spreads AS (
  SELECT *, CASE WHEN mean > 0 THEN 0.5::DOUBLE * greatest(0.0::DOUBLE, least(ratio / mean, (3.0::DOUBLE - ratio) / (1.0::DOUBLE - mean))) ELSE 0.0::DOUBLE END AS spread FROM ratios
), expected AS (
  SELECT d.doc_id, d.source, d.size, g.source_size, g.target,
    least(3.0::DOUBLE, greatest(0.0::DOUBLE, ratio + spread * ((d.size * 1024 // (d.size + 300))::DOUBLE / 1024.0::DOUBLE - mean))) AS copies,
    ((('0x' || substr(md5('mix:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT)::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM sizes d JOIN spreads g ON d.source IS NOT DISTINCT FROM g.source
), parts AS (
  SELECT *, floor(copies) AS whole, copies - floor(copies) AS p FROM expected
), placed AS (
  SELECT *, CASE WHEN p > 0 THEN (u / (1.0::DOUBLE - u)) / (p / (1.0::DOUBLE - p)) ELSE 0.0::DOUBLE END AS rank, sum(whole * size) OVER (PARTITION BY source) AS sure FROM parts
), summed AS (
  SELECT *, coalesce(sum(CASE WHEN p > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY rank, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM placed
)
SELECT doc_id, size, source_size, target, ((whole + CASE WHEN p > 0 AND ahead + size / 2 <= target - sure THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM summed
"""
