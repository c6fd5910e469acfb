"""URL filter lists, by DataFrame functions only.

Each URL is expanded into (host suffix, path prefix) expressions. Expressions meet the rules in
an equi-join on a short prefix of their SHA-256, the full digest confirms a meeting, and the
longest fitting rule decides.

Defined cases: a null URL or one without ``://`` has an empty host and path and fits no rule
whose path is not empty; an empty table gives an empty result; repeated rows stay repeated;
duplicate rules count once, and of two rules with the same expression and different verdicts
``block`` wins; extra columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Up to so many rules are broadcast (at about 100 bytes each); more are joined by a shuffle.
BROADCAST_RULES = 100_000
#: Hex digits of the digest that the equi-join uses.
SHORT = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(_rest(url), "^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """Path: what follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.coalesce(F.locate("://", url), F.lit(0))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) triples as a table."""
    kind = T.StructType([T.StructField(n, T.StringType(), False) for n in ("host", "path", "verdict")])
    return spark.createDataFrame(rules, kind)


def url_verdicts(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``pages`` plus host, path, rule (null if none fits) and verdict.

    A rule fits its host and every subdomain of it if the URL's path starts with the rule's
    path. The longest rule wins: more characters of host and path together.
    """
    keep = keep or []
    ruled = (
        rules.select("host", "path", F.col("verdict").alias("_verdict"))
        .groupBy("host", "path").agg(F.max("_verdict").alias("_verdict"))
        .select(_digest(F.col("host"), F.col("path")).alias("_full"), F.concat("host", "path").alias("_rule"), "_verdict",
                F.length(F.concat("host", "path")).alias("_size"), F.size(F.split("host", "\\.")).alias("_labels"), F.length("path").alias("_plen"))
        .withColumn("_short", F.substring("_full", 1, SHORT))
    )
    shape = ruled.agg(F.count("*").alias("n"), F.max("_labels").alias("labels"), F.sort_array(F.collect_set("_plen")).alias("plens")).first()
    rows = pages.select(*keep, F.col(url).alias("_url")).withColumns({"host": host_of(F.col("_url")), "path": path_of(F.col("_url"))})
    if not shape["n"]:
        return rows.select(*keep, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    parts = F.split("host", "\\.")
    # Only as many labels as the longest rule's host has, and only path lengths that a rule has, can meet a rule.
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size(parts), F.lit(shape["labels"]))),
        lambda k: F.array_join(F.slice(parts, F.size(parts) - k + 1, k), "."),
    )
    lengths = F.filter(F.array(*[F.lit(x) for x in shape["plens"]]), lambda n: n <= F.length("path"))
    places = rows.select("host", "path").distinct()
    expressions = (
        places.withColumn("_suffix", F.explode(suffixes)).withColumn("_plen", F.explode(lengths))
        .withColumn("_full", _digest(F.col("_suffix"), F.substring(F.col("path"), F.lit(1), F.col("_plen"))))
        .select("host", "path", "_full", F.substring("_full", 1, SHORT).alias("_short"))
    )
    side = ruled.select("_short", F.col("_full").alias("_rule_full"), "_rule", "_verdict", "_size")
    side = F.broadcast(side) if shape["n"] <= BROADCAST_RULES else side
    met = expressions.join(side, "_short").filter(F.col("_full") == F.col("_rule_full"))
    best = met.groupBy("host", "path").agg(F.max(F.struct("_size", "_verdict", "_rule")).alias("_best"))
    return (
        rows.join(best, ["host", "path"], "left")
        .select(*keep, "host", "path", F.col("_best._rule").alias("rule"), F.coalesce("_best._verdict", F.lit(default)).alias("verdict"))
    )


#: The query's rules, as its contract states them.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return url_verdicts(pages, rules_frame(spark, RULES), keep=["page_id"])


OP7_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), split AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), rules(rhost, rpath, rverdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
)
SELECT s.page_id, s.host, s.path,
  (SELECT arg_max(rhost || rpath, length(rhost || rpath)) FROM rules WHERE (s.host = rhost OR ends_with(s.host, '.' || rhost)) AND starts_with(s.path, rpath)) AS rule,
  coalesce((SELECT arg_max(rverdict, length(rhost || rpath)) FROM rules WHERE (s.host = rhost OR ends_with(s.host, '.' || rhost)) AND starts_with(s.path, rpath)), 'allow') AS verdict
FROM split s
"""
