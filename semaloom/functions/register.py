"""The engine's functions under SQL names.

SQL functions are made of Catalyst expressions, so queries that call them stay in the JVM. They
are registered as temporary SQL functions where the session supports it.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from semaloom.functions.text import CAMEL, DELIMITERS


def _literal(text: str) -> str:
    escapes = {"\\": "\\\\", "'": "\\'", "\n": "\\n", "\t": "\\t", "\r": "\\r"}
    return "'" + "".join(escapes.get(c, c) for c in text) + "'"


def register(spark: SparkSession) -> list[str]:
    """Create loom_tokenize, loom_cosine, loom_int8_dot and loom_proximity as temporary functions; returns their names."""
    spaces = " " * len(DELIMITERS)
    bodies = {
        "loom_tokenize(s STRING) RETURNS ARRAY<STRING>": (
            f"slice(filter(split(lower(regexp_replace(translate(regexp_replace(coalesce(s, ''), {_literal(CAMEL)}, ' '), {_literal(DELIMITERS)}, '{spaces}'), '[^A-Za-z0-9 ]+', '')), ' '), "
            "t -> length(t) BETWEEN 2 AND 255), 1, 512)"
        ),
        "loom_int8_dot(a ARRAY<TINYINT>, b ARRAY<TINYINT>) RETURNS BIGINT": "aggregate(zip_with(a, b, (x, y) -> CAST(x AS BIGINT) * CAST(y AS BIGINT)), 0L, (s, x) -> s + x)",
        "loom_cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": (
            "coalesce(aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) / "
            "nullif(sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x)), 0D), 0D)"
        ),
        "loom_proximity(a STRING, b STRING) RETURNS DOUBLE": (
            "CASE WHEN a IS NULL OR b IS NULL OR greatest(size(split(a, '/')), size(split(b, '/'))) = 1 THEN 1D ELSE 1D + 0.1D * "
            "aggregate(zip_with(slice(split(a, '/'), 1, size(split(a, '/')) - 1), slice(split(b, '/'), 1, size(split(b, '/')) - 1), (x, y) -> coalesce(x = y AND length(x) > 0, false)), "
            "named_struct('n', 0, 'on', true), (s, x) -> named_struct('n', s.n + IF(s.on AND x, 1, 0), 'on', s.on AND x), s -> s.n) "
            "/ greatest(size(split(a, '/')), size(split(b, '/'))) END"
        ),
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [h.split("(")[0] for h in bodies]
