"""Bounded samples for fitting models on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded(df: DataFrame, most: int, *keys: str) -> DataFrame:
    """At most ``most`` rows, chosen by a digest of ``keys``; all of them, if there are no more.

    Rows above a threshold of the digest are filtered out first, so that the final limit sorts
    about ``most`` rows and not the whole table. ``df`` is counted: pass something cheap to read.
    """
    digest = F.xxhash64(*keys)
    if (n := df.count()) > most:
        df = df.filter(F.pmod(digest, F.lit(1 << 30)) < int((1 << 30) * min(1.0, 1.1 * most / n)))
    return df.orderBy(digest, *keys).limit(most)
