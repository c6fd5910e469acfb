"""Scoring of arriving documents against a finished corpus.

Corpora are built once and then read-only: statistics, token vectors and the mean stay as they
are, so a stream has no state of its own. Each micro-batch is an ordinary batch search.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from semaloom.config import Mode
from semaloom.operators.corpus import Corpus
from semaloom.operators.search import search


def score_stream(stream: DataFrame, corpus: Corpus, k: int, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: Mode = Mode.AUTO, key: str = "doc_id", text: str = "text") -> StreamingQuery:
    """Search the corpus for every document of ``stream``; ``sink`` gets (query_id, rank, doc_id, score) and the batch number."""

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.select(F.col(key).alias("query_id"), F.col(text).alias("text"))
        sink(search(corpus, rows, k, mode), number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
