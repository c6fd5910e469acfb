"""Documents' tokens in blocks: codes of a block's own vocabulary, compressed, and that vocabulary by bucket.

A block has the documents of a part of a partition. What its tokens need from other blocks, and give
to them, goes by bucket (a digest of the token), one row for each block and bucket. So no row stands
for an occurrence or a pair, and frequent tokens weigh no more than others.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semaloom.functions.text import tokens_of
from semaloom.runtime import cut, lean

#: Occurrences that end a block, and the most buckets.
BLOCK_TOKENS, MOST_BUCKETS = 1 << 21, 1024
#: ``bucket`` is -1 for a block's documents {id, n, label} and -2 for its codes {code}; other rows have {token, df}.
DOCS, CODES = -1, -2
SCHEMA = "block long, bucket int, data binary"


def shut(**columns: pa.Array) -> bytes:
    """Columns of one length as compressed Arrow bytes."""
    batch = pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def opened(data: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(data) as got:
        return got.read_next_batch()


def bucket_of(tokens: pa.Array, buckets: int) -> np.ndarray:
    """The same as ``bucket`` in DataFrames."""
    return np.fromiter((zlib.crc32(t) for t in tokens.cast(pa.binary()).to_pylist()), np.int64, len(tokens)) % buckets


def bucket(token: str, buckets: int):
    return (F.crc32(F.col(token).cast("binary")) % buckets).cast("int")


def rows(schema: str, *columns: list) -> pa.RecordBatch:
    """A batch of a schema of long, int and binary columns."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns or [[]] * len(fields), fields, strict=True)], names=[name for name, _ in fields])


class Packed:
    """Documents (doc_id, tokens[, label]) in blocks, kept in the shared checkpoint folder.

    Documents (doc_id, text[, label]) are tokenized, without abbreviations, where they are packed; those without a token are left out.
    """

    def __init__(self, docs: DataFrame):
        self.id_type = dict(docs.dtypes)["doc_id"]
        self.buckets = buckets = max(12, min(MOST_BUCKETS, docs.rdd.getNumPartitions()))
        texts = "tokens" not in docs.columns

        def tokenized(batch: pa.RecordBatch) -> pa.RecordBatch:
            tokens = tokens_of(batch.column(1))
            some = pc.greater(pc.list_value_length(tokens), 0)
            return pa.RecordBatch.from_arrays([batch.column(0), tokens, batch.column(2)], names=["doc_id", "tokens", "label"]).filter(some)

        def pack(held: list[pa.RecordBatch], block: int) -> pa.RecordBatch:
            ids, labels = (pa.chunked_array([b.column(i) for b in held]).combine_chunks() for i in (0, 2))
            n = pa.chunked_array([pc.list_value_length(b.column(1)) for b in held]).combine_chunks()
            words = pa.chunked_array([b.column(1).flatten() for b in held]).dictionary_encode().unify_dictionaries().combine_chunks()
            if isinstance(words, pa.ChunkedArray):
                words = pa.concat_arrays(words.chunks)
            where = bucket_of(words.dictionary, buckets)
            order = np.argsort(where, kind="stable")
            # one more place, at the end, for nulls
            rank = np.full(len(order) + 1, -1, np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            codes = rank[words.indices.fill_null(len(order)).to_numpy(zero_copy_only=False)]
            tokens, bounds = words.dictionary.take(pa.array(order)), np.searchsorted(where[order], np.arange(buckets + 1))
            # a token's documents: sorting is much faster here than the table that np.unique makes
            pairs = np.repeat(np.arange(len(n)), n.to_numpy(zero_copy_only=False))[codes >= 0] * max(1, len(order)) + codes[codes >= 0]
            pairs.sort()
            df = np.bincount(pairs[np.diff(pairs, prepend=-1) > 0] % max(1, len(order)), minlength=len(order))
            some = [b for b in range(buckets) if bounds[b] < bounds[b + 1]]
            data = [shut(token=tokens[bounds[b] : bounds[b + 1]], df=pa.array(df[bounds[b] : bounds[b + 1]])) for b in some]
            return rows(SCHEMA, [block] * (len(some) + 2), [DOCS, CODES, *some], [shut(id=ids, n=n, label=labels), shut(code=pa.array(codes)), *data])

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            block, held, n = TaskContext.get().partitionId() << 32, [], 0
            for batch in map(tokenized, batches) if texts else batches:
                for at in range(0, batch.num_rows, 512):
                    held.append(batch.slice(at, 512))
                    n += len(held[-1].column(1).flatten())
                    if n >= BLOCK_TOKENS:
                        yield pack(held, block)
                        block, held, n = block + 1, [], 0
            if n or held:
                yield pack(held, block)

        label = F.col("label") if "label" in docs.columns else F.lit(None)
        self.rows = cut(docs.select("doc_id", "text" if texts else "tokens", label.cast("string").alias("label")).mapInArrow(lean(work), SCHEMA))

    def tokens(self) -> DataFrame:
        """(token, df): every token once, with the number of its documents."""

        def add(group: pa.Table) -> pa.Table:
            whole = pa.Table.from_batches([opened(x) for x in group.column("data").to_pylist()])
            got = whole.group_by("token").aggregate([("df", "sum")])
            return pa.table({"token": got.column("token"), "df": got.column("df_sum").cast(pa.int64())})

        return self.rows.filter("bucket >= 0").groupBy("bucket").applyInArrow(add, "token string, df long")

    def count(self) -> int:
        """Number of documents."""

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([opened(x).num_rows for x in batch.column(0).to_pylist()], pa.int64())], names=["n"])

        return self.rows.filter(F.col("bucket") == DOCS).select("data").mapInArrow(work, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def labels(self) -> DataFrame:
        """(doc_id, label) of the documents that have one."""

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for got in map(opened, batch.column(0).to_pylist()):
                    some = got.filter(got.column("label").is_valid())
                    yield pa.RecordBatch.from_arrays([some.column("id"), some.column("label")], names=["doc_id", "label"])

        return self.rows.filter(F.col("bucket") == DOCS).select("data").mapInArrow(work, f"doc_id {self.id_type}, label string")

    def docs(self) -> DataFrame:
        """(doc_id, tokens), as they came."""

        def work(ids: pa.Array, n: np.ndarray, codes: np.ndarray, tokens: pa.Array) -> Iterator[pa.RecordBatch]:
            ends = np.concatenate(([0], np.cumsum(n)))
            for at in range(0, len(ids), 512):
                stops = ends[at : at + 513]
                some = codes[stops[0] : stops[-1]]
                lists = pa.ListArray.from_arrays(pa.array((stops - stops[0]).astype(np.int32)), tokens.take(pa.array(some, mask=some < 0)))
                yield pa.RecordBatch.from_arrays([ids[at : at + 512], lists], names=["doc_id", "tokens"])

        return self.map_blocks(work, f"doc_id {self.id_type}, tokens array<string>")

    def map_blocks(self, work, schema: str) -> DataFrame:
        """``work(ids, n, codes, tokens)`` on each block where it lies, giving record batches; codes point at tokens, -1 is null."""

        def whole(found: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
            (_, docs), (_, codes), *rest = found
            tokens = pa.concat_arrays([pa.array([], pa.string()), *(opened(x).column("token") for _, x in rest)])
            docs = opened(docs)
            yield from work(docs.column("id"), docs.column("n").to_numpy(), opened(codes).column(0).to_numpy(), tokens)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple[int, bytes]] = []
            for batch in batches:
                for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if row[0] == DOCS and held:  # a block's rows lie together, its documents first
                        yield from whole(held)
                        held = []
                    held.append(row)
            if held:
                yield from whole(held)

        return self.rows.select("bucket", "data").mapInArrow(lean(run), schema)
