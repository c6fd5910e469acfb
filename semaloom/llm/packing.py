"""Best-fit packing of tokenized documents into fixed-length sequences.

Every partition tokenizes and packs its own documents, so nothing is shuffled and a lost task is
repeated with the same result. Packing is bounded-space online best fit: a fixed number of open
sequences, found by a bitset keyed by free space; a piece goes where the least space is left,
and when all places are taken the fullest sequence closes. Pieces arrive in buffers of bounded
size, long ones first, which leaves the small pieces to fill the gaps; what a partition wastes
is about one sequence.

Defined cases: a null text is an empty one, which has the end id only; documents of more than
``length`` ids are cut, the first piece taking the remainder; repeated rows are packed once per
row; an empty table gives an empty result; extra columns are dropped.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semaloom.runtime import lean

#: Open sequences of a partition, and the pieces and bytes of a buffer.
OPEN, PIECES, BYTES = 4096, 8192, 24 << 20
_ENCODERS: dict[str, Callable[[str], np.ndarray]] = {}


def encoder(vocabulary: str) -> Callable[[str], np.ndarray]:
    """Ids of a text by a byte-level BPE vocabulary of the public tokenizers.

    The vocabulary's rank file gives the same ids as its JSON file at a quarter of the time. Only
    where a text holds the string of a special token does the JSON file's tokenizer take over,
    because the rank file has no special tokens.
    """
    if vocabulary not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        lines = open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb").read().split(b"\n")
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}
        fast = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

        def encode(text: str) -> np.ndarray:
            if "<|" in text:
                return np.asarray(_exact(vocabulary).encode(text, add_special_tokens=False).ids, dtype="<u4")
            return fast.encode_to_numpy(text).astype("<u4", copy=False)

        _ENCODERS[vocabulary] = encode
    return _ENCODERS[vocabulary]


_EXACT: dict[str, object] = {}


def _exact(vocabulary: str):
    if vocabulary not in _EXACT:
        import public_tokenizers
        from tokenizers import Tokenizer

        _EXACT[vocabulary] = Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
    return _EXACT[vocabulary]


class BestFit:
    """Bounded-space online best fit; ``place`` gives (sequence number, offset)."""

    def __init__(self, length: int, most: int):
        self.length, self.most = length, most
        self.bits, self.count, self.opened = 0, 0, 0
        self.open: dict[int, list[int]] = {}  # free space -> sequences

    def _take(self, free: int) -> int:
        at = self.open[free]
        number = at.pop()
        if not at:
            del self.open[free]
            self.bits &= ~(1 << free)
        self.count -= 1
        return number

    def place(self, size: int) -> tuple[int, int]:
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            if self.count == self.most:  # the fullest closes
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, number = self.length, self.opened
            self.opened += 1
        if rest := free - size:
            self.open.setdefault(rest, []).append(number)
            self.bits |= 1 << rest
            self.count += 1
        return number, self.length - free


def cut_points(n: int, length: int) -> list[tuple[int, int]]:
    """(start, size) of the pieces of a document of n ids; only the first may be shorter."""
    first = n - (n - 1) // length * length
    return [(0, first), *((at, length) for at in range(first, n, length))]


def pack(docs: DataFrame, length: int = 2048, vocabulary: str = "byte_bpe_50k", end: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, ids, sequence_id, offset); ids are little-endian unsigned 32-bit."""
    names = ["doc_id", "piece", "start", "ids", "sequence_id", "offset"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, bins = encoder(vocabulary), BestFit(length, OPEN)
        base = TaskContext.get().partitionId() << 40
        tail = np.array([end], dtype="<u4")
        buffer: list[tuple[int, object, int, int, bytes]] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            buffer.sort(key=lambda x: -x[0])
            for at in range(0, len(buffer), 1024):
                part = buffer[at : at + 1024]
                spots = [bins.place(x[0]) for x in part]
                columns = [[x[1] for x in part], [x[2] for x in part], [x[3] for x in part], [x[4] for x in part], [base + s for s, _ in spots], [o for _, o in spots]]
                kinds = [kind, pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
            buffer.clear()

        for batch in batches:
            kind = batch.schema.field(0).type
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                for doc, body in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = np.concatenate([encode(body), tail]) if body else tail
                    raw = ids.tobytes()
                    for number, (start, size) in enumerate(cut_points(len(ids), length)):
                        buffer.append((size, doc, number, start, raw[4 * start : 4 * (start + size)]))
                    held += len(raw)
                    if len(buffer) >= PIECES or held >= BYTES:
                        yield from flush()
                        held = 0
        if buffer:
            yield from flush()

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(lean(work), f"doc_id {dict(rows.dtypes)['doc_id']}, piece int, start long, ids binary, sequence_id long, offset long")


def placed(packed: DataFrame) -> DataFrame:
    """The rows of :func:`pack` with length and CRC-32 in place of the ids."""
    size = (F.octet_length("ids") / 4).cast("long")
    return packed.select("doc_id", "piece", "start", size.alias("length"), F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op5_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(pack(spark.read.parquet(f"{sf_dir}/documents.parquet")))
