"""Substring dedup by FM-indexes.

A window is 50 consecutive words. Documents with the same words are one class; all but its
smallest id lose all their windows at once. For the rest, each window has an anchor: the smallest
hash of its 8-word grams. Equal windows have equal anchors, so anchors deal windows to shards.
Only anchors that occur in more than one class are followed up: the run of windows around each
becomes a segment, and equal segments of a shard are kept once.

A shard's segments make one compressed FM-index over words (a wavelet matrix over the
Burrows-Wheeler transform, sorted to a depth of 50 words). All segments are streamed through it
by backward search in lockstep: after the first 50 words an interval is kept at window length,
dropping the last word (the group of suffixes equal to depth 49) before each further step. The
smallest document of a window's interval decides whether the window is a repetition.

Nothing gathers what many documents share. A task combines its own anchors before it deals them
out, so an anchor's owner sees one entry of each batch; an anchor of very many classes is dealt on
by the words of each single window; and a shard gets each distinct segment of a task once, with
its smallest document. The documents that hold a segment stay beside it and are joined back with
what the shard found, piece by piece. Shards are bounded by their number, which follows the number
of words.

Words are compared by 64-bit hashes. Classes are named by 64 bits of a digest, checked against a
second digest; if two classes share a name, all are named anew with another salt.

Defined cases: a null text has no words; documents of fewer words than a window lose nothing;
rows without an id neither lose nor take words; rows of one id do not take words from each other;
an empty table gives an empty result; extra columns are dropped.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semaloom.llm import textkit
from semaloom.runtime import cut, lean

WINDOW, GRAM = 50, 8
#: Words of the corpus per shard; classes that make an anchor hot; bytes of a word in a segment.
SHARD_WORDS, HOT, WORD_BYTES = 500_000, 5_000, 8
#: Anchors held before they are dealt out; bytes of segments held; ids that are broadcast at most.
ANCHORS_AT, SEGMENTS_AT, MOST_BROADCAST = 1_000_000, 32 << 20, 1_000_000
#: Hot anchors that are broadcast at most (8 bytes each).
MOST_HOT = 1_000_000
_EMPTY = hashlib.sha256(b"").hexdigest()


def anchors(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window) of each run of windows with one anchor occurrence."""
    g = textkit.grams(hashes, GRAM)
    width = WINDOW - GRAM + 1
    if len(g) < width:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none
    at = np.empty(len(g) - width + 1, np.int64)
    for lo in range(0, len(at), 4096):
        hi = min(lo + 4096, len(at))
        at[lo:hi] = np.lib.stride_tricks.sliding_window_view(g[lo : hi + width - 1], width).argmin(1) + np.arange(lo, hi)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return g[at[first]], first, np.append(first[1:], len(at)) - 1


def class_of(hashes: np.ndarray, salt: int = 0) -> int:
    """A 64-bit name of a run of words; another one for another ``salt``."""
    if salt:
        hashes = textkit.mix(hashes ^ np.uint64(salt * 0xA24BAED4963EE407 & 0xFFFFFFFFFFFFFFFF))
    return int(np.array([textkit.sequence_hash(hashes, 11)], np.uint64).view(np.int64)[0])


def _texts(column: pa.Array) -> Iterator[tuple[np.ndarray, bytes]]:
    """(word hashes, bytes) of each text; null is empty."""
    for first, last, raw, offsets in textkit.pieces(column):
        hashes, _, _, before = textkit.words(raw, offsets)
        for d in range(last - first):
            yield hashes[before[d] : before[d + 1]], raw[offsets[d] : offsets[d + 1]].tobytes()


class WaveletMatrix:
    """Bits of the symbols level by level, packed, with counts per 64 bits."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.levels = max(1, int(top).bit_length())
        self.n = len(symbols)
        self.words: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in range(self.levels - 1, -1, -1):
            bits = ((symbols >> level) & 1).astype(bool)
            packed = np.packbits(bits, bitorder="little")
            packed = np.pad(packed, (0, -len(packed) % 8 + 8)).view(np.uint64)
            self.words.append(packed)
            self.counts.append(np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int32)[:-1])).astype(np.int32))
            self.zeros.append(int(self.n - bits.sum()))
            symbols = np.concatenate([symbols[~bits], symbols[bits]])
        self.start = self._walk(np.arange(top + 1), np.zeros(top + 1, np.int64))

    def _walk(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            block = at >> 6
            below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.counts[k][block] + np.bitwise_count(self.words[k][block] & below)
            at = np.where((symbols >> (self.levels - 1 - k)) & 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        return self._walk(symbols, at) - self.start[symbols]


class FmIndex:
    """Backward search over word texts, sorted to WINDOW words; 0 parts the texts and is never searched."""

    def __init__(self, text: np.ndarray, owners: np.ndarray):
        n, top = len(text), int(text.max(initial=0))
        shift = lambda r, k: np.concatenate([r[k:], np.zeros(min(k, n), r.dtype)])[:n]

        def ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            order = np.argsort(key, kind="stable")
            new = np.concatenate(([True], key[order][1:] != key[order][:-1]))
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new)
            return rank, order, new

        word = text.astype(np.int64)
        rank, depth = ranked(word * (top + 1) + shift(word, 1))[0], 2
        while depth * 2 < WINDOW:
            rank, depth = ranked(rank * (n + 2) + shift(rank, depth))[0], depth * 2
        rest = WINDOW - 1 - depth  # the depths overlap: equal runs of both lengths are equal runs of their union
        rank = ranked(rank * (n + 2) + shift(rank, rest))[0]
        _, order, new = ranked(rank * (top + 2) + shift(word, WINDOW - 1))
        self.group = np.cumsum(new) - 1  # of equal windows
        self.least = np.minimum.reduceat(owners[order], np.flatnonzero(new))
        shorter = rank[order]
        at = np.flatnonzero(np.concatenate(([True], shorter[1:] != shorter[:-1])))
        self.group_less = np.cumsum(np.concatenate(([True], shorter[1:] != shorter[:-1]))) - 1
        self.bounds_less = np.append(at, n)
        self.wavelet = WaveletMatrix(text[order - 1], top)  # the word before; the text is taken as a ring
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=top + 1))))

    def step(self, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        both = self.wavelet.rank(np.concatenate([symbols, symbols]), np.concatenate([lo, hi]))
        return self.before[symbols] + both[: len(lo)], self.before[symbols] + both[len(lo) :]

    def least_owners(self, text: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
        """For each text [start, start + length) the smallest owner of each of its windows."""
        out = [np.empty(k - WINDOW + 1, np.int64) for k in lengths]
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        lo, hi = np.zeros(len(order), np.int64), np.full(len(order), len(self.group), np.int64)
        for step in range(int(lengths.max(initial=0))):
            live = int(np.searchsorted(-lengths, -step, side="left"))  # lengths above step
            at = starts[:live] + lengths[:live] - 1 - step
            if step >= WINDOW:
                less = self.group_less[lo[:live]]
                lo[:live], hi[:live] = self.bounds_less[less], self.bounds_less[less + 1]
            lo[:live], hi[:live] = self.step(text[at], lo[:live], hi[:live])
            if step >= WINDOW - 1:
                least = self.least[self.group[lo[:live]]]
                for i in range(live):
                    out[order[i]][lengths[i] - 1 - step] = least[i]
        return out


def _described(docs: DataFrame, salt: int) -> DataFrame:
    """(doc_id, n_words, class, proof, sha) per document, ``proof`` a second digest of its words, and rows with anchors.

    Anchor rows have a share: ``anchors`` holds (anchor, one of its classes, classes in the batch)
    of each anchor of a batch, and ``met`` (anchor, class) of those that more than one class has there.
    """
    shares = 16 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ["doc_id", "n_words", "class", "proof", "sha", "share", "anchors", "met"]
    kind = dict(docs.dtypes)["doc_id"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, int]] = []
        size, seen, id_type = 0, set(), pa.int64()

        def deal() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            keys = np.concatenate([k for k, _ in held]).view(np.int64)
            owners = np.repeat(np.array([c for _, c in held], np.int64), [len(k) for k, _ in held])
            held.clear()
            order = np.lexsort((owners, keys))
            keys, owners = keys[order], owners[order]
            fresh = np.concatenate(([True], (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])))
            keys, owners = keys[fresh], owners[fresh]
            start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            count = np.diff(np.append(start, len(keys)))
            met = np.repeat(count, count) > 1
            lone = np.stack([keys[start], owners[start], count], 1)
            share = (textkit.mix(lone[:, 0].view(np.uint64).copy()) % np.uint64(shares)).astype(np.int32)
            order = np.argsort(share, kind="stable")
            lone, share = lone[order], share[order]
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(share)) + 1, [len(share)]))
            rows = [lone[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            both = np.stack([keys[met], owners[met]], 1)
            none = lambda n: [pa.nulls(n, t) for t in (id_type, *[pa.int64()] * 3, pa.string())]
            yield pa.RecordBatch.from_arrays([*none(len(rows)), pa.array(share[cuts[:-1]], pa.int32()), pa.array(rows, pa.binary()), pa.nulls(len(rows), pa.binary())], names=names)
            for at in range(0, len(both), 65536):
                yield pa.RecordBatch.from_arrays([*none(1), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), pa.array([both[at : at + 65536].tobytes()], pa.binary())], names=names)

        for batch in batches:
            id_type = batch.schema.field(0).type
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                counts, classes, proofs, shas = [], [], [], []
                for key, (hashes, raw) in zip(part.column(0).to_pylist(), _texts(part.column(1)), strict=True):
                    name = class_of(hashes, salt)
                    counts.append(len(hashes))
                    classes.append(name)
                    proofs.append(class_of(hashes, -1 - salt))
                    shas.append(hashlib.sha256(b" ".join(raw.split())).hexdigest())
                    if key is None or len(hashes) < WINDOW or name in seen:
                        continue
                    seen.add(name)
                    if len(seen) > 100_000:
                        seen.clear()
                    found = np.unique(anchors(hashes)[0])
                    held.append((found, name))
                    size += len(found)
                n = len(counts)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *[pa.array(c, pa.int64()) for c in (counts, classes, proofs)], pa.array(shas, pa.string()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], names=names
                )
                if size >= ANCHORS_AT:
                    yield from deal()
                    size = 0
        yield from deal()

    return cut(docs.mapInArrow(lean(work), f"doc_id {kind}, n_words long, class long, proof long, sha string, share int, anchors binary, met binary"))


def _by_class(keys: np.ndarray, owners: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(class, shared): the anchors of each class."""
    order = np.argsort(owners, kind="stable")
    keys, owners = keys[order], owners[order]
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(owners)) + 1, [len(owners)])) if len(owners) else np.zeros(1, np.int64)
    for at in range(0, len(cuts) - 1, 4096):
        spans = list(zip(cuts[at : at + 4096], cuts[at + 1 : at + 4097], strict=False))
        yield pa.RecordBatch.from_arrays([pa.array([int(owners[a]) for a, _ in spans], pa.int64()), pa.array([keys[a:b].tobytes() for a, b in spans], pa.binary())], names=["class", "shared"])


def _shared(described: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(class, shared): anchors of a class that other classes have too; (anchor, classes) of the hot ones.

    A class in several batches may count more than once, which only calls an anchor hot earlier.
    """
    hot_at = HOT

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                k, o = np.frombuffer(raw, np.int64).reshape(-1, 2).T
                yield from _by_class(k, o)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.frombuffer(raw, np.int64).reshape(-1, 3) for batch in batches for raw in batch.column(0).to_pylist()]
        if not parts:
            return
        rows = np.concatenate(parts)
        del parts
        keys, owners, counts = rows[np.lexsort((rows[:, 1], rows[:, 0]))].T
        start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        size = np.diff(np.append(start, len(keys)))
        total = np.add.reduceat(counts, start)
        # several entries of one class, each alone in its batch, are no repetition
        apart = np.maximum.reduceat(owners, start) != np.minimum.reduceat(owners, start)
        repeated = np.repeat(apart | (np.maximum.reduceat(counts, start) > 1), size)
        alone = repeated & (counts == 1)  # the others came with ``met``
        names = ["class", "shared", "anchor", "classes"]
        for batch in _by_class(keys[alone], owners[alone]):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.nulls(batch.num_rows, pa.int64()), pa.nulls(batch.num_rows, pa.int64())], names=names)
        hot = total > hot_at
        if hot.any():
            n = int(hot.sum())
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(keys[start][hot]), pa.array(total[hot])], names=names)

    here = described.filter("met is not null").select("met").mapInArrow(lean(met), "class long, shared binary")
    dealt = described.filter("anchors is not null").select("share", "anchors").repartition(F.col("share")).select("anchors")
    found = cut(dealt.mapInArrow(lean(work), "class long, shared binary, anchor long, classes long"))
    return here.unionByName(found.filter("class is not null").select("class", "shared")), found.filter("anchor is not null").select("anchor", "classes")


def _hottest(hot: DataFrame) -> np.ndarray:
    """The hot anchors, sorted; the hottest MOST_HOT of them, as being hot only says how windows are dealt."""
    got = hot.orderBy(F.desc("classes"), "anchor").limit(MOST_HOT).toArrow()
    return np.sort(got.column("anchor").to_numpy().astype(np.int64))


def _rows_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``docs`` joined with ``wanted`` by doc_id; only the documents asked for are shuffled, if they are not too many to name."""
    ids = wanted.select("doc_id").distinct()
    if ids.count() <= MOST_BROADCAST:
        docs = docs.join(F.broadcast(ids), "doc_id", "left_semi")
    return docs.join(wanted, "doc_id")


def _segments(docs: DataFrame, wanted: DataFrame, hot: np.ndarray, shards: int, salt: int) -> DataFrame:
    """(piece, shard, words, lengths, least, holders, sizes): distinct segments of a task, their smallest document, and the documents (id, class, start) that hold them.

    ``piece`` numbers the rows; each goes to one shard.
    """
    names = ["piece", "shard", "words", "lengths", "least", "holders", "sizes"]
    shared_hot = docs.sparkSession.sparkContext.broadcast(hot)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hottest = shared_hot.value
        held: dict[tuple[int, bytes], list[tuple[int, int, int]]] = {}
        size, number = 0, TaskContext.get().partitionId() << 33

        def deal() -> Iterator[pa.RecordBatch]:
            nonlocal number
            by: dict[int, list[tuple[bytes, list[tuple[int, int, int]]]]] = {}
            for (shard, words), who in held.items():
                by.setdefault(shard, []).append((words, who))
            held.clear()
            rows = list(by.items())
            for at in range(0, len(rows), 64):
                part = rows[at : at + 64]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(range(number, number + len(part)), pa.int64()),
                        pa.array([s for s, _ in part], pa.int32()),
                        pa.array([b"".join(w for w, _ in x) for _, x in part], pa.binary()),
                        pa.array([np.array([len(w) // WORD_BYTES for w, _ in x], np.int32).tobytes() for _, x in part], pa.binary()),
                        pa.array([np.array([min(h[0] for h in who) for _, who in x], np.int64).tobytes() for _, x in part], pa.binary()),
                        pa.array([np.array([h for _, who in x for h in who], np.int64).tobytes() for _, x in part], pa.binary()),
                        pa.array([np.array([len(who) for _, who in x], np.int32).tobytes() for _, x in part], pa.binary()),
                    ],
                    names=names,
                )
                number += len(part)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, names_, shared = (part.column(i).to_pylist() for i in (0, 2, 3))
                for key, name, own, (hashes, _) in zip(ids, names_, shared, _texts(part.column(1)), strict=True):
                    if class_of(hashes, salt) != name:
                        continue
                    own = np.frombuffer(b"".join(own), np.int64)
                    found, first, last = anchors(hashes)
                    found = found.view(np.int64)
                    packed = hashes.tobytes()
                    follow = np.isin(found, own)
                    often = np.isin(found, hottest)
                    for k in np.flatnonzero(follow & ~often):
                        words = packed[WORD_BYTES * int(first[k]) : WORD_BYTES * (int(last[k]) + WINDOW)]
                        held.setdefault((int(found[k]) % shards, words), []).append((key, name, int(first[k])))
                        size += len(words) + 24
                    if (follow & often).any():
                        windows = textkit.grams(hashes, WINDOW)
                        for k in np.flatnonzero(follow & often):
                            for w in range(int(first[k]), int(last[k]) + 1):
                                words = packed[WORD_BYTES * w : WORD_BYTES * (w + WINDOW)]
                                held.setdefault((int(windows[w]) % shards, words), []).append((key, name, w))
                                size += len(words) + 24
                if size >= SEGMENTS_AT:
                    yield from deal()
                    size = 0
        yield from deal()

    rows = _rows_of(docs, wanted).select("doc_id", "text", "class", "shared")
    return rows.mapInArrow(lean(work), "piece long, shard int, words binary, lengths binary, least binary, holders binary, sizes binary")


def least_of(shard: pa.Table) -> pa.Table:
    """For the segments of one shard the smallest document of each of their windows: (piece, runs).

    ``runs`` holds (segment of the piece, first window, windows, smallest document) of runs of windows
    that have one smallest document.
    """
    words = np.frombuffer(b"".join(shard.column("words").to_pylist()), np.uint64)
    counts = [len(x) // 4 for x in shard.column("lengths").to_pylist()]
    lengths = np.frombuffer(b"".join(shard.column("lengths").to_pylist()), np.int32).astype(np.int64)
    smallest = np.frombuffer(b"".join(shard.column("least").to_pylist()), np.int64)
    # equal segments of different tasks become one
    ends = np.cumsum(lengths)
    raw = words.tobytes()
    known: dict[bytes, int] = {}
    number = np.array([known.setdefault(raw[8 * (e - n) : 8 * e], len(known)) for e, n in zip(ends, lengths, strict=True)], np.int64)
    owner = np.full(len(known), np.iinfo(np.int64).max)
    np.minimum.at(owner, number, smallest)
    size = np.array([len(k) // 8 for k in known], np.int64)
    values, symbols = np.unique(np.frombuffer(b"".join(known), np.uint64), return_inverse=True)
    text = np.zeros(int(size.sum()) + len(size), np.int32)
    starts = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
    text[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = symbols + 1
    index = FmIndex(text, np.repeat(owner, size + 1))
    least = index.least_owners(text, starts, size)
    runs = []
    for found in least:
        begin = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1])))
        runs.append(np.stack([begin, np.diff(np.append(begin, len(found))), found[begin]], 1))
    out, at = [], 0
    for n in counts:
        rows = [np.concatenate([np.full((len(runs[s]), 1), i, np.int64), runs[s]], 1) for i, s in enumerate(number[at : at + n].tolist())]
        out.append(np.concatenate(rows).tobytes() if rows else b"")
        at += n
    return pa.table({"piece": shard.column("piece"), "runs": pa.array(out, pa.binary())})


def ranges_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, class, ranges) of repeated words, from (holders, sizes, runs) of pieces."""
    for batch in batches:
        out: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for holders, sizes, runs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            holders, sizes, runs = np.frombuffer(holders, np.int64).reshape(-1, 3), np.frombuffer(sizes, np.int32), np.frombuffer(runs, np.int64).reshape(-1, 4)
            segment = np.repeat(np.arange(len(sizes)), sizes)
            low, high = np.searchsorted(runs[:, 0], segment), np.searchsorted(runs[:, 0], segment, side="right")
            for (key, name, start), a, b in zip(holders.tolist(), low.tolist(), high.tolist(), strict=True):
                last = None
                for _, first, count, least in runs[a:b].tolist():
                    if least >= key:
                        continue
                    begin, end = start + first, start + first + count - 1 + WINDOW
                    if last is not None and begin <= last[1]:
                        last = out[key, name][-1] = (last[0], end)
                    else:
                        last = (begin, end)
                        out.setdefault((key, name), []).append(last)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in out], pa.int64()), pa.array([c for _, c in out], pa.int64()), pa.array([np.array(r, np.int32).tobytes() for r in out.values()], pa.binary())],
            names=["doc_id", "class", "ranges"],
        )


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept]) per document; kept is null where nothing was removed."""
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    for salt in itertools.count():
        described = _described(docs, salt)
        feats = described.filter("sha is not null").select("doc_id", "n_words", "class", "sha")
        # kept, so that the join below has plain shuffles on both sides and a class of very many copies can be split
        whole = described.filter(f"sha is not null and doc_id is not null and n_words >= {WINDOW}").groupBy("class")
        classes = cut(whole.agg(F.min("doc_id").alias("doc_id"), F.min("proof").alias("proof"), F.max("proof").alias("other")), small=True)
        if classes.filter("proof <> other").isEmpty():  # else two classes have one name
            break
    classes = classes.select("class", "doc_id")
    total = feats.agg(F.sum("n_words")).first()[0] or 0
    shards = int(max(8, total // SHARD_WORDS))
    shared, hot = _shared(described)
    wanted = cut(shared.groupBy("class").agg(F.collect_list("shared").alias("shared")).join(classes, "class"))
    known = docs.filter("doc_id is not null")
    pieces = cut(_segments(known, wanted, _hottest(hot), shards, salt))
    dealt = pieces.select("piece", "shard", "words", "lengths", "least")
    judged_pieces = cut(dealt.groupBy("shard").applyInArrow(least_of, "piece long, runs binary"))
    held = pieces.select("piece", "holders", "sizes").join(judged_pieces, "piece").select("holders", "sizes", "runs")
    ranges = cut(held.mapInArrow(lean(ranges_of), "doc_id long, class long, ranges binary"))
    found = ranges.groupBy("doc_id", "class").agg(F.collect_list("ranges").alias("ranges"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out: list[tuple[int, int, int, str, str | None]] = []
                for key, name, spans, (hashes, raw) in zip(*(part.column(i).to_pylist() for i in (0, 2, 3)), _texts(part.column(1)), strict=True):
                    if class_of(hashes, salt) != name:
                        continue
                    gone = np.zeros(len(hashes) + 1, np.int64)
                    pairs = np.frombuffer(b"".join(spans), np.int32).reshape(-1, 2)
                    np.add.at(gone, pairs[:, 0], 1)
                    np.add.at(gone, pairs[:, 1], -1)
                    stays = np.cumsum(gone)[:-1] == 0
                    kept = b" ".join(w for w, s in zip(raw.split(), stays.tolist(), strict=True) if s)
                    out.append((key, name, int((~stays).sum()), hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None))
                columns = list(zip(*out, strict=True)) or [()] * 5
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "class", "removed", "after", "kept"])

    judged = _rows_of(known, found).select("doc_id", "text", "class", "ranges").mapInArrow(lean(keep), "doc_id long, class long, removed long, after string, kept string")
    judged = cut(judged.dropDuplicates(["doc_id", "class"]))
    copy = F.col("doc_id") > F.col("least")
    rows = feats.join(classes.select("class", F.col("doc_id").alias("least")), "class", "left").join(judged, ["doc_id", "class"], "left")
    columns = [
        F.col("doc_id"),
        F.col("n_words"),
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(_EMPTY)).otherwise(F.coalesce("after", "sha")).alias("kept_sha256"),
        F.when(copy, F.lit("")).otherwise(F.col("kept")).alias("kept"),
    ]
    return rows.select(*columns[: None if with_text else 4])


def op4_fm_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP4_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), pos AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM d
), windows AS MATERIALIZED (
  SELECT doc_id, i, md5(array_to_string(w[i + 1 : i + 50], ' ')) AS name FROM (SELECT doc_id, w, unnest(range(len(w) - 49)) AS i FROM d WHERE len(w) >= 50)
), again AS (
  SELECT doc_id, i FROM windows JOIN (SELECT name, min(doc_id) AS least FROM windows GROUP BY name) USING (name) WHERE least < doc_id
), judged AS (
  SELECT pos.doc_id, pos.i, word, max((again.i IS NOT NULL)::INT) OVER (PARTITION BY pos.doc_id ORDER BY pos.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone
  FROM pos LEFT JOIN again ON again.doc_id = pos.doc_id AND again.i = pos.i
), summed AS (
  SELECT doc_id, sum(gone)::BIGINT AS n, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM judged GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN summed USING (doc_id)
"""
