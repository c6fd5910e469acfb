"""N-gram Jaccard join by parity sketches.

A document is the set of its word n-grams, each a 64-bit hash. Documents with equal sets are one
class. Sets are joined per size band; bands are 8 wide, and a set near the lower edge of its band
also joins in the band below, so that partners meet in the band of the smaller one.

In a band the hash space is cut into parts. A part's sketch is the XOR of the bit patterns of the
n-grams that fall into it. An n-gram that only one of two sets has changes one part, so sets that
differ in at most k n-grams agree in all but k parts (pigeonhole): of a set's non-empty parts,
ordered alike everywhere, the first k + 1 are its join keys, and two linked sets share one. Rare
parts come first, so that passages which many documents share are seldom keys.

Documents with a common key form a run. All of a run are compared with its first member, which
joins most groups. What is left are runs with members of different components: there members
outside a run's largest component are compared with all of it, in blocks of bounded size; first
the most similar partners of each, then all that the sketches allow to be linked. So no run is
expanded into all its pairs, and no link between different components is lost. Candidates pass a
second parity sketch, whose Hamming distance is a lower bound of the symmetric difference, and
then an exact comparison of the sets.

A key that very many sets share is known by its n-grams' counts; its run is dealt out in pieces
that meet again by the key, so no task gathers it. Sets are named by 64 bits of a digest, checked
against a second digest; if two sets share a name, all are named anew with another salt.

Defined cases: null and empty texts have no n-grams and link with nothing; a text of fewer words
than n is one n-gram; rows without an id link with nothing and have no component; rows of one id
are judged by their texts; an empty table gives an empty result; extra columns are dropped.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semaloom.llm import textkit
from semaloom.llm.components import components
from semaloom.runtime import cut, lean

#: The linking rule is DEN * intersection >= NUM * union.
NUM, DEN = 75, 100
#: N-grams held for counting at a time; a count that makes one common there; common ones kept in all.
COUNT_AT, COMMON, MOST_COMMON = 2_000_000, 3, 200_000
#: Keys held before they are dealt out; shares of the key space per shuffle partition.
KEYS_AT, SHARES = 500_000, 16
#: Keys that one task gathers: the more, the more runs of a pair it sees and gives only once.
GATHERED = 1_500_000
#: Ids that are broadcast, at most (8 bytes each); more are joined by a shuffle.
MOST_BROADCAST = 1_000_000
#: Rounds in which a member is compared with its TRIES most similar partners of a block; then all that are left are compared.
ROUNDS, TRIES = 1, 2
#: Members of each side of a block.
BLOCK = 128
#: Sets that share a key at most before its run is dealt out in pieces.
HEAVY = 100_000
#: Parts that the members of a component are dealt to when they get its smallest document.
SALTS = 16

_EDGES = [8**i for i in range(15)]
#: Size classes grow by this factor, up to 255; linked sets are at most so many classes apart.
_CLASS, _CLASSES_APART = 1.08, 4
_EDGES_ARRAY = np.array(_EDGES)


def most_apart(total: np.ndarray | int) -> np.ndarray | int:
    """Largest symmetric difference of two linked sets with sizes that add up to ``total``."""
    return total - 2 * -(-NUM * total // (NUM + DEN))


def _limit(total: int) -> int:
    """The same for any smaller total."""
    return max(0, *(int(most_apart(t)) for t in range(max(2, total - 8), total + 1))) if total >= 2 else 0


def _parts(band: int) -> int:
    top = _EDGES[band + 1]
    return top // 2 if top > 256 else 4 * top


def gram_sets(column: pa.Array, n: int, lower: bool = True) -> Iterator[np.ndarray]:
    """Sorted distinct n-gram hashes of each text."""
    for first, last, raw, offsets in textkit.pieces(column):
        hashes, _, _, before = textkit.words(raw, offsets, lower)
        every = textkit.grams(hashes, n)
        for d in range(last - first):
            a, b = int(before[d]), int(before[d + 1])
            if b - a >= n:
                yield np.unique(every[a : b - n + 1])
            elif b > a:
                yield np.array([textkit.sequence_hash(hashes[a:b], salt=b - a)], np.uint64)
            else:
                yield np.zeros(0, np.uint64)


def digest(grams: np.ndarray, salt: int = 0) -> int:
    """A 64-bit name of a set; another one for another ``salt``."""
    total = int(textkit.mix(grams ^ np.uint64(salt * 0xA24BAED4963EE407 & 0xFFFFFFFFFFFFFFFF)).sum(dtype=np.uint64)) if len(grams) else 0
    return int(textkit.mix(np.array([(total ^ (len(grams) * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF], np.uint64)).view(np.int64)[0])


def parity(grams: np.ndarray) -> bytes:
    """A parity bit sketch of 64 to 65,536 bits, at least two per n-gram; larger ones fold onto smaller ones."""
    bits = min(1 << 16, max(64, 1 << int(2 * len(grams) - 1).bit_length()))
    at = (textkit.mix(grams ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def hamming(a: bytes, b: bytes) -> int:
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) > len(y):
        x = np.bitwise_xor.reduce(x.reshape(-1, len(y)), 0)
    elif len(y) > len(x):
        y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), 0)
    return int(np.bitwise_count(x ^ y).sum())


def join_keys(grams: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a set in its own band and, as the larger partner, in the band below, and how many sets may share each.

    ``common``: how common each n-gram is. All sets that share a key hold its n-grams, so the rarest of them bounds the run.
    """
    n = len(grams)
    band = int(np.searchsorted(_EDGES_ARRAY, n, side="right")) - 1
    out, bounds = [], []
    for tag in (band, band - 1):
        if tag < 0:
            continue
        partner = n * DEN // NUM if tag == band else _EDGES[band] - 1  # the largest that meets it here
        if tag < band and DEN * partner < NUM * n:
            continue  # nothing in the band below is large enough
        k = _limit(n + partner)
        m = _parts(tag)
        part = ((grams >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)  # ascending, as the n-grams are
        starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        sketch = np.bitwise_xor.reduceat(textkit.mix(grams ^ np.uint64(tag + 1)), starts)
        keys = textkit.mix(sketch ^ ((part[starts] + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)) ^ np.uint64(tag << 56))
        if len(keys) <= k:  # too few parts for the argument: then all of them, and one key for all such sets
            out += [keys, np.array([0xABCDEF + tag], np.uint64)]
            bounds += [np.minimum.reduceat(common, starts), np.zeros(1, np.int64)]
            continue
        rare = np.minimum.reduceat(common, starts)
        if rare.any():
            first = np.lexsort((keys, rare))[: k + 1]
            out.append(keys[first])
            bounds.append(rare[first])
        else:
            out.append(np.partition(keys, k)[: k + 1])
            bounds.append(np.zeros(k + 1, np.int64))
    return np.concatenate(out), np.concatenate(bounds)


def _described(docs: DataFrame, n: int, salt: int = 0) -> DataFrame:
    """One pass: (doc_id, n, set, proof, sketch) per document, ``proof`` a second digest of the set, and rows without a sketch that hold common n-grams and their counts."""
    kind = dict(docs.dtypes)["doc_id"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "set", "proof", "sketch", "common"]
        held: list[np.ndarray] = []
        size, id_type = 0, pa.int64()

        def count() -> Iterator[pa.RecordBatch]:
            if held:
                every = np.concatenate(held)
                held.clear()
                every.sort()
                # an n-gram that is met COMMON times is equal to the one COMMON - 1 places on
                first = np.flatnonzero(every[: 1 - COMMON] == every[COMMON - 1 :])
                values = np.unique(every[first])
                counts = (np.searchsorted(every, values, side="right") - np.searchsorted(every, values)).astype(np.uint64)
                packed = np.concatenate([values, counts]).tobytes()
                yield pa.RecordBatch.from_arrays([pa.nulls(1, id_type), *[pa.nulls(1, pa.int64())] * 3, pa.nulls(1, pa.binary()), pa.array([packed], pa.binary())], names=names)

        for batch in batches:
            id_type = batch.schema.field(0).type
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sizes, sets, proofs, sketches = [], [], [], []
                for grams in gram_sets(part.column(1), n):
                    sizes.append(len(grams))
                    sets.append(digest(grams, salt))
                    proofs.append(digest(grams, -1 - salt))
                    sketches.append(parity(grams) if len(grams) else b"")
                    held.append(grams)
                    size += len(grams)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(sets, pa.int64()), pa.array(proofs, pa.int64()), pa.array(sketches, pa.binary()), pa.nulls(len(sizes), pa.binary())], names=names)
                if size >= COUNT_AT:
                    yield from count()
                    size = 0
        yield from count()

    return cut(docs.mapInArrow(lean(work), f"doc_id {kind}, n long, set long, proof long, sketch binary, common binary"))


def _common(described: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most common n-grams, sorted, and their counts: a bounded list that only orders the keys."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                values, counts = np.frombuffer(raw, np.int64).reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(counts)], names=["gram", "count"])

    rows = described.filter("common is not null").select("common").mapInArrow(lean(unpack), "gram long, count long").groupBy("gram").agg(F.sum("count").alias("count"))
    top = cut(rows, small=True)
    if (size := top.count()) > MOST_COMMON:  # a threshold that about so many pass, then those
        least = top.approxQuantile("count", [1 - MOST_COMMON / size], 0.001)[0]
        top = top.filter(F.col("count") >= least).orderBy(F.desc("count"), "gram").limit(MOST_COMMON)
    got = top.toArrow()
    values, counts = got.column("gram").to_numpy().astype(np.int64).view(np.uint64), got.column("count").to_numpy().astype(np.int64)
    order = np.argsort(values)
    return values[order], counts[order]


def _runs(docs: DataFrame, n: int, common: tuple[np.ndarray, np.ndarray], tasks: int, salt: int = 0) -> DataFrame:
    """(first, members, close) of every run: the sets that share a key, equal member lists once per task of ``tasks``.

    The first ``close`` members are near enough in size to be linked with the run's first one. A run
    that may have more than HEAVY sets comes in pieces, each a row of its own with the run's first.
    """
    spark = docs.sparkSession
    shares, heavy_at = SHARES * tasks, HEAVY
    shared = spark.sparkContext.broadcast(common)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, counts = shared.value
        held: list[tuple[np.ndarray, int, int]] = []
        pieces: dict[tuple[int, int], list[tuple[int, int]]] = {}
        size, seen = 0, set()

        def rows_of(share: np.ndarray, keys: np.ndarray, sets: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
            order = np.argsort(share, kind="stable")
            share, low, sets, kinds = share[order], (keys[order] & np.uint64(0xFFFFFFFF)).astype(np.uint32), sets[order], kinds[order]
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(share)) + 1, [len(share)]))
            return share[cuts[:-1]], [low[a:b].tobytes() + sets[a:b].tobytes() + kinds[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

        def deal() -> Iterator[pa.RecordBatch]:
            names = ["share", "heavy", "keys"]
            if held:
                keys = np.concatenate([k for k, _, _ in held])
                counts = [len(k) for k, _, _ in held]
                sets = np.repeat(np.array([s for _, s, _ in held], np.int64), counts)
                kinds = np.repeat(np.array([c for _, _, c in held], np.uint8), counts)
                share, rows = rows_of(((keys >> np.uint64(40)) % np.uint64(shares)).astype(np.int32), keys, sets, kinds)
                held.clear()
                for at in range(0, len(rows), 256):
                    part = rows[at : at + 256]
                    yield pa.RecordBatch.from_arrays([pa.array(share[at : at + 256], pa.int32()), pa.nulls(len(part), pa.int64()), pa.array(part, pa.binary())], names=names)
            if pieces:
                found = []
                for (key, piece), who in pieces.items():
                    own = textkit.mix(np.array([key ^ (piece * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)], np.uint64))
                    low = np.repeat((own & np.uint64(0xFFFFFFFF)).astype(np.uint32), len(who))
                    raw = low.tobytes() + np.array([s for s, _ in who], np.int64).tobytes() + np.array([c for _, c in who], np.uint8).tobytes()
                    found.append((int((own[0] >> np.uint64(40)) % np.uint64(shares)), int(np.uint64(key).view(np.int64)), raw))
                pieces.clear()
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), (pa.int32(), pa.int64(), pa.binary()), strict=True)], names=names)

        for batch in batches:
            for grams in gram_sets(batch.column(0), n):
                if not len(grams):
                    continue
                name = digest(grams, salt)
                if name in seen:
                    continue
                seen.add(name)
                if len(seen) > 100_000:
                    seen.clear()
                often = np.zeros(len(grams), np.int64)
                if len(values):
                    at = np.minimum(np.searchsorted(values, grams), len(values) - 1)
                    often = np.where(values[at] == grams, counts[at], 0)
                keys, most = join_keys(grams, often)
                kind = min(255, int(math.log(len(grams)) / math.log(_CLASS)))
                size += len(keys)
                if (much := most > heavy_at).any():
                    for key, count in set(zip(keys[much].tolist(), most[much].tolist(), strict=True)):
                        pieces.setdefault((key, name % -(-count // heavy_at)), []).append((name, kind))
                    keys = keys[~much]
                held.append((keys, name, kind))
                if size >= KEYS_AT:
                    yield from deal()
                    size = 0
        yield from deal()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sets, kinds = [], [], []
        pieces: dict[tuple[int, int], list[np.ndarray]] = {}
        for batch in batches:
            for share, heavy, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                count = len(raw) // 13
                if heavy is not None:
                    pieces.setdefault((heavy, int(np.frombuffer(raw, np.uint32, 1)[0])), []).append(np.frombuffer(raw, np.int64, count, 4 * count))
                    continue
                keys.append(np.frombuffer(raw, np.uint32, count).astype(np.uint64) | np.uint64(share << 32))
                sets.append(np.frombuffer(raw, np.int64, count, 4 * count))
                kinds.append(np.frombuffer(raw, np.uint8, count, 12 * count))
        names = ["first", "members", "close", "heavy"]
        for (heavy, _), parts in pieces.items():
            members = np.unique(np.concatenate(parts))
            yield pa.RecordBatch.from_arrays([pa.array(members[:1]), pa.array([members[1:]], pa.list_(pa.int64())), pa.array([len(members) - 1], pa.int32()), pa.array([heavy], pa.int64())], names=names)
        if not keys:
            return
        keys = np.concatenate(keys)
        sets = np.concatenate(sets)
        kinds = np.concatenate(kinds).astype(np.int16)
        order = np.lexsort((kinds, keys))
        keys = keys[order]
        sets = sets[order]
        kinds = kinds[order]
        del order
        # sizes that no chain of partners bridges part a run
        inner = np.concatenate(([False], (keys[1:] == keys[:-1]) & (kinds[1:] - kinds[:-1] <= _CLASSES_APART)))
        start = np.flatnonzero(~inner)
        ends = np.append(start[1:], len(keys))
        lists: dict[bytes, int] = {}
        for a, b in zip(start[ends - start > 1], ends[ends - start > 1], strict=True):
            members, at = np.unique(sets[a:b], return_index=True)
            if len(members) > 1:
                size = kinds[a:b][at].astype(np.int64)
                far = np.abs(size - size[0]) > _CLASSES_APART
                lists[members[np.argsort(far, kind="stable")].tobytes()] = len(members) - int(far.sum()) - 1
        rows = list(lists.items())
        for at in range(0, len(rows), 1024):
            part = [(np.frombuffer(r, np.int64), close) for r, close in rows[at : at + 1024]]
            columns = [pa.array([int(p[0]) for p, _ in part], pa.int64()), pa.array([p[1:] for p, _ in part], pa.list_(pa.int64())), pa.array([c for _, c in part], pa.int32()), pa.nulls(len(part), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    dealt = docs.select("text").mapInArrow(lean(emit), "share int, heavy long, keys binary").repartition(tasks, F.col("share"))
    found = cut(dealt.mapInArrow(lean(gather), "first long, members array<long>, close int, heavy long"))
    pieces = found.filter("heavy is not null")
    if pieces.isEmpty():
        return found.select("first", "members", "close")
    tops = pieces.groupBy("heavy").agg(F.min("first").alias("top"))
    others = F.filter(F.concat(F.array("first"), "members"), lambda m: m != F.col("top"))
    whole = pieces.join(tops, "heavy").select(F.col("top").alias("first"), others.alias("members")).withColumn("close", F.size("members"))
    return found.filter("heavy is null").select("first", "members", "close").unionByName(whole)


class _Verifier:
    """Compares pairs (a, b) of sets; keeps what it knows of the classes, and the sets that it has read."""

    def __init__(self, docs: DataFrame, classes: DataFrame, n: int, salt: int):
        self.docs, self.classes, self.n, self.salt = docs, classes, n, salt
        self.read: DataFrame | None = None

    def near(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose sizes and parity sketches allow a link."""

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a, b, na, nb, sa, sb = (c.to_pylist() for c in batch.columns)
                keep = [DEN * min(x, y) >= NUM * max(x, y) and hamming(s, t) <= most_apart(x + y) for x, y, s, t in zip(na, nb, sa, sb, strict=True)]
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

        one = self.classes.select(F.col("set").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
        two = self.classes.select(F.col("set").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
        return cut(pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(lean(work), "a long, b long"), small=True)

    def _sets(self, asked: DataFrame) -> DataFrame:
        """(set, grams) of the sets ``asked`` for; texts are read for those that were not read before."""
        n, salt = self.n, self.salt
        known = self.read
        fresh = asked if known is None else asked.join(known.select("set"), "set", "left_anti")
        wanted = cut(fresh.join(self.classes.select("set", "doc_id"), "set").select("set", "doc_id"), small=True)
        if count := wanted.count():
            held = F.broadcast(wanted) if count <= MOST_BROADCAST else wanted
            texts = self.docs.join(held, "doc_id", "left_semi").select("text")

            def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for at in range(0, batch.num_rows, 512):
                        found = list(gram_sets(batch.column(0).slice(at, 512), n))
                        yield pa.RecordBatch.from_arrays([pa.array([digest(g, salt) for g in found], pa.int64()), pa.array([g.tobytes() for g in found], pa.binary())], names=["set", "grams"])

            part = cut(texts.mapInArrow(lean(sets), "set long, grams binary").join(held, "set", "left_semi"))
            if not part.groupBy("set").count().filter("count > 1").isEmpty():  # rows of one id
                part = cut(part.dropDuplicates(["set"]))
            self.read = part if known is None else known.unionByName(part)
        if known is None:
            return self.read
        return self.read.join(F.broadcast(asked) if asked.count() <= MOST_BROADCAST else asked, "set", "left_semi")

    def linked(self, pairs: DataFrame) -> DataFrame:
        """The pairs (from :meth:`near`) that the linking rule accepts."""
        if pairs.isEmpty():
            return pairs
        whole = self._sets(pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct())

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    both = np.concatenate([x, y])
                    both.sort()
                    common = int((both[1:] == both[:-1]).sum())
                    keep.append(DEN * common >= NUM * (len(both) - common))
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

        one, two = whole.select(F.col("set").alias("a"), F.col("grams").alias("ga")), whole.select(F.col("set").alias("b"), F.col("grams").alias("gb"))
        return cut(pairs.join(one, "a").join(two, "b").select("a", "b", "ga", "gb").mapInArrow(lean(work), "a long, b long"), small=True)


def _across(met: DataFrame, joined: DataFrame, classes: DataFrame, tries: int | None) -> DataFrame | None:
    """(a, b): pairs of sets that share a first member, in different components, whose sketches allow a link; None if there are no such runs.

    The members of a first one outside its largest component are compared with all its members, in
    blocks of about BLOCK by BLOCK. A block gives each one's ``tries`` most similar partners, or all.
    """
    named = met.join(joined.select(F.col("id").alias("b"), "component"), "b", "left").select(F.col("a").alias("first"), "b", F.coalesce("component", "b").alias("label"))
    counts = named.groupBy("first", "label").agg(F.count("*").alias("count")).groupBy("first")
    counts = counts.agg(F.max(F.struct("count", "label")).alias("_main"), F.sum("count").alias("size"), F.count("*").alias("labels")).filter("labels > 1")
    mixed = cut(counts.select("first", F.col("_main.label").alias("main"), F.ceil((F.col("size") - F.col("_main.count")) / BLOCK).alias("few"), F.ceil(F.col("size") / BLOCK).alias("many")), small=True)
    if mixed.isEmpty():
        return None
    info = named.join(mixed, "first").join(classes.select(F.col("set").alias("b"), "n", "sketch"), "b")
    columns = [F.col(c).alias(c) for c in ("first", "x", "y", "b", "label", "main", "n", "sketch")]  # new names for the planner: both sides come from one table
    left = info.filter("label <> main").withColumn("x", F.pmod(F.xxhash64("b"), F.col("few"))).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("many") - 1))).select(*columns)
    right = info.withColumn("y", F.pmod(F.xxhash64("b", F.lit(1)), F.col("many"))).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("few") - 1))).select(*columns)

    def work(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        ends = np.zeros((2, 0), np.int64)
        if left.num_rows and right.num_rows:
            ids, label, n = (np.concatenate([t.column(c).to_numpy() for t in (left, right)]) for c in ("b", "label", "n"))
            sketches = _Sketches(left.column("sketch").to_pylist() + right.column("sketch").to_pylist())
            x, y = np.arange(left.num_rows)[:, None], left.num_rows + np.arange(right.num_rows)[None, :]
            # two members outside the largest component meet twice
            fits = (label[x] != label[y]) & (DEN * np.minimum(n[x], n[y]) >= NUM * np.maximum(n[x], n[y])) & ((label[y] == left.column("main")[0].as_py()) | (ids[x] < ids[y]))
            i, j = np.nonzero(fits)
            j = j + left.num_rows
            apart, most = sketches.apart(i, j), most_apart(n[i] + n[j])
            near = apart <= most
            i, j, share = i[near], j[near], apart[near] / np.maximum(most[near], 1)
            if tries is not None and len(i):
                order = np.lexsort((ids[j], share, i))
                i, j = i[order], j[order]
                begin = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1])))
                best = np.arange(len(i)) - np.repeat(begin, np.diff(np.append(begin, len(i)))) < tries
                i, j = i[best], j[best]
            ends = np.stack([np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])])
        return pa.table({"a": pa.array(ends[0], pa.int64()), "b": pa.array(ends[1], pa.int64())})

    keys = ("first", "x", "y")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(work, "a long, b long").distinct()


class _Sketches:
    """Hamming distances of many pairs of parity sketches."""

    def __init__(self, raw: list[bytes]):
        self.sizes = np.array([len(r) for r in raw])
        self.at = np.zeros(len(raw), np.int64)
        self.rows: dict[int, np.ndarray] = {}
        for size in np.unique(self.sizes):
            here = np.flatnonzero(self.sizes == size)
            self.at[here] = np.arange(len(here))
            self.rows[int(size)] = np.frombuffer(b"".join(raw[i] for i in here), np.uint64).reshape(len(here), -1)

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        kind = self.sizes[i] * (1 << 20) + self.sizes[j]
        for value in np.unique(kind):
            here = np.flatnonzero(kind == value)
            a, b = int(value) >> 20, int(value) & ((1 << 20) - 1)
            step = max(1, (8 << 20) // max(a, b))
            for lo in range(0, len(here), step):
                part = here[lo : lo + step]
                x, y = self.rows[a][self.at[i[part]]], self.rows[b][self.at[j[part]]]
                width = min(x.shape[1], y.shape[1])
                x, y = (np.bitwise_xor.reduce(v.reshape(len(v), -1, width), 1) for v in (x, y))
                out[part] = np.bitwise_count(x ^ y).sum(1)
        return out


def _apart(pairs: DataFrame, joined: DataFrame | None) -> DataFrame:
    """The pairs whose ends are not in one component yet."""
    if joined is None:
        return pairs
    one, two = joined.select(F.col("id").alias("a"), F.col("component").alias("ca")), joined.select(F.col("id").alias("b"), F.col("component").alias("cb"))
    return pairs.join(one, "a", "left").join(two, "b", "left").filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def _by_row(docs: DataFrame, key: str, text: str, n: int) -> tuple[DataFrame, int]:
    """(doc_id, n_shingles, set, component, component_id) per document, and the salt of the sets' names; no set and component without n-grams."""
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    for salt in itertools.count():
        described = _described(docs, n, salt)
        feats = described.filter("sketch is not null")
        found = feats.filter("n > 0 and doc_id is not null").groupBy("set")
        classes = cut(found.agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.min("proof").alias("proof"), F.max("proof").alias("other")), small=True)
        if classes.filter("proof <> other").isEmpty():  # else two sets have one name
            break
    classes = classes.drop("proof", "other")
    known = docs.filter("doc_id is not null")
    # a set has about two keys for each five of its n-grams
    total = classes.agg(F.sum("n")).first()[0] or 0
    runs = _runs(known, n, _common(described), max(4, int(0.4 * total) // GATHERED), salt)
    check = _Verifier(known, classes, n, salt)

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = batch.column(1)
            sizes = np.diff(members.offsets.to_numpy())
            first = np.repeat(batch.column(0).to_numpy(), sizes)
            place = np.arange(len(first)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            close = place < np.repeat(batch.column(2).to_numpy(), sizes)
            pairs = np.unique(np.stack([first, members.flatten().to_numpy(), close], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(pairs[:, 2] > 0)], names=["a", "b", "close"])

    met = cut(runs.mapInArrow(lean(stars), "a long, b long, close boolean").groupBy("a", "b").agg(F.max("close").alias("close")), small=True)
    near = check.near(met.filter("close").select("a", "b"))
    # each set is compared with its smallest first member; then with others, as far as still apart
    once = near.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = check.linked(once)
    joined = components(links)
    more = cut(_apart(near.join(once, ["a", "b"], "left_anti"), joined), small=True)
    if not more.isEmpty():
        links = links.unionByName(check.linked(more))
        joined = components(links)
    # members of a run that are still in different components may be linked all the same
    seen = near
    for tries in [TRIES] * ROUNDS + [None]:
        pairs = _across(met, joined, classes, tries)
        if pairs is None:
            break
        rest = cut(pairs.join(seen, ["a", "b"], "left_anti"), small=True)
        if rest.isEmpty():
            continue  # only the last round, which compares all, shows that none is left
        links = links.unionByName(check.linked(rest))
        seen = seen.unionByName(rest)
        joined = components(links)
    members = classes.select("set", "doc_id").join(joined.select(F.col("id").alias("set"), "component"), "set")
    least = members.groupBy("component").agg(F.min("doc_id").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    linked = members.withColumn("salt", F.pmod(F.xxhash64("set"), F.lit(SALTS))).join(least, ["component", "salt"]).select("set", "component", "component_id")
    # kept, so that the join below has plain shuffles on both sides and a set of very many copies can be split
    by_set = cut(classes.select("set", "doc_id").join(linked, "set", "left").select("set", F.coalesce("component", "set").alias("component"), F.coalesce("component_id", "doc_id").alias("component_id")), small=True)
    rows = feats.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("set")).alias("set"))
    return rows.join(by_set, "set", "left").select(
        "doc_id", "n_shingles", "set", "component", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    ), salt


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id) per document: the size of its set, the smallest id reachable by links."""
    return _by_row(docs, key, text, n)[0].select("doc_id", "n_shingles", "component_id")


def _with_set(docs: DataFrame, text: str, n: int, salt: int) -> DataFrame:
    """``docs`` and ``_set``, the name of each row's set; null without n-grams."""
    at = docs.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [digest(grams, salt) if len(grams) else None for grams in gram_sets(batch.column(at), n)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sets, pa.int64())], names=[*batch.schema.names, "_set"])

    return docs.mapInArrow(lean(work), T.StructType([*docs.schema.fields, T.StructField("_set", T.LongType())]))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their text's component, with all columns; of rows with one id and one component one stays."""
    found, salt = _by_row(docs, key, text, n)
    found = cut(found.select(F.col("doc_id").alias(key), "set", "component", "component_id"), small=True)
    gone = cut(found.filter(F.col(key) != F.col("component_id")).select(key).distinct(), small=True)
    twice = cut(found.groupBy(key).count().filter(F.col("count") > 1).filter(F.col(key).isNotNull()).select(key), small=True)
    n_gone, n_twice = gone.count(), twice.count()
    if not n_twice:
        return docs.join(F.broadcast(gone) if n_gone <= MOST_BROADCAST else gone, key, "left_anti")
    side = F.broadcast(twice) if n_twice <= MOST_BROADCAST else twice
    gone = gone.join(side, key, "left_anti")
    once = docs.join(side, key, "left_anti").join(F.broadcast(gone) if n_gone <= MOST_BROADCAST else gone, key, "left_anti")
    # rows of a repeated id are judged by their own texts
    facts = found.join(side, key, "left_semi").filter(F.col(key) == F.col("component_id")).select(F.col(key).alias("_key"), F.col("set").alias("_of"), F.col("component").alias("_component")).distinct()
    again = _with_set(docs.join(side, key, "left_semi"), text, n, salt)
    again = again.join(facts, (F.col(key) == F.col("_key")) & F.col("_set").eqNullSafe(F.col("_of"))).dropDuplicates([key, "_component"])
    return once.select(*docs.columns).unionByName(again.select(*docs.columns))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP9_SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), grams AS MATERIALIZED (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i + 1 : i + 5], ' ')) AS gram FROM (SELECT doc_id, w, unnest(range(greatest(1, len(w) - 4))) AS i FROM d WHERE len(w) > 0)
), sizes AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL
), links AS MATERIALIZED (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)
), ways AS MATERIALIZED (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS id, doc_id AS far FROM d UNION SELECT id, b FROM reach JOIN ways ON a = far
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM d LEFT JOIN sizes USING (doc_id) JOIN (SELECT id, min(far) AS component_id FROM reach GROUP BY id) ON id = d.doc_id
"""
