"""Quality classifier: a generalised additive model with pairwise interactions.

Features are counts over the whole text, made by vectorised byte and word-hash statistics. Each
feature, and each chosen pair of features, has a lookup table over bins. Tables are learned by
cyclic boosting: in every round each feature in turn gets a shallow tree on its bins, fitted to
the gradient of the logistic loss; the pairs follow on what the single features leave. Scoring
adds the tables' entries, so it is a gather and a sum per feature.

The model is fitted on at most ``MOST_ROWS`` labelled rows, chosen by a digest of their id. The
features of every document are computed once, in one pass without a shuffle.

Defined cases: a null or empty text has features of an empty text and gets a score like any
other; repeated ids are scored row by row; documents without a label are only scored; labels
other than 0 and 1, or null, are ignored; of several labels of an id the smallest counts; with
no labels, or labels of one class, every score is the (smoothed) share of label 1; an empty
table gives an empty result; extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semaloom.llm import textkit
from semaloom.llm.sampling import bounded
from semaloom.runtime import cut, lean

#: Labelled rows that the model is fitted on, at most.
MOST_ROWS = 20_000
BINS, PAIR_BINS, ROUNDS, PAIR_ROUNDS, PAIRS, RATE, LEAVES = 64, 16, 240, 80, 8, 0.08, 4

_CLASS = np.zeros(256, np.int64)  # 0: other
for _i, _chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t\x0b\x0c\r", "\n", ".,;:'\"", "!?", "|", "#$%&*+-/<=>@\\^_`~()[]{}"), 1):
    _CLASS[[ord(c) for c in _chars]] = _i
_CLASS[128:] = 10
CLASSES = 11
FEATURES = [
    "words", "word_length", "upper", "digits", "spaces", "lines", "stops", "shouts", "bars", "symbols", "non_ascii", "controls",
    "distinct_words", "top_word", "distinct_bigrams", "distinct_lines", "short_words", "long_words", "end_stops", "capitals", "longest_line",
]


def features(column: pa.Array) -> np.ndarray:
    """One row of FEATURES per text."""
    out = np.zeros((len(column), len(FEATURES)), np.float32)
    for first, last, raw, offsets in textkit.pieces(column):
        hashes, starts, ends, before = textkit.words(raw, offsets)
        kinds = _CLASS[raw]
        sizes = np.maximum(np.diff(offsets), 1)
        rows = np.repeat(np.arange(last - first), np.diff(offsets))
        table = np.bincount(rows * CLASSES + kinds, minlength=(last - first) * CLASSES).reshape(-1, CLASSES)
        lengths = (ends - starts).astype(np.float64)
        letter = table[:, 1] + table[:, 2]
        last_kind = kinds[ends - 1] if len(ends) else np.zeros(0, np.int64)
        first_kind = kinds[starts] if len(starts) else np.zeros(0, np.int64)
        edges = np.flatnonzero(raw == 10)
        for d in range(last - first):
            a, b = before[d], before[d + 1]
            n = b - a
            t = table[d]
            f = out[first + d]
            f[0] = np.log1p(n)
            f[2] = t[1] / max(letter[d], 1)
            f[3], f[4], f[5], f[6], f[7], f[8], f[9], f[10], f[11] = t[[3, 4, 5, 6, 7, 8, 9, 10, 0]] / sizes[d]
            if not n:
                continue
            own = hashes[a:b]
            counts = _counts(own)
            f[1] = lengths[a:b].mean()
            f[12] = len(counts) / n
            f[13] = counts.max() / n
            f[14] = len(_counts(own[:-1] * np.uint64(3) + own[1:])) / (n - 1) if n > 1 else 1
            i, j = np.searchsorted(edges, (offsets[d], offsets[d + 1]))
            marks = np.concatenate(([a], np.searchsorted(starts, edges[i:j]), [b]))
            marks = marks[np.concatenate(([True], np.diff(marks) > 0))]
            lines = np.add.reduceat(own * (np.uint64(2) * np.arange(n, dtype=np.uint64) + np.uint64(1) - np.uint64(2) * np.repeat(marks[:-1] - a, np.diff(marks)).astype(np.uint64)), marks[:-1] - a)
            f[15] = len(_counts(lines)) / len(lines)
            f[16] = (lengths[a:b] <= 3).mean()
            f[17] = (lengths[a:b] > 18).mean()
            f[18] = ((last_kind[a:b] == 6) | (last_kind[a:b] == 7)).mean()
            f[19] = (first_kind[a:b] == 1).mean()
            f[20] = np.log1p(np.diff(marks).max())
    return out


def _counts(values: np.ndarray) -> np.ndarray:
    ordered = np.sort(values)
    at = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1], [True])))
    return np.diff(at)


class Gam:
    """Bin edges and lookup tables; ``score`` adds them up."""

    def __init__(self) -> None:
        self.base = 0.0
        self.cuts: list[np.ndarray] = []
        self.tables: list[np.ndarray] = []
        self.pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = []

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for i, table in enumerate(self.tables):
            total += table[np.searchsorted(self.cuts[i], x[:, i], side="right")]
        for i, j, ci, cj, table in self.pairs:
            total += table[np.searchsorted(ci, x[:, i], side="right"), np.searchsorted(cj, x[:, j], side="right")]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -40, 40)))


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.arange(1, bins) / bins, method="higher")) if len(values) else np.zeros(0)


def _leaf(g: np.ndarray, h: np.ndarray) -> float:
    return float(g.sum() / (h.sum() + 1.0))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """Values per bin of a shallow tree with at most ``leaves`` leaves, split where the gain is largest."""
    parts = [(0, len(g))]
    gain = lambda a, b: a * a / (b + 1.0)
    cg, ch = np.concatenate(([0.0], np.cumsum(g))), np.concatenate(([0.0], np.cumsum(h)))
    while len(parts) < leaves:
        best = (1e-6, -1, -1)
        for k, (a, b) in enumerate(parts):
            if b - a < 2:
                continue
            m = np.arange(a + 1, b)
            gl, hl, gr, hr = cg[m] - cg[a], ch[m] - ch[a], cg[b] - cg[m], ch[b] - ch[m]
            won = gain(gl, hl) + gain(gr, hr) - gain(cg[b] - cg[a], ch[b] - ch[a])
            won[(hl < 1.0) | (hr < 1.0)] = 0
            if won.max(initial=0) > best[0]:
                best = (float(won.max()), k, int(m[won.argmax()]))
        if best[1] < 0:
            break
        a, b = parts.pop(best[1])
        parts += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = _leaf(g[a:b], h[a:b])
    return out


def _tree2(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """A tree of two levels on a grid: one split of an axis, then one split of the other in each half."""
    best, found = 0.0, np.zeros_like(g)
    whole = g.sum() ** 2 / (h.sum() + 1.0)
    for axis in (0, 1):
        gg, hh = (g, h) if axis == 0 else (g.T, h.T)
        cg, ch = np.cumsum(np.cumsum(gg, 0), 1), np.cumsum(np.cumsum(hh, 0), 1)
        for m in range(1, len(gg)):
            total, out = 0.0, np.zeros_like(gg)
            for rows, low_g, low_h in ((slice(0, m), 0.0, 0.0), (slice(m, len(gg)), cg[m - 1], ch[m - 1])):
                top = m - 1 if rows.start == 0 else len(gg) - 1
                lg, lh = cg[top] - low_g, ch[top] - low_h
                sg, sh = lg[-1], lh[-1]
                won = lg**2 / (lh + 1.0) + (sg - lg) ** 2 / (sh - lh + 1.0)
                k = int(won.argmax())
                total += float(won[k])
                out[rows, : k + 1] = lg[k] / (lh[k] + 1.0)
                out[rows, k + 1 :] = (sg - lg[k]) / (sh - lh[k] + 1.0)
            if total - whole > best:
                best, found = total - whole, out if axis == 0 else out.T
    return found, best


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """Cyclic boosting of the single features, then of the pairs that gain most."""
    model = Gam()
    share = (y.sum() + 1.0) / (len(y) + 2.0)
    model.base = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        return model
    model.cuts = [_cuts(x[:, i], BINS) for i in range(x.shape[1])]
    bins = [np.searchsorted(c, x[:, i], side="right") for i, c in enumerate(model.cuts)]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    margin = np.full(len(y), model.base)
    for _ in range(ROUNDS):
        for i, b in enumerate(bins):
            p = 1 / (1 + np.exp(-margin))
            n = len(model.tables[i])
            step = RATE * _tree(np.bincount(b, y - p, n), np.bincount(b, p * (1 - p), n), LEAVES)
            model.tables[i] += step
            margin += step[b]
    coarse = [_cuts(x[:, i], PAIR_BINS) for i in range(x.shape[1])]
    grid = [np.searchsorted(c, x[:, i], side="right") for i, c in enumerate(coarse)]

    def cells(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
        at = grid[i] * shape[1] + grid[j]
        return at, np.bincount(at, y - p, shape[0] * shape[1]).reshape(shape), np.bincount(at, p * (1 - p), shape[0] * shape[1]).reshape(shape)

    gains = sorted(((_tree2(*cells(i, j)[1:])[1], i, j) for i in range(x.shape[1]) for j in range(i) if len(coarse[i]) and len(coarse[j])), reverse=True)
    chosen = [(i, j) for gain, i, j in gains[:PAIRS] if gain > 0]
    tables = {ij: np.zeros((len(coarse[ij[0]]) + 1, len(coarse[ij[1]]) + 1)) for ij in chosen}
    for _ in range(PAIR_ROUNDS):
        for ij in chosen:
            at, g, h = cells(*ij)
            step = RATE * _tree2(g, h)[0]
            tables[ij] += step
            margin += step.ravel()[at]
    model.pairs = [(i, j, coarse[i], coarse[j], tables[i, j]) for i, j in chosen]
    return model


def with_features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, features) of every document, kept in the shared checkpoint folder."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in features(part.column(1))], pa.binary())], names=["doc_id", "features"])

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return cut(rows.mapInArrow(lean(work), f"doc_id {dict(rows.dtypes)['doc_id']}, features binary"))


def remainder(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


def _known(labels: DataFrame, most: int) -> DataFrame:
    """At most ``most`` labels to learn from."""
    labels = labels.filter(F.col("quality").isin(0, 1) & (remainder() != 1))
    return bounded(labels.groupBy("doc_id").agg(F.min("quality").alias("quality")), most, "doc_id")


def train(featured: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> Gam:
    """Fit on the labelled rows whose remainder is not 1; ``most`` bounds what reaches the driver."""
    rows = featured.join(F.broadcast(_known(labels, most)), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").select("features", "quality").limit(most).toArrow()
    x = np.array([np.frombuffer(b, np.float32) for b in rows.column("features").to_pylist()], dtype=np.float32).reshape(-1, len(FEATURES))
    return fit(x, rows.column("quality").to_numpy().astype(np.float64))


def scored(featured: DataFrame, model: Gam) -> DataFrame:
    """(doc_id, score)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([np.frombuffer(b, np.float32) for b in batch.column(1).to_pylist()], dtype=np.float32).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x), pa.float64())], names=["doc_id", "score"])

    return featured.mapInArrow(lean(work), f"doc_id {dict(featured.dtypes)['doc_id']}, score double")


def sample_features(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """:func:`with_features` of the documents that :func:`train` would use, alone."""
    return with_features(docs.join(F.broadcast(_known(labels, most).select(F.col("doc_id").alias(key))), key, "left_semi"), key, text)


def accepted(docs: DataFrame, model: Gam, least: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``least``, with all columns; nothing is shuffled."""
    at = docs.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                yield part.filter(pa.array(model.score(features(part.column(at))) >= least))

    return docs.mapInArrow(lean(work), docs.schema)


def op1_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    featured = with_features(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    scores = scored(featured, train(featured, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scores.select("doc_id", F.coalesce(remainder() == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
