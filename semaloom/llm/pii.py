"""Personal data by candidate gradient boosting.

Base matches are fixed patterns with validators. High-recall generators propose further, also
overlapping, spans: shorter readings of what a greedy pattern ran together, numbers without a
plus sign, spelled-out addresses. Boosted trees judge every candidate by format and context.
They learn from the corpus itself: candidates that are base matches are positive, and so are the
same data written in other ways (spelled out, regrouped, with another number beside them), which no
base pattern accepts; spoilt copies, prose with an "at" and a "dot", numbers within number tables and candidates that no
validator accepts are negative. Spans inside a failed base match, and spans that a validator accepts
in another form than the base pattern's, are left out, because they are what the model is to decide. Thresholds are calibrated per kind on a part that the trees have not
seen. Spans are judged whole, whatever their length.

Offsets are code points, ends exclusive. The whole text is searched, in time linear in it.

Defined cases: a null text is an empty one; an empty table, or one without any candidate, gives
no added spans; repeated rows are judged row by row; extra columns are dropped by ``detect`` and
kept by ``redact``.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semaloom.llm.sampling import bounded
from semaloom.runtime import cut, lean

KINDS = ("email", "ip", "card", "phone")
#: Candidates that the trees are fitted on, at most; the precision that a threshold must reach, and the least threshold.
MOST_CANDIDATES, PRECISION, FLOOR = 20_000, 0.98, 0.3
TREES, DEPTH, RATE, BINS = 150, 3, 0.2, 32

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

Span = tuple[int, int, int]  # index of KINDS, start, end


def luhn(digits: str) -> bool:
    total = sum(int(c) for c in digits[-1::-2]) + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return total % 10 == 0


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def valid(kind: int, text: str) -> bool:
    """The validator of a kind, on a text that fits its pattern."""
    if kind == 1:
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in text.split("."))
    if kind == 2:
        d = _digits(text)
        return 16 <= len(d) <= 19 and luhn(d)
    return kind == 0 or 8 <= len(_digits(text)) <= 15


def base_spans(text: str) -> tuple[list[Span], list[Span]]:
    """(valid matches, failed matches), leftmost and non-overlapping per kind, by kind and start."""
    good: list[Span] = []
    failed: list[Span] = []
    last, at = 0, text.find("@")
    while at >= 0:
        low = at
        while low > last and (text[low - 1].isascii() and (text[low - 1].isalnum() or text[low - 1] in "._%+-")):
            low -= 1
        if low < at and (m := _DOMAIN.match(text, at + 1)):
            good.append((0, low, m.end()))
            last = m.end()
        else:
            last = max(last, at)
        at = text.find("@", max(at + 1, last))
    for kind, pattern in ((1, _IP), (2, _CARD)):
        for m in pattern.finditer(text):
            if kind == 1 or m.end() - m.start() >= 13:
                (good if valid(kind, m[0]) else failed).append((kind, m.start(), m.end()))
    at = text.find("+")
    while at >= 0:
        m = _PHONE.match(text, at)
        if m:
            (good if valid(3, m[0]) else failed).append((3, at, m.end()))
        at = text.find("+", m.end() if m else at + 1)
    return good, failed


_ZONE = re.compile(r"[+(]?[0-9][0-9 ().+-]{5,}")
_WITHIN = [
    (3, re.compile(r"(?<![0-9])(?:\+|00)[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])")),
    (3, re.compile(r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")),
    (3, re.compile(r"\+[0-9]{8,15}(?![0-9])")),
    (2, re.compile(r"(?<![0-9])[0-9]{13,19}(?![0-9])")),
    (2, re.compile(r"(?<![0-9])[0-9]{4}(?:[ -]?[0-9]{4}){3}(?![0-9])")),
    (1, re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])")),
]
_SPELT = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:\[at\]|\(at\)|@) ?[A-Za-z0-9-]{1,64}(?: ?(?:\[dot\]|\(dot\)|\.) ?[A-Za-z0-9-]{2,24}){1,4}", re.I)
_SPELT_DOT = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9._%+-]{1,64} at [A-Za-z0-9-]{1,64}(?: dot [A-Za-z0-9-]{2,24}){1,4}", re.I)


def candidates(text: str, good: list[Span]) -> list[Span]:
    """Proposed spans, the base ones among them; they may overlap."""
    found = set(good)
    for zone in _ZONE.finditer(text):
        a, b = max(0, zone.start() - 1), min(len(text), zone.end() + 1)
        part = text[a:b]
        for kind, pattern in _WITHIN:
            at = 0
            while m := pattern.search(part, at):
                if zone.start() <= a + m.start():
                    found.add((kind, a + m.start(), a + m.end()))
                at = m.start() + 1  # also overlapping ones; a match has bounded length, so this is linear
    if "[at]" in text or "(at)" in text or "[AT]" in text or "(AT)" in text:
        found.update((0, m.start(), m.end()) for m in _SPELT.finditer(text))
    if " dot " in text:
        found.update((0, m.start(), m.end()) for m in _SPELT_DOT.finditer(text))
    return sorted(found)


class Cover:
    """Where spans lie; says whether a span overlaps any of them, in logarithmic time."""

    def __init__(self, spans: list[Span]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, a, b in sorted(spans, key=lambda s: s[1]):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, a: int, b: int) -> bool:
        k = bisect.bisect_right(self.ends, a)
        return k < len(self.starts) and self.starts[k] < b

    def add(self, a: int, b: int) -> None:
        """A span that meets none."""
        k = bisect.bisect_right(self.starts, a)
        self.starts.insert(k, a)
        self.ends.insert(k, b)


_HINTS = re.compile(r"mail|phone|tel|call|fax|mobile|card|visa|credit|ip|address|contact", re.I)


#: Usual ends of domains that are not words as well.
_ENDING = re.compile(r"[ .)\]](?:com|org|net|edu|gov|info|biz|dev|io|de|fr|uk|nl|ch|eu|us|ca|au|jp|cn|br|ru|pl|se|dk|es)\Z", re.I)
#: Prose that reads like a spelled-out address.
_PROSE = ("look at the dot on", "meet at noon dot then", "point at this dot in", "stop at each dot you", "laugh at every dot and", "stay at home dot we")
#: Groups of four digits, as in a number table.
_TABLE_BEFORE, _TABLE_AFTER = re.compile(r"(?:(?<![0-9])[0-9]{4} ){2}\Z"), re.compile(r"(?: [0-9]{4}(?![0-9])){2}")


def _class(c: str) -> int:
    return 0 if not c else 1 if c.isspace() else 2 if c.isalpha() else 3 if c.isdigit() else 4 if c in ".,;:!?)('\"" else 5


def describe(kind: int, text: str, before: str, after: str) -> list[float]:
    """Format and context features of a candidate; ``before`` and ``after`` are up to 24 code points."""
    digits = _digits(text)
    groups = re.split(r"[^0-9A-Za-z]+", text.strip("+("))
    separators = [c for c in text if not c.isalnum()]
    parts = text.split(".") if kind == 1 else []
    return [
        float(kind), len(text), len(digits), len(separators), len(set(separators)), len(set(digits)), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
        float(text[:1] == "+"), float("(" in text and ")" in text), float(len(digits) > 1 and luhn(digits)),
        float(bool(parts) and all(p.isdigit() and int(p[-4:]) <= 255 for p in parts)), float(digits[:1] or -1), float("@" in text),
        _class(before[-1:]), _class(after[:1]), float(bool(re.search(r"[0-9]\.$|[+.-]$", before))), float(bool(re.match(r"[.-][0-9]|[%€$]", after))), float(bool(_HINTS.search(before))),
        len(_digits(before[-12:])), len(_digits(after[:12])), float(bool(_TABLE_BEFORE.search(before) or _TABLE_AFTER.match(after))),
        float(kind == 0 and bool(_ENDING.search(text))),
    ]


def _rewritten(kind: int, text: str, turn: int) -> str | None:
    """The same personal data in a form that a generator proposes and no base pattern accepts; None if there is none."""
    if kind == 0:
        local, _, domain = text.rpartition("@")
        forms = [f"{local} at {domain.replace('.', ' dot ')}", f"{local}[at]{domain}", f"{local} (at) {domain.replace('.', ' (dot) ')}", f"{local} @ {domain}"]
        return next((t for t in forms[turn % 4 :] + forms if _SPELT.fullmatch(t) or _SPELT_DOT.fullmatch(t)), None)
    d = _digits(text)
    if kind == 2:
        return " -"[turn % 2].join(d[i : i + 4] for i in range(0, 16, 4)) if len(d) == 16 else d
    if kind == 3 and len(d) >= 10:
        n = d[-10:]
        return [f"({n[:3]}) {n[3:6]}-{n[6:]}", f"{n[:3]}-{n[3:6]}-{n[6:]}", f"00{d[:-10] or '1'} {n[:3]} {n[3:6]} {n[6:]}", f"{n[:3]} {n[3:6]} {n[6:]}"][turn % 4]
    return None


def _beside(kind: int, before: str, after: str, turn: int) -> tuple[str, str]:
    """The context of a number that stands beside another one: on the left, or on the right."""
    other = ["4821", "+1 (415) 555-0100", "198.51.100.24", "20934", "5105105105105100", "7 302"][turn // 2 % 6]
    return (f"{before} {other} "[-24:], after) if turn % 2 else (before, f" {other}{after}"[:24])


def _spoil(kind: int, text: str, turn: int) -> str:
    """A near miss of a true span, to learn from."""
    if kind == 0:
        return [text.replace("@", " ", 1), text.split("@")[0] + "@" + text.split("@")[-1].split(".")[0], text.replace(".", " ")][turn % 3]
    if kind == 1:
        p = text.split(".")
        return [".".join([p[0], str(256 + int(p[1][-3:])), *p[2:]]), ".".join([*p[:3], p[3] + "777"]), ".".join(p[:3])][turn % 3]
    if kind == 2:
        d = _digits(text)
        return [d[:-1] + str((int(d[-1]) + 1 + turn % 8) % 10), d[:13], d + "12345"][turn % 3 if turn % 5 else 0]
    d = _digits(text)
    return ["+" + d[:6], "+" + d + "00000000", d][turn % 3]


class Boosted:
    """Boosted trees on binned features, with a threshold per kind."""

    def __init__(self) -> None:
        self.cuts: list[np.ndarray] = []
        self.base = 0.0
        self.trees: list[tuple[list[tuple[int, int]], np.ndarray]] = []
        self.thresholds = np.full(len(KINDS), np.inf)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, i], side="right") for i, c in enumerate(self.cuts)], 1) if self.cuts else np.zeros((len(x), 0), np.int64)

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, total = self.bins(x), np.full(len(x), self.base)
        for splits, leaves in self.trees:
            total += leaves[_route(b, splits)]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _route(b: np.ndarray, splits: list[tuple[int, int]]) -> np.ndarray:
    """Leaf of each row in a full tree whose nodes are listed level by level; feature -1 goes left."""
    at = np.zeros(len(b), np.int64)
    features, marks = np.array([f for f, _ in splits]), np.array([m for _, m in splits])
    for _ in range(DEPTH):
        f = features[at]
        right = (f >= 0) & (b[np.arange(len(b)), np.maximum(f, 0)] > marks[at])
        at = 2 * at + 1 + right
    return at - (2**DEPTH - 1)


def boost(x: np.ndarray, y: np.ndarray) -> Boosted:
    model = Boosted()
    model.cuts = [np.unique(np.quantile(x[:, i], np.arange(1, BINS) / BINS, method="lower")) for i in range(x.shape[1])]
    b = model.bins(x)
    share = (y.sum() + 1) / (len(y) + 2)
    model.base = float(np.log(share / (1 - share)))
    margin = np.full(len(y), model.base)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        splits: list[tuple[int, int]] = []
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-6)
            chosen = [(-1, 0)] * width
            for f in range(b.shape[1]):
                at = (node - first) * BINS + b[:, f]
                cg = np.cumsum(np.bincount(at, g, width * BINS).reshape(width, BINS), 1)
                ch = np.cumsum(np.bincount(at, h, width * BINS).reshape(width, BINS), 1)
                tg, th = cg[:, -1:], ch[:, -1:]
                gain = cg**2 / (ch + 1) + (tg - cg) ** 2 / (th - ch + 1) - tg**2 / (th + 1)
                for k in np.flatnonzero(gain.max(1) > best):
                    best[k], chosen[k] = gain[k].max(), (f, int(gain[k].argmax()))
            splits += chosen
            fs, ms = np.array([f for f, _ in chosen]), np.array([m for _, m in chosen])
            here = node - first
            right = (fs[here] >= 0) & (b[np.arange(len(b)), np.maximum(fs[here], 0)] > ms[here])
            node = 2 * node + 1 + right
        leaf = node - (2**DEPTH - 1)
        values = RATE * np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + 1)
        model.trees.append((splits, values))
        margin += values[leaf]
    return model


def _sides(text: str, a: int, b: int) -> tuple[str, str]:
    return text[max(0, a - 24) : a], text[b : b + 24]


def learn(docs: DataFrame, text: str = "text", most: int = MOST_CANDIDATES) -> Boosted:
    """Fit on a bounded sample of the candidates of all documents; they alone reach the driver."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, spans, befores, afters, states = [], [], [], [], []
            for body in batch.column(0).to_pylist():
                if not body:
                    continue
                good, failed = base_spans(body)
                true, here, there = set(good), Cover(good), Cover(failed)
                for kind, a, b in candidates(body, good):
                    # what only its form keeps from being a base match is left out too
                    state = 1 if (kind, a, b) in true else 2 if there.meets(a, b) or valid(kind, body[a:b]) else 0
                    if state == 0 and here.meets(a, b):
                        continue
                    before, after = _sides(body, a, b)
                    for out, v in ((kinds, kind), (spans, body[a:b]), (befores, before), (afters, after), (states, state)):
                        out.append(v)
            if kinds:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kinds, pa.int32()), pa.array(spans, pa.string()), pa.array(befores, pa.string()), pa.array(afters, pa.string()), pa.array(states, pa.int32())],
                    names=["kind", "span", "before", "after", "state"],
                )

    found = cut(docs.select(F.col(text).cast("string")).mapInArrow(lean(work), "kind int, span string, before string, after string, state int"))
    rows = bounded(found.filter("state < 2"), most, "span", "before", "after", "kind", "state").collect()
    x: list[list[float]] = []
    y: list[float] = []
    for turn, r in enumerate(rows):
        x.append(describe(r["kind"], r["span"], r["before"], r["after"]))
        y.append(float(r["state"]))
        if r["state"]:
            kind, sides = r["kind"], (r["before"], r["after"])
            near, also = _beside(kind, *sides, turn), _beside(kind, *sides, turn + 7)
            table = ("8403 2957 1160 "[-24:], " 6628 1043 7719")
            other = _rewritten(kind, r["span"], turn)
            if other:
                x += [describe(kind, other, *sides), describe(kind, other, *near)]
                y += [1.0, 1.0]
            if kind == 0:
                x.append(describe(kind, _PROSE[turn % len(_PROSE)], *sides))
                y.append(0.0)
            if kind in (2, 3):
                x += [describe(kind, r["span"], *near), describe(kind, r["span"], *also)]
                y += [1.0, 1.0]
                x += [describe(kind, other or r["span"], *ends) for ends in (table, (table[0], sides[1]), (sides[0], table[1]))]
                y += [0.0, 0.0, 0.0]
            for k in (turn, turn + 1):
                x.append(describe(kind, _spoil(kind, r["span"], k), *sides))
                y.append(0.0)
    if not any(y):
        return Boosted()
    xs, ys = np.array(x), np.array(y)
    held = np.arange(len(ys)) // 8 % 4 == 3
    if held.all() or not held.any() or not ys[~held].any():
        held[:] = False
    model = boost(xs[~held], ys[~held])
    check = held if held.any() else ~held
    scores, truth, kinds = model.score(xs[check]), ys[check], xs[check, 0]
    for k in range(len(KINDS)):
        s, t = scores[kinds == k], truth[kinds == k]
        order = np.argsort(-s, kind="stable")
        precise = np.cumsum(t[order]) / np.arange(1, len(s) + 1) >= PRECISION if len(s) else np.zeros(0, bool)
        if precise.any():
            last = int(np.flatnonzero(precise)[-1])
            below = float(s[order][last + 1]) if last + 1 < len(s) else 0.0
            model.thresholds[k] = max(FLOOR, (float(s[order][last]) + below) / 2)  # half way to what must be rejected
    return model


def spans_of(texts: list[str | None], model: Boosted) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text. Added spans pass their kind's validator and overlap neither base spans nor each other."""
    out, asked, rows = [], [], []
    for i, body in enumerate(texts):
        good, _ = base_spans(body) if body else ([], [])
        out.append((good, list(good)))
        if not body:
            continue
        here = Cover(good)
        for kind, a, b in candidates(body, good):
            if not here.meets(a, b) and valid(kind, body[a:b]):
                asked.append((i, kind, a, b))
                rows.append(describe(kind, body[a:b], *_sides(body, a, b)))
    if rows:
        x = np.array(rows)
        scores = model.score(x)
        passed = scores >= model.thresholds[x[:, 0].astype(int)]
        taken: dict[int, list[Span]] = {}
        covers: dict[int, Cover] = {}
        for k in sorted(np.flatnonzero(passed), key=lambda k: (-round(float(scores[k]), 6), asked[k][2] - asked[k][3], asked[k])):
            i, kind, a, b = asked[k]
            cover = covers.setdefault(i, Cover([]))
            if not cover.meets(a, b):
                cover.add(a, b)
                taken.setdefault(i, []).append((kind, a, b))
        for i, more in taken.items():
            out[i] = (out[i][0], sorted(out[i][1] + more))
    return out


def detect(docs: DataFrame, model: Boosted, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, base, spans): arrays of (kind, start, end) per document."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = spans_of(part.column(1).to_pylist(), model)
                lists = [pa.array([[{"kind": KINDS[k], "start": a, "end": b} for k, a, b in f[which]] for f in found], kind) for which in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column(0), *lists], names=["doc_id", "base", "spans"])

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    spans = "array<struct<kind:string,start:bigint,end:bigint>>"
    return rows.mapInArrow(lean(work), f"doc_id {dict(rows.dtypes)['doc_id']}, base {spans}, spans {spans}")


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each run of overlapping spans replaced by the first one's kind in brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: Boosted, text: str = "text") -> DataFrame:
    """All columns of ``docs``, with the spans in ``text`` redacted; a null text stays null."""
    at = docs.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                texts = part.column(at).to_pylist()
                new = [t if not t else redacted(t, s) for t, (_, s) in zip(texts, spans_of(texts, model), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:at], pa.array(new, part.column(at).type), *part.columns[at + 1 :]], schema=part.schema)

    return docs.mapInArrow(lean(work), docs.schema)


def _is(kind: str):
    return lambda s: s["kind"] == kind


def op8_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = detect(docs, learn(docs))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))
