"""Operators on documents against brute force."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from semaloom.llm import jaccard, mixing, packing, pii, quality, substring

WORD = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall(text or "")


# ---- 9


def brute_components(rows, n=5):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = words((t or "").translate(lower))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_jaccard(docs, corpus_rows):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs).collect()}
    assert got == brute_components(corpus_rows)


def test_jaccard_empty_and_null_ids(spark, no_docs):
    assert jaccard.jaccard_components(no_docs).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    got = sorted(jaccard.jaccard_components(rows).collect(), key=repr)
    assert sorted((r["doc_id"], r["component_id"]) for r in got if r["doc_id"]) == [(2, 2), (2, 2), (3, 2)]
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]
    kept = jaccard.one_of_each(rows).collect()
    assert sorted(map(repr, kept)) == ["Row(doc_id=2, text='a b c d e f')", "Row(doc_id=None, text='a b c d e f')"]


def test_one_of_each_judges_rows_of_one_id_by_their_texts(spark):
    text = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    rows = [(1, text(0)), (5, text(0)), (5, text(1)), (5, text(2)), (5, text(2) + " end"), (5, text(2)), (5, ""), (5, None), (6, text(1)), (7, text(3)), (None, text(3)), (None, text(3))]
    kept = sorted(map(repr, jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    short = [r.replace(text(2) + " end", text(2)).replace("''", "None") for r in kept]
    want = [(1, text(0)), (5, text(1)), (5, text(2)), (5, None), (7, text(3)), (None, text(3)), (None, text(3))]
    assert short == sorted(f"Row(doc_id={i}, text={t!r})" for i, t in want)


def test_jaccard_one_link_in_a_hot_run(spark, monkeypatch):
    """One run of hundreds of unlinked sets, dealt out in many blocks, and one linked pair in it."""
    text = lambda i, last="": " ".join([*(f"u{i}x{k}" for k in range(40)), last])
    texts = {i: text(i) for i in range(500)}
    texts[1000] = text(77, "end")
    pair = (77, 1000)
    run = sorted(jaccard.digest(g) for g in jaccard.gram_sets(pa.array(list(texts.values())), 5))
    monkeypatch.setattr(jaccard, "BLOCK", 40)
    monkeypatch.setattr(jaccard, "_runs", lambda *_: spark.createDataFrame([(run[0], run[1:], len(run) - 1)], "first long, members array<long>, close int"))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(docs).collect()}
    assert got == {i: pair[0] if i in pair else i for i in texts}


@pytest.mark.parametrize("heavy,block", [(jaccard.HEAVY, jaccard.BLOCK), (8, 16)])
def test_jaccard_group_around_the_threshold(spark, monkeypatch, heavy, block):
    """A group whose members are linked in chains, and outsiders that share a passage with it; with heavy keys in pieces too."""
    monkeypatch.setattr(jaccard, "HEAVY", heavy)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    from llm_samples import mutate, prose
    import random

    rng = random.Random(3)
    base, passage = prose(rng, 120), prose(rng, 12)
    rows = [(i, mutate(rng, base, rng.choice([0.02, 0.03, 0.05]))) for i in range(150)]
    rows += [(150 + i, f"{passage} {prose(rng, 90)}") for i in range(60)]
    rows += [(210 + i, f"{base[:300]} {prose(rng, 60)}") for i in range(30)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_jaccard_names_that_collide(spark, monkeypatch):
    """Sets that get one name are named anew."""
    digest = jaccard.digest
    monkeypatch.setattr(jaccard, "digest", lambda grams, salt=0: digest(grams, salt) % 3 if salt in (0, 1) else digest(grams, salt))
    rows = [(i, " ".join(f"w{i % 7}x{k}" for k in range(20 + i % 2))) for i in range(28)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_parity_bounds():
    rng = np.random.default_rng(0)
    for n in (1, 4, 30, 300, 3000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[n // 8 :], rng.integers(0, 1 << 63, n // 10, dtype=np.uint64)]))
        apart = len(np.setxor1d(a, b))
        assert jaccard.hamming(jaccard.parity(a), jaccard.parity(b)) <= apart
        if apart <= jaccard.most_apart(len(a) + len(b)):
            none = lambda x: np.zeros(len(x), np.int64)
            assert np.intersect1d(jaccard.join_keys(a, none(a))[0], jaccard.join_keys(b, none(b))[0]).size


# ---- 4


def brute_removed(rows):
    seen, out = {}, {}
    for i, t in sorted(rows):
        w = words(t)
        for k in range(len(w) - 49):
            seen.setdefault(tuple(w[k : k + 50]), i)
    for i, t in rows:
        w = words(t)
        keep = [True] * len(w)
        for k in range(len(w) - 49):
            if seen[tuple(w[k : k + 50])] < i:
                keep[k : k + 50] = [False] * 50
        kept = [x for x, s in zip(w, keep) if s]
        out[i] = (len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def test_substring(docs, corpus_rows):
    rows = substring.without_repeats(docs, with_text=True).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows} == brute_removed(corpus_rows)
    assert all(hashlib.sha256(r["kept"].encode()).hexdigest() == r["kept_sha256"] for r in rows if r["n_removed"])


@pytest.mark.parametrize("hot,at", [(3, 50), (1, 1_000_000)])
def test_substring_hot_anchor(spark, docs, corpus_rows, monkeypatch, hot, at):
    """Anchors in many documents go by single windows, combined in small batches, with the same result."""
    monkeypatch.setattr(substring, "HOT", hot)
    monkeypatch.setattr(substring, "ANCHORS_AT", at)
    monkeypatch.setattr(substring, "SEGMENTS_AT", 20_000)
    rows = substring.without_repeats(docs).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows} == brute_removed(corpus_rows)


def test_substring_names_that_collide(spark, docs, corpus_rows, monkeypatch):
    """Classes that get one name are named anew."""
    class_of = substring.class_of
    monkeypatch.setattr(substring, "class_of", lambda hashes, salt=0: class_of(hashes, salt) % 5 if salt == 0 else class_of(hashes, salt))
    rows = substring.without_repeats(docs).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows} == brute_removed(corpus_rows)


def test_substring_defined_cases(spark, no_docs):
    assert substring.without_repeats(no_docs).count() == 0
    text = " ".join(f"w{i}" for i in range(60))
    rows = spark.createDataFrame([(None, text), (5, text), (5, text), (4, text), (9, f"x {text} y"), (1, None)], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"]) for r in substring.without_repeats(rows).collect())
    assert got == [("1", 0, 0), ("4", 60, 0), ("5", 60, 60), ("5", 60, 60), ("9", 62, 60), ("None", 60, 0)]


def test_fm_index_counts():
    rng = np.random.default_rng(5)
    text = rng.integers(1, 4, 400).astype(np.int32)
    index = substring.FmIndex(np.append(text, 0).astype(np.int32), np.zeros(401, np.int64))
    for n in (1, 2, 3, 5, 8):
        for at in rng.integers(0, 390, 20):
            lo, hi = np.array([0]), np.array([401])
            for w in text[at : at + n][::-1]:
                lo, hi = index.step(np.array([w]), lo, hi)
            assert hi[0] - lo[0] == sum((text[k : k + n] == text[at : at + n]).all() for k in range(400 - n + 1))


# ---- 5


def test_packing(spark, docs, corpus_rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [*corpus_rows, (900, "before <|endoftext|> after"), (901, "x" * 5000), (902, " \n\n\t  " * 40)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {}
    used = {}
    for r in packing.pack(table).collect():
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        got.setdefault(r["doc_id"], []).append((r["piece"], r["start"], ids))
        used.setdefault(r["sequence_id"], []).append((r["offset"], len(ids)))
    for i, t in rows:
        ids = [*exact.encode(t or "", add_special_tokens=False).ids, 0]
        parts = sorted(got[i])
        assert sum((p[2] for p in parts), []) == ids and [p[0] for p in parts] == list(range(-(-len(ids) // 2048)))
        assert all(len(p[2]) == 2048 for p in parts[1:]) and [p[1] for p in parts] == np.cumsum([0, *(len(p[2]) for p in parts[:-1])]).tolist()
    total = 0
    for spots in used.values():
        at = 0
        for offset, size in sorted(spots):
            assert offset == at
            at += size
        assert at <= 2048
        total += at
    assert len(used) <= -(-total // 2048) + 3
    assert packing.pack(docs.limit(0)).count() == 0


def test_best_fit_closes_the_fullest():
    bins = packing.BestFit(10, 2)
    assert [bins.place(s) for s in (6, 7, 8)] == [(0, 0), (1, 0), (2, 0)]  # 1 was the fullest and has closed
    assert [bins.place(s) for s in (3, 2, 2)] == [(0, 6), (2, 8), (3, 0)]
    bins = packing.BestFit(10, 2)
    assert [bins.place(s) for s in (6, 7, 3)] == [(0, 0), (1, 0), (1, 7)]
    assert bins.place(5) == (2, 0) and bins.place(9) == (3, 0) and bins.place(4) != (0, 6)


def brute_best_fit(sizes, length, most):
    """Looks through all open bins; of equal ones the last that got its space."""
    bins, out, opened = [], [], 0
    for size in sizes:
        fits = [b for b in bins if b[0] >= size]
        if fits:
            free = min(b[0] for b in fits)
            b = [b for b in fits if b[0] == free][-1]
            bins.remove(b)
        else:
            if len(bins) == most:
                free = min(b[0] for b in bins)
                bins.remove([b for b in bins if b[0] == free][-1])
            b = (length, opened)
            opened += 1
        out.append((b[1], length - b[0]))
        if b[0] - size:
            bins.append((b[0] - size, b[1]))
    return out


@pytest.mark.parametrize("most", [1, 2, 7, 500])
def test_best_fit_against_brute_force(most):
    rng = np.random.default_rng(most)
    sizes = rng.integers(1, 65, 900).tolist()
    bins = packing.BestFit(64, most)
    assert [bins.place(s) for s in sizes] == brute_best_fit(sizes, 64, most)


def test_packing_with_few_open_places(spark, corpus_rows, monkeypatch):
    """Sequences close, and nothing is lost or overlaps; repeated rows and clashing columns."""
    monkeypatch.setattr(packing, "OPEN", 2)
    monkeypatch.setattr(packing, "PIECES", 8)
    table = spark.createDataFrame([*corpus_rows, corpus_rows[0], corpus_rows[0]], "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("offset", F.lit("x"))
    used = {}
    rows = packing.placed(packing.pack(table.coalesce(1))).collect()
    for r in rows:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spots in used.values():
        at = 0
        for offset, size in sorted(spots):
            assert offset == at
            at += size
        assert at <= 2048
    assert sum(r["doc_id"] == corpus_rows[0][0] and r["piece"] == 0 for r in rows) == 3


# ---- 6


def test_mixing(spark, docs, corpus_rows):
    weights = [1.0, 2.0, 3.0]
    rows = mixing.mix(docs, weights).collect()
    size = {i: len(words(t)) for i, t in corpus_rows}
    assert {r["doc_id"]: r["size"] for r in rows} == size and len(rows) == len(corpus_rows)
    sources = sorted({r["source"] for r in rows if r["source"] is not None}) + [None]
    own = {s: sum(r["size"] for r in rows if r["source"] == s) for s in sources}
    weight = {s: weights[i % 3] for i, s in enumerate(sources)}
    target, full = {}, set()
    while True:
        rest = sum(own.values()) - sum(3 * own[s] for s in full)
        level = rest / sum(weight[s] for s in sources if s not in full)
        target = {s: 3 * own[s] if s in full else level * weight[s] for s in sources}
        above = {s for s in sources if target[s] > 3 * own[s]}
        if not above:
            break
        full |= above
    for s in sources:
        mine = [r for r in rows if r["source"] == s]
        assert mine[0]["target"] == pytest.approx(target[s]) and mine[0]["source_size"] == own[s]
        assert abs(sum(r["taken"] for r in mine) - target[s]) <= max(r["size"] for r in mine) / 2 + 1e-6
    assert all(r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0) for r in rows)
    copies = {}
    for r in mixing.mixed_documents(docs, weights).collect():
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    assert copies == {r["doc_id"]: r["copies"] for r in rows if r["copies"]}
    assert mixing.mix(docs.limit(0), weights).count() == 0
    assert mixing.mixed_documents(docs, weights).columns == docs.columns


def test_mixing_prefers_long_documents(spark):
    """Inclusion grows with size within a source, so the order is not that of the random numbers; repeated rows keep equal shares."""
    rows = [(i, "w " * (20 if i % 2 else 2000), f"s{i % 3}") for i in range(900)] + [(5, "w " * 20, "s2")] * 2
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), [1.0, 2.0, 3.0]).collect()
    assert len(got) == len(rows) and all(0 <= r["copies"] <= 3 for r in got)
    for s in ("s0", "s1", "s2"):
        mine = [r for r in got if r["source"] == s]
        ratio = mine[0]["target"] / mine[0]["source_size"]
        mean = lambda big: np.mean([r["copies"] for r in mine if (r["size"] > 100) == big])
        assert mean(True) > mean(False) + 0.05 or ratio == 3
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 1000 + 1e-6


def test_mixing_caps(spark):
    rows = spark.createDataFrame([(1, "w " * 10, "a"), (2, "w " * 1000, "b"), (3, None, "c"), (4, "w", None)], "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in mixing.mix(rows, [1.0, 2.0, 3.0]).collect()}
    assert got[1]["target"] == 30 and got[1]["taken"] == 30 and got[3]["target"] == 0 and got[3]["taken"] == 0 and got[4]["target"] == 3
    assert got[2]["target"] == pytest.approx(1011 - 33)


# ---- 1


def junk(rng, kind, n=40):
    w = [f"word{rng.randrange(300)}" for _ in range(n)]
    return [" ".join(x.upper() + "!!" for x in w), " | ".join(w), " ".join(x + "###" for x in w), "click here now\n" * 12][kind]


def test_quality(spark):
    import random

    from llm_samples import prose

    rng = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        good = i % 3 > 0
        rows.append((i, prose(rng, rng.randrange(20, 90)).capitalize() + "." if good else junk(rng, rng.randrange(4))))
        labels.append((i, int(good), 0))
    rows += [(1000, None), (1001, ""), (1002, "x" * 200000), (None, "no id here"), (1003, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("quality", F.lit(3)).withColumn("features", F.lit("x"))
    marks = spark.createDataFrame([*labels, (5, None, 0), (6, 7, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    featured = quality.with_features(docs)
    got = {r["doc_id"]: r["score"] for r in quality.scored(featured, quality.train(featured, marks)).collect()}
    assert len(got) == len({r[0] for r in rows}) and all(0 <= s <= 1 for s in got.values())
    held = [i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(got[i] >= 0.5) == (i % 3 > 0) for i in held]) > 0.95
    model = quality.train(quality.sample_features(docs, marks), marks)
    kept = quality.accepted(docs, model)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, s in got.items() if s >= 0.5}
    assert quality.scored(featured.limit(0), model).count() == 0
    blank = quality.train(featured, marks.limit(0))
    assert {r["score"] for r in quality.scored(featured, blank).collect()} == {0.5}


def brute_features(text):
    """Of one text, by plain Python, as far as they do not depend on hashes."""
    raw = (text or "").encode()
    size, found = max(len(raw), 1), words(text)
    lower, upper = sum(97 <= c <= 122 for c in raw), sum(65 <= c <= 90 for c in raw)
    out = {"words": np.log1p(len(found)), "upper": upper / max(lower + upper, 1), "digits": sum(48 <= c <= 57 for c in raw) / size, "lines": raw.count(10) / size, "non_ascii": sum(c > 127 for c in raw) / size}
    if found:
        lines = [tuple(w) for w in map(words, text.split("\n")) if w]
        out |= {
            "word_length": np.mean([len(w.encode()) for w in found]), "distinct_words": len(set(found)) / len(found), "top_word": max(map(found.count, set(found))) / len(found),
            "short_words": np.mean([len(w.encode()) <= 3 for w in found]), "distinct_lines": len(set(lines)) / len(lines), "longest_line": np.log1p(max(map(len, lines))),
            "distinct_bigrams": len(set(zip(found, found[1:]))) / (len(found) - 1) if len(found) > 1 else 1, "capitals": np.mean(["A" <= w[0] <= "Z" for w in found]),
        }
    return out


def test_quality_against_brute_force(spark, corpus_rows):
    """Features of every text, and scores added up entry by entry; repeated ids are scored row by row."""
    texts = [t for _, t in corpus_rows]
    got = quality.features(pa.array(texts, pa.string()))
    for row, text in zip(got, texts):
        want = brute_features(text)
        assert {n: row[quality.FEATURES.index(n)] for n in want} == pytest.approx(want, rel=1e-5, abs=1e-6)
    y = (got[:, 12] > np.median(got[:, 12])).astype(float)
    model = quality.fit(got, y)
    for row, score in zip(got, model.score(got)):
        total = model.base
        for cuts, table, x in zip(model.cuts, model.tables, row):
            total += table[sum(c <= x for c in cuts)]
        for i, j, ci, cj, table in model.pairs:
            total += table[sum(c <= row[i] for c in ci), sum(c <= row[j] for c in cj)]
        assert score == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-9)
    rows = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (1, "other words")], "doc_id long, text string")
    scores = [r["score"] for r in quality.scored(quality.with_features(rows), model).collect()]
    assert len(scores) == 3 and len(set(scores)) <= 2


def test_gam_learns_a_pair():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality.fit(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.9 and {0, 1} in [{i, j} for i, j, *_ in model.pairs]


# ---- 8


PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute_base(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == 0 or kind == 1 and all(int(p) <= 255 for p in m[0].split(".")) or kind == 2 and 16 <= len(d) <= 19 and pii.luhn(d) or kind == 3 and 8 <= len(d) <= 15:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    piece = st.sampled_from(["a", "b.c", "@", "+", "1", "22", "255", "256", ".", "-", " ", "(", ")", "4111111111111111", "4111 1111 1111 1111", "é", "0001", "1.2.3.4", "x@y.zz", "+1 (988) 555-2485", "\n", "_"])

    @settings(max_examples=1500, deadline=None)
    @given(st.lists(piece, max_size=14))
    def same(parts):
        text = "".join(parts)
        assert pii.base_spans(text)[0] == brute_base(text)

    same()


def test_pii(spark):
    import random

    rng = random.Random(4)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card():
        body = "4" + digits(14)
        return next(body + c for c in "0123456789" if pii.luhn(body + c))

    phone = lambda: f"+1 ({rng.randrange(200, 999)}) 555-{digits(4)}"
    rows = []
    for i in range(400):
        mail = f"bob{i}.{i % 90}@mail{i % 7}.example.com" if i % 3 else f"{'abcdefgh'[i // 8 % 8] * 3}{i % 10}@site{i % 9}.net"
        thing = [mail, phone(), card(), f"{i % 200 + 1}.{i % 250}.7.{i % 99}", f"{i * 37}", f"{i}.5", digits(7), "no data"][i % 8]
        rows.append((i, f"some words before {thing} and after."))
    pair = [(phone(), card()) for _ in range(12)]
    rows += [(1000 + i, f"words {a} {b} more") for i, (a, b) in enumerate(pair)]
    spelt = [(f"ann{i} at mail{i} dot example dot org", f"tom{i}[at]site{i}.net", f"eve{i} (at) post{i} (dot) de")[i % 3] for i in range(30)]
    rows += [(1100 + i, f"please write to {t} for more of it") for i, t in enumerate(spelt)]
    plain = [f"({rng.randrange(200, 999)}) 555-{digits(4)}" for i in range(30)]
    rows += [(1200 + i, f"please call {t} for more of it") for i, t in enumerate(plain)]
    clean = ["look at the dot on the map", "version 10.2.300.4000 and 3.14", "pages 1000 1037 1074 1111 1148 1185 1222 1259 1296", "in 2019-2020 and 1998", "we met at noon. Dot was there"]
    rows += [(1300 + i, t) for i, t in enumerate(clean)]
    rows += [(2000, None), (2001, ""), (2002, "1" * 100000), (2003, "a@" * 3000), (2004, "1." * 5000), (None, "x y@z.com")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1)).withColumn("n_chars", F.lit(0))
    model = pii.learn(docs)
    found = {r["doc_id"]: r for r in pii.detect(docs, model).collect()}
    texts = dict(rows)
    for i, t in rows:
        assert [(pii.KINDS.index(s["kind"]), s["start"], s["end"]) for s in found[i]["base"]] == brute_base(t or "")
        assert {tuple(s) for s in found[i]["base"]} <= {tuple(s) for s in found[i]["spans"]}
    caught = [sorted((s["kind"], texts[1000 + i][s["start"] : s["end"]]) for s in found[1000 + i]["spans"]) for i in range(12)]
    assert sum(c == sorted([("card", b), ("phone", a)]) for c, (a, b) in zip(caught, pair)) >= 10
    assert all(not found[i]["spans"] for i in range(400) if i % 8 in (4, 5, 6, 7))
    whole = lambda i, t: any(texts[i][s["start"] : s["end"]] == t for s in found[i]["spans"])
    recall = {n: sum(whole(at + i, t) for i, t in enumerate(v)) / len(v) for n, at, v in (("spelled out", 1100, spelt), ("without a plus sign", 1200, plain))}
    print("run together", sum(c == sorted([("card", b), ("phone", a)]) for c, (a, b) in zip(caught, pair)) / 12, recall)
    assert min(recall.values()) >= 0.75
    assert [found[1300 + i]["spans"] for i in range(len(clean))] == [[]] * len(clean)
    safe = {r["doc_id"]: r["text"] for r in pii.redact(docs, model).collect()}
    assert safe[0] == "some words before [EMAIL] and after." and safe[2000] is None and safe[2001] == "" and safe[7] == texts[7]
    assert pii.redact(docs, model).columns == docs.columns
    assert pii.detect(docs.limit(0), pii.learn(docs.limit(0))).count() == 0


def test_pii_candidates_against_brute_force():
    """What is proposed in digits is what a pattern matches at any place, looked for one by one."""
    rng = np.random.default_rng(3)
    parts = ["4", "411", "1111", "555", "+", "(415)", " ", "-", ".", "00", "a", "4111111111111111", "192.168.7.1", " 555-0100", "1 "]
    for _ in range(300):
        text = "".join(rng.choice(parts, rng.integers(1, 14)))
        zones = [(z.start(), z.end()) for z in pii._ZONE.finditer(text)]
        want = {(k, m.start(), m.end()) for k, p in pii._WITHIN for i in range(len(text)) if (m := p.match(text, i)) and any(a <= m.start() and m.end() <= b + 1 for a, b in zones)}
        got = {c for c in pii.candidates(text, []) if c[0]}
        assert {c for c in want if any(a <= c[1] and c[2] <= b for a, b in zones)} <= got <= want


def test_pii_candidates_in_long_zones():
    """The same readings of a number table are proposed in a short and in a long line, whatever group they start at."""
    groups = [f"{1000 + 37 * k % 9000}" for k in range(400)]
    line = " ".join(groups)
    assert len(line) > 200
    found = {(a, b) for kind, a, b in pii.candidates(line, []) if kind == 2}
    assert found == {(5 * k, 5 * k + 19) for k in range(len(groups) - 3)}
    card = "4111 1111 1111 1111"
    for k in range(4):
        text = " ".join([*groups[:k], card, *groups[4:60]])
        assert (2, 5 * k, 5 * k + 19) in pii.candidates(text, [])
