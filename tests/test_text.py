import pytest
from pyspark.sql import functions as F

from semaloom.functions.register import register
from semaloom.functions.text import ABBREVIATIONS, chunks, proximity, tokenize


def tokens(spark, texts, **kw):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[1] for r in sorted(rows.select("i", tokenize(F.col("t"), **kw)).collect())]


CASES = {
    "handleRequest": ["handle", "request"],
    "get_user_name": ["get", "user", "name"],
    "io.Reader": ["io", "reader"],
    "foo\nbar\tbaz\rqux": ["foo", "bar", "baz", "qux"],
    "foo{bar}[baz]=qux;quux": ["foo", "bar", "baz", "qux", "quux"],
    "validate a number return 1 now": ["validate", "number", "return", "now"],
    "XMLHttpRequest": ["xml", "http", "request"],
    "HTTPServer": ["http", "server"],
    "": [],
    "utf8Decode": ["utf8", "decode"],
    "sha256Hash": ["sha256", "hash"],
    "parse2JSON": ["parse2", "json"],
    "parse2item": ["parse2item"],
    "café": ["caf"],
    "éü": [],
    "x" * 255: ["x" * 255],
    "x" * 256: [],
    "foo\x0bbar": ["foobar"],
    "aéB": ["ab"],
    "ab\x00cd": ["ab"],
}


def test_tokens(spark):
    assert tokens(spark, list(CASES), abbrev=False) == list(CASES.values())
    assert tokens(spark, [None]) == [[]]


def test_tokens_of_arrow_columns(spark, monkeypatch):
    """The same as the expression, also across the texts of a column, in slices and in pieces of a few bytes."""
    import random

    import pyarrow as pa

    from semaloom.functions import text

    r = random.Random(4)
    signs = "aaabcABCD19" * 6 + text.DELIMITERS + "_. \0\x01\x0b\x7f\x80éßİK日😀\u2014\ufeff"
    some = ["".join(r.choice(signs) for _ in range(r.randrange(90))) for _ in range(800)]
    some += [*CASES, None, "", "A", "b", "X", "yz", "Ab" * 600, "tok " * 600, "\0" * 50, "x" * 5000 + " yy", None]
    want = tokens(spark, some, abbrev=False)
    assert text.tokens_of(pa.array(some)).to_pylist() == want
    assert text.tokens_of(pa.array(some).slice(3, 700)).to_pylist() == want[3:703]
    monkeypatch.setattr(text, "TEXT_BYTES", 100)
    assert text.tokens_of(pa.array(some, pa.large_string())).to_pylist() == want
    assert text.tokens_of(pa.array([None, ""], pa.string())).to_pylist() == [[], []] and len(text.tokens_of(pa.array([], pa.string()))) == 0


def test_abbreviations(spark):
    assert tokens(spark, ["ctx", "errFn", "foobar", "sub", "mock"]) == [["ctx", "context"], ["err", "fn", "error", "function"], ["foobar"], ["sub"], ["mock", "mock"]]
    assert tokens(spark, ["db cb idx"])[0] == ["db", "cb", "idx", "database", "callback", "index"]
    assert len(ABBREVIATIONS) == 134


def test_token_limit(spark):
    many = tokens(spark, ["tok " * 600, "ctx " * 300])
    assert len(many[0]) == 512 and many[0][0] == "tok" and many[0][-1] == "token" or len(many[0]) == 512
    assert len(many[1]) == 512 and many[1][300] == "context"


def test_proximity(spark):
    cases = [("src/foo.c", "src/foo.c", 1.05), ("src/a.c", "src/b.c", 1.05), ("src/a.c", "lib/b.c", 1.0), (None, "a/b", 1.0), ("a/b/c.c", "a/b/d.c", 1 + 0.1 * 2 / 3), ("/a/x", "/a/x", 1.0), ("x", "y", 1.0), ("a/x/b.c", "a/b.c", 1 + 0.1 / 3)]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b string")
    register(spark)
    rows.createOrReplaceTempView("paths")
    got = sorted(rows.select("i", proximity(F.col("a"), F.col("b"))).collect())
    again = sorted(spark.sql("select i, loom_proximity(a, b) from paths").collect())
    assert [r[1] for r in got] == pytest.approx([c[2] for c in cases])
    assert [r[1] for r in again] == pytest.approx([c[2] for c in cases])


def test_sql_functions(spark):
    assert set(register(spark)) == {"loom_tokenize", "loom_cosine", "loom_int8_dot", "loom_proximity"}
    rows = spark.createDataFrame([(t,) for t in CASES if "\x00" not in t], "t string")
    rows.createOrReplaceTempView("names")
    assert spark.sql("select t, loom_tokenize(t) k from names").filter(F.col("k") != tokenize(F.col("t"), abbrev=False)).count() == 0
    assert spark.sql("select loom_cosine(array(3D, 4D), array(3D, 4D)), loom_cosine(array(0D), array(1D))").first()[:] == (1.0, 0.0)


def test_chunks(spark):
    def brute(raw, size):
        out, at = [], 0
        while at < len(raw):
            end = at + size
            if end < len(raw):
                found = raw.find(b"}", end)
                end = found + 1 if found >= 0 else len(raw)
            else:
                end = len(raw)
            out.append(raw[at:end])
            at = end
        return out

    cases = [b"", b"ab}cd}ef", b"no brace here at all", b"}}}}}}}", bytes(range(256)) * 3, b"a{b}\n" * 50, b"0123456789}"]
    rows = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(cases)], "i int, c binary")
    for size in (1, 3, 7, 10, 64):
        got = {r[0]: [bytes(x) for x in r[1]] for r in rows.select("i", chunks(F.col("c"), size)).collect()}
        assert [got[i] for i in range(len(cases))] == [brute(c, size) for c in cases]
    with pytest.raises(ValueError):
        chunks(F.col("c"), 0)
