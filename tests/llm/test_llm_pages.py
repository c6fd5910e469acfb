"""Operators on pages."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from semaloom.llm import page_samples, url_filter
from semaloom.llm.html_extract import blocks_of, content_of, costs_of, extract_main_text, learned, main_text, min_cut


def wrap(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a='<p>x</p>';</script></head><body>{body}</body></html>"


LONG = "This is a sentence of an article that goes on for quite a while, as they do."
CASES = [
    (f"<nav><a href=/a>A</a></nav><article><h1>Title &amp; more</h1><p>{LONG}<p>Second &lt;one&gt; <b>bo</b>ld.</article><footer>Foot {LONG}</footer>", f"Title & more {LONG} Second <one> bold."),
    (f"<header><h1>Site</h1><p>{LONG}</p></header><main><p>{LONG}</p><aside>{LONG}</aside><p>{LONG}</p></main>", f"{LONG} {LONG}"),
    (f"<div class='sidebar'><p>{LONG}</p></div><div id=content><h1>Head</h1><p>{LONG}</p><ul><li>one</li><li>two</li></ul></div><div class=\"cookie-notice\">{LONG}</div>", f"Head {LONG} one two"),
    (f"<article><p>{LONG}</p><form><label>Name</label><input><button>Go</button></form><section class=comments><h2>Comments</h2><p>{LONG}</p></section><p>End.</p></article>", f"{LONG} End."),
    (f"<article><p>a\n\t b&nbsp;c<br>d</p><!-- {LONG} --><p hidden>no</p><noscript>no</noscript><p>e</p></article>", "a b c d e"),
    (f"<article><header><h1>Head</h1></header><p>{LONG}</p><div class=ad>{LONG}</div></article>", f"Head {LONG}"),
    (f"<p>{LONG}</p><p>1 < 2 &copy; &unknown; &#65;&#x42;</p>", f"{LONG} 1 < 2 © &unknown; AB"),
    (f"<div role=navigation>{LONG}</div><p>{LONG}</p>", LONG),
    (f"<div class='layout with-sidebar'><article class='post'><div class=entry-header><h1>Head</h1></div><p>{LONG}</p></article></div>", f"Head {LONG}"),
    (f"<div class=comments><article class=comment><p>{LONG}</p></article></div><article><p>{LONG} <select><option>no</select></p></article>", LONG),
    (f"<div class=post><h2>Head</h2><svg><p>{LONG}</p><div class='share social'><a href=x>Share</a></div><p>{LONG}</p></div>", f"Head {LONG} {LONG}"),
]


#: Names that the classifier does not know, names whose known word is not what they are about, and no names.
FOREIGN = [
    (f"<section id=search-engine-history><p>{LONG}</p><p>{LONG}</p></section>", f"{LONG} {LONG}"),
    (f"<div class='tags-article'><p>{LONG}</p></div>", LONG),
    (f"<div class=inhalt><h1>Ein Titel</h1><p>{LONG}</p><p>Kurz</p></div><div class=fusszeile><p>© 2020 Foo. Alle Rechte vorbehalten.</p></div>", f"Ein Titel {LONG} Kurz"),
    (f"<p>{LONG}</p><p>{LONG}</p><p>© 2020 Example. All rights reserved.</p>", f"{LONG} {LONG}"),
    (f"<div class=kopfteil><a href=/>Home</a> <a href=/b>Blog</a></div><div><h1>Titel</h1><p>{LONG}</p></div>", f"Titel {LONG}"),
]


@pytest.mark.parametrize("body,want", FOREIGN)
def test_foreign_names(body, want):
    assert main_text(wrap(body)) == want


def test_cut_improves_the_classifier():
    """On made-up pages that the classifier has not seen: blocks labelled by the cut against those with positive costs."""
    weights, wrong, changed, n = learned(), [0, 0], 0, 400
    for page in page_samples.pages(n, seed=99):
        blocks, labels = page_samples.labelled(page)
        found, within = blocks_of(page)
        if len(found) != len(blocks):
            continue
        alone, cut = [c > 0 for c in costs_of(blocks, weights)], content_of(blocks, within, weights)
        changed += alone != cut
        for k, judged in enumerate((alone, cut)):
            wrong[k] += sum(a != bool(b) for a, b in zip(judged, labels, strict=True))
    print(f"the cut changes {changed} of {n} pages; wrong blocks {wrong[0]} without, {wrong[1]} with it")
    assert changed > n // 20 and wrong[1] < 0.95 * wrong[0]


@pytest.mark.parametrize("body,want", CASES)
def test_main_text(body, want):
    assert main_text(wrap(body)) == want


def test_broken_pages():
    assert main_text(None) == main_text("") == main_text("<html>") == main_text("<!-- open") == ""
    assert main_text("just text.") == "just text."
    assert main_text("<article><p>cut off in a ta<a href='") == "cut off in a ta"
    assert main_text("<article><p>one &am") == "one &am"
    assert main_text("</div></p><article><p>stray ends</div></article>") == "stray ends"
    assert len(main_text("<article>" + "<p>" + "word " * 200000 + "</article>")) == 999_999
    main_text("<div>" * 5000 + "x" + '<a "' * 5000)
    main_text("<p class='" * 3000)


def test_min_cut_is_minimal():
    rng = random.Random(0)
    for _ in range(60):
        n = rng.randrange(1, 7)
        costs = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 2)) for a, b in itertools.combinations(range(n + 1), 2) if rng.random() < 0.5]

        def price(keep):
            return sum(c for c, k in zip(costs, keep) if c > 0 and not k) - sum(c for c, k in zip(costs, keep) if c < 0 and k)

        def whole(keep):
            return min(price(keep) + sum(c for a, b, c in edges if ([*keep, extra][a] != [*keep, extra][b])) for extra in (True, False))

        best = min(whole(list(k)) for k in itertools.product((True, False), repeat=n))
        assert whole(min_cut(costs, edges, n + 1)) == pytest.approx(best)


def test_extract(spark):
    rows = spark.createDataFrame([(i, f"http://h/{i}", None if i == 3 else "" if i == 4 else wrap(b)) for i, (b, _) in enumerate([*CASES, CASES[0]])] + [(None, None, wrap(CASES[0][0]))], "page_id long, url string, html string")
    got = extract_main_text(rows.withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit(1)))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    texts = {r["page_id"]: r for r in got.collect()}
    for i, (_, want) in enumerate([*CASES, CASES[0]]):
        want = "" if i in (3, 4) else want
        assert texts[i]["text"] == want and texts[i]["n_chars"] == len(want)
    assert texts[None]["text"] == CASES[0][1] and extract_main_text(rows.limit(0)).count() == 0


def brute_verdict(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    tail = rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fit = [(len(h + p), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[2:0:-1] if fit else (None, default)))


URLS = [
    None, "", "no scheme", "http://", "http://Example.NET/en/1", "https://a.b.example.net/en/", "http://example.net/en", "http://xexample.net/en/1", "ftp://net/x", "http://net", "http://net?x=/", "http://a.org/fr/?q#f",
    "http://a.org/FR/", "http://example.com/de/x/../y", "http://WWW.example.com:80/de/", "x://y://z.net/a", "http://.net/", "http://a..net/b", "http://é.net/ü", "http://a.net\n/b", "http://" + "a." * 3000 + "net/" + "x/" * 3000, "http://net./x",
]


def test_url_verdicts(spark):
    rules = [*url_filter.RULES, ("example.net", "/en/1", "block"), ("b.example.net", "", "allow"), ("net", "/", "allow")]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(URLS + URLS[4:8])] + [(None, "http://net/")], "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("rule", F.lit(1))
    for case in (url_filter.RULES, rules):
        got = url_filter.url_verdicts(rows, url_filter.rules_frame(spark, case), keep=["page_id"])
        effective = [r for r in case if r != ("net", "/", "allow")]  # of two verdicts for one rule, block wins
        found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got.collect()}
        for i, u in enumerate(URLS + URLS[4:8]):
            assert found[i] == brute_verdict(u, effective), u
        assert got.count() == len(URLS) + 5
    none = url_filter.url_verdicts(rows, url_filter.rules_frame(spark, []), keep=["page_id"])
    assert {r["verdict"] for r in none.collect()} == {"allow"} and url_filter.url_verdicts(rows.limit(0), url_filter.rules_frame(spark, rules), keep=["page_id"]).count() == 0
