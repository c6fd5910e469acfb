"""DuckDB SQL that says the same as the plans, written by itself: pieces that several queries share."""

from __future__ import annotations

from semaloom.functions.text import ABBREVIATIONS, DELIMITERS

_DELIMITERS = "'" + DELIMITERS.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '").replace("\r", "' || chr(13) || '") + "'"


def tokens(text: str, abbrev: bool) -> str:
    """Tokens of a SQL expression."""
    camel = f"regexp_replace(regexp_replace(coalesce({text}, ''), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g')"
    plain = f"lower(regexp_replace(translate({camel}, {_DELIMITERS}, '{' ' * len(DELIMITERS)}'), '[^A-Za-z0-9 ]+', '', 'g'))"
    base = f"list_filter(string_split({plain}, ' '), lambda t: length(t) BETWEEN 2 AND 255)[1:512]"
    if not abbrev:
        return base
    table = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in ABBREVIATIONS.items()) + "}"
    return f"list_transform([{base}], lambda b: list_concat(b, list_filter(list_transform(b, lambda t: {table}[t]), lambda e: e IS NOT NULL))[1:512])[1]"


def documents(abbrev: bool = False) -> str:
    """CTEs tok (doc_id, tokens), post (token, doc_id, tf), vocab (token, df, idf) of the documents."""
    return f"""
tok AS (SELECT doc_id, tokens FROM (SELECT doc_id, {tokens('text', abbrev)} AS tokens FROM documents) WHERE len(tokens) BETWEEN 1 AND 512),
post AS (SELECT token, doc_id, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(tokens) AS token FROM tok) GROUP BY ALL),
vocab AS (SELECT token, count(*)::BIGINT AS df, ln((SELECT count(*) FROM tok)::DOUBLE / count(*)) AS idf FROM post GROUP BY token)"""


def vectors(dim: int, abbrev: bool = False) -> str:
    """The above and enr (token, d, q), unit and mean of the documents, dq (doc_id, d, q), dm (doc_id, inv)."""
    return documents(abbrev) + f""",
src AS (SELECT token, d, ((('0x' || substr(md5(token || ':' || d), 1, 8))::BIGINT % 255 - 127) / 127.0::DOUBLE) AS v FROM vocab, (SELECT unnest(range({dim})) AS d)),
enr AS MATERIALIZED (SELECT token, d, round_even(round(127 * v / sqrt(sum(v * v) OVER (PARTITION BY token)), 9), 0)::DOUBLE AS q FROM src),
dsum AS (SELECT doc_id, d, sum(tf * idf / 127.0::DOUBLE * q) AS x FROM post JOIN vocab USING (token) JOIN enr USING (token) GROUP BY ALL),
dunit AS MATERIALIZED (SELECT doc_id, d, CASE WHEN sqrt(sum(x * x) OVER w) < 1e-10 THEN x ELSE x / sqrt(sum(x * x) OVER w) END AS x FROM dsum WINDOW w AS (PARTITION BY doc_id)),
mean AS (SELECT d, avg(x) AS m FROM dunit GROUP BY d),
dcen AS (SELECT doc_id, d, x - m AS x FROM dunit JOIN mean USING (d)),
dq AS MATERIALIZED (SELECT doc_id, d, round_even(round(127 * (CASE WHEN sqrt(sum(x * x) OVER w) < 1e-10 THEN x ELSE x / sqrt(sum(x * x) OVER w) END), 9), 0)::BIGINT AS q FROM dcen WINDOW w AS (PARTITION BY doc_id)),
dm AS (SELECT doc_id, CASE WHEN sum(q * q) > 0 THEN 1.0::DOUBLE / sqrt(sum(q * q)::DOUBLE) ELSE 0 END AS inv FROM dq GROUP BY doc_id)"""


def enriched(dim: int) -> str:
    """The same with token vectors enriched by two passes over the documents' co-occurrences."""
    plain = vectors(dim)
    start = plain.index("enr AS MATERIALIZED")
    end = plain.index("dsum AS")
    passes = f"""
pos AS (SELECT doc_id, unnest(tokens) AS t, unnest(range(len(tokens))) AS i FROM tok),
w AS MATERIALIZED (SELECT a.t, b.t AS n, sum(1.0::DOUBLE / abs(a.i - b.i)) AS w FROM pos a JOIN pos b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i - 5 AND a.i + 5 AND a.i <> b.i GROUP BY ALL),
near AS (SELECT w.t AS token, d, sum(w * v) AS x FROM w JOIN src ON src.token = w.n GROUP BY w.t, d),
p1 AS MATERIALIZED (SELECT token, d, round_even(round(127 * y / sqrt(sum(y * y) OVER (PARTITION BY token)), 9), 0)::DOUBLE AS q FROM (SELECT src.token, d, v + coalesce(x, 0) AS y FROM src LEFT JOIN near USING (token, d))),
acc AS (SELECT w.t AS token, d, round_even(round(greatest(-127, least(127, 127 * sum(w * q / 127.0::DOUBLE))), 9), 0)::DOUBLE AS x FROM w JOIN p1 ON p1.token = w.n GROUP BY w.t, d),
blend AS (SELECT p1.token, d, 0.7::DOUBLE * q + 0.3::DOUBLE * coalesce(x, 0) AS y FROM p1 LEFT JOIN acc USING (token, d)),
enr AS MATERIALIZED (SELECT token, d, round_even(round(127 * y / sqrt(sum(y * y) OVER (PARTITION BY token)), 9), 0)::DOUBLE AS q FROM blend),
"""
    return plain[:start] + passes + plain[end:]


def sparse(dim: int, keep: int) -> str:
    """The same with the ``keep`` largest components of token and document vectors; documents are made of dense token vectors."""
    plain = vectors(dim).replace("enr AS MATERIALIZED", "dense AS MATERIALIZED").replace("JOIN enr USING", "JOIN dense USING")
    plain = plain.replace("dq AS MATERIALIZED", "full_dq AS MATERIALIZED")
    thin = lambda rows, key: f"(SELECT {key}, d, CASE WHEN row_number() OVER (PARTITION BY {key} ORDER BY abs(q) DESC, d) <= {keep} THEN q ELSE 0 END AS q FROM {rows})"
    end = plain.index("dm AS (")
    return plain[:end] + f"dq AS MATERIALIZED {thin('full_dq', 'doc_id')},\nenr AS MATERIALIZED {thin('dense', 'token')},\n" + plain[end:]


def queries(abbrev: bool = False) -> str:
    """qtok (query_id, tokens), qterm (query_id, token, n, idf) of the benchmark's texts."""
    return f"""
qtok AS (SELECT item_id AS query_id, {tokens('text', abbrev)} AS tokens FROM benchmark),
qterm AS (SELECT query_id, token, count(*)::BIGINT AS n, any_value(idf) AS idf FROM (SELECT query_id, unnest(tokens) AS token FROM qtok) JOIN vocab USING (token) GROUP BY query_id, token)"""


QUERY_VECTORS = """
qsum AS (SELECT query_id, d, sum(n * idf / 127.0::DOUBLE * q) AS x FROM qterm JOIN enr USING (token) GROUP BY ALL),
qunit AS (SELECT query_id, d, CASE WHEN sqrt(sum(x * x) OVER w) < 1e-10 THEN x ELSE x / sqrt(sum(x * x) OVER w) END AS x, sqrt(sum(x * x) OVER w) AS size FROM qsum WINDOW w AS (PARTITION BY query_id)),
qcen AS (SELECT query_id, d, CASE WHEN size > 1e-10 THEN x - m ELSE x END AS x FROM qunit JOIN mean USING (d)),
qq AS (SELECT query_id, d, round_even(round(127 * (CASE WHEN sqrt(sum(x * x) OVER w) < 1e-10 THEN x ELSE x / sqrt(sum(x * x) OVER w) END), 9), 0)::BIGINT AS q FROM qcen WINDOW w AS (PARTITION BY query_id)),
qm AS (SELECT query_id, CASE WHEN sum(q * q) > 0 THEN 1.0::DOUBLE / sqrt(sum(q * q)::DOUBLE) ELSE 0 END AS inv FROM qq GROUP BY query_id)"""

SCORES = """
score AS (
  SELECT query_id, doc_id, CASE WHEN iq <= 0 OR idd <= 0 THEN 0 ELSE greatest(0, least(1, (dot * iq * idd + 1) / 2)) END AS score
  FROM (SELECT qq.query_id, dq.doc_id, sum(qq.q * dq.q)::DOUBLE AS dot, any_value(qm.inv) AS iq, any_value(dm.inv) AS idd
        FROM qq JOIN dq USING (d) JOIN qm USING (query_id) JOIN dm USING (doc_id) GROUP BY qq.query_id, dq.doc_id)
)"""

KEYWORD = """
cand AS (
  SELECT query_id, doc_id, score FROM (
    SELECT query_id, doc_id, round(sum(n * idf), 9) AS score FROM qterm JOIN post USING (token) GROUP BY query_id, doc_id)
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 2048
)"""

TFIDF = """
cand AS (
  SELECT query_id, doc_id, score FROM (
    SELECT query_id, doc_id, CASE WHEN whole > 0 AND part > 0 THEN round(part / (sqrt(whole) * sqrt(part)), 9) ELSE 0 END AS score
    FROM (SELECT query_id, doc_id, sum(n * idf * idf) AS part FROM qterm JOIN post USING (token) GROUP BY query_id, doc_id)
    JOIN (SELECT query_id, sum(n * idf * idf) AS whole FROM qterm GROUP BY query_id) USING (query_id))
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 2048
)"""


def ranked(rows: str, k: int) -> str:
    """The k best of (query_id, doc_id, score)."""
    return f"""
SELECT query_id, rank, doc_id, round(score, 6) AS score
FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id))::INTEGER AS rank FROM {rows}) WHERE rank <= {k}"""


def fallback(k: int) -> str:
    """Candidates' scores; for queries with fewer than k candidates the scores of all documents."""
    return f"""
few AS (SELECT query_id FROM qm LEFT JOIN (SELECT query_id, count(*) AS n FROM cand GROUP BY query_id) USING (query_id) WHERE inv > 0 AND coalesce(n, 0) < {k}),
picked AS (
  SELECT s.* FROM score s JOIN cand c USING (query_id, doc_id) JOIN qm USING (query_id) WHERE inv > 0 AND query_id NOT IN (SELECT query_id FROM few)
  UNION ALL SELECT s.* FROM score s WHERE query_id IN (SELECT query_id FROM few)
)"""


def dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"


def quantized(v: str) -> str:
    return f"list_transform({v}, lambda x: round_even(greatest(-127, least(127, x::DOUBLE * 127)), 0)::BIGINT)"


def joined(values: str) -> str:
    """A list as text, for comparison."""
    return f"array_to_string({values}, ',')"


def proximity(a: str, b: str) -> str:
    dirs = lambda p: f"list_slice(string_split({p}, '/'), 1, len(string_split({p}, '/')) - 1)"
    same = f"list_transform(list_zip({dirs(a)}, {dirs(b)}), lambda p: coalesce(p[1] = p[2] AND length(p[1]) > 0, false))"
    shared = f"coalesce(list_position({same}, false) - 1, len({same}))"
    most = f"greatest(len({dirs(a)}), len({dirs(b)}))"
    return f"(CASE WHEN {a} IS NULL OR {b} IS NULL OR {most} = 0 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE + {shared} / ({most} + 1)::DOUBLE * 0.1::DOUBLE END)"
