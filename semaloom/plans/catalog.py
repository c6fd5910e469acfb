"""The registered queries of the engine's own operators, each with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from semaloom.config import EngineConfig, Mode
from semaloom.functions import vectors as V
from semaloom.functions.text import proximity, tokenize
from semaloom.operators import cooccurrence, corpus, dense, graph, metrics, scores, search
from semaloom.operators.packed import Packed
from semaloom.plans import sql
from semaloom.runtime import cut, spread, table
from semaloom.sources.token_vectors import DigestVectors

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
DIM, TOP = 8, 10


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return keep


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text", "lang"), "doc_id")


def _docs(spark: SparkSession, d: str, abbrev: bool = False) -> DataFrame:
    """(doc_id, tokens) of the accepted documents."""
    return corpus.accepted(_texts(spark, d).select("doc_id", tokenize(F.col("text"), abbrev).alias("tokens")))


_BUILT: dict[tuple[str, str, str], corpus.Corpus] = {}


def _corpus(spark: SparkSession, d: str, dim: int = DIM, **settings: object) -> corpus.Corpus:
    """The documents' corpus, built once per application, input and settings."""
    config = EngineConfig.of(dim, abbrev=False, **settings)
    key = (spark.sparkContext.applicationId, d, config.to_json())
    if key not in _BUILT:
        builder = corpus.CorpusBuilder(spark, config).add_texts(_texts(spark, d))
        _BUILT[key] = builder.finalize(DigestVectors(dim))
    return _BUILT[key]


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _text(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda x: x.cast("string")), ",")


# ---- tokens and corpus statistics


@query(f"SELECT doc_id, len(t)::BIGINT AS n, array_to_string(t, ' ') AS tokens FROM (SELECT doc_id, {sql.tokens('text', False)} AS t FROM documents)")
def tokenize_documents(spark, d):
    t = tokenize(F.col("text"), abbrev=False)
    return _texts(spark, d).select("doc_id", t.alias("t")).select("doc_id", F.size("t").cast("long").alias("n"), F.array_join("t", " ").alias("tokens"))


@query(f"SELECT page_id, len(t)::BIGINT AS n, md5(array_to_string(t, ' ')) AS digest FROM (SELECT page_id, {sql.tokens('html', False)} AS t FROM pages)")
def tokenize_pages(spark, d):
    t = tokenize(F.col("html"), abbrev=False)
    return table(spark, d, "pages").select("page_id", t.alias("t")).select("page_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ")).alias("digest"))


@query(f"SELECT page_id, len(t)::BIGINT AS n, array_to_string(t[greatest(1, len(t) - 5):], ' ') AS last FROM (SELECT page_id, {sql.tokens('html', True)} AS t FROM pages)")
def abbrev_expand(spark, d):
    t = table(spark, d, "pages").select("page_id", tokenize(F.col("html")).alias("t"))
    return t.select("page_id", F.size("t").cast("long").alias("n"), F.array_join(F.slice("t", F.greatest(F.lit(1), F.size("t") - 5), F.lit(6)), " ").alias("last"))


@query(f"SELECT lang, count(*)::BIGINT AS docs, min(len(t))::BIGINT AS least, max(len(t))::BIGINT AS most, sum(len(t))::BIGINT AS total FROM (SELECT lang, {sql.tokens('text', False)} AS t FROM documents) GROUP BY lang")
def token_stats(spark, d):
    n = F.size(tokenize(F.col("text"), abbrev=False)).cast("long")
    return _texts(spark, d).select("lang", n.alias("n")).groupBy("lang").agg(F.count("*").alias("docs"), F.min("n").alias("least"), F.max("n").alias("most"), F.sum("n").alias("total"))


@query(f"SELECT lang, count(*)::BIGINT AS docs FROM (SELECT lang, {sql.tokens('text', False)} AS t FROM documents) WHERE len(t) BETWEEN 1 AND 512 GROUP BY lang")
def doc_reject_filter(spark, d):
    docs = table(spark, d, "documents").select("lang", tokenize(F.col("text"), abbrev=False).alias("tokens"))
    return corpus.accepted(docs).groupBy("lang").agg(F.count("*").alias("docs"))


@query("SELECT page_id, CASE WHEN ok THEN (sum(ok::INT) OVER (ORDER BY page_id) - 1)::BIGINT ELSE -1 END AS doc_no FROM "
       f"(SELECT page_id, len(string_split(url, '/')) BETWEEN 1 AND 5 AS ok FROM pages)")  # fmt: skip
def batch_doc_map(spark, d):
    docs = table(spark, d, "pages").select("page_id", F.split("url", "/").alias("tokens"))
    return corpus.doc_map(docs, "page_id", most=5)


@query(f"WITH {sql.documents()} SELECT token, df, round(idf, 6) AS idf FROM vocab")
def vocab_df_idf(spark, d):
    docs = cut(_docs(spark, d))
    return corpus.vocab_of(corpus.postings_of(docs), docs.count()).select("token", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {sql.documents()} SELECT * FROM post")
def term_frequency(spark, d):
    return corpus.postings_of(_docs(spark, d))


@query(f"WITH {sql.documents()} SELECT token, count(*)::BIGINT AS df, sum(doc_id)::BIGINT AS ids, min(doc_id) AS first, max(doc_id) AS last FROM post GROUP BY token")
def inverted_index(spark, d):
    p = corpus.postings_of(_docs(spark, d))
    return p.groupBy("token").agg(F.count("*").alias("df"), F.sum("doc_id").alias("ids"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


@query(f"""WITH {sql.documents()}, pos AS (SELECT doc_id, unnest(tokens) AS token, unnest(range(len(tokens))) AS i FROM tok)
SELECT token, (row_number() OVER (ORDER BY d, i) - 1)::BIGINT AS token_id FROM (SELECT token, min(doc_id) AS d, arg_min(i, (doc_id, i)) AS i FROM pos GROUP BY token)""")
def vocab_first_seen_ids(spark, d):
    return corpus.first_seen(_docs(spark, d))


@query(f"""WITH {sql.documents()}, pos AS (SELECT doc_id, unnest(tokens) AS t, unnest(range(len(tokens))) AS i FROM tok)
SELECT a.t, b.t AS n, round(sum(1.0::DOUBLE / abs(a.i - b.i)), 6) AS w FROM pos a JOIN pos b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i - 5 AND a.i + 5 AND a.i <> b.i GROUP BY ALL""")
def cooccurrence_weights(spark, d):
    return cooccurrence.weights(_docs(spark, d)).select("t", "n", F.round("w", 6).alias("w"))


# ---- vectors


@query(f"""WITH {sql.vectors(DIM)} SELECT token, d::INTEGER AS d, q::BIGINT AS q FROM enr""")
def token_vectors(spark, d):
    return _corpus(spark, d).enriched.select("token", F.posexplode("q").alias("d", "q")).select("token", "d", F.col("q").cast("long").alias("q"))


@query(f"""WITH {sql.vectors(DIM)} SELECT doc_id, d::INTEGER AS d, q, round(inv, 9) AS inv_mag FROM dq JOIN dm USING (doc_id)""")
def doc_vectors(spark, d):
    v = _corpus(spark, d).doc_vectors
    return v.select("doc_id", F.posexplode("q").alias("d", "q"), F.round("inv_mag", 9).alias("inv_mag")).withColumn("q", F.col("q").cast("long"))


@query(f"""WITH {sql.vectors(DIM)} SELECT d::INTEGER AS d, round(m, 9) AS m FROM mean""")
def mean_center(spark, d):
    mean = _corpus(spark, d).doc_mean
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(mean)], "d int, m double").select("d", F.round("m", 9).alias("m"))


@query(f"""WITH {sql.vectors(DIM)}, {sql.queries()}, {sql.QUERY_VECTORS} SELECT query_id, d::INTEGER AS d, q FROM qq""")
def query_vector(spark, d):
    c = _corpus(spark, d)
    v = search.query_vectors(c, search.query_tokens(c, _asked(spark, d)))
    return v.filter("inv_mag > 0").select("query_id", F.posexplode("q").alias("d", "q")).withColumn("q", F.col("q").cast("long"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each vector beside the next one."""
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("a"))
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")


_NEXT = "FROM (SELECT vec_id, embedding AS a FROM embeddings) JOIN (SELECT vec_id - 1 AS vec_id, embedding AS b FROM embeddings) USING (vec_id)"


@query(f"SELECT vec_id, round({sql.dot('a', 'b')} / (sqrt({sql.dot('a', 'a')}) * sqrt({sql.dot('b', 'b')})), 6) AS cosine {_NEXT}")
def cosine_pairs(spark, d):
    return _pairs(spark, d).select("vec_id", F.round(V.cosine(F.col("a"), F.col("b")), 6).alias("cosine"))


@query(f"""SELECT vec_id, i::INTEGER AS i, round(x, 6) AS x FROM (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(list_transform(list_transform([sqrt({sql.dot('embedding', 'embedding')})], lambda n: list_transform(embedding, lambda x: 3 * x::DOUBLE / (3 * n))), lambda l: l)[1]) AS x FROM embeddings)""")
def normalize_vectors(spark, d):
    e = table(spark, d, "embeddings")
    v = V.normalize(F.transform("embedding", lambda x: x.cast("double") * 3))
    return e.select("vec_id", F.posexplode(v).alias("i", "x")).withColumn("x", F.round("x", 6))


@query(f"SELECT vec_id, round(list_sum(list_transform(list_zip(a, b), lambda p: abs(p[1]::DOUBLE + 0.5 * p[2]::DOUBLE))), 6) AS total {_NEXT}")
def vec_add_scaled(spark, d):
    s = V.add_scaled(F.col("a"), F.col("b"), 0.5)
    return _pairs(spark, d).select("vec_id", F.round(V.total(F.transform(s, F.abs)), 6).alias("total"))


_Q = sql.quantized("embedding")


@query(f"SELECT vec_id, {sql.joined(_Q)} AS q FROM embeddings")
def quantize_int8(spark, d):
    return table(spark, d, "embeddings").select("vec_id", _text(V.quantize(F.col("embedding"))).alias("q"))


@query(f"SELECT vec_id, round(list_sum(list_transform({_Q}, lambda x: abs(x / 127.0::DOUBLE))), 6) AS total FROM embeddings")
def dequantize(spark, d):
    v = V.dequantize(V.quantize(F.col("embedding")))
    return table(spark, d, "embeddings").select("vec_id", F.round(V.total(F.transform(v, F.abs)), 6).alias("total"))


@query(f"SELECT vec_id, list_sum(list_transform(list_zip({sql.quantized('a')}, {sql.quantized('b')}), lambda p: p[1] * p[2]))::BIGINT AS dot {_NEXT}")
def int8_dot(spark, d):
    return _pairs(spark, d).select("vec_id", V.int8_dot(V.quantize(F.col("a")), V.quantize(F.col("b"))).alias("dot"))


@query(f"SELECT vec_id, round(1 / sqrt(list_sum(list_transform({_Q}, lambda x: x * x))::DOUBLE), 9) AS inv_mag FROM embeddings")
def inv_mag(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(V.inv_mag(V.quantize(F.col("embedding"))), 9).alias("inv_mag"))


_SPARSE = f"""WITH q AS (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest({_Q}) AS v FROM embeddings),
s AS (SELECT * FROM q WHERE v <> 0 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY abs(v) DESC, i) <= 8)"""


@query(_SPARSE + " SELECT vec_id, i::INTEGER AS i, v FROM s")
def sparsify_topk(spark, d):
    s = V.sparsify(V.quantize(F.col("embedding")), 8)
    return table(spark, d, "embeddings").select("vec_id", F.inline(s)).select("vec_id", "i", F.col("v").cast("long").alias("v"))


@query(_SPARSE + " SELECT s.vec_id, sum(s.v * q.v)::BIGINT AS dot FROM s JOIN q ON q.vec_id = s.vec_id + 1 AND q.i = s.i GROUP BY s.vec_id")
def sparse_dot(spark, d):
    return _pairs(spark, d).select("vec_id", V.sparse_dot(V.sparsify(V.quantize(F.col("a")), 8), V.quantize(F.col("b"))).alias("dot"))


_QA, _QB = sql.quantized("a"), sql.quantized("b")
_IDOT = lambda x, y: f"list_sum(list_transform(list_zip({x}, {y}), lambda p: p[1] * p[2]))::DOUBLE"


@query(f"SELECT vec_id, round(greatest(0, least(1, ({_IDOT(_QA, _QB)} / sqrt({_IDOT(_QA, _QA)}) / sqrt({_IDOT(_QB, _QB)}) + 1) / 2)), 6) AS score {_NEXT}")
def unit_score(spark, d):
    a, b = V.quantize(F.col("a")), V.quantize(F.col("b"))
    return _pairs(spark, d).select("vec_id", F.round(V.unit_score(V.int8_dot(a, b), V.inv_mag(a), V.inv_mag(b)), 6).alias("score"))


# ---- paths and pair scores


@query("WITH p AS (SELECT page_id, substr(url, strpos(url, '://') + 3) AS a FROM pages), n AS (SELECT page_id - 1 AS page_id, a AS b FROM p) "
       f"SELECT page_id, round({sql.proximity('a', 'b')}, 9) AS proximity FROM p JOIN n USING (page_id)")  # fmt: skip
def path_proximity(spark, d):
    p = table(spark, d, "pages").select("page_id", F.expr("substr(url, locate('://', url) + 3)").alias("a"))
    n = p.select((F.col("page_id") - 1).alias("page_id"), F.col("a").alias("b"))
    return p.join(n, "page_id").select("page_id", F.round(proximity(F.col("a"), F.col("b")), 9).alias("proximity"))


def _functions(spark: SparkSession, d: str) -> DataFrame:
    """Function descriptions made of the embeddings."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    path = F.concat(F.lit("src/m"), F.pmod("label", F.lit(3)), F.lit("/k"), F.col("label"), F.lit("/f"), F.col("vec_id"), F.lit(".c"))
    tfidf = F.create_map(F.pmod("vec_id", F.lit(5)).cast("int"), F.lit(1.0), (F.lit(10) + F.col("label")).cast("int"), F.lit(2.0))
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("node_id"), path.alias("file_path"), tfidf.alias("tfidf"), e.alias("ri"), F.reverse(e).alias("api"),
        F.transform(e, lambda x: F.abs(x)).alias("type"), F.array_repeat(F.lit(0.0), 64).alias("deco"), F.slice(e, 1, 25).alias("struct_profile"),
    )


_F = """f AS (SELECT vec_id AS node_id, 'src/m' || (label % 3) || '/k' || label || '/f' || vec_id || '.c' AS path, vec_id % 5 AS t1, 10 + label AS t2,
  list_transform(embedding, lambda x: x::DOUBLE) AS ri, list_reverse(list_transform(embedding, lambda x: x::DOUBLE)) AS api, list_transform(embedding, lambda x: abs(x::DOUBLE)) AS ty, embedding[1:25] AS st FROM embeddings),
one AS (SELECT path AS qpath, t1 AS q1, t2 AS q2, ri AS qri, api AS qapi, ty AS qty, st AS qst FROM f WHERE node_id = 0)"""
_COS = lambda a, b: f"({sql.dot(a, b)} / (sqrt({sql.dot(a, a)}) * sqrt({sql.dot(b, b)})))"
_SIMPLE = f"greatest(0, least(1, ({_COS('qri', 'ri')} + 1) / 2 * {sql.proximity('qpath', 'path')}))"
_COMBINED = (
    f"greatest(0, least(1, {sql.proximity('qpath', 'path')} * (0.2 * ((t1 = q1)::INT + 4 * (t2 = q2)::INT) / 5.0 + 0.25 * {_COS('qri', 'ri')} + 0.15 * {_COS('qapi', 'api')} + 0.1 * {_COS('qty', 'ty')} + 0.1 * {_COS('qst', 'st')})))"
)


def _one(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    f = _functions(spark, d)
    return f.filter("node_id = 0"), f


@query(f"WITH {_F} SELECT node_id, round({_SIMPLE}, 6) AS score FROM f, one")
def simple_score(spark, d):
    q, f = _one(spark, d)
    return scores.simple_search(q, f, None).select("node_id", F.round("score", 6).alias("score"))


@query(f"WITH {_F} SELECT node_id, round({_COMBINED}, 6) AS score FROM f, one")
def combined_score(spark, d):
    q, f = _one(spark, d)
    return scores.search(q, f, None, 0.0).select("node_id", F.round("score", 6).alias("score"))


@query(f"WITH {_F} SELECT node_id, round({_COMBINED}, 6) AS score FROM f, one ORDER BY {_COMBINED} DESC, node_id LIMIT 10")
def rank_topk(spark, d):
    q, f = _one(spark, d)
    return scores.search(q, f, TOP).select("node_id", F.round("score", 6).alias("score"))


@query(f"WITH {_F} SELECT node_id, round({_SIMPLE}, 6) AS score FROM f, one WHERE {_SIMPLE} >= 0.5 ORDER BY {_SIMPLE} DESC, node_id LIMIT 50")
def search_min_score(spark, d):
    q, f = _one(spark, d)
    return scores.simple_search(q, f, 50, 0.5).select("node_id", F.round("score", 6).alias("score"))


@query(f"WITH {_F} SELECT node_id, round(({_COS('qri', 'ri')} + 1) / 2, 6) AS score FROM f, one ORDER BY {_COS('qri', 'ri')} DESC, node_id LIMIT 10")
def rank_flat(spark, d):
    q, f = _one(spark, d)
    return scores.rank_flat(q, f, TOP).select("node_id", F.round("score", 6).alias("score"))


@query(f"""WITH {sql.documents()}, w AS (SELECT doc_id, token, idf FROM post JOIN vocab USING (token)),
m AS (SELECT doc_id, sum(idf * idf) AS s FROM w GROUP BY doc_id),
p AS (SELECT a.doc_id, sum(a.idf * b.idf) AS s FROM w a JOIN w b ON b.doc_id = a.doc_id + 1 AND a.token = b.token GROUP BY a.doc_id)
SELECT a.doc_id, round(CASE WHEN sqrt(a.s) * sqrt(b.s) > 1e-10 THEN coalesce(p.s, 0) / (sqrt(a.s) * sqrt(b.s)) ELSE 0 END, 6) AS cosine
FROM m a JOIN m b ON b.doc_id = a.doc_id + 1 LEFT JOIN p ON p.doc_id = a.doc_id""")
def tfidf_sparse_cosine(spark, d):
    c = _corpus(spark, d)
    w = c.postings.join(c.vocab, "token").select("doc_id", "token", "idf")
    nxt = w.select((F.col("doc_id") - 1).alias("doc_id"), "token", F.col("idf").alias("other"))
    size = w.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("size"))
    after = size.select((F.col("doc_id") - 1).alias("doc_id"), F.col("size").alias("size2"))
    part = w.join(nxt, ["doc_id", "token"]).groupBy("doc_id").agg(F.sum(F.col("idf") * F.col("other")).alias("part"))
    whole = F.col("size") * F.col("size2")
    both = size.join(after, "doc_id").join(part, "doc_id", "left")
    return both.select("doc_id", F.round(F.when(whole > 1e-10, F.coalesce("part", F.lit(0.0)) / whole).otherwise(F.lit(0.0)), 6).alias("cosine"))


# ---- search


def _result(rows: DataFrame) -> DataFrame:
    return rows.select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


_CHAIN = f"WITH {sql.vectors(DIM)}, {sql.queries()}, {sql.QUERY_VECTORS}, {sql.SCORES}"


@query(f"WITH {sql.documents()}, {sql.queries()}, {sql.KEYWORD} " + sql.ranked("cand", 20))
def keyword_candidates(spark, d):
    c = _corpus(spark, d)
    return _result(search.best(search.keyword_candidates(c, search.query_tokens(c, _asked(spark, d))), 20))


@query(f"WITH {sql.documents()}, {sql.queries()}, {sql.TFIDF} " + sql.ranked("cand", 20))
def tfidf_candidates(spark, d):
    c = _corpus(spark, d)
    return _result(search.best(search.tfidf_candidates(c, search.query_tokens(c, _asked(spark, d))), 20))


@query(f"WITH {sql.documents()}, {sql.queries()}, {sql.KEYWORD} SELECT query_id, count(doc_id)::BIGINT AS n FROM qtok LEFT JOIN cand USING (query_id) GROUP BY query_id")
def candidate_count(spark, d):
    c = _corpus(spark, d)
    return search.candidate_count(c, search.query_tokens(c, _asked(spark, d)))


@query(_CHAIN + sql.ranked("score", TOP))
def search_brute(spark, d):
    return _result(search.search(_corpus(spark, d), _asked(spark, d), TOP, Mode.BRUTE))


@query(f"{_CHAIN}, {sql.KEYWORD}, picked AS (SELECT s.* FROM score s JOIN cand USING (query_id, doc_id) JOIN qm USING (query_id) WHERE inv > 0)" + sql.ranked("picked", TOP))
def search_fast(spark, d):
    return _result(search.search(_corpus(spark, d), _asked(spark, d), TOP, Mode.FAST))


@query(f"{_CHAIN}, {sql.KEYWORD}, {sql.fallback(400)}" + sql.ranked("picked", 400))
def search_auto(spark, d):
    return _result(search.search(_corpus(spark, d), _asked(spark, d), 400, Mode.AUTO))


@query(f"{_CHAIN}, {sql.TFIDF}, {sql.fallback(TOP)}" + sql.ranked("picked", TOP))
def search_tfidf(spark, d):
    return _result(search.search(_corpus(spark, d), _asked(spark, d), TOP, Mode.TFIDF))


@query(f"WITH {sql.enriched(DIM)}, {sql.queries()}, {sql.QUERY_VECTORS}, {sql.SCORES}" + sql.ranked("score", TOP))
def search_enriched(spark, d):
    return _result(search.search(_corpus(spark, d, ri=True), _asked(spark, d), TOP, Mode.BRUTE))


@query(f"WITH {sql.sparse(DIM, 4)}, {sql.queries()}, {sql.QUERY_VECTORS}, {sql.SCORES}" + sql.ranked("score", TOP))
def search_sparse(spark, d):
    return _result(search.search(_corpus(spark, d, sparse_nnz=4), _asked(spark, d), TOP, Mode.BRUTE))


@query(f"""{_CHAIN}, {sql.KEYWORD}, fast AS (SELECT query_id, doc_id FROM score JOIN cand USING (query_id, doc_id) JOIN qm USING (query_id) WHERE inv > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score.score DESC, doc_id) <= 10),
brute AS (SELECT query_id, doc_id FROM score QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 10)
SELECT query_id, count(f.doc_id)::BIGINT AS overlap FROM brute b LEFT JOIN fast f USING (query_id, doc_id) GROUP BY query_id""")
def topk_overlap(spark, d):
    c, q = _corpus(spark, d), _asked(spark, d)
    return metrics.overlap(search.search(c, q, TOP, Mode.BRUTE), search.search(c, q, TOP, Mode.FAST))


# ---- graphs and metrics


_EDGES = f"""n AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt({sql.dot('embedding', 'embedding')})) AS v FROM embeddings),
e AS (SELECT a.vec_id AS src, b.vec_id AS dst, list_inner_product(a.v, b.v) AS score FROM n a JOIN n b ON a.vec_id <> b.vec_id WHERE list_inner_product(a.v, b.v) >= 0.35 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY list_inner_product(a.v, b.v) DESC, b.vec_id) <= 10)"""


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.all_pairs(table(spark, d, "embeddings"), "vec_id", "embedding", 64, least=0.35, most=10)


@query(f"WITH {_EDGES} SELECT src, dst, round(score, 6) AS score FROM e")
def all_pairs_edges(spark, d):
    return _edges(spark, d).select("src", "dst", F.round("score", 6).alias("score"))


@query(f"""WITH {_EDGES}, x AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
m AS (SELECT src AS vec_id, i, avg(x) AS m FROM e JOIN x ON x.vec_id = e.dst GROUP BY src, i),
b AS (SELECT vec_id, i, CASE WHEN m IS NULL THEN x ELSE 0.7 * x + 0.3 * m END AS x, m IS NULL AS alone FROM x LEFT JOIN m USING (vec_id, i))
SELECT vec_id, i::INTEGER AS i, round(CASE WHEN alone THEN x ELSE x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) END, 6) AS x FROM b""")
def graph_diffusion(spark, d):
    v = graph.diffuse(table(spark, d, "embeddings"), cut(_edges(spark, d)), "vec_id", "embedding", 64, 0.3)
    return v.select("vec_id", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.round("x", 6))


@query(f"""WITH {_EDGES}, r AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS rank FROM e),
g AS (SELECT src, rank, (a.label = b.label)::INT AS hit FROM r JOIN embeddings a ON a.vec_id = src JOIN embeddings b ON b.vec_id = dst)
SELECT src AS query_id, sum(hit) / 10.0::DOUBLE AS precision, round(coalesce(max(CASE WHEN hit = 1 THEN 1.0::DOUBLE / rank END), 0), 6) AS mrr FROM g GROUP BY src""")
def ranking_metrics(spark, d):
    from pyspark.sql import Window

    e = table(spark, d, "embeddings").select("vec_id", "label")
    ranked = _edges(spark, d).select(F.col("src").alias("query_id"), F.col("dst").alias("doc_id"), "score", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("score"), "dst")).alias("rank"))
    ranked = cut(ranked)
    one, two = e.withColumnRenamed("vec_id", "query_id"), e.select(F.col("vec_id").alias("doc_id"), F.col("label").alias("other"))
    judged = ranked.join(one, "query_id").join(two, "doc_id").select("query_id", "doc_id", (F.col("label") == F.col("other")).cast("int").alias("grade"))
    return metrics.quality(ranked, judged).select("query_id", "precision", F.round("mrr", 6).alias("mrr"))


# ---- what SQL does not express, or not at this size


def _small(spark: SparkSession, d: str) -> DataFrame:
    return cut(table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), tokenize(F.col("text"), False).alias("tokens")))


_BENCH = f"""tok AS (SELECT item_id AS doc_id, {sql.tokens('text', False)} AS tokens FROM benchmark),
pos AS (SELECT doc_id, unnest(tokens) AS t, unnest(range(len(tokens))) AS i FROM tok),
w AS MATERIALIZED (SELECT a.t, b.t AS n, sum(1.0::DOUBLE / abs(a.i - b.i)) AS w FROM pos a JOIN pos b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i - 5 AND a.i + 5 AND a.i <> b.i GROUP BY ALL),
src AS (SELECT t, d, ((('0x' || substr(md5(t || ':' || d), 1, 8))::BIGINT % 255 - 127) / 127.0::DOUBLE) AS v FROM (SELECT DISTINCT t FROM pos), (SELECT unnest(range({DIM})) AS d)),
near AS (SELECT w.t, d, sum(w * v) AS x FROM w JOIN src ON src.t = w.n GROUP BY w.t, d),
p1 AS MATERIALIZED (SELECT t, d, round_even(round(127 * y / sqrt(sum(y * y) OVER (PARTITION BY t)), 9), 0)::DOUBLE AS q FROM (SELECT src.t, d, v + coalesce(x, 0) AS y FROM src LEFT JOIN near USING (t, d)))"""


@query(f"WITH {_BENCH} SELECT t AS token, d::INTEGER AS d, q::BIGINT AS q FROM p1")
def rri_pass1(spark, d):
    docs = Packed(_small(spark, d))
    first = cooccurrence.pass1(docs, DigestVectors(DIM).vectors(docs.tokens()), DIM)
    return first.select("token", F.posexplode("q").alias("d", "q")).withColumn("q", F.col("q").cast("long"))


@query(f"""WITH {_BENCH}, acc AS (SELECT w.t, d, round_even(round(greatest(-127, least(127, 127 * sum(w * q / 127.0::DOUBLE))), 9), 0)::DOUBLE AS x FROM w JOIN p1 ON p1.t = w.n GROUP BY w.t, d),
y AS (SELECT p1.t, d, 0.7::DOUBLE * q + 0.3::DOUBLE * coalesce(x, 0) AS y FROM p1 LEFT JOIN acc USING (t, d))
SELECT t AS token, d::INTEGER AS d, round_even(round(127 * y / sqrt(sum(y * y) OVER (PARTITION BY t)), 9), 0)::BIGINT AS q FROM y""")
def rri_pass2(spark, d):
    docs = Packed(_small(spark, d))
    second = cooccurrence.enrich(docs, DigestVectors(DIM).vectors(docs.tokens()), DIM)
    return second.select("token", F.posexplode("q").alias("d", "q")).withColumn("q", F.col("q").cast("long"))


@query(f"WITH {sql.enriched(DIM)} SELECT token, d::INTEGER AS d, q::BIGINT AS q FROM p1")
def rri_pass1_documents(spark, d):
    docs = Packed(_texts(spark, d))
    first = cooccurrence.pass1(docs, DigestVectors(DIM).vectors(docs.tokens()), DIM)
    return first.select("token", F.posexplode("q").alias("d", "q")).withColumn("q", F.col("q").cast("long"))


@query(f"WITH {sql.enriched(DIM)} SELECT token, d::INTEGER AS d, q::BIGINT AS q FROM enr")
def rri_pass2_documents(spark, d):
    docs = Packed(_docs(spark, d))
    second = cooccurrence.enrich(docs, DigestVectors(DIM).vectors(docs.tokens()), DIM)
    return second.select("token", F.posexplode("q").alias("d", "q")).withColumn("q", F.col("q").cast("long"))


def _attention(rounds: int = 3, most: int = 32) -> str:
    """Rounds of moving each vector towards the mean of its nearest ones."""
    ctes = ["v0 AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"]
    for r in range(rounds):
        ctes.append(f"u{r} AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt({sql.dot('v', 'v')})) AS u FROM v{r})")
        ctes.append(f"e{r} AS (SELECT a.vec_id, b.vec_id AS near FROM u{r} a JOIN u{r} b ON a.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY list_inner_product(a.u, b.u) DESC, b.vec_id) <= {most})")
        ctes.append(f"x{r} AS (SELECT vec_id, unnest(range(64)) AS i, unnest(v) AS x FROM v{r})")
        ctes.append(f"m{r} AS (SELECT e.vec_id, i, avg(x) AS m FROM e{r} e JOIN x{r} x ON x.vec_id = e.near GROUP BY e.vec_id, i)")
        ctes.append(f"y{r} AS (SELECT vec_id, i, 0.7::DOUBLE * x + 0.3::DOUBLE * m AS y FROM x{r} JOIN m{r} USING (vec_id, i))")
        ctes.append(f"v{r + 1} AS (SELECT vec_id, list(y ORDER BY i) AS v FROM (SELECT vec_id, i, y / sqrt(sum(y * y) OVER (PARTITION BY vec_id)) AS y FROM y{r}) GROUP BY vec_id)")
    return "WITH " + ", ".join(c.replace(" AS (", " AS MATERIALIZED (", 1) for c in ctes) + f" SELECT vec_id, unnest(range(64))::INTEGER AS i, unnest(list_transform(v, lambda x: round(x, 6))) AS x FROM v{rounds}"


@query(_attention())
def simulated_attention(spark, d):
    v = graph.attend(table(spark, d, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding", 64)
    return v.select("vec_id", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.round("x", 6))


@query(f"""WITH {sql.vectors(DIM)}, s AS (SELECT doc_id, d, sum(tf / 127.0::DOUBLE * q) AS x FROM post JOIN enr USING (token) GROUP BY ALL),
n AS (SELECT doc_id, round(sqrt(sum(x * x)), 6) AS size FROM s GROUP BY doc_id)
SELECT doc_id, terms, size FROM (SELECT doc_id, count(*)::INTEGER AS terms FROM post GROUP BY doc_id) JOIN n USING (doc_id)""")
def describe_functions(spark, d):
    docs = cut(_docs(spark, d))
    c = corpus.CorpusBuilder(spark, EngineConfig.of(DIM, abbrev=False)).add_tokens(docs).finalize(DigestVectors(DIM))
    return scores.described(c, docs).select("doc_id", F.size("tfidf").alias("terms"), F.round(V.norm(F.col("ri")), 6).alias("size"))


@query()
def chunk_source(spark, d):
    from semaloom.sources.files import chunked

    files = table(spark, d, "pages").select(F.col("url").alias("path"), F.encode("html", "UTF-8").alias("content"))
    return chunked(files, 512).select("path", "chunk_no", F.octet_length("content").alias("bytes"))


#: The pieces that unknown tokens are composed of here: tokens of two documents or more. ``walk`` goes through a token piece by piece.
_PIECES = """known AS MATERIALIZED (SELECT token AS piece, length(token) AS len FROM vocab WHERE df >= 2 AND length(token) <= 24),
spots AS (SELECT token, spot, unnest(range(1, least(24, length(token) - spot + 1) + 1)) AS len FROM (SELECT token, unnest(range(1, length(token) + 1)) AS spot FROM vocab)),
subs AS MATERIALIZED (SELECT token, spot, max(s.len) AS len FROM spots s JOIN known k ON k.piece = substr(token, spot, s.len) GROUP BY token, spot),
walk AS (SELECT token, 1::BIGINT AS spot, 0 AS n, []::VARCHAR[] AS pieces FROM vocab
  UNION ALL SELECT w.token, w.spot + coalesce(s.len, 1), w.n + (s.len IS NOT NULL)::INT, CASE WHEN s.len IS NULL THEN w.pieces ELSE list_append(w.pieces, substr(w.token, w.spot, s.len)) END
  FROM walk w LEFT JOIN subs s ON s.token = w.token AND s.spot = w.spot WHERE w.spot <= length(w.token) AND w.n < 8),
cutup AS MATERIALIZED (SELECT token, pieces FROM walk WHERE spot > length(token) OR n = 8)"""


@query(f"WITH RECURSIVE {sql.documents()}, {_PIECES} SELECT token, array_to_string(pieces, ' ') AS pieces FROM cutup")
def subword_decompose(spark, d):
    from semaloom.sources.token_vectors import decompose

    c = _corpus(spark, d)
    return decompose(c.vocab, c.vocab.filter((F.col("df") >= 2) & (F.length("token") <= 24)).select("token")).select("token", F.array_join("pieces", " ").alias("pieces"))


@query(f"""WITH RECURSIVE {sql.vectors(DIM)}, {_PIECES}, parts AS (SELECT token, unnest(pieces) AS piece FROM cutup),
summed AS (SELECT parts.token, d, sum(q / 127.0::DOUBLE) AS x FROM parts JOIN enr ON enr.token = parts.piece GROUP BY ALL),
made AS (SELECT token, d, CASE WHEN sqrt(sum(x * x) OVER (PARTITION BY token)) >= 1e-10 THEN x / sqrt(sum(x * x) OVER (PARTITION BY token)) ELSE 0 END AS x FROM summed)
SELECT token, d::INTEGER AS d, round(CASE WHEN k.piece IS NOT NULL THEN e.q / 127.0::DOUBLE ELSE coalesce(made.x, 0) END, 6) + 0.0::DOUBLE AS x
FROM enr e LEFT JOIN known k ON k.piece = e.token LEFT JOIN made USING (token, d)""")
def pretrained_vectors(spark, d):
    """A table of vectors for tokens of two documents or more; others are composed of its pieces."""
    from semaloom.sources.token_vectors import TableVectors

    c = _corpus(spark, d)
    listed = c.vocab.filter((F.col("df") >= 2) & (F.length("token") <= 24)).join(c.enriched, "token").select("token", F.col("q").alias("vec"))
    return TableVectors(cut(listed), DIM).vectors(c.vocab).select("token", F.posexplode("vec").alias("d", "x")).withColumn("x", F.round("x", 6) + F.lit(0.0))


@query(f"""WITH {sql.vectors(DIM)}, pos AS (SELECT doc_id, unnest(tokens) AS token, unnest(range(len(tokens))) AS i FROM tok),
ids AS (SELECT token, (row_number() OVER (ORDER BY d, i) - 1)::BIGINT AS token_id FROM (SELECT token, min(doc_id) AS d, arg_min(i, (doc_id, i)) AS i FROM pos GROUP BY token))
SELECT token_id, token, round(idf, 6) AS idf, round(sum(q / 127.0::DOUBLE), 6) + 0.0::DOUBLE AS total FROM ids JOIN vocab USING (token) JOIN enr USING (token) GROUP BY ALL""")
def token_by_index(spark, d):
    return _corpus(spark, d).tokens_at().select("token_id", "token", F.round("idf", 6).alias("idf"), (F.round(V.total(F.col("vec")), 6) + F.lit(0.0)).alias("total"))


@query(f"WITH {sql.documents()} SELECT (SELECT count(*) FROM tok)::BIGINT AS docs, (SELECT count(*) FROM vocab)::BIGINT AS tokens, (SELECT count(*) FROM post)::BIGINT AS postings")
def corpus_counts(spark, d):
    c = _corpus(spark, d)
    return spark.createDataFrame([(c.n_docs, c.n_tokens)], "docs long, tokens long").crossJoin(c.postings.agg(F.count("*").alias("postings")))


def _labelled(spark: SparkSession, d: str) -> corpus.Corpus:
    """The documents' corpus, with their sources as labels."""
    key = (spark.sparkContext.applicationId, d, "labelled")
    if key not in _BUILT:
        docs = spread(table(spark, d, "documents").select("doc_id", "text", F.coalesce("source", F.lit("none")).alias("label")), "doc_id")
        _BUILT[key] = corpus.CorpusBuilder(spark, EngineConfig.of(DIM, abbrev=False)).add_texts(docs).finalize(DigestVectors(DIM))
    return _BUILT[key]


@query(f"WITH {sql.documents()} SELECT doc_id, coalesce(source, 'none') AS label FROM tok JOIN documents USING (doc_id)")
def document_labels(spark, d):
    c = _labelled(spark, d)
    return c.label(c.doc_vectors.select("doc_id"))


@query("SELECT 0::BIGINT AS faults, true AS valid")
def content_checks(spark, d):
    """A saved corpus is read with all checks; a fault would be counted."""
    import uuid

    from semaloom.runtime import checkpoint_dir
    from semaloom.sources import store

    folder = f"{checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    store.save(_labelled(spark, d), folder)
    try:
        store.load(spark, folder, check=True)
        faults = 0
    except store.CorpusFormatError:
        faults = 1
    return spark.createDataFrame([(faults, faults == 0)], "faults long, valid boolean")


@query(f"{_CHAIN}, best AS ({sql.ranked('score', TOP)}) SELECT query_id || ' ' || rank || ' ' || doc_id || ' ' || format('{{:.6f}}', score) AS line FROM best")
def dump_ranking(spark, d):
    """The lines of a dumped ranking, read again."""
    import uuid

    from semaloom.runtime import checkpoint_dir
    from semaloom.sources import store

    folder = f"{checkpoint_dir(spark)}/dump-{uuid.uuid4().hex}"
    store.dump(_result(search.search(_corpus(spark, d), _asked(spark, d), TOP, Mode.BRUTE)), folder)
    return spark.read.text(folder).withColumnRenamed("value", "line")


@query("SELECT item_id::BIGINT AS doc_id, 'benchmark/' || item_id AS label, text FROM benchmark")
def jsonl_documents(spark, d):
    """The benchmark's passages by way of JSON lines."""
    import uuid

    from semaloom.runtime import checkpoint_dir
    from semaloom.sources import files

    folder = f"{checkpoint_dir(spark)}/jsonl-{uuid.uuid4().hex}"
    rows = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.concat(F.lit("benchmark/"), F.col("item_id")).alias("path"), "text")
    rows.write.json(folder)
    return files.jsonl(spark, folder)


@query()
def pca_project(spark, d):
    from semaloom.sources.token_vectors import fit_pca

    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    mean, basis, _ = fit_pca(e, "v", 4)
    projected = dense.map_vectors(e, "vec_id", "v", 64, lambda x: (x - mean) @ basis, "double")
    return projected.select("vec_id", *[F.round(F.abs(F.col("v")[i]), 6).alias(f"x{i}") for i in range(4)])


@query("SELECT 0::BIGINT AS differences")
def save_load_roundtrip(spark, d):
    import uuid

    from semaloom.runtime import checkpoint_dir
    from semaloom.sources import store

    c, q = _corpus(spark, d), _asked(spark, d)
    folder = f"{checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    store.save(c, folder)
    again = store.load(spark, folder)
    return metrics.differences(search.search(c, q, TOP), search.search(again, q, TOP)).agg(F.count("*").alias("differences"))


def entry(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: the best documents for each benchmark passage, by candidates from the index."""
    return _result(search.search(_corpus(spark, d), _asked(spark, d), TOP, Mode.AUTO))


