"""Queries of keyword, vector and hybrid search, contexts and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import intent
from ..functions import text as T
from ..operators import bm25, context, evaluate, fusion, vectors
from .registry import register
from .tables import documents, read, search_index

# DuckDB's \b knows ASCII letters only; a word with other letters, which has no term, becomes a sign for it first.
_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
MASKED = "regexp_replace(lower({0}), '[a-z0-9_]*[^\\x00-\\x7F][a-z0-9_\\x{{80}}-\\x{{10FFFF}}]*', '§', 'g')"
_TERMS = "list_filter(regexp_extract_all(" + MASKED + ", '\\b[a-zA-Z_][a-zA-Z0-9_]*(?:\\.[a-zA-Z_][a-zA-Z0-9_]*)*\\b'), lambda t: length(t) >= 2 AND t NOT IN (" + _STOP + "))"
_DOCS = "docs AS (SELECT doc_id, source || '/' || lang || '/' || doc_id || '.txt' AS file_path, text FROM documents)"
_INDEX = f"tk AS (SELECT doc_id, {_TERMS.format('text')} AS ts FROM docs), dl AS (SELECT doc_id, CAST(len(ts) AS BIGINT) AS dl FROM tk), ps AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM tk) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM ps GROUP BY term), cp AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl)"
_QUERIES = "qs AS (SELECT item_id AS query_id, text AS query FROM benchmark)"
_SCORES = f"qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({_TERMS.format('query')}) AS term FROM qs) GROUP BY ALL), sc AS (SELECT query_id, doc_id, sum(times * ln((n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score, list_sort(list(DISTINCT term)) AS matched FROM qt JOIN ps USING (term) JOIN df USING (term) JOIN dl USING (doc_id), cp GROUP BY ALL)"
_BASE = f"WITH {_DOCS}, {_INDEX}, {_QUERIES}, {_SCORES}"


def questions(spark, sf):
    b = read(spark, sf, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def vector_queries(spark, sf):
    return read(spark, sf, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


@register("b1_terms", f"WITH {_DOCS} SELECT doc_id, array_to_string({_TERMS.format('text')}, ' ') AS terms FROM docs")
def b1(spark, sf):
    return documents(spark, sf).select("doc_id", F.array_join(T.terms(F.col("text")), " ").alias("terms"))


@register("b2_postings", f"WITH {_DOCS}, {_INDEX} SELECT term, doc_id, tf FROM ps")
def b2(spark, sf):
    return bm25.build(documents(spark, sf)).postings.select("term", "doc_id", "tf")


@register("a9_corpus_stats", f"WITH {_DOCS}, {_INDEX} SELECT count(*) AS total_documents, round(avg(dl), 6) AS average_document_length, CAST(sum(dl) AS BIGINT) AS total_terms, (SELECT count(DISTINCT term) FROM ps) AS vocabulary_size FROM dl")
def a9(spark, sf):
    return bm25.statistics(search_index(spark, sf)).withColumn("average_document_length", F.round("average_document_length", 6))


@register("a10_document_frequency", f"WITH {_DOCS}, {_INDEX} SELECT term, df FROM df")
def a10(spark, sf):
    return bm25.document_frequency(search_index(spark, sf))


@register("b3_scores", _BASE + " SELECT query_id, doc_id, round(score, 6) AS score FROM sc")
def b3(spark, sf):
    return bm25.scored(search_index(spark, sf), questions(spark, sf)).select("query_id", "doc_id", F.round("score", 6).alias("score"))


_TOP = " SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY {0} DESC, doc_id) AS INT) AS rank, * EXCLUDE (query_id) FROM {1} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY {0} DESC, doc_id) <= {2}"


@register("b4_search", _BASE + ", r AS (" + _TOP.format("round(score, 9)", "(SELECT * FROM sc WHERE score >= 0.1)", 10) + ") SELECT query_id, rank, doc_id, round(score, 6) AS score FROM r")
def b4(spark, sf):
    found = bm25.ranked(search_index(spark, sf), questions(spark, sf))
    return found.select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


@register(
    "b5_snippets",
    _BASE + ", k AS (SELECT query_id, doc_id, matched FROM sc WHERE score >= 0.1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) <= 10), m AS (SELECT query_id, doc_id, text, list_min(list_transform(matched, lambda t: instr(lower(text), t))) - 1 AS p FROM k JOIN docs USING (doc_id)), w AS (SELECT *, greatest(0, p - 100) AS a, least(length(text), greatest(0, p - 100) + 200) AS b FROM m) SELECT query_id, doc_id, CASE WHEN a > 0 THEN '...' ELSE '' END || substring(text, CAST(a + 1 AS BIGINT), CAST(b - a AS BIGINT)) || CASE WHEN b < length(text) THEN '...' ELSE '' END AS snippet FROM w",
)
def b5(spark, sf):
    return bm25.search(search_index(spark, sf), questions(spark, sf)).select("query_id", "doc_id", "snippet")


@register("b6_scoped_search", _BASE + ", r AS (" + _TOP.format("round(score, 9)", "(SELECT sc.* FROM sc JOIN docs USING (doc_id) WHERE score >= 0.1 AND split_part(file_path, '/', 1) IN ('src1', 'src2'))", 5) + ") SELECT query_id, rank, doc_id FROM r")
def b6(spark, sf):
    index = search_index(spark, sf)
    return bm25.search(index, questions(spark, sf), 5, projects=["src1", "src2"]).select("query_id", "rank", "doc_id")


_L2 = "list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda z: (CAST(z[1] AS DOUBLE) - z[2]) * (CAST(z[1] AS DOUBLE) - z[2])))"
_IP = "list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda z: CAST(z[1] AS DOUBLE) * z[2]))"
_NEAR = "nn AS (SELECT q.vec_id AS query_id, v.vec_id, {0} AS d FROM embeddings v, embeddings q WHERE q.vec_id % 20 = 0), nr AS (SELECT query_id, vec_id, d, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9) {1}, vec_id) AS rank FROM nn)"


@register("v1_nearest", f"WITH {_NEAR.format(_L2, '')} SELECT query_id, CAST(rank AS INT) AS rank, vec_id, round(d, 6) AS distance FROM nr WHERE rank <= 10")
def v1(spark, sf):
    return vectors.nearest(read(spark, sf, "embeddings"), vector_queries(spark, sf), 10).withColumn("distance", F.round("distance", 6))


@register("v4_inner_product", f"WITH {_NEAR.format(_IP, 'DESC')} SELECT query_id, CAST(rank AS INT) AS rank, vec_id, round(d, 6) AS similarity FROM nr WHERE rank <= 10")
def v4(spark, sf):
    return vectors.nearest(read(spark, sf, "embeddings"), vector_queries(spark, sf), 10, "ip").withColumn("similarity", F.round("similarity", 6))


_FILE = "source || '/' || lang || '/' || doc_id || '.txt'"


@register("v2_relevance", f"WITH {_NEAR.format(_L2, '')}, p AS (SELECT query_id, vec_id, d, source FROM nr JOIN documents ON doc_id = vec_id WHERE rank <= 20) SELECT query_id, vec_id, round(least(1.0, greatest(0.1, 1 - d / 3) + CASE WHEN contains('how is src1 built', source) OR contains(source, 'how is src1 built') THEN 0.15 ELSE 0 END + 0.05), 6) AS relevance FROM p")
def v2(spark, sf):
    near = vectors.nearest(read(spark, sf, "embeddings"), vector_queries(spark, sf), 20)
    d = read(spark, sf, "documents").select("doc_id", F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id"), F.lit(".txt"))).alias("file_path"))
    rows = near.join(d, near["vec_id"] == d["doc_id"])
    return rows.select("query_id", "vec_id", F.round(vectors.relevance(F.col("distance"), F.col("file_path"), F.lit("how is src1 built")), 6).alias("relevance"))


@register("v5_coarse_search")
def v5(spark, sf):
    index, centers = vectors.coarse_index(read(spark, sf, "embeddings"))
    return vectors.probe(index, centers, vector_queries(spark, sf)).select("query_id", "rank", "vec_id", F.round("distance", 6).alias("distance"))


@register("v6_vector_faults", "SELECT vec_id, 'width' AS fault FROM embeddings WHERE len(CASE WHEN vec_id % 50 = 0 THEN embedding[1:10] ELSE embedding END) <> 64")
def v6(spark, sf):
    e = read(spark, sf, "embeddings").withColumn("embedding", F.when(F.col("vec_id") % 50 == 0, F.slice("embedding", 1, 10)).otherwise(F.col("embedding")))
    return vectors.faults(e, 64)


# Fixed questions that touch every signal.
QUESTIONS = (
    "getUserById()", "UserService class", "how does authentication work", "what is the architecture of the system",
    "fix null pointer exception in parser.parse", "explain the dependency hierarchy", "def handle_request(self)", "why is the build broken",
    "list files", "where is std::vector used", "overview", "trace the error in order_service.create and suggest a fix for the crash",
)


def asked(spark, sf):
    """These and, from number 1000, all texts of the benchmark."""
    fixed = spark.createDataFrame(list(enumerate(QUESTIONS)), "query_id long, query string")
    return fixed.unionByName(questions(spark, sf).select((F.col("query_id") + 1000).alias("query_id"), "query"))


def _vocabulary(terms):
    return "(" + " + ".join(f"CAST(contains(l, '{t}') AS INT)" for t in terms) + ")"


# RE2 has no lookahead to worry about.
_SYM = " + ".join("len(regexp_extract_all(plain, '" + p.replace("'", "''") + "'))" for p in intent.SYMBOLS)
_QST = " + ".join("CAST(regexp_matches(l, '" + p.replace("'", "''") + "') AS INT)" for p in intent.QUESTIONS)
_ASKED = "a AS (SELECT CAST(query_id AS BIGINT) AS query_id, query FROM (VALUES " + ", ".join(f"({i}, '{q}')" for i, q in enumerate(QUESTIONS)) + ") AS t(query_id, query) UNION ALL SELECT item_id + 1000, text FROM benchmark)"
_PLAIN = "regexp_replace(query, '[A-Za-z0-9_]*[^\\x00-\\x7F][A-Za-z0-9_\\x{80}-\\x{10FFFF}]*', '§', 'g')"
_SIGNALS = f"""b AS (SELECT query_id, query, {_PLAIN} AS plain, lower(trim(query)) AS l, len(regexp_extract_all(query, '\\S+')) AS w FROM a),
s AS (SELECT query_id, {_vocabulary(intent.TECHNICAL)} / greatest(w, 1) AS t, {_vocabulary(intent.CONCEPTUAL)} / greatest(w, 1) AS c, least(({_SYM}) / 3.0, 1.0) AS s, least(({_QST}) / 2.0, 1.0) AS q,
 CASE WHEN w <= 3 THEN 0.8 WHEN w <= 7 THEN 0.5 ELSE 0.2 END AS p,
 (CAST(contains(query, '(') OR contains(query, ')') AS INT) + CAST(contains(query, '.') AND NOT ends_with(query, '.') AS INT) + CAST(contains(query, '::') OR contains(query, '.') AS INT)) / 3.0 AS x,
 least({_vocabulary(intent.DEBUGGING)} / 2.0, 1.0) AS d, least({_vocabulary(intent.STRUCTURAL)} / 2.0, 1.0) AS r FROM b)"""
_INTENT = """f AS (SELECT *, [s * .4 + t * .3 + x * .2 + p * .1, c * .4 + q * .3 + (1 - p) * .2 + (1 - t) * .1, r * .5 + t * .2 + c * .2 + q * .1, d * .5 + s * .2 + t * .2 + x * .1, q * .3 + c * .3 + (1 - p) * .2 + t * .2] AS f FROM s),
g AS (SELECT *, list_max(f) AS best, list_position(f, list_max(f)) AS i FROM f),
h AS (SELECT *, CASE WHEN best < .3 THEN 5 ELSE i END AS k, CASE WHEN best < .3 THEN .3 ELSE best END AS conf FROM g)"""


@register("r2_signals", f"WITH {_ASKED}, {_SIGNALS} SELECT query_id, round(t, 6) AS technical_density, round(c, 6) AS conceptual_density, round(s, 6) AS symbol_presence, round(q, 6) AS question_structure, CAST(p AS DOUBLE) AS query_specificity, round(x, 6) AS code_syntax, round(d, 6) AS debugging_context, round(r, 6) AS structural_analysis FROM s")
def r2(spark, sf):
    return intent.classified(asked(spark, sf)).select("query_id", *[F.round(s, 6).alias(s) for s in intent.SIGNALS])


@register(
    "r4_intent_weights",
    f"WITH {_ASKED}, {_SIGNALS}, {_INTENT}, w AS (SELECT query_id, ['specific_symbol', 'conceptual', 'structural', 'debugging', 'exploratory'][k] AS intent, conf, greatest(.1, least(.9, [.2, .8, .6, .3, .7][k] - CASE WHEN s > .5 THEN (s - .5) * .3 ELSE 0 END + CASE WHEN c > .3 THEN (c - .3) * .2 ELSE 0 END + CASE WHEN q > .5 THEN q * .15 ELSE 0 END - CASE WHEN t > .4 THEN (t - .4) * .25 ELSE 0 END - (1 - greatest(conf, .3)) * .3)) AS v FROM h) SELECT query_id, intent, round(CAST(conf AS DOUBLE), 6) AS confidence, round(CAST(v AS DOUBLE), 6) AS vector_weight, round(CAST(1 - v AS DOUBLE), 6) AS bm25_weight FROM w",
)
def r4(spark, sf):
    return intent.classified(asked(spark, sf)).select("query_id", "intent", *[F.round(c, 6).alias(c) for c in ("confidence", "vector_weight", "bm25_weight")])


@register("r30_cleaned_questions", "SELECT item_id, coalesce(nullif(trim(regexp_replace(regexp_replace('@src' || item_id || '  ' || text, '@[A-Za-z0-9_-]+', ' ', 'g'), '\\s+', ' ', 'g')), ''), 'Give an overview of this project') AS query, 'src' || item_id AS project FROM benchmark")
def r30(spark, sf):
    b = read(spark, sf, "benchmark").withColumn("q", F.concat(F.lit("@src"), "item_id", F.lit("  "), "text"))
    return b.select("item_id", intent.cleaned(F.col("q")).alias("query"), F.array_join(intent.project_mentions(F.col("q")), ",").alias("project"))


_FUSED = _BASE + f""", v0 AS (SELECT vec_id, embedding FROM embeddings), qv AS (SELECT query_id, embedding FROM qs JOIN v0 ON vec_id = query_id % (SELECT count(*) FROM v0)),
nn AS (SELECT q.query_id, v.vec_id AS doc_id, round({_L2}, 9) AS d FROM v0 v, qv q), nr AS (SELECT * FROM nn QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d, doc_id) <= 20),
va AS (SELECT query_id, doc_id, greatest(0.1, 1 - d / 3) AS vs FROM nr),
ka AS (SELECT query_id, doc_id, score / max(score) OVER (PARTITION BY query_id) AS bs FROM (SELECT query_id, doc_id, round(score, 9) AS score FROM sc WHERE round(score, 9) >= 0.1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) <= 20)),
fu AS (SELECT coalesce(va.query_id, ka.query_id) AS query_id, coalesce(va.doc_id, ka.doc_id) AS doc_id, coalesce(vs, 0) AS vs, coalesce(bs, 0) AS bs, CASE WHEN bs IS NULL THEN 'vector' WHEN vs IS NULL THEN 'bm25' ELSE 'hybrid' END AS st FROM va FULL JOIN ka ON va.query_id = ka.query_id AND va.doc_id = ka.doc_id)"""


def _numbered(spark, sf):
    """Questions with a vector by their number: the driver's tables have no vectors of questions."""
    e = read(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("query_vector"))
    q = questions(spark, sf).withColumn("n", F.col("query_id") % max(1, e.count()))
    return q.join(e, q["n"] == e["vec_id"]).select("query_id", "query", "query_vector")


def _arms(spark, sf):
    q = _numbered(spark, sf)
    near = vectors.nearest(read(spark, sf, "embeddings"), q.select("query_id", F.col("query_vector").alias("query")), 20)
    vector = near.select("query_id", F.col("vec_id").alias("doc_id"), F.greatest(F.lit(0.1), 1 - F.col("distance") / 3).alias("vector_score"))
    index = search_index(spark, sf)
    keyword = bm25.ranked(index, questions(spark, sf), 20).select("query_id", "doc_id", F.col("score").alias("bm25_score"), "matched_terms")
    return vector, keyword


@register("r5_fused", _FUSED + " SELECT query_id, doc_id, round(vs * 0.6 + bs * 0.4, 6) AS score, st AS search_type FROM fu")
def r5(spark, sf):
    vector, keyword = _arms(spark, sf)
    weights = questions(spark, sf).select("query_id", F.lit(0.6).alias("vector_weight"), F.lit(0.4).alias("bm25_weight"))
    return fusion.fused(vector, keyword, weights).select("query_id", "doc_id", F.round("score", 6).alias("score"), "search_type")


_CUT = _FUSED + ", b AS (SELECT query_id, doc_id, round(vs * 0.6 + bs * 0.4, 9) AS score FROM fu), c AS (SELECT *, count(*) FILTER (WHERE score >= 0.25) OVER (PARTITION BY query_id) AS n FROM b), k AS (SELECT query_id, doc_id, score FROM c WHERE score >= CASE WHEN n < 8 THEN 0.25 * 0.7 ELSE 0.25 END)"


@register("f15_adaptive_cut", _CUT + ", r AS (" + _TOP.format("score", "k", 10) + ") SELECT query_id, rank, doc_id FROM r")
def f15(spark, sf):
    vector, keyword = _arms(spark, sf)
    weights = questions(spark, sf).select("query_id", F.lit(0.6).alias("vector_weight"), F.lit(0.4).alias("bm25_weight"))
    return fusion.cut(fusion.fused(vector, keyword, weights).withColumn("score", F.round("score", 9)), 0.25).select("query_id", "rank", "doc_id")


@register("f14_adaptive_threshold", f"WITH {_NEAR.format(_L2, '')}, s AS (SELECT query_id, vec_id, round(1 - d / 3, 9) AS s FROM nr WHERE rank <= 20), c AS (SELECT *, count(*) FILTER (WHERE s >= 0.9) OVER w AS a, count(*) FILTER (WHERE s >= 0.45) OVER w AS b, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS p FROM s WINDOW w AS (PARTITION BY query_id)) SELECT query_id, vec_id FROM c WHERE p <= 10 AND CASE WHEN a > 0 THEN s >= 0.9 WHEN b > 0 THEN s >= 0.45 ELSE TRUE END")
def f14(spark, sf):
    near = vectors.nearest(read(spark, sf, "embeddings"), vector_queries(spark, sf), 20).withColumn("score", F.round(1 - F.col("distance") / 3, 9))
    return vectors.adaptive(near, "score", 0.9, 10).select("query_id", "vec_id")


@register("r6_filename_boost", "WITH p AS (SELECT page_id, page_id // 20 AS query_id, 1.0 + page_id % 7 AS score, regexp_extract(url, '://([^?#]*)', 1) AS f FROM pages), s AS (SELECT *, lower(regexp_extract(f, '([^/]*)$', 1)) = 'index.html' AS same, ends_with(lower(f), '.html') AS alike FROM p) SELECT page_id, round(score::DOUBLE * CASE WHEN bool_or(same) OVER (PARTITION BY query_id) THEN CASE WHEN same THEN 1.35 WHEN alike THEN 0.5 ELSE 0.2 END WHEN alike THEN 1.2 ELSE 0.6 END, 6) AS score FROM s")
def r6(spark, sf):
    p = read(spark, sf, "pages").select("page_id", F.floor(F.col("page_id") / 20).alias("query_id"), (1.0 + F.col("page_id") % 7).cast("double").alias("score"), F.regexp_extract("url", "://([^?#]*)", 1).alias("file_path"), F.lit("bm25").alias("search_type"), F.array().cast("array<string>").alias("matched_terms"))
    return fusion.boosted(p, filename="index.html").select("page_id", F.round("score", 6).alias("score"))


_TECHNICAL = "[" + ", ".join(f"'{t}'" for t in intent.TECHNICAL) + "]"
_WEIGHTS = """, a AS (SELECT query_id, query FROM qs), """ + _SIGNALS + ", " + _INTENT + """, wt AS (SELECT query_id, greatest(.1, least(.9, [.2, .8, .6, .3, .7][k] - CASE WHEN s > .5 THEN (s - .5) * .3 ELSE 0 END + CASE WHEN c > .3 THEN (c - .3) * .2 ELSE 0 END + CASE WHEN q > .5 THEN q * .15 ELSE 0 END - CASE WHEN t > .4 THEN (t - .4) * .25 ELSE 0 END - (1 - greatest(conf, .3)) * .3))::DOUBLE AS vw FROM h)"""
_HYBRID = (
    _BASE
    + _WEIGHTS
    + f""", v0 AS (SELECT vec_id, embedding FROM embeddings), qv AS (SELECT query_id, query, embedding FROM qs JOIN v0 ON vec_id = query_id % (SELECT count(*) FROM v0)),
nn AS (SELECT q.query_id, q.query, v.vec_id AS doc_id, round({_L2}, 9) AS d FROM v0 v, qv q), nr AS (SELECT * FROM nn QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d, doc_id) <= 20),
va AS (SELECT nr.query_id, doc_id, least(1.0, greatest(0.1, 1 - d / 3) + CASE WHEN contains(lower(query), split_part(file_path, '/', 1)) OR contains(split_part(file_path, '/', 1), lower(query)) THEN 0.15 ELSE 0 END + 0.05) AS vs FROM nr JOIN docs USING (doc_id)),
ka AS (SELECT query_id, doc_id, matched, score / max(score) OVER (PARTITION BY query_id) AS bs FROM (SELECT query_id, doc_id, matched, round(score, 9) AS score FROM sc JOIN qv USING (query_id) WHERE round(score, 9) >= 0.1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) <= 20)),
fu AS (SELECT coalesce(va.query_id, ka.query_id) AS query_id, coalesce(va.doc_id, ka.doc_id) AS doc_id, coalesce(vs, 0) AS vs, coalesce(bs, 0) AS bs, matched, CASE WHEN bs IS NULL THEN 'vector' WHEN vs IS NULL THEN 'bm25' ELSE 'hybrid' END AS st FROM va FULL JOIN ka ON va.query_id = ka.query_id AND va.doc_id = ka.doc_id),
bo AS (SELECT fu.*, round((vs * vw + bs * (1 - vw)) * CASE WHEN st <> 'vector' THEN 1 + 0.1 * len(list_filter(matched, lambda t: list_contains({_TECHNICAL}, t) AND contains(lower(query), t))) ELSE 1 END, 9) AS score FROM fu JOIN wt USING (query_id) JOIN qs USING (query_id)),
cu AS (SELECT *, count(*) FILTER (WHERE score >= 0.25) OVER (PARTITION BY query_id) AS m FROM bo), kp AS (SELECT * FROM cu WHERE score >= CASE WHEN m < 8 THEN 0.25 * 0.7 ELSE 0.25 END)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, round(score, 6) AS score, round(vs, 6) AS vector_score, round(bs, 6) AS bm25_score, st AS search_type FROM kp QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 10"""
)


@register("r7_hybrid_search", _HYBRID)
def r7(spark, sf):
    out = fusion.hybrid_search(search_index(spark, sf), read(spark, sf, "embeddings"), _numbered(spark, sf))
    return out.withColumns({c: F.round(c, 6) for c in ("score", "vector_score", "bm25_score")})


@register("r24_token_estimate", "SELECT doc_id, greatest(1, length(text) // 4) AS tokens FROM documents")
def r24(spark, sf):
    return read(spark, sf, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


_BUDGET = "WITH r AS (SELECT doc_id // 40 AS query_id, doc_id, round(1.0 / (1 + doc_id % 97), 9) AS score, text, greatest(1, length(text) // 4) AS tokens FROM documents), u AS (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY score DESC, doc_id ROWS UNBOUNDED PRECEDING) AS used FROM r), c AS (SELECT *, used > 3800 AND used - tokens <= 3800 AND 3800 - used + tokens > 100 AS is_cut FROM u) SELECT query_id, doc_id, round(CASE WHEN is_cut THEN score * 0.8 ELSE score END, 6) AS score, is_cut, CASE WHEN is_cut THEN left(text, CAST(floor((3800 - used + tokens) * 4 * 0.8) AS INT)) ELSE text END AS text FROM c WHERE used <= 3800 OR is_cut"


@register("r23_token_budget", _BUDGET)
def r23(spark, sf):
    r = read(spark, sf, "documents").select(F.floor(F.col("doc_id") / 40).alias("query_id"), "doc_id", F.round(1.0 / (1 + F.col("doc_id") % 97), 9).alias("score"), "text")
    return context.within_budget(r).withColumn("score", F.round("score", 6))


_GOLD = ", rr AS (SELECT query_id, arg_min(term, (df, term)) AS term FROM qt JOIN df USING (term) GROUP BY query_id), go AS (SELECT query_id, CAST(query_id % 3 AS VARCHAR) AS category, list(doc_id) AS expected FROM rr JOIN ps USING (term) GROUP BY ALL), re AS (" + _TOP.format("round(score, 9)", "(SELECT * FROM sc WHERE score >= 0.1)", 10) + "), j AS (SELECT go.query_id, category, expected, rank, doc_id, coalesce(list_contains(expected, doc_id), FALSE) AS hit FROM go LEFT JOIN re USING (query_id)), m AS (SELECT query_id, category, CASE WHEN count(doc_id) >= 3 THEN count(*) FILTER (WHERE hit AND rank <= 3) / 3.0 ELSE 0 END AS p3, CASE WHEN count(doc_id) >= 5 THEN count(*) FILTER (WHERE hit AND rank <= 5) / 5.0 ELSE 0 END AS p5, CASE WHEN count(doc_id) >= 10 THEN count(*) FILTER (WHERE hit) / 10.0 ELSE 0 END AS p10, count(*) FILTER (WHERE hit) * 1.0 / any_value(len(expected)) AS r10, coalesce(1.0 / min(rank) FILTER (WHERE hit), 0) AS mrr FROM j GROUP BY query_id, category)"


def _evaluated(spark, sf):
    """Search held against the documents that have a question's rarest term."""
    index, q = search_index(spark, sf), questions(spark, sf)
    words = q.select("query_id", F.explode(T.terms(F.col("query"))).alias("term")).join(index.terms, "term")
    rarest = words.groupBy("query_id").agg(F.min_by("term", F.struct("df", "term")).alias("term"))
    gold = index.postings.join(rarest, "term").select("query_id", (F.col("query_id") % 3).cast("string").alias("category"), "doc_id")
    return evaluate.per_query(b4(spark, sf), gold)


_M = ", ".join(f"round(CAST({m} AS DOUBLE), 6) AS {m}" for m in evaluate.METRICS)


@register("a16_query_metrics", _BASE + _GOLD + f" SELECT query_id, category, {_M} FROM m")
def a16(spark, sf):
    return _evaluated(spark, sf).select("query_id", "category", *[F.round(m, 6).alias(m) for m in evaluate.METRICS])


_A = ", ".join(f"round(CAST(avg({m}) AS DOUBLE), 6) AS {m}" for m in evaluate.METRICS)


@register("r28_evaluation_summary", _BASE + _GOLD + f" SELECT coalesce(category, 'overall') AS category, count(*) AS queries, {_A} FROM m GROUP BY ROLLUP (category)")
def r28(spark, sf):
    return evaluate.summary(_evaluated(spark, sf)).select("category", "queries", *[F.round(m, 6).alias(m) for m in evaluate.METRICS])


_KIND = "CASE " + " ".join(f"WHEN {k} >= 1 AND {k} >= greatest(entity, architecture, file) THEN '{k}'" for k in intent.KINDS) + " ELSE 'general' END"


@register("x1_question_kind", f"WITH {_ASKED}, n AS (SELECT query_id, " + ", ".join(f"{_vocabulary(v).replace('(l,', '(lower(query),')} AS {k}" for k, v in intent.KINDS.items()) + f" FROM a) SELECT query_id, {_KIND} AS kind FROM n")
def x1(spark, sf):
    return asked(spark, sf).select("query_id", intent.question_kind(F.col("query")).alias("kind"))
