"""Queries of smart search: every question of the benchmark, and questions about entities, files and structure."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import smart
from ..sources.sinks import written
from .queries_code import _fill, _parts
from .queries_search import _FUSED, _QUERIES
from .registry import register
from .tables import read, search_index

#: table, key, path and text of files beside the documents.
_FILES = (
    ("nation", "n_nationkey", "n{k}/package.json", "{{}}\n"),
    ("nation", "n_nationkey", "n{k}/src/main.py", "import os\n"),
    ("nation", "n_nationkey", "n{k}/models/user_{k}.py", "class User{k}(models.Model):\n    name = 1\n"),
    ("region", "r_regionkey", "r{k}/Dockerfile", "FROM scratch\n"),
    ("region", "r_regionkey", "r{k}/config_{k}.yaml", "a: {k}\n"),
    ("region", "r_regionkey", "r{k}/schema.sql", "CREATE TABLE t{k} (id int PRIMARY KEY);\n"),
)
#: Questions about every nation, by a thousand thousands.
_ASKS = ("which database entity or model holds User{k}", "open the config file config_{p}.yaml", "explain the architecture overview of n{k}", "show package.json and 'main.py' of n{k}")


def _filled(text: str, key: str, parent: str):
    return F.concat(*[F.col(key) if p == "\0k" else F.col(parent) if p == "\0p" else F.lit(p) for p in _parts(text)])


def files(spark, sf) -> DataFrame:
    return reduce(DataFrame.unionByName, [read(spark, sf, t).select(_filled(path, k, k).alias("file_path"), _filled(text, k, k).alias("content")) for t, k, path, text in _FILES])


def questions(spark, sf) -> DataFrame:
    """query_id, query."""
    n = read(spark, sf, "nation")
    parts = [read(spark, sf, "benchmark").select(F.col("item_id").cast("long").alias("query_id"), F.col("text").alias("query"))]
    parts += [n.select((F.col("n_nationkey") + (i + 1) * 1_000_000).cast("long").alias("query_id"), _filled(ask, "n_nationkey", "n_regionkey").alias("query")) for i, ask in enumerate(_ASKS)]
    return reduce(DataFrame.unionByName, parts)


_QS = "qs AS (SELECT CAST(item_id AS BIGINT) AS query_id, text AS query FROM benchmark UNION ALL " + " UNION ALL ".join(f"SELECT CAST({(i + 1) * 1_000_000} + n_nationkey AS BIGINT), {_fill(ask, 'n_nationkey', 'n_regionkey')} FROM nation" for i, ask in enumerate(_ASKS)) + ")"
_TERMS_IN = lambda words: "len(list_filter(w, lambda x: x IN (" + ", ".join(f"'{x}'" for x in words) + ")))"
_MATCHED = lambda kind: " + ".join(f"0.3 * CAST(regexp_matches(l, '{p}') AS INT)" for p in smart.PATTERNS[kind])
_SCORES = (
    f"[0.4 * {_TERMS_IN(smart.ENTITY_WORDS)} + " + " + ".join(f"0.2 * CAST(contains(l, '{x}') AS INT)" for x in smart.ENTITY_WORDS) + f" + {_MATCHED('entity')}, "
    f"0.4 * {_TERMS_IN(smart.FILE_WORDS)} + 0.3 * CAST(regexp_matches(l, '\\.[a-z0-9_]{{2,4}}([^a-z0-9_]|$)') AS INT) + {_MATCHED('file')}, "
    f"0.4 * {_TERMS_IN(smart.ARCHITECTURE_WORDS)} + 0.2 * CAST(" + " OR ".join(f"contains(l, '{p}')" for p in smart.PHRASES) + f" AS INT) + {_MATCHED('architecture')}, 0.4, 0.3, 0.2]"
)
_ANALYSED = f"""an AS (SELECT query_id, query, l, [round(x::DOUBLE, 6) for x in {_SCORES}] AS f FROM (SELECT *, lower(query) AS l, regexp_extract_all(lower(query), '[a-z0-9_]+') AS w FROM qs)),
bb AS (SELECT *, list_max(f) AS s, ['entity', 'file', 'architecture', 'conceptual', 'exploratory', 'debugging'][list_position(f, list_max(f))] AS intent FROM an),
qa AS (SELECT query_id, intent, least(s, 1.0) AS confidence, list_concat(CASE WHEN regexp_matches(l, '{smart.EXACT_NAME}') OR contains(query, '"') OR contains(query, '''') OR (intent = 'file' AND s >= 0.6) OR s > 0.7 THEN ['hybrid'] ELSE [] END,
 CASE intent WHEN 'entity' THEN ['entities', 'vector', 'keyword'] WHEN 'file' THEN ['files', 'vector', 'keyword'] WHEN 'architecture' THEN ['vector', 'structure', 'keyword'] ELSE ['vector', 'keyword'] END) AS strategies,
 list_distinct(list_filter(regexp_extract_all(l, '[a-z0-9_]+\\.[a-z0-9_]+'), lambda h: length(string_split(h, '.')[-1]) BETWEEN 2 AND 4)) AS hints FROM bb)"""


@register("r18_question_strategies", f"WITH {_QS}, {_ANALYSED} SELECT query_id, intent, confidence::DOUBLE AS confidence, array_to_string(strategies, ',') AS strategies, array_to_string(list_sort(hints), ',') AS file_hints FROM qa")
def r18_strategies(spark, sf):
    a = smart.analysed(questions(spark, sf))
    return a.select("query_id", "intent", "confidence", F.array_join("strategies", ",").alias("strategies"), F.array_join(F.array_sort("file_hints"), ",").alias("file_hints"))


_ARMS = f"""al AS ({" UNION ALL ".join(f"SELECT {_fill(path, k, k)} AS file_path, {_fill(text, k, k)} AS content FROM {t}" for t, k, path, text in _FILES)}),
nm AS (SELECT file_path, lower(regexp_extract(file_path, '([^/]*)$', 1)) AS name FROM al),
en AS (SELECT file_path, round(max(least(1.0, 0.6 + c + CASE WHEN regexp_matches(content, '(?i)@Table|__tablename__|tableName|create\\s+table') THEN 0.1 ELSE 0 END + CASE WHEN regexp_matches(content, '(?i)@Id\\b|primary_?\\s?key') THEN 0.1 ELSE 0 END))::DOUBLE, 9) AS confidence FROM (SELECT *, CASE WHEN regexp_matches(content, 'models\\.Model\\b') THEN 0.2 WHEN regexp_matches(content, '(?i)create\\s+table') THEN 0.3 END AS c FROM al) WHERE c IS NOT NULL GROUP BY file_path ORDER BY confidence DESC, file_path LIMIT 5),
arms AS (SELECT query_id, file_path, 'vector' AS strategy, vs AS confidence FROM va JOIN docs USING (doc_id) UNION ALL SELECT query_id, file_path, 'keyword', bs FROM ka JOIN docs USING (doc_id)
UNION ALL SELECT query_id, file_path, 'hybrid', c FROM (SELECT query_id, doc_id, round(vs * 0.6 + bs * 0.4, 9) AS c FROM fu QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(vs * 0.6 + bs * 0.4, 9) DESC, doc_id) <= 20) JOIN docs USING (doc_id)
UNION ALL SELECT query_id, file_path, 'files', 0.8 FROM (SELECT query_id, unnest(hints) AS name FROM qa) JOIN (SELECT * FROM nm QUALIFY row_number() OVER (PARTITION BY name ORDER BY file_path) <= 5) USING (name)
UNION ALL SELECT query_id, file_path, 'structure', 0.7 FROM qa, (SELECT file_path FROM nm WHERE name IN {smart.KEY_FILES} QUALIFY row_number() OVER (PARTITION BY name ORDER BY file_path) <= 3)
UNION ALL SELECT query_id, file_path, 'entities', en.confidence FROM qa, en),
sd AS (SELECT arms.query_id, file_path, strategy, round(arms.confidence::DOUBLE, 9) AS c, intent FROM arms JOIN qa ON qa.query_id = arms.query_id AND list_contains(strategies, strategy)),
su AS (SELECT * FROM sd QUALIFY row_number() OVER (PARTITION BY query_id, file_path ORDER BY c DESC, strategy) = 1),
ra AS (SELECT query_id, file_path, strategy, round(c * CASE WHEN (strategy, intent) IN ({", ".join(f"('{s}', '{i}')" for s, i in smart.ANSWERS.items())}) THEN 1.2::DOUBLE ELSE 1 END * CASE WHEN strategy = 'entities' AND intent = 'entity' THEN 1.3::DOUBLE ELSE 1 END, 9) AS confidence FROM su)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, file_path) AS INT) AS rank, file_path, strategy, round(confidence, 6) AS confidence FROM ra WHERE confidence >= 0.3 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, file_path) <= 10"""


@register("r18_smart_search", _FUSED.replace(_QUERIES, _QS) + f", {_ANALYSED}, {_ARMS}")
def r18_search(spark, sf):
    e = read(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("query_vector"))
    q = questions(spark, sf).withColumn("n", F.col("query_id") % max(1, e.count()))
    asked = written(q.join(e, q["n"] == e["vec_id"]).select("query_id", "query", "query_vector"))
    out = smart.search(search_index(spark, sf), read(spark, sf, "embeddings"), written(files(spark, sf)), asked)
    return out.withColumn("confidence", F.round("confidence", 6))


@register("r20_searches_by_intent", f"WITH {_QS}, {_ANALYSED} SELECT intent, strategy, count(*) AS questions FROM (SELECT intent, unnest(strategies) AS strategy FROM qa) GROUP BY ALL")
def r20_searches(spark, sf):
    a = smart.analysed(questions(spark, sf))
    return a.select("intent", F.explode("strategies").alias("strategy")).groupBy("intent", "strategy").agg(F.count("*").alias("questions"))
