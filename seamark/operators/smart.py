"""Smart search: what a question is after decides which searches it gets, and their results meet in one list."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import basename
from ..sources.sinks import written
from . import bm25, fusion, serving, vectors

# Words, phrases and patterns of intents, and the files that show how a project is built.
ENTITY_WORDS = (
    "entity", "entities", "model", "models", "database", "db", "table", "tables", "schema", "schemas", "orm", "@entity", "create table", "user model",
    "data model", "entity class", "jpa", "hibernate", "sqlalchemy", "django model", "mongoose", "sequelize",
)
FILE_WORDS = ("file", "files", "directory", "folder", "structure", "organization", "config", "configuration", "package.json", "requirements.txt", "dockerfile", "readme", "main.py", "index.js", "app.py")
ARCHITECTURE_WORDS = ("architecture", "overview", "structure", "design", "system", "components", "modules", "organization", "flow", "pattern", "framework", "stack", "tech stack", "dependencies")
PHRASES = ("how does", "how is", "explain the", "what is the", "show me the", "overview of", "structure of")
PATTERNS = {
    "entity": ("@entity", r"create\s+table", r"class\s+\w+\s*\(.*model\)", r"models?\.\w+", r"database\s+schema", r"entity\s+relationship"),
    "file": ("/(src|app|lib|config)/", r"package\.json", r"requirements\.txt", "dockerfile", r"\.env"),
    "architecture": (r"main\s+entry\s+point", r"application\s+structure", r"system\s+design", r"tech\s+stack"),
}
KEY_FILES = ("package.json", "requirements.txt", "setup.py", "dockerfile", "main.py", "app.py", "index.js", "server.js", "manage.py")
EXACT_NAME = r"\w+\.(xml|properties|gradle|md|yml|yaml|json|toml|ini|cfg)([^a-z0-9_]|$)"
BASELINES = {"conceptual": 0.4, "exploratory": 0.3, "debugging": 0.2}
# End of fixed values.

#: The searches of each intent besides those of all.
STRATEGIES = {"entity": ["entities", "vector", "keyword"], "file": ["files", "vector", "keyword"], "architecture": ["vector", "structure", "keyword"]}
#: Which intent a search's results answer.
ANSWERS = {"entities": "entity", "files": "file", "structure": "architecture", "vector": "conceptual", "keyword": "exploratory"}


def _words_in(found: Column, words: tuple[str, ...]) -> Column:
    return F.size(F.filter(found, lambda w: w.isin(*words)))


def _sum(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def analysed(questions: DataFrame) -> DataFrame:
    """query_id, query, intent, confidence, strategies, file_hints of (query_id, query); of equal scores the first intent counts."""
    low = F.lower("query")
    words = F.regexp_extract_all(low, F.lit("[a-z0-9_]+"), F.lit(0))
    patterns = {k: _sum([F.when(low.rlike(p), 0.3).otherwise(0.0) for p in v]) for k, v in PATTERNS.items()}
    scores = {
        "entity": 0.4 * _words_in(words, ENTITY_WORDS) + _sum([F.when(F.contains(low, F.lit(w)), 0.2).otherwise(0.0) for w in ENTITY_WORDS]) + patterns["entity"],
        "file": 0.4 * _words_in(words, FILE_WORDS) + F.when(low.rlike(r"\.[a-z0-9_]{2,4}([^a-z0-9_]|$)"), 0.3).otherwise(0.0) + patterns["file"],
        "architecture": 0.4 * _words_in(words, ARCHITECTURE_WORDS) + F.when(reduce(lambda a, p: a | F.contains(low, F.lit(p)), PHRASES, F.lit(False)), 0.2).otherwise(0.0) + patterns["architecture"],
    } | {k: F.lit(v) for k, v in BASELINES.items()}
    best = F.array_max(F.array(*[F.struct(F.round(v, 6).alias("score"), F.lit(-i).alias("order"), F.lit(k).alias("intent")) for i, (k, v) in enumerate(scores.items())]))
    rows = questions.select("query_id", "query", best.alias("b"))
    intent, score = F.col("b.intent"), F.col("b.score")
    hybrid = low.rlike(EXACT_NAME) | F.contains("query", F.lit('"')) | F.contains("query", F.lit("'")) | ((intent == "file") & (score >= 0.6)) | (score > 0.7)
    own = F.array(F.lit("vector"), F.lit("keyword"))
    for k, v in STRATEGIES.items():
        own = F.when(intent == k, F.array(*map(F.lit, v))).otherwise(own)
    hints = F.array_distinct(F.filter(F.regexp_extract_all(low, F.lit(r"[a-z0-9_]+\.[a-z0-9_]+"), F.lit(0)), lambda h: F.length(F.substring_index(h, ".", -1)).between(2, 4)))
    return rows.select("query_id", "query", intent.alias("intent"), F.least(score, F.lit(1.0)).alias("confidence"), F.when(hybrid, F.concat(F.array(F.lit("hybrid")), own)).otherwise(own).alias("strategies"), hints.alias("file_hints"))


def _first(rows: DataFrame, key: list[str], most: int, *order) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def search(index: bm25.Index, embeddings: DataFrame, files: DataFrame, questions: DataFrame, arm: int = 20, k: int = 10, least: float = 0.3) -> DataFrame:
    """query_id, rank, file_path, strategy, confidence for questions (query_id, query, query_vector).

    Each search is run for the questions that ask for it, and for no other:
    vectors and keywords over the index's documents, both fused, names of
    ``files`` (file_path, content) that a question holds, files that show a
    project's structure, and files with entities.  A file that several searches
    find counts with the surest; results that answer the question's intent rise.
    """
    asked = analysed(questions.select("query_id", "query"))
    wants = lambda s: asked.where(F.array_contains("strategies", s))
    # Fusion needs both kinds too.
    both = wants("hybrid").select("query_id")
    to = lambda s: questions.join(wants(s).select("query_id").union(both).distinct(), "query_id", "left_semi")
    near = vectors.nearest(embeddings, to("vector").select("query_id", F.col("query_vector").alias("query")), arm)
    # Written, as each is read alone and fused.
    near = written(near.select("query_id", F.col("vec_id").alias("doc_id"), F.greatest(F.lit(0.1), 1 - F.col("distance") / 3).alias("vector_score")))
    keyword = written(bm25.ranked(index, to("keyword").select("query_id", "query"), arm).select("query_id", "doc_id", F.col("score").alias("bm25_score"), "matched_terms"))
    weights = both.select("query_id", F.lit(0.6).alias("vector_weight"), F.lit(0.4).alias("bm25_weight"))
    fused = fusion.fused(near, keyword, weights).select("query_id", "doc_id", F.round("score", 9).alias("confidence"))
    searched = {
        "vector": near.select("query_id", "doc_id", F.col("vector_score").alias("confidence")),
        "keyword": fusion.normalised(keyword, "bm25_score").select("query_id", "doc_id", F.col("bm25_score").alias("confidence")),
        "hybrid": _first(fused, ["query_id"], arm, F.desc("confidence"), "doc_id"),
    }
    paths = index.documents.select("doc_id", "file_path")
    arms = [rows.join(wants(s).select("query_id"), "query_id", "left_semi").join(paths, "doc_id").select("query_id", "file_path", F.lit(s).alias("strategy"), "confidence") for s, rows in searched.items()]

    named = _first(files.select("file_path", F.lower(basename(F.col("file_path"))).alias("hint")), ["hint"], 5, "file_path")
    hints = wants("files").select("query_id", F.explode("file_hints").alias("hint"))
    arms.append(hints.join(named, "hint").select("query_id", "file_path", F.lit("files").alias("strategy"), F.lit(0.8).alias("confidence")))
    # At most three of each name, and five with entities: few rows for every question that asks.
    shown = _first(files.select("file_path", F.lower(basename(F.col("file_path"))).alias("name")).where(F.col("name").isin(*KEY_FILES)), ["name"], 3, "file_path")
    arms.append(wants("structure").select("query_id").crossJoin(F.broadcast(shown.select("file_path"))).select("query_id", "file_path", F.lit("structure").alias("strategy"), F.lit(0.7).alias("confidence")))
    entities = serving.entities(files).groupBy("file_path").agg(F.round(F.max("confidence"), 9).alias("confidence")).orderBy(F.desc("confidence"), "file_path").limit(5)
    arms.append(wants("entities").select("query_id").crossJoin(F.broadcast(entities)).select("query_id", "file_path", F.lit("entities").alias("strategy"), "confidence"))

    every = reduce(DataFrame.unionByName, arms).withColumn("confidence", F.round("confidence", 9))
    surest = _first(every, ["query_id", "file_path"], 1, F.desc("confidence"), "strategy").join(asked.select("query_id", "intent"), "query_id")
    answers = reduce(lambda a, x: a | ((F.col("strategy") == x[0]) & (F.col("intent") == x[1])), ANSWERS.items(), F.lit(False))
    raised = F.col("confidence") * F.when(answers, 1.2).otherwise(1.0) * F.when((F.col("strategy") == "entities") & (F.col("intent") == "entity"), 1.3).otherwise(1.0)
    rows = surest.withColumn("confidence", F.round(raised, 9)).where(F.col("confidence") >= least)
    top = rows.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("confidence"), "file_path"))).where(F.col("rank") <= k)
    return top.select("query_id", "rank", "file_path", "strategy", "confidence")
