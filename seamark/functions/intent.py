"""What a question asks for, and how keyword and vector search should weigh.

Everything is a column expression over the question, so whole query logs are
classified in one projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Vocabularies (counted where they occur as substrings) and patterns.
TECHNICAL = (
    "function", "class", "method", "variable", "constant", "interface",
    "type", "enum", "struct", "module", "package", "namespace",
    "async", "await", "return", "yield", "import", "export", "from",
    "public", "private", "protected", "static", "abstract", "final",
    "const", "let", "var", "def", "lambda", "arrow",
    "extends", "implements", "inherits", "override", "super", "self",
    "this", "constructor", "destructor", "getter", "setter",
    "array", "list", "dict", "map", "set", "tuple", "object", "json",
    "string", "int", "float", "bool", "char", "byte",
    "if", "else", "elif", "switch", "case", "for", "while", "do",
    "break", "continue", "try", "catch", "except", "finally", "throw",
    "callback", "handler", "listener", "decorator", "annotation",
    "middleware", "interceptor", "factory", "builder", "singleton",
)
CONCEPTUAL = (
    "how", "what", "why", "when", "where", "which", "who",
    "explain", "understand", "concept", "idea", "approach", "strategy",
    "pattern", "best practice", "example", "tutorial", "guide",
    "overview", "summary", "introduction", "basics", "fundamentals",
    "workflow", "process", "architecture", "design", "structure",
)
STRUCTURAL = (
    "hierarchy", "inheritance", "dependency", "relationship", "connection",
    "structure", "organization", "architecture", "design", "pattern",
    "tree", "graph", "flow", "diagram", "schema", "model",
)
DEBUGGING = (
    "error", "bug", "issue", "problem", "fix", "debug", "troubleshoot",
    "exception", "crash", "fail", "broken", "not working", "wrong",
    "unexpected", "strange", "weird", "odd", "trace", "stack",
    "null", "undefined", "missing", "empty", "invalid",
)
SYMBOLS = (
    r"\b[a-z_][a-zA-Z0-9_]*\(\)",
    r"\b[A-Z][a-zA-Z0-9_]*\b",
    r"\b[a-z_][a-zA-Z0-9_]*\.[a-z_]",
    r"\b[a-z_][a-zA-Z0-9_]*::[a-z_]",
    r"\b[a-z_][a-zA-Z0-9_]*\.[A-Z]",
    r"(?:def|function|class|interface|enum)\s+(\w+)",
    r"(?:const|let|var)\s+(\w+)",
    r"(?:public|private|protected)\s+(\w+)",
)
QUESTIONS = (
    r"\bhow\s+(?:do|does|can|to|should)\b",
    r"\bwhat\s+(?:is|are|does|do|can)\b",
    r"\bwhy\s+(?:is|are|does|do)\b",
    r"\bwhere\s+(?:is|are|does|can)\b",
    r"\bwhen\s+(?:is|does|should|to)\b",
    r"\bwhich\s+(?:is|are|does|should)\b",
)
#: Vector weight by intent, in the order that decides ties.
BASE_WEIGHT = {"specific_symbol": 0.2, "conceptual": 0.8, "structural": 0.6, "debugging": 0.3, "exploratory": 0.7}
# End of fixed values.

SIGNALS = ("technical_density", "conceptual_density", "symbol_presence", "question_structure", "query_specificity", "code_syntax", "debugging_context", "structural_analysis")


def _contained(text: Column, vocabulary: tuple[str, ...]) -> Column:
    """How many of the terms occur; the terms are one constant array, which keeps the expression small."""
    return F.size(F.filter(F.array(*[F.lit(t) for t in vocabulary]), lambda t: F.contains(text, t)))


def signals(query: Column) -> dict[str, Column]:
    low = F.lower(F.trim(query))
    words = F.greatest(F.size(F.regexp_extract_all(low, F.lit(r"\S+"), F.lit(0))), F.lit(1))
    raw_words = F.size(F.regexp_extract_all(query, F.lit(r"\S+"), F.lit(0)))
    symbols, questions = F.lit(0), F.lit(0)
    for p in SYMBOLS:
        symbols = symbols + F.regexp_count(query, F.lit(p))
    for p in QUESTIONS:
        questions = questions + low.rlike(p).cast("int")
    dot = F.contains(query, F.lit("."))
    syntax = (F.contains(query, F.lit("(")) | F.contains(query, F.lit(")"))).cast("int") + (dot & ~F.endswith(query, F.lit("."))).cast("int") + (F.contains(query, F.lit("::")) | dot).cast("int")
    one = F.lit(1.0)
    return {
        "technical_density": _contained(low, TECHNICAL) / words,
        "conceptual_density": _contained(low, CONCEPTUAL) / words,
        "symbol_presence": F.least(symbols / 3.0, one),
        "question_structure": F.least(questions / 2.0, one),
        "query_specificity": F.when(raw_words <= 3, 0.8).when(raw_words <= 7, 0.5).otherwise(0.2),
        "code_syntax": syntax / 3.0,
        "debugging_context": F.least(_contained(low, DEBUGGING) / 2.0, one),
        "structural_analysis": F.least(_contained(low, STRUCTURAL) / 2.0, one),
    }


def intent_scores() -> dict[str, Column]:
    """Over the signal columns."""
    t, c, s, q, p, x, d, a = (F.col(n) for n in SIGNALS)
    return {
        "specific_symbol": s * 0.4 + t * 0.3 + x * 0.2 + p * 0.1,
        "conceptual": c * 0.4 + q * 0.3 + (1.0 - p) * 0.2 + (1.0 - t) * 0.1,
        "structural": a * 0.5 + t * 0.2 + c * 0.2 + q * 0.1,
        "debugging": d * 0.5 + s * 0.2 + t * 0.2 + x * 0.1,
        "exploratory": q * 0.3 + c * 0.3 + (1.0 - p) * 0.2 + t * 0.2,
    }


def classified(queries: DataFrame) -> DataFrame:
    """The queries (column ``query``) with signals, intent, confidence, vector_weight and bm25_weight."""
    out = queries.withColumns(signals(F.col("query")))
    scores = intent_scores()
    ranked = F.array(*[F.struct(v.alias("score"), F.lit(-i).alias("order"), F.lit(k).alias("intent")) for i, (k, v) in enumerate(scores.items())])
    out = out.withColumn("_best", F.array_max(ranked))
    low = F.col("_best.score") < 0.3
    out = out.withColumns({"intent": F.when(low, "exploratory").otherwise(F.col("_best.intent")), "confidence": F.when(low, 0.3).otherwise(F.col("_best.score"))}).drop("_best")
    base = F.lit(BASE_WEIGHT["exploratory"])
    for k, v in BASE_WEIGHT.items():
        base = F.when(F.col("intent") == k, v).otherwise(base)
    above = lambda c, limit: F.when(F.col(c) > limit, F.col(c) - limit).otherwise(0.0)
    shift = -above("symbol_presence", 0.5) * 0.3 + above("conceptual_density", 0.3) * 0.2 + F.when(F.col("question_structure") > 0.5, F.col("question_structure") * 0.15).otherwise(0.0) - above("technical_density", 0.4) * 0.25
    weight = base + shift - (1.0 - F.greatest("confidence", F.lit(0.3))) * 0.3
    out = out.withColumn("vector_weight", F.greatest(F.lit(0.1), F.least(F.lit(0.9), weight)))
    return out.withColumn("bm25_weight", 1.0 - F.col("vector_weight"))


def technical_terms(query: Column) -> Column:
    low = F.lower(query)
    return F.filter(F.array(*[F.lit(t) for t in TECHNICAL]), lambda t: F.contains(low, t))


def project_mentions(query: Column) -> Column:
    """Names after ``@``, each once."""
    return F.array_distinct(F.regexp_extract_all(query, F.lit(r"@([A-Za-z0-9_-]+)"), F.lit(1)))


def cleaned(query: Column, default: str = "Give an overview of this project") -> Column:
    """The question without mentions and double blanks."""
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(F.regexp_replace(query, r"@[A-Za-z0-9_-]+", " "), r"\s+", " ")), F.lit("")), F.lit(default))


# Words of question kinds, in the order that decides ties.
KINDS = {
    "entity": ("entity", "entities", "model", "table", "schema", "database"),
    "architecture": ("architecture", "structure", "design", "overview", "components", "system"),
    "file": ("file", "content", "show", "read", "open"),
}
# End of fixed values.


def question_kind(query: Column) -> Column:
    """The kind with most words in the question, or ``general``."""
    low = F.lower(query)
    ranked = F.array(*[F.struct(_contained(low, v).alias("n"), F.lit(-i).alias("order"), F.lit(k).alias("kind")) for i, (k, v) in enumerate(KINDS.items())])
    best = F.array_max(ranked)
    return F.when(best["n"] > 0, best["kind"]).otherwise("general")


def graph_benefit(query: Column, symbols: Column) -> Column:
    """0 to 1: how much graph expansion should help; 0.5 is the gate."""
    low = F.lower(query)
    kind = question_kind(query)
    words = F.size(F.regexp_extract_all(query, F.lit(r"\S+"), F.lit(0)))
    base = F.when(kind == "architecture", 0.8).when(kind == "entity", 0.6).when(kind == "file", 0.1).otherwise(0.3)
    keywords = _contained(low, ("call", "depend", "inherit", "import", "relationship", "use")) * 0.2
    patterns = (low.rlike(r"what\s+calls").cast("int") + low.rlike(r"depends?\s+on").cast("int") + low.rlike(r"how\s+does\s+.*\s+work").cast("int")) * 0.3
    return F.least(F.lit(1.0), base + keywords + patterns + F.least(symbols * 0.1, F.lit(0.5)) + F.when(words > 5, F.least((words - 5) * 0.05, F.lit(0.2))).otherwise(0.0))
