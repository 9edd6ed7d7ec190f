import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Makes a documents table from texts, or from (doc_id, text) pairs."""

    def make(texts, lang="en", source="src0"):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        return spark.createDataFrame([(i, t, lang, source, len(t or "")) for i, t in rows], DOCUMENTS)

    return make


#: A text of each kind that must not break an operator.
ODD = [None, "", "   \n\t ", "one", "É è ü 漢字 \U0001f642", "x" * 50_000, "a b c " * 5_000, "same text here again", "same text here again", "\x00\x01 nul"]
