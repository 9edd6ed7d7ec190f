"""Operations of a large-scale training-data pipeline, one module each.

Nothing outside this subpackage imports it; ``queries`` registers the
queries and their SQL, and ``corpus_pipeline.py`` chains five of them.
"""
