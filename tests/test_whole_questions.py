"""Search queries ask with a benchmark's whole texts, as their SQL does."""

from seamark.plans import registry


def test_a_late_word_finds_its_document(spark, tmp_path):
    docs = [(i, text, "en", "src1", len(text)) for i, text in enumerate(["alpha beta", "gamma zebra", "delta", "omega"])]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "one two three four five six seven zebra")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [r["doc_id"] for r in registry.QUERIES["b4_search"](spark, str(tmp_path)).collect()] == [1]
