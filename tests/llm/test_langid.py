import os

import numpy as np
import pytest

from seamark.llm import langid

from .conftest import ODD

EN = "the cat and the dog went to the house with some of their friends that day and they were happy "
DE = "der hund und die katze gingen zu dem haus mit einigen ihrer freunde an diesem tag und sie waren froh "
RU = "собака и кошка пошли в дом вместе с друзьями в тот день и были очень рады "


def corpus(docs):
    return docs([(i, EN * 3) for i in range(0, 40)]).union(docs([(i, DE * 3) for i in range(100, 140)], lang="de")).union(docs([(i, RU * 3) for i in range(200, 240)], lang="ru"))


def test_languages_and_odd_texts(spark, docs):
    train = corpus(docs)
    model = langid.train(train)
    assert model.langs == ["de", "en", "ru"]
    test = docs([(1000, "they were with the dog"), (1001, "sie waren mit dem hund"), (1002, "кошка и собака"), (1003, "123 !? 4"), *[(1010 + i, t) for i, t in enumerate(ODD)], (None, EN)])
    got = {r["doc_id"]: r for r in langid.identify(test.selectExpr("*", "1 AS score", "'x' AS lang_pred"), model).collect()}
    assert [got[1000 + i]["lang_pred"] for i in range(4)] == ["en", "de", "ru", "und"]
    assert got[1003]["score"] == 0 and [got[1010 + i]["lang_pred"] for i in range(3)] == ["und"] * 3
    assert got[None]["lang_pred"] == "en" and got[None]["held_out"] is False
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_held_out_and_nothing_to_learn(spark, docs):
    import zlib

    rows = langid.identify(docs([(i, EN) for i in range(50)])).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    none = docs([(1, EN)], lang=None)
    assert langid.identify(none).first()["lang_pred"] == "und"
    assert langid.identify(docs([])).count() == 0
    assert langid.known_language(docs([(0, EN), (1, "12 34"), (2, None)])).select("doc_id").collect() == [(0,)]


def test_mixed_text_gets_spans(spark, docs):
    model = langid.train(corpus(docs))
    rows = langid.spans(docs([EN * 2 + DE * 2 + RU]), model).orderBy("span").collect()
    assert [r["lang"] for r in rows] == ["en", "de", "ru"]
    assert rows[0]["first_word"] == 0 and all(a["last_word"] + 1 == b["first_word"] for a, b in zip(rows, rows[1:]))


def full(s, penalty):
    """The plain dynamic program: best sum over all paths."""
    v = s[0].copy()
    for t in range(1, len(s)):
        v = np.maximum(v, v.max() - penalty) + s[t]
    return v.max()


def test_viterbi_is_optimal_with_and_without_shortcut():
    rng = np.random.default_rng(4)
    for k in range(200):
        s = rng.normal(0, 3 if k % 2 else 0.3, (rng.integers(1, 40), 4))
        path = langid.viterbi(s, 5.0)
        value = s[np.arange(len(s)), path].sum() - 5.0 * (np.diff(path) != 0).sum()
        assert abs(value - full(s, 5.0)) < 1e-9


def test_scripts():
    data = np.frombuffer("aéЖ漢ग🙂".encode() + b"    ", np.uint8)
    at = np.array([0, 1, 3, 5, 8, 11])
    assert [langid.NAMES[i] for i in langid.script_of(data, at)] == ["Latin", "Latin", "Cyrillic", "Han", "Devanagari", "other"]


def letters(seed, n=400):
    """Random words of small letters: no language."""
    rng = np.random.default_rng(seed)
    return " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(3, 9))) for _ in range(n))


FI = "kissa ja koira menivät taloon joidenkin ystäviensä kanssa sinä päivänä ja he olivat hyvin iloisia koska aurinko paistoi kirkkaasti "


def test_stage_rejects_what_no_learned_language_explains(spark, docs):
    train = corpus(docs)
    model = langid.train(train)
    test = [(1, EN), (2, DE + EN), (3, "漢字仮名交じり文" * 20), (4, letters(1)), (5, "x"), (6, "12 34"), (7, None), (8, ""), (9, "zzqx"), (9, EN), (None, RU), (10, FI)]
    got = [(r["doc_id"], r["lang"]) for r in langid.known_language(docs(test, lang="??"), model).collect()]
    assert sorted(got, key=str) == sorted([(1, "en"), (2, "de"), (5, got[2][1]), (9, got[3][1]), (9, "en"), (None, "ru")], key=str)
    only_de = langid.known_language(docs(test), model, languages={"de"}, least=0.1)
    assert {r["doc_id"] for r in only_de.collect()} - {5, 9} == {2}


def test_stage_loses_nothing_when_nothing_is_learned(spark, docs):
    rows = langid.known_language(docs([(0, EN), (0, EN), (1, "12 34"), (2, None), (None, DE)], lang=None)).collect()
    assert sorted([(r["doc_id"], r["lang"]) for r in rows], key=str) == [(0, None), (0, None), (None, None)]
    assert langid.known_language(docs([])).count() == 0


def test_clashing_columns_stay(spark, docs):
    rows = corpus(docs).selectExpr("*", "1 AS fit", "'s' AS score", "doc_id AS letters")
    out = langid.known_language(rows)
    assert out.columns == rows.columns and out.count() == rows.count()


def test_held_out_accuracy_on_driver_documents(spark):
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no test data here")
    rows = spark.read.parquet(f"{folder}/documents.parquet")
    both = langid.identify(rows).where("held_out").join(rows.select("doc_id", "lang"), "doc_id").where("lang is not null and lang_pred <> 'und'").collect()
    assert len(both) > 200 and sum(r["lang"] == r["lang_pred"] for r in both) >= 0.98 * len(both)
    kept = {r["doc_id"] for r in langid.known_language(rows).collect()}
    assert len(kept) >= 0.99 * rows.count()


def test_long_text_in_runs_scores_alike(spark, docs, monkeypatch):
    model = langid.train(corpus(docs))
    words = langid.Words([(EN + DE) * 300])
    whole = model.scores(words)
    monkeypatch.setattr(langid, "PIECE", 1)
    assert len(words.end) and words.end[-1] > 3 << 14 and np.allclose(whole, model.scores(words))
