import json
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from seamark.llm import tokencounts
from seamark.llm.common import table
from seamark.llm.queries import QUERIES

from .conftest import ODD

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = [" ", "  ", "\n", "a", "b", "ing", "'s", "é", "漢", "1", "!", " ", "\t", "<|endoftext|>", "<|", "　", "\U0001f642", "Z", "\x1c", "\x85"]


def library(texts):
    t = Tokenizer.from_file(PATH)
    return [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]


def mixed(n):
    r = random.Random(5)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(1, 40))) for _ in range(n)]


def test_counts_are_the_library_s():
    counter = tokencounts.Counter(PATH)
    texts = [*ODD, *mixed(3_000), "foo<|endoftext|>bar <|endoftext|>", "<|endoftext|>" * 3, "it's we'll 'S", " lead", "trail  "]
    assert [counter.tokens(x) for x in texts] == library(texts)


def test_a_small_memo_forgets_and_counts_alike(monkeypatch):
    monkeypatch.setattr(tokencounts, "MEMO_COUNTS", 3)
    counter = tokencounts.Counter(PATH)
    texts = mixed(300)
    assert [counter.tokens(x) for x in texts] == library(texts)
    assert len(counter.pieces) <= 3


def test_a_long_word_takes_little_more_than_its_share():
    word = "".join(random.Random(2).choice("abcdefgh") for _ in range(200_000))
    assert tokencounts.Counter(PATH).tokens(word) == library([word])[0]


def test_merges_by_hand():
    merges = tokencounts.Merges([("a", "b"), ("ab", "c"), ("c", "d"), ("a", "a")])
    assert [merges.left(w) for w in (b"", b"a", b"abcd", b"aaab", b"cdcd", b"xyz")] == [0, 1, 2, 2, 2, 3]


def test_rows(spark, docs):
    got = {r["doc_id"]: r for r in tokencounts.token_counts(docs(ODD).selectExpr("*", "1 AS n_tokens"), PATH, limit=3).collect()}
    want = library(ODD)
    for i, x in enumerate(ODD):
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((x or "").encode()), want[i], want[i] > 3)
    assert tokencounts.token_counts(docs([]), PATH).count() == 0
    twice = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in tokencounts.token_counts(twice, PATH).collect()) == [(0, 2), (1, 2), (1, 2)]


def test_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in table(spark, folder, "documents").collect()}
    rows = QUERIES["op12_token_counts"](spark, folder).collect()
    want = dict(zip(texts, library(texts.values())))
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == want
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) and r["n_bytes"] == len((texts[r["doc_id"]] or "").encode()) for r in rows)


def test_other_tokenizers_are_refused(tmp_path):
    settings = json.loads(Tokenizer.from_file(PATH).to_str())
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "use_regex": True}}):
        (tmp_path / "t.json").write_text(json.dumps(settings | change))
        with pytest.raises(ValueError):
            tokencounts.Counter(str(tmp_path / "t.json"))
