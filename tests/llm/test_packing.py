import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from seamark.llm import packing

from .conftest import ODD

PATH = public_tokenizers.path("word_bpe_49k.json")


def ids_of(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return [[*t.encode(x or "", add_special_tokens=False).ids, 2] for x in texts]


def check(rows, ids):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for d, want in enumerate(ids):
        at = 0
        for r in sorted(pieces[d], key=lambda r: r["start"]):
            part = np.array(want[at : at + r["length"]], "<u4").tobytes()
            assert r["start"] == at and r["doc_tokens"] == len(want) and r["ids_crc32"] == zlib.crc32(part)
            at += r["length"]
        assert at == len(want)
    for rs in sequences.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096 and at & (at - 1) == 0 and {r["tier"] for r in rs} == {at}


def test_every_id_once_and_no_padding(spark, docs):
    rng = random.Random(3)
    texts = ODD + [" ".join(rng.choice(["alpha", "Beta,", "it's", "x1y2", "déjà", "<|endoftext|>"]) for _ in range(int(10 ** rng.uniform(0, 3.8)))) for _ in range(80)]
    rows = packing.pack_documents(docs(texts).repartition(3).selectExpr("*", "1 AS start", "2 AS tier"), PATH).collect()
    check(rows, ids_of(texts))


def test_null_and_repeated_ids_and_empty_table(spark, docs):
    rows = packing.pack_documents(docs([(None, "a b"), (1, "c"), (1, "c"), (2, None)]), PATH, with_ids=True).collect()
    assert sum(r["length"] for r in rows) == 3 + 2 + 2 + 1
    assert [list(r["input_ids"]) for r in rows if r["doc_id"] == 2] == [[2]]
    assert packing.pack_documents(docs([]), PATH).count() == 0


def test_words_have_the_tokenizers_ids():
    words, rng = packing.WordIds(PATH), random.Random(8)
    signs = list("aAbZ09 \n\t\x0b\x0c\x1c\x85\xa0.,'’<|>-_#sStTéÉÈßñÑüöŞİıſΣσςé̈̈中ก🙂½²٣​") + ["'s", "<|endoftext|>", "don't"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 24))) for _ in range(3000)]
    assert [[*np.frombuffer(words.ids(t), "<u4").tolist(), 2] for t in texts] == ids_of(texts)


def test_small_memo_gives_the_same(monkeypatch):
    monkeypatch.setattr(packing, "MEMO_WORDS", 3)
    words = packing.WordIds(PATH)
    text = "One, two. Three! four, One, two. déjà vu"
    assert np.frombuffer(words.ids(text), "<u4").tolist() == ids_of([text])[0][:-1]


def test_tiers_fill_longest_first():
    p = packing.Packer((8, 4))
    whole = list(p.add(0, 19))
    assert whole == [(8, [(0, 0, 8)]), (8, [(0, 8, 8)])]
    list(p.add(1, 6)), list(p.add(2, 2)), list(p.add(3, 4))
    done = list(p.flush())
    assert sorted(t for t, _ in done) == [1, 2, 4, 8] or sum(sum(x[2] for x in w) for _, w in done) == 15
    assert done[0] == (8, [(1, 0, 6), (2, 0, 2)])
    with pytest.raises(ValueError):
        packing.Packer((100,))


def test_step_groups_are_even():
    sizes = [4096] * 10 + [512] * 100 + [1024] * 7
    groups = packing.step_groups(sizes, 5, 16384)
    total = defaultdict(int)
    for s, g in zip(sizes, groups):
        total[g] += s
    assert min(total) == 5 and max(total.values()) - min(total.values()) <= 4096


def test_other_tokenizers_encode_whole_texts(spark, docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["Hello  World, it's\n\nfine", "x" * 300, "", "É漢字 A B"]
    words, plain = packing.WordIds(path), Tokenizer.from_file(path)
    assert packing.WordIds(PATH).by_words and not words.by_words
    for t in texts:
        assert words.ids(t) == np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_memo_ages_and_stays_right(monkeypatch):
    monkeypatch.setattr(packing, "MEMO_WORDS", 20)
    words, fresh = packing.WordIds(PATH), packing.WordIds(PATH)
    rng = random.Random(4)
    for _ in range(60):
        text = " ".join(rng.choice("abcdefghij") * rng.randint(1, 9) for _ in range(50))
        assert words.ids(text) == fresh.encoded(text)
        assert len(words) <= 40 and len(words.old) <= 40 and len(words.cores) <= 80
