import hashlib
import random
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from seamark.llm import alignment
from seamark.llm.common import table
from seamark.llm.queries import QUERIES
from seamark.llm.tokencounts import byte_signs

from .conftest import ODD

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
FIELDS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
PARTS = [" ", "  ", "\n", "a", "b", "ing", "'s", "é", "漢字", "1", "!", " ", "\t", "<|endoftext|>", "<s>", "<0x41>", "▁", "\U0001f642", "Zürich"]


@pytest.fixture(scope="module")
def sides():
    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    byte = {s: k for k, s in byte_signs().items()}

    def of_a(text):
        ids = a.encode(" " + text, add_special_tokens=False).ids
        return [(i, bytes(byte[c] for c in a.id_to_token(i))) for i in ids]

    def of_b(text):
        return [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]

    return of_a, of_b


def brute(texts, sides):
    """As the definition says, token by token."""
    linked, held = {}, Counter()
    out = {}
    for d, text in texts.items():
        tokens = [side(text) for side in sides] if text else [[], []]
        if not text or any(b"".join(t for _, t in side) != (" " + text).encode() for side in tokens):
            out[d], linked[d] = [0] * 6 + [""], Counter()
            continue
        ends = [np.cumsum([len(t) for _, t in side]).tolist() for side in tokens]
        common = sorted(set(ends[0]) & set(ends[1]))
        groups = defaultdict(lambda: ([], []))
        for k in (0, 1):
            for (i, _), end in zip(tokens[k], ends[k]):
                groups[common[bisect_left(common, end)]][k].append(i)
        linked[d] = Counter((x, y) for c in common for x in groups[c][0] for y in groups[c][1])
        held.update(linked[d].keys())
        said = ";".join(",".join(map(str, groups[c][0])) + "|" + ",".join(map(str, groups[c][1])) for c in common)
        out[d] = [len(tokens[0]), len(tokens[1]), len(common), sum(linked[d].values()), 0, 0, hashlib.sha256(said.encode()).hexdigest()]
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    for d, pairs in linked.items():
        out[d][4] = sum(n for p, n in pairs.items() if held[p] == best[p[0]])
        out[d][5] = sum(n * held[p] for p, n in pairs.items())
    return out


def found(df):
    return {r["doc_id"]: [r[f] for f in FIELDS] for r in df.collect()}


def mixed(n, seed=3):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(1, 30))) for _ in range(n)]


def test_same_as_definition(spark, docs, sides):
    texts = [*ODD, *mixed(300), *["the very same text here"] * 150, " lead", "trail  ", "a▁b", "foo <|endoftext|> <s> bar"]
    want = brute(dict(enumerate(texts)), sides)
    assert found(alignment.aligned(docs(texts).repartition(5), A, B)) == want


def test_small_memo_stripes_salts_and_chunks(spark, docs, sides, monkeypatch):
    for name, value in (("MADE_AT_ONCE", 6), ("HELD_PAIRS", 20), ("SALT_LINKS", 50), ("AT_ONCE", 7), ("MEMO_PIECES", 20)):
        monkeypatch.setattr(alignment, name, value)
    aligner = alignment.Aligner(A, B)
    texts = ["x" * 3_000, "ab" * 500, *mixed(60, 9)]
    block = alignment.Block(aligner, texts)
    want = brute(dict(enumerate(texts)), sides)
    assert block.figures.T.tolist() == [want[i][:4] for i in range(len(texts))] and block.digests == [want[i][6] for i in range(len(texts))]
    assert found(alignment.aligned(docs(texts), A, B)) == want


def test_arrays_come_back():
    arrays = [np.array([0, 255]), np.array([], np.int64), np.array([1 << 40, 3]), np.array([65_536])]
    assert [x.tolist() for x in alignment.unpacked(alignment.packed(*arrays))] == [x.tolist() for x in arrays]


def test_empty_and_clashing_tables(spark, docs):
    assert alignment.aligned(docs([]), A, B).count() == 0
    odd = docs(["one two", None]).selectExpr("doc_id", "text", "1 AS block", "2 AS stripe", "'x' AS kind", "3 AS n_a")
    assert {k: v[0] for k, v in found(alignment.aligned(odd, A, B)).items()} == {0: 2, 1: 0}
    twice = spark.createDataFrame([(None, "one two"), (1, "one two"), (1, "one two"), (None, "")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["n_links"], r["count_sum"]) for r in alignment.aligned(twice, A, B).collect()) == [(0, 0, 0), (0, 2, 6), (1, 2, 6), (1, 2, 6)]


def test_whole_table(spark, sides):
    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in table(spark, folder, "documents").collect()}
    assert found(QUERIES["op13_alignment"](spark, folder)) == brute(texts, sides)
