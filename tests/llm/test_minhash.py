import random

import numpy as np
import pytest

from seamark.llm import minhash

from .conftest import ODD


def shingles(t, n=4):
    w = (t or "").translate({c: c + 32 for c in range(65, 91)}).replace("\x0b", " ").replace("\x0c", " ")
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", w) if x]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, n=4):
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(sets[i]), least[find(i)], d == least[find(i)]) for i, (d, _) in enumerate(rows))


def families(seed, groups=12, copies=14):
    rng = random.Random(seed)
    out = []
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(rng.randrange(20, 160))]
        for _ in range(rng.randrange(1, copies)):
            w = list(base)
            for _ in range(rng.randrange(0, 8)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            out.append(" ".join(w))
    rng.shuffle(out)
    return list(enumerate(out))


def result(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("small", [32, 1])
def test_against_brute_force(spark, docs, monkeypatch, small):
    """With ``SMALL`` at 1 every open bucket goes the way of the large ones, in blocks of 8."""
    monkeypatch.setattr(minhash, "SMALL", small)
    monkeypatch.setattr(minhash, "BLOCK", 8 if small == 1 else 256)
    rows = families(3) + [(1000 + i, t) for i, t in enumerate(ODD)] + [(2000, "A b C d e"), (2001, "a B c D e"), (2002, "a b"), (2003, "A  B")]
    assert result(minhash.near_duplicates(docs(rows))) == brute(rows)


def test_chain_reaches_its_smallest_id(spark, docs):
    words = [f"w{i}" for i in range(200)]
    rows = [(9 - k, " ".join(words[10 * k : 10 * k + 100])) for k in range(6)]
    rows = [(9 - k, " ".join(words[2 * k : 2 * k + 100])) for k in range(8)]
    assert {r[2] for r in result(minhash.near_duplicates(docs(rows)))} == {2}


def test_null_ids_repeated_rows_and_empty_table(spark, docs):
    t = "some words that are long enough to count here"
    rows = docs([(None, t), (4, t), (4, t), (2, t), (5, None)]).selectExpr("*", "1 AS a", "2 AS component_id")
    got = minhash.near_duplicates(rows).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in got) == [(0, 0, True), (2, 2, True), (4, 2, False), (4, 2, False), (5, 5, True)]
    assert minhash.near_duplicates(docs([])).count() == 0
    assert sorted(r["doc_id"] or 0 for r in minhash.without_near_duplicates(rows).collect()) == [0, 2, 5]


def test_sequential_bounds_keep_similar_pairs():
    bounds = minhash.least_matches(240, 48, 80, 1e-6)
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 16, (4000, 240))
    b = np.where(rng.random(a.shape) < 0.8, a, a + 1)
    assert len(minhash.survivors(a, b, bounds)[0]) >= 3999
    far = np.where(rng.random(a.shape) < 0.4, a, a + 1)
    assert len(minhash.survivors(a, far, bounds)[0]) == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    pool = minhash.mix(rng.integers(0, 1 << 63, 1000).astype(np.uint64))
    x, y = np.sort(pool[:800]), np.sort(pool[200:])
    s = minhash.signatures(np.concatenate([x, y]), np.array([0, 800, 1600]))
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.12
