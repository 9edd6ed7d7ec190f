import hashlib
import random
import re

from seamark.llm import substring

from .conftest import ODD


def brute(rows):
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    first = {}
    for d, w in words:
        for i in range(len(w) - 12):
            k = tuple(w[i : i + 13])
            if d is not None:
                first[k] = min(d, first.get(k, d))
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - 12):
            if d is not None and first[tuple(w[i : i + 13])] < d:
                gone.update(range(i, i + 13))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((-1 if d is None else d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def result(df):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect())


def test_cover_has_every_difference():
    assert substring.is_cover(substring.COVER, substring.PERIOD)
    assert substring.ANCHOR + substring.PERIOD - 1 == substring.WINDOW
    assert not substring.is_cover((0, 1), 7)


def texts(seed):
    rng = random.Random(seed)
    passages = [[f"p{k}_{i}" for i in range(rng.randrange(11, 60))] for k in range(6)]
    out = []
    for _ in range(60):
        w = []
        for _ in range(rng.randrange(1, 5)):
            w += [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 30))]
            if rng.random() < 0.6:
                p = rng.choice(passages)
                a = rng.randrange(0, len(p) - 10)
                w += p[a : a + rng.randrange(10, 60)]
        out.append(rng.choice([" ", "\n", "  "]).join(w))
    return out + [out[0], out[0], out[3]]


def test_against_brute_force(spark, docs):
    rows = [*enumerate(texts(5) + ODD), (500, "r " * 40), (501, "r " * 20), (502, "R " * 40)]
    assert result(substring.without_repeats(docs(rows))) == brute(rows)


def test_every_alignment_of_thirteen_words(spark, docs):
    p = [f"p{i}" for i in range(13)]
    rows = [(0, " ".join(p))] + [(k + 1, " ".join([f"a{k}_{i}" for i in range(k)] + p + [f"z{k}"])) for k in range(20)]
    got = result(substring.without_repeats(docs(rows)))
    assert [r[2] for r in got] == [0] + [13] * 20 and got == brute(rows)


def test_null_ids_repeated_rows_clashing_columns_and_empty_table(spark, docs):
    t = " ".join(f"w{i}" for i in range(30))
    rows = [(None, t), (7, t), (7, t), (3, t + " x"), (7, "other " * 5 + t)]
    d = docs(rows).selectExpr("*", "1 AS h", "'x' AS starts", "true AS copy", "2 AS tk")
    assert result(substring.without_repeats(d)) == brute(rows)
    assert substring.without_repeats(docs([])).count() == 0


def test_a_full_filter_only_costs_time(spark, docs, monkeypatch):
    monkeypatch.setattr(substring, "BLOOM_BITS", 1 << 10)
    rows = list(enumerate(texts(6)))
    assert result(substring.without_repeats(docs(rows))) == brute(rows)
    kept = {r["doc_id"]: r["kept_text"] for r in substring.without_repeats(docs(rows), with_text=True).collect()}
    assert kept[0] == " ".join(rows[0][1].split())
