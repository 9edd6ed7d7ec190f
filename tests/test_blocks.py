"""The block index against scores worked out document by document."""

import math
import random
from collections import Counter

import pytest

from seamark.operators import bm25

SCHEMA = "doc_id long, file_path string, text string"


def corpus(n=400, seed=1):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    rows = [(i, f"p{i % 3}/d/{i}.txt", " ".join(r.choices(words, weights, k=r.randint(0, 80)))) for i in range(n)]
    # Copies tie; the smaller id goes first.
    return rows + [(n + i, "p0/d/copy.txt", rows[7][2]) for i in range(30)] + [(n + 40, "p1/x", None)]


def brute(rows, query):
    counts = {d: Counter((t or "").split()) for d, _, t in rows}
    size = {d: sum(c.values()) for d, c in counts.items()}
    n, mean = len(rows), sum(size.values()) / len(rows)
    out = {}
    for term, times in Counter(query.split()).items():
        df = sum(term in c for c in counts.values())
        if not df:
            continue
        idf = math.log((n - df + 0.5) / (df + 0.5))
        for d, c in counts.items():
            if c[term]:
                out.setdefault(d, [0.0, []])
                out[d][0] += times * idf * c[term] * 2.5 / (c[term] + 1.5 * (0.25 + 0.75 * size[d] / mean))
                out[d][1].append(term)
    return out


def test_best_documents_and_their_terms(spark, monkeypatch, tmp_path):
    rows = corpus()
    table = spark.createDataFrame(rows, SCHEMA).repartition(9)
    r = random.Random(4)
    asked = [(q, " ".join(r.choices([f"w{i}" for i in range(70)], k=r.randint(1, 12)))) for q in range(40)]
    questions = spark.createDataFrame(asked, "query_id long, query string")
    bm25.build(table).save(str(tmp_path))
    index = bm25.Index.load(spark, str(tmp_path))
    assert index.blocks.count() > 3
    want = {}
    for q, text in asked:
        found = [(math.floor(s * 1e9 + 0.5) / 1e9, d, sorted(t)) for d, (s, t) in brute(rows, text).items()]
        want[q] = [(d, pytest.approx(s, abs=2e-9), t) for s, d, t in sorted(found, key=lambda x: (-x[0], x[1])) if s >= 0.1][:5]

    def got(**more):
        out = {q: [] for q, _ in asked}
        for x in bm25.ranked(index, questions, 5, **more).orderBy("query_id", "rank").collect():
            out[x["query_id"]].append((x["doc_id"], x["score"], x["matched_terms"]))
        return out

    assert got() == want
    # The questions' terms in several parts.
    monkeypatch.setattr(bm25, "SENT_TERMS", 50)
    assert got() == want
    assert len(bm25.asked(index, questions)) > 2
    inside = {d for d, p, _ in rows if p.startswith("p1/")}
    assert all(d in inside for found in got(projects=["p1"]).values() for d, _, _ in found)
    scores = {(x["query_id"], x["doc_id"]): x["score"] for x in bm25.scored(index, questions).collect()}
    assert scores == {(q, d): pytest.approx(s, abs=1e-9) for q, text in asked for d, (s, _) in brute(rows, text).items()}


def test_postings_come_back_and_documents_leave(spark):
    rows = corpus(50)
    index = bm25.build(spark.createDataFrame(rows, SCHEMA).coalesce(1))
    want = {(t, d, n) for d, _, text in rows for t, n in Counter((text or "").split()).items()}
    assert {(x["term"], x["doc_id"], x["tf"]) for x in index.postings.collect()} == want
    gone = bm25.without(index.blocks.selectExpr("*", "array(0, 3, 5) AS dead"))
    left = {x["doc_id"] for x in bm25.postings(gone).collect()}
    out = {d for b in index.blocks.collect() for d in (b["doc_ids"][0], b["doc_ids"][3], b["doc_ids"][5])}
    assert left == {d for _, d, _ in want} - out
    df = {x["term"]: x["df"] for x in bm25.frequencies(gone).collect()}
    assert df == Counter(t for t, d, _ in want if d not in out)
    assert bm25.figures(gone).first()["n"] == len(rows) - len(out)


def test_empty_index(spark):
    index = bm25.build(spark.createDataFrame([], SCHEMA))
    q = spark.createDataFrame([(1, "alpha")], "query_id long, query string")
    assert bm25.ranked(index, q).count() == 0 and index.corpus.first()["n"] == 0
    with pytest.raises(ValueError):
        bm25.ranked(index, q, min_score=0)
