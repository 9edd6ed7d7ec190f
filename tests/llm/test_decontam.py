import hashlib
import re

from seamark.llm import decontam

from .conftest import ODD


def words(t):
    low = (t or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(texts, items):
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for item, it in items:
            if item is None or it is None:
                continue
            iw = words(it)
            k = min(13, len(iw))
            for a in range(len(iw) - k + 1 if k else 0):
                for b in range(len(w) - k + 1):
                    if w[b : b + k] == iw[a : a + k]:
                        hit.update(range(b, b + k))
                        found.add(str(item))
        ids = ",".join(sorted(found))
        out.append((len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


LONG = " ".join(f"w{i}" for i in range(40))
TEXTS = [*ODD, f"intro {LONG} end", LONG.upper().replace(" ", ", "), "x " * 500 + LONG, "short item here", "the short item", " ".join(f"w{i}" for i in range(12)), "w0-w1-w2 " + LONG, "éa éb éc"]
ITEMS = [(1, LONG), (2, "Short, item!"), (3, None), (None, "x x"), (10, ""), (11, "éA Éb"), (2, "éa ÉB")]


def test_against_brute_force(spark, docs):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontam.decontaminate(docs(TEXTS), bench).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == brute(TEXTS, ITEMS)


def test_blocks_give_the_same(spark, docs, monkeypatch):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    table = docs([*TEXTS, (None, LONG), (3, LONG), (3, LONG)]).selectExpr("*", "1 AS row", "2 AS block")
    run = lambda: sorted(map(str, decontam.decontaminate(table, bench).collect()))
    clean = lambda: sorted(map(str, decontam.clean_documents(table, bench).collect()))
    spans = lambda: sorted(map(str, decontam.contaminated_spans(table, bench).collect()))
    whole = run(), clean(), spans()
    monkeypatch.setattr(decontam, "MAX_BLOCK_BYTES", 60)
    assert decontam.benchmark_blocks(bench)[1] > 1
    assert (run(), clean(), spans()) == whole


def test_segments_hold_every_window():
    text = " ".join(f"w{i}" for i in range(500))
    parts = list(decontam.segments(text, 64))
    assert len(parts) > 10
    words = text.split()
    windows = {tuple(words[i : i + 13]) for i in range(len(words) - 12)}
    assert {tuple(p.split()[i : i + 13]) for p in parts for i in range(len(p.split()) - 12)} == windows
    assert list(decontam.segments("A, b")) == ["a b"] and list(decontam.segments("")) == []


def test_empty_tables_null_ids_and_more_columns(spark, docs):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontam.decontaminate(docs([LONG]), empty).first()["n_hit"] == 0
    bench = spark.createDataFrame([(1, LONG)], "item_id long, text string")
    assert decontam.decontaminate(docs([]), bench).count() == 0
    odd = docs([(None, LONG), (5, LONG), (5, LONG)]).selectExpr("*", "1 AS n_words", "2 AS item_id")
    assert [r["contaminated"] for r in decontam.decontaminate(odd, bench).collect()] == [True] * 3
    assert decontam.clean_documents(odd.union(docs([(9, "clean")]).selectExpr("*", "1", "2")), bench).select("doc_id", "item_id").collect() == [(9, 2)]


def test_spans_are_places_in_the_original(spark, docs):
    text = "É! Intro;  W0,W1 -- w2 tail"
    bench = spark.createDataFrame([(7, "w0 w1 w2")], "item_id long, text string")
    r = decontam.contaminated_spans(docs([text]), bench).first()
    assert (r["item_id"], text[r["char_start"] : r["char_end"]]) == ("7", "W0,W1 -- w2")
