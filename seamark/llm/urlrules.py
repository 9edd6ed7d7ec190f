"""URL filter by association rules.

Spark's FP-growth mines token combinations of URLs that are labelled bad; those
that conclude the label with enough confidence and support, surely above the
share of bad pages, that no shorter rule of the same or higher confidence makes
needless, and that hold on pages held back, are kept as rules.
They are matched by an inverted index from a rule's rarest token to the rules.
Fixed host and path rules come first; the longest that fits wins.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import freed, map_batches, map_rows, only, to_arrow_schema, written

#: (verdict, host, path prefix)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
SUPPORT, CONFIDENCE = 0.01, 0.5
#: Fewest bad pages of a rule, and deviations by which its confidence must exceed the share of bad pages.
LEAST_HITS, SURE = 5, 3.0
A_Z, a_z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)\A.*?://([^/?#]*)([^?#]*)"

SCHEMA = "page_id long, host string, path string, rule string, verdict string, score double"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), A_Z, a_z)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def tokens_of(url: str | None, host: str, path: str) -> list[str]:
    """Distinct tokens of a URL: labels of the host, words of the path by depth, names of query parameters; numbers as their length."""
    found = [f"h:{x}" for x in host.split(".") if x]
    for depth, part in enumerate(x for x in path.split("/") if x):
        found += [f"p{min(depth, 3)}:{'#' * len(x) if x.isdigit() else x.lower()}" for x in re.split(r"[^0-9A-Za-z\x80-\U0010ffff]+", part) if x]
    query = (url or "").partition("?")[2].partition("#")[0]
    found += [f"q:{x.partition('=')[0].lower()}" for x in query.split("&") if x]
    scheme = (url or "").partition("://")[0].lower()
    return sorted({*found, f"s:{scheme}"} if host else set(found))


def token_rows(pages: DataFrame) -> DataFrame:
    """page_id, url, host, path and tokens."""
    rows = only(pages, "page_id", "url").select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            url, host, path = (batch.column(k).to_pylist() for k in (1, 2, 3))
            return {"page_id": batch.column(0), "url": url, "host": host, "path": path, "tokens": [tokens_of(*x) for x in zip(url, host, path)]}

        return step

    return map_rows(rows, make, "page_id long, url string, host string, path string, tokens array<string>")


def document_number(path: Column) -> Column:
    """The first path part that is a whole number, as the id of the page's document; null if there is none."""
    return F.try_to_number(F.regexp_extract(path, r"/([0-9]{1,18})(?=/|$)", 1), F.lit("9" * 18)).cast("long")


def labelled(rows: DataFrame, labels: DataFrame, by_number: bool = False) -> DataFrame:
    """Tokens of every labelled page with ``bad``, where its label is toxic or of low quality, and ``held``, the three tenths that rules are tried on.

    A label belongs to the page of the same id or, ``by_number``, to the pages
    whose URL names its document.  A page with several labels counts once, as
    bad if one of them is.
    """
    bad = only(labels, "doc_id", "quality", "toxic").where("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce((F.col("toxic") == 1) | (F.col("quality") == 0), F.lit(False))).alias("bad"))
    keyed = rows.withColumn("key", document_number(F.col("path")) if by_number else F.col("page_id")).where("key is not null and size(tokens) > 0")
    both = keyed.join(bad, keyed["key"] == bad["doc_id"])
    # All pages of one document are on one side.
    return both.select("tokens", "bad", (F.pmod(F.xxhash64("key"), F.lit(10)) < 3).alias("held"))


def matched(transactions: DataFrame, sets: list[tuple[str, ...]]) -> dict[int, tuple[int, int]]:
    """For each token set, by its number, the transactions that hold it and the bad ones among them."""
    shared = transactions.sparkSession.sparkContext.broadcast(sets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, of, hits = SetIndex(shared.value), Counter(), Counter()
        for batch in batches:
            for tokens, bad in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = list(index.within(tokens))
                of.update(found)
                if bad:
                    hits.update(found)
        yield pa.RecordBatch.from_arrays([pa.array(list(of), pa.int32()), pa.array(list(of.values()), pa.int64()), pa.array([hits[k] for k in of], pa.int64())], schema=arrow)

    schema = "rule int, of long, hits long"
    arrow = to_arrow_schema(transactions.sparkSession, schema)
    counts = map_batches(transactions.select("tokens", "bad"), run, schema).groupBy("rule").agg(F.sum("of").alias("of"), F.sum("hits").alias("hits"))
    return {r["rule"]: (r["of"], r["hits"]) for r in counts.collect()}


def least_confidence(hits: int, of: int) -> float:
    """Lower end of Wilson's interval for the confidence, ``SURE`` deviations wide."""
    if not of:
        return 0.0
    p, z = hits / of, SURE * SURE / of
    return (p + z / 2 - SURE * math.sqrt((p * (1 - p) + z / 4) / of)) / (1 + z)


def mined_rules(transactions: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, least: int = LEAST_HITS) -> list[tuple[tuple[str, ...], float, int]]:
    """(tokens, confidence, support count) of the rules that conclude a bad page.

    FP-growth mines the bad pages that are not held back; the sets it finds are
    then counted over all pages.  A rule stays if its confidence is high enough
    and surely above the share of bad pages, and if on the pages held back it
    is right more often than that share.  The number of frequent sets has a
    bound that doesn't depend on the number of rows, as each is in a
    ``support`` share of the transactions; so they may be collected.
    """
    train, held = transactions.where("not held"), transactions.where("held")
    n, n_bad = train.agg(F.count("*"), F.count_if("bad")).first()
    if n_bad < least:
        return []
    needed = max(least, math.ceil(support * n))
    model = FPGrowth(itemsCol="tokens", minSupport=min(1.0, (needed - 0.5) / n_bad)).fit(train.where("bad").select("tokens"))
    sets = [tuple(sorted(r["items"])) for r in model.freqItemsets.where(F.col("freq") >= needed).select("items").collect()]
    base = n_bad / n
    rules = [(sets[k], hits / of, hits) for k, (of, hits) in matched(train, sets).items() if hits >= needed and hits >= confidence * of and least_confidence(hits, of) > base] if sets else []
    rules = pruned(rules)
    tried = matched(held, [r[0] for r in rules]) if rules else {}
    return [r for k, r in enumerate(rules) if k in tried and tried[k][1] > base * tried[k][0]]


class SetIndex:
    """From a token to the numbers of the sets that are filed under it: each under its rarest among all."""

    def __init__(self, sets: list[tuple[str, ...]]):
        count = Counter(t for s in sets for t in s)
        self.filed: dict[str, list[tuple[int, frozenset[str]]]] = defaultdict(list)
        for k, s in enumerate(sets):
            self.filed[min(s, key=lambda t: (count[t], t))].append((k, frozenset(s)))

    def within(self, tokens: Iterable[str]) -> Iterator[int]:
        have = set(tokens)
        return (k for t in have for k, need in self.filed.get(t, ()) if need <= have)


def pruned(rules: Iterable[tuple[tuple[str, ...], float, int]]) -> list[tuple[tuple[str, ...], float, int]]:
    """Without rules that a rule of fewer of their tokens matches at the same or a higher confidence."""
    kept: list[tuple[tuple[str, ...], float, int]] = []
    index = RuleIndex([])
    for rule in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        if index.best(rule[0]) < rule[1]:
            kept.append(rule)
            index.add(rule)
    return kept


class RuleIndex:
    """From a token to the rules that are filed under it: each under its rarest among the rules."""

    def __init__(self, rules: Iterable[tuple[tuple[str, ...], float, int]]):
        rules = list(rules)
        self.count = Counter(t for tokens, _, _ in rules for t in tokens)
        self.filed: dict[str, list[tuple[frozenset[str], float]]] = defaultdict(list)
        for rule in rules:
            self.add(rule)

    def add(self, rule: tuple[tuple[str, ...], float, int]) -> None:
        tokens = rule[0]
        self.filed[min(tokens, key=lambda t: (self.count[t], t))].append((frozenset(tokens), rule[1]))

    def best(self, tokens: Iterable[str]) -> float:
        """The highest confidence of a rule whose tokens are all among these; 0 if there is none."""
        have = set(tokens)
        return max((c for t in have for need, c in self.filed.get(t, ()) if need <= have), default=0.0)


def fixed_rule(host: str, path: str, rules: tuple = RULES) -> tuple[str, str] | None:
    """(rule, verdict) of the longest fixed rule that fits."""
    fits = [(h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda x: len(x[0]), default=None)


def judged(pages: DataFrame, labels: DataFrame, rules: tuple = RULES, support: float = SUPPORT, confidence: float = CONFIDENCE, by_number: bool = False) -> DataFrame:
    """One row per page row: host, path, fixed rule or null, verdict, best mined confidence.

    A null URL or one without ``://`` has an empty host and path; it has no
    tokens and is allowed, as every URL is that no rule blocks.  Without labels,
    or where none of their rules is sure, nothing is mined.  Rows that repeat a
    page_id are judged each.
    """
    rows = token_rows(pages)
    transactions = written(labelled(rows, labels, by_number))
    mined = rows.sparkSession.sparkContext.broadcast(mined_rules(transactions, support, confidence))
    freed(transactions)

    def make():
        index = RuleIndex(mined.value)

        def step(batch: pa.RecordBatch) -> dict:
            host, path, tokens = (batch.column(k).to_pylist() for k in (1, 2, 3))
            fixed = [fixed_rule(h, p, rules) for h, p in zip(host, path)]
            score = [index.best(t) for t in tokens]
            return {"page_id": batch.column(0), "host": host, "path": path, "rule": [f and f[0] for f in fixed], "verdict": [f[1] if f else "block" if s else "allow" for f, s in zip(fixed, score)], "score": score}

        return step

    return map_rows(rows.select("page_id", "host", "path", "tokens"), make, SCHEMA)
