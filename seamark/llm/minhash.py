"""MinHash near-duplicates with sequential Bayesian verification.

Word shingles give a MinHash signature; bands of it propose pairs.  A pair's
signatures are compared in batches, and after each batch the pair is dropped
when the posterior probability (flat prior, binomial likelihood) that its
similarity reaches the threshold is below ``MISS``.  Survivors are verified on
their full shingle sets.

No group's pairs are ever listed.  Equal sets collapse to one representative.
In each bucket of a band the members are first compared with its smallest
member alone; what links into one component so needs no further comparison.
Buckets that still hold several components are finished exactly: small ones by
their open pairs, large ones together, in families of documents that share such
buckets, by blocks of ``BLOCK`` members against each other, where only links
leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.components import connected_components
from .common import bounded_batches, map_rows, only, to_arrow_schema, written
from .words import U, hashed, inside, mix, multipliers, signed, windows

SHINGLE, PERCENT = 4, 80
#: 40 bands of 6: a pair at the threshold shares no band with probability 6e-6.
BANDS, ROWS = 40, 6
HASHES = BANDS * ROWS
#: Values compared at once, and the chance taken to prune a pair at the threshold.
BATCH, MISS = 48, 1e-6
#: Members of a bucket whose open pairs are listed, and of a block.
SMALL, BLOCK = 32, 256

_M = (multipliers(HASHES, 11) >> U(32)).astype(np.uint32) | np.uint32(1)
_B = (multipliers(HASHES, 12) >> U(32)).astype(np.uint32)
_BAND = multipliers(ROWS, 13)


def least_matches(hashes: int, batch: int, percent: int, miss: float) -> list[tuple[int, int]]:
    """(values compared, fewest matches that keep a pair).

    With a flat prior, P(similarity >= t | m of n match) = P(Bin(n + 1, t) <= m).
    """
    t, out = percent / 100, []
    for n in range(batch, hashes + 1, batch):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append((n, m))
    return out


def survivors(a: np.ndarray, b: np.ndarray, bounds: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of two signature matrices that no batch prunes, and their matches."""
    live, matches, done = np.arange(len(a)), np.zeros(len(a), np.int32), 0
    for n, least in bounds:
        matches[live] += (a[live, done:n] == b[live, done:n]).sum(1)
        live, done = live[matches[live] >= least], n
    return live, matches[live]


def shingle_sets(column: pa.Array, shingle: int = SHINGLE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Slices of a text column: first text's number, distinct shingle hashes sorted by text and value, where each text's start."""
    for first, words, starts in hashed(column, lower=True):
        positions, text = inside(starts, shingle)
        h = windows(words, shingle, 21)[positions]
        count = np.diff(starts)
        short = np.flatnonzero((count > 0) & (count < shingle))
        if len(short):
            whole = [xxhash.xxh64_intdigest(words[starts[i] : starts[i + 1]].tobytes(), seed=22) for i in short]
            h, text = np.concatenate([h, np.array(whole, np.uint64)]), np.concatenate([text, short])
        order = np.lexsort((h, text))
        h, text = h[order], text[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
        h, text = h[new], text[new]
        yield first, h, np.searchsorted(text, np.arange(len(count) + 1))


def signatures(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One row of least hash values for each set that isn't empty."""
    full = starts[:-1][np.diff(starts) > 0]
    out = np.empty((HASHES, len(full)), np.uint32)
    x = (h >> U(32)).astype(np.uint32) ^ h.astype(np.uint32)
    with np.errstate(over="ignore"):
        for k in range(HASHES if len(full) else 0):
            v = x * _M[k]
            v += _B[k]
            v ^= v >> np.uint32(15)
            out[k] = np.minimum.reduceat(v, full)
    return np.ascontiguousarray(out.T)


def signed_documents(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, size and key of the set, band hashes and signature (null for an empty set)."""

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {"doc_id": batch.column(0), "n_shingles": [], "set_key": [], "bands": [], "sig": []}
            for _, h, starts in shingle_sets(batch.column(1), shingle):
                sigs = signatures(h, starts)
                with np.errstate(over="ignore"):
                    bands = mix((sigs.reshape(-1, BANDS, ROWS).astype(np.uint64) * _BAND).sum(2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
                row = 0
                for lo, hi in zip(starts[:-1], starts[1:]):
                    out["n_shingles"].append(hi - lo)
                    if hi == lo:
                        for k in ("set_key", "bands", "sig"):
                            out[k].append(None)
                        continue
                    out["set_key"].append(xxhash.xxh3_128_digest(h[lo:hi].tobytes()))
                    out["bands"].append(signed(bands[row]))
                    out["sig"].append(sigs[row].astype("<u2").tobytes())
                    row += 1
            return out

        return step

    return map_rows(only(docs, "doc_id", "text"), make, "doc_id long, n_shingles long, set_key binary, bands array<long>, sig binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(len(column), HASHES)


def likely(pairs: DataFrame, sigs: DataFrame, percent: int, miss: float) -> DataFrame:
    """Pairs (a, b) that sequential verification keeps, with their matching values."""
    bounds = least_matches(HASHES, BATCH, percent, miss)
    both = pairs.join(sigs.select(F.col("doc_id").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("doc_id").alias("b"), F.col("sig").alias("sb")), "b")

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            live, matches = survivors(_matrix(batch.column(2)), _matrix(batch.column(3)), bounds)
            return {"a": batch.column(0).take(pa.array(live)), "b": batch.column(1).take(pa.array(live)), "matches": matches}

        return step

    return map_rows(both.select("a", "b", "sa", "sb"), make, "a long, b long, matches int")


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def sets_of(column: pa.Array, shingle: int) -> list[np.ndarray]:
    return [h[lo:hi] for _, h, starts in shingle_sets(column, shingle) for lo, hi in zip(starts[:-1], starts[1:])]


def verified(pairs: DataFrame, texts: DataFrame, percent: int, shingle: int) -> DataFrame:
    """Pairs whose full shingle sets are similar enough."""
    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            left, right = sets_of(batch.column(2), shingle), sets_of(batch.column(3), shingle)
            keep = pa.array([i for i, (x, y) in enumerate(zip(left, right)) if linked(x, y, percent)], pa.int64())
            return {"a": batch.column(0).take(keep), "b": batch.column(1).take(keep)}

        return step

    return map_rows(both.select("a", "b", "ta", "tb"), make, "a long, b long")


def block_links(members: DataFrame, percent: int, shingle: int, miss: float) -> DataFrame:
    """Links between members (family, i, j, block, doc_id, component, sig, text) of two blocks, as far as they join components."""
    bounds = least_matches(HASHES, BATCH, percent, miss)
    schema = "a long, b long"
    arrow = to_arrow_schema(members.sparkSession, schema)

    def link(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        block, i, j = (group[k].to_numpy() for k in ("block", "i", "j"))
        ids, component = group["doc_id"].to_numpy(), group["component"].to_numpy()
        sig, texts = _matrix(group["sig"].combine_chunks()), group["text"].combine_chunks()
        left, right = np.flatnonzero(block == i[0]), np.flatnonzero(block == j[0])
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.get(x, x) != x:
                x = parent[x] = parent.get(parent[x], parent[x])
            return x

        sets: dict[int, np.ndarray] = {}

        def full(x: int) -> np.ndarray:
            if x not in sets:
                sets[x] = sets_of(texts.slice(x, 1), shingle)[0]
            return sets[x]

        found = []
        for x in left:
            others = right[(component[right] != component[x]) & ((i[0] != j[0]) | (right > x))]
            live, matches = survivors(np.broadcast_to(sig[x], (len(others), HASHES)), sig[others], bounds)
            for y in others[live[np.argsort(-matches, kind="stable")]]:
                if root(component[x]) != root(component[y]) and linked(full(x), full(y), percent):
                    parent[root(component[x])] = root(component[y])
                    found.append((ids[x], ids[y]))
        return pa.table({"a": [x for x, _ in found], "b": [y for _, y in found]}, schema=arrow)

    return members.groupBy("family", "i", "j").applyInArrow(link, schema)


def similar_components(docs: DataFrame, table: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, miss: float = MISS) -> DataFrame:
    """(node, component) of every linked representative; ``table`` is ``signed_documents``, written."""
    full = table.where("n_shingles > 0 and doc_id is not null")
    firsts = written(full.groupBy("set_key").agg(F.min("doc_id").alias("doc_id")))
    # One representative of each set; a doc_id that stands for several sets is one node.
    nodes = written(full.join(firsts, ["set_key", "doc_id"], "left_semi").dropDuplicates(["set_key", "doc_id"]).select("doc_id", "bands", "sig"))
    sigs, texts = nodes.select("doc_id", "sig"), only(docs, "doc_id", "text").where("text is not null")

    rows = nodes.select(F.explode("bands").alias("h"), "doc_id")
    # Written, so that the join that follows is free to split a hot bucket.
    hubs = written(rows.groupBy("h").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("last")).where("hub < last").select("h", "hub"))
    shared = written(rows.join(hubs, "h"))  # members of buckets of two or more
    stars = shared.where("doc_id <> hub").select(F.col("doc_id").alias("a"), F.col("hub").alias("b")).distinct()
    # One link is enough to join a component, so each member's likeliest is verified first.
    first = likely(stars, sigs, percent, miss).groupBy("a").agg(F.max_by("b", F.struct("matches", -F.col("b"))).alias("b"))
    links = written(verified(first, texts, percent, shingle))
    part = written(connected_components(links, written))

    now = shared.join(part, F.col("doc_id") == F.col("node"), "left").select("h", "doc_id", "hub", F.coalesce("component", "doc_id").alias("component"))
    state = written(now.groupBy("h").agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("h", "n"))
    unsettled = written(now.join(state, "h"))

    few = unsettled.where(F.col("n") <= SMALL)
    other = few.select("h", F.col("doc_id").alias("b"), F.col("component").alias("cb"))
    pairs = few.join(other, "h").where("doc_id > b and component <> cb").select(F.col("doc_id").alias("a"), "b").distinct()
    more = written(verified(likely(pairs, sigs, percent, miss), texts, percent, shingle))

    many = unsettled.where(F.col("n") > SMALL)
    found = [links, more]
    if not many.isEmpty():
        families = connected_components(many.where("doc_id <> hub").select(F.col("doc_id").alias("a"), F.col("hub").alias("b")), written)
        families = written(families.select(F.col("node").alias("doc_id"), F.col("component").alias("family")))
        sizes = families.groupBy("family").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        members = families.join(sizes, "family").withColumn("block", F.expr("cast(pmod(xxhash64(doc_id), blocks) as int)"))
        members = members.join(part, F.col("doc_id") == F.col("node"), "left").withColumn("component", F.coalesce("component", "doc_id")).drop("node")
        members = members.join(sigs, "doc_id").join(texts, "doc_id").withColumn("with", F.explode(F.expr("sequence(0, blocks - 1)")))
        members = members.select("family", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "doc_id", "component", "sig", "text")
        found.append(written(block_links(members, percent, shingle, miss)))
    edges = found[0]
    for x in found[1:]:
        edges = edges.unionByName(x)
    return connected_components(edges, written)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, miss: float = MISS) -> DataFrame:
    """One row per document row: size of its shingle set, smallest doc_id reachable, and whether that is its own.

    Null and empty texts have empty sets and are linked with nothing.  A row
    with a null doc_id is linked with nothing, has a null component and is kept.
    Rows that repeat a doc_id each get the component of their own text.
    """
    bounded_batches(docs.sparkSession)
    table = written(signed_documents(docs, shingle))
    components = similar_components(docs, table, shingle, percent, miss)
    firsts = written(table.where("n_shingles > 0 and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("first")))
    rows = table.select("doc_id", "n_shingles", "set_key").join(firsts, "set_key", "left").join(components, F.col("first") == F.col("node"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "first", "doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The documents, all columns, that are the smallest id of their group; rows without an id stay.

    An id that several rows share goes when none of them is kept.
    """
    gone = written(near_duplicates(docs, shingle, percent).groupBy("doc_id").agg(F.max("kept").alias("kept")).where("not kept").select("doc_id"))
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


#: All pairs of documents that share a shingle.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 2, 2))) AS r(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
t AS (SELECT doc_id AS v, doc_id AS r FROM d UNION SELECT l.b, t.r FROM t JOIN l ON l.a = t.v),
k AS (SELECT v, min(r) AS c FROM t GROUP BY v)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, k.c AS component_id, d.doc_id = k.c AS kept FROM d JOIN k ON k.v = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
