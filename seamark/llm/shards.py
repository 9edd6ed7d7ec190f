"""K-d tree sharding by distributed weighted medians, in DataFrame operations only.

Each document is a point of its metadata (size, id, source, language) with its
bytes as weight.  A node above the target bytes is split along its widest
dimension, at the weighted median or, where an odd number of leaves is due, next
to it; leaves are at the target.  Strings count by their place among the distinct
values.  A dimension's value and then a hash of the row and its place in the input
make one 62-bit coordinate, so that a value that a third of all rows share, and
rows that are equal in everything, can be cut too.  The median is found
by histograms of ``1 << STEP_BITS`` cells, first over the whole coordinate, then
over the cell that holds half the bytes, and so on: a few aggregations that
combine map-side, never a sort of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import only, written

SHARDS = 16
#: Bits of a coordinate that one histogram resolves, of the value, and of the hash below it.
STEP_BITS, VALUE_BITS, HASH_BITS = 10, 31, 31
#: Rows of one shard, and distinct values of a string, that are numbered in one task, about.
SLOT_ROWS = RANGE_VALUES = 50_000

DIMENSIONS = ("size", "doc_id", "source", "lang")


def places(docs: DataFrame, column: str) -> DataFrame:
    """Every distinct value of a string column and its place in their order, from 1.

    Values are dealt into ranges of about ``RANGE_VALUES``, numbered within each
    range, and shifted by what the ranges before it hold.
    """
    values = written(docs.select(column).where(F.col(column).isNotNull()).distinct())
    parts = values.repartitionByRange(max(1, -(-values.count() // RANGE_VALUES)), column)
    # Written, so that a value's range stays what it was.
    parts = written(parts.withColumn("range", F.spark_partition_id()))
    counts = parts.groupBy("range").agg(F.count("*").alias("n"))
    before = counts.select("range", (F.sum("n").over(W.orderBy("range")) - F.col("n")).alias("before"))  # one row a range
    row = F.row_number().over(W.partitionBy("range").orderBy(column))
    return written(parts.withColumn("row", row).join(before, "range").select(column, (F.col("before") + F.col("row")).alias(f"{column}_place")))


def points(docs: DataFrame) -> DataFrame:
    """doc_id, bytes, crc, one number for each dimension, and a hash that tells rows apart.

    Null metadata sort lowest.
    """
    docs = only(docs, "doc_id", "text", "source", "lang")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    rows = docs.select(
        "doc_id",
        size.alias("bytes"),
        F.crc32(F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))).alias("crc"),
        size.alias("size"),
        "source",
        "lang",
        F.xxhash64("doc_id", "source", "lang", "text", F.monotonically_increasing_id()).bitwiseAND(F.lit((1 << HASH_BITS) - 1)).alias("tie"),
    )
    rows = written(rows)  # without texts, and with its hashes settled
    for c in ("source", "lang"):
        rows = rows.join(places(rows, c), c, "left").drop(c).withColumn(c, F.coalesce(f"{c}_place", F.lit(0))).drop(f"{c}_place")
    return rows


def scaled(table: DataFrame) -> DataFrame:
    """Every dimension shifted to 0 and scaled to ``VALUE_BITS``, so that widths compare."""
    ranges = table.agg(*[f(d).alias(f"{k}_{d}") for d in DIMENSIONS for k, f in (("lo", F.min), ("hi", F.max))]).first()
    out = []
    for d in DIMENSIONS:
        lo, hi = ranges[f"lo_{d}"] or 0, ranges[f"hi_{d}"] or 0
        unit = ((1 << VALUE_BITS) - 1) / max(1, hi - lo)
        value = F.floor((F.coalesce(F.col(d), F.lit(lo)).cast("decimal(38,0)") - F.lit(lo).cast("decimal(38,0)")).cast("double") * F.lit(unit)).cast("long")
        out.append(F.least(F.greatest(value, F.lit(0)), F.lit((1 << VALUE_BITS) - 1)).alias(f"x_{d}"))
    return table.select("doc_id", "bytes", "crc", "tie", *out)


def coordinate(dimension: str) -> Column:
    return F.shiftleft(F.col(f"x_{dimension}"), HASH_BITS).bitwiseOR(F.col("tie"))


def _per_node(values: dict[int, Column]) -> Column:
    """One of a few columns by the row's node."""
    out = F.lit(None).cast("long")
    for node, value in values.items():
        out = F.when(F.col("node") == node, value).otherwise(out)
    return out


def medians(table: DataFrame, dimension: dict[int, str], share: dict[int, float]) -> dict[int, int]:
    """For each node the least coordinate that puts ``share`` of its bytes, or as near as rows allow, at or below it."""
    low = {n: 0 for n in dimension}
    width = {n: VALUE_BITS + HASH_BITS for n in dimension}
    want: dict[int, float] = {}
    total: dict[int, int] = {}
    below = {n: 0 for n in dimension}
    live = set(dimension)
    table = table.withColumn("at", _per_node({n: coordinate(d) for n, d in dimension.items()}))
    while live:
        cell = _per_node({n: F.shiftright(F.col("at") - F.lit(low[n]), max(0, width[n] - STEP_BITS)) for n in live})
        inside = F.lit(False)
        for n in live:
            inside = inside | ((F.col("node") == n) & (F.col("at") >= low[n]) & (F.col("at") < low[n] + (1 << width[n])))
        cells: dict[int, list[tuple[int, int, int]]] = {n: [] for n in live}
        for r in table.where(inside).groupBy("node", cell.alias("cell")).agg(F.sum("bytes").alias("b"), F.count("*").alias("rows")).collect():  # at most 1 << STEP_BITS cells a node
            cells[r["node"]].append((r["cell"], r["b"], r["rows"]))
        for n in list(live):
            if n not in total:
                total[n] = sum(b for _, b, _ in cells[n])
                want[n] = total[n] * share[n]
            step = max(0, width[n] - STEP_BITS)
            here = below[n]
            for c, b, rows in sorted(cells[n]):
                if here + b >= want[n] or c == max(cells[n])[0]:
                    break
                here += b
            if step == 0 or rows == 1 or b <= total[n] >> 14:
                # The cell stays whole on the nearer side.
                up = abs(here + b - want[n]) <= abs(here - want[n])
                low[n] += ((c + up) << step) - 1
                live.discard(n)
            else:
                low[n] += c << step
                width[n], below[n] = step, here
    return low


def kd_shards(docs: DataFrame, shards: int = SHARDS, target_bytes: int | None = None) -> DataFrame:
    """One row per document row: its leaf as shard, and a gapless number there.

    The target is ``target_bytes``, or else a ``shards``-th of all bytes; a node
    is due as many leaves as its bytes hold targets.  A null text has no bytes
    but its row still weighs 1; null metadata sort lowest; equal rows are told
    apart by their place in the input, so any number of them is spread as
    others are.  An empty table gives an empty result.
    """
    table = written(scaled(points(docs)))
    if target_bytes:
        shards = max(1, -(-(table.agg(F.sum("bytes")).first()[0] or 0) // target_bytes))
    nodes, leaf_id = {0: shards}, 1
    table = table.withColumn("node", F.lit(0))
    while any(n > 1 for n in nodes.values()):
        split = {k: n for k, n in nodes.items() if n > 1}
        spread = table.groupBy("node").agg(*[(F.max(f"x_{d}") - F.min(f"x_{d}")).alias(d) for d in DIMENSIONS]).collect()  # one row a node
        widest = {r["node"]: max(DIMENSIONS, key=lambda d: r[d]) for r in spread if r["node"] in split}
        cuts = medians(table, widest, {k: (split[k] + 1) // 2 / split[k] for k in widest}) if widest else {}
        above = F.lit(None).cast("int")
        for k, n in split.items():
            nodes[k], nodes[leaf_id] = (n + 1) // 2, n // 2
            if k in cuts:
                above = F.when((F.col("node") == k) & (coordinate(widest[k]) > F.lit(cuts[k])), F.lit(leaf_id)).otherwise(above)
            leaf_id += 1
        table = written(table.withColumn("node", F.coalesce(above, F.col("node"))))  # else the cuts of all levels pile up in one expression
    table = table.select("doc_id", "bytes", "crc", "tie", F.col("node").alias("shard"))
    # Numbers: counts of small parts of each shard give the offset, and only a part is sorted.
    rows = table.count()
    parts = max(4, -(-rows // (shards * SLOT_ROWS)))
    table = table.withColumn("part", F.expr(f"pmod(tie, {parts})"))
    counts = table.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = counts.select("shard", "part", (F.sum("n").over(W.partitionBy("shard").orderBy("part")) - F.col("n")).alias("before"))
    numbered = table.withColumn("row", F.row_number().over(W.partitionBy("shard", "part").orderBy("tie", "doc_id", "crc", "bytes")))
    return numbered.join(before, ["shard", "part"]).select(
        "doc_id", F.col("bytes").alias("size"), F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("before") + F.col("row") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
