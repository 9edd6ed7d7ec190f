"""A keyword index that follows a stream of changed and deleted files.

Every batch of changes becomes a folder of its own: index blocks and texts of
what is new, and the versions of all that it says, deletions too.  The newest
version of a document counts, in whichever folder it is.  A list of folders is
published after they are whole, so a batch that fails and is repeated replaces
itself and readers see all of it or nothing.  Folders of about one size are put
together when there are many, so that a document is written again a logarithmic
number of times, and what has been replaced or deleted is left out.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import bm25
from ..sources.sinks import sent

CHANGES = "doc_id long, file_path string, text string, version long, deleted boolean"
#: Folders of one size that are put together, and how many times as large the next size is.
FOLDERS = 8
#: Blocks of which a search drops documents that is told of them by broadcast (at most 8 KB each).
SENT_BLOCKS = 10_000


def changed_files(now: DataFrame, known: DataFrame) -> DataFrame:
    """file_path, modified, deleted of what differs between two listings (file_path, size, modified): new, changed and missing files.

    A missing file's time is that of its last listing.
    """
    old = known.select("file_path", F.col("size").alias("_size"), F.col("modified").alias("_modified"), F.lit(True).alias("_known"))
    both = now.select("file_path", "size", "modified", F.lit(True).alias("_there")).join(old, "file_path", "full_outer")
    same = F.col("size").eqNullSafe(F.col("_size")) & F.col("modified").eqNullSafe(F.col("_modified"))
    differs = F.col("_there").isNull() | F.col("_known").isNull() | ~same
    return both.where(differs).select("file_path", F.coalesce("modified", "_modified").alias("modified"), F.col("_there").isNull().alias("deleted"))


class WatchedIndex:
    """The index below ``path``; see the module."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def follow(self, changes: DataFrame, checkpoint: str, every: str | None = None) -> StreamingQuery:
        """Takes in a stream of ``CHANGES``: what is there now, or on and on ``every`` so often.

        Changes that arrive while a batch is written wait and make up the next one.
        """

        def write(batch: DataFrame, number: int) -> None:
            self.take(batch, number)
            self.compact()

        writer = changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()

    def take(self, changes: DataFrame, number: int) -> None:
        """One batch.  Of several versions of a document the highest counts; of equal ones a deletion."""
        newest = changes.groupBy("doc_id").agg(F.max_by(F.struct("file_path", "text", "version", "deleted"), F.struct("version", "deleted", F.xxhash64("file_path", "text"))).alias("c")).select("doc_id", "c.*")
        name = f"batch-{number}"
        newest.write.mode("overwrite").parquet(f"{self.path}/{name}/taken")
        taken = self.spark.read.schema(CHANGES).parquet(f"{self.path}/{name}/taken")
        self._write(name, taken.where("not deleted").select("doc_id", "file_path", "text"), taken.select("doc_id", "version", "deleted"))
        folders = [f for f in self.folders() if f[0] != name]
        # Batch numbers grow; a merged folder has the number of its newest batch.
        self._publish([*folders, (name, number, self._documents(name))])

    def compact(self) -> None:
        sizes: dict[int, list[tuple[str, int, int]]] = defaultdict(list)
        for f in self.folders():
            sizes[int(math.log(max(1, f[2]), FOLDERS))].append(f)
        for some in sizes.values():
            if len(some) >= FOLDERS:
                self._merge(some)
                return self.compact()

    def _merge(self, some: list[tuple[str, int, int]]) -> None:
        names = [f[0] for f in some]
        last = max(f[1] for f in some)
        name = f"merged-{last}-{max(0, *(int(n.split('-')[2]) for n in names if n.startswith('merged-')), 0) + 1}"
        newest = self.newest().where(F.col("folder").isin(names))
        documents = self._read("documents", some).join(newest.where("not deleted"), ["doc_id", "folder"], "left_semi")
        self._write(name, documents.select("doc_id", "file_path", "text"), newest.select("doc_id", "version", "deleted"))
        self._publish([*(f for f in self.folders() if f[0] not in names), (name, last, self._documents(name))])

    def _write(self, name: str, documents: DataFrame, versions: DataFrame) -> None:
        documents.write.mode("overwrite").parquet(f"{self.path}/{name}/documents")
        versions.write.mode("overwrite").parquet(f"{self.path}/{name}/versions")
        made = bm25.blocks_of(self.spark.read.parquet(f"{self.path}/{name}/documents"))
        made.withColumn("block", F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{self.path}/{name}/blocks")

    def _documents(self, name: str) -> int:
        return self.spark.read.parquet(f"{self.path}/{name}/documents").count()

    def _lists(self) -> list[int]:
        """Numbers of the published lists."""
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/lists")
        store = place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not store.exists(place):
            return []
        found = [f.getPath() for f in store.listStatus(place)]
        return sorted(int(p.getName()) for p in found if p.getName().isdigit() and store.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def folders(self) -> list[tuple[str, int, int]]:
        """Name, number and documents of the folders that make up the index."""
        if not (lists := self._lists()):
            return []
        rows = self.spark.read.schema("name string, number long, documents long").parquet(f"{self.path}/lists/{lists[-1]}").collect()
        return sorted((tuple(r) for r in rows), key=lambda f: (f[1], f[0]))

    def _publish(self, folders: list[tuple[str, int, int]]) -> None:
        number = max(self._lists(), default=0) + 1
        self.spark.createDataFrame(folders, "name string, number long, documents long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/lists/{number}")

    def _read(self, table: str, folders: list[tuple[str, int, int]] | None = None) -> DataFrame:
        out = None
        for name, number, _ in folders or self.folders():
            rows = self.spark.read.parquet(f"{self.path}/{name}/{table}").withColumns({"folder": F.lit(name), "number": F.lit(number)})
            out = rows if out is None else out.unionByName(rows)
        if out is None:
            raise ValueError(f"nothing was taken into {self.path} yet")
        return out

    def newest(self) -> DataFrame:
        """doc_id, version, deleted, folder of each document's newest version."""
        rows = self._read("versions")
        return rows.groupBy("doc_id").agg(F.max_by(F.struct("version", "deleted", "folder"), F.struct("version", "number", "deleted", "folder")).alias("v")).select("doc_id", "v.*")

    def index(self) -> bm25.Index:
        """The index as it is now: blocks without what was replaced or deleted."""
        live = self.newest().where("not deleted").select("doc_id", "folder")
        documents = self._read("documents").join(live, ["doc_id", "folder"], "left_semi").select("doc_id", "file_path", "text")
        blocks = self._read("blocks")
        held = blocks.select("folder", "block", F.posexplode("doc_ids").alias("place", "doc_id"))
        # A block has at most a thousand documents, so the list is bounded.
        dead = held.join(live, ["doc_id", "folder"], "left_anti").groupBy("folder", "block").agg(F.collect_list("place").alias("dead"))
        whole = bm25.without(blocks.join(sent(dead, SENT_BLOCKS), ["folder", "block"], "left"))
        return bm25.Index(documents, whole, bm25.figures(whole), bm25.frequencies(whole))
