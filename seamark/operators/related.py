"""Files related to a file: by imports either way, tests, configuration and names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import basename
from . import extract

# Names of configuration files.
CONFIGURATION = r"^(settings.*|config.*|\.env.*|.*\.conf|.*\.ini|.*\.config\.js|tsconfig\.json|package\.json|requirements\.txt)$"
# End of fixed values.

#: What marks a test file's stem.
TEST_MARK = r"(?i)^test_|_test$|\.test$|\.spec$"
#: Files of a task.
TASK_FILES = 10_000
ARMS = ("imported by", "imports", "test", "configuration", "name")


def stem(path: Column) -> Column:
    """The name without its last suffix."""
    return F.regexp_replace(basename(path), r"(.)\.[^.]*$", "$1")


def folder(path: Column) -> Column:
    """All before the name; nothing at the top."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def ends(path: Column) -> Column:
    """All ends of a path at its components, the shortest first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "/"))


def suffix_index(files: DataFrame) -> DataFrame:
    """suffix, target: the ends of paths (without the last suffix of a name) that only one file has."""
    plain = F.regexp_replace("file_path", r"\.[^./]*$", "")
    rows = files.select("file_path", F.explode(ends(plain)).alias("suffix"))
    return rows.groupBy("suffix").agg(F.count("*").alias("n"), F.min("file_path").alias("target")).where("n = 1").select("suffix", "target")


def imported_path(target: Column, language: Column) -> Column:
    """What an import names, as a path: steps upwards and suffixes go, and dots and colons between names are slashes."""
    local = F.regexp_replace(F.regexp_replace(target, r"^(\.{1,2}/)+", ""), r"\.(js|ts|jsx|tsx|json)$", "")
    named = F.regexp_replace(F.regexp_replace(target, r"^\.+", ""), r"\.|::|\\", "/")
    return F.when(language.isin("javascript", "typescript", "go", "php"), local).otherwise(named)


def import_edges(files: DataFrame) -> DataFrame:
    """file_path, target: which file an import means, by the longest end of what it names that only one file has."""
    found = extract.imports(files).select("file_path", F.explode(ends(imported_path(F.col("target"), F.col("language")))).alias("suffix"), F.col("target").alias("_import"))
    hits = found.join(suffix_index(files), "suffix")
    best = hits.groupBy("file_path", "_import").agg(F.max_by("target", F.length("suffix")).alias("target"))
    return best.where("file_path <> target").select("file_path", "target").distinct()


def first(rows: DataFrame, key: list[str], most: int, order: str = "file_path") -> DataFrame:
    """The first rows of each key; a group limit, so that each task keeps few."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(order))).where(F.col("_n") <= most).drop("_n")


def related(files: DataFrame, targets: DataFrame, most: int = 5) -> DataFrame:
    """target, arm, file_path, rank: the first files by path of every arm for each target, at most ``most`` of an arm.

    ``files`` has file_path and content.  A test has the target's stem besides
    its mark; configuration lies in the target's folder or the one above, or
    names its stem; a like name, in the same folder, is the stem with a part
    before or after, or begins with all of it but its last letter.  Every arm
    limits what a key has before it meets the targets, so that a large folder
    or a common stem costs no more than a small one.
    """
    # Tasks for parts of equal size: by bytes of the short paths, few tasks would hold and sort all that is made of them.
    tasks = -(-files.count() // TASK_FILES) or 1
    own = targets.select(F.col("file_path").alias("target")).distinct()
    paths = files.select("file_path")
    spread = paths.withColumn("_t", F.pmod(F.xxhash64("file_path"), F.lit(8 * tasks))).repartition(tasks, "_t")
    edges = import_edges(files)
    keyed = lambda rows, key: first(rows, key, most + 1)  # one more, as the target itself may be among them

    into = keyed(edges, ["target"]).join(own, "target").select("target", F.lit("imported by").alias("arm"), "file_path")
    out_of = edges.select(F.col("file_path").alias("target"), F.col("target").alias("file_path")).join(own, "target").select("target", F.lit("imports").alias("arm"), "file_path")

    marked = paths.where(stem(F.col("file_path")).rlike(TEST_MARK)).withColumn("s", F.regexp_replace(stem(F.col("file_path")), TEST_MARK, ""))
    tests = own.withColumn("s", F.regexp_replace(stem(F.col("target")), TEST_MARK, "")).join(keyed(marked, ["s"]), "s").select("target", F.lit("test").alias("arm"), "file_path")

    settings = files.where(F.lower(basename(F.col("file_path"))).rlike(CONFIGURATION))
    places = F.explode(F.array_distinct(F.array(folder(F.col("target")), folder(folder(F.col("target"))))))
    near = own.withColumn("f", places).join(keyed(settings.select("file_path", folder(F.col("file_path")).alias("f")), ["f"]), "f")
    words = settings.select("file_path", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"[A-Za-z0-9_-]+"), F.lit(0)))).alias("s"))
    named = own.withColumn("s", stem(F.col("target"))).join(keyed(words, ["s"]), "s")
    config = near.select("target", "file_path").unionByName(named.select("target", "file_path")).select("target", F.lit("configuration").alias("arm"), "file_path")

    # A file's keys: its stem without a part before or after an underscore, and all beginnings of it.
    s = stem(F.col("file_path"))
    parts = F.split(s, "_")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.struct(F.lit("part").alias("how"), F.array_join(F.slice(parts, 1, n), "_").alias("k")))
    tails = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.struct(F.lit("part").alias("how"), F.array_join(F.slice(parts, n + 1, F.size(parts) - n), "_").alias("k")))
    begins = F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda n: F.struct(F.lit("beginning").alias("how"), F.substring(s, F.lit(1), n).alias("k")))
    keys = F.array_distinct(F.when(F.size(parts) > 1, F.concat(heads, tails, begins)).otherwise(begins))
    every = spread.select("_t", "file_path", folder(F.col("file_path")).alias("f"), F.explode(keys).alias("x")).select("_t", "file_path", "f", "x.how", "x.k")
    # A task limits what it makes of its own files; what is left of a key meets in one of as many tasks.
    alike = keyed(keyed(every, ["_t", "f", "how", "k"]).drop("_t").repartition(tasks, "f", "how", "k"), ["f", "how", "k"])
    t = stem(F.col("target"))
    begin = F.when(F.length(t) > 3, F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t)
    asked = own.select("target", folder(F.col("target")).alias("f"), F.explode(F.array(F.struct(F.lit("part").alias("how"), t.alias("k")), F.struct(F.lit("beginning").alias("how"), begin.alias("k")))).alias("x")).select("target", "f", "x.how", "x.k")
    like = asked.join(alike, ["f", "how", "k"]).select("target", F.lit("name").alias("arm"), "file_path")

    # Each arm is dealt out by itself, else a task of the union would hold what all of them sort.
    into, out_of, tests, config, like = (x.where("target <> file_path").repartition(tasks, "target", "arm") for x in (into, out_of, tests, config, like))
    arms = reduce(DataFrame.unionByName, [into, out_of, tests, config.distinct(), like.distinct()])
    return arms.withColumn("rank", F.row_number().over(W.partitionBy("target", "arm").orderBy("file_path"))).where(F.col("rank") <= most)
