"""Workspace scans, paths and projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import basename, extension, glob, project_of

# Suffixes and names that are indexed, folders that are not, and languages by suffix.
SUFFIXES = (
    ".py", ".js", ".ts", ".tsx", ".jsx", ".java", ".kt", ".swift", ".go", ".rs", ".dart", ".scala", ".clj", ".cljs", ".rb", ".php", ".lua", ".r", ".jl",
    ".mjs", ".cjs", ".es6", ".es", ".jsm",
    ".c", ".cpp", ".h", ".hpp", ".cc", ".cxx", ".c++", ".h++", ".hh", ".hxx", ".m", ".mm", ".asm", ".s",
    ".hs", ".lhs", ".ml", ".mli", ".fs", ".fsi", ".fsx", ".elm", ".ex", ".exs", ".erl", ".hrl", ".nim", ".cr", ".d", ".zig", ".v",
    ".vue", ".svelte", ".jsp", ".asp", ".aspx", ".erb", ".haml", ".slim",
    ".plist", ".storyboard", ".entitlements", ".xcconfig", ".xcworkspace",
    ".md", ".txt", ".rst", ".adoc", ".tex", ".org",
    ".json", ".yaml", ".yml", ".toml", ".ini", ".cfg", ".conf", ".pom",
    ".html", ".htm", ".css", ".scss", ".sass", ".less", ".stylus",
    ".lock", ".frozen", ".resolved",
    ".env", ".config", ".properties", ".gitignore", ".gitattributes",
    ".gradle", ".maven", ".sbt", ".dockerfile", ".containerfile", ".cmake", ".meson", ".ninja", ".bazel", ".bzl", ".buck", ".pants", ".nix", ".rake",
    ".xml", ".csv", ".sql", ".sh", ".bat", ".ps1", ".fish", ".zsh", ".bash", ".makefile", ".mk", ".am", ".in", ".m4", ".spec", ".desktop", ".patch",
)
SPECIAL_NAMES = (
    "dockerfile", "makefile", "rakefile", "gemfile", "procfile",
    "readme", "license", "changelog", "contributing", "authors",
    "requirements", "pipfile", "poetry", "package", "composer",
    "eslint", "prettier", "babel", "webpack", "rollup", "vite",
    "postcss", "tailwind", "tsconfig", "jsconfig", "next",
    "jest", "vitest", "cypress", "playwright",
    "package-lock", "yarn.lock", "pnpm-lock", "bun.lockb",
)
SKIP_FOLDERS = (
    ".git", ".svn", ".hg", ".bzr",
    "node_modules", "__pycache__", ".pytest_cache",
    ".venv", "venv", "env", ".env",
    "build", "dist", "target", "out",
    ".idea", ".vscode", ".vs",
    "coverage", ".coverage", ".nyc_output",
    "logs", "log", "tmp", "temp",
)
IGNORED = (
    ".git", "node_modules", "__pycache__", ".venv", ".env", "build", "dist", ".pytest_cache", ".next", "coverage", ".nyc_output",
    ".vscode", ".idea", "target", "bin", "obj", ".gradle", ".m2", "vendor", ".cache", "tmp", ".DS_Store",
)
LANGUAGES = {
    "py": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java",
    "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "rs": "rust", "go": "go", "rb": "ruby", "php": "php",
    "cs": "csharp", "kt": "kotlin", "swift": "swift", "scala": "scala", "clj": "clojure",
}
LARGEST, LARGEST_SNIFFED, SNIFFED = 10 * 1024 * 1024, 100 * 1024, 1024
# End of fixed values.


def spread(df: DataFrame, split: int = 16 << 20) -> DataFrame:
    """Deals a table of less than ``split`` bytes a core to all cores; a larger one isn't moved.

    A small file of long texts is one split, and what explodes it would run on
    one core.  The size is the optimiser's estimate, which costs no job.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * split else df


def scan(spark: SparkSession, root: str, content: bool = True) -> DataFrame:
    """file_path (below the root), size, modified and, if asked for, content (bytes) of every file outside skipped folders.

    A link that leads to a file twice gives it once.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), "^.*?" + "".join("\\" + c if not c.isalnum() and c != "/" else c for c in base) + "/", "")
    out = raw.select(path.alias("file_path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), *(["content"] if content else []))
    return out.where(~in_skipped_folder(F.col("file_path"))).dropDuplicates(["file_path"])


def in_skipped_folder(path: Column) -> Column:
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return F.arrays_overlap(folders, F.array(*[F.lit(x) for x in SKIP_FOLDERS]))


def is_text(content: Column, size: Column) -> Column:
    """Small enough, and no NUL among the first bytes."""
    return (size <= LARGEST_SNIFFED) & ~F.contains(F.substring(content, 1, SNIFFED), F.lit(b"\x00"))


def _special(name: Column) -> Column:
    return F.coalesce(*[F.when(F.contains(name, F.lit(s)), s) for s in SPECIAL_NAMES])


def indexable(path: Column, size: Column, content: Column | None = None) -> Column:
    """By size, then suffix, then special name; a file without suffix must look like text."""
    suffix = extension(path)
    sniffed = is_text(content, size) if content is not None else F.lit(True)
    return (size <= LARGEST) & (suffix.isin(*SUFFIXES) | _special(F.lower(basename(path))).isNotNull() | ((suffix == "") & sniffed))


def skip_reason(path: Column, size: Column, content: Column | None = None) -> Column:
    """Null for a file that is indexed."""
    return F.when(size > LARGEST, "too_large").when(~indexable(path, size, content), F.when(extension(path) == "", "binary").otherwise("unknown_extension"))


def file_type(path: Column) -> Column:
    """Suffix, else special name, else text or unknown."""
    suffix = extension(path)
    return F.when(suffix.isin(*SUFFIXES), F.substring(suffix, 2, 64)).otherwise(F.coalesce(_special(F.lower(basename(path))), F.when(suffix == "", "text").otherwise("unknown")))


def language(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.substring(extension(path), 2, 16)), F.lit("unknown"))


def included(path: Column) -> Column:
    """False where an ignored name occurs anywhere in the lower-cased path."""
    low = F.lower(path)
    out = F.lit(True)
    for name in IGNORED:
        out = out & ~F.contains(low, F.lit(name))
    return out


def discovery_stats(files: DataFrame) -> DataFrame:
    """One row per file type or skip reason: kind, label, n."""
    reason = skip_reason(F.col("file_path"), F.col("size"))
    marked = files.select(F.when(reason.isNull(), "indexed").otherwise("skipped").alias("kind"), F.coalesce(reason, file_type(F.col("file_path"))).alias("label"))
    return marked.groupBy("kind", "label").agg(F.count("*").alias("n"))


def modified_since(files: DataFrame, status: DataFrame) -> DataFrame:
    """Files that were never processed or changed afterwards; ``status`` has file_path and updated_at."""
    both = files.join(status.select("file_path", "updated_at"), "file_path", "left")
    return both.where("updated_at is null or modified > updated_at").drop("updated_at")


def new_projects(files: DataFrame, indexed: DataFrame) -> DataFrame:
    """Projects with files but no indexed path."""
    have = indexed.select(project_of(normalised(F.col("file_path"))).alias("project")).distinct()
    return files.select(project_of(F.col("file_path")).alias("project")).where("project is not null").distinct().join(have, "project", "left_anti")


def projects(files: DataFrame) -> DataFrame:
    """project, files, bytes, modified, newest first."""
    out = files.groupBy("project").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.max("modified").alias("modified"))
    return out.orderBy(F.desc("modified"), "project")


def tree(files: DataFrame) -> DataFrame:
    """path, parent, depth, is_file of every file and folder; names with a leading dot are hidden with all below them."""
    parts = files.where(~F.col("file_path").rlike(r"(^|/)\.")).select(F.split("file_path", "/").alias("p"))
    rows = parts.select("p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("depth"))
    return rows.select(F.array_join(F.slice("p", 1, F.col("depth")), "/").alias("path"), F.array_join(F.slice("p", 1, F.col("depth") - 1), "/").alias("parent"), "depth", (F.col("depth") == F.size("p")).alias("is_file")).distinct()


def listed(files: DataFrame, folder: str, pattern: str | None = None, limit: int = 50) -> DataFrame:
    """The first ``limit`` paths below a folder, then those that fit the pattern."""
    out = files.select("file_path").where(F.startswith("file_path", F.lit(folder.rstrip("/") + "/"))).distinct().orderBy("file_path").limit(limit)
    return out.where(glob(basename(F.col("file_path")), pattern) | glob(F.col("file_path"), pattern)) if pattern else out


def found(files: DataFrame, pattern: str, project: str | None = None) -> DataFrame:
    """Paths whose name or whole path fits a glob, or that hold the pattern."""
    out = files.select("file_path").distinct()
    if project:
        out = out.where(F.startswith("file_path", F.lit(project + "/")))
    return out.where(glob(basename(F.col("file_path")), pattern) | glob(F.col("file_path"), pattern) | F.contains("file_path", F.lit(pattern)))


def grep(files: DataFrame, pattern: str, context: int = 2, suffixes: tuple[str, ...] = (), most: int | None = 50) -> DataFrame:
    """file_path, line_no, line, is_match: matching lines with ``context`` lines round them."""
    from ..operators.chunking import lines

    rows = files.where(included(F.col("file_path")))
    if suffixes:
        rows = rows.where(F.substring(extension(F.col("file_path")), 2, 64).isin(*suffixes))
    rows = lines(rows.select("file_path", "content")).withColumn("is_match", F.col("line").rlike(pattern))
    near = F.max("is_match").over(W.partitionBy("file_path").orderBy("line_no").rowsBetween(-context, context))
    out = rows.withColumn("_near", near).where("_near").drop("_near")
    return out.orderBy("file_path", "line_no").limit(most) if most else out


def by_suffix(files: DataFrame, suffixes: tuple[str, ...] | None = None) -> DataFrame:
    """suffix, n, percent."""
    rows = files.select(extension(F.col("file_path")).alias("suffix"))
    if suffixes:
        rows = rows.where(F.col("suffix").isin(*suffixes))
    out = rows.groupBy("suffix").agg(F.count("*").alias("n"))
    return out.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(W.partitionBy()))


def normalised(path: Column, project: Column | None = None, root: str = "/workspace") -> Column:
    """project/relative/path: without the root, with forward slashes, with the project before a relative path."""
    clean = F.replace(path, F.lit("\\"), F.lit("/"))
    below = F.when(F.startswith(clean, F.lit(root + "/")), F.substring(clean, len(root) + 2, 1 << 20))
    if project is None:
        return F.coalesce(below, clean)
    absolute = F.startswith(clean, F.lit("/")) | clean.rlike("^.:")
    relative = F.when(~absolute, F.concat(project, F.lit("/"), clean))
    return F.when(F.trim(F.coalesce(path, F.lit(""))) == "", F.concat(project, F.lit("/"))).otherwise(F.coalesce(relative, below, F.concat(project, F.lit("/"), basename(clean))))


# First components that are no project.
PLAIN_FOLDERS = ("src", "frontend", "backend", "lib", "utils", "components", "pages", "styles", "public")
UNPREFIXED = ("frontend", "backend", "src", "lib", "components", "pages", "styles", "utils", "api", "models")
# End of fixed values.


def has_project(path: Column) -> Column:
    return (F.instr(path, "/") > 1) & ~F.split_part(path, F.lit("/"), F.lit(1)).isin(*PLAIN_FOLDERS)


def severity(path: Column, corrected: Column) -> Column:
    """warning: workspace form; critical: no project; info: the rest."""
    stored = F.startswith(path, F.lit("/workspace/"))
    return F.when(stored & ~F.startswith(corrected, F.lit("/workspace/")), "warning").when(~has_project(path) & ~stored, "critical").otherwise("info")


def inconsistencies(paths: DataFrame) -> DataFrame:
    """file_path, corrected, severity of every stored path that isn't in its normal form.

    A path without project takes the project of the one stored path that ends
    with it, if there is one.
    """
    p = paths.select("file_path").distinct()
    full = p.where(has_project(F.col("file_path")) & ~F.startswith("file_path", F.lit("/")))
    suffix = full.select(project_of(F.col("file_path")).alias("project"), F.expr("substring(file_path, instr(file_path, '/') + 1)").alias("rest"))
    owner = suffix.groupBy("rest").agg(F.min("project").alias("project"))
    out = p.join(owner, p["file_path"] == owner["rest"], "left")
    corrected = F.when(F.startswith("file_path", F.lit("/workspace/")), normalised(F.col("file_path"))).when(~has_project(F.col("file_path")) & F.col("project").isNotNull(), F.concat_ws("/", "project", "file_path")).otherwise(F.col("file_path"))
    out = out.select("file_path", corrected.alias("corrected"))
    return out.withColumn("severity", severity(F.col("file_path"), F.col("corrected"))).where("corrected <> file_path or severity = 'critical'")


def migrated(table: DataFrame, fixes: DataFrame) -> DataFrame:
    """The table with corrected paths; ``fixes`` has file_path and corrected."""
    fix = fixes.select(F.col("file_path").alias("_old"), F.col("corrected").alias("_new")).dropDuplicates(["_old"])
    out = table.join(fix, table["file_path"] == fix["_old"], "left")
    return out.withColumn("file_path", F.coalesce("_new", "file_path")).select(*table.columns)


def project_check(paths: DataFrame, project: str) -> DataFrame:
    """One row: distinct files in relative form, in workspace form, without project, in all, and whether they agree."""
    path = F.col("file_path")
    counts = paths.agg(
        F.countDistinct(F.when(F.startswith(path, F.lit(project + "/")), path)).alias("relative"),
        F.countDistinct(F.when(F.startswith(path, F.lit(f"/workspace/{project}/")), path)).alias("absolute"),
        F.countDistinct(F.when((F.instr(path, "/") > 0) & F.split_part(path, F.lit("/"), F.lit(1)).isin(*UNPREFIXED) & ~F.startswith(path, F.lit(project + "/")), path)).alias("no_prefix"),
    )
    out = counts.withColumn("no_prefix", F.when(F.col("relative") + F.col("absolute") > 0, F.col("no_prefix")).otherwise(0))
    out = out.withColumn("total", F.col("relative") + F.col("absolute") + F.col("no_prefix"))
    return out.withColumn("consistency", F.when((F.col("relative") > 0) & (F.col("no_prefix") == 0), "good").otherwise("issues"))
