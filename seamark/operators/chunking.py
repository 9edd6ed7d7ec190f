"""From files to chunks: array expressions where lines or characters suffice, a parser where syntax counts."""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..sources.sinks import BATCH_BYTES, bounded_batches

CHUNK_SCHEMA = "file_path string, chunk_type string, start_line int, end_line int, function_name string, class_name string, imports array<string>, parent_context string, dependencies array<string>, docstring string, decorators array<string>, text string"


def _windows(text: Column, size: int | Column) -> Column:
    size = F.lit(size) if isinstance(size, int) else size
    last = F.ceil(F.length(text) / size).cast("int") - 1
    return F.when(last < 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.substring(text, i * size + 1, size)))


def fixed_chunks(files: DataFrame, size: int = 400) -> DataFrame:
    """Windows of ``size`` characters of column ``text``; an empty or null text has none."""
    rest = [c for c in files.columns if c != "text"]
    return files.select(*rest, F.posexplode(_windows(F.coalesce("text", F.lit("")), size)).alias("position", "text"))


def diversity(text: Column) -> Column:
    """Distinct over all words of the lower-cased text; 0 without words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[A-Za-z0-9_]+"), F.lit(0))
    return F.coalesce(F.size(F.array_distinct(words)) / F.nullif(F.size(words), F.lit(0)), F.lit(0.0))


def chunk_size(text: Column) -> Column:
    """Long chunks for repetitive texts."""
    d = diversity(text)
    return F.when(d < 0.05, 2000).when(d < 0.15, 1200).otherwise(800)


def dynamic_chunks(files: DataFrame) -> DataFrame:
    rest = [c for c in files.columns if c != "text"]
    sized = files.withColumn("_size", chunk_size(F.col("text")))
    return sized.select(*rest, F.col("_size").alias("chunk_size"), F.posexplode(_windows(F.coalesce("text", F.lit("")), F.col("_size"))).alias("position", "text"))


def line_of(text: Column, at: Column) -> Column:
    """1-based line of the character after ``at`` characters."""
    return F.length(F.substring(text, F.lit(1), at)) - F.length(F.replace(F.substring(text, F.lit(1), at), F.lit("\n"), F.lit(""))) + 1


def lined_chunks(files: DataFrame, size: int = 400) -> DataFrame:
    """Fixed chunks with their first and last line; a text is gone through once."""
    rest = [c for c in files.columns if c != "text"]
    given = bounded_batches(files.select(*rest, "text"))
    out = StructType([*given.select(*rest).schema.fields, *StructType.fromDDL("position int, text string, start_line int, end_line int").fields])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, position, part, first, last = [], [], [], [], []

            def rows() -> pa.RecordBatch:
                kept = [c.take(pa.array(row, pa.int32())) for c in batch.columns[:-1]]
                made = [pa.array(x, f.type) for x, f in zip((position, part, first, last), list(arrow)[-4:])]
                found = pa.RecordBatch.from_arrays([*(k.cast(f.type) for k, f in zip(kept, arrow)), *made], schema=arrow)
                for x in (row, position, part, first, last):
                    x.clear()
                return found

            for r, text in enumerate(batch.column(len(rest)).to_pylist()):
                line = 1
                for i, at in enumerate(range(0, len(text or ""), size)):
                    piece = text[at : at + size]
                    row.append(r)
                    position.append(i)
                    part.append(piece)
                    first.append(line)
                    line += piece.count("\n")
                    last.append(line)
                    if len(row) * size >= BATCH_BYTES // 4:
                        yield rows()
            yield rows()

    return given.mapInArrow(run, out)


def lines(files: DataFrame, text: str = "content") -> DataFrame:
    """One row per line: line_no from 1, line."""
    rest = [c for c in files.columns if c != text]
    return files.select(*rest, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("_i", "line")).withColumn("line_no", F.col("_i") + 1).drop("_i")


def markdown_chunks(files: DataFrame, overlap: int = 50) -> DataFrame:
    """Sections from one heading to the next, each with the first characters of the next one after it."""
    w = W.partitionBy("file_path").orderBy("line_no")
    rows = lines(files.select("file_path", "content")).withColumn("section", F.sum(F.when(F.col("line").rlike(r"^#{1,6}\s"), 1).otherwise(0)).over(w))
    parts = rows.groupBy("file_path", "section").agg(
        F.min("line_no").cast("int").alias("start_line"),
        F.max("line_no").cast("int").alias("end_line"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]), "\n").alias("body"),
    )
    after = F.lead("body").over(W.partitionBy("file_path").orderBy("section"))
    heading = F.trim(F.regexp_extract("body", r"^#{1,6}\s+([^\n]*)", 1))
    parts = parts.withColumn("text", F.concat("body", F.coalesce(F.concat(F.lit("\n"), F.substring(after, 1, overlap)), F.lit(""))))
    return parts.where(F.trim("body") != "").select("file_path", "section", heading.alias("heading"), "start_line", "end_line", "text")


def small_file_chunks(files: DataFrame, most: int = 300) -> DataFrame:
    """Whole files of at most ``most`` characters."""
    return files.where(F.length("content") <= most).select("file_path", F.lit("small_file").alias("chunk_type"), F.lit(1).alias("start_line"), line_of(F.col("content"), F.length("content")).cast("int").alias("end_line"), F.col("content").alias("text"))


def config_chunks(files: DataFrame) -> DataFrame:
    """A configuration file as one chunk."""
    kind = F.regexp_extract("file_path", r"\.([^./]+)$", 1)
    return files.where(F.lower(kind).isin("json", "yaml", "yml", "toml", "ini", "cfg", "conf", "xml", "properties")).select("file_path", F.lit("config").alias("chunk_type"), F.lit(1).alias("start_line"), line_of(F.col("content"), F.length("content")).cast("int").alias("end_line"), F.col("content").alias("text"))


def summary_chunks(files: DataFrame, above: int = 1000, size: int = 500) -> DataFrame:
    """The head of every long file as a summary."""
    return files.where(F.length("content") > above).select("file_path", F.lit("file_summary").alias("chunk_type"), F.substring("content", 1, size).alias("text"))


def complexity(line_count: Column) -> Column:
    return F.least(line_count / 100.0, F.lit(1.0))


def chunk_id(path: Column, start: Column, end: Column, text: Column) -> Column:
    """stem_start_end_digest."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return F.concat_ws("_", stem, start, end, F.substring(F.md5(text), 1, 8))


def match_symbols(chunks: DataFrame, symbols: DataFrame, name_bonus: int = 10) -> DataFrame:
    """chunk_id, node_id, score: the symbol of the same file with most shared lines; its name in the text adds a bonus.

    An equi-join on the file bounds the range comparison.  A name that repeats
    in a file stands for its last symbol, and ties go to the earlier line.
    """
    last = F.row_number().over(W.partitionBy("file_path", "name").orderBy(F.desc("line_start"), F.desc("node_id")))
    symbols = symbols.select("file_path", "name", "node_id", "line_start", "line_end").withColumn("_n", last).where("_n = 1").drop("_n")
    both = chunks.select("chunk_id", "file_path", "start_line", "end_line", "text").join(symbols, "file_path")
    shared = F.greatest(F.lit(0), F.least("end_line", "line_end") - F.greatest("start_line", "line_start") + 1)
    both = both.withColumn("score", shared + F.when(F.contains("text", F.col("name")), name_bonus).otherwise(0)).where("score > 0")
    best = F.row_number().over(W.partitionBy("chunk_id").orderBy(F.desc("score"), "line_start", "node_id"))
    return both.withColumn("_n", best).where("_n = 1").select("chunk_id", "node_id", F.col("score").cast("int").alias("score"))


def hierarchy_faults(chunks: DataFrame) -> DataFrame:
    """(fault, chunk_id): ids that repeat, parents that are missing or the chunk itself, lines in the wrong order."""
    ids = chunks.select(F.col("chunk_id").alias("parent_id")).distinct()
    repeated = chunks.groupBy("chunk_id").count().where("count > 1").select(F.lit("repeated id").alias("fault"), "chunk_id")
    orphan = chunks.where("parent_id is not null").join(ids, "parent_id", "left_anti").select(F.lit("missing parent").alias("fault"), "chunk_id")
    own = chunks.where("parent_id = chunk_id").select(F.lit("own parent").alias("fault"), "chunk_id")
    order = chunks.where("end_line < start_line").select(F.lit("lines in wrong order").alias("fault"), "chunk_id")
    return repeated.unionByName(orphan).unionByName(own).unionByName(order)


def _name(node: ast.AST) -> str:
    try:
        return ast.unparse(node)
    except ValueError:
        return ""


def python_chunks(path: str, source: str) -> list[tuple]:
    """Rows of ``CHUNK_SCHEMA``: top-level functions, classes, and statements of three lines or more.

    Source that doesn't parse gives windows of 400 characters.
    """
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return window_chunks(path, source)
    rows, all_lines = [], source.split("\n")
    imports = [a.name for n in tree.body if isinstance(n, ast.Import) for a in n.names]
    imports += [f"{n.module or ''}.{a.name}" for n in tree.body if isinstance(n, ast.ImportFrom) for a in n.names]
    for n in tree.body:
        first = min([n.lineno, *[d.lineno for d in getattr(n, "decorator_list", [])]])
        text = "\n".join(all_lines[first - 1 : n.end_lineno])
        marks = [_name(d) for d in getattr(n, "decorator_list", [])]
        if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef):
            calls = sorted({_name(c.func) for c in ast.walk(n) if isinstance(c, ast.Call)})
            rows.append((path, "async_function" if isinstance(n, ast.AsyncFunctionDef) else "function", first, n.end_lineno, n.name, None, imports, None, calls, ast.get_docstring(n), marks, text))
        elif isinstance(n, ast.ClassDef):
            rows.append((path, "class", first, n.end_lineno, None, n.name, imports, None, [_name(b) for b in n.bases], ast.get_docstring(n), marks, text))
        elif n.end_lineno - n.lineno >= 2:
            rows.append((path, "module", first, n.end_lineno, None, None, imports, None, [], None, [], text))
    return rows or window_chunks(path, source)


def window_chunks(path: str, source: str, size: int = 400) -> list[tuple]:
    out = []
    for i in range(0, len(source), size):
        part = source[i : i + size]
        first = source.count("\n", 0, i) + 1
        out.append((path, "fallback", first, first + part.count("\n"), None, None, [], None, [], None, [], part))
    return out


_SCRIPT = re.compile(r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:(?:async\s+)?function\s*\*?\s+(?P<f>\w+)|class\s+(?P<c>\w+)(?:\s+extends\s+(?P<b>[\w.]+))?|(?:const|let|var)\s+(?P<a>\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>)", re.M)
_SCRIPT_IMPORT = re.compile(r"""import\s+(?:[^'";]*?\s+from\s+)?['"]([^'"]+)['"]|require\(\s*['"]([^'"]+)['"]\s*\)""")


def block_end(source: str, at: int) -> int:
    """Where the block that opens after ``at`` closes; strings and comments don't count."""
    depth, i, quote = 0, at, ""
    while i < len(source):
        c = source[i]
        if quote:
            if c == "\\":
                i += 1
            elif c == quote:
                quote = ""
        elif c in "'\"`":
            quote = c
        elif source.startswith("//", i):
            i = (source.find("\n", i) + len(source) + 1) % (len(source) + 1) - 1 if "\n" in source[i:] else len(source)
        elif source.startswith("/*", i):
            i = source.find("*/", i) + 1 or len(source)
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth == 0:
                return i + 1
        elif c == ";" and depth == 0:
            return i + 1
        i += 1
    return len(source)


def script_chunks(path: str, source: str) -> list[tuple]:
    """Top-level functions, arrow functions and classes of JavaScript or TypeScript."""
    imports = [a or b for a, b in _SCRIPT_IMPORT.findall(source)]
    rows, until = [], 0
    for m in _SCRIPT.finditer(source):
        if m.start() < until:
            continue
        until = block_end(source, m.end())
        text = source[m.start() : until]
        first = source.count("\n", 0, m.start()) + 1
        calls = sorted(set(re.findall(r"\b([\w.]+)\s*\(", text)) - {"if", "for", "while", "switch", "catch", "function", "return"})
        name, kind = m["f"] or m["a"], m["c"]
        rows.append((path, "class" if kind else "function", first, first + text.count("\n"), name, kind, imports, None, ([m["b"]] if m["b"] else []) if kind else [c for c in calls if c != name], None, [], text))
    return rows or window_chunks(path, source)


_BLOCK = {
    "java": re.compile(r"^[ \t]*(?:(?:public|private|protected|static|final|abstract)\s+)*(?:class|interface|enum|record)\s+(\w+)|^[ \t]*(?:(?:public|private|protected|static|final|synchronized)\s+)+[\w<>\[\], ]+\s+(\w+)\s*\([^)]*\)[^;{]*\{", re.M),
    "go": re.compile(r"^type\s+(\w+)\s+(?:struct|interface)|^func\s+(?:\([^)]*\)\s*)?(\w+)\s*\(", re.M),
    "rs": re.compile(r"^[ \t]*(?:pub\s+)?(?:struct|enum|trait|impl)\s+(\w+)|^[ \t]*(?:pub\s+)?(?:async\s+)?fn\s+(\w+)", re.M),
    "kt": re.compile(r"^[ \t]*(?:(?:data|open|sealed|abstract)\s+)*(?:class|interface|object)\s+(\w+)|^[ \t]*(?:\w+\s+)*fun\s+(\w+)\s*\(", re.M),
    "swift": re.compile(r"^[ \t]*(?:\w+\s+)*(?:class|struct|enum|protocol)\s+(\w+)|^[ \t]*(?:\w+\s+)*func\s+(\w+)\s*[(<]", re.M),
}
_BLOCK |= {"cs": _BLOCK["java"], "scala": _BLOCK["kt"]}


def block_chunks(path: str, source: str) -> list[tuple]:
    """Types and functions of brace languages."""
    pattern = _BLOCK.get(path.rsplit(".", 1)[-1].lower())
    rows = []
    for m in pattern.finditer(source) if pattern else ():
        text = source[m.start() : block_end(source, m.end() - 1 if m[0].endswith("{") else m.end())]
        first = source.count("\n", 0, m.start()) + 1
        rows.append((path, "class" if m[1] else "function", first, first + text.count("\n"), m[2], m[1], [], None, [], None, [], text))
    return rows or window_chunks(path, source)


def chunk_source(path: str, source: str) -> list[tuple]:
    """By the file's suffix."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if len(source) <= 300 and suffix not in ("py", "js", "ts", "jsx", "tsx", *_BLOCK):
        return [(path, "small_file", 1, source.count("\n") + 1, None, None, [], None, [], None, [], source)]
    if suffix == "py":
        return python_chunks(path, source)
    if suffix in ("js", "jsx", "ts", "tsx", "mjs"):
        return script_chunks(path, source)
    return block_chunks(path, source)


def code_chunks(files: DataFrame) -> DataFrame:
    """Chunks of every source file (file_path, content); parsing needs Python, so files go through Arrow in batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in CHUNK_SCHEMA.split(", ")]
        for batch in batches:
            rows = [r for path, text in zip(batch["file_path"], batch["content"]) for r in chunk_source(path, text or "")]
            yield pd.DataFrame(rows, columns=names)

    return files.select("file_path", "content").mapInPandas(run, CHUNK_SCHEMA)


def hierarchy(chunks: DataFrame) -> DataFrame:
    """A summary row per file above its chunks: chunk_id, parent_id, depth, and the chunk's columns.

    A chunk's parent is the smallest class of its file that covers its lines, else the file.
    """
    ids = chunks.withColumn("chunk_id", chunk_id(F.col("file_path"), F.col("start_line"), F.col("end_line"), F.col("text")))
    roots = ids.groupBy("file_path").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.count("*").alias("n"))
    roots = roots.select(F.concat("file_path", F.lit("::summary")).alias("chunk_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("depth"), "file_path", F.lit("summary").alias("chunk_type"), "start_line", "end_line")
    outer = ids.where("chunk_type = 'class'").select("file_path", F.col("chunk_id").alias("class_id"), F.col("start_line").alias("a"), F.col("end_line").alias("b"))
    inside = ids.join(outer, "file_path").where("a <= start_line and b >= end_line and class_id <> chunk_id").groupBy("chunk_id").agg(F.min_by("class_id", F.struct(F.col("b") - F.col("a"), "class_id")).alias("class_id"))
    leaves = ids.join(inside, "chunk_id", "left").select("chunk_id", F.coalesce("class_id", F.concat("file_path", F.lit("::summary"))).alias("parent_id"), F.when(F.col("class_id").isNull(), 1).otherwise(2).alias("depth"), "file_path", "chunk_type", "start_line", "end_line")
    return roots.unionByName(leaves)


#: Terms whose cell a task remembers; cells counted at once.
KNOWN_TERMS, CELLS_AT_ONCE = 300_000, 1 << 20


def hashed_embeddings(chunks: DataFrame, width: int = 64, key: str = "chunk_id") -> DataFrame:
    """Unit vectors of hashed terms: stands in where no embedding model is at hand; a text without terms has zeros.

    A chunk's cells stay together, so one row a chunk is shuffled, and rows of
    the same key, which are one chunk, lie side by side when they are counted.
    """
    from ..functions.text import terms

    found = bounded_batches(chunks.select(key, terms(F.col("text")).alias("terms")))
    kind = found.schema[key].dataType.simpleString()

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            lists = batch.column(1)
            coded = lists.flatten().dictionary_encode()
            if len(known) > KNOWN_TERMS:
                known.clear()
            own = coded.dictionary.to_pylist()
            for t in own:
                if t not in known:
                    known[t] = int.from_bytes(hashlib.md5(t.encode()).digest()[:4], "big") % width
            cell = np.array([known[t] for t in own], np.int32)[np.asarray(coded.indices)]
            size = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(size)]).astype(np.int32), pa.array(cell, pa.int32()))], names=[key, "cells"])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(keys: pa.Array, n: np.ndarray) -> pa.RecordBatch:
            norm = np.sqrt((n * n).sum(1, keepdims=True))
            unit = (n / np.where(norm > 0, norm, 1)).astype(np.float32)
            return pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(np.arange(len(n) + 1, dtype=np.int32) * width, pa.array(unit.ravel()))], names=[key, "embedding"])

        last, held = None, None  # the last key, which may go on, and its counts
        for batch in batches:
            for at in range(0, batch.num_rows, step := max(1, CELLS_AT_ONCE // width)):
                some = batch.slice(at, step)
                keys, size = some.column(0), np.asarray(pc.list_value_length(some.column(1)))
                place = np.repeat(np.arange(len(size)), size) * width + np.asarray(some.column(1).flatten())
                n = np.bincount(place, minlength=len(size) * width).reshape(-1, width).astype(np.float64)
                names = keys.to_pylist()
                first = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1])]
                n, keys = np.add.reduceat(n, first), keys.take(pa.array(first))
                if last is not None:
                    if last[0].as_py() == names[0]:
                        n[0] += held[0]
                    else:
                        yield out(last, held)
                yield out(keys[:-1], n[:-1])
                last, held = keys[-1:], n[-1:]
        if last is not None:
            yield out(last, held)

    rows = found.mapInArrow(cells, f"`{key}` {kind}, cells array<int>").repartition(key).sortWithinPartitions(key)
    return rows.mapInArrow(vectors, f"`{key}` {kind}, embedding array<float>")
