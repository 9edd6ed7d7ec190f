"""Symbols of languages with braces: what is declared where, and in what.

Comments and strings are blanked out first, by a scan that knows where it is;
then braces are matched, and the words before one say what it opens.  Files are
read in Arrow batches; what comes out is rows, and all else is joins and
aggregations on them.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import extension
from ..sources.sinks import bounded_batches

# The symbol type of each kind of syntax node.
SYMBOL_TYPES = {
    "function_definition": "function", "async_function_definition": "function", "function_declaration": "function", "function_expression": "function",
    "arrow_function": "function", "method_declaration": "method", "method_definition": "method", "constructor_declaration": "method", "function_item": "function",
    "class_definition": "class", "class_declaration": "class", "interface_declaration": "interface", "struct_specifier": "struct", "struct_item": "struct",
    "enum_declaration": "enum", "enum_specifier": "enum", "enum_item": "enum", "trait_item": "trait", "impl_item": "impl", "type_declaration": "type", "type_definition": "type",
    "variable_declaration": "variable", "field_declaration": "variable", "assignment": "variable", "var_declaration": "variable", "const_declaration": "constant",
    "import_statement": "import", "import_from_statement": "import", "export_statement": "export",
}
# End of fixed values.

LANGUAGES = {".java": "java", ".cs": "csharp", ".js": "script", ".jsx": "script", ".ts": "script", ".tsx": "script", ".go": "go"}
#: Words before a bracket that open no method.
CONTROL = {"if", "for", "while", "switch", "catch", "synchronized", "using", "lock", "foreach", "fixed", "return", "new", "function", "else", "do", "try", "with", "when"}

_STRINGS = {
    "java": r'"""(?s:.*?)"""|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'',
    "csharp": r'\$?@\$?"(?:""|[^"])*"|"""(?s:.*?)"""|\$?"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'',
    "script": r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|(?<=[=(,:;!&|?{}\[\n])[ \t]*/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n])+/\w*',
    "go": r'`[^`]*`|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'',
}
_TYPE = r"\b(class|interface|@interface|enum|record|struct)\s+(\w+)[^;{}()=]*(?:\([^{}]*\)[^;{}()=]*)?\Z"
_METHOD = r"(\w+)\s*(?:<[^<>]*>\s*)?\((?:[^(){};]|\([^()]*\))*\)\s*(?:throws\s+[\w.,\s]+|where\s+[^{};]+|:\s*(?:base|this)\s*\([^{};]*\)|:\s*[\w<>\[\]|., ]+)?\s*\Z"
#: By language, what the words before a brace say: pattern (the name is its last group) and kind of node, the first that fits.
HEADS = {
    "java": ((_TYPE, None), (_METHOD, "method_declaration")),
    "csharp": ((_TYPE, None), (_METHOD, "method_declaration")),
    "script": (
        (r"\bclass\s+(\w+)[^;{}()]*\Z", "class_declaration"),
        (r"\binterface\s+(\w+)[^;{}()]*\Z", "interface_declaration"),
        (r"\benum\s+(\w+)\s*\Z", "enum_declaration"),
        (r"(?:^|[;{}\n])\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)\s*(?:<[^<>]*>\s*)?\([^{};]*\)[^;{}]*\Z", "function_declaration"),
        (r"(\w+)\s*(?::[^=;{}]+)?=\s*(?:async\s+)?function\b[^;{}]*\Z", "function_expression"),
        (r"(\w+)\s*(?::[^=;{}]+)?=\s*(?:async\s+)?(?:\([^{};]*\)|\w+)\s*(?::[^={};]+)?=>\s*\Z", "arrow_function"),
        (_METHOD, "method_definition"),
    ),
    "go": (
        (r"\bfunc\s*\([^()]*\)\s*(\w+)\s*(?:\[[^\]]*\])?\(.*\Z", "method_declaration"),
        (r"\bfunc\s+(\w+)\s*(?:\[[^\]]*\])?\(.*\Z", "function_declaration"),
        (r"\btype\s+(\w+)\b[^{};\n]*\Z", "type_declaration"),
    ),
}
_KINDS = {"class": "class_declaration", "record": "class_declaration", "interface": "interface_declaration", "@interface": "interface_declaration", "enum": "enum_declaration", "struct": "struct_specifier"}
_HEADS = {k: tuple((re.compile(p, re.S), kind) for p, kind in v) for k, v in HEADS.items()}
_FIELD = r"^[ \t]*(?:(?:public|private|protected|internal|static|final|readonly|volatile|const)\s+)*[\w.]+(?:<[^;={}()]*>)?(?:\[\])*\??\s+(\w+)\s*(?:=[^=]|;)"
#: By language, lines that declare without a brace: pattern, kind of node, and where they count: at the top, in a type, or either.
LINES = {
    "java": ((r"^[ \t]*import\s+(?:static\s+)?([\w.*]+)", "import_statement", "top"), (_FIELD, "field_declaration", "type")),
    "csharp": ((r"^[ \t]*using\s+(?:static\s+)?(?:\w+\s*=\s*)?([\w.]+)\s*;", "import_statement", "top"), (_FIELD, "field_declaration", "type")),
    "script": (
        (r"^[ \t]*import\b([^;\n]*)", "import_statement", "top"),
        (r"^[ \t]*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*(?::[^=;\n]+)?(?:=(?!=)|;|$)(?![^\n]*(?:=>|\bfunction\b))", "variable_declaration", "top"),
        (r"^[ \t]*export\s+(?:default\s+)?(?:\{\s*)?(?:async\s+)?(?:(?:class|function|const|let|var|interface|enum|type)\s+)?(\w+)", "export_statement", "top"),
    ),
    "go": ((r"^[ \t]*import\b([^\n(]*)$|^[ \t]*import\s*\(([^)]*)\)", "import_statement", "top"), (r"^var\s+(\w+)", "var_declaration", "top"), (r"^const\s+(\w+)", "const_declaration", "top")),
}
_LINES = {k: tuple((re.compile(p, re.M), kind, where) for p, kind, where in v) for k, v in LINES.items()}
_NOT_FIELDS = {"return", "throw", "import", "package", "using", "namespace", "new", "else", "case", "goto", "await", "yield", "delete"}
_QUOTED = re.compile(r"[\"'`]([^\"'`\n]*)[\"'`]")
_BLANK = re.compile(r"[^\n]")


class Symbol(NamedTuple):
    name: str
    node_type: str
    start: int
    end: int
    #: Names of the types and functions round it, outermost first.
    scope: tuple[str, ...]


def blanked(source: str, language: str) -> str:
    """The source with blanks for comments and strings; a template's inserted code stays, whatever it nests."""
    token = re.compile(r"//[^\n]*|/\*(?s:.*?)(?:\*/|\Z)|" + _STRINGS[language] + (r"|`|[{}]" if language == "script" else ""))
    out, at, inserted = [], 0, []  # for every template open round this place, the braces open in its inserted code
    while m := token.search(source, at):
        out.append(source[at : m.start()])
        text, at = m[0], m.end()
        if text == "{" and inserted:
            inserted[-1] += 1
        elif text == "}" and inserted:
            inserted[-1] -= 1
        if text == "`" or (text == "}" and inserted and inserted[-1] < 0):
            if text == "}":
                inserted.pop()
            end = re.compile(r"(?:\\.|\$(?!\{)|[^`\\$])*(`|\$\{|\Z)", re.S).match(source, at)
            out.append(_BLANK.sub(" ", source[m.start() : end.end()]))
            at = end.end()
            if end[1] == "${":
                inserted.append(0)
        elif text in "{}":
            out.append(text)
        else:
            out.append(_BLANK.sub(" ", text))
    return "".join([*out, source[at:]])


def symbols_of(source: str, language: str) -> list[Symbol]:
    """Declarations in order of place; a brace that is never closed ends with the text."""
    clean = blanked(source, language)
    types = {"class_declaration", "interface_declaration", "enum_declaration", "struct_specifier"}
    found: list[list] = []
    open_: list[tuple[int | None, int]] = []  # number of the symbol that a brace opened, and open round brackets before it
    head, round_ = 0, 0
    for m in re.finditer(r"[(){};]", clean):
        sign, at = m[0], m.start()
        if sign in "()":
            round_ = max(0, round_ + (1 if sign == "(" else -1))
            continue
        if sign == "{":
            owner = next((i for i, _ in reversed(open_) if i is not None), None)
            kind = _opened(clean, head, at, language, found[owner] if owner is not None else None, types)
            if kind:
                name, node_type, place = kind
                # Where statements may end with the line, what is before the name's line is another one's.
                start = clean.rfind("\n", 0, place) + 1 if language in ("script", "go") else head
                start = max(start, head)
                start += len(clean[start:at]) - len(clean[start:at].lstrip())
                found.append([name, node_type, start, len(clean), (*found[owner][4], found[owner][0]) if owner is not None else ()])
            open_.append((len(found) - 1 if kind else None, round_))
            head, round_ = at + 1, 0
        elif sign == "}":
            if open_:
                i, round_ = open_.pop()
                if i is not None:
                    found[i][3] = at
            head = at + 1
        elif not round_:
            head = at + 1
    scopes = [Symbol(*f) for f in found]
    return sorted([*scopes, *_declared(source, clean, language, scopes, types)], key=lambda s: (s.start, -s.end, s.node_type))


def _opened(clean: str, head: int, at: int, language: str, owner: list | None, types: set[str]) -> tuple[str, str, int] | None:
    """Name, kind of node and the name's place of what a brace opens, if that is a symbol."""
    for pattern, kind in _HEADS[language]:
        if not (m := pattern.search(clean, head, at)):
            continue
        name = m[m.lastindex]
        if name in CONTROL:
            return None
        if kind is None:
            return name, _KINDS[m[1]], m.start(m.lastindex)
        if kind == "method_definition" and (owner is None or owner[1] not in types):
            return None
        if kind == "method_declaration" and language != "go":
            before = clean[head : m.start()].split()
            if owner is None or owner[1] not in types or "new" in before or (before and before[-1] in (".", "=", "return")):
                return None
            if name == owner[0]:
                return name, "constructor_declaration", m.start()
        return name, kind, m.start(m.lastindex)
    return None


def _declared(source: str, clean: str, language: str, scopes: list[Symbol], types: set[str]) -> Iterator[Symbol]:
    starts = [s.start for s in scopes]

    def around(at: int) -> Symbol | None:
        # The innermost scope is the last to begin before that isn't over.
        i = bisect_right(starts, at)
        return next((s for s in reversed(scopes[:i]) if s.start <= at < s.end and clean.find("{", s.start, at) >= 0), None)

    for pattern, kind, where in _LINES[language]:
        for m in pattern.finditer(clean):
            group = next((g for g in range(1, m.re.groups + 1) if m[g] is not None), None)
            if group is None:
                continue
            a, b = m.span(group)
            scope = around(a)
            if (where == "top") != (scope is None) or (where == "type" and (scope.node_type not in types or _depth(clean, scope, a) != 1)):
                continue
            names = [m[group]]
            if kind == "import_statement" and language in ("script", "go"):
                names = _QUOTED.findall(source[a:b])
            elif kind == "field_declaration" and clean[m.start() : a].split()[0] in _NOT_FIELDS:
                continue
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            for name in names:
                yield Symbol(name.strip(), kind, start, max(start, m.end() - 1), (*scope.scope, scope.name) if scope else ())


def _depth(clean: str, scope: Symbol, at: int) -> int:
    inside = clean[scope.start : at]
    return inside.count("{") - inside.count("}")


FOUND = "file_path string, name string, node_type string, line_start int, line_end int, scope array<string>, signature string, text string"


def scoped_symbols(files: DataFrame) -> DataFrame:
    """node_id, file_path, name, type, node_type, line_start, line_end, parent, depth, signature, text of (file_path, content).

    ``parent`` is the names of what is round a symbol, joined by dots (null at
    the top).  Files of other languages and null contents have no symbols.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(FOUND))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, language, source in zip(*(c.to_pylist() for c in batch.columns)):
                lines = source.split("\n")
                # Where the lines after the first begin, less one.
                breaks = list(accumulate((len(x) + 1 for x in lines[:-1]), initial=-1))[1:]
                for s in symbols_of(source, language):
                    line, last = bisect_right(breaks, s.start - 1) + 1, bisect_right(breaks, s.end - 1) + 1
                    rows.append((path, s.name, s.node_type, line, last, list(s.scope), source[s.start : s.end + 1].split("\n", 1)[0].strip(), "\n".join(lines[line - 1 : last])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    language = F.coalesce(*[F.when(extension(F.col("file_path")) == suffix, name) for suffix, name in LANGUAGES.items()])
    known = files.select("file_path", language.alias("language"), "content").where("language is not null and content is not null")
    found = bounded_batches(known).mapInArrow(run, FOUND)
    stem = F.regexp_replace(F.regexp_extract("file_path", r"([^/]*)$", 1), r"\.[^.]*$", "")
    clean = lambda c, keep: F.regexp_replace(c, f"[^a-zA-Z0-9_{keep}]", "_")
    node_id = F.concat_ws("::", clean(stem, "."), clean(F.col("name"), ""), "line_start")
    parent = F.when(F.size("scope") > 0, F.array_join("scope", "."))
    return found.select(node_id.alias("node_id"), "file_path", "name", symbol_type(F.col("node_type")).alias("type"), "node_type", "line_start", "line_end", parent.alias("parent"), F.size("scope").alias("depth"), "signature", "text")


def symbol_type(node_type: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in SYMBOL_TYPES.items() for x in pair])
    return F.coalesce(F.element_at(known, node_type), F.lit("unknown"))


def scope_chunks(files: DataFrame) -> DataFrame:
    """file_path, chunk_type, name, parent, start_line, end_line, text: functions and types, those within others too, and imports."""
    kind = F.when(F.col("type").isin("function", "method"), "function").when(F.col("type").isin("class", "interface", "struct", "enum", "type"), "class").when(F.col("type") == "import", "import")
    return scoped_symbols(files).withColumn("chunk_type", kind).where("chunk_type is not null").select("file_path", "chunk_type", "name", "parent", F.col("line_start").alias("start_line"), F.col("line_end").alias("end_line"), "text")
