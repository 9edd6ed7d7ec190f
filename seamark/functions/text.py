"""Column functions over text: tokens, snippets, sizes, identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that keyword search leaves out, and the form of a term.
STOP_WORDS = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with",
    "by", "is", "are", "was", "were", "be", "been", "have", "has", "had", "do", "does",
    "did", "will", "would", "could", "should", "may", "might", "can", "this", "that",
    "these", "those", "i", "you", "he", "she", "it", "we", "they", "me", "him", "her",
    "us", "them", "my", "your", "his", "its", "our", "their",
)
TERM = r"\b[a-zA-Z_][a-zA-Z0-9_]*(?:\.[a-zA-Z_][a-zA-Z0-9_]*)*\b"
# End of fixed values.


def terms(text: Column) -> Column:
    """Search terms of a text in order, repeats included."""
    found = F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) >= 2) & ~t.isin(*STOP_WORDS))


def snippet(text: Column, matched: Column, size: int = 200) -> Column:
    """A window of ``size`` characters round the first place of a matched term, with dots where text is left out."""
    low = F.lower(text)
    places = F.filter(F.transform(matched, lambda t: F.instr(low, t)), lambda p: p > 0)
    first = F.when(F.size(matched) == 0, F.lit(size // 2)).otherwise(F.coalesce(F.array_min(places) - 1, F.length(text)))
    start = F.greatest(F.lit(0), first - size // 2)
    end = F.least(F.length(text), start + size)
    return F.concat(F.when(start > 0, "...").otherwise(""), F.substring(text, start + 1, end - start), F.when(end < F.length(text), "...").otherwise(""))


def token_estimate(text: Column) -> Column:
    """Model tokens by length: a quarter of the characters, one at least."""
    return F.greatest(F.lit(1).cast("long"), F.floor(F.length(text) / 4).cast("long"))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-case suffix with its dot, or nothing; a name's leading dot starts no suffix."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1))


def project_of(path: Column) -> Column:
    """The first component, where there are two or more."""
    return F.when(F.instr(path, "/") > 1, F.split_part(path, F.lit("/"), F.lit(1)))


def glob(path: Column, pattern: str) -> Column:
    """Whole-name match of ``*``, ``?`` and ``[...]``; any of the other signs stand for themselves."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            inner = pattern[i + 1 : end].replace("\\", r"\\")
            out += "[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]"
            i = end
        else:
            out += c if c.isalnum() or c == "_" else "\\" + c
        i += 1
    return path.rlike(f"(?s)^{out}$")


def like_text(column: Column, needle: str, sqlite: bool = False) -> Column:
    """Case-insensitive containment; ``sqlite`` lets ``%`` and ``_`` of the needle act as wildcards."""
    return column.ilike(f"%{needle}%") if sqlite else F.contains(F.lower(column), F.lit(needle.lower()))


def identifier(path: Column, symbol: Column | None = None, kind: Column | None = None) -> Column:
    """A stable id of letters, digits and single underscores."""
    raw = F.concat_ws("_", path, *([symbol] if symbol is not None else []), *([kind] if kind is not None else []))
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(raw, "[^A-Za-z0-9_]", "_"), "_+", "_"), F.lit("_")))
