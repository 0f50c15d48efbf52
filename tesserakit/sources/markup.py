"""Cleaning of markup that is pure pattern work, inside whole-stage code: Markdown, reStructuredText, code and logs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as X

# Patterns, in order of use, and what each match becomes. (?d): only a line feed ends a line.
MARKDOWN = [
    (r"!\[([^\]]*)\]\([^)]+\)", "$1"),
    (r"\[([^\]]+)\]\([^)]+\)", "$1"),
    (r"(?d)\*{1,3}(.+?)\*{1,3}", "$1"),
    (r"(?d)_{1,3}(.+?)_{1,3}", "$1"),
    (r"```[a-zA-Z]*\n?", ""),
    (r"(?d)`(.+?)`", "$1"),
    (r"(?md)^[-*_]{3,}\s*$", ""),
    (r"<[^>]+>", ""),
    (r"\n{3,}", "\n\n"),
]
RST = [
    (r"(?md)^\.\.\s[a-zA-Z0-9_-]+::\s*.*$", ""),
    (r"(?md)^\s+:[a-zA-Z0-9_-]+:.*$", ""),
    (r":[a-zA-Z0-9_-]+:`([^`]+)`", "$1"),
    (r"(?d)``(.+?)``", "$1"),
    (r"(?d)\*\*(.+?)\*\*", "$1"),
    (r"(?d)\*(.+?)\*", "$1"),
    (r"\|([^|]+)\|", "$1"),
    (r"\[#?[^\]]*\]_", ""),
    (r"`([^<]+)\s*<[^>]+>`_", "$1"),
    (r"`([^`]+)`__?", "$1"),
    (r"(?md)^[=\-~`'^\"#\*\+\.]{3,}\s*$", ""),
    (r"(?md)^\.\.\s+[^:].*$", ""),
    (r"(?md)^\.\.\s_[^:]+:\s*.*$", ""),
    (r"\n{3,}", "\n\n"),
]


def _through(text: Column, patterns: list[tuple[str, str]]) -> Column:
    for pattern, becomes in patterns:
        text = F.regexp_replace(text, pattern, becomes)
    return X.strip(text)


def clean_markdown(text: str | Column) -> Column:
    """Text without emphasis, links, fences, rules and tags; headings stay."""
    return _through(X._c(text), MARKDOWN)


def clean_rst(text: str | Column) -> Column:
    """Text without directives, roles, rules and references."""
    return _through(X._c(text), RST)


def markdown_title(text: str | Column) -> Column:
    """The first heading of level one, '' if none."""
    return X.strip(F.regexp_extract(X._c(text), r"(?md)^#\s+(.+)$", 1))


def log_counts(text: str | Column) -> tuple[Column, Column, Column]:
    """Numbers of lines, of error words and of warning words."""
    t = X._c(text)
    lines = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1
    return lines, F.regexp_count(t, F.lit(r"(?i)\b(ERROR|FATAL|CRITICAL)\b")), F.regexp_count(t, F.lit(r"(?i)\bWARN(ING)?\b"))


#: Languages with block comments in front.
BLOCK = ["javascript", "typescript", "java", "c", "cpp", "csharp", "go", "rust", "kotlin", "scala", "swift", "dart", "php"]


def doc_summary(text: str | Column, language: str | Column) -> Column:
    """What the first 30 lines of a source file say about it, up to 200 characters: docstring, block comment or # lines."""
    lines = F.slice(F.split(X._c(text), "\n", -1), 1, 30)
    head = F.array_join(lines, "\n")
    lang = X._c(language)
    doc = F.regexp_extract(head, '(?s)"""(.*?)"""', 1)
    doc = F.when(F.regexp_like(head, F.lit('(?s)""".*?"""')), doc).otherwise(F.regexp_extract(head, "(?s)'''(.*?)'''", 1))
    block = F.regexp_replace(F.regexp_extract(head, r"(?s)/\*\*?(.*?)\*/", 1), r"(?md)^\s*\*\s?", "")
    trimmed = F.transform(lines, X.strip)
    noted = F.transform(trimmed, lambda x: x.startswith("#") & ~x.startswith("#!"))
    first = F.array_position(noted, True)
    tail = F.slice(noted, F.greatest(first, F.lit(1)).cast("int"), F.size(noted))
    stop = F.array_position(tail, False)
    n = F.when(stop > 0, stop - 1).otherwise(F.size(tail))
    own = F.slice(trimmed, F.greatest(first, F.lit(1)).cast("int"), n.cast("int"))
    hashes = F.when(first > 0, F.array_join(F.transform(own, lambda x: F.regexp_replace(x, r"^[# ]+", "")), " ")).otherwise("")
    found = F.when((lang == "python") & (doc != ""), X.strip(doc)).when(lang.isin(BLOCK) & (block != ""), X.strip(block)).otherwise(hashes)
    return F.substring(found, 1, 200)
