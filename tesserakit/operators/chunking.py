"""Structure-aware chunks: sections by headings, definitions or pages, packed recursively, with overlap and context.

One row in, its chunks out; no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Separators from coarse to fine, and what begins a section.
SEPARATORS = ("\n\n", "\n", ". ", " ")
HEADING = re.compile(r"^(#{1,6})\s+(.+)$", re.M)
DEFINITION = [re.compile(r"^((?:async\s+)?def\s+\w+|class\s+\w+)", re.M), re.compile(r"^(?:export\s+)?(?:function\s+\w+|class\s+\w+|const\s+\w+\s*=)", re.M)]
PAGE = re.compile(r"\[PAGE\s+(\d+)\]")

SCHEMA = T.StructType(
    [
        T.StructField("chunk_id", T.StringType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("chunk_index", T.IntegerType()),
        T.StructField("start_char", T.IntegerType()),
        T.StructField("end_char", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)
Section = tuple[str, int, str]


def _marks(text: str, hint: str) -> tuple[list[tuple[int, int, str]], str]:
    """Where sections begin, where their text begins and their headings; and the heading of what comes before."""
    if hint == "markdown":
        out, above = [], []
        for m in HEADING.finditer(text):
            level = len(m.group(1))
            above = [h for h in above if h[0] < level] if not above or above[-1][0] >= level else above
            above = [*above, (level, m.group(2).strip())]
            out.append((m.start(), m.end(), " > ".join(name for _, name in above)))
        return out, ""
    if hint == "code":
        out = []
        for at, name in sorted((m.start(), m.group(0).strip()) for p in DEFINITION for m in p.finditer(text)):
            if not out or at > out[-1][0] + 10:
                out.append((at, at, name))
        return out, "(module preamble)"
    if hint == "pdf":
        return [(m.start(), m.end(), f"Page {m.group(1)}") for m in PAGE.finditer(text)], ""
    return [], ""


def sections(text: str, hint: str) -> list[Section]:
    """heading, first character and stripped text of a text's sections; the whole text if it has none."""
    marks, first = _marks(text, hint)
    if not marks:
        return [("", 0, text)]
    spans = [(first, 0, text[: marks[0][0]])]
    spans += [(name, body, text[body:end]) for (_, body, name), end in zip(marks, [*(m[0] for m in marks[1:]), len(text)])]
    return [(name, at, kept) for name, at, span in spans if (kept := span.strip())] or [("", 0, text)]


def spans(text: str, size: int) -> list[tuple[int, int]]:
    """Where the pieces of a text begin and end, each at most ``size`` long.

    A stretch that is too long is looked at through the places of the next finer separator: from a part that isn't empty, a
    piece reaches to the last part that still ends within ``size``; a part too long by itself becomes a stretch of its own.
    Separators at a piece's edge belong to no piece. Past the finest separator, windows of ``size``.
    """
    places = [np.array([m.start() for m in re.finditer(re.escape(mark), text)], dtype=np.int64) for mark in SEPARATORS] if len(text) > size else []
    out: list[tuple[int, int]] = []
    todo = [(0, len(text), 0)]
    while todo:
        low, high, level = todo.pop()
        if high - low <= size:
            out.append((low, high))
        elif level == len(SEPARATORS):
            out += [(k, min(k + size, high)) for k in range(low, high, size)]
        else:
            width = len(SEPARATORS[level])
            own = places[level][slice(*np.searchsorted(places[level], [low, high - width + 1]))]
            begins, ends = np.r_[low, own + width], np.r_[own, high]
            filled = np.flatnonzero(ends > begins)
            inner, k = [], 0
            while (j := int(np.searchsorted(filled, k))) < len(filled):
                first = int(filled[j])
                last = max(first, int(np.searchsorted(ends, begins[first] + size, side="right")) - 1)
                inner.append((int(begins[first]), int(ends[last]), level + 1))
                k = last + 1
            todo += inner[::-1]
    return out


def pack(text: str, size: int) -> list[str]:
    """The pieces of a text; see ``spans``."""
    return [text[a:b] for a, b in spans(text, size)]


def _placed(body: str, size: int) -> Iterator[tuple[int, str]]:
    """The pieces of a section that aren't blank, and where each is taken to begin.

    Fixed rule: a running position follows the pieces by their lengths, blank ones included. A piece begins at its first
    occurrence from there on if that is no further ahead than the piece is long, else at the running position itself; so
    places can fall behind where separators are long or text repeats.
    """
    at = 0
    for piece in pack(body, size):
        if piece.strip():
            at = max(at, body.find(piece, at, at + 2 * len(piece)))
            yield at, piece
        at += len(piece)


def chunk(text: str, source: str, title: str = "", hint: str = "", size: int = 1024, overlap: int = 128, extra: dict[str, str] | None = None) -> list[tuple]:
    """Rows of SCHEMA for one document.

    Fixed rules: but for the document's first, a chunk's text begins ``overlap`` characters earlier in its section; places
    are counted in the section's stripped text from where the section begins unstripped.
    """
    parts = sections(text, hint) if text.strip() else []
    placed = [(heading, first, body, at, piece) for heading, first, body in parts if body.strip() for at, piece in _placed(body, size)]
    rows: list[tuple] = []
    for k, (heading, first, body, at, piece) in enumerate(placed):
        begin, end = max(0, at - overlap), at + len(piece)
        shown = body[begin:end] if k and begin < at else piece
        named = {"section_heading": heading, "document_title": title}
        lead = [f"{label}: {value}" for label, value in (("Title", title), ("Section", heading)) if value]
        body_text = shown.strip()
        whole = "\n".join([*lead, "", body_text]) if lead else body_text
        rows.append((f"{source}::chunk_{k}", source, k, first + begin, first + end, whole, {**(extra or {}), **{n: v for n, v in named.items() if v}}))
    return rows


def chunk_documents(documents: DataFrame, size: int = 1024, overlap: int = 128) -> DataFrame:
    """Chunks of parsed documents (source_path, text, title, format_hint, metadata).

    Null or blank texts have no chunks, null titles and hints count as empty, a null map as an empty one; documents that
    occur twice, word for word, are chunked once; extra columns play no part.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows: list[tuple] = []
            for path, text, title, hint, meta in zip(part["source_path"], part["text"], part["title"], part["format_hint"], part["metadata"]):
                rows += chunk(text, path, title or "", hint or "", size, overlap, dict(meta) if meta is not None else None)
            yield pd.DataFrame(rows, columns=SCHEMA.fieldNames())

    kept = documents.select("source_path", "text", "title", "format_hint", "metadata").filter("source_path is not null and text is not null")
    return kept.dropDuplicates(["source_path", "text"]).mapInPandas(run, SCHEMA)


def section_rows(documents: DataFrame) -> DataFrame:
    """source_path, section_no, heading, start_char and length of the sections of parsed documents."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [
                (path, k, heading, at, len(body))
                for path, text, hint in zip(part["source_path"], part["text"], part["format_hint"])
                for k, (heading, at, body) in enumerate(sections(text, hint or ""))
            ]
            yield pd.DataFrame(rows, columns=["source_path", "section_no", "heading", "start_char", "length"])

    kept = documents.select("source_path", "text", "format_hint").filter("text is not null").distinct()
    return kept.mapInPandas(run, "source_path string, section_no int, heading string, start_char int, length int")


def fixed_windows(documents: DataFrame, size: int = 1024) -> DataFrame:
    """source_path, window and its length: texts in windows of ``size`` characters, as built-in expressions."""
    texts = documents.select("source_path", "text").filter("length(text) > 0").distinct()
    n = F.ceil(F.length("text") / size).cast("int")
    at = texts.select("source_path", F.length("text").alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("window"))
    return at.select("source_path", "window", F.least(F.lit(size), F.col("n") - F.col("window") * size).cast("long").alias("length"))
