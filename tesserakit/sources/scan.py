"""Folders of files into parsed documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from . import formats, markup, parsers, skip

SCHEMA = "source_path string, text string, title string, format_hint string, metadata map<string,string>, content_hash string"


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, modified_at, length and content of the files under a folder that have a parser and aren't skipped.

    Only a plan that uses content reads it; a filter on modified_at or length goes down to the listing.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    bare = F.regexp_replace("path", "^file:/*", "/")
    root = folder.removeprefix("file://").rstrip("/") + "/"
    inside = F.when(bare.startswith(root), F.expr(f"substring(regexp_replace(path, '^file:/*', '/'), {len(root) + 1})")).otherwise(bare)
    kept = files.withColumn("path", bare).filter(~skip.skipped_path(inside) & formats.supported("path"))
    return kept.select("path", F.col("modificationTime").alias("modified_at"), "length", "content")


def _parse(plugged: dict[str, parsers.Parser], hooks: dict[str, Callable[[bytes], str]]):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, kind, data, stamp in zip(part["path"], part["kind"], part["content"], part["stamp"]):
                text, title, hint, meta = parsers.parse(path.rpartition("/")[2], kind, bytes(data or b""), plugged, hooks)
                rows.append((path, text, title, hint, {**meta, "file_modified_at": stamp or ""}, xxhash.xxh64_hexdigest(bytes(data or b""))))
            yield pd.DataFrame(rows, columns=["source_path", "text", "title", "format_hint", "metadata", "content_hash"])

    return run


def parse_files(files: DataFrame, hashes: bool = False) -> DataFrame:
    """source_path, text, title, format_hint and metadata of listed files; with ``hashes`` their content_hash (xxh64) as well.

    Bytes are parsed in Arrow batches; what is pattern work (Markdown, reStructuredText, code, logs) follows as Column
    expressions. A file that can't be read comes out with empty text and parse_error in its metadata.
    """
    stamp = F.date_format("modified_at", "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    raw = files.select("path", formats.format_of("path").alias("kind"), "content", stamp.alias("stamp")).filter("kind is not null").mapInPandas(_parse(*parsers.carried()), SCHEMA)
    kind, name = F.col("metadata")["format"], X.file_name("source_path")
    heading = markup.markdown_title("text")
    named = X.title_case(F.translate(X.stem("source_path"), "-_", "  "))
    language = formats.language_of("source_path")
    lines, errors, warnings = markup.log_counts("text")
    summary = markup.doc_summary("text", language)
    code = F.create_map(F.lit("language"), language, F.lit("line_count"), lines.cast("string"))
    code = F.when(summary != "", F.map_concat(code, F.create_map(F.lit("doc_summary"), summary))).otherwise(code)
    log = F.create_map(F.lit("line_count"), lines.cast("string"), F.lit("error_count"), errors.cast("string"), F.lit("warning_count"), warnings.cast("string"))
    return raw.select(
        "source_path",
        F.when(kind == "markdown", markup.clean_markdown("text")).when(kind == "rst", markup.clean_rst("text")).otherwise(F.col("text")).alias("text"),
        F.when(kind == "markdown", F.when(heading != "", heading).otherwise(named)).when(kind == "code", F.concat(name, F.lit(" ("), language, F.lit(")"))).otherwise(F.col("title")).alias("title"),
        "format_hint",
        F.when(kind == "code", F.map_concat("metadata", code)).when(kind == "log", F.map_concat("metadata", log)).otherwise(F.col("metadata")).alias("metadata"),
        *(["content_hash"] if hashes else []),
    )


def read_folder(spark: SparkSession, *folders: str) -> DataFrame:
    """All parsed documents of some folders."""
    out = None
    for folder in folders:
        part = parse_files(list_files(spark, folder))
        out = part if out is None else out.unionByName(part)
    return out
