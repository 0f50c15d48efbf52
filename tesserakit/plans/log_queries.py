"""Queries of the log operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.logparse import log_files, parse_logs
from ..spark_util import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry of every log file, without its message."""
    entries = parse_logs(log_files(table(spark, sf_dir, "documents_parsed")))
    return entries.select("source_path", "line_no", "entry_ts", "entry_level", "component", "n_lines").distinct()


def p1_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry with its whole message."""
    return parse_logs(log_files(table(spark, sf_dir, "documents_parsed")))


QUERIES = {"p1_found": p1_found, "p1_entries": p1_entries}
SQL: dict[str, str] = {}
