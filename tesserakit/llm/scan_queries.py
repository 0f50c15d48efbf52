"""Queries of the operator for scanned pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..spark_util import table
from .scanned import find_damage, repair_scans


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    files = table(spark, sf_dir, "documents_parsed")
    clean = files.filter("format_hint <> 'pdf'").select("text").unionByName(table(spark, sf_dir, "documents").select("text"))
    return files.filter("format_hint = 'pdf'"), clean, table(spark, sf_dir, "lexicon")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of scanned files that are running headers and the like, end in a broken word or have a misread one."""
    return find_damage(*_inputs(spark, sf_dir))


def p5_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paragraphs of scanned files as once printed."""
    return repair_scans(*_inputs(spark, sf_dir))


QUERIES = {"p5_found": p5_found, "p5_paragraphs": p5_paragraphs}
SQL: dict[str, str] = {}
