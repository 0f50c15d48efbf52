"""Queries of the sentence operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spark_util import table
from .sentences import split_sentences


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence of every text."""
    return split_sentences(table(spark, sf_dir, "documents"), lang="lang").select("doc_id", "start_char", "end_char")


def p8_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences by tens of characters."""
    found = p8_found(spark, sf_dir)
    return found.groupBy((F.floor((F.col("end_char") - F.col("start_char")) / 10) * 10).alias("chars")).agg(F.count("*").alias("sentences"))


QUERIES = {"p8_found": p8_found, "p8_lengths": p8_lengths}
SQL: dict[str, str] = {}
