"""Queries of the near-duplicate operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spark_util import table
from .neardup import classes_and_links, near_duplicates

KINDS = ["record", "chunk"]


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "documents_parsed").select(F.lit("record").alias("kind"), F.col("source_path").alias("key"), "text")
    chunks = table(spark, sf_dir, "chunks").select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("key"), "text")
    return records.unionByName(chunks)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar files and similar pieces: runs of three words, similarity 0.6, texts of 30 words or more."""
    return near_duplicates(_rows(spark, sf_dir), KINDS, length=3, threshold=0.6, least_words=30)


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file and piece with its class of copies and its number of links, at five words and 0.8."""
    return classes_and_links(_rows(spark, sf_dir), KINDS)


QUERIES = {"p3_found": p3_found, "p3_classes": p3_classes}
SQL = {
    "p3_found": r"""
WITH texts AS (SELECT DISTINCT 'record' AS kind, source_path AS key, text FROM documents_parsed
               UNION SELECT DISTINCT 'chunk', chunk_id, text FROM chunks),
split AS (SELECT kind, key, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{Nd}]+') AS w FROM texts WHERE text IS NOT NULL AND key IS NOT NULL),
runs AS (SELECT DISTINCT kind, key, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS run FROM split WHERE len(w) >= 30),
sizes AS (SELECT kind, key, count(*) AS n FROM runs GROUP BY ALL),
shared AS (SELECT a.kind, a.key AS key_a, b.key AS key_b, count(*) AS c FROM runs a JOIN runs b ON a.kind = b.kind AND a.run = b.run AND a.key < b.key GROUP BY ALL)
SELECT s.kind, key_a, key_b FROM shared s JOIN sizes x ON x.kind = s.kind AND x.key = key_a JOIN sizes y ON y.kind = s.kind AND y.key = key_b
WHERE c >= 0.6 * (x.n + y.n - c) - 1e-9
""",
}
