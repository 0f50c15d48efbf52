"""Queries of the splitting operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spark_util import table
from .splitting import audit_cuts, split_texts


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given chunks that break the terms of the split."""
    return audit_cuts(table(spark, sf_dir, "documents_parsed"), table(spark, sf_dir, "chunks"))


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text over the limit, in pieces."""
    return split_texts(table(spark, sf_dir, "documents_parsed"), "source_path")


def p2_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces and characters of every text over the limit; without overlaps they add up to the text."""
    pieces = p2_pieces(spark, sf_dir)
    return pieces.groupBy("source_path").agg(F.max("end_char").alias("covered"), F.min("start_char").alias("first_char"))


QUERIES = {"p2_found": p2_found, "p2_pieces": p2_pieces, "p2_sizes": p2_sizes}
SQL = {
    "p2_found": r"""
WITH cuts AS (SELECT DISTINCT source_file, chunk_index, start_char, end_char FROM chunks
              WHERE source_file IS NOT NULL AND chunk_index IS NOT NULL AND start_char IS NOT NULL AND end_char IS NOT NULL),
steps AS (SELECT *, coalesce(lag(end_char) OVER (PARTITION BY source_file ORDER BY chunk_index), 0) AS p FROM cuts),
files AS (SELECT DISTINCT source_path, text FROM documents_parsed WHERE text IS NOT NULL)
SELECT DISTINCT source_file, CAST(chunk_index AS BIGINT) AS chunk_index
FROM steps JOIN files ON source_path = source_file
WHERE end_char - p > 1024
   OR (chunk_index > 0 AND start_char <> greatest(0, p - 128))
   OR (NOT (end_char = length(text) OR regexp_matches(substr(text, end_char, 1), '[ \t\n\r。！？]') OR regexp_matches(substr(text, end_char + 1, 1), '[ \t\n\r]'))
       AND end_char - 1 > p
       AND (regexp_matches(substr(text, p + 1, end_char - 1 - p), '[ \t\n\r。！？]') OR regexp_matches(substr(text, p + 2, end_char - 1 - p), '[ \t\n\r]') OR end_char > length(text)))
""",
    "p2_pieces": r"""
WITH RECURSIVE files AS (SELECT DISTINCT source_path, text, length(text) AS n FROM documents_parsed WHERE length(text) > 1024),
letters AS (SELECT source_path, unnest(range(1, n + 1)) AS place, unnest(string_split(text, '')) AS c FROM files),
places AS (SELECT source_path, place FROM (SELECT *, lead(c) OVER (PARTITION BY source_path ORDER BY place) AS d FROM letters) WHERE regexp_matches(c, '[ \t\n\r。！？]') OR d IS NULL OR regexp_matches(d, '[ \t\n\r]')),
cuts AS (
  SELECT source_path, n, CAST(-1 AS BIGINT) AS i, CAST(0 AS BIGINT) AS p, CAST(0 AS BIGINT) AS e FROM files
  UNION ALL
  SELECT c.source_path, c.n, c.i + 1, c.e, coalesce(max(place), least(c.e + 1024, c.n)) FROM cuts c LEFT JOIN places s ON s.source_path = c.source_path AND s.place > c.e AND s.place <= c.e + 1024
  WHERE c.e < c.n GROUP BY c.source_path, c.n, c.i, c.e)
SELECT source_path, i AS chunk_index, CASE WHEN i = 0 THEN 0 ELSE greatest(0, p - 128) END AS start_char, e AS end_char,
 substr(text, CAST(CASE WHEN i = 0 THEN 0 ELSE greatest(0, p - 128) END AS BIGINT) + 1, CAST(e - CASE WHEN i = 0 THEN 0 ELSE greatest(0, p - 128) END AS BIGINT)) AS text
FROM cuts JOIN files USING (source_path) WHERE i >= 0
""",
    "p2_sizes": """
SELECT source_path, CAST(length(text) AS BIGINT) AS covered, CAST(0 AS BIGINT) AS first_char
FROM (SELECT DISTINCT source_path, text FROM documents_parsed) WHERE length(text) > 1024
""",
}
