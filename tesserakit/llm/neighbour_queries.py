"""Queries of the most-similar-vectors operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spark_util import table
from .neighbours import nearest_neighbours, usable_vectors


def p4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar chunks of every chunk that a search delivered."""
    found = nearest_neighbours(usable_vectors(table(spark, sf_dir, "hits")))
    return found.select(F.col("key").alias("chunk_id"), "rank", F.col("neighbour").alias("neighbour_id"), "similarity")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of which one is among the other's five."""
    found = p4_neighbours(spark, sf_dir)
    return found.select(F.least("chunk_id", "neighbour_id").alias("chunk_a"), F.greatest("chunk_id", "neighbour_id").alias("chunk_b")).distinct()


QUERIES = {"p4_found": p4_found, "p4_neighbours": p4_neighbours}
SQL = {
    "p4_found": """
WITH v AS (SELECT chunk_id, CAST(min(embedding) AS DOUBLE[]) AS e FROM hits
           WHERE len(embedding) = 96 AND list_aggregate(list_transform(embedding, lambda x: abs(x)), 'max') > 0 GROUP BY chunk_id),
sims AS (SELECT a.chunk_id AS a, b.chunk_id AS b, list_cosine_similarity(a.e, b.e) AS s FROM v a JOIN v b ON a.chunk_id <> b.chunk_id),
best AS (SELECT a, b FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS r FROM sims) WHERE r <= 5)
SELECT DISTINCT least(a, b) AS chunk_a, greatest(a, b) AS chunk_b FROM best
""",
}
