"""Queries of the packing and the mixing operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spark_util import table
from .mixing import mixture, quotas, reached, short_of_share
from .packing import CAPACITY, pack_texts


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every text or part of a text."""
    return pack_texts(table(spark, sf_dir, "documents"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that had to be divided."""
    return p6_containers(spark, sf_dir).filter("part > 0").select("doc_id").distinct()


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens, the fewest containers there could be, and the share of space in use."""
    bins = p6_containers(spark, sf_dir).groupBy("container").agg(F.sum("n_tokens").alias("used"))
    totals = bins.agg(F.count("*").alias("containers"), F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"), F.max("used").alias("fullest"))
    return totals.select("containers", "tokens", "fullest", F.ceil(F.col("tokens") / CAPACITY).alias("least"), (F.col("tokens") / (F.col("containers") * CAPACITY)).alias("fill"))


def p6_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text's tokens and characters, put together again from its parts."""
    placed = p6_containers(spark, sf_dir)
    whole = placed.groupBy("doc_id").agg(F.sum("n_tokens").alias("n_tokens"), F.sum(F.col("end_char") - F.col("start_char")).alias("n_chars"))
    return whole.select("doc_id", "n_tokens", "n_chars")


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that cannot reach their share, by what the mixture got of them."""
    return short_of_share(*_tables(spark, sf_dir))


def p7_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each source has, may give and gives."""
    return quotas(*_tables(spark, sf_dir)).select("source", F.col("n_tokens"), F.col("capacity"), F.round("wanted", 3).alias("wanted"), "quota")


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture, text by text."""
    return mixture(*_tables(spark, sf_dir))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source, and how often its most used text is used."""
    rows = reached(*_tables(spark, sf_dir))
    rows = rows.crossJoin(F.broadcast(rows.agg(F.sum("used").alias("all_used"))))  # one row
    return rows.select("source", "target_share", "used", F.coalesce(F.col("used") / F.col("all_used"), F.lit(0.0)).alias("share"), "times")


QUERIES = {
    "p6_found": p6_found,
    "p6_containers": p6_containers,
    "p6_fill": p6_fill,
    "p6_totals": p6_totals,
    "p7_found": p7_found,
    "p7_quotas": p7_quotas,
    "p7_mixture": p7_mixture,
    "p7_shares": p7_shares,
}
_QUOTAS = """
WITH own AS (SELECT lower(trim(source)) AS name, sum(strlen(text) + 1) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1),
t AS (SELECT sum(strlen(text) + 1) AS total FROM documents),
q AS (SELECT source, coalesce(n, 0) AS n, coalesce(n, 0) * max_repeats AS capacity, target_share * total AS wanted
      FROM (SELECT DISTINCT * FROM mix_targets) m LEFT JOIN own ON name = lower(trim(m.source)) CROSS JOIN t)
"""
SQL = {
    "p6_found": "SELECT doc_id FROM documents WHERE strlen(text) + 1 > 4096",
    "p6_totals": "SELECT doc_id, CAST(strlen(text) + 1 AS BIGINT) AS n_tokens, CAST(length(text) AS BIGINT) AS n_chars FROM documents WHERE text IS NOT NULL",
    "p7_found": _QUOTAS + "SELECT source FROM q WHERE capacity < wanted",
    "p7_quotas": _QUOTAS
    + "SELECT source, CAST(n AS BIGINT) AS n_tokens, CAST(capacity AS BIGINT) AS capacity, round(wanted, 3) AS wanted, CAST(least(floor(wanted), capacity) AS BIGINT) AS quota FROM q",
}
