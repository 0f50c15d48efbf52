"""Operational figures: dashboards, the latest and recent rows, retention."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import VersionedTable

# The fact tables and the column that dates a row, in epoch seconds.
FACTS = {
    "indexing_runs": "started_at",
    "embedding_batches": "timestamp",
    "search_queries": "timestamp",
    "vector_store_snapshots": "timestamp",
    "system_snapshots": "timestamp",
}
SCHEMAS = {
    "indexing_runs": "id bigint, rag_name string, started_at double, finished_at double, duration_s double, status string, total_files int, processed_files int, total_chunks int, chunks_per_second double, files_per_second double, errors int",
    "embedding_batches": "id bigint, rag_name string, timestamp double, batch_size int, duration_ms double, chunks_per_second double, model string",
    "search_queries": "id bigint, rag_name string, timestamp double, query_length int, top_k int, results_returned int, total_duration_ms double, vector_search_ms double, bm25_ms double, fusion_ms double, rerank_ms double, mmr_ms double, top_score double, min_score double",
    "vector_store_snapshots": "id bigint, rag_name string, timestamp double, total_chunks bigint, total_files bigint, db_size_bytes bigint",
    "system_snapshots": "id bigint, timestamp double, cpu_percent double, memory_percent double, memory_used_mb double, process_memory_mb double",
}


def _of(rows: DataFrame, rag: str | None) -> DataFrame:
    return rows if rag is None else rows.filter(F.col("rag_name") == rag)


def search_dashboard(queries: DataFrame, rag: str | None = None, by: list[str] | None = None) -> DataFrame:
    """Number of searches, mean latency, mean number of results and mean top score; nulls don't count, nor does a duration of -1."""
    known = F.when(F.col("total_duration_ms") >= 0, F.col("total_duration_ms"))
    return _of(queries, rag).groupBy(*(by or [])).agg(
        F.count("*").alias("searches"), F.round(F.avg(known), 4).alias("avg_ms"), F.round(F.avg("results_returned"), 4).alias("avg_results"), F.round(F.avg("top_score"), 4).alias("avg_top_score")
    )


def indexing_dashboard(runs: DataFrame, rag: str | None = None) -> DataFrame:
    return _of(runs, rag).agg(
        F.count("*").alias("runs"), F.avg("duration_s").alias("avg_s"), F.avg("chunks_per_second").alias("avg_chunks_per_second"), F.coalesce(F.sum("total_chunks"), F.lit(0)).alias("chunks"), F.coalesce(F.sum("errors"), F.lit(0)).alias("errors")
    )


def embedding_dashboard(batches: DataFrame, rag: str | None = None) -> DataFrame:
    return _of(batches, rag).agg(
        F.count("*").alias("batches"), F.avg("duration_ms").alias("avg_ms"), F.avg("chunks_per_second").alias("avg_chunks_per_second"), F.coalesce(F.sum("batch_size"), F.lit(0)).alias("texts")
    )


def latest(rows: DataFrame, time: str, key: str) -> DataFrame:
    """The one latest row; of rows of one time the one of greatest key."""
    return rows.filter(F.col(time).isNotNull()).orderBy(F.desc(time), F.desc(key)).limit(1)


def recent(rows: DataFrame, time: str, key: str, n: int, oldest_first: bool = False) -> DataFrame:
    """The n latest rows."""
    top = rows.filter(F.col(time).isNotNull()).orderBy(F.desc(time), F.desc(key)).limit(n)
    return top.orderBy(F.asc(time), F.asc(key)) if oldest_first else top


def purge(rows: DataFrame, time: str, now: float, days: float) -> DataFrame:
    """Rows no older than ``days`` at ``now`` (epoch seconds); undated rows stay."""
    return rows.filter(F.col(time).isNull() | (F.col(time) >= now - 86400.0 * days))


def _table(spark: SparkSession, folder: str, fact: str) -> VersionedTable:
    return VersionedTable(spark, f"{folder}/{fact}", SCHEMAS[fact])


def append(rows: DataFrame, folder: str, fact: str) -> None:
    """Adds rows to a fact table; columns they lack are null."""
    empty = rows.sparkSession.createDataFrame([], SCHEMAS[fact])
    _table(rows.sparkSession, folder, fact).append(empty.unionByName(rows, allowMissingColumns=True).select(*empty.columns).coalesce(1))


def record(spark: SparkSession, folder: str, fact: str, **values: object) -> None:
    """Adds one row."""
    fields = [f.split() for f in SCHEMAS[fact].split(", ") if f.split()[0] in values]
    append(spark.createDataFrame([tuple(values[name] for name, _ in fields)], ", ".join(map(" ".join, fields))), folder, fact)


def rate(n: int, seconds: float) -> float:
    """So many a second, to one digit; 0 where no time passed."""
    return round(n / seconds, 1) if seconds > 0 else 0.0


def read(spark: SparkSession, folder: str, fact: str) -> DataFrame:
    return _table(spark, folder, fact).read()


def purge_all(spark: SparkSession, folder: str, days: float, now: float | None = None) -> int:
    """Applies retention to all fact tables; returns how many rows went. What stays is a new version, which then takes the old one's place."""
    gone, now = 0, time.time() if now is None else now
    for fact, when in FACTS.items():
        facts = _table(spark, folder, fact)
        rows = facts.read()
        went = rows.count() - purge(rows, when, now, days).count()
        if went:
            facts.write(purge(rows, when, now, days))
        gone += went
    return gone


def system_snapshot(spark: SparkSession) -> DataFrame:
    """One row on this machine just now; figures that can't be had are null."""
    try:
        import psutil

        memory = psutil.virtual_memory()
        own = psutil.Process().memory_info().rss / 2**20
        values = (None, time.time(), float(psutil.cpu_percent()), float(memory.percent), memory.used / 2**20, own)
    except ImportError:
        values = (None, time.time(), None, None, None, None)
    return spark.createDataFrame([values], SCHEMAS["system_snapshots"])
