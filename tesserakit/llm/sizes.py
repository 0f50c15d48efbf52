"""Sizes of texts in tokens of a public byte-level tokenizer, and running sums that no hot group can gather in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a group that one window sorts, about.
ROWS = 50_000


def byte_tokens(text: str | Column) -> Column:
    """One token a byte of UTF-8 and one end token."""
    return F.octet_length(text).cast("long") + 1


def before(rows: DataFrame, group: list[str], bucket: str, order: list[str], value: Column, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over the rows before, within ``group`` by bucket and ``order``.

    Buckets must follow the order. The sum runs within each bucket; only the buckets' own sums, one row in thousands, go
    through a window over the group.
    """
    keys = [*group, bucket]
    rows = rows.withColumn("_v", value)
    sums = rows.groupBy(*keys).agg(F.sum("_v").alias("_s"))
    sums = sums.withColumn("_before", F.sum("_s").over(W.partitionBy(*group).orderBy(bucket).rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_s")).drop("_s")
    inside = F.sum("_v").over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_v")
    return rows.withColumn("_in", inside).join(sums, keys).withColumn(name, F.col("_in") + F.col("_before")).drop("_v", "_in", "_before")
