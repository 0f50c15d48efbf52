"""Mixing sources to target weights.

Every source's texts are shuffled (by a hash) into a stream of blocks of equal tokens, repeated as
often as its quota needs and its cap allows. The mixture is a sequence of slots: the van der Corput
point of a slot, looked up in the sources' cumulative weights, names its source, so any stretch of
the mixture has the weights as nearly as whole slots can. The k-th slot of a source takes its k-th
block. Running sums and ranks go through buckets, so a source with a third of all rows, or a third
of all slots, is never sorted in one task. What the slots took is counted afterwards (``reached``).

The targets are a table given by hand; what grows with it alone, one row a source, is planned in the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .sizes import ROWS, before, byte_tokens

#: Tokens of a block, which fills one slot.
BLOCK = 65_536


def plain(source: str | Column) -> Column:
    """A source's name without outer spaces and letter case."""
    return F.lower(F.trim(source))


def quotas(texts: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, max_repeats, n_tokens, capacity, wanted, quota and reachable of each target.

    ``wanted`` is the target's share of the tokens of all rows of ``texts``; ``quota`` is that or the capacity (its tokens
    times max_repeats) if less. A null source is no source; a target without texts has capacity 0; null shares and
    repeats count as 0. Targets that occur twice, word for word, count once.
    """
    own = texts.select(plain("source").alias("name"), byte_tokens("text").alias("n")).groupBy("name").agg(F.sum("n").alias("n_tokens"))
    total = own.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("total"))
    wanted = targets.select("source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"))
    rows = wanted.filter("source is not null").distinct().withColumn("name", plain("source")).join(own, "name", "left").crossJoin(F.broadcast(total))  # one row
    rows = rows.withColumn("n_tokens", F.coalesce("n_tokens", F.lit(0)))
    rows = rows.withColumn("capacity", F.col("n_tokens") * F.col("max_repeats")).withColumn("wanted", F.col("target_share") * F.col("total"))
    return rows.select(
        "source",
        "name",
        "target_share",
        "max_repeats",
        "n_tokens",
        "capacity",
        "wanted",
        F.least(F.floor("wanted"), "capacity").cast("long").alias("quota"),
        (F.col("capacity") >= F.col("wanted")).alias("reachable"),
    )


def van_der_corput(i: Column) -> Column:
    """The base-2 radical inverse of a number below 2^52: its bits mirrored behind the point."""
    return F.conv(F.reverse(F.lpad(F.bin(i), 52, "0")), 2, 10).cast("double") / F.lit(float(2**52))


MIXTURE = "slot long, source string, doc_id long, repeat int, offset long, n_tokens long"
QUOTAS = "source string, name string, target_share double, max_repeats int, n_tokens long, capacity long, wanted double, quota long, reachable boolean"


def schedule(plan: list[Row], like: DataFrame, block: int) -> DataFrame:
    """name, k and slot: the source of each slot and the slot's rank within it, for sources (name, quota) in order of name.

    The point of a slot falls into one cell of a grid finer than the sources, and so meets only the sources that reach
    into that cell.
    """
    total, slots = sum(r["quota"] for r in plan), sum(-(-r["quota"] // block) for r in plan)
    grid = 1 << math.ceil(math.log2(4 * len(plan)))
    rows, low = [], 0
    for r in plan:
        high = low + r["quota"]
        first, last = low * grid // total, -(-high * grid // total)
        rows += [(cell, r["name"], low / total, high / total) for cell in range(first, last)]
        low = high
    spark = like.sparkSession
    cells = spark.createDataFrame(rows, "cell int, name string, low double, high double")
    points = spark.range(slots).withColumnRenamed("id", "slot").withColumn("u", van_der_corput(F.col("slot")))
    named = points.withColumn("cell", F.floor(F.col("u") * grid).cast("int")).join(cells, "cell").filter("low <= u and u < high")
    named = named.select("name", "slot").withColumn("bucket", F.floor(F.col("slot") / ROWS))
    return before(named, ["name"], "bucket", ["slot"], F.lit(1).cast("long"), "k").select("name", "k", "slot")


def _mixture(texts: DataFrame, plan: list[Row], block: int, seed: int) -> DataFrame:
    spark = texts.sparkSession
    plan = sorted((r for r in plan if r["quota"] > 0), key=lambda r: r["name"])
    if not plan:
        return spark.createDataFrame([], MIXTURE)
    rows = texts.select("doc_id", plain("source").alias("name"), byte_tokens("text").alias("n_tokens")).dropna()
    buckets = max(1, round(texts.count() / ROWS))
    rows = rows.withColumn("at", F.xxhash64("doc_id", F.lit(seed)))
    rows = rows.withColumn("bucket", F.floor((F.col("at").cast("double") / 2.0**64 + 0.5) * buckets).cast("long"))
    rows = before(rows, ["name"], "bucket", ["at", "doc_id"], F.col("n_tokens"), "start")
    few = spark.createDataFrame([(r["source"], r["name"], r["quota"], r["n_tokens"]) for r in plan], "source string, name string, quota long, all_tokens long")
    stream = rows.join(few, "name")
    passes = F.ceil(F.col("quota") / F.col("all_tokens")).cast("int")
    stream = stream.withColumn("repeat", F.explode(F.sequence(F.lit(0), passes - 1)))
    stream = stream.withColumn("offset", F.col("repeat") * F.col("all_tokens") + F.col("start")).filter("offset < quota")
    stream = stream.withColumn("k", F.floor(F.col("offset") / block).cast("long"))
    slots = schedule(plan, texts, block)
    # blocks for which the points left their source no slot, a few a source at most, come last, one after the other
    had = slots.groupBy("name").agg(F.count("*").alias("had")).toPandas()  # one row a source
    had = dict(zip(had["name"], had["had"].tolist()))
    ends, last = [], sum(-(-r["quota"] // block) for r in plan)
    for r in plan:
        got, blocks = had.get(r["name"], 0), -(-r["quota"] // block)
        ends.append((r["name"], last - got))
        last += max(0, blocks - got)
    late = spark.createDataFrame(ends, "name string, shift long")
    found = stream.join(slots, ["name", "k"], "left").join(late, "name").withColumn("slot", F.coalesce("slot", F.col("shift") + F.col("k")))
    return found.select("slot", "source", "doc_id", "repeat", F.col("offset").cast("long").alias("offset"), "n_tokens")


def mixture(texts: DataFrame, targets: DataFrame, block: int = BLOCK, seed: int = 3) -> DataFrame:
    """slot, source, doc_id, repeat (from 0), offset and n_tokens of every text in the mixture, in order of slot and offset.

    Each source gives texts until its quota (see ``quotas``) is met, none more than max_repeats times. Null texts give
    nothing. With equal shuffle keys the doc_id decides. No two sources share a slot.
    """
    return _mixture(texts, quotas(texts, targets).collect(), block, seed)


def reached(texts: DataFrame, targets: DataFrame, block: int = BLOCK, seed: int = 3) -> DataFrame:
    """The columns of ``quotas`` and, of the mixture, ``used`` (tokens) and ``times`` (uses of the most used text) of each target."""
    plan = quotas(texts, targets).collect()
    taken = _mixture(texts, plan, block, seed).groupBy("source").agg(F.sum("n_tokens").alias("used"), (F.max("repeat") + 1).alias("times"))
    rows = texts.sparkSession.createDataFrame(plan, QUOTAS).join(taken, "source", "left")
    return rows.withColumns({"used": F.coalesce("used", F.lit(0)), "times": F.coalesce("times", F.lit(0))})


def short_of_share(texts: DataFrame, targets: DataFrame) -> DataFrame:
    """source: targets of which the mixture, all their repeats used up, has less than their share of all tokens.

    A source's last text may overshoot its quota and the quota is a whole number, so an exact check of the capacity follows.
    """
    return reached(texts, targets).filter("used < wanted").filter("not reachable").select("source")
