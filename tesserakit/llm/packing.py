"""Filling containers of fixed capacity with texts.

First-fit decreasing, with the open containers' free space in a tournament tree: every inner node
holds the larger of its children, so the first container with room enough is found on one path from
the root. Groups of texts and parts drawn by a hash are packed independently; each is large enough
for its last containers not to matter, and no group grows with the collection. Only keys and sizes
are shuffled, never texts. A text larger than a container is cut first: into full containers and a rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sizes import byte_tokens

CAPACITY = 4096
#: Texts packed together, about.
GROUP = 5_000

PARTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("start_char", T.LongType()),
        T.StructField("end_char", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
    ]
)
PLACED = "doc_id long, part int, start_char long, end_char long, n_tokens long, group int, bin int"


def cut(text: str, capacity: int) -> list[tuple[int, int, int]]:
    """start, end and tokens of the fewest parts of a text that each fit; the last one has the end token."""
    data = text.encode("utf-8", "surrogatepass")
    out, at, char = [], 0, 0
    while len(data) + 1 - at > capacity:
        end = min(at + capacity, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        if end <= at:
            raise ValueError("a container must hold any one character")
        n = len(data[at:end].decode("utf-8", "surrogatepass"))
        out.append((char, char + n, end - at))
        at, char = end, char + n
    out.append((char, len(text), len(data) - at + 1))
    return out


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The container of every size; sizes of equal value keep their order."""
    order = sorted(range(len(sizes)), key=lambda k: -sizes[k])
    width = 1
    while width < max(1, len(sizes)):
        width *= 2
    tree = [capacity] * (2 * width)
    bins = [0] * len(sizes)
    for k in order:
        size = sizes[k]
        if size > capacity:
            raise ValueError("an item is larger than a container")
        node = 1
        while node < width:
            node *= 2
            if tree[node] < size:
                node += 1
        bins[k] = node - width
        tree[node] -= size
        node //= 2
        while node:
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
            node //= 2
    return bins


def _cut(capacity: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(doc, k, *piece) for doc, text in zip(part["doc_id"], part["text"]) for k, piece in enumerate(cut(text, capacity))]
            yield pd.DataFrame(rows, columns=PARTS.fieldNames())

    return run


def _pack(capacity: int):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["n_tokens", "doc_id", "part"], ascending=[False, True, True], kind="stable")
        return part.assign(bin=first_fit_decreasing(part["n_tokens"].tolist(), capacity))

    return run


def pack_texts(texts: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, seed: int = 11) -> DataFrame:
    """doc_id, part, start_char, end_char, n_tokens and container of every text or part of a text.

    A container is named ``group:bin``; the sizes in it add up to ``capacity`` at most. Only texts of more than
    ``capacity`` tokens have several parts. An empty text is one item of one token (its end); null texts and null keys are
    no items. Rows that occur twice with one key are items of their own; extra columns play no part; a table without
    rows gives none.
    """
    rows = texts.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).dropna()
    size = byte_tokens("text")
    whole = rows.filter(size <= capacity).select(
        "doc_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("start_char"), F.length("text").cast("long").alias("end_char"), size.alias("n_tokens")
    )
    items = whole.unionByName(rows.filter(size > capacity).mapInPandas(_cut(capacity), PARTS))
    parts = rows.agg(F.sum(F.ceil(size / F.lit(float(capacity))))).first()[0] or 0
    groups = max(1, round(int(parts) / GROUP))
    # the parts of one text go to groups of their own, so a text of any length fills none alone
    grouped = items.withColumn("group", F.pmod(F.xxhash64("doc_id", "part", "n_tokens", F.lit(seed)), F.lit(groups)).cast("int"))
    placed = grouped.groupBy("group").applyInPandas(_pack(capacity), PLACED)
    return placed.withColumn("container", F.concat_ws(":", "group", "bin")).drop("group", "bin")
