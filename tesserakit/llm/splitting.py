"""Splitting oversized texts at natural boundaries.

Every boundary of a text is a node. It is joined to its farthest legal successor: the last boundary
a piece that begins there may reach, or a hard cut at the limit where the stretch holds none. All
greedy cuts are then derived at once by pointer doubling: the set of reached nodes jumps through the
successor table, the table is squared, and after log2(longest path) rounds every cut of every text of
the batch is marked. No loop runs over pieces or texts, so a text of any length costs the same few
array passes.

Overlap is part of a successor's legality: a piece is the overlap before the cut it begins at and the
new stretch. The limit holds for the new stretch, as in the chunks table, or for the whole piece with
``inside``.

Given cuts are judged the same way (``audit_cuts``): the stretch of each given piece is cut anew through
its own successor table, all of a batch at once, and it must come out as one piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMIT, OVERLAP = 1024, 128
BLANKS = np.array([ord(c) for c in " \t\n\r"], dtype=np.uint32)
ENDS = np.array([ord(c) for c in "。！？"], dtype=np.uint32)
#: Cuts of one file that are looked at together; a file with more is looked at in several rows.
BLOCK = 65_536
#: Code points put together before one round of doubling.
BATCH = 4_000_000

PIECES = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("chunk_index", T.LongType()),
        T.StructField("start_char", T.LongType()),
        T.StructField("end_char", T.LongType()),
        T.StructField("text", T.StringType()),
    ]
)


def boundaries(text: str) -> np.ndarray:
    """Mask over positions 0..n: the end, blanks directly before or after, or an ideographic end mark directly before."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    n = len(codes)
    mask = np.zeros(n + 1, dtype=bool)
    if n:
        blank = np.isin(codes, BLANKS)
        mask[1:] = blank | np.isin(codes, ENDS)
        mask[1:n] |= blank[1:]
    mask[n] = True
    return mask


def _ragged(counts: np.ndarray) -> np.ndarray:
    """0 .. n-1 for each n of ``counts``, one after the other."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def nodes_and_successors(at: np.ndarray, first: np.ndarray, limit: int, overlap: int = 0, inside: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All places a cut may have, where the stretch of each begins, and the index of each one's farthest legal successor.

    ``at`` are beginnings, boundaries and ends of stretches in order on one axis, ``first`` the beginning of each one's
    stretch; stretches lie further apart than ``limit``. Hard cuts are put into gaps that no piece bridges. A piece that
    begins at a node has the overlap before it, as far as its stretch goes back; with ``inside`` that counts in its limit.
    """

    def reach(at: np.ndarray, first: np.ndarray) -> np.ndarray:
        return (np.maximum(at - overlap, first) if inside else at) + limit

    natural, far = at, reach(at, first)
    wide = np.flatnonzero((first[1:] == first[:-1]) & (at[1:] > far[:-1])) if len(at) else np.zeros(0, dtype=np.int64)
    if len(wide):
        step = limit - overlap if inside else limit
        counts = -(-(at[wide + 1] - far[wide]) // step)
        hard = np.repeat(far[wide], counts) + step * _ragged(counts)
        at, first = np.concatenate((at, hard)), np.concatenate((first, np.repeat(first[wide], counts)))
        order = np.argsort(at, kind="stable")
        at, first = at[order], first[order]
    far = reach(at, first)
    last = np.searchsorted(at, far, side="right") - 1
    if inside and len(natural):  # a hard cut of a later node may be in reach as well, but a boundary goes first
        best = natural[np.searchsorted(natural, far, side="right") - 1]
        last = np.where(best > at, np.searchsorted(at, best), last)
    return at, first, last


def reached(successor: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """Mask of the nodes on the roots' paths, by pointer doubling; a path ends where a node is its own successor."""
    seen = np.zeros(len(successor), dtype=bool)
    seen[roots] = True
    jump = successor
    while True:
        seen[jump[seen]] = True
        twice = jump[jump]
        if np.array_equal(twice, jump):
            return seen
        jump = twice


def cut_stretches(at: np.ndarray, first: np.ndarray, limit: int, overlap: int = 0, inside: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The greedy cuts of all stretches (see ``nodes_and_successors``), without beginnings, and where the stretch of each begins."""
    at, first, successor = nodes_and_successors(at, first, limit, overlap, inside)
    cut = reached(successor, np.flatnonzero(at == first)) & (at > first)
    return at[cut], first[cut]


def cut_batch(texts: list[str], limit: int = LIMIT, overlap: int = 0, inside: bool = False) -> list[np.ndarray]:
    """The greedy cuts of each text, without 0, all derived together."""
    if not texts:
        return []
    own = [np.flatnonzero(boundaries(text)) for text in texts]
    own = [b if len(b) and b[0] == 0 else np.concatenate(([0], b)) for b in own]
    ends = np.cumsum([b[-1] + limit + 1 for b in own])
    bases = ends - [b[-1] + limit + 1 for b in own]
    at, first = cut_stretches(np.concatenate([b + base for b, base in zip(own, bases)]), np.repeat(bases, [len(b) for b in own]), limit, overlap, inside)
    edges = np.searchsorted(first, bases)
    return [part - base for part, base in zip(np.split(at, edges[1:]), bases)]


def _split(limit: int, overlap: int, inside: bool):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            keys, texts, size = [], [], 0
            for k, (key, text) in enumerate(zip(part["key"], part["text"])):
                keys.append(key)
                texts.append(text)
                size += len(text)
                if size >= BATCH or k == len(part) - 1:
                    rows = []
                    for a, t, cuts in zip(keys, texts, cut_batch(texts, limit, overlap, inside)):
                        before = np.concatenate(([0], cuts[:-1]))
                        starts = np.maximum(before - overlap, 0)
                        starts[:1] = 0
                        rows += [(a, i, int(x), int(y), t[x:y]) for i, (x, y) in enumerate(zip(starts, cuts))]
                    yield pd.DataFrame(rows, columns=PIECES.fieldNames())
                    keys, texts, size = [], [], 0

    return run


def split_texts(texts: DataFrame, key: str, text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, only_larger: bool = True, inside: bool = False) -> DataFrame:
    """The pieces of each text: key, chunk_index (from 0), start_char, end_char, text.

    ``end_char`` is a natural boundary unless the ``limit`` characters since the cut before hold none; every piece after
    the first starts ``overlap`` characters before that cut. Texts of up to ``limit`` characters are left out, or come
    out as one piece with ``only_larger=False``. Null and empty texts give nothing; rows that occur twice are split once;
    the input's other columns play no part; a table without rows gives none. The key comes out as a string under its own name.
    """
    if limit < 1 or overlap < 0 or inside and overlap >= limit:
        raise ValueError("limit must be at least 1, overlap at least 0, and below the limit that it counts in")
    rows = texts.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).filter(F.length("text") > (limit if only_larger else 0))
    out = rows.mapInPandas(_split(limit, overlap, inside), PIECES).distinct()
    return out.withColumnRenamed("key", key)


def recut(at: np.ndarray, before: np.ndarray, end: np.ndarray, limit: int) -> np.ndarray:
    """For each stretch from ``before`` to ``end`` of a text with boundaries ``at``: whether the operator leaves it whole."""
    whole = np.ones(len(end), dtype=bool)
    own = np.flatnonzero(end > before)
    low, high = np.searchsorted(at, before[own], side="right"), np.searchsorted(at, end[own])
    sizes = high - low + 2
    total, done = np.cumsum(sizes), 0
    while done < len(own):
        # so many stretches at once as have BATCH nodes together
        last = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + BATCH, side="right")))
        n, p, e = sizes[done:last], before[own[done:last]], end[own[done:last]]
        base = np.cumsum(e - p + limit + 1) - (e - p + limit + 1)
        k, of = _ragged(n), np.repeat(np.arange(len(n)), n)
        inner = at[np.clip(low[done:last][of] + k - 1, 0, max(0, len(at) - 1))] if len(at) else p[of]
        nodes = base[of] + np.where(k == 0, 0, np.where(k == n[of] - 1, e[of] - p[of], inner - p[of]))
        _, first = cut_stretches(nodes, base[of], limit)
        whole[own[done:last]] = np.diff(np.searchsorted(first, [*base, np.iinfo(np.int64).max])) == 1
        done = last
    return whole


def _judge(limit: int, overlap: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            names, numbers = [], []
            for name, text, skipped, n, cuts in zip(part["source_file"], part["text"], part["skipped"], part["n"], part["cuts"]):
                order, start, end, before = np.array([(c["i"], c["s"], c["e"], c["p"]) for c in cuts], dtype=np.int64).T
                at = np.flatnonzero(boundaries(text)) + skipped
                # beyond the text a stretch has no boundaries; how far beyond the limit it goes doesn't matter
                whole = recut(at, before, np.minimum(end, np.maximum(before, n) + limit + 1), limit)
                natural = np.isin(end, at) & (end <= n)
                passed = (end > before) & (np.searchsorted(at, end) > np.searchsorted(at, before, side="right"))
                bad = ~whole | ((order > 0) & (start != np.maximum(before - overlap, 0))) | (~natural & passed)
                names += [name] * int(bad.sum())
                numbers += order[bad].tolist()
            yield pd.DataFrame({"source_file": pd.Series(names, dtype=object), "chunk_index": pd.Series(numbers, dtype=np.int64)})

    return run


def with_previous_end(cuts: DataFrame) -> DataFrame:
    """``cuts`` (source_file, i, s, e) with p, the end of the piece before in the file, and its block.

    A file's pieces are never sorted in one task: the lag runs within blocks of pieces, and only each block's last piece,
    one in thousands, goes into a window over the file.
    """
    cuts = cuts.withColumn("block", F.floor(F.col("i") / BLOCK))
    inside = W.partitionBy("source_file", "block").orderBy("i", "s", "e")
    last = cuts.groupBy("source_file", "block").agg(F.max_by("e", F.struct("i", "s", "e")).alias("last"))
    carried = last.withColumn("carried", F.lag("last").over(W.partitionBy("source_file").orderBy("block"))).drop("last")
    return (
        cuts.withColumn("own", F.lag("e").over(inside))
        .join(carried, ["source_file", "block"])
        .withColumn("p", F.coalesce("own", "carried", F.lit(0)))
        .drop("own", "carried")
    )


def audit_cuts(files: DataFrame, chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """source_file and chunk_index of the given chunks that this operator's terms don't allow.

    ``files`` has source_path and text, ``chunks`` source_file, chunk_index, start_char and end_char. The stretch from the
    end of the chunk before to the chunk's own end is cut anew, through its successor table, by pointer doubling. The chunk
    is allowed if that leaves it whole, if it ends at a boundary unless none lies between, and if it starts with the overlap
    in front. Chunks with a null in one of those columns, of unknown files or of files without text are left out;
    duplicates count once; extra columns play no part.

    Only the part of a text that a block of cuts speaks of goes to Python.
    """
    cuts = (
        chunks.select("source_file", F.col("chunk_index").cast("long").alias("i"), F.col("start_char").cast("long").alias("s"), F.col("end_char").cast("long").alias("e"))
        .dropna()
        .distinct()
    )
    edges = F.min(F.least("p", "e")).alias("low"), F.max(F.greatest("p", "e")).alias("high")
    blocks = with_previous_end(cuts).groupBy("source_file", "block").agg(F.collect_list(F.struct("i", "s", "e", "p")).alias("cuts"), *edges)
    texts = files.select(F.col("source_path").alias("source_file"), "text").dropna().dropDuplicates()
    rows = texts.join(blocks, "source_file").withColumn("n", F.length("text").cast("long"))
    clipped = lambda c: F.least(F.greatest(c, F.lit(0)), F.col("n"))
    rows = rows.withColumn("skipped", clipped(F.col("low") - 1)).withColumn("upto", clipped(F.col("high") + 1))
    part = F.substring(F.col("text"), (F.col("skipped") + 1).cast("int"), F.greatest(F.col("upto") - F.col("skipped"), F.lit(0)).cast("int"))
    return rows.select("source_file", part.alias("text"), "skipped", "n", "cuts").mapInPandas(_judge(limit, overlap), "source_file string, chunk_index long").distinct()
