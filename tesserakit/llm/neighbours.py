"""The k most similar vectors of every vector, by small-world graphs.

The collection is cut into shards by a coarse codebook. Each shard holds the vectors for which it is
among the nearest cells (a vector near a border is in several), and is indexed by a hierarchical
navigable small-world graph: per level one flat array of neighbour numbers, -1 where there is none.
Vectors enter in batches that double up to a bound; a batch descends and searches the graph in
lockstep as one set of array operations, and is then linked with diverse neighbours both ways. Every
vector then searches the graphs of the shards it belongs to, and the shards' results are merged.

A shard has a bounded number of vectors whatever the collection's size: cells grow in number with
the collection, and a cell that still is too large is cut at random into several graphs, all of
which its queries search. Work is so in proportion to the vectors. The codebook is fitted on a
sample of bounded size; every vector is indexed and searched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..spark_util import cut_lineage

#: Vectors the codebook is fitted on: so many, or 16 a cell where that is more.
SAMPLE = 20_000
#: Vectors a graph holds, about and at most.
CELL, LARGEST = 3_000, 12_000
#: Cells of the codebook, at most: it is sent to every task.
CELLS = 4_096
#: Nearest cells a vector is indexed and searched in.
COPIES = 3
#: Links of a node above the lowest level (twice as many there), candidates kept while building and while searching.
LINKS, BUILD, SEARCH = 16, 40, 48
BATCH = 512


def _top(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of each row's k largest, in falling order."""
    k = min(k, scores.shape[1])
    part = np.argpartition(-scores, k - 1, axis=1)[:, :k] if k < scores.shape[1] else np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
    order = np.argsort(-np.take_along_axis(scores, part, 1), axis=1, kind="stable")
    return np.take_along_axis(part, order, 1)


class SmallWorld:
    """A hierarchical navigable small-world graph over unit vectors, all of whose operations take batches."""

    def __init__(self, vectors: np.ndarray, links: int = LINKS, build: int = BUILD, seed: int = 7):
        self.x = np.ascontiguousarray(vectors, dtype=np.float32)
        self.links, self.build_width = links, build
        n = len(self.x)
        draw = np.random.default_rng(seed).random(n)
        self.level = np.minimum((-np.log(np.maximum(draw, 1e-12)) / np.log(max(links, 2))).astype(np.int64), 8)
        if n:
            self.level[0] = self.level.max()  # the entry point enters first
        # one flat table per level; a node's row in it is its rank among the nodes of that level
        self.rows = [np.cumsum(self.level >= h) - 1 for h in range(int(self.level.max(initial=0)) + 1)]
        self.near = [np.full((int((self.level >= h).sum()), links * (2 if h == 0 else 1)), -1, dtype=np.int32) for h in range(len(self.rows))]
        self._build()

    def _neighbours(self, nodes: np.ndarray, h: int) -> np.ndarray:
        return self.near[h][self.rows[h][nodes]]

    def _beam(self, q: np.ndarray, starts: np.ndarray, h: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The best ``width`` nodes of level h for each row of q, from ``starts`` on: nodes (-1: none) and similarities."""
        m, n = len(q), len(self.x)
        ids = np.full((m, width), -1, dtype=np.int32)
        sims = np.full((m, width), -np.inf, dtype=np.float32)
        done = np.ones((m, width), dtype=bool)
        s = starts.shape[1]
        ids[:, :s], done[:, :s] = starts, False
        sims[:, :s] = np.einsum("mkd,md->mk", self.x[starts], q)
        # -1 until a query has seen a node; flat, one stretch a query
        seen = np.full(m * n, -1, dtype=np.int32)
        seen[(np.arange(m)[:, None] * n + starts).ravel()] = 0
        live = np.arange(m)
        expand = 1 if width == 1 else 4
        while len(live):
            # each live query opens its best few unopened nodes
            open_sims = np.where(done[live], -np.inf, sims[live])
            pick = np.argpartition(-open_sims, expand - 1, axis=1)[:, :expand] if width > expand else np.broadcast_to(np.arange(width), (len(live), width))
            good = np.take_along_axis(open_sims, pick, 1) > -np.inf
            going = good.any(axis=1)
            live, pick, good = live[going], pick[going], good[going]
            if not len(live):
                break
            done[live[:, None], pick] = True
            nodes = ids[live[:, None], pick]
            found = self._neighbours(np.where(good, nodes, 0), h)
            found = np.where(good[:, :, None], found, -1).reshape(len(live), -1)
            r, c = np.nonzero(found >= 0)
            node = found[r, c]
            place = live[r] * n + node
            fresh = np.flatnonzero(seen[place] < 0)
            if not len(fresh):
                continue
            r, node, place = r[fresh], node[fresh], place[fresh]
            # a node that two opened nodes link to is taken once: the one written last
            mine = np.arange(len(r), dtype=np.int32)
            seen[place] = mine
            once = seen[place] == mine
            r, node = r[once], node[once]
            sim = np.einsum("kd,kd->k", self.x[node], q[live[r]])
            better = sim > sims[live[r], -1]
            r, node, sim = r[better], node[better], sim[better]
            if not len(r):
                continue
            at = np.arange(len(r)) - np.searchsorted(r, r)
            wide = int(at.max()) + 1
            hit, local = np.unique(r, return_inverse=True)
            add_ids = np.full((len(hit), wide), -1, dtype=np.int32)
            add_sims = np.full((len(hit), wide), -np.inf, dtype=np.float32)
            add_ids[local, at], add_sims[local, at] = node, sim
            rows = live[hit]
            all_sims = np.concatenate((sims[rows], add_sims), axis=1)
            order = np.argsort(-all_sims, axis=1, kind="stable")[:, :width]
            sims[rows] = np.take_along_axis(all_sims, order, 1)
            ids[rows] = np.take_along_axis(np.concatenate((ids[rows], add_ids), axis=1), order, 1)
            done[rows] = np.take_along_axis(np.concatenate((done[rows], np.zeros_like(add_ids, dtype=bool)), axis=1), order, 1)
        return ids, sims

    def _diverse(self, ids: np.ndarray, sims: np.ndarray, keep: int) -> np.ndarray:
        """Of each row's candidates (best first, -1: none), those nearer to the row's vector than to any kept before; filled up with the rest."""
        m, width = ids.shape
        vectors = self.x[np.maximum(ids, 0)]
        between = np.matmul(vectors, vectors.transpose(0, 2, 1))
        chosen = np.zeros((m, width), dtype=bool)
        count = np.zeros(m, dtype=np.int64)
        for j in range(width):
            shaded = (chosen & (between[:, j, :] > sims[:, j, None])).any(axis=1)
            take = (ids[:, j] >= 0) & ~shaded & (count < keep)
            chosen[:, j] = take
            count += take
        rank = np.where(ids < 0, 3 * width, np.where(chosen, 0, width) + np.arange(width))
        order = np.argsort(rank, axis=1, kind="stable")[:, :keep]
        return np.take_along_axis(ids, order, 1)

    def _link(self, nodes: np.ndarray, ids: np.ndarray, sims: np.ndarray, h: int) -> None:
        table, rows = self.near[h], self.rows[h]
        size = table.shape[1]
        table[rows[nodes]] = -1
        chosen = self._diverse(ids, sims, size // 2 if h == 0 else size)
        table[rows[nodes], : chosen.shape[1]] = chosen
        # back links: a node whose row is full keeps its diverse ones of old and new
        r, c = np.nonzero(chosen >= 0)
        target, source = chosen[r, c], nodes[r].astype(np.int32)
        order = np.argsort(target, kind="stable")
        target, source = target[order], source[order]
        hit, first, counts = np.unique(target, return_index=True, return_counts=True)
        extra = np.full((len(hit), int(counts.max(initial=0))), -1, dtype=np.int32)
        local = np.repeat(np.arange(len(hit)), counts)
        extra[local, np.arange(len(target)) - np.repeat(first, counts)] = source
        merged = np.concatenate((table[rows[hit]], extra), axis=1)
        full = (merged >= 0).sum(axis=1) > size
        order = np.argsort(merged < 0, axis=1, kind="stable")[:, :size]
        table[rows[hit[~full]]] = np.take_along_axis(merged, order, 1)[~full]
        if full.any():
            node, cand = hit[full], merged[full]
            s = np.where(cand >= 0, np.einsum("mkd,md->mk", self.x[np.maximum(cand, 0)], self.x[node]), -np.inf)
            order = np.argsort(-s, axis=1, kind="stable")
            cand, s = np.take_along_axis(cand, order, 1), np.take_along_axis(s, order, 1)
            kept = self._diverse(cand, s, size)
            table[rows[node], : kept.shape[1]] = kept

    def _build(self) -> None:
        n, at = len(self.x), min(1, len(self.x))
        while at < n:
            # batches double; points of one batch see each other through one block product
            nodes = np.arange(at, min(n, at + min(BATCH, at)))
            q = self.x[nodes]
            starts = np.zeros((len(nodes), 1), dtype=np.int32)
            own = q @ q.T
            np.fill_diagonal(own, -np.inf)
            for h in range(len(self.near) - 1, -1, -1):
                inside = self.level[nodes] >= h
                if not inside.all():
                    ids, _ = self._beam(q[~inside], starts[~inside], h, 1)
                    starts[~inside] = ids[:, :1]
                if inside.any():
                    ids, sims = self._beam(q[inside], starts[inside], h, self.build_width)
                    starts[inside] = ids[:, :1]
                    mates = np.flatnonzero(inside)
                    block = own[np.ix_(mates, mates)]
                    pick = _top(block, min(self.build_width // 2, len(mates)))
                    mate_sims = np.take_along_axis(block, pick, 1)
                    mate_ids = np.where(mate_sims > -np.inf, nodes[mates][pick], -1).astype(np.int32)
                    sims, ids = np.concatenate((sims, mate_sims), axis=1), np.concatenate((ids, mate_ids), axis=1)
                    order = np.argsort(-sims, axis=1, kind="stable")[:, : self.build_width]
                    self._link(nodes[mates], np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1), h)
            at += len(nodes)

    def search(self, q: np.ndarray, k: int, width: int = SEARCH, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest nodes of each row of q as found by the graph, best first: nodes (-1: none) and similarities.

        A query that is a node itself, as ``known`` says (-1: it isn't), starts there instead of descending.
        """
        out_ids, out_sims = [], []
        for a in range(0, len(q), BATCH):
            part = np.ascontiguousarray(q[a : a + BATCH], dtype=np.float32)
            starts = np.zeros((len(part), 1), dtype=np.int32)
            own = np.full(len(part), -1) if known is None else known[a : a + BATCH]
            for h in range(len(self.near) - 1, 0, -1):
                if (own < 0).any():
                    starts[own < 0] = self._beam(part[own < 0], starts[own < 0], h, 1)[0][:, :1]
            starts[own >= 0, 0] = own[own >= 0]
            ids, sims = self._beam(part, starts, 0, max(width, k))
            out_ids.append(ids[:, :k])
            out_sims.append(sims[:, :k])
        if not out_ids:
            return np.zeros((0, k), np.int32), np.zeros((0, k), np.float32)
        return np.concatenate(out_ids), np.concatenate(out_sims)


def usable_vectors(hits: DataFrame, key: str = "chunk_id", vector: str = "embedding", size: int = 96) -> DataFrame:
    """One vector of each key: key and vector, without those that are null, of another size, all zero or not finite."""
    good = hits.select(F.col(key).cast("string").alias("key"), F.col(vector).alias("vector")).filter(
        F.col("key").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") == size)
    )
    vec = F.col("vector")
    finite = F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    good = good.filter(finite & F.exists(vec, lambda v: v != 0))
    return good.groupBy("key").agg(F.min("vector").alias("vector"))


def _units(vectors: pd.Series) -> np.ndarray:
    x = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def codebook(x: np.ndarray, cells: int, rounds: int = 10, seed: int = 5) -> np.ndarray:
    """Unit centres by spherical k-means; an empty cell moves to a random vector."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float32)
    centres = x[rng.permutation(len(x))[:cells]].copy()
    for _ in range(rounds if cells > 1 else 0):
        cell = np.concatenate([(x[a : a + 8192] @ centres.T).argmax(axis=1) for a in range(0, len(x), 8192)])
        order = np.argsort(cell, kind="stable")
        present, first = np.unique(cell[order], return_index=True)
        sums = np.add.reduceat(x[order], first, axis=0)
        centres = x[rng.integers(0, len(x), len(centres))].copy()
        centres[present] = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return centres


def _nearest_cells(centres: np.ndarray, copies: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if not len(part):
                continue
            x = _units(part["vector"])
            cells = _top(x.astype(np.float32) @ centres.T, copies)
            c = cells.shape[1]
            rows = np.repeat(np.arange(len(part)), c)
            packed = np.array([v.tobytes() for v in x.astype(np.float32)], dtype=object)
            yield pd.DataFrame({"cell": cells.ravel().astype(np.int32), "key": part["key"].to_numpy()[rows], "unit": packed[rows]})

    return run


def _search_shard(k: int, size: int):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("key", kind="stable")
        x = np.frombuffer(b"".join(part["unit"]), dtype=np.float32).reshape(-1, size)
        keys = part["key"].to_numpy()
        inside = part["inside"].to_numpy(dtype=bool)
        nodes = np.flatnonzero(inside)
        names = keys[nodes]
        graph = SmallWorld(x[nodes])
        known = np.full(len(x), -1)
        known[nodes] = np.arange(len(nodes))
        ids, _ = graph.search(x, k + 4, known=known)
        # the found ones' exact similarities
        wide = x.astype(np.float64)
        exact = np.where((ids >= 0) & (ids != known[:, None]), 0.0, -np.inf)
        for a in range(0, len(x), 4096):
            exact[a : a + 4096] += np.einsum("mkd,md->mk", wide[nodes][np.maximum(ids[a : a + 4096], 0)], wide[a : a + 4096])
        order = np.argsort(-exact, axis=1, kind="stable")[:, :k]
        ids, exact = np.take_along_axis(ids, order, 1), np.take_along_axis(exact, order, 1)
        found = [[{"similarity": float(s), "key": names[i]} for i, s in zip(row, sims) if s > -np.inf] for row, sims in zip(ids.tolist(), exact.tolist())]
        return pd.DataFrame({"key": keys, "found": found})

    return run


def nearest_neighbours(vectors: DataFrame, k: int = 5, size: int = 96) -> DataFrame:
    """key, rank (from 1), neighbour and similarity (cosine): the k vectors most similar to each, itself left out.

    ``vectors`` has key and vector, each key once, as of ``usable_vectors``. Neighbours are those that the graphs find:
    nearly all (see the README for the recall measured against brute force). Ties go by the neighbour's key. With fewer
    than k + 1 vectors there are fewer ranks; one vector or an empty table gives no rows.
    """
    vectors = cut_lineage(vectors.select("key", "vector"))
    total = vectors.count()
    cells = int(min(CELLS, max(1, round(total / CELL))))
    wanted = max(SAMPLE, 16 * cells)
    sample = vectors
    if total > wanted:
        sample = vectors.filter(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < int(1e6 * wanted / total))
    x = [np.asarray(r[0], dtype=np.float64) for r in sample.select("vector").limit(int(1.2 * wanted)).collect()]
    centres = codebook(_units(x), cells) if x else np.zeros((1, size), np.float32)
    copies = vectors.mapInPandas(_nearest_cells(centres, COPIES), "cell int, key string, unit binary")
    # cells that came out too large are cut at random into parts, all of which their queries search
    large = {r[0]: -(-r[1] // LARGEST) for r in copies.groupBy("cell").count().filter(F.col("count") > LARGEST).collect()}
    if large:
        parts = F.coalesce(F.create_map(*[F.lit(v) for kv in large.items() for v in kv])[F.col("cell")], F.lit(1))
        copies = copies.withColumn("parts", parts).withColumn("home", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
        copies = copies.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("inside", F.col("part") == F.col("home"))
    else:
        copies = copies.withColumn("part", F.lit(0)).withColumn("inside", F.lit(True))
    # building graphs takes far longer than moving their vectors, so their number, not their bytes, sets that of the tasks
    tasks = min(4000, max(vectors.sparkSession.sparkContext.defaultParallelism, cells))
    found = copies.repartition(tasks, "cell", "part").groupBy("cell", "part").applyInPandas(_search_shard(k, size), "key string, found array<struct<similarity:double,key:string>>")
    # a neighbour that several shards found counts once
    one = F.transform("found", lambda f: F.struct((-F.round(f["similarity"], 12)).alias("less"), f["key"].alias("neighbour")))
    best = found.select("key", one.alias("found")).groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))).alias("found"))
    ranked = best.select("key", F.posexplode(F.slice("found", 1, k)).alias("at", "f"))
    return ranked.select("key", (F.col("at") + 1).alias("rank"), F.col("f.neighbour").alias("neighbour"), (-F.col("f.less")).alias("similarity"))
