"""Search over chunks: vectors, BM25, fusion, re-ranking, diversity, and the pipeline of them."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X

K1, B, EPSILON = 1.5, 0.75, 0.25


def ranked(rows: DataFrame, k: int, order: list[Column]) -> DataFrame:
    """The first k rows in ``order`` with their rank (from 1). Only those k rows meet in one task."""
    top = rows.orderBy(*order).limit(k)
    return top.withColumn("rank", F.row_number().over(W.orderBy(*order)))


# --- vectors ---------------------------------------------------------------------------------------------------------


def _first_ids(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best rows of different ids, each with its id's greatest similarity."""
    return rows.sort_values(["similarity", "id"], ascending=[False, True], na_position="first").drop_duplicates("id").head(k)


def _similar(query: np.ndarray, k: int | None, least: float | None):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = None
        for part in parts:
            if not len(part):
                continue
            x = np.array([np.asarray(v, dtype=np.float64) for v in part["v"]])
            with np.errstate(invalid="ignore", divide="ignore"):
                sim = np.round(x @ query / np.linalg.norm(x, axis=1), 4)
            out = pd.DataFrame({"id": part["id"], "similarity": sim})
            out = out[np.isfinite(sim) & (sim >= least if least is not None else True)]
            best = out if best is None else pd.concat([best, out])
            if k is None:
                yield best
                best = None
            elif len(best) > 4 * k + 1000:
                best = _first_ids(best, k)
        if best is not None:
            yield best if k is None else _first_ids(best, k)

    return run


def vector_search(chunks: DataFrame, query: list[float], k: int, key: str = "chunk_id", vector: str = "embedding", min_score: float | None = None, where: Column | None = None) -> DataFrame:
    """rank, id and similarity (cosine, to 4 digits) of the k chunks most similar to ``query``; exact.

    ``where`` is applied before the top k, ``min_score`` to the rounded similarity. Each partition keeps its own k best
    ids, however often they are repeated, so a search moves k rows a partition. Chunks without a vector, with one of another length or of length zero are left
    out; ties go by id; an id that occurs twice counts once; an empty table gives no rows.
    """
    rows = chunks if where is None else chunks.filter(where)
    rows = rows.select(F.col(key).cast("string").alias("id"), F.col(vector).alias("v")).filter(F.size("v") == len(query)).filter(~F.exists("v", lambda x: x.isNull()))
    q = np.asarray(query, dtype=np.float64)
    norm = np.linalg.norm(q)
    found = rows.mapInPandas(_similar(q / (norm or 1.0), k, min_score), "id string, similarity double")
    return ranked(found.groupBy("id").agg(F.max("similarity").alias("similarity")), k, [F.desc("similarity"), F.asc("id")])


#: Vectors multiplied with one another at once.
VECTORS = 2048


def _pack_vectors(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        for a in range(0, len(part), VECTORS):
            some = part.iloc[a : a + VECTORS]
            x = np.array([np.asarray(v, dtype=np.float64) for v in some["v"]])
            n = np.linalg.norm(x, axis=1)
            good = (n > 0) & np.isfinite(n)
            x = (x[good] / n[good, None]).astype(np.float64)
            yield pd.DataFrame({"ids": [some["id"][good].tolist()], "data": [x.tobytes()]})


def _best_of_blocks(k: int, size: int, itself: bool):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for qi, qd, ci, cd in zip(part["q_ids"], part["q_data"], part["ids"], part["data"]):
                q, c = (np.frombuffer(d, dtype=np.float64).reshape(-1, size) for d in (qd, cd))
                if not len(q) or not len(c):
                    continue
                qi, ci = np.asarray(qi), np.asarray(ci)
                order = np.argsort(ci, kind="stable")
                ci, first = np.unique(ci[order], return_index=True)
                sim = np.round(q @ c[order].T, 6)
                if len(ci) < len(order):  # an id's copies count once, by the most similar
                    sim = np.maximum.reduceat(sim, first, axis=1)
                if not itself:
                    sim[qi[:, None] == ci[None, :]] = -np.inf
                m = min(k, len(ci))
                least = np.partition(sim, len(ci) - m, axis=1)[:, len(ci) - m]
                rows, cols = np.nonzero(sim >= least[:, None])  # all ties at the cut, by row
                best = np.lexsort((cols, -sim[rows, cols], rows))
                rows, cols = rows[best], cols[best]  # columns are in order of ids
                kept = np.arange(len(rows)) - np.searchsorted(rows, rows) < m
                rows, cols = rows[kept], cols[kept]
                out = pd.DataFrame({"query_id": qi[rows], "id": ci[cols], "similarity": sim[rows, cols]})
                yield out[np.isfinite(out["similarity"])]

    return run


def vector_search_many(vectors: DataFrame, queries: DataFrame, k: int, size: int, itself: bool = False) -> DataFrame:
    """query_id, rank, id and similarity: for every query (id, v) its k most similar rows of ``vectors`` (id, v); exact.

    Both sides are packed into blocks, and each pair of blocks is one matrix product, so rows are never paired one by
    one; per query and block only the k best ids go on. Ties go by id; an id that occurs twice counts once, by its most
    similar vector. A vector's own id is left out unless ``itself``.
    """
    pack = "ids array<bigint>, data binary"
    left = queries.select("id", "v").filter(F.size("v") == size).mapInPandas(_pack_vectors, pack).withColumnsRenamed({"ids": "q_ids", "data": "q_data"})
    right = vectors.select("id", "v").filter(F.size("v") == size).mapInPandas(_pack_vectors, pack)
    # a stated query set against all rows, block by block
    blocks = right.join(left, F.lit(True)).mapInPandas(_best_of_blocks(k, size, itself), "query_id bigint, id bigint, similarity double")
    once = blocks.repartition("query_id").groupBy("query_id", "id").agg(F.max("similarity").alias("similarity"))
    best = once.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("less"), "id"))).alias("best"))
    found = best.select("query_id", F.posexplode(F.slice("best", 1, k)).alias("at", "b"))
    return found.select("query_id", (F.col("at") + 1).alias("rank"), F.col("b.id").alias("id"), (-F.col("b.less")).alias("similarity"))


# --- BM25 ------------------------------------------------------------------------------------------------------------


#: Folders that saved postings are divided into by term.
BUCKETS = 64


def _bucket(term: str | Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


@dataclass
class Bm25Index:
    """A corpus as terms (term, df, raw_idf, idf), its stats (n, avgdl) and either its words by text or its saved postings.

    ``idf`` is ln(N - df + 0.5) - ln(df + 0.5); negative ones are replaced by EPSILON times the mean over the vocabulary.
    """

    terms: DataFrame
    stats: DataFrame
    source: DataFrame | None = None
    postings: DataFrame | None = None
    mean_length: float | None = None

    @staticmethod
    def of(corpus: DataFrame, key: str, text: str = "text") -> Bm25Index:
        source = corpus.select(F.col(key).alias("id"), X.tokens(F.coalesce(F.col(text), F.lit(""))).alias("tokens"))
        stats = source.agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("avgdl"))
        df = source.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        raw = df.crossJoin(F.broadcast(stats.select("n"))).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))  # one row
        mean = raw.agg(F.avg("raw").alias("mean"))
        idf = F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw"))
        terms = raw.crossJoin(F.broadcast(mean)).select("term", "df", F.col("raw").alias("raw_idf"), idf.alias("idf"))  # one row
        return Bm25Index(terms, stats, source)

    def save(self, folder: str) -> None:
        """Writes postings and terms, divided by term, so that a search reads its words' folders only."""
        tf = self.source.select("id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).groupBy("id", "dl", "term").agg(F.count("*").alias("tf"))
        for rows, name in ((tf, "postings"), (self.terms, "terms")):
            rows.withColumn("bucket", _bucket("term")).repartition(BUCKETS, "bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{folder}/{name}")
        self.stats.write.mode("overwrite").parquet(f"{folder}/stats")

    @staticmethod
    def load(spark: SparkSession, folder: str) -> Bm25Index:
        terms, stats, postings = (spark.read.parquet(f"{folder}/{name}") for name in ("terms", "stats", "postings"))
        return Bm25Index(terms, stats, postings=postings)

    def scores(self, query: str) -> DataFrame:
        """id and score (6 digits) of the texts with any of the query's words; a word that the query has twice counts twice."""
        words = query.lower().split()
        times = {w: words.count(w) for w in words}
        gain = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
        if self.postings is not None:
            return self._saved_scores(times, gain)
        return self._fresh_scores(times)

    def _fresh_scores(self, times: dict[str, int]) -> DataFrame:
        """Scores without saved postings: one aggregate over the corpus for its size and the query's words, one scan for the texts.

        The vocabulary is counted only if a word's idf is negative and so needs its mean. Nothing is shuffled but sums.
        """
        words = list(times)
        if not words:
            return self.source.limit(0).select("id", F.lit(0.0).alias("score"))
        held = F.array_intersect("tokens", F.array(*map(F.lit, words)))
        found = self.source.select(F.size("tokens").alias("dl"), held.alias("held"))
        sums = [F.coalesce(F.sum(F.array_contains("held", w).cast("long")), F.lit(0)).alias(f"w{k}") for k, w in enumerate(words)]
        n, avgdl, *df = found.agg(F.count("*"), F.avg("dl"), *sums).first()
        raw = [math.log(n - d + 0.5) - math.log(d + 0.5) for d in df]
        low = EPSILON * self.terms.agg(F.avg("raw_idf")).first()[0] if any(d and r < 0 for d, r in zip(df, raw)) else 0.0
        weights = [F.struct(F.lit(w).alias("w"), F.lit(times[w] * (r if r >= 0 else low)).alias("x")) for w, d, r in zip(words, df, raw) if d]
        if not weights:
            return self.source.limit(0).select("id", F.lit(0.0).alias("score"))
        damp = K1 * (1 - B + B * F.size("tokens") / F.lit(float(avgdl or 1.0)))

        def gain(total: Column, word: Column) -> Column:
            tf = F.size(F.filter("mine", lambda t: t == word["w"]))
            return total + word["x"] * tf * (K1 + 1) / (tf + damp)

        mine = F.filter("tokens", lambda t: t.isin(words))
        rows = self.source.filter(F.arrays_overlap("tokens", F.array(*map(F.lit, words)))).withColumn("mine", mine)
        return rows.select("id", F.round(F.aggregate(F.array(*weights), F.lit(0.0), gain), 6).alias("score"))

    def _saved_scores(self, times: dict[str, int], gain: Column) -> DataFrame:
        """Scores from saved postings: the few words' weights are read first, then their postings, in their folders only."""
        import xxhash

        buckets = sorted({(h - (1 << 64) if h >> 63 else h) % BUCKETS for h in (xxhash.xxh64_intdigest(w.encode(), seed=42) for w in times)})
        mine = F.col("bucket").isin(buckets) & F.col("term").isin(list(times))
        weight = {r["term"]: r["idf"] * times[r["term"]] for r in self.terms.filter(mine).select("term", "idf").collect()}
        if self.mean_length is None:
            self.mean_length = self.stats.first()["avgdl"] or 0.0
        rows = self.postings.filter(mine).withColumn("avgdl", F.lit(self.mean_length))
        of = F.create_map(*[F.lit(x) for kv in weight.items() for x in kv])[F.col("term")] if weight else F.lit(0.0)
        return rows.groupBy("id").agg(F.round(F.sum(of * gain), 6).alias("score"))


def bm25_search(index: Bm25Index, query: str, k: int) -> DataFrame:
    """rank, id and score of the k best texts, those with a positive score. A blank query finds nothing."""
    return ranked(index.scores(query), k, [F.desc("score"), F.asc("id")]).filter("score > 0")


# --- fusion, re-ranking, diversity -----------------------------------------------------------------------------------


def fuse(vector: DataFrame, keyword: DataFrame, alpha: float = 0.7, by: list[str] | None = None) -> DataFrame:
    """id and fused score of the union of both sides' hits (id, score).

    Each side is scaled to [0, 1] over its own hits (all equal: 0), a missing side counts 0, and the sum is weighted
    alpha : 1 - alpha. ``by`` fuses several searches at once.
    """
    by = by or []

    def scaled(side: DataFrame, name: str) -> DataFrame:
        every = W.partitionBy(*by) if by else W.partitionBy()
        return side.select(*by, "id", X.min_max(F.col("score"), F.min("score").over(every), F.max("score").over(every)).alias(name))

    both = scaled(vector, "v").join(scaled(keyword, "b"), [*by, "id"], "full_outer")
    return both.select(*by, "id", F.round(alpha * F.coalesce("v", F.lit(0.0)) + (1 - alpha) * F.coalesce("b", F.lit(0.0)), 6).alias("score"))


def lexical_logit(query: str, text: Column) -> Column:
    """A stand-in for a cross-encoder: 6 times the share of the query's different words that the text has, less 3."""
    words = list(dict.fromkeys(query.lower().split())) or [""]
    found = F.size(F.array_intersect(X.tokens(text), F.array(*map(F.lit, words))))
    return 6.0 * found / len(words) - 3.0


def rerank(hits: DataFrame, query: str, text: str = "text", scorer: Callable[[str, Column], Column] = lexical_logit) -> DataFrame:
    """``hits`` with score replaced by the sigmoid of the scorer's logit (6 digits). A scorer may be a pandas UDF with a model."""
    return hits.withColumn("score", F.round(X.sigmoid(scorer(query, F.col(text))), 6))


def select_diverse(query: np.ndarray, vectors: np.ndarray, k: int, lam: float) -> list[int]:
    """Greedy maximal marginal relevance: positions in order of selection; all of them, in order, if there are no more than k."""
    n = len(vectors)
    if n <= k:
        return list(range(n))
    unit = vectors / (np.linalg.norm(vectors, axis=1, keepdims=True) + 1e-10)
    relevance = unit @ (query / (np.linalg.norm(query) + 1e-10))
    nearest = np.zeros(n)
    left = np.ones(n, dtype=bool)
    out: list[int] = []
    while len(out) < k:
        value = np.where(left, lam * relevance - (1 - lam) * (nearest if out else 0.0), -np.inf)
        j = int(value.argmax())
        out.append(j)
        left[j] = False
        nearest = np.maximum(nearest, unit @ unit[j]) if len(out) > 1 else unit @ unit[j]
    return out


def mmr(hits: DataFrame, query: list[float], k: int, lam: float = 0.7, by: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """The k hits (id, rank, v) of each search that greedy maximal marginal relevance selects, with ``selected`` from 1.

    If any hit lacks a usable vector, the first k in order come out instead. A search's hits are the few it fetched, so
    one group is small by construction.
    """
    by, q = by or [], np.asarray(query, dtype=np.float64)
    schema = ", ".join([*(f"`{c}` {dict(hits.dtypes)[c]}" for c in by), "id string", "selected int"])

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order or ["rank"], kind="stable")
        x = [np.asarray([] if v is None else v, dtype=np.float64) for v in part["v"]]
        whole = all(v.shape == q.shape and np.isfinite(v).all() for v in x)
        pick = select_diverse(q, np.array(x), k, lam) if whole else list(range(min(k, len(part))))
        out = part.iloc[pick][[*by, "id"]].copy()
        out["selected"] = np.arange(1, len(pick) + 1, dtype=np.int32)
        return out

    grouped = hits.groupBy(*by) if by else hits.withColumn("_all", F.lit(True)).groupBy("_all")
    return grouped.applyInPandas(run, schema)


@dataclass
class SearchSettings:
    """Switches and numbers of a search."""

    top_k: int = 5
    hybrid: bool = True
    alpha: float = 0.7
    reranking: bool = True
    diversity: bool = True
    lam: float = 0.7
    min_score_threshold: float = 0.15
    min_score: float | None = None
    scorer: Callable[[str, Column], Column] = field(default=lexical_logit)

    @property
    def fetch_k(self) -> int:
        return max(4 * self.top_k, 20)


def search(chunks: DataFrame, query: str, vector: list[float], settings: SearchSettings | None = None, index: Bm25Index | None = None, took: dict[str, float] | None = None) -> DataFrame:
    """rank, chunk_id, source_file, chunk_index, score and text of the best chunks for a query.

    Vector search over fetches max(4 k, 20) chunks and drops those under the threshold; with no vector hits the result is
    empty. BM25 hits are fused in, the fetch_k best kept and re-ranked, k of them selected for diversity (in order of
    selection; the k best where diversity is off or a vector is missing), and the final score cut at min_score. ``took`` is
    told the milliseconds of the stages that run at once; what follows them runs with the result's plan.
    """
    s = settings or SearchSettings()
    spark = chunks.sparkSession
    clock = time.time()

    def lap(name: str) -> None:
        nonlocal clock
        if took is not None:
            took[name] = 1000 * (time.time() - clock)
        clock = time.time()

    def few(rows: list) -> DataFrame:
        """At most fetch_k rows, as a table of one partition, on which nothing is shuffled."""
        ids, scores = zip(*rows) if rows else ((), ())
        return spark.createDataFrame(pa.table({"id": pa.array(ids, pa.string()), "score": pa.array(scores, pa.float64())})).coalesce(1)

    near = vector_search(chunks, vector, s.fetch_k, min_score=s.min_score_threshold).select("id", "similarity").collect()
    lap("vector_search_ms")
    found, words = few(near), []
    if s.hybrid and near:
        index = index or Bm25Index.of(chunks.dropDuplicates(["chunk_id"]), "chunk_id")
        words = bm25_search(index, query, s.fetch_k).select("id", "score").collect()
        lap("bm25_ms")
        found = fuse(found, few(words), s.alpha).orderBy(F.desc("score"), F.asc("id")).limit(s.fetch_k)
    columns = ["source_file", "chunk_index", "text", "embedding"]
    # the ids, at most twice fetch_k, go down to the scan; of rows with one id the greatest counts, those with a vector first
    ids = sorted({r["id"] for r in [*near, *words]})
    rows = chunks.filter(F.col("chunk_id").isin(ids)).select(F.col("chunk_id").cast("string").alias("id"), *columns).repartition(1)
    best = F.max(F.struct(F.col("embedding").isNotNull().alias("has"), *columns)).alias("best")
    hits = rows.groupBy("id").agg(best).select("id", *(F.col(f"best.{c}").alias(c) for c in columns)).join(found, "id").withColumnRenamed("embedding", "v")
    if s.reranking:
        hits = rerank(hits, query, "text", s.scorer)
    hits = ranked(hits, s.fetch_k, [F.desc("score"), F.asc("id")])
    if s.diversity:
        chosen = mmr(hits, vector, s.top_k, s.lam)
        hits = hits.join(chosen, "id").withColumn("rank", F.col("selected"))
    else:
        hits = hits.filter(F.col("rank") <= s.top_k)
    least = s.min_score if s.min_score is not None else s.min_score_threshold
    if least > 0:
        hits = hits.filter(F.col("score") >= least)
    return hits.select("rank", F.col("id").alias("chunk_id"), "source_file", "chunk_index", F.round("score", 4).alias("score"), "text")
