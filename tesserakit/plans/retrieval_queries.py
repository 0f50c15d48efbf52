"""Queries of the search operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import retrieval as R
from ..spark_util import table

TEXT = "temporary index of the scanner"
SIZE = 96


def _bm25(spark: SparkSession, sf_dir: str) -> R.Bm25Index:
    return R.Bm25Index.of(table(spark, sf_dir, "documents"), "doc_id")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunks")


def _query_vector(chunks: DataFrame) -> list[float]:
    """The vector of the first chunk that has one."""
    rows = chunks.filter(F.size("embedding") == SIZE).select("chunk_id", "embedding")
    return [float(x) for x in rows.agg(F.min_by("embedding", "chunk_id")).first()[0] or [1.0] * SIZE]


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.bm25_search(_bm25(spark, sf_dir), TEXT, 20)
    return found.select("rank", F.col("id").alias("doc_id"), "score")


def bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir).scores(TEXT).select(F.col("id").alias("doc_id"), "score")


def bm25_term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir).terms.select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_negative_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir).terms.filter("raw_idf < 0").select("term", "df", F.round("raw_idf", 6).alias("raw_idf"), F.round("idf", 6).alias("idf"))


def bm25_chunk_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of more than half of the chunks, whose idf would be negative."""
    terms = R.Bm25Index.of(_chunks(spark, sf_dir).dropDuplicates(["chunk_id"]), "chunk_id").terms
    return terms.filter("raw_idf < 0").select("term", "df", F.round("raw_idf", 6).alias("raw_idf"), F.round("idf", 6).alias("idf"))


def bm25_common_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of a query with words that most chunks have."""
    index = R.Bm25Index.of(_chunks(spark, sf_dir).dropDuplicates(["chunk_id"]), "chunk_id")
    return index.scores("Title: the index the").select(F.col("id").alias("chunk_id"), "score")


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir)
    return R.vector_search(chunks, _query_vector(chunks), 20).select("rank", F.col("id").alias("chunk_id"), "similarity")


def vector_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir)
    return R.vector_search(chunks, _query_vector(chunks), 50, min_score=0.6).select("rank", F.col("id").alias("chunk_id"), "similarity")


def vector_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir)
    found = R.vector_search(chunks, _query_vector(chunks), 20, where=X.map_get("metadata", "format") == "markdown")
    return found.select("rank", F.col("id").alias("chunk_id"), "similarity")


def vector_topk_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return R.vector_search_many(rows, rows.filter("id % 20 = 0"), 5, 64)


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    chunks = _chunks(spark, sf_dir)
    vectors = R.vector_search(chunks, _query_vector(chunks), 40).select("id", F.col("similarity").alias("score"))
    words = R.bm25_search(R.Bm25Index.of(chunks.dropDuplicates(["chunk_id"]), "chunk_id"), TEXT, 40).select("id", "score")
    return vectors, words


def hybrid_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fuse(*_sides(spark, sf_dir), 0.7).select(F.col("id").alias("chunk_id"), "score")


def hybrid_fuse_keywords_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fuse(*_sides(spark, sf_dir), 0.0).select(F.col("id").alias("chunk_id"), "score")


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pipeline without diversity."""
    chunks = _chunks(spark, sf_dir)
    found = R.search(chunks, TEXT, _query_vector(chunks), R.SearchSettings(top_k=10, diversity=False))
    return found.select("rank", "chunk_id", "source_file", "chunk_index", "score")


def search_diverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pipeline."""
    chunks = _chunks(spark, sf_dir)
    return R.search(chunks, TEXT, _query_vector(chunks), R.SearchSettings(top_k=10))


def mmr_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five diverse hits of each search."""
    hits = table(spark, sf_dir, "hits").filter(F.size("embedding") == SIZE).dropDuplicates(["query_id", "rank"])
    hits = hits.select("query_id", "rank", F.col("chunk_id").alias("id"), F.col("embedding").alias("v"))
    return R.mmr(hits, _query_vector(_chunks(spark, sf_dir)), 5, by=["query_id"])


def rerank_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "hits").filter("text is not null").select("query_id", "rank", "text").distinct()
    return R.rerank(hits, TEXT).select("query_id", "rank", "score")


def score_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "hits").select("query_id", "rank", "chunk_id", "score").distinct()
    return hits.withColumn("band", X.band("score")).groupBy("band").agg(F.count("*").alias("hits"))


def hits_over_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "hits").select("query_id", "rank", "chunk_id", F.round("score", 4).alias("score")).distinct()
    return hits.filter("score >= 0.5")


def hits_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores scaled within each search."""
    hits = table(spark, sf_dir, "hits").select("query_id", "rank", "score").filter("score is not null").distinct()
    w = W.partitionBy("query_id")
    return hits.select("query_id", "rank", F.round(X.min_max(F.col("score"), F.min("score").over(w), F.max("score").over(w)), 6).alias("scaled"))


def hits_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each search's hits ranked anew by score."""
    hits = table(spark, sf_dir, "hits").select("query_id", F.col("rank").alias("was"), "score").filter("score is not null").distinct()
    order = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("was"))
    return hits.select("query_id", "was", F.row_number().over(order).alias("rank"))


def hit_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "hits").groupBy("query_id")
    return hits.agg(F.round(F.coalesce(F.max("score"), F.lit(0.0)), 6).alias("top_score"), F.round(F.coalesce(F.min("score"), F.lit(0.0)), 6).alias("min_score"))


def hit_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits without a vector that the store has one for."""
    hits = table(spark, sf_dir, "hits").filter("embedding is null").select("query_id", "rank", "chunk_id").distinct()
    store = _chunks(spark, sf_dir).filter("embedding is not null").select("chunk_id").distinct()
    return hits.join(store, "chunk_id").select("query_id", "rank", "chunk_id")


def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(X.norm("embedding"), 5).alias("norm"))


def sigmoid_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "hits").select("query_id", "rank", "score").filter("score is not null").distinct()
    return hits.select("query_id", "rank", F.round(X.sigmoid("score"), 6).alias("p"))


QUERIES = {
    f.__name__: f
    for f in (
        bm25_topk,
        bm25_scores,
        bm25_term_stats,
        bm25_negative_idf,
        bm25_chunk_idf,
        bm25_common_words,
        vector_topk,
        vector_threshold,
        vector_filtered,
        vector_topk_many,
        hybrid_fuse,
        hybrid_fuse_keywords_only,
        hybrid_search,
        search_diverse,
        mmr_select,
        rerank_hits,
        score_bands,
        hits_over_threshold,
        hits_scaled,
        hits_ranked,
        hit_extremes,
        hit_backfill,
        vector_norms,
        sigmoid_scores,
    )
}

_WORDS = "'temporary', 'index', 'of', 'the', 'scanner'"


def _bm25_sql(table_: str, key: str, name: str = "") -> str:
    return f"""
words{name} AS (SELECT {key} AS id, list_filter(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda t: t <> '') AS toks FROM {table_}),
sizes{name} AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM words{name}),
df{name} AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(toks)) AS term FROM words{name}) GROUP BY term),
raw{name} AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw_idf FROM df{name}, sizes{name}),
idf{name} AS (SELECT term, df, raw_idf, CASE WHEN raw_idf < 0 THEN 0.25 * (SELECT avg(raw_idf) FROM raw{name}) ELSE raw_idf END AS idf FROM raw{name}),
tf{name} AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(toks) AS dl, unnest(toks) AS term FROM words{name}) WHERE term IN ({_WORDS}) GROUP BY ALL),
scores{name} AS (SELECT id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM tf{name} JOIN idf{name} USING (term), sizes{name} GROUP BY id)
"""


_VECTORS = """
v AS (SELECT DISTINCT chunk_id AS id, CAST(embedding AS DOUBLE[]) AS e, metadata['format'] AS format FROM chunks WHERE len(embedding) = 96),
q AS (SELECT e AS qe FROM v ORDER BY id LIMIT 1),
sims AS (SELECT DISTINCT id, format, round(list_cosine_similarity(e, qe), 4) AS similarity FROM v, q)
"""
_ONE = "(SELECT DISTINCT chunk_id, text FROM chunks)"


def _side_sql(k: int, least: str) -> str:
    return f"""
vec AS (SELECT id, similarity AS score FROM sims {least} ORDER BY similarity DESC, id LIMIT {k}),
kw AS (SELECT * FROM (SELECT id, score FROM scores ORDER BY score DESC, id LIMIT {k}) WHERE score > 0),
vn AS (SELECT id, (score - min(score) OVER ()) / CASE WHEN max(score) OVER () = min(score) OVER () THEN 1 ELSE max(score) OVER () - min(score) OVER () END AS v FROM vec),
kn AS (SELECT id, (score - min(score) OVER ()) / CASE WHEN max(score) OVER () = min(score) OVER () THEN 1 ELSE max(score) OVER () - min(score) OVER () END AS b FROM kw),
fused AS (SELECT coalesce(vn.id, kn.id) AS id, coalesce(v, 0) AS v, coalesce(b, 0) AS b FROM vn FULL JOIN kn ON vn.id = kn.id)
"""


def _greedy(rows: str, by: str, k: int) -> str:
    """Greedy selection among rows (r, e, picks) per ``by``: chosen (r, turn). Each step holds, of every row, how near the chosen ones come and when it was chosen."""
    key, same = (f"{by}, ", f"AND a.{by} = b.{by}") if by else ("", "")
    part = f"PARTITION BY {by} " if by else ""
    back = f"AND n.{by} = {{0}}.{by}" if by else ""
    return f"""
near AS (SELECT {"a." + key if by else ""}a.r AS x, b.r AS y, list_dot_product(a.e, b.e) / ((sqrt(list_dot_product(a.e, a.e)) + 1e-10) * (sqrt(list_dot_product(b.e, b.e)) + 1e-10)) AS s FROM {rows} a JOIN {rows} b ON a.picks AND b.picks {same}),
rel AS (SELECT {key}r, list_dot_product(e, qe) / ((sqrt(list_dot_product(e, e)) + 1e-10) * (sqrt(list_dot_product(qe, qe)) + 1e-10)) AS rel FROM {rows}, q WHERE picks),
steps AS (
  SELECT 0 AS step, {key}r, rel, CAST(0 AS DOUBLE) AS nearest, CAST(NULL AS INTEGER) AS turn FROM rel
  UNION ALL
  SELECT step + 1, {"w." + key if by else ""}r, rel, CASE WHEN step = 0 THEN s ELSE greatest(nearest, s) END, CASE WHEN r = pick THEN step + 1 ELSE turn END
  FROM (SELECT *, first_value(r) OVER ({part}ORDER BY turn IS NOT NULL, 0.7 * rel - 0.3 * nearest DESC, r) AS pick FROM steps WHERE step < {k}) w JOIN near n ON n.x = pick AND n.y = r {back.format("w")}),
chosen AS (SELECT {key}r, turn FROM steps WHERE step = {k} AND turn IS NOT NULL)
"""


SQL = {
    "bm25_topk": "WITH " + _bm25_sql("documents", "doc_id") + "SELECT CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank, id AS doc_id, score FROM (SELECT * FROM scores ORDER BY score DESC, id LIMIT 20) WHERE score > 0",
    "bm25_scores": "WITH " + _bm25_sql("documents", "doc_id") + "SELECT id AS doc_id, score FROM scores",
    "bm25_term_stats": "WITH " + _bm25_sql("documents", "doc_id") + "SELECT term, df, round(idf, 6) AS idf FROM idf",
    "bm25_negative_idf": "WITH " + _bm25_sql("documents", "doc_id") + "SELECT term, df, round(raw_idf, 6) AS raw_idf, round(idf, 6) AS idf FROM idf WHERE raw_idf < 0",
    "bm25_chunk_idf": "WITH " + _bm25_sql(_ONE, "chunk_id") + "SELECT term, df, round(raw_idf, 6) AS raw_idf, round(idf, 6) AS idf FROM idf WHERE raw_idf < 0",
    "bm25_common_words": "WITH " + _bm25_sql(_ONE, "chunk_id").replace(_WORDS, "'title:', 'the', 'index'") + """,
asked AS (SELECT * FROM (VALUES ('title:', 1), ('the', 2), ('index', 1)) AS a(term, times))
SELECT id AS chunk_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM tf JOIN idf USING (term) JOIN asked USING (term), sizes GROUP BY id
""",
    "vector_topk": "WITH " + _VECTORS + "SELECT CAST(row_number() OVER (ORDER BY similarity DESC, id) AS INTEGER) AS rank, id AS chunk_id, similarity FROM sims ORDER BY 1 LIMIT 20",
    "vector_threshold": "WITH " + _VECTORS + "SELECT CAST(row_number() OVER (ORDER BY similarity DESC, id) AS INTEGER) AS rank, id AS chunk_id, similarity FROM sims WHERE similarity >= 0.6 ORDER BY 1 LIMIT 50",
    "vector_filtered": "WITH " + _VECTORS + "SELECT CAST(row_number() OVER (ORDER BY similarity DESC, id) AS INTEGER) AS rank, id AS chunk_id, similarity FROM sims WHERE format = 'markdown' ORDER BY 1 LIMIT 20",
    "vector_topk_many": """
WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT a.id AS query_id, b.id AS id, round(list_cosine_similarity(a.e, b.e), 6) AS similarity FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, id, similarity FROM r WHERE rank <= 5
""",
    "hybrid_fuse": "WITH " + _VECTORS + "," + _bm25_sql(_ONE, "chunk_id") + "," + _side_sql(40, "") + "SELECT id AS chunk_id, round(0.7 * v + 0.3 * b, 6) AS score FROM fused",
    "hybrid_fuse_keywords_only": "WITH " + _VECTORS + "," + _bm25_sql(_ONE, "chunk_id") + "," + _side_sql(40, "") + "SELECT id AS chunk_id, round(b, 6) AS score FROM fused",
    "hybrid_search": "WITH " + _VECTORS + "," + _bm25_sql(_ONE, "chunk_id") + "," + _side_sql(40, "WHERE similarity >= 0.15") + f""",
best AS (SELECT id FROM fused ORDER BY round(0.7 * v + 0.3 * b, 6) DESC, id LIMIT 40),
again AS (SELECT DISTINCT id, source_file, chunk_index, round(1 / (1 + exp(-(6.0 * len(list_intersect(list_filter(string_split_regex(lower(text), '\\s+'), lambda t: t <> ''), [{_WORDS}])) / 5 - 3))), 6) AS score
          FROM best JOIN chunks ON chunk_id = id),
top AS (SELECT CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank, * FROM again)
SELECT rank, id AS chunk_id, source_file, chunk_index, round(score, 4) AS score FROM top WHERE rank <= 10 AND score >= 0.15
""",
    "search_diverse": "WITH RECURSIVE " + _VECTORS + "," + _bm25_sql(_ONE, "chunk_id") + "," + _side_sql(40, "WHERE similarity >= 0.15") + f""",
best AS (SELECT id FROM fused ORDER BY round(0.7 * v + 0.3 * b, 6) DESC, id LIMIT 40),
again AS (SELECT chunk_id AS id, text, source_file, chunk_index, max(CAST(embedding AS DOUBLE[])) AS e,
          round(1 / (1 + exp(-(6.0 * len(list_intersect(list_filter(string_split_regex(lower(text), '\\s+'), lambda t: t <> ''), [{_WORDS}])) / 5 - 3))), 6) AS score
          FROM best JOIN chunks ON chunk_id = id GROUP BY ALL),
cand AS (SELECT row_number() OVER (ORDER BY score DESC, id) AS r, again.*, count(*) OVER () > 10 AND bool_and(coalesce(len(e), 0) = 96) OVER () AS picks FROM again),
"""
    + _greedy("cand", "", 10)
    + """
SELECT CAST(selected AS INTEGER) AS rank, id AS chunk_id, source_file, chunk_index, round(score, 4) AS score, text
FROM (SELECT cand.*, CASE WHEN picks THEN s.turn ELSE cand.r END AS selected FROM cand LEFT JOIN chosen s ON s.r = cand.r) WHERE selected <= 10 AND score >= 0.15
""",
    "mmr_select": "WITH RECURSIVE " + _VECTORS + """,
cand AS (SELECT row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r, query_id, chunk_id AS id, CAST(e0 AS DOUBLE[]) AS e, count(*) OVER (PARTITION BY query_id) > 5 AS picks
         FROM (SELECT query_id, rank, chunk_id, any_value(embedding) AS e0 FROM hits WHERE len(embedding) = 96 GROUP BY 1, 2, 3)),
"""
    + _greedy("cand", "query_id", 5)
    + "SELECT cand.query_id, id, CAST(CASE WHEN picks THEN s.turn ELSE cand.r END AS INTEGER) AS selected FROM cand LEFT JOIN chosen s ON s.r = cand.r AND s.query_id = cand.query_id WHERE NOT picks OR s.turn IS NOT NULL",
    "rerank_hits": f"""
SELECT query_id, rank, round(1 / (1 + exp(-(6.0 * len(list_intersect(list_filter(string_split_regex(lower(text), '\\s+'), lambda t: t <> ''), [{_WORDS}])) / 5 - 3))), 6) AS score
FROM (SELECT DISTINCT query_id, rank, text FROM hits WHERE text IS NOT NULL)
""",
    "score_bands": "SELECT CASE WHEN score >= 0.6 THEN 'high' WHEN score >= 0.35 THEN 'mid' WHEN score IS NOT NULL THEN 'low' END AS band, count(*) AS hits FROM (SELECT DISTINCT query_id, rank, chunk_id, score FROM hits) GROUP BY 1",
    "hits_over_threshold": "SELECT DISTINCT query_id, rank, chunk_id, round(score, 4) AS score FROM hits WHERE round(score, 4) >= 0.5",
    "hits_scaled": """
SELECT query_id, rank, round((score - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END, 6) AS scaled
FROM (SELECT *, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM (SELECT DISTINCT query_id, rank, score FROM hits WHERE score IS NOT NULL))
""",
    "hits_ranked": "SELECT query_id, rank AS was, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS INTEGER) AS rank FROM (SELECT DISTINCT query_id, rank, score FROM hits WHERE score IS NOT NULL)",
    "hit_extremes": "SELECT query_id, round(coalesce(max(score), 0), 6) AS top_score, round(coalesce(min(score), 0), 6) AS min_score FROM hits GROUP BY 1",
    "hit_backfill": "SELECT DISTINCT query_id, rank, chunk_id FROM hits WHERE embedding IS NULL AND chunk_id IN (SELECT chunk_id FROM chunks WHERE embedding IS NOT NULL)",
    "vector_norms": "SELECT vec_id, round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 5) AS norm FROM embeddings",
    "sigmoid_scores": "SELECT query_id, rank, round(1 / (1 + exp(-score)), 6) AS p FROM (SELECT DISTINCT query_id, rank, score FROM hits WHERE score IS NOT NULL)",
}
