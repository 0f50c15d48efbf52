import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from tesserakit.functions import text as X
from tesserakit.operators import retrieval as R

DOCS = [(1, "the cat sat"), (2, "the dog and the cat"), (3, "a bird"), (4, None), (5, ""), (6, "the the the end")]


def by_hand(docs, query):
    toks = {i: (t or "").lower().split() for i, t in docs}
    n, avgdl = len(toks), sum(map(len, toks.values())) / len(toks)
    df = Counter(w for t in toks.values() for w in set(t))
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: 0.25 * mean if v < 0 else v for w, v in idf.items()}
    out = {}
    for i, t in toks.items():
        s = [idf[w] * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avgdl)) for w in query.lower().split() if w in t]
        if s:
            out[i] = round(sum(s), 6)
    return out


def test_bm25(spark):
    index = R.Bm25Index.of(spark.createDataFrame(DOCS, "id int, text string"), "id")
    for query in ("cat", "The the cat", "bird end"):
        assert {r["id"]: r["score"] for r in index.scores(query).collect()} == by_hand(DOCS, query)
    assert R.bm25_search(index, "   ", 5).count() == 0 and R.bm25_search(index, "zebra", 5).count() == 0


def test_saved_index_equals_the_live_one(spark, tmp_path):
    live = R.Bm25Index.of(spark.createDataFrame(DOCS, "id int, text string"), "id")
    live.save(str(tmp_path / "i"))
    saved = R.Bm25Index.load(spark, str(tmp_path / "i"))
    for query in ("cat", "The the cat", "zebra", ""):
        assert {r["id"]: r["score"] for r in saved.scores(query).collect()} == by_hand(DOCS, query)


def test_bm25_empty_corpus(spark):
    index = R.Bm25Index.of(spark.createDataFrame([], "id int, text string"), "id")
    assert R.bm25_search(index, "cat", 5).count() == 0


def test_vector_search_edges(spark):
    rows = [("a", [1.0, 0.0]), ("a", [1.0, 0.0]), ("b", [2.0, 0.0]), ("c", [0.0, 0.0]), ("d", None), ("e", [1.0]), ("f", [0.0, 3.0]), ("g", [None, 1.0])]
    chunks = spark.createDataFrame(rows, "chunk_id string, embedding array<float>").withColumn("similarity", F.lit("clash"))
    assert [(r["rank"], r["id"], r["similarity"]) for r in R.vector_search(chunks, [1.0, 0.0], 5).orderBy("rank").collect()] == [(1, "a", 1.0), (2, "b", 1.0), (3, "f", 0.0)]
    assert [r["id"] for r in R.vector_search(chunks, [1.0, 0.0], 5, min_score=0.5).orderBy("rank").collect()] == ["a", "b"]
    assert R.vector_search(chunks.limit(0), [1.0, 0.0], 5).count() == 0


def test_copies_leave_room_for_other_ids(spark):
    rows = [("a", [1.0, 0.0])] * 3000 + [(f"b{i}", [1.0, 0.1 * i]) for i in range(1, 6)]
    for part in (rows, rows[::-1]):
        chunks = spark.createDataFrame(part, "chunk_id string, embedding array<float>").coalesce(1)
        assert [r["id"] for r in R.vector_search(chunks, [1.0, 0.0], 4).orderBy("rank").collect()] == ["a", "b1", "b2", "b3"]


def test_fuse(spark):
    v = spark.createDataFrame([("a", 0.9), ("b", 0.5)], "id string, score double")
    k = spark.createDataFrame([("b", 4.0), ("c", 2.0)], "id string, score double")
    assert {r["id"]: r["score"] for r in R.fuse(v, k, 0.7).collect()} == {"a": 0.7, "b": 0.3, "c": 0.0}
    assert {r["id"]: r["score"] for r in R.fuse(v.limit(1), k.limit(0), 0.7).collect()} == {"a": 0.0}
    assert R.fuse(v.limit(0), k.limit(0)).count() == 0


def test_mmr_limits():
    rng = np.random.default_rng(42)
    x, q = rng.normal(size=(12, 4)), rng.normal(size=4)
    cos = x @ q / np.linalg.norm(x, axis=1)
    assert R.select_diverse(q, x, 5, 1.0) == list(np.argsort(-cos)[:5])
    assert R.select_diverse(q, x[:3], 5, 0.3) == [0, 1, 2]
    same = np.ones((6, 4))
    assert R.select_diverse(q, same, 3, 0.7) == [0, 1, 2] and R.select_diverse(q, x[:0], 3, 0.7) == []


def test_mmr_by_hand():
    rng = np.random.default_rng(3)
    x, q, lam = rng.normal(size=(20, 6)), rng.normal(size=6), 0.6
    u, v = x / np.linalg.norm(x, axis=1, keepdims=True), q / np.linalg.norm(q)
    picked = []
    for _ in range(6):
        value = {i: lam * float(u[i] @ v) - (1 - lam) * max((float(u[i] @ u[j]) for j in picked), default=0.0) for i in range(20) if i not in picked}
        picked.append(max(value, key=value.get))
    assert R.select_diverse(q, x, 6, lam) == picked


def test_search_needs_vector_hits(spark):
    rows = [("f::chunk_0", "f", 0, "alpha beta", [0.0, 1.0]), ("f::chunk_1", "f", 1, "gamma", [0.1, 1.0])]
    chunks = spark.createDataFrame(rows, "chunk_id string, source_file string, chunk_index int, text string, embedding array<float>")
    assert R.search(chunks, "alpha", [1.0, 0.0], R.SearchSettings(min_score_threshold=0.5)).count() == 0
    found = R.search(chunks, "alpha", [0.0, 1.0], R.SearchSettings(top_k=1)).collect()
    assert [(r["rank"], r["chunk_id"]) for r in found] == [(1, "f::chunk_0")]


def test_diverse_search_keeps_hits_without_vector(spark):
    rows = [("f::chunk_0", "f", 0, "alpha beta", None), *((f"f::chunk_{i}", "f", i, "gamma", [0.1 * i, 1.0]) for i in range(1, 5))]
    chunks = spark.createDataFrame(rows, "chunk_id string, source_file string, chunk_index int, text string, embedding array<double>")
    settings = R.SearchSettings(top_k=2, min_score=0.0)
    found = R.search(chunks, "alpha", [0.0, 1.0], settings).orderBy("rank").collect()
    assert [(r["rank"], r["chunk_id"]) for r in found] == [(1, "f::chunk_0"), (2, "f::chunk_1")]
    found = R.search(chunks.filter("chunk_index > 0"), "alpha", [0.0, 1.0], settings).orderBy("rank").collect()
    assert [(r["rank"], r["chunk_id"]) for r in found] == [(1, "f::chunk_1"), (2, "f::chunk_2")]


def test_tokens_like_split(spark):
    odd = "a\x1fb\u00a0c\u3000d  \t\n e\x85f \u2028G"
    got = spark.createDataFrame([(odd,), ("",), (None,)], "t string").select(X.tokens("t").alias("t")).collect()
    assert got[0][0] == odd.lower().split() and got[1][0] == [] and got[2][0] is None


def test_vector_many(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 8)).astype(np.float32)
    rows = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id bigint, v array<float>")
    got = R.vector_search_many(rows, rows.filter("id % 10 = 0"), 3, 8).collect()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    for q in range(0, 50, 10):
        s = u @ u[q]
        s[q] = -9
        assert [r["id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == list(np.argsort(-s)[:3])


def test_vector_many_ties_and_copies(spark):
    east, north = [1.0, 0.0], [0.0, 1.0]
    ties = [(0, east)] + [(i, east) for i in range(400, 0, -1)] + [(i, north) for i in range(401, 500)]
    copies = [(0, east)] + [(7, east)] * 100 + [(9, [1.0, 0.1]), (8, [1.0, 0.2]), (7, north)]
    for data, wanted in ((ties, [1, 2, 3]), (copies, [7, 9, 8])):
        for parts in (1, 3):
            rows = spark.createDataFrame(data, "id bigint, v array<float>").repartition(parts)
            got = R.vector_search_many(rows, rows.filter("id = 0"), 3, 2).orderBy("rank").collect()
            assert [(r["rank"], r["id"]) for r in got] == list(enumerate(wanted, 1))
