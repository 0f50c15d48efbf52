import numpy as np
from pyspark.sql import functions as F
from tesserakit.llm import neighbours as N


def clustered(n, d=24, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n // 10, d))[rng.integers(0, n // 10, n)] + 0.4 * rng.normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def brute(x, k):
    s = x @ x.T
    np.fill_diagonal(s, -9)
    return np.argsort(-s, axis=1, kind="stable")[:, :k]


def test_graph_recall():
    x = clustered(3000)
    g = N.SmallWorld(x)
    ids, sims = g.search(x[:500], 6)
    want = brute(x, 5)[:500]
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(want.tolist(), ids.tolist())]) > 0.95
    assert (np.diff(sims, axis=1) <= 1e-6).all()
    known, _ = g.search(x[:500], 6, known=np.arange(500))
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(want.tolist(), known.tolist())]) > 0.95
    assert all(t.dtype == np.int32 and t.max() < 3000 for t in g.near)


def test_graph_of_few():
    for n in (0, 1, 2, 5):
        g = N.SmallWorld(clustered(20)[:n])
        ids, _ = g.search(clustered(20)[:n], 3)
        assert ids.shape == (n, 3) and all(len(set(r[r >= 0])) == min(3, n) for r in ids)


def frame(spark, x):
    return spark.createDataFrame([(f"k{i:05d}", [float(a) for a in v]) for i, v in enumerate(x)], "chunk_id string, embedding array<float>")


def recall(spark, x, k=5):
    got = N.nearest_neighbours(N.usable_vectors(frame(spark, x), size=x.shape[1]), k, size=x.shape[1]).collect()
    own = {}
    for r in got:
        own.setdefault(int(r["key"][1:]), set()).add(int(r["neighbour"][1:]))
    return np.mean([len(own.get(i, set()) & set(w)) / k for i, w in enumerate(brute(x.astype(np.float32).astype(float), k).tolist())])


def test_shards(spark, monkeypatch):
    monkeypatch.setattr(N, "CELL", 300)
    assert recall(spark, clustered(3000)) > 0.95


def test_hot_cell_is_cut(spark, monkeypatch):
    monkeypatch.setattr(N, "CELL", 300)
    monkeypatch.setattr(N, "LARGEST", 400)
    x = clustered(2000)
    x[:900] = x[0] + 0.05 * np.random.default_rng(1).normal(size=(900, x.shape[1]))
    assert recall(spark, x / np.linalg.norm(x, axis=1, keepdims=True)) > 0.95


def test_edges(spark):
    rows = [("a", [1.0, 0.0]), ("a", [2.0, 0.0]), ("b", [1.0, 0.1]), ("zero", [0.0, 0.0]), ("short", [1.0]), ("null", None), ("nan", [float("nan"), 1.0]), ("inf", [float("inf"), 1.0]), ("hole", [None, 1.0]), (None, [1.0, 1.0]), ("c", [-1.0, 0.0])]
    hits = spark.createDataFrame(rows, "chunk_id string, embedding array<float>").withColumn("vector", F.lit("clash"))
    got = N.nearest_neighbours(N.usable_vectors(hits, size=2), 5, size=2).collect()
    assert {(r["key"], r["rank"], r["neighbour"]) for r in got} == {("a", 1, "b"), ("a", 2, "c"), ("b", 1, "a"), ("b", 2, "c"), ("c", 1, "b"), ("c", 2, "a")}
    assert N.nearest_neighbours(N.usable_vectors(hits.limit(0), size=2), 5, size=2).count() == 0
    assert N.nearest_neighbours(N.usable_vectors(hits.limit(1), size=2), 5, size=2).count() == 0
