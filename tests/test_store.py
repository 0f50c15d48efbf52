from pyspark.sql import functions as F
from tesserakit.operators import metrics, store


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_upsert_last_wins(spark):
    old = table(spark, [("a", 1), ("b", 1)], "k string, v int")
    new = table(spark, [("b", 2), ("b", 3), ("c", 4), (None, 9)], "k string, v int")
    assert sorted(map(tuple, store.upsert(old, new, ["k"], F.col("v")).collect())) == [("a", 1), ("b", 3), ("c", 4)]
    assert store.upsert(old.limit(0), new.limit(0), ["k"]).count() == 0


def test_changes(spark):
    now = table(spark, [("same", 1, "h"), ("touched", 2, "h"), ("edited", 2, "i"), ("new", 1, "h"), ("empty", 1, "h"), ("untimed", None, "i")], "path string, mtime_ns bigint, content_hash string")
    old = table(spark, [("same", 1, "h"), ("touched", 1, "h"), ("edited", 1, "h"), ("gone", 1, "h"), ("empty", 1, ""), ("untimed", None, "h")], "path string, mtime_ns bigint, content_hash string")
    assert {r[0]: r[1] for r in store.changed(now, old).collect()} == {"edited": "modified", "new": "new", "gone": "removed", "empty": "modified", "untimed": "modified"}
    timed = {r[0]: r[1] for r in store.changed(now.drop("content_hash"), old).collect()}
    assert timed["touched"] == "modified" and "same" not in timed


def test_verify(spark):
    manifest = table(spark, [("a", "h"), ("b", ""), ("c", None)], "path string, content_hash string")
    chunks = table(spark, [("a",), ("b",), ("d",), ("",)], "source_file string")
    assert sorted(map(tuple, store.verify(manifest, chunks).collect())) == [("b", "invalidated"), ("c", "invalidated"), ("c", "orphan_manifest"), ("d", "orphan_store")]


def test_stats_and_pages(spark):
    chunks = table(spark, [("1", "a"), ("1", "a"), ("2", "a"), ("3", "b")], "chunk_id string, source_file string")
    assert tuple(store.store_stats(chunks).first()) == (3, 2, 1.5) and tuple(store.store_stats(chunks.limit(0)).first()) == (0, 0, 0.0)
    files = store.sources(chunks)
    assert [tuple(r) for r in store.page(files, "source_file", 1, 1).collect()] == [("b", 1, 2)] and store.page(files, "source_file", 0, 0).count() == 2


def test_versions(spark, tmp_path):
    t = store.VersionedTable(spark, str(tmp_path / "t"), "k string, v int")
    assert t.read().count() == 0
    t.write(table(spark, [("a", 1)], t.schema))
    t.write(store.upsert(t.read(), table(spark, [("b", 2)], t.schema), ["k"]))
    assert sorted(map(tuple, t.read().collect())) == [("a", 1), ("b", 2)]


def test_knowledge_base(spark, tmp_path):
    base = store.KnowledgeBase.at(spark, str(tmp_path / "kb"))
    files = table(spark, [("f", 1, "h"), ("e", 1, "h")], "path string, mtime_ns bigint, content_hash string")
    chunks = table(spark, [("f::chunk_0", "f", 0), ("f::chunk_1", "f", 1)], "chunk_id string, source_file string, chunk_index int")
    base.replace_files(chunks, files)
    base.replace_files(chunks.limit(1), files.filter("path = 'f'"))
    assert base.chunks.read().count() == 1
    assert {r["path"]: r["chunk_count"] for r in base.manifest.read().collect()} == {"f": 1, "e": 0}
    base.remove_files(files.filter("path = 'f'"))
    assert base.chunks.read().count() == 0 and base.manifest.read().count() == 1
    base.clear()
    assert base.manifest.read().count() == 0


def test_metrics(spark):
    rows = table(spark, [(1, 10.0, 5.0), (2, 20.0, -1.0), (3, None, None)], "id bigint, timestamp double, total_duration_ms double")
    rows = rows.withColumns({"results_returned": F.lit(3), "top_score": F.lit(0.5), "rag_name": F.lit("x")})
    assert tuple(metrics.search_dashboard(rows).first()) == (3, 5.0, 3.0, 0.5)
    assert metrics.latest(rows, "timestamp", "id").first()["id"] == 2
    assert [r["id"] for r in metrics.recent(rows, "timestamp", "id", 5, oldest_first=True).collect()] == [1, 2]
    assert metrics.purge(rows, "timestamp", 86400.0 + 15, 1).count() == 2


def test_facts_on_disk(spark, tmp_path):
    folder = str(tmp_path)
    metrics.append(table(spark, [(1, "x", 10.0), (2, "x", 200_000.0)], "id bigint, rag_name string, timestamp double"), folder, "search_queries")
    metrics.append(metrics.system_snapshot(spark), folder, "system_snapshots")
    assert metrics.read(spark, folder, "search_queries").count() == 2 and metrics.read(spark, folder, "embedding_batches").count() == 0
    assert metrics.purge_all(spark, folder, 1, now=200_000.0) == 1 and metrics.read(spark, folder, "search_queries").count() == 1
    assert tuple(metrics.indexing_dashboard(metrics.read(spark, folder, "indexing_runs")).first()) == (0, None, None, 0, 0)
    assert metrics.embedding_dashboard(metrics.read(spark, folder, "embedding_batches")).first()["texts"] == 0


def test_paths(spark):
    paths = table(spark, [("ops/a/B.md",), ("docs/b.md",), ("x/b.md",)], "path string")
    asked = table(spark, [("A\\b.MD",), ("b.md",), ("none",), ("ops/a/B.md",)], "asked string")
    assert {tuple(r) for r in store.resolve(asked, paths, ["ops", "docs"]).collect()} == {("A\\b.MD", "ops/a/B.md"), ("b.md", "docs/b.md"), ("ops/a/B.md", "ops/a/B.md")}
    assert [store.pages(n, 10) for n in (0, 1, 10, 11)] == [0, 1, 1, 2] and store.pages(5, 0) == 1


def test_files_without_a_time_are_there(spark, tmp_path):
    from tesserakit.plans import store_queries as Q

    at = {"file_modified_at": "2024-01-01T00:00:00+00:00"}
    files = [("same", at), ("no_time", {"format": "text"}), ("no_metadata", None), ("new_no_time", None)]
    table(spark, files, "source_path string, metadata map<string,string>").write.parquet(str(tmp_path / "documents_parsed.parquet"))
    known = [(p, 1_704_067_200_000_000_000, "h", 3, "") for p in ("same", "no_time", "no_metadata", "gone")]
    table(spark, known, "path string, mtime_ns bigint, content_hash string, chunk_count int, last_indexed string").write.parquet(str(tmp_path / "manifest.parquet"))
    changes = {r["path"]: r["change"] for r in Q.manifest_changes(spark, str(tmp_path)).collect()}
    assert changes == {"no_time": "modified", "no_metadata": "modified", "new_no_time": "new", "gone": "removed"}
    assert [tuple(r) for r in Q.manifest_upserted(spark, str(tmp_path)).select("files", "chunks").collect()] == [(5, 7)]


def times_by_the_nanosecond(spark, folder):
    """Files of one time, and a manifest with that second's first and last nanoseconds, those beside it and one before 1970."""
    second = 1_704_067_200
    times = {"first": second * 10**9, "last": second * 10**9 + 999_999_999, "before": second * 10**9 - 1, "after": (second + 1) * 10**9, "untimed": None}
    at = {"file_modified_at": "2024-01-01T00:00:00+00:00"}
    files = [(p, at) for p in times] + [("old", {"file_modified_at": "1969-12-31T23:59:57+00:00"})]
    known = [(p, t, "h", 1, "") for p, t in times.items()] + [("old", -2_500_000_000, "h", 1, "")]
    table(spark, files, "source_path string, metadata map<string,string>").write.parquet(f"{folder}/documents_parsed.parquet")
    table(spark, known, store.MANIFEST).write.parquet(f"{folder}/manifest.parquet")


def test_manifest_changes_in_whole_seconds(spark, tmp_path):
    from tesserakit.plans import store_queries as Q

    times_by_the_nanosecond(spark, tmp_path)
    assert {r["path"]: r["change"] for r in Q.manifest_changes(spark, str(tmp_path)).collect()} == {"before": "modified", "after": "modified", "untimed": "modified"}


def test_change_counts_in_whole_seconds(spark, tmp_path):
    from tesserakit.plans import store_queries as Q

    at = {"file_modified_at": "2024-01-01T00:00:00+00:00"}
    table(spark, [("same", at), ("last", at), ("new", at)], "source_path string, metadata map<string,string>").write.parquet(str(tmp_path / "documents_parsed.parquet"))
    known = [(p, 1_704_067_200_000_000_000 + n, "h", 1, "") for p, n in (("same", 0), ("last", 999_999_999), ("gone", 0))]
    table(spark, known, store.MANIFEST).write.parquet(str(tmp_path / "manifest.parquet"))
    assert {r["change"]: r["files"] for r in Q.change_counts(spark, str(tmp_path)).collect()} == {"new": 1, "removed": 1}
