"""Folders into a searchable collection, in full or only what has changed.

A run lists files without reading them, compares their times with the manifest's, and reads only those that differ, once: text
and hash go to a staging folder beside the store. Files that were but touched get their new time, the others' chunks go into the
parts of the store that hold them. One run at a time writes to a collection; it can be cancelled, and then, as after a crash,
readers see the version before it.
"""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Catalog, Entry
from .config import Settings
from .operators import chunking, embedding, metrics, store
from .operators.retrieval import Bm25Index
from .operators.retrieval import search as run_search
from .sources import scan
from .spark_util import on_workers


class Cancelled(Exception):
    """A run was told to stop."""


class Busy(Exception):
    """Another run writes to the collection."""


def _alive(pid: str) -> bool:
    try:
        os.kill(int(pid), 0)
    except (ValueError, ProcessLookupError):
        return False
    except PermissionError:
        pass
    return True


@contextmanager
def guard(spark: SparkSession, catalog: Catalog, name: str) -> Iterator[None]:
    """Holds a collection for one run, in a file beside the catalog; a run that died no longer holds it.

    The run's jobs form a group of the collection's name, which ``cancel`` ends.
    """
    at = os.path.join(catalog.folder, f"{name}.lock")
    while True:
        try:
            os.close(os.open(at, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
            break
        except FileExistsError:
            with open(at, encoding="utf-8") as f:
                holder = f.read()
            if not holder or _alive(holder):
                raise Busy(f"collection {name!r} is being indexed") from None
            os.unlink(at)
    try:
        with open(at, "w", encoding="utf-8") as f:
            f.write(str(os.getpid()))
        spark.sparkContext.setJobGroup(f"index {name}", f"indexing of {name}", interruptOnCancel=True)
        yield
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        os.unlink(at)


def indexing(catalog: Catalog, name: str) -> bool:
    """Whether a run holds a collection."""
    try:
        with open(os.path.join(catalog.folder, f"{name}.lock"), encoding="utf-8") as f:
            holder = f.read()
    except FileNotFoundError:
        return False
    return not holder or _alive(holder)


def cancel(spark: SparkSession, name: str) -> None:
    """Ends the jobs of a collection's run in this session."""
    spark.sparkContext.cancelJobGroup(f"index {name}")


def listing(spark: SparkSession, folders: tuple[str, ...]) -> DataFrame:
    """path, mtime_ns, modified_at and length of the files there are, and their content for a plan that uses it."""
    out = None
    for folder in folders:
        part = scan.list_files(spark, folder)
        out = part if out is None else out.unionByName(part)
    return out.withColumn("mtime_ns", F.unix_micros("modified_at") * 1000)


def changes(spark: SparkSession, entry: Entry) -> DataFrame:
    """path and change of files by their times alone: new, modified (perhaps but touched) or removed."""
    now = listing(spark, entry.source_folders).select("path", "mtime_ns")
    return store.changed(now, store.KnowledgeBase.at(spark, entry.path).manifest.read())


def index(
    spark: SparkSession,
    catalog: Catalog,
    name: str,
    settings: Settings | None = None,
    full: bool = False,
    only: list[str] | None = None,
    stop: Callable[[], bool] | None = None,
    progress: Callable[[dict], None] | None = None,
) -> dict[str, int]:
    """Takes up new and modified files of a collection's folders, lets removed ones go, and returns the counts of changes.

    ``only`` names files to look at, all others staying as they are. ``stop`` is asked between the stages and ends the run with
    ``Cancelled``; ``progress`` is told of each stage. The run is recorded among the metrics.
    """
    on_workers(spark)
    s, entry = settings or Settings(), catalog.writable(name)
    base = store.KnowledgeBase.at(spark, entry.path)
    began, facts = time.time(), f"{catalog.folder}/metrics"

    def stage(what: str, **more: object) -> None:
        if progress:
            progress({"stage": what, "collection": name, **more})
        if stop and stop():
            raise Cancelled(name)

    with guard(spark, catalog, name):
        staging = f"{entry.path}/staging-{uuid.uuid4().hex}"
        done, status = {"new": 0, "modified": 0, "removed": 0}, "error"
        chunks_written = 0
        try:
            stage("scan")
            if full:
                base.clear()
            files = listing(spark, entry.source_folders)
            found = store.changed(files.select("path", "mtime_ns"), base.manifest.read())
            if only is not None:
                found = found.filter(F.col("path").isin(only))
            found = found.cache()
            counts = {r[0]: r[1] for r in found.groupBy("change").count().collect()}
            stage("changes", **counts)
            if counts.get("removed"):
                base.remove_files(found.filter("change = 'removed'").select("path"))
                done["removed"] = counts["removed"]
            if counts.get("new") or counts.get("modified"):
                wanted = found.filter("change <> 'removed'")
                # the oldest of them, so that the listing passes over whatever is older
                since = files.select("path", "modified_at").join(wanted, "path", "left_semi").agg(F.min("modified_at")).first()[0]
                read = files.filter(F.col("modified_at") >= F.lit(since)).join(wanted.select("path"), "path", "left_semi")
                known = base.manifest.read().select(F.col("path").alias("source_path"), F.col("content_hash").alias("old_hash"))
                times = files.select(F.col("path").alias("source_path"), "mtime_ns").join(wanted.select(F.col("path").alias("source_path"), "change"), "source_path")
                parsed = scan.parse_files(read, hashes=True).join(times, "source_path").join(known, "source_path", "left")
                parsed.write.parquet(staging)
                parsed = spark.read.parquet(staging)
                same = F.coalesce(F.col("old_hash"), F.lit("")).eqNullSafe(F.col("content_hash"))
                touched, taken = parsed.filter(same), parsed.filter(~same)
                for r in taken.groupBy("change").count().collect():
                    done[r[0]] = r[1]
                stage("parsed", **done)
                ident = [F.col("source_path").alias("path"), "mtime_ns", "content_hash"]
                if done["new"] or done["modified"]:
                    wrote = time.time()
                    chunks = chunking.chunk_documents(taken, s.chunk_size, s.chunk_overlap)
                    chunks = chunks.withColumn("embedding", embedding.embed("text", entry.embedding_model, batch=s.embedding_batch_size))
                    base.replace_files(chunks, taken.select(*ident))
                    paths = taken.select(F.col("source_path").alias("source_file"))
                    chunks_written = base.chunks.read(base.chunks.parts_of(paths)).join(paths, "source_file", "left_semi").count()
                    took = time.time() - wrote
                    metrics.record(spark, facts, "embedding_batches", rag_name=name, timestamp=wrote, batch_size=chunks_written, duration_ms=1000 * took, chunks_per_second=metrics.rate(chunks_written, took), model=entry.embedding_model)
                if not touched.isEmpty():
                    base.touch_files(touched.select(*ident))
            stage("written")
            found.unpersist()
            _refresh(spark, catalog, entry)
            status = "done"
        except Cancelled:
            status = "cancelled"
            raise
        finally:
            fs, path = base.chunks._fs()
            fs.delete(path(staging), True)
            took, n = time.time() - began, done["new"] + done["modified"]
            metrics.record(
                spark, facts, "indexing_runs", rag_name=name, started_at=began, finished_at=began + took, duration_s=took, status=status, total_files=n + done["removed"], processed_files=n,
                total_chunks=chunks_written, chunks_per_second=metrics.rate(chunks_written, took), files_per_second=metrics.rate(n, took), errors=int(status == "error"),
            )
    return done


def _refresh(spark: SparkSession, catalog: Catalog, entry: Entry) -> None:
    """Brings the keyword index and the catalog's figures in step with the store."""
    keyword_index(spark, entry.path)
    stats = store.store_stats(store.KnowledgeBase.at(spark, entry.path).chunks.read()).first()
    catalog.update(entry.name, file_count=stats["total_files"], chunk_count=stats["total_chunks"])


def apply_events(spark: SparkSession, catalog: Catalog, name: str, events: DataFrame) -> dict[str, int]:
    """Takes up or lets go the files that last events (path, event, ts) speak of, by what is there now; see ``streaming.follow``."""
    entry = catalog.get(name)
    roots = [f.rstrip("/") + "/" for f in entry.source_folders]
    inside = [r["path"] for r in events.select("path").distinct().collect() if r["path"].startswith(tuple(roots))]  # one batch of a watcher's
    return index(spark, catalog, name, only=inside) if inside else {"new": 0, "modified": 0, "removed": 0}


def index_file(spark: SparkSession, catalog: Catalog, name: str, path: str, settings: Settings | None = None) -> dict[str, int]:
    """Takes up one file of a collection's folders, or lets it go if it is gone."""
    return index(spark, catalog, name, settings, only=[path])


def remove_file(spark: SparkSession, catalog: Catalog, name: str, path: str) -> None:
    """Lets one file go, whether it is still there or not."""
    entry = catalog.writable(name)
    with guard(spark, catalog, name):
        store.KnowledgeBase.at(spark, entry.path).remove_files(spark.createDataFrame([(path,)], "path string"))
        _refresh(spark, catalog, entry)


def store_size(spark: SparkSession, entry: Entry) -> int:
    """Bytes of a collection's files."""
    fs, path = store.KnowledgeBase.at(spark, entry.path).chunks._fs()
    at = path(entry.path)
    return fs.getContentSummary(at).getLength() if fs.exists(at) else 0


def snapshot(spark: SparkSession, catalog: Catalog, retention_days: float = 30) -> None:
    """Records the size of every collection that isn't being indexed, and of this machine's memory, and applies retention; to be run at intervals."""
    facts = f"{catalog.folder}/metrics"
    for entry in catalog.list():
        if not indexing(catalog, entry.name):
            stats = store.store_stats(store.KnowledgeBase.at(spark, entry.path).chunks.read()).first()
            metrics.record(spark, facts, "vector_store_snapshots", rag_name=entry.name, timestamp=time.time(), total_chunks=stats["total_chunks"], total_files=stats["total_files"], db_size_bytes=store_size(spark, entry))
    metrics.append(metrics.system_snapshot(spark), facts, "system_snapshots")
    metrics.purge_all(spark, facts, retention_days)


def document(spark: SparkSession, catalog: Catalog, name: str, path: str) -> DataFrame:
    """chunk_index, start_char, end_char and text of the file that a shown or full path names, in order."""
    entry = catalog.get(name)
    chunks = store.KnowledgeBase.at(spark, entry.path).chunks.read()
    paths = store.sources(chunks).select(F.col("source_file").alias("path"))
    named = store.resolve(spark.createDataFrame([(path,)], "asked string"), paths, list(entry.source_folders)).first()
    return chunks.filter(F.col("source_file") == F.lit(named["path"] if named else None)).select("chunk_index", "start_char", "end_char", "text").orderBy("chunk_index")


def status(spark: SparkSession, catalog: Catalog, name: str) -> dict[str, object]:
    """What there is of a collection and whether it is being indexed."""
    entry = catalog.get(name)
    return {"name": name, "files": entry.file_count, "chunks": entry.chunk_count, "bytes": store_size(spark, entry), "detached": entry.detached, "indexing": indexing(catalog, name)}


def keyword_index(spark: SparkSession, folder: str) -> Bm25Index:
    """The keyword index of the store's current version, saved under that version's name, so it is never stale."""
    chunks = store.KnowledgeBase.at(spark, folder).chunks
    version = chunks.version()
    if version is None:
        return Bm25Index.of(chunks.read(), "chunk_id")
    at = f"{folder}/keywords/{version}"
    fs, path = chunks._fs()
    if not fs.exists(path(f"{at}/stats/_SUCCESS")):
        if fs.exists(path(f"{folder}/keywords")):
            fs.delete(path(f"{folder}/keywords"), True)
        Bm25Index.of(chunks.read(), "chunk_id").save(at)
    return Bm25Index.load(spark, at)


def search(spark: SparkSession, catalog: Catalog, name: str, query: str, top_k: int = 5, settings: Settings | None = None, min_score: float | None = None) -> DataFrame:
    """The best chunks of a collection for a query; the search is recorded among the metrics."""
    on_workers(spark)
    s, entry = settings or Settings(), catalog.get(name)
    began = time.time()
    took: dict[str, float] = {}
    vector = embedding.unit(embedding.backend(entry.embedding_model).embed([query]))[0].tolist()
    chunks = store.KnowledgeBase.at(spark, entry.path).chunks.read()
    found = run_search(chunks, query, vector, s.search(top_k, min_score), keyword_index(spark, entry.path), took)
    rows = found.collect()  # top_k at most
    scores = [r["score"] for r in rows]
    metrics.record(
        spark, f"{catalog.folder}/metrics", "search_queries", rag_name=name, timestamp=began, query_length=len(query), top_k=top_k, results_returned=len(rows),
        total_duration_ms=1000 * (time.time() - began), top_score=max(scores, default=None), min_score=min(scores, default=None), **took,
    )
    return spark.createDataFrame(rows, found.schema)
