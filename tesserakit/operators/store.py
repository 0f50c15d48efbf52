"""A chunk store in versioned Parquet folders, its manifest, and what keeps the two in step.

A version is a whole folder; ``current.json`` names the one to read and is replaced last, so a reader sees the store before
or after a write, never between, and a job that dies leaves the old version. Every change is a plan over the old version:
anti join and union, so the work is a join on the key and no row is looked at in the driver.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MANIFEST = "path string, mtime_ns bigint, content_hash string, chunk_count int, last_indexed string"


# --- plans over tables -----------------------------------------------------------------------------------------------


def upsert(old: DataFrame, new: DataFrame, key: list[str], latest: Column | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` put in by key; of rows of ``new`` with one key the one of greatest ``latest`` (else any) counts.

    Rows of ``new`` with a null in the key are left out.
    """
    new = new.dropna(subset=key)
    if latest is None:
        new = new.dropDuplicates(key)
    else:
        new = new.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(latest.desc()))).filter("_n = 1").drop("_n")
    return old.join(new.select(*key), key, "left_anti").unionByName(new)


def delete_where_in(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` isn't among ``keys`` (its first column)."""
    return rows.join(keys.select(F.col(keys.columns[0]).alias(column)).distinct(), column, "left_anti")


def sources(chunks: DataFrame) -> DataFrame:
    """source_file and number of chunks of each file; blank names are none."""
    return chunks.filter("source_file <> ''").groupBy("source_file").agg(F.countDistinct("chunk_id").alias("chunk_count"))


def store_stats(chunks: DataFrame) -> DataFrame:
    """One row: total_chunks, total_files, avg_chunks_per_file (one digit, 0 without files)."""
    total = chunks.agg(F.countDistinct("chunk_id").alias("total_chunks"), F.countDistinct(F.when(F.col("source_file") != "", F.col("source_file"))).alias("total_files"))
    return total.withColumn("avg_chunks_per_file", F.when(F.col("total_files") == 0, F.lit(0.0)).otherwise(F.round(F.col("total_chunks") / F.col("total_files"), 1)))


def page(rows: DataFrame, order: str, offset: int, limit: int) -> DataFrame:
    """Rows offset.. of the sorted list with the list's total; limit 0 is all of the rest."""
    ordered = rows.crossJoin(F.broadcast(rows.agg(F.count("*").alias("total")))).orderBy(order).offset(offset)  # one row
    return ordered.limit(limit) if limit else ordered


def display_path(path: Column, folders: list[str]) -> Column:
    """A path relative to the first folder that holds it, else its file name."""
    out = F.substring_index(path, "/", -1)
    for folder in reversed(folders):
        base = folder.rstrip("/") + "/"
        out = F.when(path.startswith(base), F.substring(path, len(base) + 1, 1_000_000)).otherwise(out)
    return out


def resolve(asked: DataFrame, paths: DataFrame, folders: list[str]) -> DataFrame:
    """asked and path: for each shown or full path (column ``asked``) the first stored path (column ``path``) that it names.

    Letter case and the kind of slash don't matter for shown paths; a name that nothing has is left out.
    """
    plain = lambda c: F.lower(F.replace(c, F.lit("\\"), F.lit("/")))
    stored = paths.select("path").distinct()
    names = stored.select("path", plain(F.col("path")).alias("name")).union(stored.select("path", plain(display_path(F.col("path"), folders)).alias("name")))
    return asked.select("asked", plain(F.col("asked")).alias("name")).distinct().join(names, "name").groupBy("asked").agg(F.min("path").alias("path"))


def pages(total: int, size: int) -> int:
    """How many pages a list has."""
    return -(-total // size) if size > 0 else int(total > 0)


def changed(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """path and change (new, modified or removed) between files (path, mtime_ns, and content_hash if known) and a manifest.

    A file is modified if the manifest has no hash of it, or its time differs and its hash does too; without a hash to
    compare, a differing time is enough. A null time differs from any.
    """
    known = manifest.dropDuplicates(["path"]).select("path", F.col("mtime_ns").alias("was"), F.col("content_hash").alias("old_hash"), F.lit(True).alias("known"))
    now = current.dropDuplicates(["path"]).withColumn("present", F.lit(True))
    if "content_hash" not in current.columns:
        now = now.withColumn("content_hash", F.lit(None).cast("string"))
    both = now.join(known, "path", "full_outer")
    other = ~F.col("mtime_ns").eqNullSafe(F.col("was")) | F.col("mtime_ns").isNull()
    touched = other & (F.col("content_hash").isNull() | ~F.col("content_hash").eqNullSafe(F.col("old_hash")))
    kind = F.when(F.col("known").isNull(), "new").when(F.col("present").isNull(), "removed").when((F.coalesce("old_hash", F.lit("")) == "") | touched, "modified")
    return both.select("path", kind.alias("change")).filter("change is not null")


def verify(manifest: DataFrame, chunks: DataFrame) -> DataFrame:
    """path and problem of what is out of step: invalidated (no hash), orphan_manifest (no chunks), orphan_store (not in the manifest)."""
    files = chunks.filter("source_file <> ''").select(F.col("source_file").alias("path")).distinct()
    known = manifest.select("path", "content_hash").distinct()
    bad = known.filter(F.coalesce("content_hash", F.lit("")) == "").select("path", F.lit("invalidated").alias("problem"))
    gone = known.select("path").distinct().join(files, "path", "left_anti").select("path", F.lit("orphan_manifest").alias("problem"))
    stray = files.join(known.select("path"), "path", "left_anti").select("path", F.lit("orphan_store").alias("problem"))
    return bad.unionByName(gone).unionByName(stray)


def invalidate(manifest: DataFrame, paths: DataFrame) -> DataFrame:
    """The manifest with the hashes of some paths emptied."""
    hit = paths.select("path").distinct().withColumn("hit", F.lit(True))
    return manifest.join(hit, "path", "left").withColumn("content_hash", F.when(F.col("hit"), F.lit("")).otherwise(F.col("content_hash"))).drop("hit")


def migrate(manifest: DataFrame, chunks: DataFrame) -> DataFrame:
    """The manifest with a row, without time and hash, for each file that only the store has."""
    only = sources(chunks).withColumnRenamed("source_file", "path").join(manifest.select("path"), "path", "left_anti")
    rows = only.select("path", F.lit(0).cast("bigint").alias("mtime_ns"), F.lit("").alias("content_hash"), F.col("chunk_count").cast("int"), F.lit("").alias("last_indexed"))
    return manifest.unionByName(rows)


# --- the store -------------------------------------------------------------------------------------------------------


@dataclass
class VersionedTable:
    """A table of which each write is a new folder.

    With a ``key`` its rows are divided into ``parts`` by the key's hash, a folder each, and a write may replace some parts
    only: the pointer then names, part by part, the version that holds it. ``parts`` may not change once there is a table.
    """

    spark: SparkSession
    path: str
    schema: str
    key: str | None = None
    parts: int = 64

    def _fs(self):  # noqa: ANN202
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(conf), jvm.org.apache.hadoop.fs.Path

    def _pointer(self) -> dict:
        fs, path = self._fs()
        if not fs.exists(path(f"{self.path}/current.json")):
            return {}
        return json.loads("".join(r[0] for r in self.spark.read.text(f"{self.path}/current.json").collect()))

    def version(self) -> str | None:
        return self._pointer().get("version")

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.parts)).cast("int")

    def parts_of(self, keys: DataFrame) -> list[int]:
        """The parts in which keys (the first column) lie; ``parts`` numbers at most."""
        return sorted(r[0] for r in keys.select(F.col(keys.columns[0]).alias(self.key)).select(self._part()).distinct().collect())

    def read(self, parts: list[int] | None = None) -> DataFrame:
        """All rows, or those of some parts."""
        now = self._pointer()
        if "folders" in now:
            folders = [f"{folder}/_part={part}" for part, folder in now["folders"].items() if parts is None or int(part) in parts]
        else:
            folders = [now["version"]] if now else []
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{f}" for f in folders)) if folders else self.spark.createDataFrame([], self.schema)

    def write(self, rows: DataFrame, keep_old: bool = False, parts: list[int] | None = None) -> str:
        """Writes a version, of some parts if named, and makes it current; what it replaces is removed unless ``keep_old``."""
        old, new = self._pointer(), f"v-{uuid.uuid4().hex}"
        fs, path = self._fs()
        state = {"version": new}
        gone = [old["version"]] if old else []
        if self.key is None:
            rows.write.parquet(f"{self.path}/{new}")
        else:
            # a part is written by several tasks, which AQE divides further if it is large
            spread = rows.withColumn("_part", self._part()).repartition("_part", F.pmod(F.xxhash64(self.key, F.lit(1)), F.lit(8)))
            spread.write.partitionBy("_part").parquet(f"{self.path}/{new}")
            written = {s.getPath().getName().removeprefix("_part=") for s in fs.listStatus(path(f"{self.path}/{new}")) if s.isDirectory()}
            before = old.get("folders", {})
            kept = {k: v for k, v in before.items() if parts is not None and int(k) not in parts}
            state["folders"] = kept | dict.fromkeys(sorted(written), new)
            gone = [f"{v}/_part={k}" for k, v in before.items() if k not in kept] or gone * ("folders" not in old)
        self._point(state)
        for folder in [] if keep_old else gone:
            fs.delete(path(f"{self.path}/{folder}"), True)
        return new

    def append(self, rows: DataFrame) -> None:
        """Adds rows to the current version, where no other change is under way."""
        version = self.version()
        if version is None:
            self.write(rows)
        else:
            rows.write.mode("append").parquet(f"{self.path}/{version}")

    def _point(self, state: dict) -> None:
        fs, path = self._fs()
        draft, pointer = path(f"{self.path}/next-{state['version']}.json"), path(f"{self.path}/current.json")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else fs.getUri(), self.spark._jsc.hadoopConfiguration())
        rename = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark._sc._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context.rename(fs.makeQualified(draft), fs.makeQualified(pointer), options)


CHUNKS = "chunk_id string, source_file string, chunk_index int, start_char int, end_char int, text string, metadata map<string,string>, embedding array<float>"


@dataclass
class KnowledgeBase:
    """The chunks and the manifest of one collection, both divided by file, so a change rewrites the parts of its files only."""

    chunks: VersionedTable
    manifest: VersionedTable

    @staticmethod
    def at(spark: SparkSession, folder: str) -> KnowledgeBase:
        return KnowledgeBase(VersionedTable(spark, f"{folder}/chunks", CHUNKS, "source_file"), VersionedTable(spark, f"{folder}/manifest", MANIFEST, "path"))

    def replace_files(self, chunks: DataFrame, files: DataFrame) -> None:
        """Puts in the chunks of some files (path, mtime_ns, content_hash): all of their old ones go.

        Files with no chunks left are in the manifest all the same, with 0, so they aren't taken up again each time.
        """
        paths = files.select("path").distinct()
        parts = self.manifest.parts_of(paths)
        cut = delete_where_in(self.chunks.read(parts), paths, "source_file").unionByName(chunks, allowMissingColumns=True)
        self.chunks.write(cut, parts=parts)
        counts = sources(self.chunks.read(parts)).withColumnRenamed("source_file", "path")
        rows = files.join(counts, "path", "left").select(
            "path", "mtime_ns", "content_hash", F.coalesce("chunk_count", F.lit(0)).cast("int").alias("chunk_count"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("last_indexed")
        )
        self.manifest.write(upsert(self.manifest.read(parts), rows, ["path"]), parts=parts)

    def touch_files(self, files: DataFrame) -> None:
        """New times (path, mtime_ns) of files whose content is as it was."""
        parts = self.manifest.parts_of(files)
        new = files.select("path", F.col("mtime_ns").alias("_at"))
        rows = self.manifest.read(parts).join(new, "path", "left").withColumn("mtime_ns", F.coalesce("_at", "mtime_ns")).drop("_at")
        self.manifest.write(rows, parts=parts)

    def remove_files(self, paths: DataFrame) -> None:
        parts = self.manifest.parts_of(paths.select("path"))
        self.chunks.write(delete_where_in(self.chunks.read(parts), paths.select("path"), "source_file"), parts=parts)
        self.manifest.write(delete_where_in(self.manifest.read(parts), paths.select("path"), "path"), parts=parts)

    def clear(self) -> None:
        for t in (self.chunks, self.manifest):
            t.write(t.spark.createDataFrame([], t.schema))
