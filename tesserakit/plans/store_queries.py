"""Queries of the sources, the chunk store, the manifest, the metrics and the file events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chunking, embedding, metrics, store
from ..sources import formats, markup, parsers, skip
from ..spark_util import shared_dir, table
from ..streaming import events as E

FOLDERS = ["ops", "docs/2023", "docs"]
GONE = "legal/"
VARIANTS = [("", ""), ("a/Node_Modules/", ""), (".git\\", ""), ("x.egg-info/", ""), ("build", ""), ("", ".BAK"), ("", "/Thumbs.db"), ("", ".min.js"), ("", "~")]


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents_parsed")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunks")


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "manifest")


def _searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "search_queries").distinct()


def _seconds(column: str) -> F.Column:
    """Whole seconds of nanoseconds, rounded down, in whole numbers: doubles would round some up to the next second."""
    return F.expr(f"{column} div 1000000000 - int({column} % 1000000000 < 0)")


def _current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files there are now, with their times in whole seconds, null where there is none."""
    stamp = F.unix_timestamp(F.to_timestamp(F.nullif(X.map_get("metadata", "file_modified_at"), F.lit("")), "yyyy-MM-dd'T'HH:mm:ssXXX"))
    return _files(spark, sf_dir).select(F.col("source_path").alias("path"), stamp.alias("mtime_ns")).groupBy("path").agg(F.max("mtime_ns").alias("mtime_ns"))


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _manifest(spark, sf_dir).withColumn("mtime_ns", _seconds("mtime_ns"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.relevant(table(spark, sf_dir, "file_events"))


# --- sources ---------------------------------------------------------------------------------------------------------


def format_dispatch(spark, sf_dir):
    paths = _files(spark, sf_dir).select("source_path").distinct()
    return paths.groupBy(F.coalesce(formats.format_of("source_path"), F.lit("none")).alias("format")).agg(F.count("*").alias("files"))


def code_languages(spark, sf_dir):
    paths = _files(spark, sf_dir).select("source_path").distinct().filter(formats.format_of("source_path") == "code")
    return paths.select("source_path", formats.language_of("source_path").alias("language"))


def path_parts(spark, sf_dir):
    paths = _files(spark, sf_dir).select("source_path").distinct()
    return paths.select("source_path", X.file_name("source_path").alias("name"), X.suffix("source_path").alias("suffix"), X.stem("source_path").alias("stem"))


def skipped_paths(spark, sf_dir):
    paths = table(spark, sf_dir, "file_events").select("path").filter("path is not null").distinct()
    return paths.filter(skip.skipped_path("path"))


def skipped_variants(spark, sf_dir):
    """Of every path, as it is and put where rules skip it, whether it is skipped."""
    paths = _files(spark, sf_dir).select(F.col("source_path").alias("p")).distinct()
    forms = F.array(*(F.concat(F.lit(before), "p", F.lit(after)) for before, after in VARIANTS))
    return paths.select(F.explode(forms).alias("path")).select("path", skip.skipped_path("path").alias("skipped"))


def log_counts(spark, sf_dir):
    lines, errors, warnings = markup.log_counts("text")
    files = _files(spark, sf_dir).filter(F.col("source_path").rlike(r"\.log$") & F.col("text").isNotNull()).select("source_path", "text").distinct()
    return files.select("source_path", lines.cast("bigint").alias("line_count"), errors.cast("bigint").alias("error_count"), warnings.cast("bigint").alias("warning_count"))


def markdown_clean(spark, sf_dir):
    files = _files(spark, sf_dir).filter("format_hint = 'markdown' and text is not null").select("source_path", "text").distinct()
    return files.select("source_path", markup.markdown_title("text").alias("title"), markup.clean_markdown("text").alias("text"))


def rst_clean(spark, sf_dir):
    files = _files(spark, sf_dir).filter(F.col("source_path").endswith(".rst") & F.col("text").isNotNull()).select("source_path", "text").distinct()
    return files.select("source_path", markup.clean_rst("text").alias("text"))


def doc_summaries(spark, sf_dir):
    files = _files(spark, sf_dir).filter("format_hint = 'code' and text is not null").select("source_path", "text").distinct()
    return files.select("source_path", markup.doc_summary("text", formats.language_of("source_path")).alias("doc_summary"))


def events_props_flat(spark, sf_dir):
    """JSON properties of events, flattened to lines."""

    def run(parts):
        import json

        for part in parts:
            part["flat"] = ["\n".join(parsers.flatten(json.loads(p))) if p else "" for p in part["props"]]
            yield part[["event_id", "flat"]]

    return table(spark, sf_dir, "events").select("event_id", "props").mapInPandas(run, "event_id bigint, flat string")


# --- chunking --------------------------------------------------------------------------------------------------------


def chunk_documents(spark, sf_dir):
    return chunking.chunk_documents(_files(spark, sf_dir))


def section_rows(spark, sf_dir):
    return chunking.section_rows(_files(spark, sf_dir))


def page_sections(spark, sf_dir):
    """Sections of scanned files by page."""
    rows = chunking.section_rows(_files(spark, sf_dir).filter("format_hint = 'pdf'"))
    return rows.filter("heading <> ''").groupBy("source_path").agg(F.count("*").alias("pages"))


def heading_sections(spark, sf_dir):
    """Headings of Markdown files with text under them."""
    rows = chunking.section_rows(_files(spark, sf_dir).filter("format_hint = 'markdown'"))
    return rows.filter("heading <> ''").groupBy("source_path").agg(F.count("*").alias("sections"))


def fixed_windows(spark, sf_dir):
    return chunking.fixed_windows(_files(spark, sf_dir))


def context_prefix(spark, sf_dir):
    """What stands before each chunk of a titled file."""
    return _chunks(spark, sf_dir).filter(F.col("text").startswith("Title: ")).select("chunk_id", F.substring_index("text", "\n", 1).alias("prefix")).distinct()


# --- scalars ---------------------------------------------------------------------------------------------------------


def token_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(X.tokens(F.coalesce("text", F.lit("")))).cast("bigint").alias("tokens"))


def blank_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(X.is_blank("text")).select("doc_id")


def embedding_texts(spark, sf_dir):
    """Texts as a model with a prefix takes them."""
    rows = table(spark, sf_dir, "documents").select("doc_id", X.for_embedding("text").alias("t"))
    return rows.select("doc_id", F.length(F.concat(F.lit("passage: "), "t")).cast("bigint").alias("n"), F.md5(F.concat(F.lit("passage: "), "t")).alias("digest"))


def hash_embedding(spark, sf_dir):
    """A stand-in embedding: counts of words by bucket of their digest, 64 buckets."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(X.tokens("text")).alias("w"))
    bucket = F.pmod(F.conv(F.substring(F.md5("w"), 1, 8), 16, 10).cast("bigint"), F.lit(64)).cast("bigint")
    return words.groupBy("doc_id", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def embedded_shapes(spark, sf_dir):
    """Unit vectors of prefixed texts, by the backend that only counts."""
    vectors = table(spark, sf_dir, "documents").select("doc_id", embedding.embed("text", "text-shape", "passage: ").alias("v"))
    return vectors.select("doc_id", *(F.round(F.col("v")[k].cast("double"), 2).alias(f"v{k}") for k in range(4)))


def iso_times(spark, sf_dir):
    rows = _searches(spark, sf_dir).filter("timestamp is not null")
    at = F.timestamp_seconds(F.floor("timestamp"))
    return rows.select("id", X.iso_utc("timestamp").alias("iso"), F.date_format(at, "yyyy-MM-dd HH:mm").alias("shown")).distinct()


def durations(spark, sf_dir):
    """Durations as minutes and seconds."""
    rows = _searches(spark, sf_dir).filter("total_duration_ms >= 0").select("id", F.floor(F.col("total_duration_ms") / 1000).cast("bigint").alias("s")).distinct()
    return rows.select("id", F.floor(F.col("s") / 60).cast("bigint").alias("minutes"), F.pmod("s", F.lit(60)).alias("seconds"))


def metadata_values(spark, sf_dir):
    rows = _files(spark, sf_dir).select("source_path", X.map_get("metadata", "format").alias("format"), X.map_get("metadata", "page_count", "0").alias("pages"))
    return rows.distinct()


def metadata_merged(spark, sf_dir):
    """Each chunk's metadata with its position, as one JSON text."""
    position = F.create_map(F.lit("chunk_index"), F.col("chunk_index").cast("string"), F.lit("start_char"), F.col("start_char").cast("string"))
    both = F.map_concat(F.coalesce("metadata", F.expr("map()").cast("map<string,string>")), position)
    return _chunks(spark, sf_dir).select("chunk_id", F.size(both).cast("bigint").alias("keys"), both["start_char"].alias("start_char")).distinct()


def content_hashes(spark, sf_dir):
    return _files(spark, sf_dir).select("source_path", X.content_hash("text").alias("content_hash")).distinct()


# --- store -----------------------------------------------------------------------------------------------------------


def source_counts(spark, sf_dir):
    return store.sources(_chunks(spark, sf_dir))


def store_stats(spark, sf_dir):
    return store.store_stats(_chunks(spark, sf_dir))


def source_page(spark, sf_dir):
    """Files 10 to 19 of the sorted list."""
    return store.page(store.sources(_chunks(spark, sf_dir)), "source_file", 10, 10)


def source_filter(spark, sf_dir):
    return store.sources(_chunks(spark, sf_dir)).filter(F.contains(F.lower("source_file"), F.lit("REPORT".lower())))


def display_paths(spark, sf_dir):
    paths = store.sources(_chunks(spark, sf_dir))
    return paths.select("source_file", store.display_path(F.col("source_file"), FOLDERS).alias("shown"))


def resolved_paths(spark, sf_dir):
    """The file that each shown path, in capitals, names."""
    paths = store.sources(_chunks(spark, sf_dir)).select(F.col("source_file").alias("path"))
    asked = paths.select(F.upper(store.display_path(F.col("path"), FOLDERS)).alias("asked"))
    return store.resolve(asked, paths, FOLDERS)


def document_chunks(spark, sf_dir):
    """The chunks of every file in order, with how many there are."""
    rows = _chunks(spark, sf_dir).select("source_file", "chunk_index", "start_char", "end_char").distinct()
    counts = rows.groupBy("source_file").agg(F.count("*").alias("of"))
    return rows.join(counts, "source_file").orderBy("source_file", "chunk_index")


def upserted(spark, sf_dir):
    """Chunks per file once hits have been put in as chunks of their own text."""
    old = _chunks(spark, sf_dir).dropDuplicates(["chunk_id"]).select("chunk_id", "source_file", F.length("text").alias("n"))
    new = table(spark, sf_dir, "hits").filter("text is not null").select("chunk_id", "source_file", F.lit(0).alias("n")).distinct()
    return store.upsert(old, new, ["chunk_id"]).groupBy("source_file").agg(F.count("*").alias("chunks"), F.sum("n").alias("characters"))


def without_sources(spark, sf_dir):
    """Chunks left when a folder's files are gone."""
    gone = _files(spark, sf_dir).filter(F.col("source_path").startswith(GONE)).select("source_path")
    left = store.delete_where_in(_chunks(spark, sf_dir).select("chunk_id", "source_file").distinct(), gone, "source_file")
    return left.agg(F.count("*").alias("chunks"), F.countDistinct("source_file").alias("files"))


def known_ids(spark, sf_dir):
    """Hits whose chunk the store has, by search."""
    ids = _chunks(spark, sf_dir).select("chunk_id").distinct()
    return table(spark, sf_dir, "hits").select("query_id", "rank", "chunk_id").distinct().join(ids, "chunk_id", "left_semi").groupBy("query_id").agg(F.count("*").alias("known"))


def source_sets(spark, sf_dir):
    """Files of the store and the manifest: in either, in both, in one only."""
    a = _chunks(spark, sf_dir).filter("source_file <> ''").select(F.col("source_file").alias("path"))
    b = _manifest(spark, sf_dir).select("path")
    parts = {"either": a.union(b).distinct(), "both": a.intersect(b), "store_only": a.subtract(b), "manifest_only": b.subtract(a)}
    out = None
    for name, rows in parts.items():
        one = rows.agg(F.lit(name).alias("part"), F.count("*").alias("files"))
        out = one if out is None else out.unionByName(one)
    return out


# --- manifest --------------------------------------------------------------------------------------------------------


def manifest_changes(spark, sf_dir):
    return store.changed(_current(spark, sf_dir), _known(spark, sf_dir))


def file_changes(spark, sf_dir):
    """Changes with the hash rule, over all files: every third file's hash is the manifest's, so a differing time alone is none."""
    now = _current(spark, sf_dir)
    known = _known(spark, sf_dir).dropDuplicates(["path"])
    same = F.when(F.length("path") % 3 == 0, F.col("content_hash")).otherwise(F.concat(F.lit("other "), "content_hash"))
    hashed = now.join(known.select("path", same.alias("content_hash")), "path", "left")
    return store.changed(hashed, known)


def change_counts(spark, sf_dir):
    return manifest_changes(spark, sf_dir).groupBy("change").agg(F.count("*").alias("files"))


def manifest_problems(spark, sf_dir):
    return store.verify(_manifest(spark, sf_dir), _chunks(spark, sf_dir))


def manifest_totals(spark, sf_dir):
    return _manifest(spark, sf_dir).distinct().agg(F.count("*").alias("files"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunks"))


def manifest_invalidated(spark, sf_dir):
    """Files without a hash once a folder's are emptied."""
    gone = _manifest(spark, sf_dir).filter(F.col("path").startswith(GONE))
    return store.invalidate(_manifest(spark, sf_dir), gone).filter("content_hash = ''").select("path").distinct()


def manifest_upserted(spark, sf_dir):
    """The manifest's size and chunks once the present files have been put in with one chunk each."""
    new = _current(spark, sf_dir).select("path", F.col("mtime_ns"), F.lit("0").alias("content_hash"), F.lit(1).alias("chunk_count"), F.lit("").alias("last_indexed"))
    rows = store.upsert(_manifest(spark, sf_dir).distinct(), new, ["path"])
    return rows.agg(F.count("*").alias("files"), F.sum("chunk_count").alias("chunks"))


def manifest_migrated(spark, sf_dir):
    rows = store.migrate(_manifest(spark, sf_dir).distinct(), _chunks(spark, sf_dir))
    return rows.filter("last_indexed = ''").select("path", F.col("chunk_count").cast("bigint").alias("chunk_count")).distinct()


def wrong_counts(spark, sf_dir):
    """Files whose number of chunks in the manifest isn't the store's."""
    both = _manifest(spark, sf_dir).select("path", "chunk_count").distinct().join(store.sources(_chunks(spark, sf_dir)).withColumnsRenamed({"source_file": "path", "chunk_count": "in_store"}), "path")
    return both.filter("chunk_count <> in_store").select("path", F.col("chunk_count").cast("bigint").alias("chunk_count"), "in_store")


# --- metrics ---------------------------------------------------------------------------------------------------------


def search_dashboard(spark, sf_dir):
    return metrics.search_dashboard(_searches(spark, sf_dir))


def search_dashboard_by_base(spark, sf_dir):
    return metrics.search_dashboard(_searches(spark, sf_dir), by=["rag_name"])


def search_dashboard_of_one(spark, sf_dir):
    return metrics.search_dashboard(_searches(spark, sf_dir), rag="kb-main")


def latest_search(spark, sf_dir):
    return metrics.latest(_searches(spark, sf_dir), "timestamp", "id").select("id", "rag_name", "timestamp")


def recent_searches(spark, sf_dir):
    return metrics.recent(_searches(spark, sf_dir), "timestamp", "id", 20).select("id", "rag_name", "timestamp")


def recent_searches_chart(spark, sf_dir):
    return metrics.recent(_searches(spark, sf_dir), "timestamp", "id", 20, oldest_first=True).select("id", F.round("total_duration_ms", 3).alias("ms"))


def purged_searches(spark, sf_dir):
    """Searches left after thirty days' retention at the time of the last one."""
    rows = _searches(spark, sf_dir)
    now = rows.agg(F.max("timestamp")).first()[0] or 0.0
    return metrics.purge(rows, "timestamp", now, 30).groupBy("rag_name").agg(F.count("*").alias("searches"))


def searches_by_day(spark, sf_dir):
    rows = _searches(spark, sf_dir).filter("timestamp is not null")
    day = F.date_format(F.timestamp_seconds(F.floor("timestamp")), "yyyy-MM-dd")
    return rows.groupBy(day.alias("day")).agg(F.count("*").alias("searches"))


# --- file events -----------------------------------------------------------------------------------------------------


def relevant_events(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("event").agg(F.count("*").alias("events"), F.countDistinct("path").alias("files"))


def last_events(spark, sf_dir):
    return E.last_event_wins(_events(spark, sf_dir)).select("path", "event", F.unix_micros("ts").alias("us"))


def debounce_sessions(spark, sf_dir):
    """Bursts of events: their start, files and events."""
    rows = E.sessions(_events(spark, sf_dir))
    return rows.groupBy(F.unix_micros("session_start").alias("start_us")).agg(F.countDistinct("path").alias("files"), F.count("*").alias("events"))


def debounced_events(spark, sf_dir):
    """What each burst comes to, per file."""
    rows = E.last_event_wins(E.sessions(_events(spark, sf_dir)), ["session_start"])
    return rows.select(F.unix_micros("session_start").alias("start_us"), "path", "event")


def late_events(spark, sf_dir):
    rows = table(spark, sf_dir, "file_events").filter("ts is not null and received_at is not null").distinct()
    late = F.unix_micros(F.col("received_at").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    return rows.filter(late > 86_400_000_000).groupBy("path").agg(F.count("*").alias("late"))


def streamed_events(spark, sf_dir):
    """Last events per file, by a stream over the events' folder that ends with what is there."""
    import uuid

    at = f"{shared_dir(spark)}/streamed-{uuid.uuid4().hex}"
    source = spark.readStream.schema(table(spark, sf_dir, "file_events").schema).parquet(f"{sf_dir}/file_events.parquet*")
    rows = source.select("path", E.kind_of("event_type").alias("event"), F.col("ts").cast("timestamp").alias("ts")).dropna()
    rows = rows.filter(formats.supported("path") & ~skip.skipped_path("path"))
    last = E.LastEvents(spark, f"{at}/last", lambda batch, n: None)
    E.follow(rows, f"{at}/checkpoint", last).awaitTermination()
    return last.now().select("path", "event", F.unix_micros("ts").alias("us"))


QUERIES = {
    f.__name__: f
    for f in (
        [format_dispatch, code_languages, path_parts, skipped_paths, skipped_variants, log_counts, markdown_clean, rst_clean, doc_summaries, events_props_flat]
        + [chunk_documents, section_rows, page_sections, heading_sections, fixed_windows, context_prefix]
        + [token_counts, blank_texts, embedding_texts, hash_embedding, embedded_shapes, iso_times, durations, metadata_values, metadata_merged, content_hashes]
        + [source_counts, store_stats, source_page, source_filter, display_paths, resolved_paths, document_chunks, upserted, without_sources, known_ids, source_sets]
        + [manifest_changes, file_changes, change_counts, manifest_problems, manifest_totals, manifest_invalidated, manifest_upserted, manifest_migrated, wrong_counts]
        + [search_dashboard, search_dashboard_by_base, search_dashboard_of_one, latest_search, recent_searches, recent_searches_chart, purged_searches, searches_by_day]
        + [relevant_events, last_events, debounce_sessions, debounced_events, late_events, streamed_events]
    )
}


def _list(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _case(column: str, values: dict[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN {column} = '{k}' THEN '{v}'" for k, v in values.items()) + " END"


_NAME = "regexp_extract({0}, '[^/]*$')"
_SUFFIX = "lower(regexp_extract(regexp_extract({0}, '[^/]*$'), '.(\\.[^.]*)$', 1))"
_PATHS = "(SELECT DISTINCT source_path AS p FROM documents_parsed)"
_ENDING = skip.ENDING.replace("'", "''")
_SKIPPED = f"""(len(list_filter(list_slice(parts, 1, -2), lambda d: list_contains([{_list(skip.DIRS)}], lower(d)) OR ends_with(lower(d), '.egg-info'))) > 0
 OR list_contains([{_list(skip.FILES)}], lower(parts[-1])) OR regexp_matches(lower(parts[-1]), '{_ENDING}'))"""
_PARTS = "list_filter(string_split(replace(path, '\\', '/'), '/'), lambda d: d <> '')"
_RELEVANT = f"""
raw AS (SELECT DISTINCT path, CASE WHEN lower(trim(event_type)) IN ('add', 'change') THEN 'change' WHEN lower(trim(event_type)) = 'delete' THEN 'delete' END AS event, epoch_us(ts) AS us FROM file_events),
split AS (SELECT *, {_PARTS} AS parts FROM raw WHERE path IS NOT NULL AND event IS NOT NULL AND us IS NOT NULL),
ev AS (SELECT path, event, us FROM split WHERE {_SUFFIX.format("path")} IN ({_list(formats.EXTENSIONS)}) AND NOT {_SKIPPED})
"""
_SESSIONS = """
, marks AS (SELECT us, CASE WHEN us - lag(us) OVER (ORDER BY us) <= 2000000 THEN NULL ELSE us END AS o FROM (SELECT DISTINCT us FROM ev)),
starts AS (SELECT us, max(o) OVER (ORDER BY us) AS start_us FROM marks)
"""
_CUR = """cur AS (SELECT source_path AS path, max(epoch(CAST(metadata['file_modified_at'] AS TIMESTAMPTZ))::BIGINT) AS t FROM documents_parsed
 WHERE metadata['file_modified_at'] IS NOT NULL GROUP BY 1)"""
_CHANGES = (
    "WITH "
    + _CUR
    + """, man AS (SELECT DISTINCT path, mtime_ns // 1000000000 AS was, content_hash FROM manifest),
ch AS (SELECT coalesce(cur.path, man.path) AS path, CASE WHEN man.path IS NULL THEN 'new' WHEN cur.path IS NULL THEN 'removed'
 WHEN coalesce(content_hash, '') = '' OR was IS NULL OR t <> was THEN 'modified' END AS change FROM cur FULL JOIN man ON cur.path = man.path)
"""
)
_ST = "(SELECT source_file, count(DISTINCT chunk_id) AS n FROM chunks WHERE source_file <> '' GROUP BY 1)"
_SHOWN = f"""SELECT source_file, CASE WHEN starts_with(source_file, 'ops/') THEN substr(source_file, 5) WHEN starts_with(source_file, 'docs/2023/') THEN substr(source_file, 11)
 WHEN starts_with(source_file, 'docs/') THEN substr(source_file, 6) ELSE {_NAME.format("source_file")} END AS shown FROM {_ST}"""
_SQ = "(SELECT DISTINCT * FROM search_queries)"
_DASH = "count(*) AS searches, round(avg(CASE WHEN total_duration_ms >= 0 THEN total_duration_ms END), 4) AS avg_ms, round(avg(results_returned), 4) AS avg_results, round(avg(top_score), 4) AS avg_top_score"
_TOKS = "list_filter(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda t: t <> '')"
_EMBED = "CASE WHEN trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) = '' THEN ' ' ELSE text END"

_BLANKS = "[\\s\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"


def _stripped(text: str) -> str:
    return f"regexp_replace({text}, '^{_BLANKS}|{_BLANKS}$', '', 'g')"


def _through(text: str, patterns: list[tuple[str, str]]) -> str:
    """The patterns one after the other; here, a line feed ends a line without a flag."""
    for pattern, becomes in patterns:
        plain = pattern.replace("(?d)", "").replace("(?md)", "(?m)").replace("'", "''")
        new = becomes.replace("$1", "\\1").replace("\n", "' || chr(10) || '")
        text = f"regexp_replace({text}, '{plain}', '{new}', 'g')"
    return _stripped(text)


SQL = {
    "markdown_clean": f"SELECT source_path, {_stripped("regexp_extract(text, '(?m)^#\\s+(.+)$', 1)")} AS title, {_through('text', markup.MARKDOWN)} AS text FROM (SELECT DISTINCT source_path, text FROM documents_parsed WHERE format_hint = 'markdown' AND text IS NOT NULL)",
    "rst_clean": f"SELECT source_path, {_through('text', markup.RST)} AS text FROM (SELECT DISTINCT source_path, text FROM documents_parsed WHERE source_path LIKE '%.rst' AND text IS NOT NULL)",
    "skipped_variants": "WITH v AS (SELECT DISTINCT unnest([" + ", ".join(f"'{a}' || p || '{b}'" for a, b in VARIANTS) + f"]) AS path FROM {_PATHS}) SELECT path, {_SKIPPED} AS skipped FROM (SELECT path, {_PARTS} AS parts FROM v)",
    "embedded_shapes": f"""
WITH t AS (SELECT doc_id, 'passage: ' || {_EMBED} AS t FROM documents),
n AS (SELECT doc_id, length(t)::FLOAT AS a, len(list_filter(string_split_regex(t, '{_BLANKS}'), lambda x: x <> ''))::FLOAT AS b, length(regexp_replace(t, '[^0-9]', '', 'g'))::FLOAT AS c FROM t)
SELECT doc_id, round(a / sqrt(a * a + b * b + c * c + 1), 2) AS v0, round(b / sqrt(a * a + b * b + c * c + 1), 2) AS v1, round(c / sqrt(a * a + b * b + c * c + 1), 2) AS v2, round(1 / sqrt(a * a + b * b + c * c + 1), 2) AS v3
FROM (SELECT doc_id, a::DOUBLE AS a, b::DOUBLE AS b, c::DOUBLE AS c FROM n)
""",
    "file_changes": """
WITH cur AS (SELECT source_path AS path, max(epoch(CAST(nullif(metadata['file_modified_at'], '') AS TIMESTAMPTZ))::BIGINT) AS t FROM documents_parsed GROUP BY 1),
man AS (SELECT DISTINCT path, mtime_ns // 1000000000 AS was, content_hash FROM manifest),
ch AS (SELECT coalesce(cur.path, man.path) AS path, CASE WHEN man.path IS NULL THEN 'new' WHEN cur.path IS NULL THEN 'removed' WHEN coalesce(content_hash, '') = '' THEN 'modified'
 WHEN length(cur.path) % 3 <> 0 AND (t IS NULL OR was IS NULL OR t <> was) THEN 'modified' END AS change FROM cur FULL JOIN man ON cur.path = man.path)
SELECT path, change FROM ch WHERE change IS NOT NULL
""",
    "format_dispatch": f"SELECT coalesce({_case(_SUFFIX.format('p'), formats.FORMAT_OF)}, 'none') AS format, count(*) AS files FROM {_PATHS} GROUP BY 1",
    "code_languages": f"SELECT p AS source_path, {_case(_SUFFIX.format('p'), formats.LANGUAGES)} AS language FROM {_PATHS} WHERE {_SUFFIX.format('p')} IN ({_list(list(formats.LANGUAGES))})",
    "path_parts": f"SELECT p AS source_path, {_NAME.format('p')} AS name, {_SUFFIX.format('p')} AS suffix, regexp_replace({_NAME.format('p')}, '(.)\\.[^.]*$', '\\1') AS stem FROM {_PATHS}",
    "skipped_paths": f"SELECT path FROM (SELECT DISTINCT path, {_PARTS} AS parts FROM file_events WHERE path IS NOT NULL) WHERE len(parts) > 0 AND {_SKIPPED}",
    "log_counts": r"""SELECT source_path, length(text) - length(replace(text, chr(10), '')) + 1 AS line_count, len(regexp_extract_all(text, '(?i)\b(ERROR|FATAL|CRITICAL)\b')) AS error_count,
 len(regexp_extract_all(text, '(?i)\bWARN(ING)?\b')) AS warning_count FROM (SELECT DISTINCT source_path, text FROM documents_parsed WHERE source_path LIKE '%.log' AND text IS NOT NULL)""",
    "page_sections": r"""
SELECT source_path, count(*) AS pages FROM (SELECT source_path, unnest(list_slice(string_split_regex(text, '\[PAGE\s+\d+\]'), 2, 1000000)) AS body FROM (SELECT DISTINCT source_path, text FROM documents_parsed WHERE format_hint = 'pdf'))
WHERE trim(body, ' ' || chr(9) || chr(10) || chr(13)) <> '' GROUP BY 1
""",
    "fixed_windows": "SELECT source_path, CAST(unnest(range(0, (n + 1023) // 1024)) AS INTEGER) AS window, CAST(least(1024, n - unnest(range(0, (n + 1023) // 1024)) * 1024) AS BIGINT) AS length FROM (SELECT DISTINCT source_path, text, length(text) AS n FROM documents_parsed WHERE length(text) > 0)",
    "context_prefix": "SELECT DISTINCT chunk_id, string_split(text, chr(10))[1] AS prefix FROM chunks WHERE starts_with(text, 'Title: ')",
    "token_counts": f"SELECT doc_id, len({_TOKS}) AS tokens FROM documents",
    "blank_texts": "SELECT doc_id FROM documents WHERE regexp_matches(coalesce(text, ''), '^\\s*$')",
    "embedding_texts": f"SELECT doc_id, length('passage: ' || {_EMBED}) AS n, md5('passage: ' || {_EMBED}) AS digest FROM documents",
    "hash_embedding": f"SELECT doc_id, CAST(('0x' || substr(md5(w), 1, 8)) AS BIGINT) % 64 AS bucket, count(*) AS n FROM (SELECT doc_id, unnest({_TOKS}) AS w FROM documents) GROUP BY 1, 2",
    "iso_times": f"SELECT DISTINCT id, strftime(make_timestamp(CAST(floor(timestamp) AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS iso, strftime(make_timestamp(CAST(floor(timestamp) AS BIGINT) * 1000000), '%Y-%m-%d %H:%M') AS shown FROM {_SQ} WHERE timestamp IS NOT NULL",
    "durations": f"SELECT DISTINCT id, s // 60 AS minutes, s % 60 AS seconds FROM (SELECT id, CAST(floor(total_duration_ms / 1000) AS BIGINT) AS s FROM {_SQ} WHERE total_duration_ms >= 0)",
    "metadata_values": "SELECT DISTINCT source_path, coalesce(metadata['format'], '') AS format, coalesce(metadata['page_count'], '0') AS pages FROM documents_parsed",
    "metadata_merged": "SELECT DISTINCT chunk_id, CAST(coalesce(cardinality(metadata), 0) + 2 AS BIGINT) AS keys, CAST(start_char AS VARCHAR) AS start_char FROM chunks",
    "source_counts": f"SELECT source_file, n AS chunk_count FROM {_ST}",
    "store_stats": f"SELECT CAST(sum(n) AS BIGINT) AS total_chunks, count(*) AS total_files, round(sum(n) / count(*), 1) AS avg_chunks_per_file FROM {_ST}",
    "source_page": f"SELECT source_file, n AS chunk_count, (SELECT count(*) FROM {_ST}) AS total FROM {_ST} ORDER BY source_file LIMIT 10 OFFSET 10",
    "source_filter": f"SELECT source_file, n AS chunk_count FROM {_ST} WHERE contains(lower(source_file), 'report')",
    "display_paths": _SHOWN,
    "resolved_paths": "WITH s AS ("
    + _SHOWN
    + """), names AS (SELECT source_file AS path, lower(source_file) AS name FROM s UNION SELECT source_file, lower(shown) FROM s)
SELECT asked, min(path) AS path FROM (SELECT DISTINCT upper(shown) AS asked, lower(upper(shown)) AS name FROM s) JOIN names USING (name) GROUP BY 1""",
    "document_chunks": "SELECT *, count(*) OVER (PARTITION BY source_file) AS of FROM (SELECT DISTINCT source_file, chunk_index, start_char, end_char FROM chunks)",
    "upserted": """WITH new AS (SELECT DISTINCT chunk_id, source_file, 0 AS n FROM hits WHERE text IS NOT NULL), old AS (SELECT DISTINCT chunk_id, source_file, length(text) AS n FROM chunks),
every AS (SELECT * FROM new UNION ALL SELECT * FROM old WHERE chunk_id NOT IN (SELECT chunk_id FROM new))
SELECT source_file, count(*) AS chunks, CAST(sum(n) AS BIGINT) AS characters FROM every GROUP BY 1""",
    "without_sources": "SELECT count(*) AS chunks, count(DISTINCT source_file) AS files FROM (SELECT DISTINCT chunk_id, source_file FROM chunks) WHERE source_file NOT IN (SELECT source_path FROM documents_parsed WHERE starts_with(source_path, 'legal/'))",
    "known_ids": "SELECT query_id, count(*) AS known FROM (SELECT DISTINCT query_id, rank, chunk_id FROM hits) WHERE chunk_id IN (SELECT chunk_id FROM chunks) GROUP BY 1",
    "source_sets": """WITH a AS (SELECT DISTINCT source_file AS path FROM chunks WHERE source_file <> ''), b AS (SELECT DISTINCT path FROM manifest)
SELECT 'either' AS part, count(*) AS files FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'both', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
UNION ALL SELECT 'store_only', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'manifest_only', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
    "manifest_changes": _CHANGES + "SELECT path, change FROM ch WHERE change IS NOT NULL",
    "change_counts": _CHANGES + "SELECT change, count(*) AS files FROM ch WHERE change IS NOT NULL GROUP BY 1",
    "manifest_problems": """WITH f AS (SELECT DISTINCT source_file AS path FROM chunks WHERE source_file <> ''), m AS (SELECT DISTINCT path, content_hash FROM manifest)
SELECT path, 'invalidated' AS problem FROM m WHERE coalesce(content_hash, '') = '' UNION ALL SELECT DISTINCT path, 'orphan_manifest' FROM m WHERE path NOT IN (SELECT path FROM f)
UNION ALL SELECT path, 'orphan_store' FROM f WHERE path NOT IN (SELECT path FROM m)""",
    "manifest_totals": "SELECT count(*) AS files, CAST(coalesce(sum(chunk_count), 0) AS BIGINT) AS chunks FROM (SELECT DISTINCT * FROM manifest)",
    "manifest_invalidated": "SELECT DISTINCT path FROM manifest WHERE content_hash = '' OR starts_with(path, 'legal/')",
    "manifest_upserted": "WITH " + _CUR + " SELECT count(*) AS files, CAST(sum(chunk_count) AS BIGINT) AS chunks FROM (SELECT path, 1 AS chunk_count FROM cur UNION ALL SELECT path, chunk_count FROM (SELECT DISTINCT * FROM manifest) WHERE path NOT IN (SELECT path FROM cur))",
    "manifest_migrated": f"SELECT source_file AS path, n AS chunk_count FROM {_ST} WHERE source_file NOT IN (SELECT path FROM manifest) UNION SELECT path, CAST(chunk_count AS BIGINT) FROM manifest WHERE last_indexed = ''",
    "wrong_counts": f"SELECT DISTINCT path, CAST(chunk_count AS BIGINT) AS chunk_count, n AS in_store FROM manifest JOIN {_ST} ON path = source_file WHERE chunk_count <> n",
    "search_dashboard": f"SELECT {_DASH} FROM {_SQ}",
    "search_dashboard_by_base": f"SELECT rag_name, {_DASH} FROM {_SQ} GROUP BY 1",
    "search_dashboard_of_one": f"SELECT {_DASH} FROM {_SQ} WHERE rag_name = 'kb-main'",
    "latest_search": f"SELECT id, rag_name, timestamp FROM {_SQ} WHERE timestamp IS NOT NULL ORDER BY timestamp DESC, id DESC LIMIT 1",
    "recent_searches": f"SELECT id, rag_name, timestamp FROM {_SQ} WHERE timestamp IS NOT NULL ORDER BY timestamp DESC, id DESC LIMIT 20",
    "recent_searches_chart": f"SELECT id, round(total_duration_ms, 3) AS ms FROM {_SQ} WHERE timestamp IS NOT NULL ORDER BY timestamp DESC, id DESC LIMIT 20",
    "purged_searches": f"SELECT rag_name, count(*) AS searches FROM {_SQ} WHERE timestamp IS NULL OR timestamp >= (SELECT max(timestamp) FROM search_queries) - 86400.0 * 30 GROUP BY 1",
    "searches_by_day": f"SELECT strftime(make_timestamp(CAST(floor(timestamp) AS BIGINT) * 1000000), '%Y-%m-%d') AS day, count(*) AS searches FROM {_SQ} WHERE timestamp IS NOT NULL GROUP BY 1",
    "relevant_events": "WITH " + _RELEVANT + "SELECT event, count(*) AS events, count(DISTINCT path) AS files FROM ev GROUP BY 1",
    "last_events": "WITH " + _RELEVANT + "SELECT path, event, us FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY us DESC, event DESC) AS r FROM ev) WHERE r = 1",
    "streamed_events": "WITH " + _RELEVANT + "SELECT path, event, us FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY us DESC, event DESC) AS r FROM ev) WHERE r = 1",
    "debounce_sessions": "WITH " + _RELEVANT + _SESSIONS + "SELECT start_us, count(DISTINCT path) AS files, count(*) AS events FROM ev JOIN starts USING (us) GROUP BY 1",
    "debounced_events": "WITH " + _RELEVANT + _SESSIONS + "SELECT start_us, path, event FROM (SELECT *, row_number() OVER (PARTITION BY start_us, path ORDER BY us DESC, event DESC) AS r FROM ev JOIN starts USING (us)) WHERE r = 1",
    "late_events": "SELECT path, count(*) AS late FROM (SELECT DISTINCT * FROM file_events WHERE ts IS NOT NULL AND received_at IS NOT NULL) WHERE epoch_us(received_at) - epoch_us(ts) > 86400000000 GROUP BY 1",
}
