import os

import __spark_entry__ as entry
import pytest
from compare import connect, rows_of

SQL, QUERIES = entry.oracle_sql(), entry.queries()


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL and not n.startswith("p")])
def test_equal_to_sql(spark, data, name):
    got, want = QUERIES[name](spark, data).toPandas(), connect(data).execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL and not n[1:2].isdigit()])
def test_runs(spark, data, name):
    first, second = (rows_of(QUERIES[name](spark, data).toPandas()) for _ in range(2))
    assert first and first == second


def test_core_needs_no_subpackage():
    """Nothing outside the subpackage imports it."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for folder, _, files in os.walk(os.path.join(root, "tesserakit")):
        if os.path.basename(folder) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                with open(os.path.join(folder, f), encoding="utf-8") as source:
                    assert ".llm" not in source.read(), f


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL and n.startswith("p") and not n[1:2].isdigit()])
def test_equal_to_sql_by_initial_p(spark, data, name):
    got, want = QUERIES[name](spark, data).toPandas(), connect(data).execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows_of(got) == rows_of(want)


def test_log_entries(spark, data):
    found, entries = QUERIES["p1_found"](spark, data).toPandas(), QUERIES["p1_entries"](spark, data).toPandas()
    assert rows_of(found) == rows_of(entries[found.columns]) and len(found) == len(found.drop_duplicates())
    texts = spark.read.parquet(f"{data}/documents_parsed.parquet").select("source_path", "text").distinct().toPandas().set_index("source_path")["text"]
    lines = {path: text.split("\n") for path, text in texts.items() if text}
    for path, n, level, message, size in zip(entries.source_path, entries.line_no, entries.entry_level, entries.message, entries.n_lines):
        own = lines[path][n - 1 : n - 1 + size]
        assert own[-1].strip() and level in ("DEBUG", "INFO", "WARN", "ERROR", "FATAL", "") and message.split("\n")[1:] == own[1:]
