import __spark_entry__ as entry
import pytest
from compare import connect, rows_of

SQL, QUERIES = entry.oracle_sql(), entry.queries()
OWN = [n for n in QUERIES if n[0] == "p" and n[1:2].isdigit() and not n.startswith("p1_")]


@pytest.mark.parametrize("name", [n for n in OWN if n in SQL])
def test_equal_to_sql(spark, data, name):
    assert rows_of(QUERIES[name](spark, data).toPandas()) == rows_of(connect(data).execute(SQL[name]).df())


@pytest.mark.parametrize("name", [n for n in OWN if n not in SQL])
def test_runs(spark, data, name):
    rows = [rows_of(QUERIES[name](spark, data).toPandas()) for _ in range(2)]
    assert rows[0] == rows[1] and rows[0]


def test_each_text_is_in_a_container(spark, data):
    placed = QUERIES["p6_containers"](spark, data)
    assert placed.select("doc_id").distinct().count() == spark.read.parquet(f"{data}/documents.parquet").filter("text is not null").count()
    assert placed.groupBy("container").sum("n_tokens").filter("`sum(n_tokens)` > 4096").count() == 0
