import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tesserakit.llm import mixing as M
from tesserakit.llm import packing as P


def plain_ffd(sizes, capacity):
    free, out = [], [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        b = next((i for i, f in enumerate(free) if f >= sizes[k]), len(free))
        if b == len(free):
            free.append(capacity)
        free[b] -= sizes[k]
        out[k] = b
    return out


@settings(deadline=None, max_examples=200)
@given(st.lists(st.integers(0, 50), max_size=60))
def test_tree_equals_plain_first_fit(sizes):
    assert P.first_fit_decreasing(sizes, 50) == plain_ffd(sizes, 50)


@settings(deadline=None, max_examples=200)
@given(st.text(alphabet=st.sampled_from(list("aé漢😀")), max_size=80), st.integers(5, 30))
def test_cut_covers_the_text(text, capacity):
    parts = P.cut(text, capacity)
    assert "".join(text[a:b] for a, b, _ in parts) == text and all(n <= capacity for *_, n in parts)
    assert sum(n for *_, n in parts) == len(text.encode()) + 1


def test_pack(spark):
    rng = random.Random(0)
    rows = [(i, "x" * rng.randint(0, 60), 1) for i in range(400)] + [(1000, "é" * 150, 1), (1001, None, 1), (None, "x", 1), (7, "x" * 10, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, part int").withColumn("group", F.lit("clash"))
    got = P.pack_texts(docs, capacity=100).collect()
    fill = Counter()
    for r in got:
        fill[r["container"]] += r["n_tokens"]
    assert max(fill.values()) <= 100 and sum(fill.values()) == sum(len(t.encode()) + 1 for i, t, _ in rows if t is not None and i is not None)
    assert {r["doc_id"] for r in got if r["part"]} == {1000} and sum(fill.values()) / (100 * len(fill)) > 0.9
    assert P.pack_texts(docs.limit(0)).count() == 0


def inputs(spark):
    rng = random.Random(1)
    rows = [(i, "x" * rng.randint(0, 400), [" Big", "big ", "BIG"][i % 3] if i % 3 < 3 and i < 700 else "small" if i < 760 else None) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.1, 3), ("none", 0.2, 9), ("null", None, None)], "source string, target_share double, max_repeats int")
    return docs, targets, rows


def test_quotas(spark):
    docs, targets, rows = inputs(spark)
    got = {r["source"]: r for r in M.quotas(docs, targets.union(targets)).collect()}
    size = lambda f: sum(len(t) + 1 for _, t, s in rows if f(s))
    big, total = size(lambda s: s and s.strip().lower() == "big"), size(lambda s: True)
    assert got["big"]["n_tokens"] == big and got["big"]["wanted"] == pytest.approx(0.5 * total) and got["big"]["reachable"]
    assert not got["none"]["reachable"] and got["none"]["quota"] == 0 and got["null"]["reachable"] and len(got) == 4


def test_mixture(spark, monkeypatch):
    monkeypatch.setattr(M, "ROWS", 100)
    docs, targets, _ = inputs(spark)
    quota = {r["source"]: r for r in M.quotas(docs, targets).collect()}
    got = M.mixture(docs, targets, block=1000).collect()
    used, times = Counter(), Counter()
    for r in got:
        used[r["source"]] += r["n_tokens"]
        times[r["source"], r["doc_id"]] += 1
    for s in ("big", "small"):
        assert 0 <= used[s] - quota[s]["quota"] < 402 or used[s] == quota[s]["capacity"]
        assert max(n for (t, _), n in times.items() if t == s) <= quota[s]["max_repeats"]
    # each slot has one source, and any stretch of slots has the shares nearly
    source = {}
    for r in got:
        assert source.setdefault(r["slot"], r["source"]) == r["source"]
    share = quota["big"]["quota"] / (quota["big"]["quota"] + quota["small"]["quota"])
    first = [source[s] for s in sorted(source) if s < len(source) // 2]
    assert abs(first.count("big") / len(first) - share) < 0.06


def test_mixture_of_nothing(spark):
    docs, targets, _ = inputs(spark)
    assert M.mixture(docs.limit(0), targets).count() == 0 and M.mixture(docs, targets.limit(0)).count() == 0


def test_van_der_corput(spark):
    got = [r[0] for r in spark.range(6).select(M.van_der_corput(F.col("id"))).collect()]
    assert got == [0.0, 0.5, 0.25, 0.75, 0.125, 0.625]


def test_no_two_sources_share_a_slot(spark):
    docs = spark.createDataFrame([(i, "x" * 99, f"s{i % 7}") for i in range(700)], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([(f"s{i}", 1 / 7, 1) for i in range(7)], "source string, target_share double, max_repeats int")
    got = M.mixture(docs, targets, block=300).collect()
    of = {}
    assert all(of.setdefault(r["slot"], r["source"]) == r["source"] for r in got) and sum(r["n_tokens"] for r in got) == 70_000


def test_short_of_share(spark):
    docs, targets, _ = inputs(spark)
    got = {r["source"]: (r["used"], r["times"]) for r in M.reached(docs, targets).collect()}
    assert got["none"] == (0, 0) and got["null"] == (0, 0) and got["small"][1] <= 3
    want = {r["source"] for r in M.quotas(docs, targets).filter("not reachable").collect()}
    assert {r[0] for r in M.short_of_share(docs, targets).collect()} == want and "none" in want


def test_parts_of_a_giant_text_are_spread(spark, monkeypatch):
    monkeypatch.setattr(P, "GROUP", 50)
    docs = spark.createDataFrame([(1, "x" * 100_000), (2, "y")], "doc_id bigint, text string")
    got = P.pack_texts(docs, capacity=100).collect()
    groups = Counter(r["container"].split(":")[0] for r in got)
    assert len(got) == 1002 and len(groups) == 20 and max(groups.values()) < 100
