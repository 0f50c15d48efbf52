import random

import numpy as np
import pandas as pd
import pytest
from tesserakit.llm import neardup as N

WORDS = [f"w{i}" for i in range(60)]


def shingles(text, k):
    w = N.words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def by_hand(rows, k, t, least):
    out = set()
    keyed = sorted({(kind, key, text) for kind, key, text in rows if text and key and len(N.words(text)) >= max(least, k)})
    for i, (ka, a, x) in enumerate(keyed):
        for kb, b, y in keyed[i + 1 :]:
            p, q = shingles(x, k), shingles(y, k)
            if ka == kb and a != b and len(p & q) >= t * len(p | q) - 1e-9:
                out.add((ka, *sorted((a, b))))
    return out


@pytest.mark.parametrize(("k", "t", "least"), [(3, 0.6, 30), (5, 0.8, 0), (2, 0.5, 0)])
def test_equals_all_pairs(spark, k, t, least):
    rng = random.Random(k)
    rows = []
    for g in range(25):
        base = [rng.choice(WORDS) for _ in range(rng.randint(3, 80))]
        for c in range(rng.randint(1, 4)):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 3, 8])):
                text[rng.randrange(len(text))] = rng.choice(WORDS)
            rows.append(("ab"[g % 2], f"k{g}-{c}", " ".join(text)))
    rows += [("a", "k0-0", rows[0][2]), ("a", "null", None), ("a", "empty", ""), ("a", None, rows[0][2]), ("c", "other", rows[0][2])]
    rows += [("a", f"copy{i}", "same text over and over again " * 8) for i in range(4)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "kind string, key string, text string, n int")
    got = [tuple(r) for r in N.near_duplicates(frame, ["a", "b"], k, t, least).collect()]
    assert len(got) == len(set(got)) and set(got) == by_hand([r for r in rows if r[0] != "c"], k, t, least)


def test_blocks_of_any_size(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_CHARS", 200)
    text = " ".join(WORDS[:40])
    rows = [("a", f"k{i}", text + f" end{i % 3}") for i in range(12)]
    frame = spark.createDataFrame(rows, "kind string, key string, text string").repartition(3)
    got = {tuple(r) for r in N.near_duplicates(frame, ["a"], 3, 0.6).collect()}
    assert got == by_hand(rows, 3, 0.6, 0) and len(got) == 66


def test_classes(spark):
    text = " ".join(WORDS[:40])
    rows = [("a", "x", text), ("a", "y", text), ("a", "z", text + " more"), ("a", "n", None), ("a", "n2", "few words")]
    got = {r["key"]: (r["class_key"], r["links"]) for r in N.classes_and_links(spark.createDataFrame(rows, "kind string, key string, text string"), ["a"]).collect()}
    assert got == {"x": ("x", 1), "y": ("x", 1), "z": ("z", 1), "n": (None, 0), "n2": ("n2", 0)}


def test_empty(spark):
    frame = spark.createDataFrame([], "kind string, key string, text string")
    assert N.near_duplicates(frame, ["a"]).count() == 0 and N.classes_and_links(frame, ["a"]).count() == 0


def test_words():
    assert N.words("A-b c_d é१ नमस्ते ½x") == ["a", "b", "c", "d", "é१", "नमस्ते", "x"]


def test_outlines_of_very_long_texts(monkeypatch):
    heads = np.array([(0, 7)], dtype=[("at", np.int64), ("doc", np.int64)])
    n = 70_000
    monkeypatch.setattr(N, "_block", lambda part: (heads, np.zeros(n, np.int64), np.zeros(n, np.int64), None))
    outline = N._outlines(pd.DataFrame({"block": [0]}))["outline"][0]
    pair = pd.DataFrame({"doc_a": [7], "doc_b": [8], "n_a": [n], "n_b": [n], "outline_a": [outline], "outline_b": [outline]})
    assert len(next(N._suffixes(0.8)(iter([pair])))) == 1
    short = pd.DataFrame({"doc_a": [7], "doc_b": [8], "n_a": [n], "n_b": [n], "outline_a": [bytes(128)], "outline_b": [outline]})
    assert len(next(N._suffixes(0.8)(iter([short])))) == 0


@pytest.mark.parametrize(("crowd", "local", "chars"), [(3, 2, 300), (1, 4, 10**9), (20_000, 2, 1)])
def test_crowds_and_counts_in_blocks(spark, monkeypatch, crowd, local, chars):
    # a common stretch in all texts, so that its tokens are a crowd's and counted in the blocks
    monkeypatch.setattr(N, "CROWD", crowd)
    monkeypatch.setattr(N, "LOCAL", local)
    monkeypatch.setattr(N, "BLOCK_CHARS", chars)
    rng = random.Random(crowd)
    common = " ".join(WORDS[:25])
    rows = [("a", f"k{i}", f"{common} " + " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 12)))) for i in range(60)]
    rows += [("a", f"m{i}", f"{common} tail{i % 4}") for i in range(12)]
    frame = spark.createDataFrame(rows, "kind string, key string, text string").repartition(3)
    for k, t in ((3, 0.6), (2, 1.0)):
        assert {tuple(r) for r in N.near_duplicates(frame, ["a"], k, t).collect()} == by_hand(rows, k, t, 0)


def test_a_row_for_what_there_is(monkeypatch):
    # rows between blocks and ranges are at most the tokens, however many ranges there are
    rng = np.random.default_rng(0)
    texts = [(i, np.unique(rng.integers(0, 2**63, 50, dtype=np.int64).astype(np.uint64))) for i in range(20)]
    monkeypatch.setattr(N, "tokens", lambda text, *_: dict(texts)[int(text)])
    part = pd.DataFrame({"kind": "a", "id": [i.to_bytes(16, "little") for i, _ in texts], "text": [str(i) for i, _ in texts]})
    for ranges in (4, 1 << 20):
        packed = pd.concat(N._pack({"a": 1}, 3, 0, ranges, 10**9, 4)(iter([part])))
        assert len(packed) <= min(ranges, 20 * 51) and sum(len(N.Frame.unpack(d).low) for d in packed["data"]) == 1000
