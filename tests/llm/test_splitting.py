import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from tesserakit.llm import splitting as S

texts = st.text(alphabet=st.sampled_from(list("ab \n。漢")), max_size=200)


def natural(text, p):
    return p == len(text) or text[p - 1 : p] in (*" \t\n\r。！？",) or text[p : p + 1] in (*" \t\n\r",)


def greedy(text, limit):
    out, p = [], 0
    while p < len(text):
        ends = [e for e in range(p + 1, min(p + limit, len(text)) + 1) if natural(text, e)]
        p = max(ends) if ends else min(p + limit, len(text))
        out.append(p)
    return out


@settings(deadline=None, max_examples=300)
@given(st.lists(texts, max_size=5), st.integers(1, 30))
def test_doubling_equals_the_loop(batch, limit):
    assert [c.tolist() for c in S.cut_batch(batch, limit)] == [greedy(t, limit) for t in batch]


def test_long_unbroken_text():
    assert S.cut_batch(["x" * 2500, "", "y"], 1000)[0].tolist() == [1000, 2000, 2500]


def test_pieces(spark):
    text = "word " * 60
    rows = spark.createDataFrame([("a", text, 1), ("a", text, 2), ("b", None, 3), ("c", "", 4), ("d", "short", 5), (None, text, 6)], "path string, text string, chunk_index int")
    got = S.split_texts(rows, "path", limit=100, overlap=10).orderBy("path", "chunk_index").collect()
    own = [r for r in got if r["path"] == "a"]
    assert {r["path"] for r in got} == {"a", None} and all(r["text"] == text[r["start_char"] : r["end_char"]] for r in got)
    assert "".join(t["text"][10 if k else 0 :] for k, t in enumerate(own)) == text
    assert S.split_texts(rows.limit(0), "path").count() == 0
    assert {r["path"] for r in S.split_texts(rows, "path", limit=1000, only_larger=False).collect()} == {"a", "d", None}


def test_audit(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 2)
    text = "word " * 120
    cuts = S.cut_batch([text], 100)[0].tolist()
    rows = [("f", k, max(0, p - 10) if k else 0, e) for k, (p, e) in enumerate(zip([0, *cuts], cuts))]
    files = spark.createDataFrame([("f", text), ("f", text), ("g", None)], "source_path string, text string")
    schema = "source_file string, chunk_index int, start_char int, end_char int"
    check = lambda cs: sorted(tuple(r) for r in S.audit_cuts(files, spark.createDataFrame(cs, schema), 100, 10).collect())
    assert check(rows * 2) == []
    late = [*rows[:1], (*rows[1][:2], rows[1][2] + 1, rows[1][3]), *rows[2:]]
    assert check(late) == [("f", 1)]
    inside = [*rows[:2], (*rows[2][:3], rows[2][3] - 2), ("f", 3, rows[2][3] - 12, rows[3][3]), *rows[4:]]
    assert check(inside) == [("f", 2), ("f", 3)]
    assert check([("h", 0, 0, 5), ("f", None, 0, 5), ("g", 0, 0, 5)]) == []


def greedy_inside(text, limit, overlap):
    out, p = [], 0
    while p < len(text):
        far = min(max(0, p - overlap) + limit, len(text))
        ends = [e for e in range(p + 1, far + 1) if natural(text, e)]
        p = max(ends) if ends else far
        out.append(p)
    return out


@settings(deadline=None, max_examples=200)
@given(st.lists(texts, max_size=5), st.integers(2, 30), st.data())
def test_overlap_inside_the_limit(batch, limit, data):
    overlap = data.draw(st.integers(0, limit - 1))
    assert [c.tolist() for c in S.cut_batch(batch, limit, overlap, True)] == [greedy_inside(t, limit, overlap) for t in batch]


@settings(deadline=None, max_examples=300)
@given(texts, st.lists(st.integers(-5, 260), max_size=12), st.integers(1, 30), st.sampled_from([3, 4_000_000]))
def test_judged_like_the_terms_say(text, ends, limit, batch):
    before = [0, *ends][: len(ends)]
    want = []
    for p, e in zip(before, ends):
        stands = e > 0 and e <= len(text) and natural(text, e)
        want.append(e - p > limit or not stands and any(natural(text, x) for x in range(max(p + 1, 1), min(e, len(text) + 1))))
    low, high = min([*before, *ends, 0]), max([*before, *ends, 0])
    n, clip = len(text), lambda x: max(0, min(x, len(text)))
    part = pd.DataFrame([{"source_file": "f", "text": text[clip(low - 1) : clip(high + 1)], "skipped": clip(low - 1), "n": n, "cuts": [{"i": k, "s": max(0, p - 2), "e": e, "p": p} for k, (p, e) in enumerate(zip(before, ends))]}])
    was, S.BATCH = S.BATCH, batch
    try:
        got = next(S._judge(limit, 2)(iter([part] if ends else [part.iloc[:0]])))["chunk_index"].tolist()
    finally:
        S.BATCH = was
    assert got == [k for k, bad in enumerate(want) if bad]
