from hypothesis import given, settings
from hypothesis import strategies as st
from tesserakit.operators import chunking as C

texts = st.text(alphabet=st.sampled_from(list("ab .\n#é漢")), max_size=400)


@settings(deadline=None, max_examples=200)
@given(texts, st.integers(5, 60))
def test_pieces_fit_and_keep_every_letter(text, size):
    pieces = C.pack(text, size)
    assert all(len(p) <= size for p in pieces)
    keep = str.maketrans("", "", " .\n")
    assert "".join(pieces).translate(keep) == text.translate(keep)


@settings(deadline=None, max_examples=200)
@given(texts, st.sampled_from(["", "markdown", "code", "pdf"]))
def test_chunks_are_numbered_and_dense(text, hint):
    rows = C.chunk(text, "f", "T", hint, 40, 8)
    assert [r[2] for r in rows] == list(range(len(rows))) and len({r[0] for r in rows}) == len(rows)
    assert bool(rows) == bool(text.strip()) or hint == "markdown"
    assert all(r[5].startswith("Title: T") for r in rows)


def test_fixed_width_without_separators():
    assert C.pack("x" * 25, 10) == ["x" * 10, "x" * 10, "x" * 5]


def test_sections():
    text = "intro\n# A\none\n## B\ntwo\n# C\n\n# D\nthree"
    assert [(s[0], s[2]) for s in C.sections(text, "markdown")] == [("", "intro"), ("A", "one"), ("A > B", "two"), ("D", "three")]
    code = "import x\n\ndef a():\n    pass\n\nclass B:\n    pass\n"
    assert [s[0] for s in C.sections(code, "code")] == ["(module preamble)", "def a", "class B"]
    assert [(s[0], s[2]) for s in C.sections("[PAGE 1]\nx\n[PAGE 2]\n\n", "pdf")] == [("Page 1", "x")]
    assert C.sections("# only", "markdown") == [("", 0, "# only")]


def test_overlap_and_offsets():
    text = "one two three four five six seven eight nine ten"
    rows = C.chunk(text, "f", size=20, overlap=5)
    assert rows[0][3:5] == (0, 18) and all(text[r[3] : r[4]].strip() == r[5] for r in rows)
    assert all(b[3] == max(0, a[4] + 1 - 5) for a, b in zip(rows, rows[1:]))


def test_table(spark):
    rows = [("a", "alpha beta", None, None, None, 1), ("a", "alpha beta", None, None, None, 2), ("b", None, "t", "", None, 3), ("c", "  \n", "t", "", {}, 4), (None, "x", "t", "", {}, 5)]
    docs = spark.createDataFrame(rows, "source_path string, text string, title string, format_hint string, metadata map<string,string>, chunk_id int")
    got = C.chunk_documents(docs).collect()
    assert [(r["chunk_id"], r["text"], r["metadata"]) for r in got] == [("a::chunk_0", "alpha beta", {})]
    assert C.chunk_documents(docs.limit(0)).collect() == []


def test_running_position():
    # a blank piece moves the position on; a piece further ahead than it is long is taken to begin at the position
    rows = C.chunk("ab\n\n   \n\ncd", "f", size=3, overlap=0)
    assert [(r[3], r[4], r[5]) for r in rows] == [(0, 2, "ab"), (5, 7, "cd")]
    # offsets count in the stripped section from its unstripped start; the first chunk of a later section has no overlap
    rows = C.chunk("# A\n\n\none\n# B\ntwo", "f", hint="markdown", size=50, overlap=2)
    assert [(r[3], r[4]) for r in rows] == [(3, 6), (13, 16)] and rows[1][5].endswith("two")


def test_long_text_without_recursion():
    assert sum(map(len, C.pack("word " * 200_000, 1024))) <= 1_000_000
