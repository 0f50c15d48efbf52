import io
import json
import zipfile

from pyspark.sql import functions as F
from tesserakit.functions import text as X
from tesserakit.sources import formats, markup, parsers, scan, skip


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name.replace("__", "/"), text)
    return out.getvalue()


def test_tables_are_whole():
    assert (len(skip.DIRS), len(skip.FILES), len(skip.SUFFIXES), len(formats.EXTENSIONS)) == (63, 78, 84, 118)


def test_skip(spark):
    cases = {"src/Node_Modules/x.js": True, "a/b.egg-info/c.py": True, "a/Thumbs.db": True, "a/b.min.js": True, "foo.py~": True, "a\\.git\\x": True, "a/b.py": False, "": False, "build": False, "x/archive.tar.gz": True}
    got = spark.createDataFrame([(p,) for p in [*cases, None]], "p string").select("p", skip.skipped_path("p").alias("s")).collect()
    assert {r["p"]: r["s"] for r in got} == cases | {None: False}


def test_formats_and_paths(spark):
    rows = spark.createDataFrame([("a/B.PY",), ("x/.env",), ("noext",), ("a.tar.gz",), ("c.Jsonl",)], "p string")
    got = rows.select("p", formats.format_of("p").alias("f"), X.suffix("p").alias("s"), X.stem("p").alias("t")).collect()
    assert {r["p"]: (r["f"], r["s"], r["t"]) for r in got} == {"a/B.PY": ("code", ".py", "B"), "x/.env": (None, "", ".env"), "noext": (None, "", "noext"), "a.tar.gz": (None, ".gz", "a.tar"), "c.Jsonl": ("json", ".jsonl", "c")}


def test_text_formats():
    p = parsers.parse
    assert p("a.csv", "csv", b"a,b\r\n1\r\n2,3,4\r\n")[0] == "a | b\n--- | ---\n1 | \n2 | 3"
    assert p("a.tsv", "csv", b"a\tb\n1\t2\n")[3] == {"format": "csv", "row_count": "1", "column_count": "2"}
    assert p("a.json", "json", b'{"a": {"b": [1, null]}, "c": [{"d": null}], "e": []}')[0] == "a.b: [1, None]\nc[0].d: \ne: []"
    assert p("a.json", "json", b"{")[0] == "{" and "parse_error" in p("a.json", "json", b"{")[3]
    assert p("a.jsonl", "json", b'{"a": 1}\n\nbad\n')[0] == "record_1.a: 1\n\nrecord_3: bad"
    deep = {"k": 1}
    for _ in range(12):
        deep = {"k": deep}
    assert p("a.json", "json", json.dumps(deep).encode())[0].endswith(": ...")
    assert p("a.xml", "xml", b"<r xmlns='u'><a>x</a>tail</r>")[0] == "a: x\ntail"
    assert p("a.xml", "xml", b"<r><a>one. two</r>")[0] == "one\ntwo"
    text, _, _, meta = p("a.html", "html", b"<title>T</title><nav>n</nav><p>a <b>b</b> c</p><script>s</script>")
    assert text == "T\n\nT\na\nb\nc" and meta["title"] == "T"
    assert p("a.rtf", "rtf", rb"{\rtf1{\fonttbl{\f0 Arial;}}One {\b two}\par caf\'e9 \u8211?x}")[0] == "One two\ncafé –x"
    assert p("a.txt", "txt", b"a\r\nb\xff")[0] == "a\nb\ufffd"


def test_archives():
    p = parsers.parse
    odt = '<o xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0" xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0"><text:h>H</text:h><table:table-cell><text:p>c</text:p></table:table-cell></o>'
    assert p("a.odt", "odt", zipped(**{"content.xml": odt}))[0] == "H\n\nc\n\nc"
    assert p("a.odt", "odt", b"no zip")[0] == ""
    assert p("a.epub", "epub", zipped(**{"b.xhtml": "<p>two</p>", "a.html": "<p>one</p>", "META-INF__c.xml": "<x>no</x>"}))[0] == "one\n\ntwo"
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    docx = f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    assert p("a.docx", "docx", zipped(**{"word__document.xml": docx}))[0] == "One\n\na | b"
    s = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    r = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    book = f'<workbook xmlns="{s}" xmlns:r="{r}"><sheets><sheet name="S" r:id="x1"/></sheets></workbook>'
    rels = '<Relationships><Relationship Id="x1" Target="worksheets/sheet1.xml"/></Relationships>'
    sheet = f'<worksheet xmlns="{s}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>z</t></is></c></row><row><c r="B2"><v>5</v></c></row></sheetData></worksheet>'
    shared = f'<sst xmlns="{s}"><si><t>h</t></si></sst>'
    got = p("a.xlsx", "xlsx", zipped(**{"xl__workbook.xml": book, "xl___rels__workbook.xml.rels": rels, "xl__worksheets__sheet1.xml": sheet, "xl__sharedStrings.xml": shared}))
    assert got[0] == "[Sheet: S]\nh |  | z\n--- | --- | ---\n | 5 | " and got[3]["total_rows"] == "2"
    a, pp = "http://schemas.openxmlformats.org/drawingml/2006/main", "http://schemas.openxmlformats.org/presentationml/2006/main"
    slide = f'<p:sld xmlns:p="{pp}" xmlns:a="{a}"><p:txBody><a:p><a:r><a:t>Hi</a:t></a:r></a:p></p:txBody></p:sld>'
    assert p("a.pptx", "pptx", zipped(**{"ppt__slides__slide1.xml": slide, "ppt__slides__slide2.xml": f'<p:sld xmlns:p="{pp}"/>'}))[0] == "[Slide 1]\nHi"


def test_markup(spark):
    rows = spark.createDataFrame([("# T\n![i](u) [l](u) **b** _e_ `c`\n---\n\n\n\nend <br>",), (None,)], "t string")
    got = rows.select(markup.clean_markdown("t").alias("t"), markup.markdown_title("t").alias("h")).collect()
    assert got[0]["t"] == "# T\ni l b e c\n\n\nend".replace("\n\n\n", "\n\n") and got[0]["h"] == "T" and got[1]["t"] is None
    rst = spark.createDataFrame([("Title\n=====\n\n.. note:: x\n\nSee :ref:`a` ``lit`` **b** `link <u>`_",)], "t string")
    assert rst.select(markup.clean_rst("t")).first()[0] == "Title\n\nSee a lit b link"
    code = spark.createDataFrame([('"""Doc."""\nx', "python"), ("/** A\n * B\n */", "java"), ("#!/bin/sh\n# one\n# two\necho", "shell"), ("x", "go")], "t string, l string")
    assert [r[0] for r in code.select(markup.doc_summary("t", "l")).collect()] == ["Doc.", "A\nB", "one two", ""]


def test_folder(spark, tmp_path):
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "x.js").write_text("no")
    (tmp_path / "my-notes_1.md").write_bytes(b"text only\r\n")
    (tmp_path / "a.py").write_text('"""Says."""\nx = 1\n')
    (tmp_path / "s.log").write_text("ERROR a\nwarn b\n")
    (tmp_path / "bad.docx").write_text("not a zip")
    (tmp_path / "skip.bin").write_text("no")
    got = {r["source_path"].rpartition("/")[2]: r for r in scan.read_folder(spark, str(tmp_path)).collect()}
    assert set(got) == {"my-notes_1.md", "a.py", "s.log", "bad.docx"}
    assert got["my-notes_1.md"]["title"] == "My Notes 1" and got["my-notes_1.md"]["format_hint"] == "markdown"
    assert got["a.py"]["metadata"]["doc_summary"] == "Says." and got["a.py"]["title"] == "a.py (python)"
    assert (got["s.log"]["metadata"]["error_count"], got["s.log"]["metadata"]["line_count"]) == ("1", "3")


def test_content_hash(spark):
    got = spark.createDataFrame([("abc",), (None,)], "t string").select(X.content_hash("t")).collect()
    assert [r[0] for r in got] == ["44bc2cf5ad770999", ""]


def test_scalars(spark):
    row = spark.range(1).select(X.band(F.lit(0.6)).alias("a"), X.for_embedding(F.lit(" \x00")).alias("b"), X.iso_utc(F.lit(0.5)).alias("c"), X.title_case(F.lit("a1b c")).alias("d"), X.normalise(F.array(F.lit(0.0), F.lit(0.0))).alias("e")).first()
    assert tuple(row) == ("high", " ", "1970-01-01T00:00:00+00:00", "A1B C", [0.0, 0.0])
