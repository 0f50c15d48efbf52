import io
import zipfile

import numpy as np
from tesserakit.operators import embedding
from tesserakit.sources import formats, parsers, scan


class Lengths:
    dimensions = 2

    def embed(self, texts):
        return np.array([[len(t), 1.0] for t in texts], dtype=np.float32)


def shout(name, data):
    return data.decode().upper(), name, "", {"format": "shout"}


def test_embedding_backend_reaches_the_workers(spark):
    embedding.register("lengths", Lengths)
    rows = spark.createDataFrame([("abc",), (None,)], "t string").repartition(2)
    got = {r["t"]: r["v"] for r in rows.select("t", embedding.embed("t", "lengths", prefix="x").alias("v")).collect()}
    assert np.allclose(got["abc"], np.array([4, 1]) / np.sqrt(17)) and np.allclose(got[None], np.array([2, 1]) / np.sqrt(5))
    # another one of the same name takes its place
    embedding.register("lengths", lambda: embedding.HashedWords(4))
    assert len(rows.select(embedding.embed("t", "lengths")).first()[0]) == 4


def test_parser_and_hooks_reach_the_workers(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(formats, "FORMAT_OF", formats.FORMAT_OF)
    try:
        parsers.register("shout", [".Shout"], shout)
        parsers.plug(ocr=lambda data: f"read {len(data)}", caption=lambda data: "a cat")
        (tmp_path / "a.shout").write_text("hello")
        png = b"\x89PNG\r\n\x1a\n" + bytes(8) + (80).to_bytes(4, "big") + (60).to_bytes(4, "big")
        (tmp_path / "b.png").write_bytes(png)
        got = {r["source_path"].rpartition("/")[2]: r for r in scan.read_folder(spark, str(tmp_path)).collect()}
        assert got["a.shout"]["text"] == "HELLO" and got["a.shout"]["metadata"]["format"] == "shout"
        assert got["b.png"]["text"] == "[OCR Text]\nread 24\n\n[Image Description]\na cat" and got["b.png"]["metadata"]["width"] == "80"
        assert parsers.parse("d.docx", "docx", document(png))[0] == "Before\n\n[Image OCR]\nread 24"
        assert parsers.parse("d.docx", "docx", document(png[:16] + bytes(8)))[0].startswith("Before")
    finally:
        parsers.plug()
        formats.FORMAT_OF.pop(".shout", None)
        parsers.PARSERS.pop("shout"), parsers.PLUGGED.clear()
    assert parsers.parse("b.png", "image", png)[0] == "[Image: b.png — PNG, 80x60]"


def document(image):
    w, a = "http://schemas.openxmlformats.org/wordprocessingml/2006/main", "http://schemas.openxmlformats.org/drawingml/2006/main"
    r = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    body = f'<w:p><w:r><w:t>Before</w:t></w:r></w:p><w:p><w:r><w:drawing><a:blip xmlns:a="{a}" r:embed="i1"/></w:drawing></w:r></w:p>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}" xmlns:r="{r}"><w:body>{body}</w:body></w:document>')
        z.writestr("word/_rels/document.xml.rels", '<Relationships><Relationship Id="i1" Target="media/x.png"/></Relationships>')
        z.writestr("word/media/x.png", image)
    return out.getvalue()


def test_sizes_of_images():
    tiff = b"II*\0" + (8).to_bytes(4, "little") + (2).to_bytes(2, "little") + b"".join(t.to_bytes(2, "little") + b"\3\0" + (1).to_bytes(4, "little") + v.to_bytes(4, "little") for t, v in ((256, 33), (257, 44)))
    webp = b"RIFF" + bytes(4) + b"WEBPVP8X" + bytes(8) + (32).to_bytes(3, "little") + (43).to_bytes(3, "little")
    assert parsers._image_size(tiff) == ("TIFF", 33, 44) and parsers._image_size(webp) == ("WEBP", 33, 44) and parsers._image_size(b"") == ("", 0, 0)
