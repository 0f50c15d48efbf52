import os
import zipfile

import pytest
from tesserakit import cli, share
from tesserakit.catalog import Catalog, check_name
from tesserakit.config import Settings
from tesserakit.models import models


def test_catalog(tmp_path):
    c = Catalog(str(tmp_path))
    a, b = c.create(" a "), c.create("b", source_folders=["x"])
    assert c.active().name == "a" and a.name == "a" and os.path.isabs(b.source_folders[0])
    with pytest.raises(ValueError):
        c.create("a")
    c.switch("b")
    c.detach("b")
    with pytest.raises(PermissionError):
        c.writable("b")
    c.update("a", file_count=2, chunk_count=5)
    assert c.totals() == {"collections": 2, "files": 2, "chunks": 5} and c.free_name("a") == "a-2"
    c.delete("b")
    assert c.active().name == "a"


@pytest.mark.parametrize("name", ["", "  ", "a/b", 'a"', "x" * 129, ".."])
def test_bad_names(name):
    with pytest.raises(ValueError):
        check_name(name)


def test_settings(tmp_path):
    s = Settings().set("chunk_size", 500)
    s.save(str(tmp_path / "s.json"))
    assert Settings.load(str(tmp_path / "s.json")) == s and Settings.load(str(tmp_path / "none")) == Settings()
    with pytest.raises(ValueError):
        Settings(chunk_overlap=5000)
    with pytest.raises(KeyError):
        s.set("nothing", 1)


def archive(path, **members):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)
    return str(path)


def test_archives(tmp_path):
    c = Catalog(str(tmp_path / "home"))
    entry = c.create("a", description="d")
    os.makedirs(f"{entry.path}/chunks")
    with open(f"{entry.path}/chunks/x.txt", "w") as f:
        f.write("data")
    path = share.export(c, "a", str(tmp_path / "out.zip"))
    assert path.endswith(".rag") and share.peek(path)["name"] == "a"
    back = share.import_(c, path)
    assert back.name == "a-2" and back.is_imported and open(f"{back.path}/chunks/x.txt").read() == "data"
    for name in ("../x", "/x", "data/../../x"):
        with pytest.raises(ValueError):
            share.peek(archive(tmp_path / "bad.rag", **{"manifest.json": '{"name": "n", "embedding_model": "m"}', name: "x"}))
    with pytest.raises(ValueError):
        share.peek(archive(tmp_path / "bare.rag", **{"manifest.json": "{}"}))
    with pytest.raises(ValueError):
        share.peek(archive(tmp_path / "none.rag", x="y"))


def test_models(spark):
    assert (models(spark, "embedding").count(), models(spark, "reranker").count()) == (17, 8)


def test_index_and_search(spark, tmp_path, capsys):
    files = tmp_path / "files"
    files.mkdir()
    (files / "quantum.md").write_text("# Quantum\nQuantum computers use qubits and gates.")
    (files / "music.txt").write_text("A symphony has four movements for orchestra.")
    home = str(tmp_path / "home")
    assert cli.main(["--home", home, "create", "kb", str(files)]) == 0

    from tesserakit import index

    c = Catalog(home)
    assert index.index(spark, c, "kb") == {"new": 2, "modified": 0, "removed": 0}
    assert index.index(spark, c, "kb") == {"new": 0, "modified": 0, "removed": 0}
    top = index.search(spark, c, "kb", "qubits and gates", 1, Settings(min_score_threshold=0.0)).first()
    assert top["source_file"].endswith("quantum.md")
    (files / "music.txt").unlink()
    (files / "quantum.md").write_text("# Quantum\nOnly gates now, in a longer text.")
    assert index.index(spark, c, "kb") == {"new": 0, "modified": 1, "removed": 1}
    assert c.get("kb").file_count == 1
    assert index.index(spark, c, "kb", full=True)["new"] == 1
    assert cli.main(["--home", home, "list"]) == 0 and "kb\t1 files" in capsys.readouterr().out


def test_incremental_runs(spark, tmp_path):
    from tesserakit import index
    from tesserakit.operators import metrics, store

    files = tmp_path / "files"
    files.mkdir()
    for k in range(4):
        (files / f"f{k}.txt").write_text(f"text number {k} about rivers")
    c = Catalog(str(tmp_path / "home"))
    entry = c.create("kb", source_folders=[str(files)])
    told = []
    assert index.index(spark, c, "kb", progress=told.append)["new"] == 4 and [t["stage"] for t in told][:2] == ["scan", "changes"]
    base = store.KnowledgeBase.at(spark, entry.path)
    before = base.chunks._pointer()["folders"]
    # touched only: no chunk is written again; edited: its part only
    os.utime(files / "f0.txt", (10**9, 10**9))
    assert index.index(spark, c, "kb") == {"new": 0, "modified": 0, "removed": 0} and base.chunks._pointer()["folders"] == before
    assert index.index(spark, c, "kb") == {"new": 0, "modified": 0, "removed": 0}
    (files / "f1.txt").write_text("another text")
    (files / "f2.txt").unlink()
    path = str(files / "f1.txt")
    assert index.index_file(spark, c, "kb", path) == {"new": 0, "modified": 1, "removed": 0}
    after = base.chunks._pointer()["folders"]
    assert sum(after.get(k) != v for k, v in before.items()) == 1
    assert {r["change"] for r in index.changes(spark, c.get("kb")).collect()} == {"removed"}
    index.remove_file(spark, c, "kb", str(files / "f2.txt"))
    assert base.manifest.read().count() == 3 and not [n for n in os.listdir(entry.path) if n.startswith("staging")]
    # cancelled between stages: the store is as it was, and the run is recorded
    (files / "f3.txt").write_text("changed as well")
    with pytest.raises(index.Cancelled):
        index.index(spark, c, "kb", stop=lambda: True)
    assert "number 3" in " ".join(r["text"] for r in base.chunks.read().collect()) and not index.indexing(c, "kb")
    index.search(spark, c, "kb", "rivers", 2, Settings(min_score_threshold=0.0))
    index.snapshot(spark, c)
    facts = f"{c.folder}/metrics"
    runs = metrics.read(spark, facts, "indexing_runs").collect()
    assert [r["status"] for r in sorted(runs, key=lambda r: r["started_at"])] == ["done"] * 4 + ["cancelled"] and max(r["chunks_per_second"] for r in runs) > 0
    assert metrics.embedding_dashboard(metrics.read(spark, facts, "embedding_batches"), "kb").first()["texts"] == 5
    search = metrics.read(spark, facts, "search_queries").first()
    assert search["results_returned"] == 2 and search["total_duration_ms"] > search["vector_search_ms"] > 0
    assert metrics.read(spark, f"file://{facts}", "vector_store_snapshots").first()["db_size_bytes"] > 0
    assert index.status(spark, c, "kb")["files"] == 3


def test_one_run_at_a_time(spark, tmp_path):
    from tesserakit import index

    c = Catalog(str(tmp_path / "home"))
    c.create("kb")
    with index.guard(spark, c, "kb"):
        assert index.indexing(c, "kb")
        with pytest.raises(index.Busy), index.guard(spark, c, "kb"):
            pass
        with pytest.raises(index.Busy):
            c.delete("kb")
    with open(os.path.join(c.folder, "kb.lock"), "w") as f:
        f.write("999999999")  # a run that died
    with index.guard(spark, c, "kb"):
        pass
    assert not index.indexing(c, "kb")
