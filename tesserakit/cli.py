"""Command line: collections, indexing, search, what there is of a collection, its figures, settings, models, archives."""

from __future__ import annotations

import argparse
import json
import os
from dataclasses import asdict


def _spark():  # noqa: ANN202
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("tesserakit").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def main(argv: list[str] | None = None) -> int:
    from . import share
    from .catalog import Catalog
    from .config import Settings

    p = argparse.ArgumentParser(prog="tesserakit", description=__doc__)
    p.add_argument("--home", default=os.path.expanduser("~/.tesserakit"))
    sub = p.add_subparsers(dest="command", required=True)
    for name, *args in (
        ("create", "name", "folders*"),
        ("list",),
        ("use", "name"),
        ("detach", "name"),
        ("attach", "name"),
        ("delete", "name"),
        ("index", "name", "--full"),
        ("search", "name", "query", "-k"),
        ("index-file", "name", "path"),
        ("remove-file", "name", "path"),
        ("status", "name"),
        ("changes", "name"),
        ("document", "name", "path"),
        ("stats", "name"),
        ("snapshot",),
        ("config", "key?", "value?"),
        ("models",),
        ("files", "name"),
        ("verify", "name"),
        ("export", "name", "path"),
        ("import", "path"),
        ("peek", "path"),
    ):
        c = sub.add_parser(name)
        for a in args:
            if a == "--full":
                c.add_argument(a, action="store_true")
            elif a == "-k":
                c.add_argument(a, type=int, default=5)
            else:
                c.add_argument(a.rstrip("*?"), nargs=a[-1] if a[-1] in "*?" else None)
    a = p.parse_args(argv)
    catalog = Catalog(a.home)
    if a.command == "create":
        print(catalog.create(a.name, source_folders=a.folders).path)
    elif a.command == "list":
        for e in catalog.list():
            print(f"{e.name}\t{e.file_count} files\t{e.chunk_count} chunks" + "\tdetached" * e.detached)
    elif a.command == "use":
        catalog.switch(a.name)
    elif a.command in ("detach", "attach", "delete"):
        getattr(catalog, a.command)(a.name)
    elif a.command == "peek":
        print(json.dumps(share.peek(a.path), indent=1))
    elif a.command == "export":
        print(share.export(catalog, a.name, a.path))
    elif a.command == "import":
        print(share.import_(catalog, a.path).name)
    elif a.command == "config":
        at = os.path.join(a.home, "settings.json")
        settings = Settings.load(at)
        if a.value is not None:
            try:
                value = json.loads(a.value)
            except ValueError:
                value = a.value
            settings.set(a.key, value).save(at)
        elif a.key == "reset":
            Settings().save(at)
        else:
            shown = asdict(settings)
            print(json.dumps(shown if a.key is None else shown[a.key], indent=1))
    else:
        from . import index
        from .models import models
        from .operators import metrics, store

        spark, settings = _spark(), Settings.load(os.path.join(a.home, "settings.json"))
        if a.command == "index":
            print(json.dumps(index.index(spark, catalog, a.name, settings, full=a.full)))
        elif a.command == "index-file":
            print(json.dumps(index.index_file(spark, catalog, a.name, os.path.realpath(a.path), settings)))
        elif a.command == "remove-file":
            index.remove_file(spark, catalog, a.name, os.path.realpath(a.path))
        elif a.command == "status":
            print(json.dumps(index.status(spark, catalog, a.name), indent=1))
        elif a.command == "changes":
            index.changes(spark, catalog.get(a.name)).orderBy("path").show(1000, truncate=False)
        elif a.command == "document":
            index.document(spark, catalog, a.name, a.path).show(1000, truncate=False)
        elif a.command == "models":
            models(spark).orderBy("kind", "name").show(100, truncate=False)
        elif a.command == "snapshot":
            index.snapshot(spark, catalog, settings.retention_days)
        elif a.command == "stats":
            facts = f"{catalog.folder}/metrics"
            for fact, dashboard in (("search_queries", metrics.search_dashboard), ("indexing_runs", metrics.indexing_dashboard), ("embedding_batches", metrics.embedding_dashboard)):
                print(fact, json.dumps(dashboard(metrics.read(spark, facts, fact), a.name).first().asDict()))
        elif a.command == "search":
            index.search(spark, catalog, a.name, a.query, a.k, settings).orderBy("rank").show(truncate=80)
        else:
            base = store.KnowledgeBase.at(spark, catalog.get(a.name).path)
            rows = store.sources(base.chunks.read()).orderBy("source_file") if a.command == "files" else store.verify(base.manifest.read(), base.chunks.read())
            rows.show(1000, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
