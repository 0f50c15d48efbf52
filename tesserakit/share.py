"""Collections as archives: a manifest and the store's Parquet files in one zip file."""

from __future__ import annotations

import json
import os
import shutil
import zipfile
from datetime import datetime, timezone

from . import __version__
from .catalog import Catalog, Entry

# What an archive may hold.
MEMBERS, MEMBER_BYTES, TOTAL_BYTES = 100_000, 2 * 1024**3, 10 * 1024**3
MANIFEST, DATA = "manifest.json", "data/"


def check(archive: zipfile.ZipFile) -> None:
    """Refuses archives that would fill the disk or write outside their folder."""
    members = archive.infolist()
    if len(members) > MEMBERS:
        raise ValueError(f"{len(members)} members; {MEMBERS} are allowed")
    for m in members:
        parts = m.filename.replace("\\", "/").split("/")
        if m.file_size > MEMBER_BYTES:
            raise ValueError(f"{m.filename} is too large")
        if m.filename.startswith(("/", "\\")) or ".." in parts or (parts and ":" in parts[0]):
            raise ValueError(f"{m.filename} points outside the archive")
    if sum(m.file_size for m in members) > TOTAL_BYTES:
        raise ValueError("the archive is too large unpacked")


def export(catalog: Catalog, name: str, path: str) -> str:
    """Writes a collection to ``path`` (ending in .rag) and returns its full name."""
    entry = catalog.get(name)
    if not os.path.isdir(entry.path):
        raise FileNotFoundError(entry.path)
    path = path if path.lower().endswith(".rag") else os.path.splitext(path)[0] + ".rag"
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    about = {
        "format_version": 1,
        "tool_version": __version__,
        **{k: getattr(entry, k) for k in ("name", "description", "embedding_model", "file_count", "chunk_count", "created_at", "source_folders")},
        "exported_at": datetime.now(timezone.utc).isoformat(),
    }
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(MANIFEST, json.dumps(about, indent=1, ensure_ascii=False))
        for folder, _, files in sorted(os.walk(entry.path)):
            for file in sorted(files):
                full = os.path.join(folder, file)
                z.write(full, DATA + os.path.relpath(full, entry.path))
    return os.path.realpath(path)


def peek(path: str) -> dict:
    """An archive's manifest."""
    with zipfile.ZipFile(path) as z:
        check(z)
        if MANIFEST not in z.namelist():
            raise ValueError("the archive has no manifest")
        about = json.loads(z.read(MANIFEST))
    if missing := {"name", "embedding_model"} - about.keys():
        raise ValueError(f"the manifest lacks {', '.join(sorted(missing))}")
    return about


def import_(catalog: Catalog, path: str, name: str | None = None) -> Entry:
    """Adds an archive's collection, read-only sources and all, under its own or a given name, with a number if taken."""
    about = peek(path)
    entry = catalog.create(
        catalog.free_name(name or about["name"]),
        description=about.get("description", ""),
        embedding_model=about["embedding_model"],
        is_imported=True,
        imported_from=os.path.realpath(path),
        file_count=about.get("file_count", 0),
        chunk_count=about.get("chunk_count", 0),
    )
    root = os.path.realpath(entry.path)
    try:
        with zipfile.ZipFile(path) as z:
            for m in z.infolist():
                if m.is_dir() or not m.filename.startswith(DATA):
                    continue
                to = os.path.realpath(os.path.join(root, m.filename[len(DATA) :]))
                if os.path.commonpath([root, to]) != root:
                    raise ValueError(f"{m.filename} points outside the collection")
                os.makedirs(os.path.dirname(to), exist_ok=True)
                with z.open(m) as source, open(to, "wb") as target:
                    shutil.copyfileobj(source, target)
    except BaseException:
        catalog.delete(entry.name)
        raise
    return entry
