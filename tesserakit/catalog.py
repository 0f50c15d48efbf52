"""Several independent collections by name."""

from __future__ import annotations

import json
import os
import shutil
from dataclasses import asdict, dataclass, field, replace
from datetime import datetime, timezone

from .config import write_atomically

FORBIDDEN = set('<>:"/\\|?*')


def check_name(name: str) -> str:
    """The stripped name, if it can name a folder: not blank, at most 128 characters, none of ``<>:"/\\|?*``."""
    name = name.strip()
    if not name or len(name) > 128 or FORBIDDEN & set(name) or name in (".", ".."):
        raise ValueError(f"not a name for a collection: {name!r}")
    return name


@dataclass(frozen=True)
class Entry:
    """A collection."""

    name: str
    path: str
    description: str = ""
    embedding_model: str = "hashed-words"
    embedding_dimension: int = 64
    source_folders: tuple[str, ...] = ()
    created_at: str = field(default_factory=lambda: datetime.now(timezone.utc).isoformat())
    is_imported: bool = False
    imported_from: str = ""
    file_count: int = 0
    chunk_count: int = 0
    detached: bool = False


class Catalog:
    """Entries in one JSON file under a folder; the first one made becomes the active one."""

    def __init__(self, folder: str):
        self.folder = folder
        self.file = os.path.join(folder, "catalog.json")

    def _read(self) -> dict:
        if not os.path.exists(self.file):
            return {"active": None, "entries": {}}
        with open(self.file, encoding="utf-8") as f:
            return json.load(f)

    def _write(self, state: dict) -> None:
        write_atomically(self.file, json.dumps(state, indent=1, ensure_ascii=False))

    def _entry(self, values: dict) -> Entry:
        return Entry(**{**values, "source_folders": tuple(values.get("source_folders", ()))})

    def create(self, name: str, **values: object) -> Entry:
        state, name = self._read(), check_name(name)
        if name in state["entries"]:
            raise ValueError(f"there is a collection {name!r} already")
        values["source_folders"] = tuple(os.path.realpath(f) for f in values.get("source_folders", ()))
        entry = Entry(name, os.path.join(self.folder, name), **values)
        state["entries"][name] = asdict(entry)
        state["active"] = state["active"] or name
        self._write(state)
        return entry

    def list(self) -> list[Entry]:
        return [self._entry(v) for v in self._read()["entries"].values()]

    def get(self, name: str) -> Entry:
        return self._entry(self._read()["entries"][name])

    def active(self) -> Entry | None:
        state = self._read()
        return self._entry(state["entries"][state["active"]]) if state["active"] else None

    def switch(self, name: str) -> None:
        state = self._read()
        if name not in state["entries"]:
            raise KeyError(name)
        self._write(state | {"active": name})

    def update(self, name: str, **values: object) -> Entry:
        state = self._read()
        entry = replace(self._entry(state["entries"][name]), **values)
        state["entries"][name] = asdict(entry)
        self._write(state)
        return entry

    def detach(self, name: str) -> Entry:
        """From now on the collection is only read."""
        return self.update(name, detached=True)

    def attach(self, name: str) -> Entry:
        return self.update(name, detached=False)

    def writable(self, name: str) -> Entry:
        entry = self.get(name)
        if entry.detached:
            raise PermissionError(f"collection {name!r} is detached")
        return entry

    def delete(self, name: str) -> None:
        """The entry goes first, then its data; the next entry becomes the active one. Refused while a run writes to it."""
        from .index import Busy, indexing

        if indexing(self, name):
            raise Busy(f"collection {name!r} is being indexed")
        state = self._read()
        entry = self._entry(state["entries"].pop(name))
        if state["active"] == name:
            state["active"] = next(iter(state["entries"]), None)
        self._write(state)
        shutil.rmtree(entry.path, ignore_errors=True)

    def totals(self) -> dict[str, int]:
        entries = self.list()
        return {"collections": len(entries), "files": sum(e.file_count for e in entries), "chunks": sum(e.chunk_count for e in entries)}

    def free_name(self, name: str) -> str:
        """The name, or the first of ``name-2``, ``name-3`` and so on that is free."""
        taken, n, out = {e.name for e in self.list()}, 1, check_name(name)
        while out in taken:
            n += 1
            out = f"{name}-{n}"
        return out
