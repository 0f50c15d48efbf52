"""Settings: defaults, file and environment."""

from __future__ import annotations

import json
import os
import tempfile
from dataclasses import asdict, dataclass, field, fields, replace

from .operators.retrieval import SearchSettings
from .sources.formats import FORMAT_OF


@dataclass(frozen=True)
class Settings:
    """Numbers and switches of indexing and search."""

    embedding_model: str = "hashed-words"
    chunk_size: int = 1024
    chunk_overlap: int = 128
    supported_extensions: tuple[str, ...] = field(default_factory=lambda: tuple(sorted(FORMAT_OF)))
    reranking_enabled: bool = True
    hybrid_search_enabled: bool = True
    hybrid_search_alpha: float = 0.7
    min_score_threshold: float = 0.15
    mmr_enabled: bool = True
    mmr_lambda: float = 0.7
    embedding_batch_size: int = 512
    retention_days: int = 30

    def __post_init__(self) -> None:
        if self.chunk_size < 1 or not 0 <= self.chunk_overlap < self.chunk_size:
            raise ValueError("chunk_size must be positive and chunk_overlap below it")
        if not (0 <= self.hybrid_search_alpha <= 1 and 0 <= self.mmr_lambda <= 1):
            raise ValueError("hybrid_search_alpha and mmr_lambda lie between 0 and 1")

    def set(self, key: str, value: object) -> Settings:
        if key not in {f.name for f in fields(self)}:
            raise KeyError(key)
        return replace(self, **{key: tuple(value) if isinstance(value, list) else value})

    def search(self, top_k: int = 5, min_score: float | None = None) -> SearchSettings:
        return SearchSettings(
            top_k, self.hybrid_search_enabled, self.hybrid_search_alpha, self.reranking_enabled, self.mmr_enabled, self.mmr_lambda, self.min_score_threshold, min_score
        )

    @staticmethod
    def load(path: str) -> Settings:
        """Settings from a JSON file; unknown keys are passed over, a missing file gives the defaults."""
        if not os.path.exists(path):
            return Settings()
        with open(path, encoding="utf-8") as f:
            known = {k: tuple(v) if isinstance(v, list) else v for k, v in json.load(f).items() if k in {x.name for x in fields(Settings)}}
        return Settings(**known)

    def save(self, path: str) -> None:
        write_atomically(path, json.dumps(asdict(self), indent=1, ensure_ascii=False))


def write_atomically(path: str, text: str) -> None:
    """A file that is there as a whole or as it was."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, draft = tempfile.mkstemp(dir=folder)
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(text)
        os.replace(draft, path)
    except BaseException:
        os.unlink(draft)
        raise
