"""Settings with their defaults, and how an environment or a mapping changes them."""

from __future__ import annotations

import dataclasses
import os
from collections.abc import Mapping


@dataclasses.dataclass(frozen=True)
class Settings:
    """Fixed values are the defaults of the engine's stages."""

    log_level: str = "INFO"
    output_dir: str = "./output"
    embedding_backend: str = "auto"
    embedding_model: str = ""
    embedding_key: str = ""
    cluster_similarity: float = 0.80
    cluster_window_hours: float = 48.0
    select_top_n: int = 25
    min_final_stories: int = 20

    def has_embedding_key(self) -> bool:
        return is_real_key(self.embedding_key)


def is_real_key(key: str | None) -> bool:
    """Whether a key is one, and neither blank nor a placeholder with dots."""
    return bool((key or "").strip()) and "..." not in (key or "")


def load(values: Mapping[str, str] | None = None) -> Settings:
    """Settings with what the mapping (the environment, if none) names in capitals; others stay as they are."""
    values = os.environ if values is None else values
    given = {}
    for f in dataclasses.fields(Settings):
        raw = values.get(f.name.upper())
        if raw is not None:
            given[f.name] = type(f.default)(raw)
    return Settings(**given)
