"""Settings of a project and where its index lies."""

from __future__ import annotations

import hashlib
import os
from dataclasses import dataclass, field, fields
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

PREFIX = "QUARRY_"


@dataclass(frozen=True)
class Settings:
    embedding_model: str = "hashing"
    cache_dir: str = "~/.cache/quarry"
    local_index: bool = False
    debug: bool = False
    profile: bool = False
    ignore_patterns: tuple[str, ...] = field(default=())
    use_gitignore: bool = True

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Settings:
        """Values of variables with the prefix; unknown ones are ignored, lists are comma-separated."""
        env = dict(os.environ) if env is None else env
        found = {}
        for f in fields(cls):
            raw = env.get(PREFIX + f.name.upper())
            if raw is not None:
                kind = type(f.default) if f.name != "ignore_patterns" else tuple
                found[f.name] = raw.lower() in ("1", "true", "yes", "on") if kind is bool else tuple(filter(None, raw.split(","))) if kind is tuple else raw
        return cls(**found)


def project_hash(path: Column) -> Column:
    return F.substring(F.sha2(path, 256), 1, 16)


def index_path(project: str, settings: Settings, override: str | None = None) -> str:
    """The folder of a project's index; it is made if it is not there."""
    root = Path(project).resolve()
    if override:
        out = Path(override)
    elif settings.local_index:
        out = root / ".quarry"
    else:
        out = Path(settings.cache_dir).expanduser() / hashlib.sha256(str(root).encode()).hexdigest()[:16]
    out.mkdir(parents=True, exist_ok=True)
    return str(out)
