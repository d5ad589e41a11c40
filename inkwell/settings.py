"""Settings by name, from the environment or a file of it."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields
from pathlib import Path

PREFIX = "INKWELL_"


@dataclass(frozen=True)
class Settings:
    """Limits and defaults of reading and analysing; each may be set as INKWELL_<NAME>."""

    max_files: int = 5
    max_file_bytes: int = 50 * 1024**2
    max_total_bytes: int = 100 * 1024**2
    max_pages: int = 300
    request_timeout_seconds: float = 20.0
    analysis_timeout_seconds: float = 600.0
    recognition_batch_size: int = 4
    recognition_language: str = "en"
    artifact_ttl_seconds: int = 3600


def loaded(env_file: str | None = None, environment: dict[str, str] | None = None) -> Settings:
    """Settings of the environment, before it those of `env_file` (lines NAME=value, `#` begins a
    remark, values may be quoted). Values of the wrong type raise ValueError."""
    found: dict[str, str] = {}
    if env_file and Path(env_file).is_file():
        for line in Path(env_file).read_text(encoding="utf-8").splitlines():
            name, sign, value = line.strip().removeprefix("export ").partition("=")
            if sign and not name.startswith("#"):
                found[name.strip()] = value.strip().strip("'\"")
    found |= os.environ if environment is None else environment
    given = {f.name: found[PREFIX + f.name.upper()] for f in fields(Settings) if PREFIX + f.name.upper() in found}
    kinds = {"int": int, "float": float, "str": str}
    return Settings(**{name: kinds[Settings.__annotations__[name]](value) for name, value in given.items()})
