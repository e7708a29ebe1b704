"""Settings from a TOML file, looked for from a folder upward."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from pathlib import Path

FILE = "weftline.toml"
#: Keys of each section; others are errors, so that a misspelt one does not pass for none.
KNOWN = {"scan": {"ignore", "types", "queries", "storage"}, "apps": None, "project": {"model", "reports"}}


@dataclass
class Settings:
    path: Path | None = None
    ignore: list[str] = field(default_factory=list)
    types: list[str] | None = None
    model: str | None = None
    reports: list[str] = field(default_factory=list)
    apps: dict[str, str] = field(default_factory=dict)


def find(start: Path) -> Path | None:
    """The nearest settings file in a folder or one above it."""
    return next((p / FILE for p in [start, *start.parents] if (p / FILE).is_file()), None)


def load(start: Path) -> Settings:
    """Settings for work in a folder; none of its own gives the defaults."""
    path = find(start.resolve())
    if path is None:
        return Settings()
    held = tomllib.loads(path.read_text("utf-8"))
    for section, keys in held.items():
        if section not in KNOWN:
            raise ValueError(f"{path}: no section [{section}]")
        unknown = set(keys) - KNOWN[section] if KNOWN[section] is not None else set()
        if unknown:
            raise ValueError(f"{path}: [{section}] knows no {', '.join(sorted(unknown))}")
    scan, project = held.get("scan", {}), held.get("project", {})
    return Settings(path, list(scan.get("ignore", [])), scan.get("types"), project.get("model"), list(project.get("reports", [])), dict(held.get("apps", {})))
