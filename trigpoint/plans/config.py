"""Settings of a build, read from JSON."""

from __future__ import annotations

import json
import warnings
from dataclasses import dataclass, fields
from pathlib import Path

#: Feature classes of the place dump.
FEATURE_CLASSES = tuple("AHLPRSTUV")


def feature_classes(listed: str) -> list[str]:
    """A comma list as classes: trimmed, upper case, each once. Raises ValueError for others."""
    out: list[str] = []
    for part in (p.strip().upper() for p in listed.split(",")):
        if part and part not in out:
            out.append(part)
    check_feature_classes(out)
    return out


def check_feature_classes(classes: list[str]) -> None:
    bad = [c for c in classes if c not in FEATURE_CLASSES]
    if bad:
        raise ValueError(f"no feature classes: {', '.join(map(repr, bad))}")


@dataclass(frozen=True)
class Config:
    places: str
    postal: str
    output: str
    admin1: str = ""
    limit: int = 0
    include_feature_classes: str = ""
    exclude_admin_divisions: bool = False

    def __post_init__(self):
        for name in ("places", "postal", "output"):
            if not getattr(self, name):
                raise ValueError(f"{name} is missing")
        paths = [p for p in (self.places, self.postal, self.output, self.admin1) if p]
        if len(set(paths)) < len(paths):
            raise ValueError("two settings name the same file")
        feature_classes(self.include_feature_classes)


def load_config(path: str) -> Config:
    """Relative paths are relative to the file. Unknown keys give a warning; text after the object is an error."""
    raw = json.loads(Path(path).read_text())
    if not isinstance(raw, dict):
        raise ValueError("the settings must be an object")
    known = {f.name for f in fields(Config)}
    for k in sorted(raw.keys() - known):
        warnings.warn(f"unknown setting {k}", stacklevel=2)
    base = Path(path).resolve().parent
    own = {k: v for k, v in raw.items() if k in known}
    for k in ("places", "postal", "output", "admin1"):
        if own.get(k) and "://" not in own[k]:
            own[k] = str(base / own[k])
    return Config(**own)
