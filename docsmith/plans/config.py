"""Settings of a run, from defaults, a TOML file and overrides."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields, is_dataclass, replace


# The defaults.
@dataclass(frozen=True)
class Extract:
    pages: int = 12
    max_chars: int = 6000
    scanned_threshold: int = 800
    timeout_secs: int = 60


@dataclass(frozen=True)
class Model:
    path: str = "models/model.gguf"
    gpu_layers: int = 999
    context: int = 8192
    max_tokens: int = 512
    seed: int = 1337
    template: str = "chatml"


@dataclass(frozen=True)
class Vision:
    enabled: bool = True
    max_pixels: int = 2100
    image_max_tokens: int = 2048
    context: int = 8192
    max_tokens: int = 512


@dataclass(frozen=True)
class Bookmark:
    min_ratio: float = 1.6
    max_depth: int = 3
    min_pages: int = 20
    max_growth: float = 0.25


@dataclass(frozen=True)
class Systems:
    aliases: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Dedupe:
    near_duplicates: bool = True
    size_tolerance: float = 0.05
    min_text_chars: int = 500


@dataclass(frozen=True)
class Taxonomy:
    max_leaves: int = 40
    max_depth: int = 3
    min_docs_per_leaf: int = 3
    min_confidence: float = 0.45


@dataclass(frozen=True)
class Config:
    source: str = "."
    work_dir: str = "tmp"
    library: str = "tmp/library"
    extract: Extract = Extract()
    model: Model = Model()
    vision: Vision = Vision()
    bookmarks: Bookmark = Bookmark()
    systems: Systems = field(default_factory=Systems)
    dedupe: Dedupe = Dedupe()
    taxonomy: Taxonomy = Taxonomy()

    @property
    def cache_dir(self) -> str:
        return f"{self.work_dir}/cache"

    @property
    def plan_path(self) -> str:
        return f"{self.work_dir}/plan.json"

    @property
    def render_dir(self) -> str:
        return f"{self.work_dir}/renders"


def _merge(config, values: dict):
    known = {f.name for f in fields(config)}
    changes = {}
    for name, value in values.items():
        if name in known:
            current = getattr(config, name)
            changes[name] = _merge(current, value) if is_dataclass(current) else value
    return replace(config, **changes)


def load(path: str | None = None, **overrides) -> Config:
    """The defaults, changed by a TOML file and then by overrides that are not None.

    A work folder given without a library, and without a file, takes the library along.
    """
    config = Config()
    if path is not None:
        with open(path, "rb") as f:
            config = _merge(config, tomllib.load(f))
    overrides = {k: v for k, v in overrides.items() if v is not None}
    if "work_dir" in overrides and "library" not in overrides and path is None:
        overrides["library"] = f"{overrides['work_dir']}/library"
    return replace(config, **overrides)
