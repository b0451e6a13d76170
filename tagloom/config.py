"""Settings: frozen dataclasses on the driver, optionally overridden from a YAML-like nested mapping."""

from __future__ import annotations

import dataclasses
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Cascade:
    merge_iou: float = 0.45
    nms_iou: float = 0.2
    crop_expand_factor: int = 2
    adaptive_yolo: bool = True
    yolo_skip_frames: int = 5
    yolo_force_interval: int = 15


@dataclass(frozen=True)
class Tracker:
    center_dist_thresh: float = 10.0
    size_ratio_thresh: float = 0.25
    max_frames_missed: int = 15


@dataclass(frozen=True)
class Density:
    base: float = 0.5
    low_limit: float = 0.25
    high_limit: float = 0.7
    window: int = 30
    density_low: float = 3
    density_high: float = 12


@dataclass(frozen=True)
class Boost:
    enabled: bool = True
    max_boost: float = 1.3
    per_frame: float = 0.03


@dataclass(frozen=True)
class Tiling:
    tile: int = 640
    stride: int = 320
    scales: tuple[float, ...] = (0.75, 1.0, 1.25)
    iou: float = 0.45
    conf: float = 0.15


@dataclass(frozen=True)
class Settings:
    cascade: Cascade = field(default_factory=Cascade)
    tracker: Tracker = field(default_factory=Tracker)
    density: Density = field(default_factory=Density)
    boost: Boost = field(default_factory=Boost)
    tiling: Tiling = field(default_factory=Tiling)
    video_skip_frames: int = 3


def lookup(tree: Any, path: str, default: Any = None) -> Any:
    """The value at a dotted path of nested mappings; ``default`` where a part is missing or None."""
    for part in path.split("."):
        if not isinstance(tree, Mapping) or tree.get(part) is None:
            return default
        tree = tree[part]
    return tree


def settings(tree: Mapping[str, Any] | None = None) -> Settings:
    """Defaults with the sections of ``tree`` put over them; unknown names are left out, a tree that is no mapping counts as empty."""
    tree = tree if isinstance(tree, Mapping) else {}
    changed = {}
    for part in dataclasses.fields(Settings):
        now = getattr(Settings(), part.name)
        if dataclasses.is_dataclass(now) and isinstance(tree.get(part.name), Mapping):
            known = {f.name for f in dataclasses.fields(now)}
            changed[part.name] = dataclasses.replace(now, **{k: tuple(v) if isinstance(v, list) else v for k, v in tree[part.name].items() if k in known and v is not None})
    skip = lookup(tree, "video.skip_frames")
    return dataclasses.replace(Settings(), **changed, **({"video_skip_frames": skip} if skip is not None else {}))


def load(path: str) -> Settings:
    """Settings from a YAML file where a parser is installed; a missing file gives the defaults."""
    try:
        with open(path, encoding="utf-8") as f:
            text = f.read()
    except FileNotFoundError:
        return Settings()
    import yaml

    return settings(yaml.safe_load(text))
