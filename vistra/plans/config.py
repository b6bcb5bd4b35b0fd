"""Configuration: defaults, overlays, and a read-only view."""

from __future__ import annotations

import copy
import json
import os
from collections.abc import Mapping

#: The defaults of every stage.
DEFAULTS = {
    "run_mode": "full",
    "detection": {"mode": "fixed_sparse", "interval": 3, "min_interval": 1, "change_threshold": 0.35, "min_area": 500.0, "max_per_frame": 60},
    "tracking": {"min_iou": 0.3, "max_age": 10, "min_hits": 2, "delta": 3, "inertia": 0.2, "vote_window": 12, "interpolate": 6, "window": 30, "stride": 15},
    "quality": {"min_frames": 2, "max_changes": 1, "max_ratio": 0.45},
    "rules": {"min_votes": 0.6, "axis_margin": 0.08, "near_ratio": 0.35, "overlap": 0.05, "min_observed": 1, "min_evidence": 2, "max_gap": 0},
    "semantic": {"frames": 8, "burst": 5, "candidates": 14, "expanded": 24, "windows_per_call": 6, "more_frames": 4, "min_pair_frames": 2, "max_windows": 0},
    "clustering": {"max_gap": 1, "max_evidence_gap": 4},
    "verify": {"low_score": 0.45, "min_export": 0.0, "coupling": False},
    "evaluation": {"viou": 0.5, "track_iou": 0.3, "tiou": 0.5},
}
RUN_MODES = ("full", "tracking_only")


def merged(base: Mapping, overlay: Mapping) -> dict:
    """``base`` with ``overlay`` on top, level by level."""
    out = copy.deepcopy(dict(base))
    for key, value in overlay.items():
        out[key] = merged(out[key], value) if isinstance(value, Mapping) and isinstance(out.get(key), Mapping) else copy.deepcopy(value)
    return out


class Config(Mapping):
    """A read-only mapping whose keys are attributes too."""

    def __init__(self, values: Mapping):
        self._values = dict(values)

    def __getitem__(self, key):
        value = self._values[key]
        return Config(value) if isinstance(value, Mapping) else value

    def __getattr__(self, key):
        try:
            return self[key]
        except KeyError:
            raise AttributeError(key) from None

    def __iter__(self):
        return iter(self._values)

    def __len__(self):
        return len(self._values)


def load(overlay: str | Mapping | None = None) -> Config:
    """The defaults with a JSON file or mapping on top; the run mode must be known."""
    if isinstance(overlay, str):
        with open(overlay, encoding="utf-8-sig") as f:
            overlay = json.load(f)
    values = merged(DEFAULTS, overlay or {})
    if values["run_mode"] not in RUN_MODES:
        raise ValueError(f"unknown run mode {values['run_mode']!r}")
    return Config(values)


def secret(name: str, given: str = "", env_file: str = ".env") -> str:
    """A key that is given, or in the environment, or in a file of NAME=value lines; empty where there is none."""
    if given or os.environ.get(name):
        return given or os.environ[name]
    if os.path.exists(env_file):
        with open(env_file, encoding="utf-8") as f:
            pairs = (line.strip().partition("=") for line in f if "=" in line and not line.lstrip().startswith("#"))
            return next((v.strip().strip("'\"") for k, _, v in pairs if k.strip() == name), "")
    return ""
