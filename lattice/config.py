"""Layered configuration: defaults, then the user's file, then the corpus's file."""

from __future__ import annotations

import copy
import os
from pathlib import Path

import yaml

STATE_DIR = ".lattice"

# Defaults by section.
DEFAULTS: dict = {
    "corpus": {"include": None},
    "embedding": {"backend": "hash", "model": "hash-384"},
    "llm": {"model": "pattern", "temperature": 0.0, "max_tokens": 16384, "timeout_seconds": 120, "concurrency": 4},
    "chunking": {"max_chars": 4000, "overlap_chars": 200, "split_on": "paragraph"},
    "extraction": {"retry_on_parse_failure": 2},
    "resolution": {"similarity_threshold": 0.85, "llm_verify_clusters": True, "max_cluster_size": 10},
    "induction": {"hierarchy_depth": 3},
}


def merged(base: dict, over: dict | None) -> dict:
    """``base`` with ``over`` laid on it: dicts merge, lists and scalars are replaced."""
    out = copy.deepcopy(base)
    for key, value in (over or {}).items():
        out[key] = merged(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else copy.deepcopy(value)
    return out


def user_config_path() -> Path:
    home = os.environ.get("XDG_CONFIG_HOME") or Path.home() / ".config"
    return Path(home) / "lattice" / "config.yaml"


def load_config(corpus: Path) -> dict:
    out = DEFAULTS
    for path in (user_config_path(), Path(corpus) / STATE_DIR / "config.yaml"):
        if path.is_file():
            out = merged(out, yaml.safe_load(path.read_text(encoding="utf-8")))
    return merged(out, None)


def write_default_config(path: Path) -> None:
    Path(path).write_text(yaml.safe_dump(DEFAULTS, sort_keys=False), encoding="utf-8")
