"""Settings: defaults, then a mapping (from a file), then the environment."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from copy import deepcopy

DEFAULTS: dict = {
    "budget": {"default": 8000, "tools": {}},
    "gate": {"min_tokens": 1000, "min_savings": 0.3},
    "bounds": {"prefilter_tokens": 30_000, "max_chunks": 2000},
    "feedback": {"step": 1.2, "most": 3.0, "gate": 3, "decay": 0.95, "decay_days": 30},
}


def merged(base: Mapping, over: Mapping) -> dict:
    out = deepcopy(dict(base))
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def load(settings: Mapping | None = None, env: Mapping[str, str] = os.environ, prefix: str = "QUERN_") -> dict:
    """QUERN_BUDGET__DEFAULT=4000 sets budget.default; values are JSON where they parse, else text."""
    out = merged(DEFAULTS, settings or {})
    for k, v in env.items():
        if k.startswith(prefix):
            *path, last = k.removeprefix(prefix).lower().split("__")
            try:
                value = json.loads(v)
            except ValueError:
                value = v
            for p in reversed(path):
                value, last = {last: value}, p
            out = merged(out, {last: value})
    return out


def budget_for(settings: Mapping, tool: str) -> int:
    return settings["budget"]["tools"].get(tool, settings["budget"]["default"])
