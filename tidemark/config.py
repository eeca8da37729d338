"""Settings: defaults, then a local file, then the environment; each later one wins.

Environment names are ``TIDEMARK__SECTION__KEY``; a double underscore is a level, a single one part of a name. Values take the
type that the default has.
"""

from __future__ import annotations

import copy
import json
import os
import tomllib
from typing import Any

DEFAULTS: dict[str, Any] = {
    "windows": {"size": 100, "stride": 10, "max_windows": 0},
    "prep": {"trend_frame": 60, "alpha": 0.05, "max_lag": 20},
    "learn": {"estimator": "ridge", "p": 0, "lambda_w": 0.1, "lambda_a": 0.1, "threshold": 0.01, "rank_w": 4, "rank_a": 3, "n_knots": 5, "steps": 300},
    "detect": {"metric": "frobenius", "lookback": 5, "lag": 0, "adaptive": True, "golden_sample": 10, "sigmas": 3.0},
    "evaluate": {"ks": [1, 3, 5], "dim_base": 1},
}
#: (low, high) of settings that only make sense within them.
RANGES = {"windows.size": (2, None), "windows.stride": (1, None), "prep.alpha": (0, 1), "learn.lambda_w": (0, None), "learn.lambda_a": (0, None), "detect.lookback": (1, None), "detect.sigmas": (0, None)}
PREFIX = "TIDEMARK__"


def coerced(value: Any, like: Any) -> Any:
    if not isinstance(value, str) or isinstance(like, str):
        return value
    if isinstance(like, bool):
        if value.lower() not in ("1", "0", "true", "false", "yes", "no", "on", "off"):
            raise ValueError(f"not a truth value: {value!r}")
        return value.lower() in ("1", "true", "yes", "on")
    if isinstance(like, list):
        parts = [x.strip() for x in value.strip("[]").split(",") if x.strip()]
        return [coerced(x, like[0]) if like else x for x in parts]
    return type(like)(value) if like is not None else value


class Config:
    def __init__(self, path: str | None = None, environ: dict[str, str] | None = None):
        self.path, self.environ = path, environ
        self.reload()

    def reload(self) -> None:
        self.values = copy.deepcopy(DEFAULTS)
        if self.path:
            with open(self.path, "rb") as f:
                text = f.read()
            local = json.loads(text) if self.path.endswith(".json") else tomllib.loads(text.decode())
            for key, value in _flat(local):
                self.set(key, value)
        for name, value in (os.environ if self.environ is None else self.environ).items():
            if name.startswith(PREFIX):
                self.set(name.removeprefix(PREFIX).lower().replace("__", "."), value)

    def get(self, key: str, default: Any = None) -> Any:
        at: Any = self.values
        for part in key.split("."):
            if not isinstance(at, dict) or part not in at:
                return default
            at = at[part]
        return at

    def set(self, key: str, value: Any) -> None:
        at = self.values
        *parts, last = key.split(".")
        for part in parts:
            at = at.setdefault(part, {})
        at[last] = coerced(value, at.get(last))

    def problems(self) -> list[str]:
        """Settings outside their range."""
        out = []
        for key, (low, high) in RANGES.items():
            v = self.get(key)
            if (low is not None and v < low) or (high is not None and v > high):
                out.append(f"{key} = {v} is outside {low}..{high}")
        return out

    def export(self) -> str:
        return json.dumps(self.values, indent=2, sort_keys=True)


def _flat(tree: dict, before: str = ""):
    for k, v in tree.items():
        if isinstance(v, dict):
            yield from _flat(v, f"{before}{k}.")
        else:
            yield f"{before}{k}", v
