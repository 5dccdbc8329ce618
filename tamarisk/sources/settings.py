"""Settings from the environment, as plain values."""

from __future__ import annotations

import os
from collections.abc import Mapping


def topic_ids(keys: Mapping[str, str], env: Mapping[str, str] = os.environ) -> dict[str, int | None]:
    """Topic -> numeric id from the variable named for it; missing or not a number is None."""
    out = {}
    for topic, variable in keys.items():
        try:
            out[topic] = int(env.get(variable, ""))
        except ValueError:
            out[topic] = None
    return out


def seed_mode(given: bool | None = None, env: Mapping[str, str] = os.environ, variable: str = "SEED_MODE") -> bool:
    """the argument, else the variable."""
    return given if given is not None else env.get(variable, "").strip().lower() in {"1", "true", "yes"}
