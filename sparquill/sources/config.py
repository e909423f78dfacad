"""Configuration files on the driver: nested settings, dotted overrides, scalars by their looks."""

from __future__ import annotations

import copy
import json


def scalar(text: str) -> object:
    """true, false, null, whole and decimal numbers, else the text."""
    low = text.strip().lower()
    if low in ("true", "false"):
        return low == "true"
    if low in ("null", "none", "~", ""):
        return None
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def overridden(config: dict, *settings: str) -> dict:
    """A copy with settings such as a.b.c=value put in their places."""
    out = copy.deepcopy(config)
    for setting in settings:
        path, found, value = setting.partition("=")
        if not found:
            raise ValueError(f"{setting!r} has no =")
        *above, last = path.split(".")
        at = out
        for name in above:
            if not isinstance(at.get(name), dict):
                at[name] = {}
            at = at[name]
        at[last] = scalar(value)
    return out


def loaded(text: str) -> dict:
    """Settings from the text of a JSON file, or of a YAML file where a YAML reader is installed."""
    try:
        return json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError as e:
            raise ValueError("the settings are not JSON, and no YAML reader is installed") from e
        return yaml.safe_load(text) or {}
