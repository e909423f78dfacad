"""Named operators: strategies, scorers and tasks register as functions of a DataFrame and settings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

Operator = Callable[[DataFrame, dict], DataFrame]
_known: dict[tuple[str, str], Operator] = {}


def register(kind: str, name: str) -> Callable[[Operator], Operator]:
    def add(f: Operator) -> Operator:
        if (kind, name) in _known:
            raise ValueError(f"{kind} {name!r} is registered already")
        _known[kind, name] = f
        return f

    return add


def names(kind: str) -> list[str]:
    return sorted(n for k, n in _known if k == kind)


def apply(kind: str, name: str, rows: DataFrame, config: dict | None = None) -> DataFrame:
    if (kind, name) not in _known:
        raise KeyError(f"no {kind} {name!r}; there are {', '.join(names(kind)) or 'none'}")
    return _known[kind, name](rows, config or {})
