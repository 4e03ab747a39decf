"""The registered queries: name, function, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None) -> Callable:
    """Register a function of (spark, sf_dir)."""
    def add(f: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"{name} is registered already")
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add
