"""Registry of the library's own queries: name -> callable, and name -> SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

#: Modules that register queries, each with a dict QUERIES of name -> (callable, SQL or None).
MODULES = ("newsgrain.plans.stories", "newsgrain.plans.articles", "newsgrain.plans.telemetry", "newsgrain.plans.clusters", "newsgrain.plans.streams")


def _all() -> dict[str, tuple[Callable, str | None]]:
    every: dict[str, tuple[Callable, str | None]] = {}
    for name in MODULES:
        every |= import_module(name).QUERIES
    return every


def queries() -> dict[str, Callable]:
    return {k: f for k, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _all().items() if sql}
