"""All registered queries."""

from __future__ import annotations

import importlib

from tickloom.plans import registry

_MODULES = ("scan_queries", "scalar_queries", "join_queries", "state_queries", "risk_queries",
            "portfolio_queries", "factor_queries", "reconcile_queries", "stream_queries")


def _load() -> None:
    for name in _MODULES:
        importlib.import_module(f"tickloom.plans.{name}")


def queries() -> dict:
    _load()
    return dict(registry.QUERIES)


def oracles() -> dict:
    _load()
    return dict(registry.ORACLES)
