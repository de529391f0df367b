"""Registered queries and the independent SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tickloom.plans import views

Build = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Build] = {}
ORACLES: dict[str, str] = {}


def query(name: str, use: str = "", sql: str | None = None) -> Callable[[Build], Build]:
    """Register a query; ``sql`` runs on the stand-in views named in ``use``."""
    def add(build: Build) -> Build:
        if name in QUERIES:
            raise KeyError(f"query {name} is registered twice")
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = views.with_views(use, sql)
        return build
    return add
