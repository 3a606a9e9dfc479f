"""All queries with their reference SQL."""

from __future__ import annotations

import importlib

from gleanset.catalog.base import ORACLES, QUERIES, Query

MODULES = ("rules", "runs", "records", "activity", "files", "streams")


def load() -> tuple[dict[str, Query], dict[str, str]]:
    for module in MODULES:
        importlib.import_module(f"gleanset.catalog.{module}")
    return dict(QUERIES), dict(ORACLES)
