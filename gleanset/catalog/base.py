"""Registration of the queries and their reference SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gleanset.fixtures import VIEWS, view, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Views of one scale-factor folder, by attribute: ``t.contacts``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)


def query(name: str, sql: str | None = None) -> Callable:
    """Register ``function(tables)`` under ``name``, with SQL if it can be said in SQL."""

    def register(function: Callable[[Tables], DataFrame]) -> Callable:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: function(Tables(spark, sf_dir))
        if sql is not None:
            used = [v for v in VIEWS if re.search(rf"\b(FROM|JOIN|,) *{v}\b", sql)]
            ORACLES[name] = with_views(sql, *used) if used else sql.strip()
        return function

    return register
