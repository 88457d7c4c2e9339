"""Registered queries with their comparison SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from linklens.checks import views
from linklens.session import bound_tasks, delete_stored, stored


class Tables:
    """Views and base tables of one data directory as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.placed: dict[str, DataFrame] = {}
        bound_tasks(spark)

    def once(self, *names: str) -> Tables:
        """These tables with the named views written out, for a query that reads them in several places.

        Evidence, and then each view from those before it, is put together once; its shuffle files are gone before the next.
        """
        out = Tables(self.spark, self.sf_dir)
        for name in dict.fromkeys(("fx_occurrences", *names)):
            rows = views.view(self.spark, self.sf_dir, name, out.placed)
            out.placed[name] = rows if (self.sf_dir, name) in views.STORED else stored(rows, name)
        if "fx_occurrences" not in names and (self.sf_dir, "fx_occurrences") not in views.STORED:
            delete_stored(out.placed.pop("fx_occurrences"))
        return out

    def __getattr__(self, name: str) -> DataFrame:
        if name in self.placed:
            return self.placed[name]
        if name in views.VIEWS:
            return views.view(self.spark, self.sf_dir, name)
        if name in views.BASE_TABLES:
            return views.base(self.spark, self.sf_dir, name)
        raise AttributeError(name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def check(name: str, build: Callable[[Tables], DataFrame], sql: str | None = None) -> None:
    """Register a query; `sql` may use the adapter views and the base tables."""
    assert name not in QUERIES, name
    QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
    if sql is not None:
        used = sorted(set(re.findall(r"\bfx_[a-z_]+\b", sql)))
        body = sql.strip()
        if used:
            head = views.with_views(*used)
            # a statement with its own CTEs continues the list
            body = head.rstrip() + ",\n" + body[5:] if body[:5].lower() == "with " else head + body
        ORACLES[name] = body


def check_like(name: str, build: Callable[[Tables], DataFrame], other: str) -> None:
    """Register a query that has to give the rows of another one in a different way."""
    check(name, build)
    ORACLES[name] = ORACLES[other]
