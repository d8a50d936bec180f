"""Registered queries: name -> (function of session and table folder, SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
WHOLE: list[str] = []  # queries whose functions take a filter, which is true in the query


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def whole(cut: str, **more: str):
    """Makes a query with a filter as its third argument one over the whole table: the filter is ``true``.

    Its SQL has ``true`` for ``cut``, and ``new`` for ``old`` where a figure in it depends on the cut; the function's own default
    serves tests on few keys.
    """

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf: f(spark, sf, "true")
        WHOLE.append(f.__name__)
        assert cut in SQL[f.__name__]
        SQL[f.__name__] = SQL[f.__name__].replace(cut, "true")
        if more:
            SQL[f.__name__] = SQL[f.__name__].replace(more["old"], more["new"])
        return f

    return add
