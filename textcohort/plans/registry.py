"""Queries by inventory id, each with its SQL for another engine where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import views

#: White space as Unicode sees it, and a text in lower case with it collapsed, in SQL.
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
NORM = f"trim(regexp_replace(lower(coalesce(text, '')), '{SPACE}', ' ', 'g'))"


def wordy(text: str) -> str:
    """A text whose letters beyond ASCII are underscores, so that the SQL engine's ASCII word boundaries are where Unicode's are."""
    return rf"regexp_replace({text}, '[^\x00-\x7F\p{{P}}\p{{S}}\p{{Z}}\p{{C}}]', '_', 'g')"


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of one folder and the views derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in views.VIEWS:
            return views.VIEWS[name](self)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register fn(tables) under a name; views named in the SQL are put before it."""

    def add(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = views.with_views(sql)
        return fn

    return add
