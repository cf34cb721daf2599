"""Named queries over the supplied tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsonde.plans.fixtures import view, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Views of one data folder by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)


def query(name: str, sql: str | None = None, views: tuple[str, ...] = (), ctes: str = "") -> Callable:
    """Register a function of :class:`Tables`; ``sql`` sees ``views`` and then ``ctes``."""
    def register(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            clauses = [c for c in (with_views(*views) if views else "", ctes) if c]
            ORACLES[name] = (f"WITH {', '.join(clauses)} {sql}" if clauses else sql)
        return fn

    return register


def r(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def rounded(df: DataFrame, *names: str, digits: int = 6, shift: float = 0.0) -> DataFrame:
    """``shift`` moves short decimals off rounding ties, where engines may disagree."""
    return df.withColumns({n: F.round(F.col(n) - shift if shift else F.col(n), digits) for n in names})


def text(c: Column | str) -> Column:
    """Dates and timestamps as text, which compares alike in every engine."""
    return (F.col(c) if isinstance(c, str) else c).cast("string")
