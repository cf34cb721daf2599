"""Data-quality checks: tables in, one row per check with the number of violations out."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsonde import constants as K
from gridsonde.grid_spec import GridSpec
from gridsonde.operators.grid import mask_join


class QualityError(RuntimeError):
    """A table failed its checks."""


def _row(df: DataFrame, check: str, subject: str, n_bad: Column, ok: Column | None = None) -> DataFrame:
    bad = F.coalesce(n_bad, F.lit(0)).cast("bigint")
    return df.agg(bad.alias("n_bad"), (bad == 0 if ok is None else ok).alias("ok")).select(
        F.lit(check).alias("check"), F.lit(subject).alias("subject"), "n_bad", "ok")


def _axis_check(df: DataFrame, column: str, n: int, expected: Column, tolerance: float, index: str | None) -> DataFrame:
    """Distinct values of an axis column against its expected centres.

    The k-th centre is a closed form of the index, so no expected table is joined. Counted as bad:
    values off their centre, plus the difference between the known and the expected axis length.
    """
    values = df.select(*([index] if index else []), column).filter(F.col(column).isNotNull()).distinct()
    off = F.count_if(F.abs(F.col(column) - expected) > tolerance)
    return _row(values, f"axis_{column}", column, off + F.abs(F.countDistinct(column) - n))


def check_grid(df: DataFrame, spec: GridSpec, levels: Sequence[float] | None = K.STANDARD_DEPTHS) -> DataFrame:
    """Axis sizes, cell centres within 1e-4 degrees and depth levels within 1e-3 metres."""
    parts = [
        _axis_check(df, "lat", spec.n_lat, spec.lat("iy"), 1e-4, "iy"),
        _axis_check(df, "lon", spec.n_lon, spec.lon("ix"), 1e-4, "ix"),
    ]
    if levels is not None:
        wanted = F.array(*[F.lit(float(z)) for z in levels])
        nearest = F.array_min(F.transform(wanted, lambda z: F.abs(z - F.col("depth")))) + F.col("depth")
        parts.append(_axis_check(df, "depth", len(levels), nearest, 1e-3, None))
    return reduce(DataFrame.unionByName, parts)


def check_land_null(df: DataFrame, mask: DataFrame, values: Sequence[str], land: str = "land") -> DataFrame:
    """No known value on land, over all days and depths."""
    joined = mask_join(df.select("iy", "ix", *values), mask.select("iy", "ix", F.col(land).alias("__land")))
    counts = joined.agg(*[F.count_if(F.col("__land") & F.col(v).isNotNull()).alias(v) for v in values])
    rows = F.explode(F.array(*[F.struct(F.lit(v).alias("subject"), F.col(v).alias("n_bad")) for v in values]))
    return counts.select(rows.alias("r")).select(
        F.lit("land_null").alias("check"), "r.subject", "r.n_bad", (F.col("r.n_bad") == 0).alias("ok"))


def check_coriolis(df: DataFrame, column: str = "f_tilde") -> DataFrame:
    """The floored Coriolis parameter is known and not below its floor."""
    c = F.col(column)
    bad = F.count_if(c.isNull() | F.isnan(c) | (F.abs(c) < K.CORIOLIS_FLOOR - 1e-12))
    return _row(df, "coriolis", column, bad)


def check_curl_spikes(df: DataFrame, mask: DataFrame, column: str = "curl", max_abs: float = K.CURL_SPIKE,
                      land: str = "land") -> DataFrame:
    """At most 0.1 % of the known ocean values may exceed the limit; no known ocean value is an error."""
    joined = mask_join(df.select("iy", "ix", column), mask.select("iy", "ix", F.col(land).alias("__land")))
    ocean = joined.filter(~F.coalesce(F.col("__land"), F.lit(False)) & F.col(column).isNotNull())
    n, spikes = F.count(F.lit(1)), F.count_if(F.abs(F.col(column)) > max_abs)
    return _row(ocean, "curl_spikes", column, spikes, (n > 0) & (spikes <= n * K.CURL_SPIKE_SHARE))


def quality_report(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def require_ok(report: DataFrame) -> None:
    """Raise when any check failed; the report has one row per check and column."""
    failed = report.filter(~F.col("ok")).select("check", "subject", "n_bad").collect()
    if failed:
        raise QualityError("; ".join(f"{r['check']}({r['subject']}): {r['n_bad']}" for r in failed))
