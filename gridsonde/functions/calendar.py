"""Calendar expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridsonde import constants as K


def climatology_doy(day: Column) -> Column:
    """Day of year 1..365; 29 February counts as 28 February."""
    doy = F.dayofyear(day)
    leap = F.dayofyear(F.make_date(F.year(day), F.lit(12), F.lit(31))) == 366
    return F.when(leap & (doy >= 60), doy - 1).otherwise(doy).cast("int")


def season_sin(doy: Column, first_day_zero: bool = True) -> Column:
    return F.sin(_angle(doy, first_day_zero))


def season_cos(doy: Column, first_day_zero: bool = True) -> Column:
    return F.cos(_angle(doy, first_day_zero))


def _angle(doy: Column, first_day_zero: bool) -> Column:
    phase = doy - 1 if first_day_zero else doy
    return F.lit(2.0 * math.pi) * phase / F.lit(float(K.DAYS_PER_YEAR))


def days_since_1950(days: Column) -> Column:
    """Float days since 1950-01-01 to a timestamp."""
    epoch_micros = -631152000000000  # 1950-01-01T00:00:00Z
    return F.timestamp_micros((days * F.lit(86400000000.0)).cast("bigint") + F.lit(epoch_micros).cast("bigint"))


def dt_bin(abs_hours: Column) -> Column:
    """Time-distance class; bins are closed on both sides and the first match wins."""
    out = None
    for name, upper in K.DT_BINS_HOURS:
        cond = abs_hours <= upper
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out


def day_number(day: Column) -> Column:
    """Whole days since 1970-01-01, for RANGE frames over calendar days."""
    return F.datediff(day, F.lit("1970-01-01").cast("date"))


def split_label(day: Column, splits: dict[str, tuple[str, str]] | None = None) -> Column:
    """Name of the inclusive date range holding ``day``; NULL outside all of them."""
    out = None
    for name, (start, end) in (splits or K.SPLITS).items():
        cond = day.between(F.lit(start).cast("date"), F.lit(end).cast("date"))
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out
