"""NULL handling and nearest-value expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridsonde import constants as K


def finite(c: Column) -> Column:
    """NaN and infinities become NULL, so that aggregates skip them."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def fill_constant(c: Column, value: float, land: Column | None = None) -> Column:
    """Missing values (and land, when a mask is given) become ``value``."""
    filled = F.coalesce(finite(c), F.lit(float(value)))
    return filled if land is None else F.when(land, F.lit(float(value))).otherwise(filled)


def clip(c: Column, low: float, high: float) -> Column:
    """``greatest``/``least`` skip NULL, so a missing value needs its own guard."""
    return F.when(c.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), c)))


def unit(c: Column) -> Column:
    return clip(c, 0.0, 1.0)


def nearest_level(depth: Column, levels: Sequence[float] = K.STANDARD_DEPTHS) -> Column:
    """Closest level, the shallower one on a tie."""
    levels = sorted(levels)
    out = None
    for low, high in zip(levels, levels[1:]):
        cond = depth - F.lit(low) <= F.lit(high) - depth
        out = F.when(cond, F.lit(low)) if out is None else out.when(cond, F.lit(low))
    last = F.when(depth.isNotNull(), F.lit(levels[-1]))
    return last if out is None else out.otherwise(last)


def nearest_index(value: Column, start: float, step: float, n: int) -> Column:
    """Index of the closest centre of a regular axis, the lower one on a tie; no join needed."""
    position = F.ceil((value - F.lit(start)) / F.lit(step) - 0.5)
    return F.when(value.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(n - 1), position))).cast("int")


def nearest_site(lat: Column, lon: Column, sites: Sequence[tuple[str, float, float]] = K.MOORING_SITES) -> Column:
    """Name of the closest of a few named points by squared degree distance, first one on a tie."""
    best_name, best_d2 = None, None
    for name, site_lat, site_lon in sites:
        d2 = F.pow(F.lit(site_lat) - lat, 2) + F.pow(F.lit(site_lon) - lon, 2)
        if best_name is None:
            best_name, best_d2 = F.when(d2.isNotNull(), F.lit(name)), d2
        else:
            best_name = F.when(d2 < best_d2, F.lit(name)).otherwise(best_name)
            best_d2 = F.least(d2, best_d2)
    return best_name


def wrap_longitude(lon: Column) -> Column:
    """0..360 to -180..180."""
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0
