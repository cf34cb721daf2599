"""Physical scalar expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridsonde import constants as K
from gridsonde.functions.numeric import clip


def coriolis(lat: Column, omega: float = K.OMEGA) -> Column:
    return F.lit(2.0 * omega) * F.sin(F.radians(lat))


def coriolis_floored(lat: Column, omega: float = K.OMEGA, floor: float = K.CORIOLIS_FLOOR) -> Column:
    """Coriolis parameter kept away from zero near the equator, with the sign of the latitude."""
    size = F.greatest(F.abs(coriolis(lat, omega)), F.lit(floor))
    return F.when(lat < 0, -size).otherwise(size)


def wind_stress_x(u: Column, v: Column) -> Column:
    return F.lit(K.RHO_AIR * K.DRAG_COEFFICIENT) * F.hypot(u, v) * u


def wind_stress_y(u: Column, v: Column) -> Column:
    return F.lit(K.RHO_AIR * K.DRAG_COEFFICIENT) * F.hypot(u, v) * v


def latitude_weight(lat: Column) -> Column:
    """cos(latitude) floored at 1e-3; divide by its mean over the latitude axis to normalise."""
    return F.greatest(F.cos(F.radians(lat)), F.lit(1e-3))


def is_land(elevation: Column) -> Column:
    """Unknown elevation is not land."""
    return F.coalesce(elevation >= F.lit(K.LAND_ELEVATION), F.lit(False))


def water_column(elevation: Column) -> Column:
    """Ocean depth, zero on land, NULL where the elevation is unknown."""
    return (F.when(is_land(elevation), F.lit(0.0))
            .when(elevation.isNotNull(), F.abs(F.least(elevation, F.lit(0.0)))))


def depth_valid(elevation: Column, depth: Column) -> Column:
    return ~is_land(elevation) & F.coalesce(water_column(elevation) > depth, F.lit(False))


def absolute_salinity(sp: Column) -> Column:
    return sp * F.lit(K.ABSOLUTE_SALINITY_RATIO)


def simple_density(theta: Column, sp: Column) -> Column:
    """Linear density used by the serving indices."""
    return F.lit(1025.0) - F.lit(0.15) * (theta - 10.0) + F.lit(0.76) * (absolute_salinity(sp) - 35.0)


def sigma_theta(theta: Column, sp: Column) -> Column:
    """One-atmosphere sea-water density minus 1000."""
    rho = (_poly(theta, K.DENSITY_PURE) + sp * _poly(theta, K.DENSITY_S)
           + F.pow(sp, F.lit(1.5)) * _poly(theta, K.DENSITY_S15) + F.lit(K.DENSITY_S2) * sp * sp)
    return rho - 1000.0


def _poly(x: Column, coefficients: Sequence[float]) -> Column:
    acc = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        acc = acc * x + F.lit(c)
    return acc


def intensification_score(sst: Column, tchp: Column, sla: Column, land: Column | None = None) -> Column:
    """Share of three thresholds met; a missing input does not count, land gives NULL."""
    def hit(cond: Column) -> Column:
        return F.coalesce(cond.cast("int"), F.lit(0))

    score = (hit(sst >= 28.0) + hit(tchp >= 60.0) + hit(sla >= 0.05)) / F.lit(3.0)
    return score if land is None else F.when(~land, score)


def classify_heat(tchp: Column) -> Column:
    return (F.when(tchp.isNull(), "UNKNOWN").when(tchp > K.HEAT_EXTREME, "EXTREME")
            .when(tchp >= K.HEAT_MODERATE, "MODERATE").otherwise("DEPLETED"))


def heat_text(heat_class: Column, texts: Mapping[str, str]) -> Column:
    """Text of a heat class (``constants.HEAT_LABELS`` or ``HEAT_RULES``); NULL for names that are no class."""
    return F.get(F.array(*map(F.lit, texts.values())), F.array_position(F.array(*map(F.lit, texts)), heat_class).cast("int") - 1)


def classify_mld(mld: Column) -> Column:
    return (F.when(mld < 30, F.lit("SHALLOW MLD")).when(mld > 60, F.lit("DEEP MLD"))
            .when(mld.isNotNull(), F.concat(F.lit("MLD "), F.round(mld).cast("int").cast("string"), F.lit(" m"))))


def freshwater_flag(surface_sp: Column) -> Column:
    return surface_sp < 33.2


def barrier_shown(blt: Column) -> Column:
    return blt > 1


def thermocline_base(z20: Column, mld: Column) -> Column:
    """Missing inputs give NULL, as a comparison with a missing number would."""
    base = F.least(F.lit(1000.0), F.greatest(z20, mld + 80.0, F.lit(200.0)))
    return F.when(z20.isNotNull() & mld.isNotNull(), base)


def reconstruct(climatology: Column, residual: Column) -> Column:
    return climatology + residual


def clip_sigma_theta(sigma: Column) -> Column:
    return clip(sigma, 1e-4, 5.0)


def clip_sigma_sp(sigma: Column) -> Column:
    return clip(sigma, 1e-4, 2.0)


def sigma_from_log(log_sigma: Column) -> Column:
    return F.exp(clip(log_sigma, -7.0, 2.0))


def good_flag(flag: Column) -> Column:
    """Quality flags 1 and 2, given as numbers, text or bytes."""
    return F.coalesce(F.trim(flag.cast("string")).isin(*K.GOOD_FLAGS), F.lit(False))
