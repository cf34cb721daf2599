"""Model-input tables: channel assembly, antecedent windows, standardisation, scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridsonde import constants as K
from gridsonde.functions.calendar import climatology_doy, day_number, season_cos, season_sin
from gridsonde.functions.numeric import finite, fill_constant
from gridsonde.functions.physics import coriolis_floored, depth_valid, is_land, water_column
from gridsonde.grid_spec import GridSpec
from gridsonde.operators.grid import mask_join
from gridsonde.sources.tables import alias_columns

_KEYS = ("day", "iy", "ix")


def channel_assembly(surface: Mapping[str, DataFrame], elevation: DataFrame, spec: GridSpec, base: str = "sst",
                     elevation_column: str = "elevation_m") -> DataFrame:
    """Twelve channels per (day, iy, ix): seven surface fields, w_e, f_tilde, depth, season.

    ``surface`` maps table names to tables holding the fields; the ``base`` table defines the rows.
    All joins use the same three keys, so each table is shuffled once. Absent fields, missing
    values and land become zero.
    """
    out = alias_columns(surface[base], K.SURFACE_ALIASES)
    wanted = [c for c in K.CHANNELS if c in (*K.SURFACE_ALIASES, "w_e")]
    out = out.select(*_KEYS, *[c for c in wanted if c in out.columns])
    for name, table in surface.items():
        if name == base:
            continue
        t = alias_columns(table, K.SURFACE_ALIASES)
        fields = [c for c in wanted if c in t.columns and c not in out.columns]
        if fields:
            out = out.join(t.select(*_KEYS, *fields), list(_KEYS), "left")
    out = mask_join(out, elevation.select("iy", "ix", F.col(elevation_column).alias("__e")))
    e, land = F.col("__e"), is_land(F.col("__e"))
    doy = climatology_doy(F.col("day"))
    made = {
        "f_tilde": coriolis_floored(spec.lat()), "water_column": water_column(e),
        "doy_sin": season_sin(doy), "doy_cos": season_cos(doy),
    }
    channels = []
    for c in K.CHANNELS:
        value = made.get(c, F.col(c) if c in out.columns else F.lit(0.0))
        channels.append(fill_constant(value.cast("double"), 0.0, land).alias(c))
    return out.select(*_KEYS, *channels)


def antecedent_window(df: DataFrame, keys: Sequence[str], day: str, values: Sequence[str], length: int = K.WINDOW_DAYS,
                      out: str = "window") -> DataFrame:
    """The ``length`` calendar days ending at each row, kept only where all of them exist.

    A RANGE frame over day numbers, so gaps never shift a window. Days are counted once: of repeated rows of a
    day all enter the window, but cannot stand in for another day.
    """
    w = Window.partitionBy(*keys).orderBy("__n").rangeBetween(-(length - 1), 0)
    item = F.struct(F.col(day).alias("day"), *[F.col(v).alias(v) for v in values])
    numbered = df.withColumn("__n", day_number(F.col(day)))
    return (
        numbered.withColumn(out, F.collect_list(item).over(w))
        .filter(F.size(F.array_distinct(F.transform(out, lambda x: x["day"]))) == length).drop("__n")
    )


def channel_stats(df: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Mean and population standard deviation per channel, as one row."""
    return df.agg(*[a for c in channels for a in (F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"))])


def standardize(df: DataFrame, stats: Mapping[str, tuple[float, float]], untouched: Sequence[str] = ("doy_sin", "doy_cos")) -> DataFrame:
    """(x - mean) / max(std, 1e-3) with supplied statistics; season channels stay as they are."""
    return df.withColumns({
        c: (F.col(c) - F.lit(float(m))) / F.lit(max(float(s), 1e-3)) for c, (m, s) in stats.items() if c not in untouched
    })


def standardize_by(df: DataFrame, train: DataFrame, channels: Sequence[str], untouched: Sequence[str] = ("doy_sin", "doy_cos")) -> DataFrame:
    """Standardisation with statistics fitted on ``train``, entering the plan as a scalar subquery."""
    fitted = [c for c in channels if c not in untouched]
    s = channel_stats(train, fitted).select(F.struct("*").alias("s")).scalar()
    return df.withColumns({
        c: (F.col(c) - s[f"{c}_mean"]) / F.greatest(s[f"{c}_std"], F.lit(1e-3)) for c in fitted})


def destandardize(value: Column, scale: float = 1.0) -> Column:
    return value * F.lit(float(scale))


def valid_targets(df: DataFrame, depth: str = "depth", elevation: str = "elevation_m", values: Sequence[str] = ("delta_theta", "delta_sp")) -> DataFrame:
    """Flag target cells below the surface and above the sea floor with all residuals known."""
    ok = depth_valid(F.col(elevation), F.col(depth))
    for v in values:
        ok = ok & F.coalesce(finite(F.col(v)).isNotNull(), F.lit(False))
    return df.withColumn("valid", ok)


def training_table(channels: DataFrame, targets: DataFrame, elevation: DataFrame, length: int = K.WINDOW_DAYS) -> DataFrame:
    """Windows joined with their residual targets.

    ``targets``: day, iy, ix, depth, delta_theta, delta_sp, theta_clim, sp_clim. One output row per
    sample day and cell: the window array plus an array of target levels with their valid flag.
    """
    windows = antecedent_window(channels, ("iy", "ix"), "day", K.CHANNELS, length).select("day", "iy", "ix", "window")
    t = mask_join(targets, elevation.select("iy", "ix", "elevation_m"))
    t = valid_targets(t)
    land = is_land(F.col("elevation_m"))
    fields = ["delta_theta", "delta_sp", "theta_clim", "sp_clim"]
    level = F.struct("depth", "valid", *[fill_constant(F.col(c), 0.0, land).alias(c) for c in fields])
    levels = t.groupBy("day", "iy", "ix").agg(F.sort_array(F.collect_list(level)).alias("targets"))
    return windows.join(levels, ["day", "iy", "ix"])


def score_windows(df: DataFrame, predict: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType | str) -> DataFrame:
    """Apply a caller's model to window rows, batch by batch, in Arrow form.

    ``predict`` gets a batch as a pandas frame and returns rows of ``schema``. No model is shipped.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield predict(batch)

    return df.mapInPandas(run, schema)
