"""End-to-end jobs: each stage is a DataFrame function; tables are written only where several jobs share them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsonde import constants as K
from gridsonde.functions import physics as P
from gridsonde.functions.calendar import climatology_doy, season_cos, season_sin
from gridsonde.grid_spec import GridSpec
from gridsonde.operators import climate as C
from gridsonde.operators import grid as G
from gridsonde.operators import match as M
from gridsonde.operators import regrid as R
from gridsonde.operators import spatial as S
from gridsonde.operators import training as T
from gridsonde.operators import vertical as V
from gridsonde.sources import tables as ST


def job_regrid(raw: DataFrame, target: GridSpec, values: Sequence[str], keys: Sequence[str],
               aliases: Mapping[str, Sequence[str]] | None = None, interpolate_depth: bool = False,
               elevation: DataFrame | None = None, wrap: bool | None = None, unique: bool = False) -> DataFrame:
    """Raw gridded rows to the target grid: names, optional depth interpolation, remap, sea-floor mask.

    The source axes are the distinct coordinates of the raw rows. ``wrap`` says whether longitudes
    run 0..360, which otherwise takes a look at their range.
    """
    df = ST.standardize_coords(ST.alias_columns(raw, aliases or {}), wrap)
    lat_axis, lon_axis = df.select("lat").distinct(), df.select("lon").distinct()
    keys = list(keys)
    if interpolate_depth:
        column = [k for k in keys if k != "depth"] + ["lat", "lon"]
        levels = None
        for v in values:
            one = V.pchip_levels(df.select(*column, "depth", v), column, "depth", v, unique=unique)
            levels = one if levels is None else levels.join(one, [*column, "depth"], "full")
        df = levels
    out = R.conservative_regrid(df, lat_axis, lon_axis, target, values, keys, sy="lat", sx="lon")
    if elevation is None:
        return out
    return G.depth_truncation(out, elevation, values, depth="depth" if "depth" in keys else None)


def job_masks(raw_elevation: DataFrame, target: GridSpec, value: str = "elevation_m",
              levels: Sequence[float] = K.STANDARD_DEPTHS) -> tuple[DataFrame, DataFrame]:
    """Elevation on the target grid with land, water depth and both buffers; plus validity per level."""
    lat_axis, lon_axis = raw_elevation.select("lat").distinct(), raw_elevation.select("lon").distinct()
    elev = R.conservative_regrid(raw_elevation, lat_axis, lon_axis, target, [value], sy="lat", sx="lon", keep_uncovered=True)
    masks = G.build_masks(elev, value)
    masks = S.dilate_mask(masks, "land", K.COASTAL_BUFFER_CELLS, out="coastal")
    masks = S.dilate_mask(masks, "land", K.GRADIENT_BUFFER_CELLS, out="gradient_invalid")
    return masks, G.depth_validity(masks, levels, value)


def mask_counts(masks: DataFrame, validity: DataFrame) -> DataFrame:
    """Counts of what ``job_masks`` returns, as (name, depth, n): land, ocean and buffered ocean cells, and valid cells per level.

    One row per count; both sums combine map-side, so only counts are shuffled.
    """
    ocean = ~F.col("land")
    counts = {"land": F.col("land"), "ocean": ocean, "coastal": F.col("coastal") & ocean, "gradient_invalid": F.col("gradient_invalid") & ocean}
    one = masks.agg(F.array(*[F.struct(F.lit(n).alias("name"), F.count_if(c).alias("n")) for n, c in counts.items()]).alias("c"))
    cells = one.select(F.explode("c").alias("c")).select("c.name", F.lit(None).cast("double").alias("depth"), "c.n")
    levels = G.valid_per_depth(validity).select(F.lit("valid").alias("name"), F.col("depth").cast("double").alias("depth"), F.col("n_valid").alias("n"))
    return cells.unionByName(levels)


def job_features(winds: DataFrame, masks: DataFrame, spec: GridSpec, sst: DataFrame | None = None,
                 west: Column | None = None, east: Column | None = None) -> DataFrame:
    """Wind physics per day and cell with the calendar encoding and, given sst, the lagged box index.

    The calendar is an expression of the day. The index has one row per day: it joins the cells from the left, so a
    day's cells may be split or the index broadcast, and its days without cells follow as rows of their own.
    """
    out = S.physics_features(winds, masks, ["day"], spec)
    if sst is not None:
        index = C.box_index(sst, "sst", west if west is not None else C.in_box(K.DIPOLE_WEST),
                            east if east is not None else C.in_box(K.DIPOLE_EAST))
        index = index.select("day", "dmi", *[F.col(f"lag_{n}").alias(f"dmi_lag_{n}d") for n in K.INDEX_LAGS])
        alone = index.join(winds.select("day").distinct(), "day", "left_anti")
        out = out.join(index, "day", "left").unionByName(alone, allowMissingColumns=True)
    doy = climatology_doy(F.col("day"))
    return out.withColumns({"doy": doy, "doy_sin": season_sin(doy), "doy_cos": season_cos(doy)})


def job_climatology(df: DataFrame, keys: Sequence[str], values: Sequence[str], cell: Sequence[str],
                    splits: dict[str, tuple[str, str]] | None = None, split: str | None = "train",
                    min_samples: int = K.CLIMATOLOGY_MIN_SAMPLES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Climatology of one split with its gaps filled, anomalies of everything, and the baseline error."""
    withdoy = df.withColumn("doy", climatology_doy(F.col("day")))
    source = G.keep_split(withdoy, "day", split, splits, fall_back=True) if split else withdoy
    clim = C.daily_climatology(source, "doy", keys, values, min_samples)
    for v in values:
        clim = C.fill_doy_gaps(clim, "doy", keys, f"{v}_clim")
    on = ["doy", *keys]
    return clim, C.anomaly(withdoy, clim, on, values), C.climatology_mse(source, clim, on, cell, values)


def job_indices(cube: DataFrame, keys: Sequence[str], theta: str = "theta", sp: str = "sp", depth: str = "depth",
                serving: bool = False, sla: str | None = None, land: str | None = None) -> DataFrame:
    """Indices of every column: the 1 m validation family, or the coarse serving family with labels."""
    if not serving:
        rho = P.simple_density(F.col(theta), F.col(sp))
        level = cube.withColumn("__rho", rho)
        return V.column_indices(level, keys, depth, theta, "__rho")
    own = V.serving_indices(cube, keys, depth, theta, land)
    surface = cube.groupBy(*keys).agg(F.min_by(theta, depth).alias("sst"),
                                      *([F.min_by(sla, depth).alias("sla")] if sla else []))
    joined = own.join(surface, list(keys))
    sea_level = F.col("sla") if sla else F.lit(None).cast("double")
    is_land = F.coalesce(F.col("land"), F.lit(False)) if land else None
    return joined.withColumn("cip", P.intensification_score(F.col("sst"), F.col("tchp"), sea_level, is_land)).withColumn(
        "heat_class", P.classify_heat(F.col("tchp")))


def job_validation(levels: DataFrame, model: DataFrame, spec: GridSpec, flagged: bool = True,
                   unique: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """In-situ levels through quality control and matching to scores; also the pairs and counters."""
    clean = M.qc_filter(levels, ["profile_id"]) if flagged else levels
    matched = M.argo_match(clean, model, spec, unique=unique)
    return M.skill_by_dt(M.argo_pairs(matched)), matched, M.argo_counters(matched)


def job_training_table(surface: Mapping[str, DataFrame], targets: DataFrame, elevation: DataFrame, spec: GridSpec,
                       stats: Mapping[str, tuple[float, float]] | None = None) -> DataFrame:
    """Standardised seven-day channel windows with residual targets, one row per sample day and cell."""
    channels = T.channel_assembly(surface, elevation, spec)
    if stats:
        channels = T.standardize(channels, stats)
    return T.training_table(channels, targets, elevation)
