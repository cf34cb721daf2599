"""Grid axes, date spines, simple masks and row selections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridsonde import constants as K
from gridsonde.functions.calendar import split_label
from gridsonde.functions.physics import depth_valid, is_land, water_column
from gridsonde.grid_spec import GridSpec


def build_grid(spark: SparkSession, spec: GridSpec) -> DataFrame:
    """All cells of a regular grid with their centres."""
    return (
        spark.range(spec.n_lat * spec.n_lon)
        .select(
            F.floor(F.col("id") / spec.n_lon).cast("int").alias("iy"),
            F.pmod(F.col("id"), F.lit(spec.n_lon)).cast("int").alias("ix"),
        )
        .select("iy", "ix", spec.lat().alias("lat"), spec.lon().alias("lon"))
    )


def frame_cells(frames: DataFrame, spec: GridSpec, iy: str = "iy", ix: str = "ix") -> DataFrame:
    """Every grid cell for every frame row, generated from index sequences instead of a join."""
    return frames.withColumn(iy, F.explode(F.sequence(F.lit(0), F.lit(spec.n_lat - 1)))).withColumn(
        ix, F.explode(F.sequence(F.lit(0), F.lit(spec.n_lon - 1)))
    )


def cell_bounds(axis: DataFrame, centre: str, keys: Sequence[str] = (), low: str = "lo", high: str = "hi") -> DataFrame:
    """Edges of irregular cells: midpoints inside, mirrored at both ends.

    One window per axis; an axis is a dimension table, its length is the grid's. Centres must be
    distinct per axis (see :func:`check_axis`).
    """
    w = Window.partitionBy(*keys).orderBy(centre)
    c = F.col(centre)
    before, after = F.lag(c).over(w), F.lead(c).over(w)
    return (
        axis.withColumn("__before", before)
        .withColumn("__after", after)
        .withColumn(low, F.coalesce((F.col("__before") + c) / 2.0, c - (F.col("__after") - c) / 2.0))
        .withColumn(high, F.coalesce((c + F.col("__after")) / 2.0, c + (c - F.col("__before")) / 2.0))
        .drop("__before", "__after")
    )


def check_axis(axis: DataFrame, centre: str, keys: Sequence[str] = ()) -> DataFrame:
    """Axes that are not usable: fewer than two centres, missing or repeated centres."""
    return (
        axis.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count(centre).alias("n_known"),
            F.countDistinct(centre).alias("n_distinct"),
        )
        .filter((F.col("n_distinct") < 2) | (F.col("n_distinct") < F.col("n")) | (F.col("n_known") < F.col("n")))
    )


def cell_area(lat_lo: Column, lat_hi: Column, lon_lo: Column, lon_hi: Column,
              radius: float = K.EARTH_RADIUS_M) -> Column:
    """Area in square metres of a latitude/longitude cell on the sphere."""
    return (F.lit(radius * radius) * (F.sin(F.radians(lat_hi)) - F.sin(F.radians(lat_lo)))
            * (F.radians(lon_hi) - F.radians(lon_lo)))


def grid_spacing(axis: DataFrame, centre: str, keys: Sequence[str] = (), out: str = "step") -> DataFrame:
    """Spacing along an axis: half the distance between neighbours, one-sided at the ends."""
    w = Window.partitionBy(*keys).orderBy(centre)
    c = F.col(centre)
    before, after = F.lag(c).over(w), F.lead(c).over(w)
    return axis.withColumn(out, F.coalesce((after - before) / 2.0, after - c, c - before))


def day_spine(ranges: DataFrame, start: str, end: str, out: str = "day") -> DataFrame:
    """One row per calendar day of each inclusive range."""
    return ranges.withColumn(out, F.explode(F.sequence(F.col(start), F.col(end), F.expr("interval 1 day"))))


def monthly_windows(ranges: DataFrame, start: str, end: str) -> DataFrame:
    """Month-aligned windows covering each inclusive range, clipped to it."""
    months = F.sequence(F.trunc(F.col(start), "month"), F.col(end), F.expr("interval 1 month"))
    return (
        ranges.withColumn("__month", F.explode(months))
        .withColumn("window_start", F.greatest(F.col("__month"), F.col(start)))
        .withColumn("window_end", F.least(F.last_day("__month"), F.col(end)))
        .drop("__month")
    )


def label_split(df: DataFrame, day: str, splits: dict[str, tuple[str, str]] | None = None,
                out: str = "split") -> DataFrame:
    return df.withColumn(out, split_label(F.col(day), splits))


def keep_split(df: DataFrame, day: str, name: str, splits: dict[str, tuple[str, str]] | None = None,
               fall_back: bool = False) -> DataFrame:
    """Rows of one chronological split; ``val`` and ``validation`` mean the same.

    ``fall_back`` keeps everything when the split holds no row; the test is part of the plan.
    """
    ranges = dict(splits or K.SPLITS)
    if name not in ranges:
        name = {"val": "validation", "validation": "val"}.get(name, name)
    start, end = ranges[name]
    within = F.col(day).between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    kept = df.filter(within)
    if not fall_back:
        return kept
    return df.filter(within | (kept.select(day).limit(1).agg(F.count(F.lit(1))).scalar() == 0))


def bbox_filter(df: DataFrame, box: dict[str, float], lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Rows inside a box, edges included; plain comparisons, so they reach the Parquet scan."""
    return df.filter(
        F.col(lat).between(box["lat_min"], box["lat_max"]) & F.col(lon).between(box["lon_min"], box["lon_max"])
    )


def sub_basin(lon: Column, boundary: float = K.SUB_BASIN_LON) -> Column:
    return F.when(lon < boundary, F.lit("west")).when(lon.isNotNull(), F.lit("east"))


def build_masks(elevation: DataFrame, value: str = "elevation_m") -> DataFrame:
    """Land flag and water depth for each cell of an elevation table."""
    e = F.col(value)
    return elevation.withColumn("land", is_land(e)).withColumn("water_m", water_column(e))


def depth_validity(elevation: DataFrame, levels: Sequence[float] = K.STANDARD_DEPTHS, value: str = "elevation_m",
                   out: str = "valid") -> DataFrame:
    """One row per cell and level with the flag "the sea is deeper than this level here"."""
    return (
        elevation.withColumn("depth", F.explode(F.array(*[F.lit(float(z)) for z in levels])))
        .withColumn(out, depth_valid(F.col(value), F.col("depth")))
    )


def mask_join(df: DataFrame, mask: DataFrame, on: Sequence[str] = ("iy", "ix")) -> DataFrame:
    """Attach a static mask to every day.

    No broadcast hint: Catalyst broadcasts the mask when its measured size is below the session
    threshold and falls back to a shuffled join beyond it.
    """
    return df.join(mask, list(on), "left")


def depth_truncation(df: DataFrame, masks: DataFrame, values: Sequence[str], depth: str | None = None,
                     elevation: str = "elevation_m", on: Sequence[str] = ("iy", "ix")) -> DataFrame:
    """Values become NULL on land (surface fields) or at and below the sea floor (depth fields)."""
    joined = mask_join(df, masks.select(*on, F.col(elevation).alias("__elev")), on)
    e = F.col("__elev")
    keep = ~is_land(e) if depth is None else depth_valid(e, F.col(depth))
    return joined.withColumns({v: F.when(keep, F.col(v)) for v in values}).drop("__elev")


def mask_stats(masks: DataFrame, land: str = "land", buffered: str = "buffered") -> DataFrame:
    return masks.agg(
        F.count_if(F.col(land)).alias("n_land"),
        F.count_if(~F.col(land)).alias("n_ocean"),
        F.count_if(F.col(buffered) & ~F.col(land)).alias("n_buffer"),
    )


def valid_per_depth(validity: DataFrame, valid: str = "valid") -> DataFrame:
    return validity.groupBy("depth").agg(F.count_if(F.col(valid)).alias("n_valid"))


def fill_missing(df: DataFrame, values: Sequence[str], by: str = "mean") -> DataFrame:
    """Missing values become the mean of all known ones, taken by one scalar subquery per table."""
    if by != "mean":
        raise ValueError("use functions.numeric.fill_constant for constants")
    means = df.agg(F.struct(*[F.avg(v).alias(v) for v in values]).alias("m")).scalar()
    return df.withColumns({v: F.coalesce(F.col(v), means[v]) for v in values})


def select_layer(df: DataFrame, variables: dict[str, str], variable: str, depth: float) -> DataFrame:
    """One variable at one level, as ``value``; unknown names are an error."""
    if variable not in variables:
        raise ValueError(f"unknown variable {variable}; known: {sorted(variables)}")
    return df.filter(F.col("depth") == float(depth)).withColumn("value", F.col(variables[variable]))


def export_grid_rows(df: DataFrame, spec: GridSpec, value: str, box: dict[str, float],
                     digits: int = 3, keys: Sequence[str] = ()) -> DataFrame:
    """Crop a field and return one row per latitude with its values in longitude order.

    A row holds at most ``n_lon`` values; a field of several days needs the day among ``keys``. ``west/south/east/north`` are the outer cell edges.
    """
    half = spec.resolution / 2.0
    lats = [y for y in (spec.lat_start + spec.resolution * i for i in range(spec.n_lat)) if box["lat_min"] <= y <= box["lat_max"]]
    lons = [x for x in (spec.lon_start + spec.resolution * i for i in range(spec.n_lon)) if box["lon_min"] <= x <= box["lon_max"]]
    if not lats or not lons:
        raise ValueError("the box does not intersect the grid")
    cropped = bbox_filter(
        df.select(*keys, "iy", "ix", spec.lat().alias("lat"), spec.lon().alias("lon"), F.col(value).alias("v")), box
    )
    rows = cropped.groupBy(*keys, "iy", "lat").agg(
        F.sort_array(F.collect_list(F.struct("ix", F.bround("v", digits).alias("v")))).alias("cells")
    )
    return rows.select(
        *keys, "iy", "lat", F.transform("cells", lambda c: c["v"]).alias("values"), F.size("cells").alias("n_cols"),
        F.lit(lons[0] - half).alias("west"), F.lit(lats[0] - half).alias("south"),
        F.lit(lons[-1] + half).alias("east"), F.lit(lats[-1] + half).alias("north"),
    )
