"""Horizontal remapping: overlap-weighted (conservative) and bilinear."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsonde.grid_spec import GridSpec
from gridsonde.operators.grid import build_grid, cell_bounds, frame_cells

EDGE_DUST = 1e-9  # degrees; overlaps below it are rounding of cells that merely touch


def axis_of(df: DataFrame, index: str, centre: str) -> DataFrame:
    """Distinct (index, centre) pairs of a field: its axis table."""
    return df.select(index, centre).distinct()


def interval_buckets(df: DataFrame, low: Column, high: Column, width: float, out: str) -> DataFrame:
    """One row per bucket of the given width that the interval touches: the equi-key of a range join."""
    return df.withColumn(out, F.explode(F.sequence(
        F.floor(low / width).cast("bigint"), F.floor(high / width).cast("bigint"))))


def overlap_weights(src: DataFrame, dst: DataFrame, width: float, spherical: bool, src_index: str, dst_index: str) -> DataFrame:
    """Overlap of source and target cells of one axis, both with ``lo``/``hi`` edges in degrees.

    A bucketed equi-join instead of a nested loop; a pair that shares several buckets is kept only
    in the one where its overlap starts. Latitude overlaps are differences of sines.
    """
    s = interval_buckets(src.select(src_index, F.col("lo").alias("s_lo"), F.col("hi").alias("s_hi")),
                         F.col("s_lo"), F.col("s_hi"), width, "__b")
    d = interval_buckets(dst.select(dst_index, F.col("lo").alias("d_lo"), F.col("hi").alias("d_hi")),
                         F.col("d_lo"), F.col("d_hi"), width, "__b")
    lo, hi = F.greatest("s_lo", "d_lo"), F.least("s_hi", "d_hi")
    pairs = s.join(d, "__b").filter((hi - lo > EDGE_DUST) & (F.floor(lo / width) == F.col("__b")))
    size = F.sin(F.radians(hi)) - F.sin(F.radians(lo)) if spherical else F.radians(hi - lo)
    return pairs.select(src_index, dst_index, size.alias("w"))


def regular_axis(df_axis: DataFrame, spec: GridSpec, axis: str) -> DataFrame:
    """Axis table with edges for a regular target grid."""
    centre = spec.lat("i") if axis == "lat" else spec.lon("i")
    half = spec.resolution / 2.0
    return df_axis.select("i", (centre - half).alias("lo"), (centre + half).alias("hi"))


def known_small(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """Broadcast a table whose row count has been looked at and is within bounds; else leave it to Catalyst.

    Estimates of derived tables are too coarse for Catalyst to see that an axis is small, and without
    the hint the whole field would be shuffled by a handful of axis positions.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def _weighted_means(rows: DataFrame, values: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Weighted mean of the known values per target cell; the sums combine map-side before the shuffle."""
    w = F.col("w_lat") * F.col("w_lon")
    aggs = []
    for v in values:
        known = F.col(v).isNotNull()
        aggs += [F.sum(F.when(known, w * F.col(v))).alias(f"__{v}_n"), F.sum(F.when(known, w)).alias(f"__{v}_d")]
    sums = rows.groupBy(*keys, "ty", "tx").agg(*aggs)
    return sums.select(*keys, F.col("ty").alias("iy"), F.col("tx").alias("ix"), *[
        F.when(F.col(f"__{v}_d") > 0, F.col(f"__{v}_n") / F.col(f"__{v}_d")).alias(v) for v in values])


def _on_all_cells(out: DataFrame, field: DataFrame, target: GridSpec, keys: Sequence[str]) -> DataFrame:
    if keys:
        spine = frame_cells(field.select(*keys).distinct(), target)
    else:
        spine = build_grid(field.sparkSession, target).select("iy", "ix")
    return spine.join(out, [*keys, "iy", "ix"], "left")


def regrid_regular(field: DataFrame, source: GridSpec, target: GridSpec, values: Sequence[str], keys: Sequence[str] = (),
                   keep_uncovered: bool = False) -> DataFrame:
    """First-order conservative remap between regular grids, without any join.

    The target cells a source cell touches and the overlaps are closed-form functions of its
    indices, so rows are expanded in place and one shuffle carries the partial sums.
    """
    def overlaps(index: str, start: float, t_start: float, n: int, out: str) -> Column:
        low = F.lit(start) + F.lit(source.resolution) * (F.col(index) - 0.5)
        high = low + source.resolution
        edge, step = t_start - target.resolution / 2.0, target.resolution
        first = F.greatest(F.lit(0), F.floor((low - edge) / step).cast("int"))
        last = F.least(F.lit(n - 1), F.ceil((high - edge) / step).cast("int") - 1)
        return F.explode(F.when(first <= last, F.sequence(first, last))).alias(out)

    def piece(index: str, start: float, t_start: float, t: str) -> tuple[Column, Column]:
        low = F.lit(start) + F.lit(source.resolution) * (F.col(index) - 0.5)
        t_low = F.lit(t_start) + F.lit(target.resolution) * (F.col(t) - 0.5)
        return F.greatest(low, t_low), F.least(low + source.resolution, t_low + target.resolution)

    rows = field.select(*keys, "iy", "ix", *values)
    rows = rows.select("*", overlaps("iy", source.lat_start, target.lat_start, target.n_lat, "ty"))
    rows = rows.select("*", overlaps("ix", source.lon_start, target.lon_start, target.n_lon, "tx"))
    (y0, y1), (x0, x1) = piece("iy", source.lat_start, target.lat_start, "ty"), piece("ix", source.lon_start, target.lon_start, "tx")
    rows = rows.select(
        *keys, *values, "ty", "tx", F.when(y1 - y0 > EDGE_DUST, F.sin(F.radians(y1)) - F.sin(F.radians(y0))).alias("w_lat"),
        F.when(x1 - x0 > EDGE_DUST, F.radians(x1 - x0)).alias("w_lon")).filter("w_lat is not null and w_lon is not null")
    out = _weighted_means(rows, values, keys)
    return _on_all_cells(out, field, target, keys) if keep_uncovered else out


def conservative_regrid(field: DataFrame, src_lat: DataFrame, src_lon: DataFrame, target: GridSpec, values: Sequence[str],
                        keys: Sequence[str] = (), lat: str = "lat", lon: str = "lon", sy: str = "iy",
                        sx: str = "ix", keep_uncovered: bool = False) -> DataFrame:
    """First-order conservative remap of all ``values`` from irregular axes onto a regular grid.

    ``src_lat(sy, lat)`` and ``src_lon(sx, lon)`` are the source axes; an axis may be its own index.
    Per axis the overlap weights form a small table whose size is checked before it is broadcast.
    Missing source values drop out of both sums. Target cells no source cell overlaps are absent
    unless ``keep_uncovered``. For regular sources :func:`regrid_regular` needs no table at all.
    """
    spark = field.sparkSession
    rows = spark.range(target.n_lat).select(F.col("id").cast("int").alias("i"))
    cols = spark.range(target.n_lon).select(F.col("id").cast("int").alias("i"))
    t_lat = regular_axis(rows, target, "lat").withColumnRenamed("i", "ty")
    t_lon = regular_axis(cols, target, "lon").withColumnRenamed("i", "tx")
    width = target.resolution
    w_lat = overlap_weights(cell_bounds(src_lat, lat), t_lat, width, True, sy, "ty").withColumnRenamed("w", "w_lat")
    w_lon = overlap_weights(cell_bounds(src_lon, lon), t_lon, width, False, sx, "tx").withColumnRenamed("w", "w_lon")
    joined = field.select(*keys, sy, sx, *values).join(known_small(w_lat), sy).join(known_small(w_lon), sx)
    out = _weighted_means(joined, values, keys)
    return _on_all_cells(out, field, target, keys) if keep_uncovered else out


def nearest_source_levels(src_levels: Sequence[float], levels: Sequence[float]) -> dict[float, float | None]:
    """For each target level the closest source level (shallower on a tie), None outside their range."""
    src = sorted(src_levels)
    out: dict[float, float | None] = {}
    for z in levels:
        inside = src[0] <= z <= src[-1]
        out[float(z)] = min(src, key=lambda s: (abs(s - z), s)) if inside else None
    return out


def select_levels(field: DataFrame, depth: str, src_levels: Sequence[float], levels: Sequence[float]) -> DataFrame:
    """Rows repeated for the target levels their own level is nearest to; others are dropped."""
    table = F.array(*[F.struct(F.lit(z).alias("z"), F.lit(s).alias("s"))
                      for z, s in nearest_source_levels(src_levels, levels).items() if s is not None])
    hits = F.transform(F.filter(table, lambda t: t["s"] == F.col(depth)), lambda t: t["z"])
    return field.withColumn("__z", F.explode(hits)).withColumn(depth, F.col("__z")).drop("__z")


def corner(position: Column, n: int) -> Column:
    """Lower bracketing index of a fractional axis position; an exact node belongs to the cell before it."""
    return F.greatest(F.lit(0), F.least(F.lit(n - 2), F.ceil(position) - 1)).cast("int")


def bilinear_regrid(field: DataFrame, source: GridSpec, targets: DataFrame, values: Sequence[str],
                    keys: Sequence[str] = (), lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Linear interpolation in latitude and longitude from a regular grid to target points.

    ``targets`` needs an id per point in its remaining columns. The field is brought into one row
    per lower corner and key with the values of all four corners, so that a point meets whole
    stencils by a merge join and points times keys are neither held nor shuffled. A missing corner
    and a repeated point give NULL, a point outside the source centres gives no row.
    """
    ids = [c for c in targets.columns if c not in (lat, lon)]
    py = (F.col(lat) - source.lat_start) / source.resolution
    px = (F.col(lon) - source.lon_start) / source.resolution
    y0, x0 = corner(py, source.n_lat), corner(px, source.n_lon)
    inside = py.between(0.0, source.n_lat - 1.0) & px.between(0.0, source.n_lon - 1.0)
    # dealt out before they are counted, as one file of points may be read by one task
    points = targets.filter(inside).repartition(*ids, lat, lon).groupBy(*ids, lat, lon).agg(F.count("*").alias("__m"))
    points = points.select(*ids, "__m", y0.alias("__y"), x0.alias("__x"), (py - y0).alias("__fy"), (px - x0).alias("__fx"))

    offsets = [(dy, dx) for dy in (0, 1) for dx in (0, 1)]
    places = F.array(*[F.struct((F.col("iy") - dy).alias("__y"), (F.col("ix") - dx).alias("__x"), F.lit(k).alias("__k"))
                       for k, (dy, dx) in enumerate(offsets)])
    placed = field.select(*keys, *values, F.explode(places).alias("__p")).select(*keys, *values, "__p.*")
    placed = placed.filter(F.col("__y").between(0, max(0, source.n_lat - 2)) & F.col("__x").between(0, max(0, source.n_lon - 2)))
    sums = [F.sum(F.when(F.col("__k") == k, F.col(v))).alias(f"__{v}_{k}") for v in values for k in range(4)]
    stencils = placed.groupBy("__y", "__x", *keys).agg(*sums, *[F.count(v).alias(f"__{v}_n") for v in values])

    def value(v: str) -> Column:
        total = F.lit(0.0)
        for k, (dy, dx) in enumerate(offsets):
            w = (F.col("__fy") if dy else 1.0 - F.col("__fy")) * (F.col("__fx") if dx else 1.0 - F.col("__fx"))
            total = total + w * F.coalesce(F.col(f"__{v}_{k}"), F.lit(0))
        # a point given m times counts its known corners m times
        return F.when(F.col("__m") * F.col(f"__{v}_n") == 4, F.col("__m") * total).alias(v)

    return points.join(stencils.hint("merge"), ["__y", "__x"]).select(*ids, *keys, *[value(v) for v in values])
