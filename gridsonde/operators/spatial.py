"""Neighbourhood operators on (frame, iy, ix) tables: derivatives, medians, dilation, wind curl.

Stencils of two axes are evaluated on *halo tiles*: a row goes to its own tile and, near an edge,
also to the neighbouring tiles that need it. After one shuffle on (frame, tile) every window of
either axis is local to the task, no matter how many stencils are chained, and a task holds at most
``(tile + 2 * halo)**2`` cells of one frame however large the grid or how few the frames.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridsonde import constants as K
from gridsonde.functions.physics import coriolis, coriolis_floored, wind_stress_x, wind_stress_y
from gridsonde.grid_spec import GridSpec
from gridsonde.operators.grid import build_grid, frame_cells, mask_join

TILE = 64
_TILE_KEYS = ("__ty", "__tx")


def halo_tiles(df: DataFrame, frame: Sequence[str], halo: int, tile: int = TILE) -> DataFrame:
    """Copy rows to every tile that needs them and shuffle by (frame, tile)."""
    if tile < 2 * halo + 1:
        raise ValueError("a tile must be wider than its halo")

    def owners(index: str) -> Column:
        i = F.col(index)
        first = F.greatest(F.lit(0), F.floor((i - halo) / tile).cast("int"))
        return F.explode(F.sequence(first, F.floor((i + halo) / tile).cast("int")))

    return (
        df.withColumn("__ty", owners("iy")).withColumn("__tx", owners("ix"))
        .repartition(*frame, *_TILE_KEYS)
    )


def own_cells(tiled: DataFrame, tile: int = TILE) -> DataFrame:
    """Drop halo copies after the stencils are done."""
    own = (F.floor(F.col("iy") / tile) == F.col("__ty")) & (F.floor(F.col("ix") / tile) == F.col("__tx"))
    return tiled.filter(own).drop(*_TILE_KEYS)


def with_all_cells(df: DataFrame, frame: Sequence[str], spec: GridSpec) -> DataFrame:
    """Append a NULL row for every grid cell of every frame; :func:`merge_cells` folds them in."""
    if frame:
        spine = frame_cells(df.select(*frame).distinct(), spec)
    else:
        spine = build_grid(df.sparkSession, spec).select("iy", "ix")
    return df.unionByName(spine, allowMissingColumns=True)


def merge_cells(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per cell: a cell holds one data row, so the maximum picks it over the NULL row.

    On a table already shuffled by (frame, tile) this adds no shuffle.
    """
    values = [c for c in df.columns if c not in (*keys, "iy", "ix")]
    return df.groupBy(*keys, "iy", "ix").agg(*[F.max(v).alias(v) for v in values])


def densify(df: DataFrame, frame: Sequence[str], spec: GridSpec) -> DataFrame:
    """Every grid cell of every frame, with NULL values where the input has no row."""
    return merge_cells(with_all_cells(df, frame, spec), frame)


def _along(axis: str, keys: Sequence[str]) -> tuple[Window, str]:
    """Ordered window running along an axis and the index column it is ordered by."""
    across, index = ("iy", "ix") if axis == "x" else ("ix", "iy")
    return Window.partitionBy(*keys, across).orderBy(index), index


def _neighbours(df: DataFrame, keys: Sequence[str], axis: str, columns: Sequence[str]) -> DataFrame:
    """Values of the previous and next cell along an axis; NULL where that cell is absent."""
    w, index = _along(axis, keys)
    i = F.col(index)
    has_prev, has_next = F.lag(index).over(w) == i - 1, F.lead(index).over(w) == i + 1
    out = []
    for c in columns:
        out += [F.when(has_prev, F.lag(c).over(w)).alias(f"{c}__p"), F.when(has_next, F.lead(c).over(w)).alias(f"{c}__n")]
    return df.select(*df.columns, *out)


def _difference(field: str, spacing: Column, spacing_prev: Column, spacing_next: Column, valid: str) -> Column:
    """Centred difference where both neighbours are valid, one-sided where one is, else NULL."""
    v, p, n = F.col(field), F.col(f"{field}__p"), F.col(f"{field}__n")
    here = F.col(valid) & v.isNotNull()
    ok_p = F.coalesce(F.col(f"{valid}__p") & p.isNotNull(), F.lit(False))
    ok_n = F.coalesce(F.col(f"{valid}__n") & n.isNotNull(), F.lit(False))
    one_sided = F.greatest(spacing, F.lit(1e-6))
    return (F.when(here & ok_p & ok_n, (n - p) / (spacing_next + spacing_prev))
            .when(here & ok_n, (n - v) / one_sided)
            .when(here & ok_p, (v - p) / one_sided))


def masked_derivative(df: DataFrame, frame: Sequence[str], field: str, spacing: str, valid: str, axis: str,
                      out: str = "derivative") -> DataFrame:
    """Derivative of one field along one axis; a single window per grid row or column suffices."""
    n = _neighbours(df, frame, axis, [field, spacing, valid])
    d = _difference(field, F.col(spacing), F.col(f"{spacing}__p"), F.col(f"{spacing}__n"), valid)
    return n.select(*df.columns, d.alias(out))


def dilate_mask(mask: DataFrame, value: str, n: int, frame: Sequence[str] = (), out: str = "buffered",
                tile: int = TILE) -> DataFrame:
    """Square dilation by ``n`` cells of a mask given for every cell; ``n <= 0`` copies it."""
    if n <= 0:
        return mask.withColumn(out, F.col(value))
    tiled = halo_tiles(mask, frame, n, max(tile, 2 * n + 1))
    return own_cells(_dilate(tiled, (*frame, *_TILE_KEYS), value, n, out), max(tile, 2 * n + 1))


def known_days(df: DataFrame, value: str, day: str = "day", cell: Sequence[str] = ("iy", "ix")) -> DataFrame:
    """Days with a known value per cell as bitmaps: cell, bucket, days.

    Repeated rows of a day set the same bit. Bitmaps of several tables are united by ``merged_days``.
    """
    n = F.datediff(F.col(day), F.lit("1970-01-01").cast("date")).cast("bigint")
    return df.filter(F.col(value).isNotNull() & F.col(day).isNotNull()).groupBy(*cell, F.bitmap_bucket_number(n).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(n)).alias("days"))


def merged_days(days: DataFrame, cell: Sequence[str] = ("iy", "ix")) -> DataFrame:
    return days.groupBy(*cell, "bucket").agg(F.bitmap_or_agg("days").alias("days"))


def land_on_grid(days: DataFrame, spec: GridSpec, n_days: Column, buffer: int = K.COASTAL_BUFFER_CELLS) -> DataFrame:
    """Land and its coastal buffer for every cell of the grid, from the days on which cells are known.

    ``n_days``: how many days there are. Cells known on fewer than half of them are land, absent cells too; without
    any day the whole grid is.
    """
    counts = days.groupBy("iy", "ix").agg(F.sum(F.bitmap_count("days")).alias("__n"))
    frac = F.coalesce(F.col("__n") / F.when(n_days > 0, n_days), F.lit(0.0))
    cells = build_grid(days.sparkSession, spec).join(counts, ["iy", "ix"], "left")
    land = cells.select("iy", "ix", frac.alias("frac")).withColumn("land", F.col("frac") < K.COVERAGE_LAND_FRACTION)
    return dilate_mask(land, "land", buffer, out="coastal")


def _dilate(tiled: DataFrame, keys: Sequence[str], value: str, n: int, out: str) -> DataFrame:
    """Rows, then columns; RANGE frames measure index distance, not position."""
    wx, _ = _along("x", keys)
    wy, _ = _along("y", keys)
    columns = [c for c in tiled.columns if c != out]
    rows = tiled.select(*columns, F.max(value).over(wx.rangeBetween(-n, n)).alias("__row"))
    return rows.select(*columns, F.max("__row").over(wy.rangeBetween(-n, n)).alias(out))


def _median3(tiled: DataFrame, keys: Sequence[str], fields: Sequence[str], spec: GridSpec) -> DataFrame:
    """3x3 median ignoring NULL, with the grid's edge cells replicated outwards."""
    iy, ix = F.col("iy"), F.col("ix")
    base = tiled.columns
    t = _neighbours(tiled, keys, "x", fields)
    row = []
    for f in fields:
        row += [F.when(ix == 0, F.col(f)).otherwise(F.col(f"{f}__p")).alias(f"{f}__w"), F.col(f).alias(f"{f}__c"),
                F.when(ix == spec.n_lon - 1, F.col(f)).otherwise(F.col(f"{f}__n")).alias(f"{f}__e")]
    t = t.select(*base, *row)
    triple = [f"{f}__{s}" for f in fields for s in ("w", "c", "e")]
    t = _neighbours(t, keys, "y", triple)
    outs = []
    for f in fields:
        cells = []
        for s in ("w", "c", "e"):
            c = F.col(f"{f}__{s}")
            cells += [F.when(iy == 0, c).otherwise(F.col(f"{f}__{s}__p")), c,
                      F.when(iy == spec.n_lat - 1, c).otherwise(F.col(f"{f}__{s}__n"))]
        outs.append(_median_of(cells).alias(f))
    return t.select(*[c for c in base if c not in fields], *outs)


def _median_of(cells: Sequence[Column]) -> Column:
    known = F.lit(0)
    for c in cells:
        known = known + c.isNotNull().cast("int")
    ordered = F.sort_array(F.array(*cells))  # NULLs first
    missing = F.lit(len(cells)) - known
    low = (missing + F.floor((known + 1) / 2)).cast("int")
    high = (missing + F.floor(known / 2) + 1).cast("int")
    return F.when(known > 0, (F.element_at(ordered, low) + F.element_at(ordered, high)) / 2.0)


def median3x3(df: DataFrame, frame: Sequence[str], fields: Sequence[str], spec: GridSpec, dense: bool = False,
              tile: int = TILE) -> DataFrame:
    """3x3 NULL-ignoring median of each field; absent cells are added first unless ``dense``."""
    keys = (*frame, *_TILE_KEYS)
    tiled = halo_tiles(df if dense else with_all_cells(df, frame, spec), frame, 1, tile)
    tiled = tiled if dense else merge_cells(tiled, keys)
    return own_cells(_median3(tiled, keys, fields, spec), tile)


def wind_features(winds: DataFrame, mask: DataFrame, frame: Sequence[str], spec: GridSpec, u: str = "u10",
                  v: str = "v10", land: str = "land", dense: bool = False, tile: int = TILE) -> DataFrame:
    """Stress, boundary-safe stress curl and Ekman pumping for every frame, in one tile shuffle.

    ``mask`` has a row per cell with the ``land`` flag. Gradients avoid land and its neighbours;
    the medians then refill the neighbours, and land is NULL in the end. Output rows: every grid
    cell of every frame, with tau_x, tau_y, curl, w_e, land and the ``invalid`` gradient mask.
    """
    static = dilate_mask(mask.select("iy", "ix", F.coalesce(F.col(land), F.lit(False)).alias("land")), "land",
                         K.GRADIENT_BUFFER_CELLS, out="invalid")
    fields = winds.select(*frame, "iy", "ix", F.col(u).alias("u"), F.col(v).alias("v"))
    full = fields if dense else with_all_cells(fields, frame, spec)
    cells = mask_join(full, static).fillna({"land": False, "invalid": False})
    sea = ~F.col("land")
    tau_x = F.when(sea, wind_stress_x(F.col("u"), F.col("v")))
    tau_y = F.when(sea, wind_stress_y(F.col("u"), F.col("v")))
    keys = (*frame, *_TILE_KEYS)
    t = halo_tiles(cells.select(*frame, "iy", "ix", "land", "invalid", tau_x.alias("tau_x"), tau_y.alias("tau_y")),
                   frame, 2, tile)
    t = t if dense else merge_cells(t, keys)
    scale = F.lit(K.RHO_SEA) * coriolis_floored(spec.lat())
    t = t.select(*t.columns, (~F.col("invalid")).alias("ok"), (F.col("tau_y") / scale).alias("ux"),
                 (-F.col("tau_x") / scale).alias("uy"))
    base = t.columns
    dy, dx = spec.dy(), spec.dx()
    t = _neighbours(t, keys, "y", ["tau_x", "uy", "ok"])
    t = t.select(*base, _difference("tau_x", dy, dy, dy, "ok").alias("dtx"), _difference("uy", dy, dy, dy, "ok").alias("duy"))
    base = [c for c in t.columns if c != "uy"]
    t = _neighbours(t, keys, "x", ["tau_y", "ux", "ok"])
    curl = _difference("tau_y", dx, dx, dx, "ok") - F.col("dtx")
    div = _difference("ux", dx, dx, dx, "ok") + F.col("duy")
    keep = [*frame, "iy", "ix", *_TILE_KEYS, "land", "invalid", "tau_x", "tau_y"]
    t = _median3(t.select(*keep, curl.alias("curl"), div.alias("div")), keys, ["curl", "div"], spec)
    south = spec.lat() < K.BETA_PLANE_LATITUDE
    w_e = F.when(south, F.col("div")).otherwise(F.col("curl") / scale)
    return own_cells(t, tile).select(
        *frame, "iy", "ix", "land", "invalid", "tau_x", "tau_y",
        F.when(~F.col("land"), F.col("curl")).alias("curl"), F.when(~F.col("land"), w_e).alias("w_e"),
    )


def curl_stats(features: DataFrame, frame: Sequence[str]) -> DataFrame:
    return features.groupBy(*frame).agg(
        F.count_if(F.col("land")).alias("n_land"),
        F.count_if(F.col("invalid") & ~F.col("land")).alias("n_buffer"),
        F.count("curl").alias("n_curl"),
    )


def physics_features(winds: DataFrame, mask: DataFrame, frame: Sequence[str], spec: GridSpec, **options) -> DataFrame:
    """Wind features with the Coriolis parameter and its floored form."""
    lat = spec.lat()
    return wind_features(winds, mask, frame, spec, **options).withColumns({
        "f": coriolis(lat), "f_tilde": coriolis_floored(lat)})
