"""Time series: daily means, calendar-day climatology, anomalies, gap filling, index lags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridsonde import constants as K
from gridsonde.operators.vertical import spread_columns


def daily_mean(df: DataFrame, ts: str, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Mean per UTC day; partial aggregation runs before the shuffle, so a hot key costs one row per task."""
    return df.groupBy(*keys, F.to_date(F.col(ts)).alias("day")).agg(*[F.avg(v).alias(v) for v in values])


def lag_features(df: DataFrame, value: str, order: str = "day", keys: Sequence[str] = (),
                 lags: Sequence[int] = K.INDEX_LAGS) -> DataFrame:
    """Earlier values by row position. Pass an aggregated series: one row per key and step."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumns({f"lag_{n}": F.lag(value, n).over(w) for n in lags})


def box_index(df: DataFrame, value: str, west: Column, east: Column, day: str = "day",
              lags: Sequence[int] = K.INDEX_LAGS) -> DataFrame:
    """Unweighted mean inside the west box minus that inside the east box, per day, with lags."""
    index = df.filter(west | east).groupBy(day).agg(
        (F.avg(F.when(west, F.col(value))) - F.avg(F.when(east, F.col(value)))).alias("dmi")
    )
    return lag_features(index, "dmi", day, (), lags)


def in_box(box: dict[str, float], lat: str = "lat", lon: str = "lon") -> Column:
    return F.col(lat).between(box["lat_min"], box["lat_max"]) & F.col(lon).between(box["lon_min"], box["lon_max"])


def daily_climatology(df: DataFrame, doy: str, keys: Sequence[str], values: Sequence[str],
                      min_samples: int = K.CLIMATOLOGY_MIN_SAMPLES, full_year: bool = True) -> DataFrame:
    """Mean, population standard deviation and count per calendar day and key.

    ``full_year`` adds the missing days of 1..365 for every key, with a count of zero.
    """
    aggs = []
    for v in values:
        aggs += [F.avg(v).alias(f"{v}_clim"), F.stddev_pop(v).alias(f"{v}_std"), F.count(v).alias(f"{v}_count")]
    stats = df.groupBy(doy, *keys).agg(*aggs)
    if full_year:
        stats = _all_days(stats.withColumn(doy, F.col(doy).cast("int")), doy, keys)
    for v in values:
        count = F.coalesce(F.col(f"{v}_count"), F.lit(0))
        stats = stats.withColumn(f"{v}_count", count).withColumn(f"{v}_low", count < min_samples)
    return stats


def _all_days(stats: DataFrame, doy: str, keys: Sequence[str]) -> DataFrame:
    """Rows for the days between, before and after the known ones, generated from their neighbours.

    One shuffle of the aggregated rows by key replaces a join with a day spine, and leaves the
    result partitioned for windows over the same key.
    """
    w = Window.partitionBy(*keys).orderBy(doy)
    d = F.col(doy)
    first = F.when(F.lag(doy).over(w).isNull(), F.lit(1)).otherwise(d)
    last = F.coalesce(F.lead(doy).over(w) - 1, F.lit(K.DAYS_PER_YEAR))
    spread = spread_columns(stats, keys).withColumn("__first", first).withColumn("__last", last)
    days = spread.withColumn("__day", F.explode(F.sequence("__first", "__last")))
    own = F.col("__day") == d
    rest = [c for c in stats.columns if c != doy and c not in keys]
    return days.select(*keys, F.col("__day").alias(doy), *[F.when(own, F.col(c)).alias(c) for c in rest])


def fill_doy_gaps(df: DataFrame, doy: str, keys: Sequence[str], value: str) -> DataFrame:
    """Missing calendar days filled linearly between known days and beyond them from the two nearest.

    At most 365 rows per key. A key with fewer than two known days keeps its gaps.
    """
    v, d = F.col(value), F.col(doy).cast("double")
    over = f"OVER (PARTITION BY {', '.join(f'`{k}`' for k in keys)} ORDER BY `{doy}`)" if keys else f"OVER (ORDER BY `{doy}`)"

    def known(side: str, nth: int) -> tuple[Column, Column]:
        """Day and value of the nth known day before (``lag``) or after (``lead``) this one."""
        return tuple(F.expr(f"{side}({c}, {nth}) IGNORE NULLS {over}") for c in ("__x", f"`{value}`"))

    sides = {"p": ("lag", 1), "q": ("lag", 2), "n": ("lead", 1), "m": ("lead", 2)}
    points = []
    for name, (side, nth) in sides.items():
        x, y = known(side, nth)
        points += [x.alias(f"__{name}x"), y.alias(f"__{name}y")]
    out = df.withColumn("__x", F.when(v.isNotNull(), d)).select("*", *points)
    (px, py), (qx, qy), (nx, ny), (mx, my) = ((F.col(f"__{s}x"), F.col(f"__{s}y")) for s in sides)

    def line(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
        return y0 + (y1 - y0) / (x1 - x0) * (d - x0)

    filled = (
        F.when(v.isNotNull(), v)
        .when(px.isNotNull() & nx.isNotNull(), line(px, py, nx, ny))
        .when(qx.isNotNull(), line(qx, qy, px, py))
        .when(mx.isNotNull(), line(nx, ny, mx, my))
    )
    return out.select(*[filled.alias(value) if c == value else F.col(c) for c in df.columns])


def doy_join(df: DataFrame, climatology: DataFrame, on: Sequence[str]) -> DataFrame:
    """Attach the climatology of the row's calendar day: a plain equi-join on (doy, cell keys)."""
    return df.join(climatology, list(on), "left")


def anomaly(df: DataFrame, climatology: DataFrame, on: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Value minus its climatology, which is kept as ``<name>_clim_on_time``."""
    clim = climatology.select(*on, *[F.col(f"{v}_clim").alias(f"{v}_clim_on_time") for v in values])
    joined = doy_join(df, clim, on)
    return joined.withColumns({
        K.ANOMALY_NAMES.get(v, f"delta_{v}"): F.col(v) - F.col(f"{v}_clim_on_time") for v in values
    })


def climatology_mse(df: DataFrame, climatology: DataFrame, on: Sequence[str], cell: Sequence[str],
                    values: Sequence[str]) -> DataFrame:
    """Error of predicting the climatology: the mean of the cells' mean squared errors."""
    joined = anomaly(df, climatology, on, values)
    parts = []
    for v in values:
        delta = F.col(K.ANOMALY_NAMES.get(v, f"delta_{v}"))
        parts.append(F.avg(delta * delta).alias(f"{v}_mse"))
    per_cell = joined.groupBy(*cell).agg(*parts)
    totals = []
    for v in values:
        totals += [F.avg(f"{v}_mse").alias(f"{v}_mse"), F.sqrt(F.avg(f"{v}_mse")).alias(f"{v}_rmse")]
    return per_cell.agg(*totals)


def period_mean(df: DataFrame, keys: Sequence[str], values: dict[str, float]) -> DataFrame:
    """Time mean per key for each value, or the given default where nothing is known."""
    return df.groupBy(*keys).agg(
        *[F.coalesce(F.avg(v), F.lit(float(d))).alias(f"{v}_mean") for v, d in values.items()]
    )


def period_residual(df: DataFrame, keys: Sequence[str], values: dict[str, float]) -> DataFrame:
    """Each value minus its period mean."""
    joined = df.join(period_mean(df, keys, values), list(keys), "left")
    return joined.withColumns({f"{v}_residual": F.col(v) - F.col(f"{v}_mean") for v in values})


def land_from_coverage(df: DataFrame, value: str, cell: Sequence[str] = ("iy", "ix"),
                       n_days: Column | None = None) -> DataFrame:
    """Cells known on fewer than half of the days are land.

    ``n_days`` is the number of frames when absent rows stand for missing values.
    """
    known, total = F.count(value), F.count(F.lit(1))
    frac = known / (total if n_days is None else n_days)
    return df.groupBy(*cell).agg(frac.alias("frac")).withColumn("land", F.col("frac") < K.COVERAGE_LAND_FRACTION)


def merge_features(left: DataFrame, right: DataFrame, on: Sequence[str] = ("day",)) -> DataFrame:
    """Full outer join on the key; where both sides hold a column the left value wins."""
    shared = [c for c in right.columns if c in left.columns and c not in on]
    renamed = right.withColumnsRenamed({c: f"__r_{c}" for c in shared})
    joined = left.join(renamed, list(on), "full")
    merged = joined.withColumns({c: F.coalesce(F.col(c), F.col(f"__r_{c}")) for c in shared})
    return merged.drop(*[f"__r_{c}" for c in shared])


def before_after(df: DataFrame, keys: Sequence[str], day: str, before: str, after: str,
                 values: Sequence[str]) -> DataFrame:
    """Each value on two dates side by side with its net change, in one conditional aggregation."""
    def at(v: str, when: str) -> Column:
        return F.avg(F.when(F.col(day) == F.lit(when).cast("date"), F.col(v)))

    aggs = []
    for v in values:
        aggs += [at(v, before).alias(f"{v}_before"), at(v, after).alias(f"{v}_after"),
                 (at(v, after) - at(v, before)).alias(f"{v}_change")]
    wanted = F.col(day).isin(*[F.lit(d).cast("date") for d in (before, after)])
    return df.filter(wanted).groupBy(*keys).agg(*aggs)
