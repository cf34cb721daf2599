"""Sources, grid axes, masks and row selections."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsonde import constants as K
from gridsonde.functions import calendar as C
from gridsonde.functions import numeric as N
from gridsonde.functions import physics as P
from gridsonde.grid_spec import GridSpec
from gridsonde.operators import grid as G
from gridsonde.operators import quality as Q
from gridsonde.operators import spatial as S
from gridsonde.plans.registry import Tables, query, r, rounded, text
from gridsonde.session import scratch_path
from gridsonde.sources import profiles as SP
from gridsonde.sources import tables as ST

CELLS = GridSpec(5.125, 45.125, 0.25, 10, 10)
_LATLON = "5.125e0 + 0.25e0 * iy AS lat, 45.125e0 + 0.25e0 * ix AS lon"


def _year_parts(t: Tables, n: int = 4) -> list[DataFrame]:
    """Every row in one of ``n`` parts by its year; rows without a date in the first."""
    part = F.coalesce(F.year("l_shipdate") % n, F.lit(0))
    return [t.lineitem.filter(part == k) for k in range(n)]


@query("read_many", """SELECT src, nation, COUNT(*) AS n, ROUND(SUM(bal), 2) AS bal FROM (
    SELECT 0 AS src, c_nationkey AS nation, c_acctbal AS bal FROM customer UNION ALL SELECT 1, s_nationkey, s_acctbal FROM supplier) GROUP BY 1, 2""")
def read_many(t: Tables):
    """Two Parquet files with different columns as one table; a third path that matches nothing is skipped."""
    both = ST.read_many(t.spark, [f"{t.sf_dir}/{n}.parquet" for n in ("customer", "supplier", "absent*")], "src")
    nation, bal = F.coalesce("c_nationkey", "s_nationkey"), F.coalesce("c_acctbal", "s_acctbal")
    return both.groupBy("src", nation.alias("nation")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(bal), 2).alias("bal"))


@query("union_files", """SELECT CAST(YEAR(l_shipdate) AS INT) AS yr, COUNT(*) AS n, SUM(CAST(l_quantity AS BIGINT)) AS qty FROM lineitem GROUP BY 1""")
def union_files(t: Tables):
    """Parts of one table, by year, united again."""
    return ST.union_tables(*_year_parts(t)).groupBy(F.year("l_shipdate").alias("yr")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("bigint")).cast("bigint").alias("qty"))


@query("alias_columns", "SELECT sst, COUNT(*) AS n, ROUND(SUM(sla), 3) AS sla FROM (SELECT c_nationkey AS sst, c_acctbal AS sla FROM customer) GROUP BY sst")
def alias_columns(t: Tables):
    """First matching source column of each canonical name."""
    out = ST.alias_columns(t.customer, {"sst": ("delta_sst", "c_nationkey", "c_custkey"), "sla": ("SLA", "c_acctbal")})
    return out.groupBy("sst").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("sla"), 3).alias("sla"))


_COORD_SQL = "SELECT o_orderkey AS id, CAST(o_custkey % 60 AS DOUBLE) / 4 AS lat, CAST(1 + o_orderkey % 359 AS DOUBLE) + 0.25e0 AS lon FROM orders"


@query("standardize_coords", f"""SELECT lat, CASE WHEN lon >= 180 THEN lon - 360 ELSE lon END AS lon, COUNT(*) AS n FROM ({_COORD_SQL}) GROUP BY 1, 2""")
def standardize_coords(t: Tables):
    """Source coordinate names and 0..360 longitudes made canonical."""
    raw = t.orders.select(
        (F.col("o_custkey") % 60 / 4.0).alias("nav_lat"), ((1 + F.col("o_orderkey") % 359) + 0.25).alias("Longitude"))
    return ST.standardize_coords(raw).groupBy("lat", "lon").agg(F.count(F.lit(1)).alias("n"))


@query("write_table", """SELECT CAST(day AS VARCHAR) AS day, COUNT(*) AS n, ROUND(SUM(CAST(CAST(theta AS FLOAT) AS DOUBLE)), 3) AS theta,
    SUM(CASE WHEN warm THEN 1 ELSE 0 END) AS warm FROM (SELECT *, theta > 25 AS warm FROM f_obs) GROUP BY day""", ("f_obs",))
def write_table(t: Tables):
    """Storage types (float32, 0/1 bytes) through a written, month-partitioned table."""
    path = scratch_path(t.spark, "obs_table")
    obs = t.f_obs.withColumn("warm", F.col("theta") > 25)
    back = t.spark.read.parquet(ST.write_table(obs, path, day="day"))
    return back.groupBy(text("day").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("theta").cast("double")), 3).alias("theta"),
        F.sum(F.col("warm").cast("bigint")).alias("warm"))


@query("append_days", """SELECT series, CAST(day AS VARCHAR) AS day, ROUND(CAST(CAST(value AS FLOAT) AS DOUBLE), 6) AS value FROM f_daily""", ("f_daily",))
def append_days(t: Tables):
    """Two overlapping batches of days, one of them written twice: every day is there once."""
    path = scratch_path(t.spark, "daily_table")
    first, second = t.f_daily.filter(F.dayofmonth("day") <= 20), t.f_daily.filter(F.dayofmonth("day") >= 15)
    for batch in (first, second, second):
        ST.append_days(batch, path)
    back = t.spark.read.parquet(path)
    return back.select("series", text("day").alias("day"), r(F.col("value").cast("double")).alias("value"))


@query("export_grid_rows", """SELECT iy, STRING_AGG(CAST(ROUND(theta, 3) AS VARCHAR), ',' ORDER BY ix) AS vals, COUNT(*) AS n_cols,
    MIN(w) AS west, MIN(s) AS south, MIN(e) AS east, MIN(n) AS north FROM (SELECT iy, ix, theta + 1.1e-7 AS theta, MIN(lon) OVER () - 0.125e0 AS w, MIN(lat) OVER () - 0.125e0 AS s,
    MAX(lon) OVER () + 0.125e0 AS e, MAX(lat) OVER () + 0.125e0 AS n FROM f_profile WHERE depth = 0 AND lat BETWEEN 5.3e0 AND 6.9e0 AND lon BETWEEN 45.6e0 AND 47.2e0) GROUP BY iy""",
       ("f_profile",))
def export_grid_rows(t: Tables):
    """A surface field cropped to a box, one row of rounded values per latitude."""
    surface = t.f_profile.filter("depth = 0").select("iy", "ix", (F.col("theta") + 1.1e-7).alias("theta"))
    box = {"lat_min": 5.3, "lat_max": 6.9, "lon_min": 45.6, "lon_max": 47.2}
    out = G.export_grid_rows(surface, CELLS, "theta", box)
    return out.select("iy", F.concat_ws(",", F.transform("values", lambda v: v.cast("string"))).alias("vals"),
                      F.col("n_cols").cast("bigint").alias("n_cols"), "west", "south", "east", "north")


@query("layer_select", "SELECT iy, ix, ROUND(sp, 6) AS value FROM f_profile WHERE depth = 75", ("f_profile",))
def layer_select(t: Tables):
    out = G.select_layer(t.f_profile, {"temperature": "theta", "salinity": "sp"}, "salinity", 75)
    return out.select("iy", "ix", r("value").alias("value"))


@query("build_grid", """SELECT iy, ix, 5.125e0 + 0.25e0 * iy AS lat, 45.125e0 + 0.25e0 * ix AS lon, COUNT(l_partkey) AS n
    FROM (SELECT UNNEST(GENERATE_SERIES(0, 9)) AS iy), (SELECT UNNEST(GENERATE_SERIES(0, 9)) AS ix)
    LEFT JOIN (SELECT l_partkey, (l_partkey % 100) // 10 AS py, l_partkey % 10 AS px FROM lineitem) ON py = iy AND px = ix GROUP BY 1, 2""")
def build_grid(t: Tables):
    """Every grid cell with its centre and the number of samples in it."""
    samples = t.lineitem.select(
        F.floor(F.col("l_partkey") % 100 / 10).cast("int").alias("iy"), (F.col("l_partkey") % 10).cast("int").alias("ix"))
    n = samples.groupBy("iy", "ix").agg(F.count(F.lit(1)).alias("n"))
    out = G.build_grid(t.spark, CELLS).join(n, ["iy", "ix"], "left").fillna({"n": 0})
    return out.select(F.col("iy").cast("bigint").alias("iy"), F.col("ix").cast("bigint").alias("ix"), "lat", "lon", "n")


_AXIS_SQL = "axis AS (SELECT c_nationkey AS axis, c_acctbal AS c FROM customer GROUP BY 1, 2)"


def _axis(t: Tables):
    """An irregular axis per nation: the distinct balances of its customers."""
    return t.customer.select(F.col("c_nationkey").alias("axis"), F.col("c_acctbal").alias("c")).distinct()


@query("cell_bounds", """SELECT axis, c, ROUND(COALESCE((p + c) / 2, c - (n - c) / 2) + 1e-9, 6) AS lo, ROUND(COALESCE((c + n) / 2, c + (c - p) / 2) + 1e-9, 6) AS hi
    FROM (SELECT *, LAG(c) OVER w AS p, LEAD(c) OVER w AS n FROM axis WINDOW w AS (PARTITION BY axis ORDER BY c))""", (), _AXIS_SQL)
def cell_bounds(t: Tables):
    return rounded(G.cell_bounds(_axis(t), "c", ["axis"]), "lo", "hi", shift=-1e-9)


@query("grid_spacing", """SELECT axis, c, ROUND(COALESCE((n - p) / 2, n - c, c - p) + 1e-9, 6) AS step
    FROM (SELECT *, LAG(c) OVER w AS p, LEAD(c) OVER w AS n FROM axis WINDOW w AS (PARTITION BY axis ORDER BY c))""", (), _AXIS_SQL)
def grid_spacing(t: Tables):
    return rounded(G.grid_spacing(_axis(t), "c", ["axis"]), "step", shift=-1e-9)


@query("cell_area", """SELECT iy, ix, ROUND(6371e0 * 6371e0 * (SIN(RADIANS(5.25e0 + 0.25e0 * iy)) - SIN(RADIANS(5e0 + 0.25e0 * iy))) * RADIANS(0.25e0), 5) AS km2,
    ROUND(SUM(raw), 2) AS raw FROM f_obs GROUP BY iy, ix""", ("f_obs",))
def cell_area(t: Tables):
    cells = t.f_obs.groupBy("iy", "ix").agg(F.round(F.sum("raw"), 2).alias("raw"))
    half = CELLS.resolution / 2
    area = G.cell_area(CELLS.lat() - half, CELLS.lat() + half, CELLS.lon() - half, CELLS.lon() + half)
    return cells.select("iy", "ix", r(area / 1e6, 5).alias("km2"), "raw")


@query("date_spine", """SELECT series, CAST(GREATEST(m, a) AS VARCHAR) AS window_start, CAST(LEAST(LAST_DAY(m), b) AS VARCHAR) AS window_end,
    DATE_DIFF('day', GREATEST(m, a), LEAST(LAST_DAY(m), b)) + 1 AS n_days
    FROM (SELECT *, CAST(UNNEST(GENERATE_SERIES(DATE_TRUNC('month', a), CAST(b AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS m FROM
    (SELECT o_orderpriority AS series, CAST(MIN(o_orderdate) AS DATE) AS a, CAST(MAX(o_orderdate) AS DATE) AS b FROM orders GROUP BY 1))""")
def date_spine(t: Tables):
    """Month windows over the order dates of each priority, with the days each one holds."""
    ranges = t.orders.groupBy(F.col("o_orderpriority").alias("series")).agg(
        F.to_date(F.min("o_orderdate")).alias("a"), F.to_date(F.max("o_orderdate")).alias("b"))
    windows = G.monthly_windows(ranges, "a", "b")
    days = G.day_spine(windows, "window_start", "window_end")
    return days.groupBy("series", text("window_start").alias("window_start"), text("window_end").alias("window_end")).agg(
        F.count(F.lit(1)).alias("n_days"))


SPLITS = {"train": ("1995-01-01", "1999-12-31"), "validation": ("2000-01-01", "2000-12-31"), "test": ("2001-01-01", "2001-12-31")}


@query("chronological_split", """SELECT CASE WHEN day BETWEEN DATE '1995-01-01' AND DATE '1999-12-31' THEN 'train' WHEN day BETWEEN DATE '2000-01-01' AND DATE '2000-12-31' THEN 'validation'
    WHEN day BETWEEN DATE '2001-01-01' AND DATE '2001-12-31' THEN 'test' END AS split, COUNT(*) AS n, CAST(MIN(day) AS VARCHAR) AS first_day, CAST(MAX(day) AS VARCHAR) AS last_day
    FROM f_obs GROUP BY 1""", ("f_obs",))
def chronological_split(t: Tables):
    return G.label_split(t.f_obs, "day", SPLITS).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), text(F.min("day")).alias("first_day"), text(F.max("day")).alias("last_day"))


@query("bbox_filter", f"""SELECT iy, ix, COUNT(*) AS n FROM (SELECT iy, ix, {_LATLON} FROM f_obs) WHERE lat BETWEEN 5.375e0 AND 6.5e0 AND lon BETWEEN 45.2e0 AND 46.625e0 GROUP BY 1, 2""", ("f_obs",))
def bbox_filter(t: Tables):
    df = t.f_obs.select("iy", "ix", CELLS.lat().alias("lat"), CELLS.lon().alias("lon"))
    box = {"lat_min": 5.375, "lat_max": 6.5, "lon_min": 45.2, "lon_max": 46.625}
    return G.bbox_filter(df, box).groupBy("iy", "ix").agg(F.count(F.lit(1)).alias("n"))


@query("sub_basin", """SELECT CASE WHEN lon < 80 THEN 'west' ELSE 'east' END AS basin, COUNT(*) AS n FROM (SELECT 45.125e0 + 7e0 * ix AS lon FROM f_obs) GROUP BY 1""", ("f_obs",))
def sub_basin(t: Tables):
    lon = F.lit(45.125) + F.lit(7.0) * F.col("ix")
    return t.f_obs.groupBy(G.sub_basin(lon).alias("basin")).agg(F.count(F.lit(1)).alias("n"))


@query("water_column", """SELECT iy, ix, elevation_m >= 0 AS land, ROUND(CASE WHEN elevation_m >= 0 THEN 0 ELSE -elevation_m END, 6) AS water_m FROM f_elev""", ("f_elev",))
def water_column(t: Tables):
    return G.build_masks(t.f_elev).select("iy", "ix", "land", r("water_m").alias("water_m"))


_WET = "(elevation_m < 0 AND -elevation_m > depth)"


@query("depth_truncation", f"""SELECT depth, COUNT(*) AS n, COUNT(CASE WHEN {_WET} THEN theta END) AS n_theta, ROUND(SUM(CASE WHEN {_WET} THEN theta END), 3) AS theta
    FROM f_obs JOIN f_elev USING (iy, ix) GROUP BY depth""", ("f_obs", "f_elev"))
def depth_truncation(t: Tables):
    out = G.depth_truncation(t.f_obs, t.f_elev, ["theta"], depth="depth")
    return out.groupBy("depth").agg(F.count(F.lit(1)).alias("n"), F.count("theta").alias("n_theta"), F.round(F.sum("theta"), 3).alias("theta"))


@query("mask_join", "SELECT land, depth, COUNT(*) AS n FROM f_obs LEFT JOIN f_mask USING (iy, ix) GROUP BY 1, 2", ("f_obs", "f_mask"))
def mask_join(t: Tables):
    return G.mask_join(t.f_obs, t.f_mask.select("iy", "ix", "land")).groupBy("land", "depth").agg(F.count(F.lit(1)).alias("n"))


@query("mask_stats", f"""SELECT depth, n_valid, n_land, n_ocean, n_buffer FROM (SELECT depth, SUM(CASE WHEN {_WET} THEN 1 ELSE 0 END) AS n_valid FROM f_elev,
    (SELECT UNNEST([0e0, 5e0, 1e1, 2e1, 3e1, 5e1, 75e0, 1e2, 125e0, 15e1, 2e2, 3e2, 5e2, 7e2, 1e3]) AS depth) GROUP BY depth),
    (SELECT SUM(CASE WHEN land THEN 1 ELSE 0 END) AS n_land, SUM(CASE WHEN land THEN 0 ELSE 1 END) AS n_ocean,
    SUM(CASE WHEN buffered AND NOT land THEN 1 ELSE 0 END) AS n_buffer FROM (SELECT a.land, (SELECT BOOL_OR(b.land) FROM f_mask b WHERE ABS(a.iy - b.iy) <= 2 AND ABS(a.ix - b.ix) <= 2) AS buffered FROM f_mask a))""",
       ("f_elev", "f_mask"))
def mask_stats(t: Tables):
    """Valid cells per level beside the land, ocean and coastal-buffer counts."""
    stats = G.mask_stats(S.dilate_mask(t.f_mask.select("iy", "ix", "land"), "land", K.COASTAL_BUFFER_CELLS))
    s = stats.select(F.struct("*").alias("s")).scalar()
    per = G.valid_per_depth(G.depth_validity(t.f_elev))
    return per.select("depth", "n_valid", s["n_land"].alias("n_land"), s["n_ocean"].alias("n_ocean"), s["n_buffer"].alias("n_buffer"))


@query("mask_algebra", """SELECT a.iy, a.ix, a.land, (SELECT BOOL_OR(b.land) FROM f_mask b WHERE ABS(a.iy - b.iy) <= 1 AND ABS(a.ix - b.ix) <= 1) AND NOT a.land AS ring FROM f_mask a""", ("f_mask",))
def mask_algebra(t: Tables):
    """The ring of ocean cells next to land."""
    out = S.dilate_mask(t.f_mask.select("iy", "ix", "land"), "land", 1)
    return out.select("iy", "ix", "land", (F.col("buffered") & ~F.col("land")).alias("ring"))


@query("fill_missing", """SELECT cid, depth, ROUND(COALESCE(theta, (SELECT AVG(theta) FROM f_gappy)), 6) AS by_mean, ROUND(COALESCE(theta, 0), 6) AS by_zero,
    ROUND(CASE WHEN cid % 9 = 0 THEN -1 ELSE COALESCE(theta, -1) END, 6) AS on_land FROM f_gappy""", ("f_gappy",))
def fill_missing(t: Tables):
    out = t.f_gappy.select("cid", "depth", "theta", N.fill_constant(F.col("theta"), 0.0).alias("by_zero"),
                           N.fill_constant(F.col("theta"), -1.0, F.col("cid") % 9 == 0).alias("on_land"))
    return rounded(G.fill_missing(out, ["theta"]).withColumnRenamed("theta", "by_mean"), "by_mean", "by_zero", "on_land")


@query("finite_or_null", """SELECT cid, COUNT(*) AS n, COUNT(v) AS known, ROUND(AVG(v) + 1e-9, 6) AS v FROM (SELECT cid, CASE WHEN depth = 75 OR depth = 200 OR depth = 0 THEN NULL ELSE theta END AS v FROM f_column) GROUP BY cid""", ("f_column",))
def finite_or_null(t: Tables):
    """NaN and both infinities planted at three levels are left out of the mean."""
    planted = (F.when(F.col("depth") == 75, F.lit(float("nan"))).when(F.col("depth") == 200, F.lit(float("inf")))
               .when(F.col("depth") == 0, F.lit(float("-inf"))).otherwise(F.col("theta")))
    v = N.finite(F.col("v"))
    return t.f_column.select("cid", planted.alias("v")).groupBy("cid").agg(
        F.count(F.lit(1)).alias("n"), F.count(v).alias("known"), r(F.avg(v) + 1e-9).alias("v"))


@query("valid_mask", f"""SELECT depth, COUNT(*) AS n, SUM(CASE WHEN {_WET} AND theta IS NOT NULL AND sp IS NOT NULL THEN 1 ELSE 0 END) AS n_valid
    FROM (SELECT iy, ix, depth, CASE WHEN (iy + ix) % 3 = 0 THEN NULL ELSE theta END AS theta, sp FROM f_obs) JOIN f_elev USING (iy, ix) GROUP BY depth""", ("f_obs", "f_elev"))
def valid_mask(t: Tables):
    from gridsonde.operators.training import valid_targets
    holes = F.when((F.col("iy") + F.col("ix")) % 3 == 0, F.lit(float("nan"))).otherwise(F.col("theta"))
    df = G.mask_join(t.f_obs.withColumn("theta", holes), t.f_elev)
    return valid_targets(df, values=("theta", "sp")).groupBy("depth").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("valid").cast("bigint")).alias("n_valid"))


@query("coriolis", """SELECT id, ROUND(f * 1e6, 6) AS f, ROUND((CASE WHEN lat < 0 THEN -1 ELSE 1 END) * GREATEST(ABS(f), 1.5e-5) * 1e6, 6) AS f_tilde
    FROM (SELECT id, lat, 2 * 7.292115e-5 * SIN(RADIANS(lat)) AS f FROM (SELECT c_custkey AS id, c_acctbal / 4e2 - 5e0 AS lat FROM customer))""")
def coriolis(t: Tables):
    lat = F.col("c_acctbal") / 400.0 - 5.0
    return t.customer.select(F.col("c_custkey").alias("id"), r(P.coriolis(lat) * 1e6).alias("f"),
                             r(P.coriolis_floored(lat) * 1e6).alias("f_tilde"))


@query("wind_stress", """SELECT ym, iy, ix, ROUND(1.225e0 * 1.3e-3 * SQRT(u10 * u10 + v10 * v10) * u10, 6) AS tau_x,
    ROUND(1.225e0 * 1.3e-3 * SQRT(u10 * u10 + v10 * v10) * v10, 6) AS tau_y FROM f_wind""", ("f_wind",))
def wind_stress(t: Tables):
    u, v = F.col("u10"), F.col("v10")
    return t.f_wind.select("ym", "iy", "ix", r(P.wind_stress_x(u, v)).alias("tau_x"), r(P.wind_stress_y(u, v)).alias("tau_y"))


@query("area_weight", """SELECT id, ROUND(w / (SELECT AVG(w) FROM ws), 6) AS w FROM ws""", (),
       "ws AS (SELECT c_custkey AS id, GREATEST(COS(RADIANS(c_acctbal / 1.2e2)), 1e-3) AS w FROM customer)")
def area_weight(t: Tables):
    w = P.latitude_weight(F.col("c_acctbal") / 120.0)
    mean = t.customer.agg(F.avg(w)).scalar()
    return t.customer.select(F.col("c_custkey").alias("id"), r(w / mean).alias("w"))


@query("reconstruct", """SELECT member, cid, k, ROUND(pred + sigma, 6) AS theta, ROUND(LEAST(5e0, GREATEST(1e-4, sigma * 2e2 - 1e0)), 6) AS sigma_theta,
    ROUND(LEAST(2e0, GREATEST(1e-4, sigma * 1e2 - 1e0)), 6) AS sigma_sp FROM f_ensemble""", ("f_ensemble",))
def reconstruct(t: Tables):
    s = F.col("sigma")
    return t.f_ensemble.select(
        "member", "cid", "k", r(P.reconstruct(F.col("pred"), s)).alias("theta"),
        r(P.clip_sigma_theta(s * 200.0 - 1.0)).alias("sigma_theta"), r(P.clip_sigma_sp(s * 100.0 - 1.0)).alias("sigma_sp"))


@query("log_sigma", "SELECT member, cid, k, ROUND(EXP(LEAST(2e0, GREATEST(-7e0, pred / 3e0 - 9e0))), 6) AS sigma FROM f_ensemble", ("f_ensemble",))
def log_sigma(t: Tables):
    return t.f_ensemble.select("member", "cid", "k", r(P.sigma_from_log(F.col("pred") / 3.0 - 9.0)).alias("sigma"))


@query("juld_to_ts", """SELECT id, CAST(TIMESTAMP '1950-01-01' + TO_MICROSECONDS(CAST(days * 864e8 AS BIGINT)) AS VARCHAR) AS ts
    FROM (SELECT o_orderkey AS id, 2e4 + (o_orderkey % 9000) + (o_custkey % 64) / 64e0 AS days FROM orders)""")
def juld_to_ts(t: Tables):
    days = F.lit(20000.0) + (F.col("o_orderkey") % 9000) + (F.col("o_custkey") % 64) / 64.0
    return t.orders.select(F.col("o_orderkey").alias("id"), text(C.days_since_1950(days)).alias("ts"))


@query("climatology_doy", """SELECT CAST(day AS VARCHAR) AS day, CAST(CASE WHEN DAYOFYEAR(MAKE_DATE(YEAR(day), 12, 31)) = 366 AND DAYOFYEAR(day) >= 60 THEN DAYOFYEAR(day) - 1
    ELSE DAYOFYEAR(day) END AS INT) AS doy FROM (SELECT DISTINCT day FROM f_obs)""", ("f_obs",))
def climatology_doy(t: Tables):
    return t.f_obs.select("day").distinct().select(text("day").alias("day"), C.climatology_doy(F.col("day")).alias("doy"))


@query("season_encoding", """SELECT CAST(day AS VARCHAR) AS day, ROUND(SIN(2 * PI() * (doy - 1) / 365e0), 6) AS s, ROUND(COS(2 * PI() * (doy - 1) / 365e0), 6) AS c,
    ROUND(SIN(2 * PI() * doy / 365e0), 6) AS s1 FROM (SELECT day, CASE WHEN DAYOFYEAR(MAKE_DATE(YEAR(day), 12, 31)) = 366 AND DAYOFYEAR(day) >= 60 THEN DAYOFYEAR(day) - 1
    ELSE DAYOFYEAR(day) END AS doy FROM (SELECT DISTINCT day FROM f_obs))""", ("f_obs",))
def season_encoding(t: Tables):
    doy = C.climatology_doy(F.col("day"))
    return t.f_obs.select("day").distinct().select(
        text("day").alias("day"), r(C.season_sin(doy)).alias("s"), r(C.season_cos(doy)).alias("c"), r(C.season_sin(doy, False)).alias("s1"))


# --- nested records -------------------------------------------------------------------------------


def _pluck(array: str, field: str):
    return F.transform(array, lambda s: s[field])


def _records(t: Tables):
    """In-situ samples of each platform and day collected into profile records (one file record each)."""
    level = F.struct("obs_id", "depth", "temp", F.col("qc").cast("string").alias("temp_qc"))
    rec = t.f_insitu.groupBy("platform", F.to_date("ts").alias("day")).agg(F.sort_array(F.collect_list(level)).alias("l"))
    return rec.select("platform", "day", *[_pluck("l", c).alias(c) for c in ("depth", "temp", "temp_qc")])


@query("profiles_to_rows", """SELECT platform, COUNT(*) AS n, COUNT(CASE WHEN qc <= 2 THEN 1 END) AS n_good, ROUND(SUM(temp) - 1.234e-6, 3) AS temp, ROUND(SUM(depth), 3) AS depth, 0 AS n_psal FROM f_insitu GROUP BY platform""", ("f_insitu",))
def profiles_to_rows(t: Tables):
    rows = SP.profiles_to_rows(_records(t), ("platform", "day"))
    good = P.good_flag(F.col("temp_qc")) & P.good_flag(F.col("pres_qc")) & P.good_flag(F.col("position_qc"))
    return rows.groupBy("platform").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(good).alias("n_good"), F.round(F.sum("temp") - 1.234e-6, 3).alias("temp"),
        F.round(F.sum("depth"), 3).alias("depth"), F.count("psal").alias("n_psal"))


def mooring_records(t: Tables):
    """Eight consecutive readings form one time step of a sensor string; three steps form a record."""
    e = t.events.select(F.floor(F.col("event_id") / 8).alias("step"), (F.col("event_id") % 8).alias("k"), "user_id",
                        F.col("ts").cast("timestamp").alias("ts"), "value")
    cells = e.groupBy("step", "k").agg(F.min("user_id").alias("platform"), F.min("ts").alias("ts"), F.avg("value").alias("value"))
    steps = cells.groupBy("step").agg(
        F.min("ts").alias("ts"), F.transform(F.sort_array(F.collect_list(F.struct("k", "value"))), lambda s: s["value"]).alias("temp"),
        F.min("platform").alias("platform"))
    rec = steps.groupBy(F.floor(F.col("step") / 3).alias("rec")).agg(
        F.sort_array(F.collect_list(F.struct("step", "ts", "temp", "platform"))).alias("s"))
    even = (F.col("rec") % 2 == 0)
    lats = F.array(F.when(even, 14.5).otherwise(11.0), F.when(even, 15.1).otherwise(12.0))
    return rec.select(
        "rec", lats.alias("lats"), F.array(F.lit(89.5), F.lit(90.5)).alias("lons"),
        F.transform("s", lambda s: s["ts"]).alias("times"), F.transform("s", lambda s: s["temp"]).alias("temp"),
        F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.lit(1.0) + k * 10.0).alias("depths"))


@query("mooring_to_rows", """SELECT site, depth, COUNT(temp) AS n, ROUND(SUM(temp), 3) AS temp, 0 AS n_psal, ROUND(MAX(lat), 6) AS lat_max FROM (
    SELECT CASE WHEN (event_id // 24) % 2 = 0 THEN 'rama_15n90e' ELSE 'rama_12n90e' END AS site, CASE WHEN (event_id // 24) % 2 = 0 THEN 14.8e0 ELSE 11.5e0 END AS lat,
    1e0 + 1e1 * (event_id % 8) AS depth, value AS temp FROM events) GROUP BY site, depth""")
def mooring_to_rows(t: Tables):
    rows = SP.mooring_to_rows(mooring_records(t), site=None)
    return rows.groupBy("site", "depth").agg(
        F.count("temp").alias("n"), F.round(F.sum("temp"), 3).alias("temp"), F.count("psal").alias("n_psal"), r(F.max("lat")).alias("lat_max"))


PROFILE_LEVELS = 1000


@query("load_case_study", """SELECT series, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, COUNT(*) AS n, ROUND(SUM(value), 3) AS theta,
    ROUND(SUM(CAST(json_extract_string(props, '$.k') AS DOUBLE)), 3) AS sp, 0.2e0 AS sigma_theta FROM (SELECT event_type AS series, ts, value, props FROM events) GROUP BY 1, 2""")
def load_case_study(t: Tables):
    """Nested JSON documents (a map of dated profiles per series) built from the events, then read as level rows."""
    e = t.events.select(F.col("event_type").alias("series"), F.to_date("ts").cast("string").alias("date"), "event_id", "value",
                        F.get_json_object("props", "$.k").cast("double").alias("k"))
    level = F.struct("event_id", "value", "k")
    # A profile holds at most PROFILE_LEVELS readings; a longer day makes several profiles.
    e = e.withColumn("part", F.floor(F.col("event_id") / PROFILE_LEVELS))
    profile = e.groupBy("series", "date", "part").agg(F.sort_array(F.collect_list(level)).alias("l")).select(
        "series", "date", F.struct(
            F.col("series").alias("label"), F.transform("l", lambda s: s["event_id"].cast("double")).alias("depths"),
            F.transform("l", lambda s: s["value"]).alias("potential_temperature"),
            F.transform("l", lambda s: s["k"]).alias("practical_salinity")).alias("p"))
    # One document per profile: its size does not grow with the table.
    docs = profile.select("series", F.to_json(F.struct(F.create_map("date", "p").alias("profiles"))).alias("doc"))
    rows = SP.case_profile_rows(SP.parse_case_study(docs, "doc"), keep=("series",))
    return rows.groupBy("series", "date").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("theta"), 3).alias("theta"), F.round(F.sum("sp"), 3).alias("sp"),
        F.max("sigma_theta").alias("sigma_theta"))


# --- quality checks -------------------------------------------------------------------------------


def _planted(t: Tables):
    """Observations with two planted axis errors: a shifted latitude row and a stray level."""
    lat = CELLS.lat() + F.when(F.col("iy") == 3, 0.01).otherwise(0.0)
    return t.f_obs.select("day", "iy", "ix", lat.alias("lat"), CELLS.lon().alias("lon"),
                          F.when((F.col("iy") == 1) & (F.col("depth") == 75.0), 76.0).otherwise(F.col("depth")).alias("depth"), "theta", "sp")


_LEVELS7 = (0.0, 10.0, 30.0, 75.0, 200.0, 500.0, 1000.0)


@query("check_grid", """SELECT 'axis_lat' AS "check", 'lat' AS subject, (SELECT COUNT(*) FROM (SELECT DISTINCT iy, lat FROM planted) WHERE ABS(lat - (5.125e0 + 0.25e0 * iy)) > 1e-4) + ABS(COUNT(DISTINCT lat) - 10) AS n_bad, FALSE AS ok FROM planted
    UNION ALL SELECT 'axis_lon', 'lon', ABS(COUNT(DISTINCT ix) - 10), COUNT(DISTINCT ix) = 10 FROM planted
    UNION ALL SELECT 'axis_depth', 'depth', (SELECT COUNT(DISTINCT depth) FROM planted WHERE depth NOT IN (0, 10, 30, 75, 200, 500, 1000)) + ABS(COUNT(DISTINCT depth) - 7), FALSE FROM planted""", ("f_obs",),
       """planted AS (SELECT iy, ix, 5.125e0 + 0.25e0 * iy + CASE WHEN iy = 3 THEN 0.01e0 ELSE 0 END AS lat, CASE WHEN iy = 1 AND depth = 75 THEN 76e0 ELSE depth END AS depth FROM f_obs)""")
def check_grid(t: Tables):
    return Q.check_grid(_planted(t), CELLS, _LEVELS7)


@query("check_land_null", """SELECT 'land_null' AS "check", v AS subject, COUNT(CASE WHEN land AND (v = 'theta' OR sp IS NOT NULL) THEN 1 END) AS n_bad,
    COUNT(CASE WHEN land AND (v = 'theta' OR sp IS NOT NULL) THEN 1 END) = 0 AS ok FROM (SELECT o.iy, o.ix, CASE WHEN m.land THEN NULL ELSE o.sp END AS sp, m.land FROM f_obs o JOIN f_mask m USING (iy, ix)),
    (SELECT UNNEST(['theta', 'sp']) AS v) GROUP BY v""", ("f_obs", "f_mask"))
def check_land_null(t: Tables):
    """Salinity masked on land passes, unmasked temperature does not."""
    df = G.mask_join(t.f_obs, t.f_mask.select("iy", "ix", "land")).withColumn("sp", F.when(~F.col("land"), F.col("sp")))
    return Q.check_land_null(df.drop("land"), t.f_mask, ["theta", "sp"])


@query("check_coriolis", """SELECT 'coriolis' AS "check", 'f_tilde' AS subject, COUNT(*) AS n_bad, COUNT(*) = 0 AS ok FROM customer WHERE ABS(2 * 7.292115e-5 * SIN(RADIANS(c_acctbal / 4e2 - 5e0))) < 1.5e-5 - 1e-12""")
def check_coriolis(t: Tables):
    """The unregularised parameter violates the floor near the equator."""
    return Q.check_coriolis(t.customer.select(P.coriolis(F.col("c_acctbal") / 400.0 - 5.0).alias("f_tilde")))


def _curl_like(t: Tables):
    return t.f_obs.filter("depth = 0").select("iy", "ix", ((F.col("raw") - 38.0) / 7e4).alias("curl"))


_CURL_SQL = """SELECT 'curl_spikes' AS "check", 'curl' AS subject, COUNT(CASE WHEN ABS(curl) > 5e-4 THEN 1 END) AS n_bad,
    COUNT(*) > 0 AND COUNT(CASE WHEN ABS(curl) > 5e-4 THEN 1 END) <= COUNT(*) * 1e-3 AS ok FROM (SELECT (raw - 3.8e1) / 7e4 AS curl, land FROM f_obs JOIN f_mask USING (iy, ix) WHERE depth = 0) WHERE NOT land"""


@query("check_curl_spikes", _CURL_SQL, ("f_obs", "f_mask"))
def check_curl_spikes(t: Tables):
    return Q.check_curl_spikes(_curl_like(t), t.f_mask)


@query("quality_report", f"""SELECT 'axis_lon' AS "check", 'lon' AS subject, 10 - COUNT(DISTINCT ix) AS n_bad, COUNT(DISTINCT ix) = 10 AS ok FROM f_obs
    UNION ALL SELECT 'axis_lat', 'lat', 10 - COUNT(DISTINCT iy), COUNT(DISTINCT iy) = 10 FROM f_obs UNION ALL SELECT 'axis_depth', 'depth', 7 - COUNT(DISTINCT depth), COUNT(DISTINCT depth) = 7 FROM f_obs
    UNION ALL SELECT 'land_null', 'theta', COUNT(*), COUNT(*) = 0 FROM f_obs JOIN f_mask USING (iy, ix) WHERE land UNION ALL {_CURL_SQL}""", ("f_obs", "f_mask"))
def quality_report(t: Tables):
    df = t.f_obs.withColumns({"lat": CELLS.lat(), "lon": CELLS.lon()})
    return Q.quality_report(Q.check_grid(df, CELLS, _LEVELS7), Q.check_land_null(df, t.f_mask, ["theta"]),
                            Q.check_curl_spikes(_curl_like(t), t.f_mask))


