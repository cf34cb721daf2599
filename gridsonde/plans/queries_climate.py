"""Time-series and climatology queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridsonde.functions.calendar import climatology_doy
from gridsonde.operators import climate as C
from gridsonde.operators import grid as G
from gridsonde.operators import spatial as S
from gridsonde.plans.queries_grid import CELLS, SPLITS
from gridsonde.plans.registry import Tables, query, r, rounded, text

DOY_SQL = "CAST(CASE WHEN DAYOFYEAR(MAKE_DATE(YEAR(day), 12, 31)) = 366 AND DAYOFYEAR(day) >= 60 THEN DAYOFYEAR(day) - 1 ELSE DAYOFYEAR(day) END AS INT)"
_OBS_DOY = f"od AS (SELECT *, {DOY_SQL} AS doy FROM f_obs)"
_TRAIN = "day BETWEEN DATE '1995-01-01' AND DATE '1999-12-31'"
_CLIM = f"""{_OBS_DOY}, clim AS (SELECT s.doy, s.iy, c.m, c.sd, COALESCE(c.n, 0) AS n FROM (SELECT doy, iy FROM (SELECT UNNEST(GENERATE_SERIES(1, 365)) AS doy), (SELECT DISTINCT iy FROM od WHERE {_TRAIN})) s
    LEFT JOIN (SELECT doy, iy, AVG(theta) AS m, STDDEV_POP(theta) AS sd, COUNT(theta) AS n FROM od WHERE {_TRAIN} GROUP BY doy, iy) c ON c.doy = s.doy AND c.iy = s.iy)"""


def obs_doy(t: Tables):
    return t.f_obs.withColumn("doy", climatology_doy(F.col("day")))


def _train_clim(t: Tables):
    return C.daily_climatology(G.keep_split(obs_doy(t), "day", "train", SPLITS), "doy", ["iy"], ["theta"])


@query("daily_mean", "SELECT series, CAST(day AS VARCHAR) AS day, ROUND(value, 6) AS value FROM f_daily", ("f_daily",))
def daily_mean(t: Tables):
    return C.daily_mean(t.f_series, "ts", ["series"], ["value"]).select("series", text("day").alias("day"), r("value").alias("value"))


@query("lag_features", """SELECT series, CAST(day AS VARCHAR) AS day, ROUND(value, 6) AS value, ROUND(LAG(value, 7) OVER w, 6) AS lag_7, ROUND(LAG(value, 14) OVER w, 6) AS lag_14
    FROM f_daily WINDOW w AS (PARTITION BY series ORDER BY day)""", ("f_daily",))
def lag_features(t: Tables):
    out = C.lag_features(C.daily_mean(t.f_series, "ts", ["series"], ["value"]), "value", "day", ["series"])
    return rounded(out.withColumn("day", text("day")), "value", "lag_7", "lag_14")


@query("daily_climatology", "SELECT CAST(doy AS INT) AS doy, iy, ROUND(m - 1.234e-9, 6) AS mean, ROUND(sd, 6) AS std, n, n < 3 AS low FROM clim", ("f_obs",), _CLIM)
def daily_climatology(t: Tables):
    return _train_clim(t).select("doy", "iy", r(F.col("theta_clim") - 1.234e-9).alias("mean"), r("theta_std").alias("std"), F.col("theta_count").alias("n"), F.col("theta_low").alias("low"))


@query("doy_join", "SELECT od.iy, COUNT(*) AS n, COUNT(m) AS n_known, ROUND(SUM(m), 3) AS clim FROM od LEFT JOIN clim ON od.doy = clim.doy AND od.iy = clim.iy GROUP BY od.iy", ("f_obs",), _CLIM)
def doy_join(t: Tables):
    out = C.doy_join(obs_doy(t), _train_clim(t), ["doy", "iy"])
    return out.groupBy("iy").agg(F.count(F.lit(1)).alias("n"), F.count("theta_clim").alias("n_known"), F.round(F.sum("theta_clim"), 3).alias("clim"))


@query("fill_doy_gaps", """SELECT g.series, CAST(g.doy AS INT) AS doy, ROUND(CASE WHEN g.v IS NOT NULL THEN g.v
    WHEN lo.doy IS NOT NULL AND hi.doy IS NOT NULL THEN lo.v + (hi.v - lo.v) * (g.doy - lo.doy) / (hi.doy - lo.doy)
    WHEN lo.doy IS NOT NULL THEN lo2.v + (lo.v - lo2.v) * (g.doy - lo2.doy) / (lo.doy - lo2.doy)
    ELSE hi.v + (hi2.v - hi.v) * (g.doy - hi.doy) / (hi2.doy - hi.doy) END - 1.234e-9, 6) AS v FROM
    (SELECT s.*, (SELECT MAX(doy) FROM known k WHERE k.series = s.series AND k.doy <= s.doy) AS p1, (SELECT MIN(doy) FROM known k WHERE k.series = s.series AND k.doy >= s.doy) AS n1,
    c.v FROM (SELECT doy, series FROM (SELECT UNNEST(GENERATE_SERIES(1, 365)) AS doy), (SELECT DISTINCT series FROM known)) s LEFT JOIN known c ON c.series = s.series AND c.doy = s.doy) g
    LEFT JOIN known lo ON lo.series = g.series AND lo.doy = g.p1 LEFT JOIN known hi ON hi.series = g.series AND hi.doy = g.n1
    LEFT JOIN known lo2 ON lo2.series = g.series AND lo2.doy = (SELECT MAX(doy) FROM known k WHERE k.series = g.series AND k.doy < g.p1)
    LEFT JOIN known hi2 ON hi2.series = g.series AND hi2.doy = (SELECT MIN(doy) FROM known k WHERE k.series = g.series AND k.doy > g.n1)""", (),
       """known AS (SELECT o_custkey AS series, CASE WHEN DAYOFYEAR(MAKE_DATE(YEAR(o_orderdate), 12, 31)) = 366 AND DAYOFYEAR(o_orderdate) >= 60 THEN DAYOFYEAR(o_orderdate) - 1
    ELSE DAYOFYEAR(o_orderdate) END AS doy, AVG(o_totalprice) / 1e4 AS v FROM orders GROUP BY 1, 2)""")
def fill_doy_gaps(t: Tables):
    """Sparse calendar-day means of every customer filled to 365 days."""
    o = t.orders.select(F.col("o_custkey").alias("series"), climatology_doy(F.col("o_orderdate")).alias("doy"), (F.col("o_totalprice") / 1e4).alias("v"))
    clim = C.daily_climatology(o, "doy", ["series"], ["v"])
    out = C.fill_doy_gaps(clim.select("series", "doy", F.col("v_clim").alias("v")), "doy", ["series"], "v")
    return rounded(out, "v", shift=1.234e-9)


@query("anomaly", "SELECT od.iy, COUNT(*) AS n, ROUND(SUM(theta - m), 3) AS delta_theta, ROUND(SUM((theta - m) * (theta - m)), 3) AS sq FROM od LEFT JOIN clim ON od.doy = clim.doy AND od.iy = clim.iy GROUP BY od.iy", ("f_obs",), _CLIM)
def anomaly(t: Tables):
    out = C.anomaly(obs_doy(t), _train_clim(t), ["doy", "iy"], ["theta"])
    d = F.col("delta_theta")
    return out.groupBy("iy").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(d), 3).alias("delta_theta"), F.round(F.sum(d * d), 3).alias("sq"))


@query("climatology_mse", f"""SELECT ROUND(AVG(e), 6) AS theta_mse, ROUND(SQRT(AVG(e)), 6) AS theta_rmse FROM (SELECT od.iy, od.ix, od.depth, AVG((theta - m) * (theta - m)) AS e
    FROM od JOIN clim ON od.doy = clim.doy AND od.iy = clim.iy WHERE {_TRAIN} GROUP BY 1, 2, 3)""", ("f_obs",), _CLIM)
def climatology_mse(t: Tables):
    train = G.keep_split(obs_doy(t), "day", "train", SPLITS)
    return rounded(C.climatology_mse(train, _train_clim(t), ["doy", "iy"], ["iy", "ix", "depth"], ["theta"]), "theta_mse", "theta_rmse")


@query("period_mean_baseline", """SELECT depth, iy, ix, COUNT(*) AS n, ROUND(MIN(m) - 1.234e-9, 6) AS theta_mean, ROUND(MIN(s) - 1.234e-9, 6) AS sp_mean, ROUND(SUM(ABS(theta - m)) - 1.234e-6, 3) AS residual FROM
    (SELECT o.*, COALESCE(AVG(theta) OVER w, 20) AS m, COALESCE(AVG(sp) OVER w, 34.5e0) AS s FROM (SELECT iy, ix, depth, CASE WHEN iy = 2 AND ix < 3 THEN NULL ELSE theta END AS theta, CASE WHEN iy = 2 AND ix < 3 THEN NULL ELSE sp END AS sp FROM f_obs) o
    WINDOW w AS (PARTITION BY iy, ix, depth)) GROUP BY 1, 2, 3""", ("f_obs",))
def period_mean_baseline(t: Tables):
    gap = (F.col("iy") == 2) & (F.col("ix") < 3)
    df = t.f_obs.select("iy", "ix", "depth", F.when(~gap, F.col("theta")).alias("theta"), F.when(~gap, F.col("sp")).alias("sp"))
    out = C.period_residual(df, ["iy", "ix", "depth"], {"theta": 20.0, "sp": 34.5})
    return out.groupBy("depth", "iy", "ix").agg(
        F.count(F.lit(1)).alias("n"), r(F.min("theta_mean") - 1.234e-9).alias("theta_mean"), r(F.min("sp_mean") - 1.234e-9).alias("sp_mean"),
        F.round(F.sum(F.abs("theta_residual")) - 1.234e-6, 3).alias("residual"))


@query("box_index", """SELECT CAST(day AS VARCHAR) AS day, ROUND(dmi, 6) AS dmi, ROUND(LAG(dmi, 7) OVER (ORDER BY day), 6) AS lag_7, ROUND(LAG(dmi, 14) OVER (ORDER BY day), 6) AS lag_14 FROM
    (SELECT day, AVG(CASE WHEN lon <= 45.875e0 THEN theta END) - AVG(CASE WHEN lon >= 46.625e0 AND lat <= 6.5e0 THEN theta END) AS dmi FROM (SELECT day, theta, 5.125e0 + 0.25e0 * iy AS lat, 45.125e0 + 0.25e0 * ix AS lon FROM f_obs)
    WHERE lon <= 45.875e0 OR (lon >= 46.625e0 AND lat <= 6.5e0) GROUP BY day)""", ("f_obs",))
def box_index(t: Tables):
    lat, lon = F.lit(5.125) + F.lit(0.25) * F.col("iy"), F.lit(45.125) + F.lit(0.25) * F.col("ix")
    df = t.f_obs.select("day", "theta", lat.alias("lat"), lon.alias("lon"))
    west = C.in_box({"lat_min": 0.0, "lat_max": 30.0, "lon_min": 45.0, "lon_max": 45.875})
    east = C.in_box({"lat_min": 0.0, "lat_max": 6.5, "lon_min": 46.625, "lon_max": 60.0})
    return rounded(C.box_index(df, "theta", west, east).withColumn("day", text("day")), "dmi", "lag_7", "lag_14")


@query("land_from_coverage", """SELECT iy, ix, ROUND(COUNT(v) / CAST(COUNT(*) AS DOUBLE), 6) AS frac, COUNT(v) / CAST(COUNT(*) AS DOUBLE) < 0.5e0 AS land FROM (SELECT iy, ix, CASE WHEN raw > 3e1 + iy * 2e0 THEN theta END AS v FROM f_obs) GROUP BY 1, 2""", ("f_obs",))
def land_from_coverage(t: Tables):
    seen = t.f_obs.select("iy", "ix", F.when(F.col("raw") > F.lit(30.0) + F.col("iy") * 2.0, F.col("theta")).alias("sst"))
    return rounded(C.land_from_coverage(seen, "sst"), "frac")


@query("land_on_grid", """SELECT a.iy, a.ix, ROUND(a.frac, 6) AS frac, a.frac < 0.5e0 AS land, (SELECT BOOL_OR(b.frac < 0.5e0) FROM share b WHERE ABS(a.iy - b.iy) <= 1 AND ABS(a.ix - b.ix) <= 1) AS coastal FROM share a""", ("f_obs",),
       """seen AS (SELECT DATE_TRUNC('month', day) AS day, iy, ix, CASE WHEN raw > 2e1 + iy * 4e0 THEN theta END AS v FROM f_obs WHERE (iy * 3 + ix) % 11 <> 5),
       share AS (SELECT CAST(y AS INT) AS iy, CAST(x AS INT) AS ix, COALESCE(n, 0) / CAST((SELECT COUNT(DISTINCT day) FROM seen) AS DOUBLE) AS frac FROM (SELECT UNNEST(GENERATE_SERIES(0, 9)) AS y), (SELECT UNNEST(GENERATE_SERIES(0, 9)) AS x)
       LEFT JOIN (SELECT iy, ix, COUNT(DISTINCT CASE WHEN v IS NOT NULL THEN day END) AS n FROM seen GROUP BY 1, 2) k ON k.iy = y AND k.ix = x)""")
def land_on_grid(t: Tables):
    """Months known per cell; a tenth of the cells is absent, and all depths of a month repeat its bit."""
    seen = t.f_obs.filter((F.col("iy") * 3 + F.col("ix")) % 11 != 5).select(
        F.trunc("day", "month").alias("day"), "iy", "ix", F.when(F.col("raw") > F.lit(20.0) + F.col("iy") * 4.0, F.col("theta")).alias("v"))
    n = seen.agg(F.countDistinct("day").alias("n")).scalar()
    return rounded(S.land_on_grid(S.known_days(seen, "v"), CELLS, n, 1).select("iy", "ix", "frac", "land", "coastal"), "frac")


@query("merge_features", """SELECT CAST(COALESCE(a.day, b.day) AS VARCHAR) AS day, COALESCE(a.n, b.n) AS n, ROUND(a.theta, 6) AS theta, ROUND(b.sp, 6) AS sp FROM
    (SELECT day, COUNT(*) AS n, AVG(theta) AS theta FROM f_obs WHERE depth < 75 GROUP BY day) a FULL JOIN (SELECT day, COUNT(*) AS n, AVG(sp) AS sp FROM f_obs WHERE NOT depth < 75 GROUP BY day) b ON a.day = b.day""", ("f_obs",))
def merge_features(t: Tables):
    a = t.f_obs.filter("depth < 75").groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.avg("theta").alias("theta"))
    b = t.f_obs.filter("NOT depth < 75").groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.avg("sp").alias("sp"))
    return rounded(C.merge_features(a, b).withColumn("day", text("day")), "theta", "sp")


@query("event_before_after", """SELECT series, ROUND(AVG(CASE WHEN day = DATE '2024-01-05' THEN value END), 6) AS value_before, ROUND(AVG(CASE WHEN day = DATE '2024-01-25' THEN value END), 6) AS value_after,
    ROUND(AVG(CASE WHEN day = DATE '2024-01-25' THEN value END) - AVG(CASE WHEN day = DATE '2024-01-05' THEN value END), 6) AS value_change FROM f_daily WHERE day IN (DATE '2024-01-05', DATE '2024-01-25') GROUP BY series""", ("f_daily",))
def event_before_after(t: Tables):
    out = C.before_after(t.f_daily, ["series"], "day", "2024-01-05", "2024-01-25", ["value"])
    return rounded(out, "value_before", "value_after", "value_change")
