"""End-to-end jobs over the supplied tables, and the streaming daily mean."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridsonde import constants as K
from gridsonde.plans import jobs as J
from gridsonde.plans.queries_climate import DOY_SQL
from gridsonde.plans.queries_grid import SPLITS
from gridsonde.plans.queries_match import CELLS, argo_sql
from gridsonde.plans.queries_skill import skill_sql
from gridsonde.plans.queries_spatial import _EKMAN, _REGRID, COARSE, WIND
from gridsonde.plans.queries_vertical import _INDEX_CTES, _STEP, _SURFACE_SQL, SERVING_SQL
from gridsonde.plans.registry import Tables, query, r, rounded, text
from gridsonde.plans.sql_parts import PCHIP, level_values
from gridsonde.session import scratch_path
from gridsonde.streaming.daily import append_to, read_stream, stream_daily_mean as daily_stream, with_open_days

_WEIGHTS = _REGRID[_REGRID.index("wy AS"):]
_LAND15 = "[0e0, 5e0, 1e1, 2e1, 3e1, 5e1, 75e0, 1e2, 125e0, 15e1, 2e2, 3e2, 5e2, 7e2, 1e3]"


@query("job_regrid", """SELECT CAST(t_model AS VARCHAR) AS t, CAST(depth AS DOUBLE) AS depth, iy, ix, ROUND(CASE WHEN elevation_m < 0 AND -elevation_m > depth THEN v END, 5) AS thetao FROM
    (SELECT t_model, depth, CAST(jy AS INT) AS iy, CAST(jx AS INT) AS ix, SUM(CASE WHEN v IS NOT NULL THEN wy.w * wx.w * v END) / SUM(CASE WHEN v IS NOT NULL THEN wy.w * wx.w END) AS v
    FROM std JOIN wy USING (iy) JOIN wx USING (ix) GROUP BY 1, 2, 3, 4) LEFT JOIN f_elev USING (iy, ix)""", ("f_model", "f_elev"),
       f"{PCHIP('g', 'f_model', ['t_model', 'iy', 'ix'], 'depth', 'theta')}, {level_values('std', 'g', K.STANDARD_DEPTHS, ('t_model', 'iy', 'ix'))}, {_WEIGHTS}")
def job_regrid(t: Tables):
    """Model cube with foreign column names: depth interpolation, remap and sea-floor mask."""
    raw = t.f_model.select(F.col("t_model").alias("valid_time"), F.col("depth").alias("lev"), CELLS.lat().alias("nav_lat"),
                           CELLS.lon().alias("Longitude"), F.col("theta").alias("temperature"))
    out = J.job_regrid(raw, COARSE, ["thetao"], ["time", "depth"], K.RAW_ALIASES["reanalysis"], interpolate_depth=True, elevation=t.f_elev)
    return out.select(text("time").alias("t"), "depth", "iy", "ix", r("thetao", 5).alias("thetao"))


_MASKS = f"""{_WEIGHTS}, el AS (SELECT CAST(jy AS INT) AS iy, CAST(jx AS INT) AS ix, SUM(wy.w * wx.w * elevation_m) / SUM(wy.w * wx.w) AS e FROM f_elev JOIN wy USING (iy) JOIN wx USING (ix) GROUP BY 1, 2)"""


@query("job_masks", """SELECT a.iy, a.ix, a.e >= 0 AS land, ROUND(CASE WHEN a.e >= 0 THEN 0 ELSE -a.e END, 5) AS water_m, (SELECT BOOL_OR(b.e >= 0) FROM el b WHERE ABS(a.iy - b.iy) <= 2 AND ABS(a.ix - b.ix) <= 2) AS coastal,
    (SELECT BOOL_OR(b.e >= 0) FROM el b WHERE ABS(a.iy - b.iy) <= 1 AND ABS(a.ix - b.ix) <= 1) AS gradient_invalid, (SELECT COUNT(*) FROM (SELECT UNNEST(""" + _LAND15 + """) AS z) WHERE a.e < 0 AND -a.e > z) AS n_valid FROM el a""", ("f_elev",), _MASKS)
def job_masks(t: Tables):
    masks, validity = J.job_masks(t.f_elev.select(CELLS.lat().alias("lat"), CELLS.lon().alias("lon"), "elevation_m"), COARSE)
    n = validity.groupBy("iy", "ix").agg(F.count_if("valid").alias("n_valid"))
    return masks.join(n, ["iy", "ix"]).select("iy", "ix", "land", r("water_m", 5).alias("water_m"), "coastal", "gradient_invalid", "n_valid")


@query("job_masks_counts", """SELECT c.name, CAST(NULL AS DOUBLE) AS depth, c.n FROM (SELECT UNNEST([{'name': 'land', 'n': COUNT(*) FILTER (land)}, {'name': 'ocean', 'n': COUNT(*) FILTER (NOT land)},
    {'name': 'coastal', 'n': COUNT(*) FILTER (coastal AND NOT land)}, {'name': 'gradient_invalid', 'n': COUNT(*) FILTER (gradient_invalid AND NOT land)}]) AS c FROM (SELECT a.e >= 0 AS land,
    (SELECT BOOL_OR(b.e >= 0) FROM el b WHERE ABS(a.iy - b.iy) <= 2 AND ABS(a.ix - b.ix) <= 2) AS coastal,
    (SELECT BOOL_OR(b.e >= 0) FROM el b WHERE ABS(a.iy - b.iy) <= 1 AND ABS(a.ix - b.ix) <= 1) AS gradient_invalid FROM el a))
    UNION ALL SELECT 'valid', z, COUNT(*) FILTER (e < 0 AND -e > z) FROM el, (SELECT UNNEST(""" + _LAND15 + """) AS z) GROUP BY z""", ("f_elev",), _MASKS)
def job_masks_counts(t: Tables):
    """Land, ocean and buffer cells and the valid cells per level of the masks job."""
    return J.mask_counts(*J.job_masks(t.f_elev.select(CELLS.lat().alias("lat"), CELLS.lon().alias("lon"), "elevation_m"), COARSE))


_DMI = """dm AS (SELECT *, LAG(dmi, 7) OVER (ORDER BY day) AS lag_7 FROM (SELECT day, AVG(CASE WHEN ix <= 3 THEN theta END) - AVG(CASE WHEN ix >= 6 THEN theta END) AS dmi FROM (
    SELECT DATE_TRUNC('month', day) AS day, ix, theta FROM f_obs WHERE depth = 0 AND (ix <= 3 OR ix >= 6)) GROUP BY day))"""


@query("job_features", """SELECT CAST(MAKE_DATE(CAST(ym // 100 AS INT), CAST(ym % 100 AS INT), 1) AS VARCHAR) AS day, iy, ix, ROUND(tx, 6) AS tau_x, ROUND(CASE WHEN NOT land THEN curl * 1e6 END, 6) AS curl_1e6, ROUND(CASE WHEN NOT land THEN w_e * 1e6 END, 6) AS w_e_1e6,
    ROUND(SIN(2 * PI() * (doy - 1) / 365e0), 6) AS doy_sin, ROUND(dmi, 6) AS dmi, ROUND(lag_7, 6) AS dmi_lag_7d FROM
    (SELECT f.*, MAKE_DATE(CAST(ym // 100 AS INT), CAST(ym % 100 AS INT), 1) AS day FROM feat f) LEFT JOIN (SELECT day AS mday, dmi, lag_7 FROM dm) ON mday = day,
    LATERAL (SELECT """ + DOY_SQL + """ AS doy)""", ("f_wind", "f_mask", "f_obs"), f"{_EKMAN}, {_DMI}")
def job_features(t: Tables):
    """Monthly wind physics merged with the calendar encoding and a lagged east-west index."""
    first = F.make_date(F.floor(F.col("ym") / 100).cast("int"), (F.col("ym") % 100).cast("int"), F.lit(1))
    winds = t.f_wind.withColumn("day", first).select("day", "iy", "ix", "u10", "v10")
    sst = t.f_obs.filter("depth = 0").select(F.trunc("day", "month").alias("day"), "ix", F.col("theta").alias("sst"))
    out = J.job_features(winds, t.f_mask, WIND, sst, F.col("ix") <= 3, F.col("ix") >= 6)
    return out.select(text("day").alias("day"), "iy", "ix", r("tau_x").alias("tau_x"), r(F.col("curl") * 1e6).alias("curl_1e6"), r(F.col("w_e") * 1e6).alias("w_e_1e6"),
                      r("doy_sin").alias("doy_sin"), r("dmi").alias("dmi"), r("dmi_lag_7d").alias("dmi_lag_7d"))


_TRAIN = "day BETWEEN DATE '1995-01-01' AND DATE '1999-12-31'"
_FILLED = f"""od AS (SELECT *, {DOY_SQL} AS doy FROM f_obs), known AS (SELECT doy, iy, ix, AVG(theta) AS m, STDDEV_POP(theta) AS sd, COUNT(theta) AS n FROM od WHERE {_TRAIN} GROUP BY doy, iy, ix),
sp AS (SELECT d.doy, c.iy, c.ix FROM (SELECT UNNEST(GENERATE_SERIES(1, 365)) AS doy) d, (SELECT DISTINCT iy, ix FROM known) c),
ends AS (SELECT s.*, k.m, k.sd, COALESCE(k.n, 0) AS n, MAX(k.doy) OVER (PARTITION BY s.iy, s.ix ORDER BY s.doy) AS p1, MIN(k.doy) OVER (PARTITION BY s.iy, s.ix ORDER BY s.doy DESC) AS n1 FROM sp s LEFT JOIN known k ON k.doy = s.doy AND k.iy = s.iy AND k.ix = s.ix),
ord AS (SELECT doy, iy, ix, m, LAG(doy) OVER w AS d_b, LAG(m) OVER w AS m_b, LEAD(doy) OVER w AS d_a, LEAD(m) OVER w AS m_a FROM known WINDOW w AS (PARTITION BY iy, ix ORDER BY doy)),
filled AS (SELECT e.doy, e.iy, e.ix, e.sd, e.n, CASE WHEN e.m IS NOT NULL THEN e.m WHEN lo.doy IS NOT NULL AND hi.doy IS NOT NULL THEN lo.m + (hi.m - lo.m) * (e.doy - lo.doy) / (hi.doy - lo.doy)
    WHEN lo.doy IS NOT NULL THEN lo.m_b + (lo.m - lo.m_b) * (e.doy - lo.d_b) / (lo.doy - lo.d_b) ELSE hi.m + (hi.m_a - hi.m) * (e.doy - hi.doy) / (hi.d_a - hi.doy) END AS clim
    FROM ends e LEFT JOIN ord lo ON lo.iy = e.iy AND lo.ix = e.ix AND lo.doy = e.p1 LEFT JOIN ord hi ON hi.iy = e.iy AND hi.ix = e.ix AND hi.doy = e.n1)"""


@query("job_climatology", f"""SELECT f.iy, f.ix, f.n_low, ROUND(clim - 1.234e-6, 3) AS clim, ROUND(delta - 1.234e-6, 3) AS delta, ROUND(mse, 6) AS mse FROM (SELECT iy, ix, COUNT(CASE WHEN n < 3 THEN 1 END) AS n_low, SUM(clim) AS clim FROM filled GROUP BY 1, 2) f
    JOIN (SELECT o.iy, o.ix, SUM(theta - clim) AS delta FROM od o JOIN filled USING (doy, iy, ix) GROUP BY 1, 2) a ON a.iy = f.iy AND a.ix = f.ix,
    (SELECT AVG(e) AS mse FROM (SELECT AVG((theta - clim) * (theta - clim)) AS e FROM od o JOIN filled USING (doy, iy, ix) WHERE {_TRAIN} GROUP BY iy, ix, depth))""", ("f_obs",), _FILLED)
def job_climatology(t: Tables):
    """Train-split climatology per cell with its gaps filled, anomalies of all days, baseline error."""
    clim, anomalies, baseline = J.job_climatology(t.f_obs, ["iy", "ix"], ["theta"], ["iy", "ix", "depth"], SPLITS)
    c = clim.groupBy("iy", "ix").agg(F.count_if("theta_low").alias("n_low"), F.round(F.sum("theta_clim") - 1.234e-6, 3).alias("clim"))
    a = anomalies.groupBy("iy", "ix").agg(F.round(F.sum("delta_theta") - 1.234e-6, 3).alias("delta"))
    mse = baseline.select("theta_mse").scalar()
    return c.join(a, ["iy", "ix"]).withColumn("mse", F.round(mse, 6))


@query("job_indices", """SELECT cid, ROUND(CASE WHEN cid % 9 <> 0 THEN z20 END, 6) AS z20, ROUND(CASE WHEN cid % 9 <> 0 THEN mld END, 6) AS mld, ROUND(CASE WHEN cid % 9 <> 0 THEN COALESCE(tchp, 0) - 1e-9 END, 6) AS tchp,
    ROUND(CASE WHEN cid % 9 <> 0 THEN ((CASE WHEN sst >= 28 THEN 1 ELSE 0 END) + (CASE WHEN tchp >= 60 THEN 1 ELSE 0 END)) / 3e0 END, 6) AS cip,
    CASE WHEN cid % 9 = 0 THEN 'UNKNOWN' WHEN tchp > 80 THEN 'EXTREME' WHEN tchp >= 50 THEN 'MODERATE' ELSE 'DEPLETED' END AS heat_class FROM serving JOIN surf USING (cid)""",
       ("f_column",), f"{_STEP}, {SERVING_SQL}, {_SURFACE_SQL}")
def job_indices(t: Tables):
    cube = t.f_column.withColumn("land", F.col("cid") % 9 == 0)
    out = J.job_indices(cube, ["cid"], serving=True, land="land").select("cid", "z20", "mld", "tchp", "cip", "heat_class")
    return rounded(rounded(out, "z20", "mld", "cip"), "tchp", shift=1e-9)


@query("job_indices_metre", """SELECT idx.cid, ROUND(d26, 6) AS d26, ROUND(z20, 6) AS z20, ROUND(mld, 4) AS mld, ROUND(ild - 1.234e-9, 6) AS ild,
    ROUND(CASE WHEN has = 1 THEN COALESCE(e, 0) END, 6) AS tchp FROM idx JOIN heat USING (cid)""", ("f_inverted",), _INDEX_CTES.replace("f_column", "f_inverted"))
def job_indices_metre(t: Tables):
    """The 1 m validation family of the index job."""
    out = J.job_indices(t.f_inverted, ["cid"]).select("cid", "d26", "z20", "mld", "ild", "tchp")
    return rounded(rounded(rounded(out, "d26", "z20", "tchp"), "mld", digits=4), "ild", shift=1.234e-9)


_QC_LEVELS = """flagged AS (SELECT obs_id, platform * 100 + DAY(ts) AS profile_id, ts, lat + CASE WHEN platform % 13 = 0 THEN 30 ELSE 0 END AS lat, lon, CASE WHEN qc <= 2 THEN depth END AS depth, CASE WHEN qc <= 2 THEN temp END AS temp, CASE WHEN obs_id % 7 <> 0 THEN psal END AS psal FROM f_insitu WHERE (platform % 17) <> 3),
lev AS (SELECT * FROM flagged WHERE profile_id IN (SELECT profile_id FROM flagged GROUP BY 1 HAVING COUNT(temp) >= 3))"""


@query("job_validation", "SELECT dt_bin, variable, depth, n, n_pairs, ROUND(rmse, 6) AS rmse, ROUND(bias, 6) AS bias, ROUND(r, 6) AS pearson_r FROM skill", ("f_insitu", "f_model"),
       argo_sql(_QC_LEVELS) + ", vars AS (SELECT dt_bin, 'theta' AS variable, depth, temp_model AS pred, temp AS obs FROM pairs UNION ALL SELECT dt_bin, 'sp', depth, sp_model, psal FROM pairs), " + skill_sql("vars", "dt_bin, variable"))
def job_validation(t: Tables):
    """Flagged levels through quality control, matching and depth-wise scores."""
    far = F.when(F.col("platform") % 13 == 0, 30.0).otherwise(0.0)
    levels = t.f_insitu.select(
        "obs_id", (F.col("platform") * 100 + F.dayofmonth("ts")).alias("profile_id"), "ts", (F.col("lat") + far).alias("lat"), "lon", "depth", "temp", "psal",
        F.col("qc").alias("temp_qc"), F.lit("1").alias("pres_qc"), F.when(F.col("obs_id") % 7 == 0, 4).otherwise(1).alias("psal_qc"),
        F.when(F.col("platform") % 17 == 3, "3").otherwise("2").alias("position_qc"), F.lit(1).alias("time_qc"))
    skill, _, _ = J.job_validation(levels, t.f_model, CELLS)
    return rounded(skill, "rmse", "bias", "pearson_r")


_TRAINING = f"""s0 AS (SELECT CAST(DATE '2024-01-01' + CAST(DAY(day) % 16 AS INT) AS DATE) AS day, iy, ix, depth, AVG(theta) AS theta, AVG(sp) AS sp FROM f_obs GROUP BY 1, 2, 3, 4),
chan AS (SELECT s.day, s.iy, s.ix, CASE WHEN e.elevation_m >= 0 THEN 0 ELSE (s.theta - 25) / 5e0 END AS sst FROM s0 s LEFT JOIN f_elev e ON e.iy = s.iy AND e.ix = s.ix WHERE s.depth = 0),
win AS (SELECT * FROM (SELECT *, COUNT(*) OVER w AS n, SUM(sst) OVER w AS window_sst, MIN(day) OVER w AS first_day FROM chan WINDOW w AS (PARTITION BY iy, ix ORDER BY day RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW)) WHERE n = 7),
tg AS (SELECT s.day, s.iy, s.ix, COUNT(*) AS n_targets, COUNT(CASE WHEN e.elevation_m < 0 AND -e.elevation_m > depth THEN 1 END) AS n_valid, SUM(CASE WHEN e.elevation_m >= 0 THEN 0 ELSE theta - 25 END) AS delta FROM s0 s LEFT JOIN f_elev e ON e.iy = s.iy AND e.ix = s.ix GROUP BY 1, 2, 3)"""


@query("job_training_table", "SELECT CAST(day AS VARCHAR) AS day, iy, ix, CAST(first_day AS VARCHAR) AS first_day, ROUND(window_sst, 5) AS window_sst, n_targets, n_valid, ROUND(delta, 5) AS delta FROM win JOIN tg USING (day, iy, ix)", ("f_obs", "f_elev"), _TRAINING)
def job_training_table(t: Tables):
    """Daily surface fields of every cell: standardised windows with their targets."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.dayofmonth("day") % 16)  # years and months folded, so that cells have runs of days
    s0 = t.f_obs.groupBy(day.alias("day"), "iy", "ix", "depth").agg(F.avg("theta").alias("theta"), F.avg("sp").alias("sp"))
    top = s0.filter("depth = 0").select("day", "iy", "ix", F.col("theta").alias("sst"), F.col("sp").alias("sss"))
    targets = s0.select("day", "iy", "ix", "depth", (F.col("theta") - 25.0).alias("delta_theta"), (F.col("sp") - 34.0).alias("delta_sp"),
                        F.lit(25.0).alias("theta_clim"), F.lit(34.0).alias("sp_clim"))
    # Land becomes zero before standardisation, so the mean is taken off beforehand.
    out = J.job_training_table({"sst": top.withColumn("sst", F.col("sst") - 25.0)}, targets, t.f_elev, CELLS, {"sst": (0.0, 5.0)})
    total = F.aggregate("window", F.lit(0.0), lambda a, w: a + w["sst"])
    delta = F.aggregate("targets", F.lit(0.0), lambda a, w: a + w["delta_theta"])
    return out.select(text("day").alias("day"), "iy", "ix", text(F.get("window", F.lit(0))["day"]).alias("first_day"), r(total, 5).alias("window_sst"),
                      F.size("targets").cast("bigint").alias("n_targets"), F.size(F.filter("targets", lambda x: x["valid"])).cast("bigint").alias("n_valid"), r(delta, 5).alias("delta"))


@query("stream_daily_mean", """SELECT series, CAST(day AS VARCHAR) AS day, ROUND(value, 6) AS value FROM f_daily""", ("f_daily",))
def stream_daily_mean(t: Tables):
    """The events file as a stream: days closed by the watermark, then those left open, read back from the sink."""
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("user_id", T.LongType()),
                           T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])
    stream = read_stream(t.spark, t.sf_dir, schema, files="events.parquet").select(F.col("event_type").alias("series"), "ts", "value")
    out = scratch_path(t.spark, "stream_daily")
    append_to(daily_stream(stream, "ts", ["series"], ["value"]), f"{out}/data", f"{out}/checkpoint").awaitTermination()
    back = with_open_days(t.f_series, f"{out}/data", "ts", ["series"], ["value"])
    return back.select("series", text("day").alias("day"), r("value").alias("value"))


