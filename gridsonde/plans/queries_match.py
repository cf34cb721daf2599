"""Matching queries: in-situ samples against model days, cells and columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from gridsonde.functions import numeric as N
from gridsonde.functions.calendar import dt_bin
from gridsonde.grid_spec import GridSpec
from gridsonde.operators import match as M
from gridsonde.operators import training as T
from gridsonde.operators.climate import daily_mean
from gridsonde.plans.queries_skill import skill_sql
from gridsonde.plans.registry import Tables, query, r, rounded, text
from gridsonde.plans.sql_parts import PCHIP, SEG_VALUE

CELLS = GridSpec(5.125, 45.125, 0.25, 10, 10)

_NEAR = """near AS (SELECT obs_id, ARG_MIN(iy, ABS(lat - (5.125e0 + 0.25e0 * iy)) * 1e6 + iy * 1e-3) AS iy FROM f_insitu, (SELECT UNNEST(GENERATE_SERIES(0, 9)) AS iy) GROUP BY obs_id),
nearx AS (SELECT obs_id, ARG_MIN(ix, ABS(lon - (45.125e0 + 0.25e0 * ix)) * 1e6 + ix * 1e-3) AS ix FROM f_insitu, (SELECT UNNEST(GENERATE_SERIES(0, 9)) AS ix) GROUP BY obs_id)"""


@query("nearest_cell", "SELECT obs_id, CAST(iy AS INT) AS iy, CAST(ix AS INT) AS ix FROM near JOIN nearx USING (obs_id)", ("f_insitu",), _NEAR)
def nearest_cell(t: Tables):
    return M.nearest_cell(t.f_insitu, CELLS).select("obs_id", "iy", "ix")


@query("nearest_site", """SELECT obs_id, CASE WHEN POW(15 - lat2, 2) + POW(90 - lon2, 2) <= POW(12 - lat2, 2) + POW(90 - lon2, 2) THEN 'rama_15n90e' ELSE 'rama_12n90e' END AS site
    FROM (SELECT obs_id, lat * 2 + 1.2e0 AS lat2, lon * 2 - 1 AS lon2 FROM f_insitu)""", ("f_insitu",))
def nearest_site(t: Tables):
    return t.f_insitu.select("obs_id", N.nearest_site(F.col("lat") * 2 + 1.2, F.col("lon") * 2 - 1).alias("site"))


def near_time_sql(src: str, ident: str, limit: float) -> str:
    """CTE ``timed``: nearest model time by ranking all candidates."""
    return f"""timed AS (SELECT {ident}, t_model, h FROM (SELECT o.{ident}, m.t_model, ABS(EPOCH_US(m.t_model) - EPOCH_US(o.ts)) / 3.6e9 AS h,
    ROW_NUMBER() OVER (PARTITION BY o.{ident} ORDER BY ABS(EPOCH_US(m.t_model) - EPOCH_US(o.ts)), m.t_model) AS k FROM {src} o, (SELECT DISTINCT t_model FROM days) m) WHERE k = 1 AND h <= {limit})"""


_BIN = "CASE WHEN h <= 12 THEN 'dt_0d' WHEN h <= 36 THEN 'dt_1d' WHEN h <= 60 THEN 'dt_2d' END"


@query("nearest_time_join", f"""SELECT obs_id, CAST(t_model AS VARCHAR) AS t_model, ROUND(h, 5) AS dt_h, {_BIN} AS dt_bin FROM f_insitu LEFT JOIN timed USING (obs_id)""",
       ("f_insitu", "f_model_day"), "days AS (SELECT t_model FROM f_model_day), " + near_time_sql("f_insitu", "obs_id", 60))
def nearest_time_join(t: Tables):
    out = M.nearest_time(t.f_insitu.select("obs_id", "ts"), t.f_model_day.select("t_model"), "ts", "t_model")
    return out.select("obs_id", text("t_model").alias("t_model"), r("dt_hours", 5).alias("dt_h"), dt_bin(F.col("dt_hours")).alias("dt_bin"))


@query("qc_filter", """SELECT profile_id, COUNT(*) AS n, COUNT(temp) AS n_temp, COUNT(depth) AS n_depth, COUNT(psal) AS n_psal, ROUND(SUM(temp), 3) AS temp FROM (
    SELECT profile_id, CASE WHEN qc <= 2 AND pq <> 4 THEN temp END AS temp, CASE WHEN qc <= 2 AND pq <> 4 THEN depth END AS depth, CASE WHEN sq <= 2 THEN psal END AS psal FROM flagged WHERE posq <= 2 AND tq <= 2)
    GROUP BY profile_id HAVING COUNT(temp) >= 3""", ("f_insitu",),
       """flagged AS (SELECT platform * 100 + DAY(ts) AS profile_id, temp, depth, psal, qc, obs_id % 5 AS pq, 1 + obs_id % 3 AS sq, 1 + (platform % 11) // 4 AS posq, 1 + (DAY(ts) % 10) // 4 AS tq FROM f_insitu)""")
def qc_filter(t: Tables):
    """Flags as numbers, text and padded text; profiles are a platform's samples of one day."""
    i = F.col("obs_id")
    flagged = t.f_insitu.select(
        (F.col("platform") * 100 + F.dayofmonth("ts")).alias("profile_id"), "temp", "depth", "psal", F.col("qc").alias("temp_qc"),
        F.when(i % 5 == 4, "4").otherwise(" 1 ").alias("pres_qc"), (1 + i % 3).cast("string").alias("psal_qc"),
        (1 + F.floor(F.col("platform") % 11 / 4)).alias("position_qc"), (1 + F.floor(F.dayofmonth("ts") % 10 / 4)).cast("int").alias("time_qc"))
    out = M.qc_filter(flagged, ["profile_id"])
    return out.groupBy("profile_id").agg(
        F.count(F.lit(1)).alias("n"), F.count("temp").alias("n_temp"), F.count("depth").alias("n_depth"), F.count("psal").alias("n_psal"), F.round(F.sum("temp"), 3).alias("temp"))


@query("min_depth_guard", "SELECT COUNT(CASE WHEN depth < 5 AND temp IS NOT NULL THEN 1 END) AS n_shallow, COUNT(CASE WHEN depth >= 5 THEN 1 END) AS n_kept FROM f_insitu", ("f_insitu",))
def min_depth_guard(t: Tables):
    return M.shallow_count(t.f_insitu)


def _levels(t: Tables):
    """In-situ levels as profiles of a platform and day, some of them outside the domain."""
    far = F.when(F.col("platform") % 13 == 0, 30.0).otherwise(0.0)
    return t.f_insitu.select(
        "obs_id", (F.col("platform") * 100 + F.dayofmonth("ts")).alias("profile_id"), "ts", (F.col("lat") + far).alias("lat"), "lon", "depth",
        F.when(F.col("qc") != 4, F.col("temp")).alias("temp"), F.when(F.col("qc") != 3, F.col("psal")).alias("psal"))


_RAW_LEVELS = """lev AS (SELECT obs_id, platform * 100 + DAY(ts) AS profile_id, ts, lat + CASE WHEN platform % 13 = 0 THEN 30 ELSE 0 END AS lat, lon, depth, CASE WHEN qc <> 4 THEN temp END AS temp,
    CASE WHEN qc <> 3 THEN psal END AS psal FROM f_insitu)"""
_MODEL_SEG = PCHIP("mt", "f_model", ["t_model", "iy", "ix"], "depth", "theta") + ", " + PCHIP("ms", "f_model", ["t_model", "iy", "ix"], "depth", "sp")
_INTERP_T, _INTERP_S = (SEG_VALUE.replace("(z - z0)", f"({{z}} - {p}.z0)").replace("z1", f"{p}.z1").replace("- z0)", f"- {p}.z0)").replace("y0", f"{p}.y0").replace("y1", f"{p}.y1")
                        .replace("d0", f"{p}.d0").replace("d1", f"{p}.d1") for p in ("a", "b"))


def _in_seg(p: str, z: str) -> str:
    return f"({z} >= {p}.z0 OR ({p}.is_first AND {p}.complete)) AND ({z} < {p}.z1 OR ({p}.is_last AND {z} <= {p}.z1))"


def argo_sql(levels: str) -> str:
    """CTEs ``stat`` (status of every level) and ``pairs`` for the level rows ``lev``."""
    return f"""{levels}, days AS (SELECT DISTINCT t_model FROM f_model), {_NEAR}, {near_time_sql('lev', 'obs_id', 60)}, {_MODEL_SEG},
placed AS (SELECT l.*, iy, ix, l.lat BETWEEN 5.125e0 AND 7.375e0 AND l.lon BETWEEN 45.125e0 AND 47.375e0 AND ABS(l.lat - (5.125e0 + 0.25e0 * iy)) <= 0.35e0 AND ABS(l.lon - (45.125e0 + 0.25e0 * ix)) <= 0.35e0 AS inside, t_model, h
    FROM lev l LEFT JOIN near USING (obs_id) LEFT JOIN nearx USING (obs_id) LEFT JOIN timed USING (obs_id)),
stat AS (SELECT p.*, CASE WHEN NOT inside THEN 'far' WHEN h IS NULL THEN 'time' WHEN (SELECT COUNT(*) FROM f_model m WHERE m.t_model = p.t_model AND m.iy = p.iy AND m.ix = p.ix) < 3 THEN 'no_model'
    WHEN temp IS NOT NULL AND depth < 5 THEN 'shallow' WHEN temp IS NULL OR depth < 5 THEN 'missing' ELSE 'pair' END AS status FROM placed p),
pairs AS (SELECT s.obs_id, s.depth, {_BIN} AS dt_bin, s.h, s.temp, s.psal, {_INTERP_T.format(z='s.depth')} AS temp_model, {_INTERP_S.format(z='s.depth')} AS sp_model FROM stat s
    LEFT JOIN mt_seg a ON a.t_model = s.t_model AND a.iy = s.iy AND a.ix = s.ix AND {_in_seg('a', 's.depth')} LEFT JOIN ms_seg b ON b.t_model = s.t_model AND b.iy = s.iy AND b.ix = s.ix AND {_in_seg('b', 's.depth')} WHERE status = 'pair')"""


_ARGO = argo_sql(_RAW_LEVELS)
_ARGO_VIEWS = ("f_insitu", "f_model")


@query("argo_match", "SELECT obs_id, depth, dt_bin, ROUND(h, 5) AS dt_h, ROUND(temp, 6) AS temp, ROUND(temp_model, 6) AS temp_model, ROUND(psal, 6) AS psal, ROUND(sp_model, 6) AS sp_model FROM pairs", _ARGO_VIEWS, _ARGO)
def argo_match(t: Tables):
    pairs = M.argo_pairs(M.argo_match(_levels(t), t.f_model, CELLS, unique=True))
    out = pairs.select("obs_id", "depth", "dt_bin", r("dt_hours", 5).alias("dt_h"), "temp", "temp_model", "psal", "sp_model")
    return rounded(out, "temp", "temp_model", "psal", "sp_model")


@query("argo_counters", """SELECT COUNT(DISTINCT CASE WHEN status = 'far' THEN profile_id END) AS skipped_far, COUNT(DISTINCT CASE WHEN status = 'time' THEN profile_id END) AS skipped_time,
    COUNT(CASE WHEN status = 'shallow' THEN 1 END) AS skipped_shallow, COUNT(CASE WHEN status = 'pair' THEN 1 END) AS n_pairs FROM stat""", _ARGO_VIEWS, _ARGO)
def argo_counters(t: Tables):
    return M.argo_counters(M.argo_match(_levels(t), t.f_model, CELLS, unique=True))


@query("skill_by_dt", "SELECT dt_bin, variable, depth, n, n_pairs, ROUND(rmse, 6) AS rmse, ROUND(bias, 6) AS bias, ROUND(r, 6) AS pearson_r FROM skill", _ARGO_VIEWS,
       f"{_ARGO}, vars AS (SELECT dt_bin, 'theta' AS variable, depth, temp_model AS pred, temp AS obs FROM pairs UNION ALL SELECT dt_bin, 'sp', depth, sp_model, psal FROM pairs), " + skill_sql("vars", "dt_bin, variable"))
def skill_by_dt(t: Tables):
    pairs = M.argo_pairs(M.argo_match(_levels(t), t.f_model, CELLS, unique=True))
    return rounded(M.skill_by_dt(pairs), "rmse", "bias", "pearson_r")


# Moorings: every record is a sensor string of eight depths, placed on the test grid by its parity.
_MOOR = f"""cellv AS (SELECT event_id // 24 AS rec, event_id // 8 AS step, 1e0 + 1e1 * (event_id % 8) AS depth, MIN(CAST(ts AS TIMESTAMP)) AS t0, AVG(value) AS value FROM events GROUP BY 1, 2, 3),
moor AS (SELECT step, CASE WHEN rec % 2 = 0 THEN 'rama_15n90e' ELSE 'rama_12n90e' END AS site, MIN(t0) OVER (PARTITION BY step) AS ts, depth,
    CASE WHEN (step * 8 + CAST(depth AS INT)) % 9 = 0 OR (step % 10 = 0 AND depth > 20) THEN NULL ELSE 29e0 - 0.012e0 * depth + value / 1e3 END AS temp, 34e0 + 1e-3 * depth AS psal FROM cellv),
recs AS (SELECT DISTINCT step, site, ts FROM moor), days AS (SELECT DISTINCT t_model FROM f_model), {near_time_sql('recs', 'step', 12)},
known AS (SELECT step, depth, temp FROM moor WHERE temp IS NOT NULL), knowns AS (SELECT step, depth, psal FROM moor WHERE psal IS NOT NULL),
{PCHIP('ot', 'known', ['step'], 'depth', 'temp')}, {PCHIP('os', 'knowns', ['step'], 'depth', 'psal')}, {_MODEL_SEG},
base AS (SELECT r.step, r.site, r.ts, t_model, CASE WHEN site = 'rama_15n90e' THEN 7 ELSE 4 END AS iy, 3 AS ix FROM recs r JOIN timed USING (step)),
q AS (SELECT b.*, d.depth, 'model_to_mooring' AS direction, CAST(NULL AS DOUBLE) AS mt, CAST(NULL AS DOUBLE) AS ms FROM base b, (SELECT UNNEST([1e0, 1e1, 2e1, 4e1, 6e1, 8e1, 1e2, 14e1, 2e2, 3e2, 5e2]) AS depth) d
    UNION ALL SELECT b.*, m.depth, 'mooring_to_standard', m.theta, m.sp FROM base b JOIN f_model m ON m.t_model = b.t_model AND m.iy = b.iy AND m.ix = b.ix),
mm AS (SELECT q.step, q.site, q.ts, q.depth, q.direction, CASE WHEN direction = 'model_to_mooring' THEN {_INTERP_T.format(z='q.depth')} ELSE q.mt END AS temp_model, CASE WHEN direction = 'model_to_mooring' THEN {_INTERP_S.format(z='q.depth')} ELSE q.ms END AS sp_model,
    {_INTERP_T.format(z='q.depth').replace('a.', 'c.')} AS temp_obs, {_INTERP_S.format(z='q.depth').replace('b.', 'd.')} AS sp_obs FROM q
    LEFT JOIN mt_seg a ON a.t_model = q.t_model AND a.iy = q.iy AND a.ix = q.ix AND {_in_seg('a', 'q.depth')} LEFT JOIN ms_seg b ON b.t_model = q.t_model AND b.iy = q.iy AND b.ix = q.ix AND {_in_seg('b', 'q.depth')}
    LEFT JOIN ot_seg c ON c.step = q.step AND c.n >= 3 AND {_in_seg('c', 'q.depth')} LEFT JOIN os_seg d ON d.step = q.step AND d.n >= 3 AND {_in_seg('d', 'q.depth')})"""


def _mooring(t: Tables):
    """Sensor-string rows straight from the events: site, ts, lat, lon, depth, temp, psal and their step."""
    e = t.events.select(
        F.floor(F.col("event_id") / 24).alias("rec"), F.floor(F.col("event_id") / 8).alias("step"),
        (F.lit(1.0) + (F.col("event_id") % 8) * 10.0).alias("depth"), F.col("ts").cast("timestamp").alias("ts"), "value")
    cells = e.groupBy("rec", "step", "depth").agg(F.min("ts").alias("ts"), F.avg("value").alias("value"))
    start = cells.groupBy("step").agg(F.min("ts").alias("ts"))
    north = F.col("rec") % 2 == 0
    gone = ((F.col("step") * 8 + F.col("depth").cast("int")) % 9 == 0) | ((F.col("step") % 10 == 0) & (F.col("depth") > 20))
    return cells.drop("ts").join(start, "step").select(
        F.when(north, "rama_15n90e").otherwise("rama_12n90e").alias("site"), "ts", F.when(north, 6.9).otherwise(6.1).alias("lat"), F.lit(45.9).alias("lon"),
        "depth", F.when(~gone, F.lit(29.0) - F.col("depth") * 0.012 + F.col("value") / 1e3).alias("temp"), (F.lit(34.0) + F.col("depth") * 1e-3).alias("psal"))


_MM_COLS = "CAST(ts AS VARCHAR) AS ts, site, depth, direction, ROUND(temp_model, 6) AS temp_model, ROUND(temp_obs, 6) AS temp_obs, ROUND(sp_model, 6) AS sp_model, ROUND(sp_obs, 6) AS sp_obs"


@query("mooring_match", f"SELECT {_MM_COLS} FROM mm", ("f_model",), _MOOR)
def mooring_match(t: Tables):
    out = M.mooring_match(_mooring(t), t.f_model, CELLS, unique=True)
    return rounded(out.withColumn("ts", text("ts")), "temp_model", "temp_obs", "sp_model", "sp_obs")


@query("mooring_skill", "SELECT direction, variable, depth, n, n_pairs, ROUND(rmse, 6) AS rmse, ROUND(bias, 6) AS bias, ROUND(r, 6) AS pearson_r FROM skill", ("f_model",),
       f"{_MOOR}, vars AS (SELECT direction, 'theta' AS variable, depth, temp_model AS pred, temp_obs AS obs FROM mm UNION ALL SELECT direction, 'sp', depth, sp_model, sp_obs FROM mm), " + skill_sql("vars", "direction, variable"))
def mooring_skill(t: Tables):
    return rounded(M.mooring_skill(M.mooring_match(_mooring(t), t.f_model, CELLS, unique=True)), "rmse", "bias", "pearson_r")


@query("point_lookup", """SELECT pid, CAST(iy AS INT) AS iy, CAST(ix AS INT) AS ix, n, ROUND(theta, 6) AS theta FROM (SELECT c_custkey AS pid, ((c_custkey * 7) % 10) AS iy, ((c_custkey * 3) % 10) AS ix FROM customer) s
    JOIN (SELECT iy, ix FROM f_mask WHERE NOT land) m USING (iy, ix) JOIN (SELECT iy, ix, COUNT(*) AS n, SUM(theta * (depth + 1)) AS theta FROM f_profile GROUP BY 1, 2) p USING (iy, ix)""", ("f_profile", "f_mask"))
def point_lookup(t: Tables):
    """Stations near cell centres; those on land disappear, the others get their whole column."""
    k = F.col("c_custkey")
    stations = t.customer.select(k.alias("pid"), (F.lit(5.125) + 0.25 * (k * 7 % 10) + 0.05).alias("lat"), (F.lit(45.125) + 0.25 * (k * 3 % 10) - 0.05).alias("lon"))
    out = M.point_lookup(stations, t.f_profile, t.f_mask, CELLS)
    total = F.aggregate("levels", F.lit(0.0), lambda a, x: a + x["theta"] * (x["depth"] + 1.0))
    return out.select("pid", "iy", "ix", F.size("levels").cast("bigint").alias("n"), r(total).alias("theta"))


# --- model-input tables ----------------------------------------------------------------------------


@query("antecedent_window", """SELECT series, CAST(day AS VARCHAR) AS day, n, CAST(d0 AS VARCHAR) AS first_day, ROUND(v0, 6) AS first_value, ROUND(v1, 6) AS last_value FROM (SELECT series, day, COUNT(*) OVER w AS n, MIN(day) OVER w AS d0,
    FIRST_VALUE(value) OVER w AS v0, value AS v1 FROM f_daily WINDOW w AS (PARTITION BY series ORDER BY day RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW)) WHERE n = 7""", ("f_daily",))
def antecedent_window(t: Tables):
    """Seven-day blocks of daily means."""
    daily = daily_mean(t.f_series, "ts", ["series"], ["value"])
    w = T.antecedent_window(daily, ["series"], "day", ["value"])
    first = F.get("window", F.lit(0))
    return w.select("series", text("day").alias("day"), F.size("window").cast("bigint").alias("n"), text(first["day"]).alias("first_day"),
                    r(first["value"]).alias("first_value"), r("value").alias("last_value"))


@query("standardize", """SELECT series, CAST(day AS VARCHAR) AS day, ROUND((value - (SELECT AVG(value) FROM f_daily WHERE DAY(day) <= 20)) / GREATEST((SELECT STDDEV_POP(value) FROM f_daily WHERE DAY(day) <= 20), 1e-3), 6) AS z,
    ROUND((value - 10) / 1e-3, 3) AS supplied FROM f_daily""", ("f_daily",))
def standardize(t: Tables):
    d = t.f_daily.withColumn("supplied", F.col("value")).withColumn("z", F.col("value"))
    out = T.standardize(T.standardize_by(d, d.filter(F.dayofmonth("day") <= 20), ["z"]), {"supplied": (10.0, 1e-9)})
    return rounded(rounded(out.select("series", text("day").alias("day"), "z", "supplied"), "z"), "supplied", digits=3)


def surface_tables(t: Tables):
    """Surface stores of the day cube: temperature, salinity and sea level at 0 m, winds at 10 m."""
    top = t.f_obs.filter("depth = 0")
    wind = t.f_obs.filter("depth = 10")
    key = ["day", "iy", "ix"]
    return {
        "sst": top.select(*key, F.when((F.col("iy") + F.col("ix")) % 6 != 0, F.col("theta")).alias("delta_sst")),
        "sss": top.select(*key, F.col("sp").alias("sos")),
        "winds": wind.select(*key, (F.col("theta") - 25.0).alias("u10"), (F.col("sp") - 34.0).alias("v10")),
    }


CHANNELS_SQL = """chan AS (SELECT s.day, s.iy, s.ix, CASE WHEN e.elevation_m >= 0 THEN 0 ELSE 1 END AS sea, CASE WHEN (s.iy + s.ix) % 6 <> 0 THEN s.theta END AS sst, s.sp AS sss, w.theta - 25 AS u10, w.sp - 34 AS v10, e.elevation_m AS e, s.iy AS y
    FROM (SELECT * FROM f_obs WHERE depth = 0) s LEFT JOIN (SELECT * FROM f_obs WHERE depth = 10) w ON w.day = s.day AND w.iy = s.iy AND w.ix = s.ix LEFT JOIN f_elev e ON e.iy = s.iy AND e.ix = s.ix),
ch AS (SELECT day, iy, ix, COALESCE(sst, 0) * sea AS sst, COALESCE(sss, 0) * sea AS sss, COALESCE(u10, 0) * sea AS u10, COALESCE(v10, 0) * sea AS v10, GREATEST(2 * 7.292115e-5 * SIN(RADIANS(5.125e0 + 0.25e0 * iy)), 1.5e-5) * sea AS f,
    CASE WHEN e < 0 THEN -e ELSE 0 END AS w, (CASE WHEN DAYOFYEAR(MAKE_DATE(YEAR(day), 12, 31)) = 366 AND DAYOFYEAR(day) >= 60 THEN DAYOFYEAR(day) - 1 ELSE DAYOFYEAR(day) END) AS doy, sea FROM chan)"""


@query("channel_assembly", """SELECT CAST(day AS VARCHAR) AS day, iy, ix, ROUND(sst, 6) AS sst, ROUND(sss, 6) AS sss, 0e0 AS sla, 0e0 AS w_e, ROUND(u10, 6) AS u10, ROUND(v10, 6) AS v10, ROUND(f * 1e6, 6) AS f_1e6, ROUND(w, 6) AS water_column,
    ROUND(SIN(2 * PI() * (doy - 1) / 365e0) * sea, 6) AS doy_sin, ROUND(COS(2 * PI() * (doy - 1) / 365e0) * sea, 6) AS doy_cos FROM ch""", ("f_obs", "f_elev"), CHANNELS_SQL)
def channel_assembly(t: Tables):
    """Twelve channels; sea level and pumping are absent stores and become zero."""
    c = T.channel_assembly(surface_tables(t), t.f_elev, CELLS)
    c = c.withColumn("f_1e6", F.col("f_tilde") * 1e6)
    out = c.select(text("day").alias("day"), "iy", "ix", "sst", "sss", "sla", "w_e", "u10", "v10", "f_1e6", "water_column", "doy_sin", "doy_cos")
    return rounded(out, *[n for n in out.columns if n not in ("day", "iy", "ix")])


@query("score_windows", """SELECT series, CAST(day AS VARCHAR) AS day, ROUND(m, 6) AS score FROM (SELECT series, day, COUNT(*) OVER w AS n, AVG(value) OVER w AS m
    FROM f_daily WINDOW w AS (PARTITION BY series ORDER BY day RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW)) WHERE n = 7""", ("f_daily",))
def score_windows(t: Tables):
    """A caller's function (here the window mean) applied to Arrow batches of windows."""
    daily = daily_mean(t.f_series, "ts", ["series"], ["value"])
    windows = T.antecedent_window(daily, ["series"], "day", ["value"]).select(
        "series", "day", F.transform("window", lambda w: w["value"]).alias("values"))

    def window_mean(batch):
        return batch.assign(score=np.stack(batch["values"]).mean(axis=1) if len(batch) else 0.0)[["series", "day", "score"]]

    scored = T.score_windows(windows, window_mean, "series string, day date, score double")
    return scored.select("series", text("day").alias("day"), r("score").alias("score"))


@query("nearest_cell_irregular", """SELECT c_custkey AS id, CASE WHEN c_custkey % 11 <> 0 THEN (SELECT n_nationkey FROM nation ORDER BY ABS(POW(n_nationkey, 1.5e0) - c_acctbal / 6e1), n_nationkey LIMIT 1) END AS cell FROM customer""")
def nearest_cell_irregular(t: Tables):
    """Positions against an axis whose spacing grows; some positions are missing, some lie beyond the ends."""
    axis = t.nation.select(F.col("n_nationkey").alias("cell"), F.pow(F.col("n_nationkey"), F.lit(1.5)).alias("centre"))
    points = t.customer.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 11 != 0, F.col("c_acctbal") / 60.0).alias("x"))
    return M.nearest_on_axis(points, axis, "x", "cell", "centre", width=8.0).select("id", "cell")
