"""Water-column queries: one column per part, seven levels each."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridsonde import constants as K
from gridsonde.functions import physics as P
from gridsonde.operators import vertical as V
from gridsonde.plans.registry import Tables, query, r, rounded
from gridsonde.plans.sql_parts import PCHIP, SEG_VALUE, level_values, metre_profile

_CID = ["cid"]


def _with_density(t: Tables):
    theta, sp = F.col("theta"), F.col("sp")
    return t.f_column.withColumn("ct", theta).withColumn("rho", P.simple_density(theta, sp))


def _fused(t: Tables, *wanted: str):
    """Single indices take the fused chain, which samples no deeper than they need."""
    return V.column_indices(_with_density(t), _CID, "depth", "ct", "rho", unique=True, wanted=wanted)


RHO_SQL = "1025e0 - 0.15e0 * (theta - 1e1) + 0.76e0 * (sp * (35.16504e0 / 35e0) - 35e0)"
_COLUMNS = f"cols AS (SELECT cid, depth, theta AS ct, {RHO_SQL} AS rho FROM f_column)"
_CT = PCHIP("ct", "cols", ["cid"], "depth", "ct") + ", " + metre_profile("ct")
_RHO = PCHIP("rho", "cols", ["cid"], "depth", "rho") + ", " + metre_profile("rho")
_PAIRS = """pairs AS (SELECT a.cid, a.z, a.v AS v0, LEAD(a.v) OVER w AS v1, b.v AS r0, LEAD(b.v) OVER w AS r1
    FROM ct_m a JOIN rho_m b ON a.cid = b.cid AND a.z = b.z WINDOW w AS (PARTITION BY a.cid ORDER BY a.z)),
top AS (SELECT cid, MIN(z) AS z_top, ARG_MIN(v0, z) AS v_top, MAX(CASE WHEN z = 10 THEN v0 END) AS ct_ref,
    MAX(CASE WHEN z = 10 THEN r0 END) AS rho_ref FROM pairs GROUP BY cid),
x26 AS (SELECT cid, MIN(z) AS zc FROM pairs WHERE v0 >= 26 AND v1 < 26 GROUP BY cid),
x20 AS (SELECT cid, MIN(z) AS zc FROM pairs WHERE v0 >= 20 AND v1 < 20 GROUP BY cid),
xm AS (SELECT p.cid, MIN(p.z) AS zc FROM pairs p JOIN top USING (cid) WHERE p.z >= 10 AND r1 - rho_ref >= 0.03e0 GROUP BY p.cid),
xi AS (SELECT p.cid, MIN(p.z) AS zc FROM pairs p JOIN top USING (cid) WHERE p.z >= 10 AND v1 <= ct_ref - 0.2e0 GROUP BY p.cid),
idx AS (SELECT t.cid,
    CASE WHEN v_top < 26 THEN CAST(z_top AS DOUBLE) ELSE a.z + (a.v0 - 26) / (a.v0 - a.v1) END AS d26,
    CASE WHEN v_top < 20 THEN CAST(z_top AS DOUBLE) ELSE b.z + (b.v0 - 20) / (b.v0 - b.v1) END AS z20,
    m.z + LEAST(1e0, GREATEST(0e0, (0.03e0 - (m.r0 - rho_ref)) / (m.r1 - m.r0))) AS mld,
    i.z + LEAST(1e0, GREATEST(0e0, (i.v0 - (ct_ref - 0.2e0)) / (i.v0 - i.v1))) AS ild
    FROM top t LEFT JOIN x26 ON x26.cid = t.cid LEFT JOIN pairs a ON a.cid = t.cid AND a.z = x26.zc
    LEFT JOIN x20 ON x20.cid = t.cid LEFT JOIN pairs b ON b.cid = t.cid AND b.z = x20.zc
    LEFT JOIN xm ON xm.cid = t.cid LEFT JOIN pairs m ON m.cid = t.cid AND m.z = xm.zc
    LEFT JOIN xi ON xi.cid = t.cid LEFT JOIN pairs i ON i.cid = t.cid AND i.z = xi.zc),
heat AS (SELECT x.cid, MAX(CASE WHEN x.d26 IS NOT NULL THEN 1 END) AS has,
    SUM(CASE WHEN p.z + 0.5e0 <= x.d26 THEN (r0 + r1) / 2 * 4178e0 * (GREATEST(v0 - 26, 0e0) + GREATEST(v1 - 26, 0e0)) / 2 END) * 1e-7 AS e
    FROM idx x JOIN pairs p ON p.cid = x.cid GROUP BY x.cid)"""
_INDEX_CTES = f"{_COLUMNS}, {_CT}, {_RHO}, {_PAIRS}"


@query("indices_profile", """SELECT idx.cid, ROUND(d26, 6) AS d26, ROUND(z20, 6) AS z20, ROUND(mld, 4) AS mld, ROUND(ild - 1.234e-9, 6) AS ild,
    ROUND(CASE WHEN ild > mld THEN ild - mld END, 4) AS blt, ROUND(CASE WHEN has = 1 THEN COALESCE(e, 0) END, 6) AS tchp
    FROM idx JOIN heat USING (cid)""", ("f_column",), _INDEX_CTES)
def indices_profile(t: Tables):
    out = V.column_indices(_with_density(t), _CID, "depth", "ct", "rho", unique=True)
    # Density differences of 0.03 out of 1025 leave the mixed layer with fewer sure digits.
    out = rounded(rounded(out, "d26", "z20", "tchp"), "mld", "blt", digits=4)
    return rounded(out, "ild", shift=1.234e-9)


@query("isotherm_depth", "SELECT cid, ROUND(d26, 6) AS d26, ROUND(z20, 6) AS z20 FROM idx", ("f_column",), _INDEX_CTES)
def isotherm_depth(t: Tables):
    return rounded(_fused(t, "d26", "z20"), "d26", "z20")


@query("mld", "SELECT cid, ROUND(mld, 4) AS mld FROM idx", ("f_column",), _INDEX_CTES)
def mld(t: Tables):
    return rounded(_fused(t, "mld"), "mld", digits=4)


@query("ild", "SELECT cid, ROUND(ild - 1.234e-9, 6) AS ild FROM idx", ("f_column",), _INDEX_CTES)
def ild(t: Tables):
    return rounded(_fused(t, "ild"), "ild", shift=1.234e-9)


@query("blt", """SELECT idx.cid, ROUND(CASE WHEN ild > mld AND s <= 0.15e0 THEN ild - mld END, 4) AS blt
    FROM idx JOIN (SELECT cid, AVG(sp / 230.0013e0) AS s FROM f_column GROUP BY cid) USING (cid)""", ("f_column",), _INDEX_CTES)
def blt(t: Tables):
    """Barrier layer gated by the column's mean salinity spread (a spread derived from salinity here)."""
    df = _with_density(t).withColumn("sigma", F.col("sp") / 230.0013)
    return V.column_indices(df, _CID, "depth", "ct", "rho", sigma_sp="sigma", unique=True).select("cid", r("blt", 4).alias("blt"))


@query("tchp", "SELECT cid, ROUND(CASE WHEN has = 1 THEN COALESCE(e, 0) END, 6) AS tchp FROM heat", ("f_column",), _INDEX_CTES)
def tchp(t: Tables):
    return rounded(_fused(t, "tchp"), "tchp")


@query("pchip", f"""SELECT cid, CAST(z AS DOUBLE) AS z, ROUND({SEG_VALUE} - 1.234e-9, 6) AS theta
    FROM g_seg JOIN (SELECT UNNEST(GENERATE_SERIES(0, 1000, 25)) AS z) q
    ON (z >= z0 OR (is_first AND complete)) AND (z < z1 OR (is_last AND z <= z1))""",
       ("f_gappy",), PCHIP("g", "f_gappy", ["cid"], "depth", "theta"))
def pchip(t: Tables):
    return rounded(V.pchip(t.f_gappy, _CID, "depth", "theta", step=25.0, unique=True), "theta", shift=1.234e-9)


@query("pchip_std_levels", "SELECT cid, depth, ROUND(v - 1.234e-9, 6) AS theta FROM std",
       ("f_gappy",), PCHIP("g", "f_gappy", ["cid"], "depth", "theta") + ", " + level_values("std", "g", K.STANDARD_DEPTHS))
def pchip_std_levels(t: Tables):
    return rounded(V.pchip_levels(t.f_gappy, _CID, "depth", "theta", unique=True), "theta", shift=1.234e-9)


@query("dedupe_levels", """SELECT cid, depth, q AS qty, ord FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY cid, depth ORDER BY ord) AS k FROM raw)
    WHERE k = 1""", (), """raw AS (SELECT l_partkey AS cid, CAST(l_linenumber AS DOUBLE) AS depth, l_quantity AS q,
    l_orderkey * 1000000 + l_suppkey * 100 + CAST(l_quantity AS BIGINT) AS ord FROM lineitem)""")
def dedupe_levels(t: Tables):
    raw = t.lineitem.select(
        F.col("l_partkey").alias("cid"), F.col("l_linenumber").cast("double").alias("depth"),
        F.col("l_quantity").alias("qty"),
        (F.col("l_orderkey") * 1000000 + F.col("l_suppkey") * 100 + F.col("l_quantity").cast("bigint")).alias("ord"))
    return V.dedupe_levels(raw, _CID, "depth", ["qty", "ord"], order="ord")


_STEP = """steps AS (SELECT cid, depth AS z1, theta AS t1, LEAD(depth) OVER w AS z2, LEAD(theta) OVER w AS t2,
    FIRST_VALUE(theta) OVER w AS t0 FROM f_column WINDOW w AS (PARTITION BY cid ORDER BY depth))"""


@query("vertical_diff", """SELECT cid, (z1 + z2) / 2 AS z_mid, ROUND(t2 - t1 - 1.234e-9, 6) AS diff, ROUND((t2 - t1) / (z2 - z1) - 1.234e-9, 6) AS grad,
    t2 - t1 > 0.05e0 AS inversion FROM steps WHERE z2 IS NOT NULL""", ("f_column",), _STEP)
def vertical_diff(t: Tables):
    return rounded(V.vertical_diff(t.f_column, _CID, "depth", "theta"), "diff", "grad", shift=1.234e-9)


@query("thermocline_core", """SELECT cid, z_mid, ROUND(g, 6) AS grad FROM (SELECT cid, (z1 + z2) / 2 AS z_mid, (t2 - t1) / (z2 - z1) AS g,
    ROW_NUMBER() OVER (PARTITION BY cid ORDER BY (t2 - t1) / (z2 - z1), z1) AS k FROM steps WHERE z2 IS NOT NULL) WHERE k = 1""",
       ("f_column",), _STEP)
def thermocline_core(t: Tables):
    return rounded(V.thermocline_core(t.f_column, _CID, "depth", "theta"), "grad")


@query("arg_extreme", """SELECT cid, ARG_MIN(depth, ABS(theta - 28e0) * 1e6 + depth * 1e-3) AS depth FROM f_column GROUP BY cid""", ("f_column",))
def arg_extreme(t: Tables):
    """Level whose temperature is nearest to 28 degrees, the shallower one on a tie."""
    return V.level_nearest_to(t.f_column, _CID, "depth", "theta", 28.0)


@query("simple_density", f"""SELECT cid, depth, ROUND(sp * (35.16504e0 / 35e0), 6) AS sa, ROUND({RHO_SQL}, 6) AS rho FROM f_column""", ("f_column",))
def simple_density(t: Tables):
    theta, sp = F.col("theta"), F.col("sp")
    return t.f_column.select("cid", "depth", r(P.absolute_salinity(sp)).alias("sa"), r(P.simple_density(theta, sp)).alias("rho"))


SIGMA_SQL = """(999.842594e0 + 6.793952e-2 * theta - 9.09529e-3 * POW(theta, 2) + 1.001685e-4 * POW(theta, 3)
    - 1.120083e-6 * POW(theta, 4) + 6.536332e-9 * POW(theta, 5)
    + sp * (0.824493e0 - 4.0899e-3 * theta + 7.6438e-5 * POW(theta, 2) - 8.2467e-7 * POW(theta, 3) + 5.3875e-9 * POW(theta, 4))
    + POW(sp, 1.5e0) * (-5.72466e-3 + 1.0227e-4 * theta - 1.6546e-6 * POW(theta, 2)) + 4.8314e-4 * sp * sp - 1e3)"""


@query("sigma_theta", f"SELECT cid, depth, ROUND({SIGMA_SQL}, 6) AS sigma FROM f_column", ("f_column",))
def sigma_theta(t: Tables):
    return t.f_column.select("cid", "depth", r(P.sigma_theta(F.col("theta"), F.col("sp"))).alias("sigma"))


SERVING_SQL = """serving AS (SELECT s.cid, COALESCE(z20, 120e0) AS z20, COALESCE(mld, 40e0) AS mld, tchp FROM
    (SELECT cid, CASE WHEN COUNT(*) = COUNT(t1) THEN COALESCE(SUM((GREATEST(t1 - 26, 0e0) + GREATEST(t2 - 26, 0e0)) / 2 * (z2 - z1) * 0.428245e0), 0) END AS tchp FROM steps GROUP BY cid) s
    LEFT JOIN (SELECT cid, ARG_MAX(z1 + (2e1 - t1) / (t2 - t1 + 1e-6) * (z2 - z1), z1) AS z20 FROM steps WHERE t1 >= 20 AND t2 < 20 GROUP BY cid) a ON a.cid = s.cid
    LEFT JOIN (SELECT cid, ARG_MAX(z1 + (t0 - 0.2e0 - t1) / (t2 - t1 + 1e-6) * (z2 - z1), z1) AS mld FROM steps WHERE t1 >= t0 - 0.2e0 AND t2 < t0 - 0.2e0 GROUP BY cid) b ON b.cid = s.cid)"""


@query("serving_z20_mld_tchp", """SELECT cid, ROUND(z20, 6) AS z20, ROUND(mld, 6) AS mld, ROUND(tchp - 1e-9, 6) AS tchp,
    ROUND(GREATEST(mld - 10, 0), 6) AS blt FROM serving""", ("f_column",), f"{_STEP}, {SERVING_SQL}")
def serving(t: Tables):
    out = V.serving_indices(t.f_column, _CID, "depth", "theta")
    return rounded(rounded(out, "z20", "mld", "blt"), "tchp", shift=1e-9)


@query("serving_gappy", """SELECT cid, ROUND(z20, 6) AS z20, ROUND(mld, 6) AS mld, ROUND(tchp - 1e-9, 6) AS tchp,
    CASE WHEN tchp IS NULL THEN 'UNKNOWN' WHEN tchp > 80 THEN 'EXTREME' WHEN tchp >= 50 THEN 'MODERATE' ELSE 'DEPLETED' END AS label FROM serving""",
       ("f_gappy",), f"{_STEP.replace('f_column', 'f_gappy')}, {SERVING_SQL}")
def serving_gappy(t: Tables):
    """Columns with missing levels: no heat content, class unknown, defaults for the depths."""
    out = V.serving_indices(t.f_gappy, _CID, "depth", "theta").withColumn("label", P.classify_heat(F.col("tchp")))
    return rounded(rounded(out.select("cid", "z20", "mld", "tchp", "label"), "z20", "mld"), "tchp", shift=1e-9)


@query("indices_inverted", """SELECT idx.cid, ROUND(d26, 6) AS d26, ROUND(z20, 6) AS z20, ROUND(mld, 4) AS mld, ROUND(ild - 1.234e-9, 6) AS ild,
    ROUND(CASE WHEN ild > mld THEN ild - mld END, 4) AS blt, ROUND(CASE WHEN has = 1 THEN COALESCE(e, 0) END, 6) AS tchp
    FROM idx JOIN heat USING (cid)""", ("f_inverted",), _INDEX_CTES.replace("f_column", "f_inverted"))
def indices_inverted(t: Tables):
    """Columns that warm again below: around 26 and 20 degrees and below the reference level."""
    theta, sp = F.col("theta"), F.col("sp")
    df = t.f_inverted.withColumn("ct", theta).withColumn("rho", P.simple_density(theta, sp))
    out = V.column_indices(df, _CID, "depth", "ct", "rho", unique=True)
    out = rounded(rounded(out, "d26", "z20", "tchp"), "mld", "blt", digits=4)
    return rounded(out, "ild", shift=1.234e-9)


def _serving_surface(t: Tables):
    """Serving indices with surface temperature, a sea-level anomaly and a land flag per column."""
    surface = t.f_column.groupBy("cid").agg(
        F.min_by("theta", "depth").alias("sst"), (F.avg("sp") - 34.700003).alias("sla"))
    return V.serving_indices(t.f_column, _CID, "depth", "theta").join(surface, "cid").withColumn("land", F.col("cid") % 9 == 0)


_SURFACE_SQL = """surf AS (SELECT cid, ARG_MIN(theta, depth) AS sst, AVG(sp) - 34.700003e0 AS sla FROM f_column GROUP BY cid)"""


@query("cip", """SELECT cid, ROUND(CASE WHEN cid % 9 <> 0 THEN ((CASE WHEN sst >= 28 THEN 1 ELSE 0 END) + (CASE WHEN tchp >= 60 THEN 1 ELSE 0 END)
    + (CASE WHEN sla >= 0.05e0 THEN 1 ELSE 0 END)) / 3e0 END, 6) AS cip FROM serving JOIN surf USING (cid)""",
       ("f_column",), f"{_STEP}, {SERVING_SQL}, {_SURFACE_SQL}")
def cip(t: Tables):
    return _serving_surface(t).select("cid", r(P.intensification_score(
        F.col("sst"), F.col("tchp"), F.col("sla"), F.col("land"))).alias("cip"))


@query("classify_heat", """SELECT CASE WHEN tchp IS NULL THEN 'UNKNOWN' WHEN tchp > 80 THEN 'EXTREME' WHEN tchp >= 50 THEN 'MODERATE' ELSE 'DEPLETED' END AS label,
    COUNT(*) AS n FROM (SELECT CASE WHEN cid % 5 = 0 THEN NULL ELSE tchp * (0.3e0 + (cid % 7) / 1e1) END AS tchp FROM serving) GROUP BY 1""",
       ("f_column",), f"{_STEP}, {SERVING_SQL}")
def classify_heat(t: Tables):
    s = V.serving_indices(t.f_column, _CID, "depth", "theta")
    scaled = F.when(F.col("cid") % 5 != 0, F.col("tchp") * (F.lit(0.3) + (F.col("cid") % 7) / 10.0))
    return s.groupBy(P.classify_heat(scaled).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("heat_texts", """SELECT cid, label, CASE label WHEN 'UNKNOWN' THEN 'NO SOUNDING' WHEN 'EXTREME' THEN 'CRITICAL FUEL' WHEN 'MODERATE' THEN 'MODERATE FUEL' ELSE 'COLD WAKE' END AS shown,
    CASE label WHEN 'UNKNOWN' THEN 'TCHP was not reported; intensification fuel cannot be classified.' WHEN 'EXTREME' THEN 'TCHP exceeds 80 kJ/cm² — extreme cyclone intensification fuel.'
    WHEN 'MODERATE' THEN 'TCHP is between 50 and 80 kJ/cm² — moderate intensification potential.' ELSE 'TCHP is below 50 kJ/cm² — depleted heat / cold-wake regime.' END AS rule
    FROM (SELECT cid, CASE WHEN tchp IS NULL THEN 'UNKNOWN' WHEN tchp > 80 THEN 'EXTREME' WHEN tchp >= 50 THEN 'MODERATE' ELSE 'DEPLETED' END AS label
    FROM (SELECT cid, CASE WHEN cid % 5 = 0 THEN NULL ELSE tchp * (0.3e0 + (cid % 7) / 1e1) END AS tchp FROM serving))""", ("f_column",), f"{_STEP}, {SERVING_SQL}")
def heat_texts(t: Tables):
    """Every column's heat class with its label on display and its rule text."""
    s = V.serving_indices(t.f_column, _CID, "depth", "theta")
    scaled = F.when(F.col("cid") % 5 != 0, F.col("tchp") * (F.lit(0.3) + (F.col("cid") % 7) / 10.0))
    out = s.select("cid", P.classify_heat(scaled).alias("label"))
    return out.select("cid", "label", P.heat_text(F.col("label"), K.HEAT_LABELS).alias("shown"), P.heat_text(F.col("label"), K.HEAT_RULES).alias("rule"))


@query("classify_mld", """SELECT CASE WHEN mld < 30 THEN 'SHALLOW MLD' WHEN mld > 60 THEN 'DEEP MLD' ELSE 'MLD ' || CAST(CAST(ROUND(mld) AS INT) AS VARCHAR) || ' m' END AS label,
    COUNT(*) AS n FROM serving GROUP BY 1""", ("f_column",), f"{_STEP}, {SERVING_SQL}")
def classify_mld(t: Tables):
    s = V.serving_indices(t.f_column, _CID, "depth", "theta")
    return s.groupBy(P.classify_mld(F.col("mld")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("freshwater_flag", """SELECT cid, sss < 34.5e0 - 1.3e0 AS fresh, GREATEST(mld - 10, 0) > 1 AS barrier,
    ROUND(LEAST(1e3, GREATEST(z20, mld + 80, 2e2)), 6) AS base FROM serving
    JOIN (SELECT cid, ARG_MIN(sp, depth) - 1.3e0 AS sss FROM f_column GROUP BY cid) USING (cid)""", ("f_column",), f"{_STEP}, {SERVING_SQL}")
def freshwater_flag(t: Tables):
    s = V.serving_indices(t.f_column, _CID, "depth", "theta")
    sss = t.f_column.groupBy("cid").agg((F.min_by("sp", "depth") - 1.3).alias("sss"))
    return s.join(sss, "cid").select(
        "cid", P.freshwater_flag(F.col("sss")).alias("fresh"), P.barrier_shown(F.col("blt")).alias("barrier"),
        r(P.thermocline_base(F.col("z20"), F.col("mld"))).alias("base"))


_ILD_SURFACE_SQL = """ilds AS (SELECT cid, COALESCE(MIN(CASE WHEN t2 <= t0 - 0.5e0 THEN CASE WHEN t1 - t2 <= 0 THEN z2
    ELSE z1 + (z2 - z1) * LEAST(1e0, GREATEST(0e0, (t1 - (t0 - 0.5e0)) / (t1 - t2))) END END), MAX(z1)) AS ild FROM steps GROUP BY cid)"""


@query("ild_surface", "SELECT cid, ROUND(ild, 6) AS ild FROM ilds", ("f_column",), f"{_STEP}, {_ILD_SURFACE_SQL}")
def ild_surface(t: Tables):
    return rounded(V.isothermal_layer_from_surface(t.f_column, _CID, "depth", "theta"), "ild")


# Nodes of each layer: its two edges and the levels strictly inside, with clamped linear values.
_LAYER_SQL = """layers(layer, a, b) AS (VALUES ('0-50', 0e0, 5e1), ('50-100', 5e1, 1e2), ('100-200', 1e2, 2e2), ('200-500', 2e2, 5e2)),
ends AS (SELECT cid, MIN(depth) AS zt, MAX(depth) AS zb, ARG_MIN(theta, depth) AS tt, ARG_MAX(theta, depth) AS tb FROM f_column GROUP BY cid),
edges AS (SELECT e.cid, q.z, CASE WHEN q.z <= zt THEN tt WHEN q.z >= zb THEN tb ELSE
    (SELECT s.t1 + (q.z - s.z1) / (s.z2 - s.z1) * (s.t2 - s.t1) FROM steps s WHERE s.cid = e.cid AND q.z >= s.z1 AND q.z < s.z2) END AS t
    FROM ends e, (SELECT UNNEST([0e0, 5e1, 1e2, 2e2, 5e2]) AS z) q),
nodes AS (SELECT cid, layer, z, t FROM edges, layers WHERE z = a OR z = b
    UNION ALL SELECT cid, layer, depth, theta FROM f_column, layers WHERE depth > a AND depth < b),
layered AS (SELECT cid, layer, SUM(0.5e0 * (GREATEST(t - 26, 0e0) + GREATEST(tn - 26, 0e0)) * (zn - z)) * 1025e0 * 3985e0 / 1e7 AS kj
    FROM (SELECT *, LEAD(z) OVER w AS zn, LEAD(t) OVER w AS tn FROM nodes WINDOW w AS (PARTITION BY cid, layer ORDER BY z)) GROUP BY cid, layer)"""


@query("layer_heat", "SELECT cid, layer, ROUND(kj - 1e-9, 6) AS kj FROM layered", ("f_column",), f"{_STEP}, {_LAYER_SQL}")
def layer_heat(t: Tables):
    return rounded(V.layer_heat(t.f_column, _CID, "depth", "theta"), "kj", shift=1e-9)


@query("linear_interp", """SELECT e.cid, q.z, ROUND(CASE WHEN q.z <= zt THEN tt WHEN q.z >= zb THEN tb ELSE
    (SELECT s.t1 + (q.z - s.z1) / (s.z2 - s.z1) * (s.t2 - s.t1) FROM steps s WHERE s.cid = e.cid AND q.z >= s.z1 AND q.z < s.z2) END, 6) AS theta
    FROM ends e, (SELECT UNNEST([0e0, 5e0, 4e1, 9e1, 3.5e2, 1e3, 1.2e3]) AS z) q""", ("f_column",),
       f"""{_STEP}, ends AS (SELECT cid, MIN(depth) AS zt, MAX(depth) AS zb, ARG_MIN(theta, depth) AS tt, ARG_MAX(theta, depth) AS tb FROM f_column GROUP BY cid)""")
def linear_interp(t: Tables):
    out = V.linear_interp(t.f_column, _CID, "depth", ["theta"], [0.0, 5.0, 40.0, 90.0, 350.0, 1000.0, 1200.0])
    return rounded(out, "theta")


@query("sounding_summary", f"""SELECT c.cid, ROUND(ild, 6) AS ild, core_z, ROUND(core_g, 6) AS core_grad, n_sigma, ROUND(sigma_top, 6) AS sigma_top,
    ROUND(GREATEST(ild - mld, 0), 6) AS blt, ROUND(k1 - 1e-9, 6) AS kj_0_50, ROUND(k2 - 1e-9, 6) AS kj_50_100, ROUND(k3 - 1e-9, 6) AS kj_100_200, ROUND(k4 - 1e-9, 6) AS kj_200_500
    FROM ilds c JOIN serving USING (cid)
    LEFT JOIN (SELECT cid, (z1 + z2) / 2 AS core_z, (t2 - t1) / (z2 - z1) AS core_g, ROW_NUMBER() OVER (PARTITION BY cid ORDER BY (t2 - t1) / (z2 - z1), z1) AS k
        FROM steps WHERE z2 IS NOT NULL) g ON g.cid = c.cid AND g.k = 1
    JOIN (SELECT cid, COUNT(*) AS n_sigma, ARG_MIN({SIGMA_SQL}, depth) AS sigma_top FROM f_column GROUP BY cid) s ON s.cid = c.cid
    JOIN (SELECT cid, MAX(CASE WHEN layer = '0-50' THEN kj END) AS k1, MAX(CASE WHEN layer = '50-100' THEN kj END) AS k2,
        MAX(CASE WHEN layer = '100-200' THEN kj END) AS k3, MAX(CASE WHEN layer = '200-500' THEN kj END) AS k4 FROM layered GROUP BY cid) l ON l.cid = c.cid""",
       ("f_column",), f"{_STEP}, {SERVING_SQL}, {_ILD_SURFACE_SQL}, {_LAYER_SQL}")
def sounding_summary(t: Tables):
    serving_mld = V.serving_indices(t.f_column, _CID, "depth", "theta").select("cid", "mld")
    out = V.sounding_summary(t.f_column.join(serving_mld, "cid"), _CID, "depth", "theta", "sp", mld="mld")
    kj = ["kj_0_50", "kj_50_100", "kj_100_200", "kj_200_500"]
    return rounded(rounded(out.select(
        "cid", "ild", "core_z", "core_grad", F.size("sigma").cast("bigint").alias("n_sigma"), F.get("sigma", F.lit(0)).alias("sigma_top"), "blt", *kj),
        "ild", "core_grad", "sigma_top", "blt"), *kj, shift=1e-9)


@query("uncertainty_band", """SELECT member, cid, k, ROUND(pred - sigma, 6) AS lo_1, ROUND(pred + sigma, 6) AS hi_1, ROUND(pred - 2 * sigma, 6) AS lo_2,
    ROUND(pred + 2 * sigma, 6) AS hi_2 FROM f_ensemble""", ("f_ensemble",))
def uncertainty_band(t: Tables):
    out = V.uncertainty_band(t.f_ensemble, "pred", "sigma")
    return rounded(out.select("member", "cid", "k", "lo_1", "hi_1", "lo_2", "hi_2"), "lo_1", "hi_1", "lo_2", "hi_2")


@query("sort_axes", """SELECT cid, STRING_AGG(CAST(CAST(depth AS INT) AS VARCHAR), ',' ORDER BY depth) AS axis, COUNT(*) AS n FROM f_column GROUP BY cid""", ("f_column",))
def sort_axes(t: Tables):
    """Ascending level list of every column."""
    shown = F.transform("axis", lambda z: z.cast("int").cast("string"))
    return V.level_axis(t.f_column, _CID, "depth").select("cid", F.concat_ws(",", shown).alias("axis"), F.size("axis").cast("long").alias("n"))
