"""Neighbourhood and remapping queries: monthly wind fields on a 10 x 10 grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridsonde.grid_spec import GridSpec
from gridsonde.operators import regrid as R
from gridsonde.operators import spatial as S
from gridsonde.plans.registry import Tables, query, r, rounded

CELLS = GridSpec(5.125, 45.125, 0.25, 10, 10)
WIND = GridSpec(5.125, 45.125, 0.5, 10, 10)  # half-degree cells, so that both sides of 8 degrees occur
COARSE = GridSpec(5.3, 45.2, 0.6, 4, 5)

_R = "6371e3"
_SPINE = """frames AS (SELECT DISTINCT ym FROM f_wind), cells AS (SELECT * FROM f_mask),
m2 AS (SELECT a.iy, a.ix, a.land, (SELECT BOOL_OR(b.land) FROM f_mask b WHERE ABS(a.iy - b.iy) <= 1 AND ABS(a.ix - b.ix) <= 1) AS invalid FROM f_mask a),
full_wind AS (SELECT f.ym, c.iy, c.ix, c.land, c.invalid, 5.125e0 + 0.5e0 * c.iy AS lat, w.u10, w.v10 FROM frames f CROSS JOIN m2 c LEFT JOIN f_wind w ON w.ym = f.ym AND w.iy = c.iy AND w.ix = c.ix),
tau AS (SELECT *, CASE WHEN NOT land THEN 1.225e0 * 1.3e-3 * SQRT(u10 * u10 + v10 * v10) * u10 END AS tx,
    CASE WHEN NOT land THEN 1.225e0 * 1.3e-3 * SQRT(u10 * u10 + v10 * v10) * v10 END AS ty,
    GREATEST(ABS(2 * 7.292115e-5 * SIN(RADIANS(lat))), 1.5e-5) * 1025e0 AS rf FROM full_wind),
field AS (SELECT ym, iy, ix, land, invalid, lat, tx, ty, ty / rf AS ux, -tx / rf AS uy, rf, 6371e3 * RADIANS(0.5e0) AS dy,
    6371e3 * COS(RADIANS(lat)) * RADIANS(0.5e0) AS dx FROM tau)"""


def _deriv(out: str, src: str, col: str, axis: str) -> str:
    """CTE with the masked derivative of one column by two shifted self joins."""
    d = "dx" if axis == "x" else "dy"
    move = ("a.iy = {n}.iy AND a.ix {s} 1 = {n}.ix" if axis == "x" else "a.ix = {n}.ix AND a.iy {s} 1 = {n}.iy")
    p, n = move.format(n="p", s="-"), move.format(n="n", s="+")
    return f"""{out} AS (SELECT a.ym, a.iy, a.ix, CASE WHEN a.invalid OR a.{col} IS NULL THEN NULL
    WHEN p.{col} IS NOT NULL AND n.{col} IS NOT NULL THEN (n.{col} - p.{col}) / (n.{d} + p.{d})
    WHEN n.{col} IS NOT NULL THEN (n.{col} - a.{col}) / a.{d} WHEN p.{col} IS NOT NULL THEN (a.{col} - p.{col}) / a.{d} END AS v
    FROM {src} a LEFT JOIN {src} p ON a.ym = p.ym AND {p} AND NOT p.invalid LEFT JOIN {src} n ON a.ym = n.ym AND {n} AND NOT n.invalid)"""


def _median(out: str, src: str) -> str:
    """CTE with the 3x3 median, edges replicated, by nine clamped offsets."""
    return f"""{out} AS (SELECT a.ym, a.iy, a.ix, MEDIAN(b.v) AS v FROM {src} a, (SELECT UNNEST([-1, 0, 1]) AS dy) oy, (SELECT UNNEST([-1, 0, 1]) AS dx) ox, {src} b
    WHERE b.ym = a.ym AND b.iy = GREATEST(0, LEAST(9, a.iy + dy)) AND b.ix = GREATEST(0, LEAST(9, a.ix + dx)) GROUP BY a.ym, a.iy, a.ix)"""


_CURL = ", ".join([
    _SPINE, _deriv("dtydx", "field", "ty", "x"), _deriv("dtxdy", "field", "tx", "y"),
    "rawcurl AS (SELECT ym, iy, ix, a.v - b.v AS v FROM dtydx a JOIN dtxdy b USING (ym, iy, ix))", _median("curl", "rawcurl"),
])
_EKMAN = ", ".join([
    _CURL, _deriv("duxdx", "field", "ux", "x"), _deriv("duydy", "field", "uy", "y"),
    "rawdiv AS (SELECT ym, iy, ix, a.v + b.v AS v FROM duxdx a JOIN duydy b USING (ym, iy, ix))", _median("div", "rawdiv"),
    "feat AS (SELECT f.*, c.v AS curl, CASE WHEN f.lat < 8 THEN d.v ELSE c.v / f.rf END AS w_e FROM field f JOIN curl c USING (ym, iy, ix) JOIN div d USING (ym, iy, ix))",
])


@query("dilate_mask", """SELECT a.iy, a.ix, a.land, (SELECT BOOL_OR(b.land) FROM f_mask b WHERE ABS(a.iy - b.iy) <= 1 AND ABS(a.ix - b.ix) <= 1) AS by_1,
    (SELECT BOOL_OR(b.land) FROM f_mask b WHERE ABS(a.iy - b.iy) <= 2 AND ABS(a.ix - b.ix) <= 2) AS by_2, a.land AS by_0 FROM f_mask a""", ("f_mask",))
def dilate_mask(t: Tables):
    m = S.dilate_mask(t.f_mask.select("iy", "ix", "land"), "land", 1, out="by_1")
    return S.dilate_mask(S.dilate_mask(m, "land", 2, out="by_2"), "land", 0, out="by_0")


@query("median3x3", "SELECT ym, iy, ix, ROUND(v, 6) AS u10 FROM med", ("f_wind", "f_mask"),
       f"{_SPINE}, src AS (SELECT ym, iy, ix, u10 AS v FROM full_wind), {_median('med', 'src')}")
def median3x3(t: Tables):
    return rounded(S.median3x3(t.f_wind.select("ym", "iy", "ix", "u10"), ["ym"], ["u10"], WIND), "u10")


@query("masked_derivative", "SELECT a.ym, a.iy, a.ix, ROUND(a.v * 1e6, 6) AS dx_1e6, ROUND(b.v * 1e6, 6) AS dy_1e6 FROM dtydx a JOIN dtxdy b USING (ym, iy, ix) JOIN f_wind USING (ym, iy, ix)",
       ("f_wind", "f_mask"), ", ".join([_SPINE, _deriv("dtydx", "field", "ty", "x"), _deriv("dtxdy", "field", "tx", "y")]))
def masked_derivative(t: Tables):
    """Both derivatives on a grid with absent cells; the neighbour test is by index, not position."""
    from gridsonde.functions.physics import wind_stress_x, wind_stress_y
    mask = S.dilate_mask(t.f_mask.select("iy", "ix", "land"), "land", 1, out="invalid")
    u, v = F.col("u10"), F.col("v10")
    df = t.f_wind.join(mask, ["iy", "ix"]).select(
        "ym", "iy", "ix", (~F.col("invalid")).alias("ok"), WIND.dx().alias("dx"), WIND.dy().alias("dy"),
        F.when(~F.col("land"), wind_stress_x(u, v)).alias("tx"), F.when(~F.col("land"), wind_stress_y(u, v)).alias("ty"))
    x = S.masked_derivative(df, ["ym"], "ty", "dx", "ok", "x", out="gx")
    both = S.masked_derivative(x, ["ym"], "tx", "dy", "ok", "y", out="gy")
    return both.select("ym", "iy", "ix", r(F.col("gx") * 1e6).alias("dx_1e6"), r(F.col("gy") * 1e6).alias("dy_1e6"))


def _features(t: Tables):
    return S.wind_features(t.f_wind, t.f_mask, ["ym"], WIND)


@query("wind_stress_curl", "SELECT ym, iy, ix, ROUND(CASE WHEN NOT land THEN v * 1e6 END, 6) AS curl_1e6 FROM field JOIN curl USING (ym, iy, ix)", ("f_wind", "f_mask"), _CURL)
def wind_stress_curl(t: Tables):
    return _features(t).select("ym", "iy", "ix", r(F.col("curl") * 1e6).alias("curl_1e6"))


@query("curl_stats", """SELECT ym, COUNT(CASE WHEN land THEN 1 END) AS n_land, COUNT(CASE WHEN invalid AND NOT land THEN 1 END) AS n_buffer,
    COUNT(CASE WHEN NOT land THEN v END) AS n_curl FROM field JOIN curl USING (ym, iy, ix) GROUP BY ym""", ("f_wind", "f_mask"), _CURL)
def curl_stats(t: Tables):
    return S.curl_stats(_features(t), ["ym"])


@query("ekman_pumping", "SELECT ym, iy, ix, ROUND(CASE WHEN NOT land THEN w_e * 1e6 END, 6) AS w_e_1e6 FROM feat", ("f_wind", "f_mask"), _EKMAN)
def ekman_pumping(t: Tables):
    return _features(t).select("ym", "iy", "ix", r(F.col("w_e") * 1e6).alias("w_e_1e6"))


@query("physics_features", """SELECT ym, iy, ix, ROUND(2e6 * 7.292115e-5 * SIN(RADIANS(lat)), 6) AS f_1e6, ROUND(rf / 1025e0 * 1e6, 6) AS f_tilde_1e6, ROUND(tx, 6) AS tau_x, ROUND(ty, 6) AS tau_y,
    ROUND(CASE WHEN NOT land THEN curl * 1e6 END, 6) AS curl_1e6, ROUND(CASE WHEN NOT land THEN w_e * 1e6 END, 6) AS w_e_1e6 FROM feat""", ("f_wind", "f_mask"), _EKMAN)
def physics_features(t: Tables):
    out = S.physics_features(t.f_wind, t.f_mask, ["ym"], WIND)
    return out.select("ym", "iy", "ix", r(F.col("f") * 1e6).alias("f_1e6"), r(F.col("f_tilde") * 1e6).alias("f_tilde_1e6"),
                      r("tau_x").alias("tau_x"), r("tau_y").alias("tau_y"), r(F.col("curl") * 1e6).alias("curl_1e6"),
                      r(F.col("w_e") * 1e6).alias("w_e_1e6"))


_REGRID = """src AS (SELECT CAST(day AS VARCHAR) AS day, depth, iy, ix, CASE WHEN (iy * 3 + ix) % 5 = 0 THEN NULL ELSE theta END AS theta, sp FROM f_obs),
wy AS (SELECT iy, jy, SIN(RADIANS(LEAST(5.25e0 + 0.25e0 * iy, 5.6e0 + 0.6e0 * jy))) - SIN(RADIANS(GREATEST(5e0 + 0.25e0 * iy, 5e0 + 0.6e0 * jy))) AS w
    FROM (SELECT UNNEST(GENERATE_SERIES(0, 9)) AS iy), (SELECT UNNEST(GENERATE_SERIES(0, 3)) AS jy) WHERE LEAST(5.25e0 + 0.25e0 * iy, 5.6e0 + 0.6e0 * jy) - GREATEST(5e0 + 0.25e0 * iy, 5e0 + 0.6e0 * jy) > 1e-9),
wx AS (SELECT ix, jx, RADIANS(LEAST(45.25e0 + 0.25e0 * ix, 45.5e0 + 0.6e0 * jx) - GREATEST(45e0 + 0.25e0 * ix, 44.9e0 + 0.6e0 * jx)) AS w
    FROM (SELECT UNNEST(GENERATE_SERIES(0, 9)) AS ix), (SELECT UNNEST(GENERATE_SERIES(0, 4)) AS jx) WHERE LEAST(45.25e0 + 0.25e0 * ix, 45.5e0 + 0.6e0 * jx) - GREATEST(45e0 + 0.25e0 * ix, 44.9e0 + 0.6e0 * jx) > 1e-9)"""


_REGRID_SQL = """SELECT day, depth, CAST(jy AS INT) AS iy, CAST(jx AS INT) AS ix, ROUND(SUM(CASE WHEN theta IS NOT NULL THEN wy.w * wx.w * theta END) / SUM(CASE WHEN theta IS NOT NULL THEN wy.w * wx.w END) - 1.234e-9, 5) AS theta,
    ROUND(SUM(wy.w * wx.w * sp) / SUM(wy.w * wx.w) - 1.234e-9, 5) AS sp FROM src JOIN wy USING (iy) JOIN wx USING (ix) GROUP BY 1, 2, 3, 4"""


def _field(t: Tables):
    """Two variables of the daily cube, one with missing values."""
    holes = F.when((F.col("iy") * 3 + F.col("ix")) % 5 != 0, F.col("theta"))
    return t.f_obs.select(F.col("day").cast("string").alias("day"), "depth", "iy", "ix", holes.alias("theta"), "sp")


@query("conservative_regrid", _REGRID_SQL, ("f_obs",), _REGRID)
def conservative_regrid(t: Tables):
    """Onto coarser shifted cells, the source axes given as tables."""
    lat_axis = R.axis_of(t.f_obs.withColumn("lat", CELLS.lat()), "iy", "lat")
    lon_axis = R.axis_of(t.f_obs.withColumn("lon", CELLS.lon()), "ix", "lon")
    out = R.conservative_regrid(_field(t), lat_axis, lon_axis, COARSE, ["theta", "sp"], keys=["day", "depth"])
    return rounded(out, "theta", "sp", digits=5, shift=1.234e-9)


@query("regrid_regular", _REGRID_SQL, ("f_obs",), _REGRID)
def regrid_regular(t: Tables):
    """The same remap between regular grids in closed form."""
    out = R.regrid_regular(_field(t), CELLS, COARSE, ["theta", "sp"], keys=["day", "depth"])
    return rounded(out, "theta", "sp", digits=5, shift=1.234e-9)


@query("bilinear_regrid", """SELECT pid, a.depth, ROUND((1 - fy) * (1 - fx) * a.theta + (1 - fy) * fx * b.theta + fy * (1 - fx) * c.theta + fy * fx * d.theta, 6) AS theta FROM
    (SELECT pid, GREATEST(0, LEAST(8, CEIL(py) - 1)) AS y0, GREATEST(0, LEAST(8, CEIL(px) - 1)) AS x0, py - GREATEST(0, LEAST(8, CEIL(py) - 1)) AS fy, px - GREATEST(0, LEAST(8, CEIL(px) - 1)) AS fx FROM
    (SELECT c_custkey AS pid, (4.9e0 + 2.7e0 * ((c_custkey * 31) % 97) / 97e0 - 5.125e0) / 0.25e0 AS py, (45e0 + 2.6e0 * ((c_custkey * 17) % 89) / 89e0 - 45.125e0) / 0.25e0 AS px FROM customer)
    WHERE py BETWEEN 0 AND 9 AND px BETWEEN 0 AND 9) q
    JOIN f_profile a ON a.iy = y0 AND a.ix = x0 JOIN f_profile b ON b.iy = y0 AND b.ix = x0 + 1 AND b.depth = a.depth JOIN f_profile c ON c.iy = y0 + 1 AND c.ix = x0 AND c.depth = a.depth
    JOIN f_profile d ON d.iy = y0 + 1 AND d.ix = x0 + 1 AND d.depth = a.depth""", ("f_profile",))
def bilinear_regrid(t: Tables):
    """Columns interpolated linearly to scattered points, of which those outside the grid are dropped."""
    k = F.col("c_custkey")
    points = t.customer.select(k.alias("pid"), (4.9 + 2.7 * (k * 31 % 97) / 97.0).alias("lat"), (45.0 + 2.6 * (k * 17 % 89) / 89.0).alias("lon"))
    out = R.bilinear_regrid(t.f_profile.select("iy", "ix", "depth", "theta"), CELLS, points, ["theta"], ["depth"])
    return rounded(out, "theta")
