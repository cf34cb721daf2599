"""Neighbourhood and remapping operators against brute force on small random grids."""

import numpy as np
import pytest
from conftest import plan
from pyspark.sql import functions as F

from gridsonde.grid_spec import BASIN_GRID, GridSpec
from gridsonde.session import scratch_path
from gridsonde.operators import grid as G
from gridsonde.operators import regrid as R
from gridsonde.operators import spatial as S

NY, NX = 11, 13
SPEC = GridSpec(5.125, 45.125, 0.5, NY, NX)


def field(spark, arrays, **columns):
    rows = []
    for f, arr in enumerate(arrays):
        for iy in range(arr.shape[0]):
            for ix in range(arr.shape[1]):
                v = arr[iy, ix]
                rows.append((f, iy, ix, None if np.isnan(v) else float(v)))
    return spark.createDataFrame(rows, "f int, iy int, ix int, v double")


def to_array(df, column, n=2):
    out = np.full((n, NY, NX), np.nan)
    for r in df.collect():
        if r[column] is not None:
            out[r["f"], r["iy"], r["ix"]] = r[column]
    return out


@pytest.fixture(scope="module")
def noisy():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(2, NY, NX))
    a[rng.random(a.shape) < 0.25] = np.nan
    return a


def brute_median(a):
    p = np.pad(a, 1, mode="edge")
    out = np.full(a.shape, np.nan)
    for i in range(a.shape[0]):
        for j in range(a.shape[1]):
            w = p[i:i + 3, j:j + 3].ravel()
            w = w[np.isfinite(w)]
            if w.size:
                out[i, j] = np.median(w)
    return out


def brute_derivative(a, spacing, valid, axis):
    ok = valid & np.isfinite(a)
    out = np.full(a.shape, np.nan)
    n = a.shape[axis]
    for i in range(a.shape[0]):
        for j in range(a.shape[1]):
            if not ok[i, j]:
                continue
            k = (i, j)[axis]

            def at(d):
                t = (i + d, j) if axis == 0 else (i, j + d)
                return t if 0 <= k + d < n and ok[t] else None

            p, m = at(1), at(-1)
            if p and m:
                out[i, j] = (a[p] - a[m]) / (spacing[p] + spacing[m])
            elif p:
                out[i, j] = (a[p] - a[i, j]) / spacing[i, j]
            elif m:
                out[i, j] = (a[i, j] - a[m]) / spacing[i, j]
    return out


def brute_dilate(m, n):
    out = np.zeros_like(m)
    for i, j in zip(*np.nonzero(m)):
        out[max(0, i - n):i + n + 1, max(0, j - n):j + n + 1] = True
    return out


@pytest.mark.parametrize("tile", [3, 4, 64])
@pytest.mark.parametrize("drop", [False, True])
def test_median_matches_brute_force_for_any_tile(spark, noisy, tile, drop):
    df = field(spark, noisy)
    if drop:
        df = df.filter("v is not null")  # absent rows instead of NULL values
    got = to_array(S.median3x3(df, ["f"], ["v"], SPEC, tile=tile), "v")
    for f in range(2):
        np.testing.assert_allclose(got[f], brute_median(noisy[f]), equal_nan=True)


@pytest.mark.parametrize("axis,name", [(0, "y"), (1, "x")])
def test_derivative_matches_brute_force_on_gappy_rows(spark, noisy, axis, name):
    rng = np.random.default_rng(4)
    spacing, valid = rng.uniform(1, 2, (NY, NX)), rng.random((NY, NX)) > 0.2
    extra = spark.createDataFrame([(i, j, float(spacing[i, j]), bool(valid[i, j])) for i in range(NY) for j in range(NX)],
                                  "iy int, ix int, s double, ok boolean")
    df = field(spark, noisy).filter("v is not null").join(extra, ["iy", "ix"])
    got = to_array(S.masked_derivative(df, ["f"], "v", "s", "ok", name), "derivative")
    for f in range(2):
        np.testing.assert_allclose(got[f], brute_derivative(noisy[f], spacing, valid, axis), equal_nan=True)


@pytest.mark.parametrize("n,tile", [(0, 64), (1, 3), (2, 5), (2, 64), (3, 7)])
def test_dilation(spark, n, tile):
    m = np.random.default_rng(n).random((NY, NX)) < 0.08
    df = spark.createDataFrame([(0, i, j, bool(m[i, j])) for i in range(NY) for j in range(NX)], "f int, iy int, ix int, m boolean")
    got = S.dilate_mask(df, "m", n, ["f"], tile=tile)
    assert got.count() == NY * NX
    out = np.zeros((NY, NX), bool)
    for r in got.collect():
        out[r["iy"], r["ix"]] = r["buffered"]
    assert (out == brute_dilate(m, n)).all() and (out | m == out).all()


@pytest.mark.parametrize("tile", [5, 64])
def test_wind_features_match_brute_force(spark, tile):
    rng = np.random.default_rng(8)
    u, v = rng.normal(5, 1, (NY, NX)), rng.normal(2, 1, (NY, NX))
    land = rng.random((NY, NX)) < 0.1
    mask = spark.createDataFrame([(i, j, bool(land[i, j])) for i in range(NY) for j in range(NX)], "iy int, ix int, land boolean")
    winds = spark.createDataFrame([(0, i, j, float(u[i, j]), float(v[i, j])) for i in range(NY) for j in range(NX)],
                                  "f int, iy int, ix int, u10 double, v10 double")
    out = S.wind_features(winds, mask, ["f"], SPEC, tile=tile)
    lat = 5.125 + 0.5 * np.arange(NY)
    tx, ty = (1.225 * 1.3e-3 * np.hypot(u, v) * c for c in (u, v))
    tx, ty = np.where(land, np.nan, tx), np.where(land, np.nan, ty)
    ok = ~brute_dilate(land, 1)
    dx = np.repeat((6371000.0 * np.cos(np.radians(lat)) * np.radians(0.5))[:, None], NX, 1)
    dy = np.full((NY, NX), 6371000.0 * np.radians(0.5))
    rf = 1025.0 * np.maximum(np.abs(2 * 7.292115e-5 * np.sin(np.radians(lat))), 1.5e-5)[:, None]
    curl = brute_median(brute_derivative(ty, dx, ok, 1) - brute_derivative(tx, dy, ok, 0))
    div = brute_median(brute_derivative(ty / rf, dx, ok, 1) + brute_derivative(-tx / rf, dy, ok, 0))
    we = np.where(lat[:, None] < 8, div, curl / rf)
    np.testing.assert_allclose(to_array(out, "curl", 1)[0], np.where(land, np.nan, curl), rtol=1e-9, atol=1e-15, equal_nan=True)
    np.testing.assert_allclose(to_array(out, "w_e", 1)[0], np.where(land, np.nan, we), rtol=1e-9, atol=1e-18, equal_nan=True)


def test_composite_stencils_share_one_tile_shuffle(spark):
    path = scratch_path(spark, "winds")
    df = spark.range(8).selectExpr("cast(id as int) f", "0 iy", "0 ix", "1d u10", "1d v10")
    df.write.mode("overwrite").parquet(path)
    mask = spark.range(1).selectExpr("0 iy", "0 ix", "false land")
    text = plan(S.wind_features(spark.read.parquet(path), mask, ["f"], GridSpec(5.0, 45.0, 1.0, 4, 4), dense=True))
    tiles = [line for line in text.splitlines() if "Exchange hashpartitioning(f" in line and "__ty" in line]
    assert len(tiles) == 1


def test_regrid_keeps_constants_and_area_sums(spark):
    lat, lon = np.array([5.0, 5.4, 6.1, 6.5, 7.3]), np.array([45.0, 45.3, 45.9, 46.6])
    vals = np.random.default_rng(1).uniform(10, 20, (5, 4))
    rows = [(i, j, float(lat[i]), float(lon[j]), float(vals[i, j]), 7.5) for i in range(5) for j in range(4)]
    f = spark.createDataFrame(rows, "iy int, ix int, lat double, lon double, v double, c double")
    target = GridSpec(4.0, 44.0, 0.5, 10, 8)
    out = R.conservative_regrid(f, R.axis_of(f, "iy", "lat"), R.axis_of(f, "ix", "lon"), target, ["v", "c"]).collect()

    def bounds(c):
        mid = (c[:-1] + c[1:]) / 2
        return np.concatenate([[c[0] - (mid[0] - c[0])], mid, [c[-1] + (c[-1] - mid[-1])]])

    bl, bo = bounds(lat), bounds(lon)
    got = {(r["iy"], r["ix"]): r["v"] for r in out}
    for ty in range(10):
        for tx in range(8):
            num = den = 0.0
            for i in range(5):
                for j in range(4):
                    y0, y1 = max(bl[i], 3.75 + 0.5 * ty), min(bl[i + 1], 4.25 + 0.5 * ty)
                    x0, x1 = max(bo[j], 43.75 + 0.5 * tx), min(bo[j + 1], 44.25 + 0.5 * tx)
                    if y1 > y0 and x1 > x0:
                        w = (np.sin(np.radians(y1)) - np.sin(np.radians(y0))) * np.radians(x1 - x0)
                        num, den = num + w * vals[i, j], den + w
            if den > 1e-12:
                assert got[ty, tx] == pytest.approx(num / den)
            else:
                assert (ty, tx) not in got
    assert all(r["c"] == pytest.approx(7.5) for r in out)
    full = R.conservative_regrid(f, R.axis_of(f, "iy", "lat"), R.axis_of(f, "ix", "lon"), target, ["c"], keep_uncovered=True)
    assert full.count() == 80


@pytest.mark.parametrize("src,dst", [
    (GridSpec(0.125, 10.125, 0.25, 8, 12), GridSpec(0.5, 10.5, 1.0, 2, 3)),     # nested, coarser
    (GridSpec(0.0, 10.0, 1.0, 3, 3), GridSpec(-0.3, 9.7, 0.4, 9, 9)),           # finer, shifted
    (GridSpec(5.0, 10.0, 0.5, 4, 4), GridSpec(5.2, 10.3, 0.7, 5, 2)),           # partly outside
])
def test_regular_regrid_equals_the_axis_form(spark, src, dst):
    cells = G.build_grid(spark, src).withColumn("v", F.when((F.col("iy") + F.col("ix")) % 4 != 1, F.sin(F.col("iy") * 3.0 + F.col("ix"))))
    a = R.conservative_regrid(cells, R.axis_of(cells, "iy", "lat"), R.axis_of(cells, "ix", "lon"), dst, ["v"])
    b = R.regrid_regular(cells, src, dst, ["v"])
    got, want = ({(r["iy"], r["ix"]): r["v"] for r in x.collect()} for x in (b, a))
    assert got.keys() == want.keys() and len(got) > 0
    for k, v in want.items():
        assert got[k] == (None if v is None else pytest.approx(v, abs=1e-12))
    assert "Join" not in plan(b)


def test_bilinear_nodes_and_missing_corners(spark):
    src = GridSpec(0.0, 0.0, 1.0, 3, 3)
    f = spark.createDataFrame([(i, j, None if (i, j) == (2, 2) else float(10 * i + j)) for i in range(3) for j in range(3)], "iy int, ix int, v double")
    pts = spark.createDataFrame([(1, 0.5, 0.25), (2, 0.0, 0.0), (3, 1.0, 1.0), (4, 1.5, 1.5), (5, 2.5, 0.0)], "p int, lat double, lon double")
    got = {r["p"]: r["v"] for r in R.bilinear_regrid(f, src, pts, ["v"]).collect()}
    assert got == {1: pytest.approx(5.25), 2: 0.0, 3: pytest.approx(11.0), 4: None}
    assert R.nearest_source_levels([0.0, 10.0, 20.0], [5.0, 6.0, 25.0]) == {5.0: 0.0, 6.0: 10.0, 25.0: None}
    levels = spark.createDataFrame([(0.0, 1), (10.0, 2)], "depth double, v int")
    out = sorted((r["depth"], r["v"]) for r in R.select_levels(levels, "depth", [0.0, 10.0, 20.0], [0.0, 5.0, 6.0, 20.0]).collect())
    assert out == [(0.0, 1), (5.0, 1), (6.0, 2)]


def test_bilinear_points_meet_whole_stencils(spark):
    src = GridSpec(0.0, 0.0, 1.0, 4, 5)
    known = {(i, j, d): None if (i, j, d) == (1, 1, 10) else float(i * i + 3 * j + d) for i in range(4) for j in range(5) for d in (0, 10) if (i, j, d) != (3, 4, 0)}
    f = spark.createDataFrame([(*k, v) for k, v in known.items()] + [(None, 1, 0, 1.0), (-1, 0, 0, 1.0), (4, 5, 0, 1.0)], "iy int, ix int, d int, v double")
    pts = [(k, (k * 7 % 40) / 10.0 - 0.2, (k * 3 % 50) / 10.0 - 0.3) for k in range(60)] + [(60, 3.0, 4.0), (61, 0.0, 0.0), (62, 2.5, None)]
    out = R.bilinear_regrid(f, src, spark.createDataFrame(pts + [pts[1]], "p int, lat double, lon double"), ["v"], ["d"])
    want = {}
    for p, y, x in pts:
        if x is None or not (0 <= y <= 3 and 0 <= x <= 4):
            continue
        y0, x0 = (max(0, min(n - 2, int(np.ceil(c)) - 1)) for c, n in ((y, 4), (x, 5)))
        for d in (0, 10):
            v = [known.get((y0 + a, x0 + b, d)) for a in (0, 1) for b in (0, 1)]
            w = [(y - y0 if a else 1 - y + y0) * (x - x0 if b else 1 - x + x0) for a in (0, 1) for b in (0, 1)]
            want[p, d] = None if None in v or p == pts[1][0] else pytest.approx(sum(i * j for i, j in zip(v, w)))
    rows = out.collect()
    assert out.columns == ["p", "d", "v"] and len(rows) == len(want) and (pts[1][0], 0) in want
    assert {(r["p"], r["d"]): r["v"] for r in rows} == want
    text = plan(out)
    assert "Broadcast" not in text, "points are not held whole"
    assert "Aggregate" not in text[:text.index("SortMergeJoin")], "points times keys are not grouped"


def test_basin_grid(spark):
    g = G.build_grid(spark, BASIN_GRID)
    r = g.agg(F.count("*"), F.max("lat"), F.max("lon")).first()
    assert tuple(r) == (24000, 29.875, 104.875)
    from gridsonde.functions.physics import coriolis_floored
    assert g.select(F.min(F.abs(coriolis_floored(F.col("lat"))))).first()[0] >= 1.5e-5
    with pytest.raises(ValueError):
        GridSpec.tiling({"lat_max": 30.0, "lon_max": 105.0}, 0.25, 5.0, 45.125, 100, 240)
    half = 0.125
    area = g.select(F.sum(G.cell_area(F.col("lat") - half, F.col("lat") + half, F.col("lon") - half, F.col("lon") + half))).first()[0]
    assert area == pytest.approx(6371000.0**2 * (np.sin(np.radians(30)) - np.sin(np.radians(5))) * np.radians(60))


def test_axis_checks_and_export(spark):
    bad = spark.createDataFrame([(1, 1.0), (1, 1.0), (2, 1.0), (2, 2.0)], "a int, c double")
    assert [r["a"] for r in G.check_axis(bad, "c", ["a"]).collect()] == [1]
    df = spark.createDataFrame([(0, 0, 1.23456), (0, 1, None), (1, 0, 2.0), (1, 1, 0.0005)], "iy int, ix int, v double")
    spec = GridSpec(5.125, 45.125, 0.25, 2, 2)
    box = {"lat_min": 5, "lat_max": 6, "lon_min": 45, "lon_max": 46}
    rows = {r["iy"]: r for r in G.export_grid_rows(df, spec, "v", box).collect()}
    assert rows[0]["values"] == [1.235, None] and rows[1]["values"][1] == 0.0, "halves round to even"
    assert (rows[0]["west"], rows[0]["south"], rows[0]["east"], rows[0]["north"]) == (45.0, 5.0, 45.5, 5.5)
    with pytest.raises(ValueError):
        G.export_grid_rows(df, spec, "v", {"lat_min": 50, "lat_max": 60, "lon_min": 45, "lon_max": 46})


def test_land_from_known_days(spark):
    import datetime as dt

    from gridsonde.grid_spec import GridSpec
    from gridsonde.operators import spatial as SP
    spec, first = GridSpec(5.0, 45.0, 1.0, 5, 6), dt.date(1969, 12, 30)
    rows = [(first + dt.timedelta(days=d), y, x, None if x == 4 and d > 1 else 1.0) for d in range(4) for y in range(5) for x in range(6) if (y, x) != (2, 1)]
    df = spark.createDataFrame(rows + rows[:40] + [(None, 2, 1, 1.0)], "day date, iy int, ix int, v double")
    halves = SP.known_days(df.where("day < '1970-01-01'"), "v").unionByName(SP.known_days(df, "v"))
    for days in (SP.known_days(df, "v"), SP.merged_days(halves)):
        got = {(r["iy"], r["ix"]): (r["frac"], r["land"], r["coastal"]) for r in SP.land_on_grid(days, spec, F.lit(4), 1).collect()}
        assert len(got) == 30
        for (y, x), (frac, land, coastal) in got.items():
            assert frac == (0.0 if (y, x) == (2, 1) else 0.5 if x == 4 else 1.0) and land == (frac < 0.5)
            assert coastal == (abs(y - 2) <= 1 and abs(x - 1) <= 1)
    none = SP.land_on_grid(SP.known_days(df.limit(0), "v"), spec, F.lit(0), 1).collect()
    assert len(none) == 30 and all(r["land"] and r["coastal"] for r in none)
