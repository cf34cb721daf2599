"""Space/time matching with known answers."""

import datetime as dt

import numpy as np
import pytest
from conftest import LEVELS
from pyspark.sql import functions as F

from gridsonde.functions.numeric import nearest_index, nearest_site
from gridsonde.grid_spec import BASIN_GRID, GridSpec
from gridsonde.operators import match as M

T0 = dt.datetime(2020, 5, 1)
SPEC = GridSpec(10.125, 88.125, 0.25, 4, 4)


def model(spark, days=2, slope=0.012, top=29.0):
    rows = [(T0 + dt.timedelta(days=d), iy, ix, float(z), top - slope * z, 34 + 0.001 * z)
            for d in range(days) for iy in range(4) for ix in range(4) for z in LEVELS]
    return spark.createDataFrame(rows, "t_model timestamp, iy int, ix int, depth double, theta double, sp double")


def test_nearest_index_agrees_with_argmin(spark):
    lat = np.array([5.125 + 0.25 * i for i in range(100)])
    v = np.concatenate([np.random.default_rng(0).uniform(4, 31, 500), (lat[:-1] + lat[1:]) / 2, [0.0, 99.0]])
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "i int, v double")
    got = {r[0]: r[1] for r in df.select("i", nearest_index(F.col("v"), 5.125, 0.25, 100)).collect()}
    for i, x in enumerate(v):
        assert got[i] == int(np.argmin(np.abs(lat - x))), x


def test_radius_and_domain(spark):
    df = spark.createDataFrame([(1, 10.2, 88.2), (2, 10.0, 88.2), (3, 12.0, 88.2)], "i int, lat double, lon double")
    got = {r["i"]: r["iy"] for r in M.nearest_cell(df, SPEC, max_radius=0.35, in_domain=True).collect()}
    assert got == {1: 0, 2: None, 3: None}
    assert {r["iy"] for r in M.nearest_cell(df, SPEC).collect()} == {0, 3}


def test_nearest_time_against_brute_force(spark):
    rng = np.random.default_rng(2)
    times = sorted({T0 + dt.timedelta(hours=int(h)) for h in rng.integers(0, 900, 25)})
    obs = [T0 + dt.timedelta(minutes=int(m)) for m in rng.integers(-6000, 60000, 300)]
    obs += [a + (b - a) / 2 for a, b in zip(times, times[1:])]  # exact ties
    o = spark.createDataFrame([(i, t) for i, t in enumerate(obs)], "i int, ts timestamp")
    m = spark.createDataFrame([(t,) for t in times], "t timestamp")
    got = {r["i"]: (r["t_model"], r["dt_hours"]) for r in M.nearest_time(o, m, "ts", "t", 60.0).collect()}
    assert len(got) == len(obs)
    for i, t in enumerate(obs):
        best = min(times, key=lambda x: (abs(x - t), x))
        h = abs(best - t).total_seconds() / 3600
        if h <= 60:
            assert got[i][0] == best and got[i][1] == pytest.approx(h, abs=1e-9)
        else:
            assert got[i] == (None, None)


def test_float_profile_obeys_the_five_metre_guard(spark):
    ts = T0 + dt.timedelta(hours=6)
    rows = [("p", ts, 10.2, 88.2, z, 29 - 0.012 * z, 34.0) for z in (0.0, 2.0, 10.0, 20.0, 50.0)]
    rows += [("far", ts, 40.0, 88.2, 10.0, 20.0, 34.0), ("late", ts + dt.timedelta(days=9), 10.2, 88.2, 10.0, 20.0, 34.0),
             ("p", ts, 10.2, 88.2, 30.0, None, None)]
    levels = spark.createDataFrame(rows, "profile_id string, ts timestamp, lat double, lon double, depth double, temp double, psal double")
    matched = M.argo_match(levels, model(spark), SPEC)
    assert matched.count() == len(rows), "every level keeps a status"
    pairs = M.argo_pairs(matched).collect()
    assert sorted(p["depth"] for p in pairs) == [10.0, 20.0, 50.0] and {p["dt_bin"] for p in pairs} == {"dt_0d"}
    assert all(p["temp_model"] == pytest.approx(p["temp"], abs=1e-9) for p in pairs)
    c = M.argo_counters(matched).first()
    assert (c["skipped_far"], c["skipped_time"], c["skipped_shallow"], c["n_pairs"]) == (1, 1, 2, 3)
    skill = M.skill_by_dt(M.argo_pairs(matched))
    assert skill.filter("depth is null and variable = 'theta'").first()["rmse"] == pytest.approx(0, abs=1e-9)
    assert skill.groupBy("dt_bin", "variable").count().first()["count"] == 16


def test_model_columns_need_three_levels(spark):
    m = model(spark).filter("depth <= 5")
    row = spark.createDataFrame([("p", T0, 10.2, 88.2, 10.0, 20.0, 34.0)], "profile_id string, ts timestamp, lat double, lon double, depth double, temp double, psal double")
    assert M.argo_match(row, m, SPEC).first()["status"] == "no_model"


def test_mooring_both_directions(spark):
    sensors = (1.0, 10.0, 20.0, 40.0, 60.0, 80.0, 100.0, 140.0, 200.0, 300.0, 500.0)
    rows = [("rama_15n90e", T0 + dt.timedelta(hours=h), 10.6, 88.6, z, 29 - 0.012 * z, None) for h in (3, 40) for z in sensors]
    rows += [("rama_15n90e", T0 + dt.timedelta(hours=4), 10.6, 88.6, z, 20.0, 34.0) for z in (1.0, 10.0)]
    moor = spark.createDataFrame(rows, "site string, ts timestamp, lat double, lon double, depth double, temp double, psal double")
    out = M.mooring_match(moor, model(spark), SPEC)
    a = out.filter("direction = 'model_to_mooring'")
    assert a.filter("temp_obs is not null").count() == 11, "the 40 h record is beyond 12 h, the short one has no curve"
    assert a.agg(F.avg(F.abs(F.col("temp_model") - F.col("temp_obs")))).first()[0] < 0.05
    b = {r["depth"]: r["temp_obs"] for r in out.filter("direction = 'mooring_to_standard' and temp_obs is not null").collect()}
    assert b[0.0] == pytest.approx(29.0, abs=1e-6), "extended above the 1 m sensor"
    assert b[500.0] == pytest.approx(23.0) and 700.0 not in b
    assert out.filter("sp_obs is not null").count() == 0
    skill = M.mooring_skill(out)
    assert skill.filter("direction = 'model_to_mooring' and variable = 'theta' and depth is null").first()["n_pairs"] == 11


def test_quality_flags(spark):
    rows = [("a", z, 20.0, 34.0, 1, "1", 1, "2", 1) for z in (1.0, 2.0, 3.0)] + [("a", 4.0, 20.0, 34.0, 4, "1", 4, "1", 1)]
    rows += [("b", z, 20.0, 34.0, 1, "1", 1, "1", 3) for z in (1.0, 2.0, 3.0)] + [("c", z, 20.0, 34.0, 1, "1", 1, "1", 1) for z in (1.0, 2.0)]
    df = spark.createDataFrame(rows, "p string, depth double, temp double, psal double, temp_qc int, pres_qc string, psal_qc int, position_qc string, time_qc int")
    out = M.qc_filter(df, ["p"]).collect()
    assert {r["p"] for r in out} == {"a"} and len(out) == 4
    bad = [r for r in out if r["temp"] is None]
    assert len(bad) == 1 and bad[0]["depth"] is None and bad[0]["psal"] is None


def test_sites_lookup_and_surface(spark):
    r = spark.range(1).select(nearest_site(F.lit(14.0), F.lit(90.0)), nearest_site(F.lit(12.4), F.lit(91.0)), nearest_site(F.lit(13.5), F.lit(90.0))).first()
    assert list(r) == ["rama_15n90e", "rama_12n90e", "rama_15n90e"]
    st = spark.createDataFrame([(1, 10.2, 88.2), (2, 10.9, 88.9)], "s int, lat double, lon double")
    mask = spark.createDataFrame([(i, j, (i, j) == (3, 3)) for i in range(4) for j in range(4)], "iy int, ix int, land boolean")
    out = M.point_lookup(st, model(spark, days=1).drop("t_model"), mask, SPEC).collect()
    assert [r["s"] for r in out] == [1] and len(out[0]["levels"]) == 15 and out[0]["levels"][0]["theta"] == 29.0
    p = spark.createDataFrame([(1, 0, 0, 20.0, True), (1, 0, 1, 25.0, False)], "day int, iy int, ix int, pred double, ok boolean")
    o = spark.createDataFrame([(1, 0, 0, 21.0), (1, 0, 1, 0.0)], "day int, iy int, ix int, obs double")
    got = {r["depth"]: r for r in M.surface_match(p, o, valid="ok").collect()}
    assert got[0.0]["bias"] == -1.0 and got[None]["n"] == 1 and got[5.0]["n"] == 0


def test_hot_observation_cell_is_matched_whole(spark):
    """A third of all samples sit in one cell and hour; none may be lost or repeated."""
    n = 3000
    obs = spark.range(n).select(
        F.col("id").alias("profile_id"), F.expr("timestamp'2020-05-01 05:00:00' + make_interval(0,0,0,0,0,0,if(id % 3 = 0, 0, id % 600))").alias("ts"),
        F.when(F.col("id") % 3 == 0, 10.2).otherwise(10.15 + (F.col("id") % 7) * 0.1).alias("lat"), F.lit(88.3).alias("lon"),
        F.lit(30.0).alias("depth"), F.lit(28.0).alias("temp"), F.lit(34.0).alias("psal"))
    out = M.argo_pairs(M.argo_match(obs, model(spark), SPEC))
    assert out.count() == n and out.select("profile_id").distinct().count() == n
    assert out.filter("abs(temp_model - 28.64) > 1e-9").count() == 0
    assert BASIN_GRID.n_lat == 100
