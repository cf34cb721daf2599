"""Calendar, climatology and time-series operators."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridsonde.functions.calendar import climatology_doy, days_since_1950, dt_bin, season_cos, season_sin, split_label
from gridsonde.operators import climate as C
from gridsonde.operators import grid as G

DAY = dt.date


def test_doy_folds_leap_day(spark):
    days = [DAY(2000, 2, 28), DAY(2000, 2, 29), DAY(2000, 3, 1), DAY(2000, 12, 31), DAY(2001, 3, 1), DAY(2001, 12, 31)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    assert [r[0] for r in df.select(climatology_doy(F.col("d"))).collect()] == [59, 59, 60, 365, 60, 365]


def test_season_and_julian_days(spark):
    r = spark.range(1).select(season_sin(F.lit(1)), season_cos(F.lit(1)), days_since_1950(F.lit(0.0)).cast("string"),
                              days_since_1950(F.lit(27048.75)).cast("string")).first()
    assert (r[0], r[1]) == (0.0, 1.0) and r[2] == "1950-01-01 00:00:00" and r[3] == "2024-01-21 18:00:00"


def test_dt_bins_are_closed(spark):
    df = spark.createDataFrame([(h,) for h in (0.0, 12.0, 12.01, 36.0, 36.5, 60.0, 60.1, None)], "h double")
    assert [r[0] for r in df.select(dt_bin(F.col("h"))).collect()] == ["dt_0d", "dt_0d", "dt_1d", "dt_1d", "dt_2d", "dt_2d", None, None]


def test_splits(spark):
    df = spark.createDataFrame([(DAY(2012, 1, 1),), (DAY(2019, 6, 1),), (DAY(2021, 12, 31),), (DAY(2022, 1, 1),)], "day date")
    assert [r[0] for r in df.select(split_label(F.col("day"))).collect()] == ["train", "validation", "test", None]
    assert G.keep_split(df, "day", "val").count() == 1
    late = df.filter("day > '2020-01-01'")
    assert G.keep_split(late, "day", "train").count() == 0
    assert G.keep_split(late, "day", "train", fall_back=True).count() == 2


def test_climatology_statistics_and_full_year(spark):
    rows = [(1, 10, 1.0), (1, 10, 3.0), (1, 20, None), (2, 365, 5.0)]
    clim = C.daily_climatology(spark.createDataFrame(rows, "c int, doy int, v double"), "doy", ["c"], ["v"])
    assert clim.count() == 730 and clim.select("c", "doy").distinct().count() == 730
    got = {(r["c"], r["doy"]): r for r in clim.filter("v_count > 0 or doy = 20").collect()}
    assert got[1, 10]["v_clim"] == 2.0 and got[1, 10]["v_std"] == 1.0 and got[1, 10]["v_low"]
    assert got[1, 20]["v_clim"] is None and got[1, 20]["v_count"] == 0 and got[2, 365]["v_count"] == 1


def test_gap_filling_matches_linear_interpolation(spark):
    rng = np.random.default_rng(0)
    rows, want = [], {}
    x = np.arange(1, 366)
    for c in range(5):
        known = np.sort(rng.choice(x, size=rng.integers(2, 40), replace=False))
        v = rng.normal(size=known.size)
        rows += [(c, int(d), float(y)) for d, y in zip(known, v)]
        w = np.interp(x, known, v)
        left, right = x < known[0], x > known[-1]
        w[left] = v[0] + (v[1] - v[0]) / (known[1] - known[0]) * (x[left] - known[0])
        w[right] = v[-1] + (v[-1] - v[-2]) / (known[-1] - known[-2]) * (x[right] - known[-1])
        want[c] = w
    rows.append((9, 100, 4.0))
    clim = C.daily_climatology(spark.createDataFrame(rows, "c int, doy int, v double"), "doy", ["c"], ["v"])
    got = {}
    for r in C.fill_doy_gaps(clim, "doy", ["c"], "v_clim").collect():
        got.setdefault(r["c"], {})[r["doy"]] = r["v_clim"]
    for c, w in want.items():
        np.testing.assert_allclose([got[c][d] for d in x], w, atol=1e-9)
    assert sum(v is not None for v in got[9].values()) == 1, "one known day cannot be extended"


def test_anomaly_and_baseline_of_the_climatology_itself(spark):
    rows = [(c, d, float(d % 7 + c + y)) for c in (1, 2) for d in range(1, 30) for y in (0, 2)]
    df = spark.createDataFrame(rows, "c int, doy int, sst double")
    clim = C.daily_climatology(df, "doy", ["c"], ["sst"])
    a = C.anomaly(df, clim, ["doy", "c"], ["sst"])
    assert {abs(r["delta_sst"]) for r in a.collect()} == {1.0} and "sst_clim_on_time" in a.columns
    r = C.climatology_mse(df, clim, ["doy", "c"], ["c"], ["sst"]).first()
    assert r["sst_mse"] == pytest.approx(1.0) and r["sst_rmse"] == pytest.approx(1.0)


def test_baseline_is_mean_of_cell_means(spark):
    df = spark.createDataFrame([(1, 1, 3.0)] + [(2, 1, 1.0)] * 9, "c int, doy int, v double")
    clim = spark.createDataFrame([(1, 1, 0.0), (2, 1, 0.0)], "c int, doy int, v_clim double")
    assert C.climatology_mse(df, clim, ["doy", "c"], ["c"], ["v"]).first()["v_mse"] == pytest.approx((9 + 1) / 2)


def test_box_index_edges_and_lags(spark):
    rows = [(DAY(2020, 1, d), 0.0, 50.0, 10.0 + d) for d in range(1, 16)] + [(DAY(2020, 1, d), 0.0, 110.0, 1.0) for d in range(1, 16)]
    rows += [(DAY(2020, 1, 1), 50.0, 50.0, 999.0)]
    df = spark.createDataFrame(rows, "day date, lat double, lon double, sst double")
    from gridsonde import constants as K
    got = {r["day"].day: r for r in C.box_index(df, "sst", C.in_box(K.DIPOLE_WEST), C.in_box(K.DIPOLE_EAST)).collect()}
    assert got[1]["dmi"] == 10.0 and got[1]["lag_7"] is None and got[15]["lag_14"] == 10.0 and got[8]["lag_7"] == 10.0


def test_coverage_merge_and_before_after(spark):
    cov = spark.createDataFrame([(0, 0, 1.0), (0, 0, None), (0, 1, None), (0, 1, None), (0, 1, 2.0)], "iy int, ix int, v double")
    assert {r["ix"]: r["land"] for r in C.land_from_coverage(cov, "v").collect()} == {0: False, 1: True}
    a = spark.createDataFrame([(DAY(2020, 1, 1), 1, None), (DAY(2020, 1, 2), 2, 5)], "day date, a int, x int")
    b = spark.createDataFrame([(DAY(2020, 1, 1), 7), (DAY(2020, 1, 3), 9)], "day date, x int")
    got = {r["day"].day: (r["a"], r["x"]) for r in C.merge_features(a, b).collect()}
    assert got == {1: (1, 7), 2: (2, 5), 3: (None, 9)}
    e = spark.createDataFrame([("s", DAY(2020, 5, 16), 115.2), ("s", DAY(2020, 5, 20), 35.6), ("s", DAY(2020, 5, 18), 1.0)], "k string, day date, tchp double")
    r = C.before_after(e, ["k"], "day", "2020-05-16", "2020-05-20", ["tchp"]).first()
    assert r["tchp_change"] == pytest.approx(-79.6)


def test_windows_and_spines(spark):
    r = spark.createDataFrame([("a", DAY(2019, 11, 20), DAY(2020, 2, 3))], "k string, s date, e date")
    got = [(x["window_start"].isoformat(), x["window_end"].isoformat()) for x in G.monthly_windows(r, "s", "e").orderBy("window_start").collect()]
    assert got == [("2019-11-20", "2019-11-30"), ("2019-12-01", "2019-12-31"), ("2020-01-01", "2020-01-31"), ("2020-02-01", "2020-02-03")]
    assert G.day_spine(r, "s", "e").count() == 76
