"""Scores with known answers."""

import numpy as np
import pytest
from conftest import LEVELS
from pyspark.sql import functions as F

from gridsonde.operators import skill as S


@pytest.fixture(scope="module")
def pairs(spark):
    rng = np.random.default_rng(1)
    rows = [("m", float(rng.uniform(0, 1000)), float(rng.normal(20, 3)), float(rng.normal(20, 3)), 20.0) for _ in range(400)]
    rows += [("m", 3.0, float("nan"), 1.0, 1.0), ("m", 3.0, 5.0, None, 1.0), ("k", 0.0, 1.0, 1.0, 1.0)]
    return rows, spark.createDataFrame(rows, "name string, depth double, pred double, obs double, clim double")


def test_depthwise_against_numpy(pairs):
    rows, df = pairs
    got = {(r["name"], r["depth"]): r for r in S.skill_by(df, ["name"], clim="clim").collect()}
    assert len(got) == 32
    levels = np.array(LEVELS, float)
    m = [r for r in rows if r[0] == "m"]
    z, p, o, c = (np.array([np.nan if r[i] is None else r[i] for r in m], float) for i in (1, 2, 3, 4))
    bins = levels[np.abs(z[:, None] - levels[None]).argmin(1)]
    for level in [*levels, None]:
        sel = np.ones(len(z), bool) if level is None else bins == level
        ok = sel & np.isfinite(p) & np.isfinite(o)
        r = got["m", level]
        assert r["n"] == np.isfinite(p[sel]).sum() and r["n_pairs"] == ok.sum()
        if ok.any():
            assert r["rmse"] == pytest.approx(np.sqrt(np.mean((p[ok] - o[ok]) ** 2)))
            assert r["bias"] == pytest.approx(np.mean(p[ok] - o[ok]))
            known = sel & np.isfinite(o) & np.isfinite(c)  # the climatology is scored on its own pairs
            assert r["css"] == pytest.approx(1 - np.mean((p[ok] - o[ok]) ** 2) / np.mean((c[known] - o[known]) ** 2))
        if ok.sum() >= 3:
            assert r["pearson_r"] == pytest.approx(np.corrcoef(p[ok], o[ok])[0, 1])
    assert got["k", None]["pearson_r"] is None and got["k", 5.0]["n"] == 0 and got["k", None]["css"] is None


def test_simple_scores(spark):
    x = spark.createDataFrame([(float(i), float(2 * i + 1), 7.0) for i in range(5)], "x double, y double, k double")
    r = x.agg(S.rmse(F.col("x"), F.col("x")), S.pearson(F.col("x"), F.col("y")), S.pearson(F.col("x"), F.col("k")),
              S.climatology_skill(F.lit(0.0), S.mse(F.col("x"), F.col("y"))), S.climatology_skill(S.mse(F.col("k"), F.col("x")), S.mse(F.col("k"), F.col("x"))),
              S.brier(F.lit(1.5), F.lit(1.0))).first()
    assert list(r) == [0.0, pytest.approx(1.0), None, 1.0, 0.0, 0.0]


def test_inversions(spark):
    rows = [(1, z, 30 - z, 30 - z) for z in (0.0, 1.0, 2.0)] + [(2, 0.0, 20.0, 20.0), (2, 1.0, 21.0, 19.0)]
    df = spark.createDataFrame(rows, "c int, z double, p double, o double")
    assert S.inversion_brier(df, ["c"], "z", "p", "p").first()["brier"] == 0.0
    r = S.inversion_brier(df, ["c"], "z", "p", "o").first()
    assert (r["brier"], r["n_columns"]) == (0.5, 2)
    pen = spark.createDataFrame([(1, 0.0, 20.0, 33.0), (1, 1.0, 21.0, 33.0), (1, 2.0, 22.0, 34.0)], "c int, z double, t double, s double")
    r = S.inversion_penalty(pen, ["c"], "z", "t", "s").first()
    assert r["penalty"] == pytest.approx(0.95 / 2) and r["plain"] == 1.0


def test_area_weighting(spark):
    df = spark.createDataFrame([(10.0, 1.0, 0.0, True), (60.0, 3.0, 0.0, True), (60.0, 99.0, 0.0, False)], "lat double, p double, o double, ok boolean")
    axis = df.select("lat").distinct()
    w = np.cos(np.radians([10.0, 60.0]))
    w = w / w.mean()
    got = S.area_weighted_mse(df, axis, "p", "o", valid="ok").first()[0]
    assert got == pytest.approx((w[0] * 1 + w[1] * 9) / w.sum())
    assert S.area_weighted_mse(df, axis, "p", "o", valid="ok", blend=0.0).first()[0] == pytest.approx(5.0)


def test_states_of_batches_equal_the_whole(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(k % 7, float(k % 3), float(k % 5) * 10, float(rng.normal()), None if k % 11 == 0 else float(rng.normal()), None if k % 13 == 0 else k % 4 > 0) for k in range(500)]
    df = spark.createDataFrame(rows, "day int, depth double, lat double, p double, o double, ok boolean")
    axis = df.select("lat").distinct()

    def state(part):
        return S.score_state(part, axis, "p", "o", valid="ok")

    path = str(tmp_path / "states")
    for name, where in (("a", "day < 2"), ("b", "day between 2 and 4"), ("c", "day > 4"), ("b", "day between 2 and 4"), ("none", "day > 99")):
        S.store_state(state(df.where(where)), path, name)
    once = S.merged_states(spark.read.parquet(path).where("batch in ('a', 'b')")).unionByName(S.merged_states(spark.read.parquet(path).where("batch = 'c'")))
    for stored in (spark.read.parquet(path), once):
        got = {r["depth"]: (r["rmse"], r["mse"]) for r in S.scores_of_state(S.merged_states(stored)).collect()}
        known = df.withColumn("ok", F.coalesce("ok", F.lit(False)))
        rmse = {r["depth"]: r["rmse"] for r in S.masked_depth_rmse(known, "p", "o", valid="ok").collect()}
        mse = {r["depth"]: r["mse"] for r in S.area_weighted_mse(known, axis, "p", "o", valid="ok", keys=["depth"]).collect()}
        assert set(got) == {0.0, 1.0, 2.0}
        for z, (a, b) in got.items():
            assert a == pytest.approx(rmse[z]) and b == pytest.approx(mse[z])


def test_ensemble_coverage_and_nll(spark):
    e = spark.createDataFrame([(1, 1.0, 0.3), (1, 3.0, 0.5)], "c int, p double, s double")
    r = S.ensemble_stats(e, ["c"], "p", "s").first()
    assert r["epistemic"] == 1.0 and r["aleatoric"] == pytest.approx(0.4) and r["total"] == pytest.approx(np.sqrt(1 + 0.16 + 1e-12))
    d = spark.createDataFrame([(0.0, 1.0, 1.0, True), (0.0, 1.5, 1.0, True), (0.0, 9.0, 1.0, False)], "p double, t double, s double, ok boolean")
    r = d.agg(S.coverage_share(F.col("p"), F.col("t"), F.col("s"), 1.0, F.col("ok")), S.coverage_share(F.col("p"), F.col("t"), F.col("s"), 2.0, F.col("ok")),
              S.gaussian_nll(F.col("p"), F.log("s"), F.col("t"))).first()
    assert (r[0], r[1]) == (0.5, 1.0) and r[2] == pytest.approx(np.mean([0.5, 1.125, 40.5]))


def test_eval_roll_up(spark):
    rng = np.random.default_rng(5)
    rows = [(d, z, lat, *map(float, rng.normal(size=4)), 1.0, bool(rng.random() < 0.8)) for d in range(3) for z in (0.0, 10.0) for lat in (5.0, 30.0, 60.0)]
    df = spark.createDataFrame(rows, "day int, depth double, lat double, pred_theta double, true_theta double, pred_sp double, true_sp double, sigma_theta double, ok boolean")
    r = S.split_eval_report(df, df.select("lat").distinct(), valid="ok").first()
    a = np.array([[float(x) for x in row] for row in rows])
    day, z, lat, pt, tt, ok = a[:, 0], a[:, 1], a[:, 2], a[:, 3], a[:, 4], a[:, 8] > 0
    w = np.cos(np.radians(lat)) / np.cos(np.radians([5.0, 30.0, 60.0])).mean()
    rm = [np.sqrt(np.mean((pt - tt)[ok & (z == k)] ** 2)) for k in (0.0, 10.0)]
    frames = [np.sum((w * tt**2)[ok & (day == d)]) / np.sum(w[ok & (day == d)]) for d in range(3)]
    assert [x["rmse_theta"] for x in r["by_depth"]] == pytest.approx(rm)
    assert r["css"] == pytest.approx(1 - np.mean(np.square(rm)) / np.mean(frames))
    assert r["css_consistent"] == pytest.approx(1 - np.sum((w * (pt - tt) ** 2)[ok]) / np.sum((w * tt**2)[ok]))
    cov = [np.mean((np.abs(pt - tt) <= 1.0)[ok & (day == d)]) for d in range(3)]
    assert r["coverage_1"] == pytest.approx(np.mean(cov))
