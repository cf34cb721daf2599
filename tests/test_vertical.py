"""Water columns with known answers."""

import random

import numpy as np
import pytest
from conftest import LEVELS, plan
from pyspark.sql import functions as F

from gridsonde.functions.numeric import nearest_level
from gridsonde.functions.physics import sigma_theta, simple_density
from gridsonde.session import scratch_path
from gridsonde.operators import vertical as V


def columns(spark, profiles):
    rows = [(c, float(z), None if t is None else float(t), None if r is None else float(r))
            for c, levels in profiles.items() for z, t, r in levels]
    return spark.createDataFrame(rows, "c int, z double, ct double, rho double")


def linear():
    return [(z, 30 - 0.02 * z, 1025.0) for z in LEVELS]


def reference_pchip(z, y, q):
    """Independent numpy form of the shape-preserving cubic."""
    z, y = np.asarray(z, float), np.asarray(y, float)
    h, m = np.diff(z), np.diff(y) / np.diff(z)
    d = np.zeros(len(z))
    if len(z) == 2:
        d[:] = m[0]
    else:
        for k in range(1, len(z) - 1):
            if m[k - 1] * m[k] > 0:
                w1, w2 = 2 * h[k] + h[k - 1], h[k] + 2 * h[k - 1]
                d[k] = (w1 + w2) / (w1 / m[k - 1] + w2 / m[k])

        def end(h0, h1, m0, m1):
            e = ((2 * h0 + h1) * m0 - h0 * m1) / (h0 + h1)
            if np.sign(e) != np.sign(m0):
                return 0.0
            return 3 * m0 if np.sign(m0) != np.sign(m1) and abs(e) > 3 * abs(m0) else e

        d[0], d[-1] = end(h[0], h[1], m[0], m[1]), end(h[-1], h[-2], m[-1], m[-2])
    k = np.clip(np.searchsorted(z, q, side="right") - 1, 0, len(z) - 2)
    s = (q - z[k]) / h[k]
    return (y[k] * (1 + 2 * s) * (1 - s) ** 2 + h[k] * d[k] * s * (1 - s) ** 2
            + y[k + 1] * s**2 * (3 - 2 * s) + h[k] * d[k + 1] * s**2 * (s - 1))


def test_pchip_linear_profile_is_exact(spark):
    out = V.pchip(columns(spark, {1: linear()}), ["c"], "z", "ct")
    row = out.agg(F.count("*"), F.max(F.abs(F.col("ct") - (30 - 0.02 * F.col("z")))), F.min("z"), F.max("z")).first()
    assert row[0] == 1001 and row[1] < 1e-9 and (row[2], row[3]) == (0.0, 1000.0)


def test_pchip_decreasing_profile_stays_monotone(spark):
    prof = [(z, 29 - 3 * np.tanh(z / 100) - 0.01 * z, 1025) for z in LEVELS]
    out = V.pchip(columns(spark, {1: prof}), ["c"], "z", "ct").orderBy("z").collect()
    v = [r["ct"] for r in out]
    assert all(b <= a + 1e-12 for a, b in zip(v, v[1:]))


def test_pchip_matches_independent_form_on_random_columns(spark):
    rng = random.Random(5)
    profiles = {}
    for c in range(12):
        zs = sorted(rng.sample(range(0, 200), rng.randint(3, 9)))
        zs = [z + rng.choice([0, 0.25, 0.5]) for z in zs]
        profiles[c] = [(z, rng.uniform(0, 30), 1025) for z in zs]
    got = {}
    for r in V.pchip(columns(spark, profiles), ["c"], "z", "ct", z_max=200).collect():
        got.setdefault(r["c"], {})[r["z"]] = r["ct"]
    for c, prof in profiles.items():
        z, y = [p[0] for p in prof], [p[1] for p in prof]
        q = np.array([float(i) for i in range(0, int(np.floor(z[-1])) + 1)])
        assert sorted(got[c]) == list(q)  # complete columns reach the top, and stop at their last level
        np.testing.assert_allclose([got[c][x] for x in q], reference_pchip(z, y, q), atol=1e-9)


def test_partial_columns_are_not_extrapolated_and_need_three_levels(spark):
    df = columns(spark, {
        1: [(0, None, 1), (5, 20, 1), (10, 19, 1), (20, 18, 1), (30, None, 1)],
        2: [(0, 20, 1), (5, 19, 1), (10, None, 1)],
        3: [(5, 20, 1), (10, 18, 1)],
    })
    out = V.pchip(df, ["c"], "z", "ct")
    got = {r["c"]: (r[1], r[2]) for r in out.groupBy("c").agg(F.min("z"), F.max("z")).collect()}
    assert got == {1: (5.0, 20.0), 3: (0.0, 10.0)}


def test_repeated_levels_are_merged(spark):
    df = columns(spark, {1: linear() + linear() + [(10, None, 1025)]})
    assert V.pchip(df, ["c"], "z", "ct").count() == 1001
    again = V.dedupe_levels(df.withColumn("o", F.monotonically_increasing_id()), ["c"], "z", ["ct"], order="o")
    assert again.count() == len(LEVELS) and again.filter("ct is null").count() == 0


def test_standard_levels_clamp_above_and_null_below(spark):
    df = columns(spark, {1: [(8, 20, 1), (40, 18, 1), (120, 12, 1)]})
    got = {r["z"]: r["ct"] for r in V.pchip_levels(df, ["c"], "z", "ct").collect()}
    assert got[0.0] == got[5.0] == 20.0 and got[100.0] is not None and got[125.0] is None and got[1000.0] is None
    deep = {r["z"]: r["ct"] for r in V.pchip_levels(df, ["c"], "z", "ct", clamp_deep=True).collect()}
    assert deep[125.0] == deep[1000.0] == pytest.approx(12.0)


def test_sensor_depths_from_a_packed_column(spark):
    segs = V.hermite_segments(columns(spark, {1: linear()}), ["c"], "z", ["ct"])
    packed = V.pack_segments(segs, ["c"], ["ct"])
    depths = [1.0, 10.0, 140.0, 500.0, 1000.0, 1001.0]
    q = packed.select(F.explode(F.array(*[F.lit(d) for d in depths])).alias("z"), "profile")
    got = [r[1] for r in q.select("z", V.probe(F.col("profile"), "ct", F.col("z"))).orderBy("z").collect()]
    np.testing.assert_allclose(got[:-1], [30 - 0.02 * d for d in depths[:-1]], atol=1e-9)
    assert got[-1] is None


@pytest.fixture(scope="module")
def known(spark):
    isothermal = [(z, 28.0 if z <= 75 else 28 - 0.02 * (z - 75), 1024 + 0.001 * max(z - 10, 0)) for z in LEVELS]
    warm = [(z, 29 - 0.001 * z, 1025) for z in LEVELS]
    cold = [(z, 15 - 0.01 * z, 1025 + 0.01 * z) for z in LEVELS]
    rewarmed = [(0, 27, 1025), (10, 26.5, 1025), (20, 25, 1025), (30, 27.5, 1025), (50, 24, 1026), (75, 19, 1027)]
    df = columns(spark, {1: linear(), 2: isothermal, 3: warm, 4: cold, 5: rewarmed, 6: [(0, 29, 1025), (5, None, 1025)]})
    return df, {r["c"]: r for r in V.column_indices(df, ["c"], "z", "ct", "rho").collect()}


def test_index_values(known):
    _, idx = known
    assert idx[1]["z20"] == pytest.approx(500, abs=1) and idx[1]["d26"] == pytest.approx(200, abs=1)
    assert idx[1]["tchp"] == pytest.approx(1025 * 4178 * 400 * 1e-7, rel=0.02)
    assert idx[1]["ild"] == pytest.approx(20, abs=1) and idx[1]["mld"] is None
    assert idx[2]["mld"] == pytest.approx(40, abs=1) and idx[2]["blt"] > 0
    assert idx[3]["tchp"] is None and idx[3]["d26"] is None, "a column that stays warm has no heat potential"
    assert idx[4]["tchp"] == 0.0 and idx[4]["d26"] == 0.0
    assert all(idx[6][k] is None for k in ("d26", "z20", "mld", "ild", "blt", "tchp")), "too few levels"


def test_fused_indices_equal_the_separate_operators(known):
    df, idx = known
    metres = V.pchip(df, ["c"], "z", ["ct", "rho"])
    parts = (V.isotherm_depth(metres, ["c"], "z", "ct", {"d26": 26.0, "z20": 20.0})
             .join(V.mixed_layer_depth(metres, ["c"], "z", "rho"), "c").join(V.isothermal_layer_depth(metres, ["c"], "z", "ct"), "c")
             .join(V.heat_potential(metres, ["c"], "z", "ct", "rho"), "c"))
    for r in parts.collect():
        for k in ("d26", "z20", "mld", "ild", "tchp"):
            assert r[k] == (None if idx[r["c"]][k] is None else pytest.approx(idx[r["c"]][k], abs=1e-9)), (r["c"], k)


def test_heat_stops_at_the_first_isotherm_even_if_it_rewarms(known):
    _, idx = known
    assert 10 < idx[5]["d26"] < 20 and idx[5]["tchp"] == pytest.approx(
        sum(1025 * 4178 * e for e in (0.5 * (1.0 + 0.5) * 10,)) * 1e-7, rel=0.35)


def test_barrier_gate_on_salinity_spread(spark):
    prof = [(z, 28.0 if z <= 75 else 28 - 0.02 * (z - 75), 1024 + 0.001 * max(z - 10, 0)) for z in LEVELS]
    df = columns(spark, {1: prof, 2: prof}).withColumn("sigma", F.when(F.col("c") == 1, 0.1).otherwise(0.2))
    got = {r["c"]: r["blt"] for r in V.column_indices(df, ["c"], "z", "ct", "rho", sigma_sp="sigma").collect()}
    assert got[1] > 0 and got[2] is None


def test_indices_use_one_shuffle(spark):
    path = scratch_path(spark, "cols")
    columns(spark, {1: linear()}).write.mode("overwrite").parquet(path)
    text = plan(V.column_indices(spark.read.parquet(path), ["c"], "z", "ct", "rho", unique=True))
    assert text.count("Exchange") == 1 and "Python" not in text


def test_reference_depth_must_be_near(spark):
    coarse = spark.createDataFrame([(1, z, 1024 + 0.01 * z) for z in (0.0, 9.0, 12.0, 30.0)], "c int, z double, rho double")
    assert V.mixed_layer_depth(coarse, ["c"], "z", "rho").first()["mld"] is None


def test_serving_family_defaults_and_last_crossing(spark):
    df = spark.createDataFrame([(1, z, t) for z, t in ((0.0, 29.0), (10.0, 28.0), (20.0, 29.0), (30.0, 27.0))]
                               + [(2, z, 25.0) for z in (0.0, 10.0)], "c int, z double, t double")
    got = {r["c"]: r for r in V.serving_indices(df, ["c"], "z", "t").collect()}
    assert 20 < got[1]["mld"] < 30 and got[1]["z20"] == 120.0
    assert (got[2]["mld"], got[2]["z20"], got[2]["tchp"], got[2]["blt"]) == (40.0, 120.0, 0.0, 30.0)


def test_dashboard_family(spark):
    df = columns(spark, {1: linear()}).withColumn("sp", F.lit(34.0))
    r = V.sounding_summary(df, ["c"], "z", "ct", "sp").first()
    assert r["ild"] == pytest.approx(25.0) and len(r["sigma"]) == 15 and r["core_grad"] == pytest.approx(-0.02)
    full = 1025 * 3985 / 1e7
    assert r["kj_0_50"] == pytest.approx(full * 50 * 3.5) and r["kj_200_500"] == pytest.approx(0.0, abs=1e-9)
    z = V.linear_interp(df, ["c"], "z", ["ct"], [-1.0, 2.5, 2000.0]).orderBy("z").collect()
    assert [x["ct"] for x in z] == pytest.approx([30.0, 29.95, 10.0])


def test_density_formulas(spark):
    r = spark.range(1).select(simple_density(F.lit(10.0), F.lit(35.0 * 35 / 35.16504)).alias("a"),
                              sigma_theta(F.lit(5.0), F.lit(35.0)).alias("b")).first()
    assert r["a"] == pytest.approx(1025.0) and r["b"] == pytest.approx(27.67547, abs=1e-4)  # published check value


def test_nearest_level_tie_is_shallower(spark):
    df = spark.createDataFrame([(2.5,), (2.6,), (850.0,), (5000.0,), (None,)], "z double")
    assert [r[0] for r in df.select(nearest_level(F.col("z"))).collect()] == [0.0, 5.0, 700.0, 1000.0, None]


def test_fused_indices_equal_the_separate_operators_on_random_columns(spark):
    rng = random.Random(4)
    cols = {}
    for c in range(120):
        t = [26.5 - 0.008 * z + rng.uniform(-4, 4) for z in LEVELS]
        cols[c] = [(z, v, 1022 + 0.004 * z + rng.uniform(-0.4, 0.4)) for z, v in zip(LEVELS, t)]
    cols[900] = [(0, 27.0, 1024.0), (10, 25.999, 1024.1), (20, 28.0, 1024.2), (50, 27.0, 1024.3), (100, 20.0, 1024.4)]
    df = columns(spark, cols)
    fused = {r["c"]: r for r in V.column_indices(df, ["c"], "z", "ct", "rho", unique=True).collect()}
    m = V.pchip(df, ["c"], "z", ["ct", "rho"], unique=True).withColumnRenamed("z", "zz")
    one = V.heat_potential(m, ["c"], "zz", "ct", "rho")
    for more in (V.mixed_layer_depth(m, ["c"], "zz", "rho"), V.isothermal_layer_depth(m, ["c"], "zz", "ct"),
                 V.isotherm_depth(m, ["c"], "zz", "ct", {"d26": 26.0, "z20": 20.0})):
        one = one.join(more, "c")
    for r in one.collect():
        for name in ("tchp", "mld", "ild", "d26", "z20"):
            want, got = r[name], fused[r["c"]][name]
            assert (want is None) == (got is None) and (want is None or got == pytest.approx(want, abs=1e-6)), (r["c"], name)
    part = V.column_indices(df, ["c"], "z", "ct", "rho", unique=True, wanted=("tchp",))
    assert part.columns == ["c", "tchp"] and all(r["tchp"] == fused[r["c"]]["tchp"] for r in part.collect())


def test_absent_levels_count_as_missing_when_a_number_is_expected(spark):
    full = [(float(z), 30.0 - 0.02 * z, 1024.0 + 0.001 * z) for z in LEVELS]
    df = columns(spark, {1: full[1:], 2: full})
    top = {r["c"]: r["z"] for r in V.pchip_levels(df, ["c"], "z", "ct", [0.0, 1000.0], clamp_deep=True, expected=len(LEVELS)).groupBy("c").agg(
        F.count("ct").alias("z")).collect()}
    assert top[2] == 2
    free = V.column_indices(df, ["c"], "z", "ct", "rho", unique=True).orderBy("c").collect()
    held = V.column_indices(df, ["c"], "z", "ct", "rho", unique=True, expected=len(LEVELS)).orderBy("c").collect()
    assert free[1] == held[1] and free[0]["tchp"] > held[0]["tchp"]  # metres above the first known level are not made up


def test_repeated_levels_keep_one_whole_row(spark):
    df = spark.createDataFrame([(1, 0.0, 5.0, None), (1, 0.0, 7.0, 30.0), (1, 0.0, 6.0, 31.0), (1, 5.0, None, None)], "c int, z double, t double, s double")
    got = {r["z"]: (r["t"], r["s"]) for r in V.dedupe_levels(df, ["c"], "z", ["t", "s"]).collect()}
    assert got == {0.0: (6.0, 31.0), 5.0: (None, None)}


def test_serving_heat_is_unknown_where_a_level_is_missing(spark):
    df = spark.createDataFrame([(1, 0.0, None), (1, 10.0, None), (2, 0.0, 29.0), (2, 10.0, None), (3, 0.0, 29.0), (3, 10.0, 28.0)], "c int, z double, t double")
    got = {r["c"]: r for r in V.serving_indices(df, ["c"], "z", "t").collect()}
    assert got[1]["tchp"] is None and got[2]["tchp"] is None and got[3]["tchp"] > 0 and got[1]["z20"] == 120.0
