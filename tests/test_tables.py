"""Sources, sinks, quality checks, model-input tables and streaming."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from conftest import plan
from gridsonde import constants as K
from gridsonde.functions.numeric import fill_constant, finite
from gridsonde.functions.physics import classify_heat, classify_mld, depth_valid, heat_text, intensification_score, sigma_from_log, thermocline_base, water_column
from gridsonde.grid_spec import GridSpec
from gridsonde.operators import quality as Q
from gridsonde.operators import training as T
from gridsonde.operators.climate import daily_mean
from gridsonde.sources import profiles as SP
from gridsonde.sources import tables as ST
from gridsonde.streaming.daily import append_to, read_stream, stream_daily_mean

DAY = dt.date


def test_read_many(spark, tmp_path):
    spark.createDataFrame([(1, 2.0)], "a int, b double").write.parquet(f"{tmp_path}/x1")
    spark.createDataFrame([(3, "z")], "a int, c string").write.parquet(f"{tmp_path}/x2")
    both = ST.read_many(spark, [f"{tmp_path}/x1", f"{tmp_path}/x2", f"{tmp_path}/none*"])
    assert both.columns == ["a", "b", "c"] and both.count() == 2
    assert ST.read_many(spark, [f"{tmp_path}/none*"]) is None


def test_aliases_and_coordinates(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "sos double, sss_old double, u double")
    assert ST.alias_columns(df, {"sss": ("sos", "sss_old"), "u": ("sos",), "none": ("x",)}).columns == ["sss", "sss_old", "u"]
    m = spark.createDataFrame([(1.0, 5.0)], "T_20 double, pres double")
    assert ST.alias_columns(m, K.MOORING_ALIASES, ignore_case=True).columns == ["temp", "depth"]
    for lons, want in (([10.0, 350.0], [10.0, -10.0]), ([0.0, 350.0], [0.0, 350.0]), ([10.0, 170.0], [10.0, 170.0])):
        df = spark.createDataFrame([(5.0, x, 1.0) for x in lons], "Latitude double, nav_lon double, lev double")
        out = ST.standardize_coords(df)
        assert out.columns == ["lat", "lon", "depth"] and [r["lon"] for r in out.collect()] == want
    assert ST.wind_columns(spark.createDataFrame([(1.0, 1.0)], "eastward_wind double, V10M double")) == ("eastward_wind", "V10M")
    with pytest.raises(KeyError):
        ST.wind_columns(df)


def test_write_and_append(spark, tmp_path):
    rows = [(DAY(2020, 1, 31), 0, 0, 1.1, True), (DAY(2020, 2, 1), 0, 1, 2.2, False)]
    df = spark.createDataFrame(rows, "day date, iy int, ix int, v double, land boolean")
    ST.write_table(df, f"{tmp_path}/t", day="day")
    ST.write_table(df, f"{tmp_path}/t", day="day")
    back = spark.read.parquet(f"{tmp_path}/t")
    assert back.count() == 2 and dict(back.dtypes)["v"] == "float" and dict(back.dtypes)["land"] == "tinyint"
    assert "PartitionFilters: [isnotnull(month" in plan(back.filter("month = '2020-02'"))
    for part in (df.filter("iy = 0"), df.filter("day = '2020-02-01'")):
        ST.append_days(part, f"{tmp_path}/a")
    assert spark.read.parquet(f"{tmp_path}/a").count() == 2
    ST.append_days(df, f"{tmp_path}/a", idempotent=False)
    assert spark.read.parquet(f"{tmp_path}/a").count() == 4


def test_bucketed_tables_join_without_shuffle(spark, tmp_path):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("gs_cube", "gs_clim"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
            ST.write_bucketed(spark.range(100).selectExpr("cast(id as int) iy", "id v"), name, ["iy"], 4)
        joined = spark.table("gs_cube").join(spark.table("gs_clim"), "iy")
        assert "Exchange" not in plan(joined) and joined.count() == 100
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        for name in ("gs_cube", "gs_clim"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_case_study_document(spark, tmp_path):
    doc = {"meta": {"basin": "b", "category": 5}, "track": [{"date": "2020-05-16", "lat": 10.8, "lon": 88.4, "vmax_kt": 35, "mslp_hpa": 1002}],
           "profiles": {"2020-05-16": {"label": "pre", "lat": 15.5, "lon": 86.3, "depths": [0, 5, 10], "potential_temperature": [29.8, 29.7, 29.6],
                                       "practical_salinity": [33.2, 33.2, 33.3], "argo_temperature": [None, 29.8, 29.6], "TCHP": 115.2, "MLD": 28.5, "Z20": 105.8},
                        "2020-05-20": {"label": "post", "lat": 15.5, "lon": 86.3, "depths": [0], "potential_temperature": [27.0], "practical_salinity": [33.9], "TCHP": 35.6}}}
    (tmp_path / "c.json").write_text(json.dumps(doc, indent=2))
    docs = SP.load_case_study(spark, str(tmp_path / "c.json"))
    rows = SP.case_profile_rows(docs).orderBy("date", "level").collect()
    assert len(rows) == 4 and rows[1]["argo_temp"] == 29.8 and rows[0]["argo_temp"] is None and rows[0]["sigma_theta"] == 0.2
    assert {r["date"]: r["tchp"] for r in SP.case_index_rows(docs).collect()} == {"2020-05-16": 115.2, "2020-05-20": 35.6}
    assert SP.case_track_rows(docs).first()["mslp_hpa"] == 1002.0


def test_profile_and_mooring_records(spark):
    rec = spark.createDataFrame([(1, [1.0, 2.0], [20.0, float("nan")]), (2, [3.0], [19.0])], "profile_id int, depth array<double>, temp array<double>")
    rows = SP.profiles_to_rows(rec).orderBy("profile_id", "level").collect()
    assert [r["temp"] for r in rows] == [20.0, None, 19.0] and {r["psal"] for r in rows} == {None} and {r["temp_qc"] for r in rows} == {"1"}
    t = [dt.datetime(2020, 1, 1), dt.datetime(2020, 1, 2)]
    m = spark.createDataFrame([([14.0, 15.0], [90.0], t, [1.0, 10.0], [[1.0, 2.0], [3.0, float("nan")]])],
                              "lats array<double>, lons array<double>, times array<timestamp>, depths array<double>, temp array<array<double>>")
    out = SP.mooring_to_rows(m, site=None).orderBy("ts", "depth").collect()
    assert [r["temp"] for r in out] == [1.0, 2.0, 3.0, None] and {r["site"] for r in out} == {"rama_15n90e"} and out[0]["lat"] == 14.5


def test_scalar_edges(spark):
    df = spark.createDataFrame([(None, 10.0), (5.0, 10.0), (0.0, 0.0), (-10.0, 10.0), (-10.5, 10.0)], "e double, z double")
    got = [tuple(r) for r in df.select(water_column(F.col("e")), depth_valid(F.col("e"), F.col("z"))).collect()]
    assert got == [(None, False), (0.0, False), (0.0, False), (10.0, False), (10.5, True)]
    inf = float("inf")
    v = spark.createDataFrame([(x,) for x in (1.0, float("nan"), inf, -inf, None)], "v double")
    assert [r[0] for r in v.select(finite(F.col("v"))).collect()] == [1.0, None, None, None, None]
    assert [r[0] for r in v.select(fill_constant(F.col("v"), 9.0)).collect()] == [1.0, 9.0, 9.0, 9.0, 9.0]
    r = spark.range(1).select(
        intensification_score(F.lit(28.0), F.lit(None).cast("double"), F.lit(0.05)), sigma_from_log(F.lit(99.0)), sigma_from_log(F.lit(None).cast("double")),
        classify_heat(F.lit(80.0)), classify_mld(F.lit(44.6)), thermocline_base(F.lit(150.0), F.lit(150.0)), thermocline_base(F.lit(None).cast("double"), F.lit(1.0))).first()
    assert r[0] == pytest.approx(2 / 3) and r[1] == pytest.approx(7.389056) and list(r)[2:] == [None, "MODERATE", "MLD 45 m", 230.0, None]


def test_quality_checks_raise(spark):
    spec = GridSpec(5.0, 45.0, 1.0, 2, 2)
    df = spark.createDataFrame([(i, j, 5.0 + i, 45.0 + j, 0.0, 1.0 if (i, j) != (1, 1) else None) for i in range(2) for j in range(2)],
                               "iy int, ix int, lat double, lon double, depth double, v double")
    mask = spark.createDataFrame([(i, j, (i, j) == (1, 1)) for i in range(2) for j in range(2)], "iy int, ix int, land boolean")
    good = Q.quality_report(Q.check_grid(df, spec, [0.0]), Q.check_land_null(df, mask, ["v"]), Q.check_curl_spikes(df.withColumn("curl", F.lit(1e-7)), mask))
    Q.require_ok(good)
    leaky = Q.check_land_null(df.fillna(0.0), mask, ["v"])
    assert leaky.first()["n_bad"] == 1
    with pytest.raises(Q.QualityError, match="land_null"):
        Q.require_ok(Q.quality_report(good, leaky))
    empty = Q.check_curl_spikes(df.withColumn("curl", F.lit(None).cast("double")), mask).first()
    assert not empty["ok"], "no known ocean value is an error"
    assert Q.check_grid(df.filter("iy = 0"), spec, None).filter("not ok").count() == 1


def test_channels_windows_and_targets(spark):
    spec = GridSpec(5.125, 45.125, 0.25, 1, 2)
    days = [DAY(2020, 1, d) for d in range(1, 10) if d != 3]
    sst = spark.createDataFrame([(d, 0, x, 20.0 + d.day if x == 0 else float("nan")) for d in days for x in (0, 1)], "day date, iy int, ix int, sst double")
    elev = spark.createDataFrame([(0, 0, -100.0), (0, 1, 5.0)], "iy int, ix int, elevation_m double")
    ch = T.channel_assembly({"sst": sst}, elev, spec)
    assert ch.columns[3:] == list(K.CHANNELS)
    land = ch.filter("ix = 1").first()
    assert all(land[c] == 0.0 for c in K.CHANNELS)
    sea = ch.filter("ix = 0 and day = '2020-01-01'").first()
    assert sea["water_column"] == 100.0 and sea["doy_cos"] == 1.0 and sea["sla"] == 0.0 and sea["sst"] == 21.0
    w = T.antecedent_window(ch, ["ix"], "day", ["sst"], length=4).filter("ix = 0").orderBy("day").collect()
    assert [r["day"].day for r in w] == [7, 8, 9] and [x["sst"] for x in w[0]["window"]] == [24.0, 25.0, 26.0, 27.0]
    std = T.standardize(ch, {"sst": (20.0, 2.0), "doy_sin": (5.0, 5.0)}).filter("ix = 0 and day = '2020-01-01'").first()
    assert std["sst"] == 0.5 and std["doy_sin"] == sea["doy_sin"]
    tg = spark.createDataFrame([(DAY(2020, 1, 9), 0, 0, z, 0.5, 0.1, 20.0, 34.0) for z in (0.0, 100.0)],
                               "day date, iy int, ix int, depth double, delta_theta double, delta_sp double, theta_clim double, sp_clim double")
    table = T.training_table(ch, tg, elev, length=4).collect()
    assert len(table) == 1 and [x["valid"] for x in table[0]["targets"]] == [True, False]


def test_stream_equals_batch_with_late_rows(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    first = [("a", base + dt.timedelta(hours=h), float(h)) for h in range(0, 72, 3)]
    second = [("a", base + dt.timedelta(hours=50), 100.0), ("b", base + dt.timedelta(days=9), 1.0)]
    schema = "k string, ts timestamp, v double"
    for i, part in enumerate((first, second)):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    files = spark.read.schema(schema).parquet(f"{tmp_path}/in")
    stream = read_stream(spark, f"{tmp_path}/in", files.schema, files_per_trigger=1)
    q = append_to(stream_daily_mean(stream, "ts", ["k"], ["v"]), f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination()
    got = {(r["k"], r["day"]): r["v"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {(r["k"], r["day"]): r["v"] for r in daily_mean(files, "ts", ["k"], ["v"]).collect()}
    assert len(got) == 3 and all(want[k] == pytest.approx(v) for k, v in got.items())


def test_heat_texts_follow_the_class(spark):
    v = spark.createDataFrame([(None,), (80.1,), (50.0,), (49.9,)], "v double").select(classify_heat(F.col("v")).alias("c"))
    got = [tuple(r) for r in v.select("c", heat_text(F.col("c"), K.HEAT_LABELS), heat_text(F.col("c"), K.HEAT_RULES)).collect()]
    assert got == [(c, K.HEAT_LABELS[c], K.HEAT_RULES[c]) for c in ("UNKNOWN", "EXTREME", "MODERATE", "DEPLETED")]
    assert spark.range(1).select(heat_text(F.lit("other"), K.HEAT_RULES), heat_text(F.lit(None).cast("string"), K.HEAT_RULES)).first()[:] == (None, None)
