"""Score queries over prediction/truth cubes."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridsonde.functions import calendar as C
from gridsonde.functions import numeric as N
from gridsonde.operators import skill as S
from gridsonde.operators import vertical as V
from gridsonde.plans.registry import Tables, query, r, rounded
from gridsonde.session import scratch_path
from gridsonde.sources.tables import write_rows_json

STD = "[0e0, 5e0, 1e1, 2e1, 3e1, 5e1, 75e0, 1e2, 125e0, 15e1, 2e2, 3e2, 5e2, 7e2, 1e3]"


def nearest_sql(z: str) -> str:
    """Nearest standard depth of an expression, the shallower one on a tie."""
    return (f"CASE WHEN {z} <= 2.5e0 THEN 0e0 WHEN {z} <= 7.5e0 THEN 5e0 WHEN {z} <= 15 THEN 1e1 WHEN {z} <= 25 THEN 2e1 WHEN {z} <= 40 THEN 3e1 WHEN {z} <= 62.5e0 THEN 5e1 "
            f"WHEN {z} <= 87.5e0 THEN 75e0 WHEN {z} <= 112.5e0 THEN 1e2 WHEN {z} <= 137.5e0 THEN 125e0 WHEN {z} <= 175 THEN 15e1 WHEN {z} <= 250 THEN 2e2 WHEN {z} <= 400 THEN 3e2 "
            f"WHEN {z} <= 600 THEN 5e2 WHEN {z} <= 850 THEN 7e2 ELSE 1e3 END")


_SCORES = """COUNT(pred) AS n, COUNT(CASE WHEN pred IS NOT NULL AND obs IS NOT NULL THEN 1 END) AS n_pairs, SQRT(AVG((pred - obs) * (pred - obs))) AS rmse, AVG(pred - obs) AS bias,
    CASE WHEN COUNT(pred - obs) >= 3 AND STDDEV_POP(CASE WHEN obs IS NOT NULL THEN pred END) > 0 AND STDDEV_POP(CASE WHEN pred IS NOT NULL THEN obs END) > 0 THEN CORR(pred, obs) END AS r"""


def skill_sql(src: str, names: str = "", css: bool = False) -> str:
    """CTEs ending in ``skill``: per level and overall, all fifteen levels listed for each name."""
    c = ", 1 - AVG((pred - obs) * (pred - obs)) / NULLIF(AVG((clim - obs) * (clim - obs)), 0) AS css" if css else ""
    cc = ", b.css" if css else ""
    names_ = names + ", " if names else ""
    on = "".join(f" AND s.{n.strip()} = b.{n.strip()}" for n in names.split(",") if n.strip())
    s_names = "".join(f"s.{n.strip()}, " for n in names.split(",") if n.strip())
    group = f"GROUP BY {names}" if names else ""
    having = "" if names else "HAVING COUNT(*) > 0"
    return f"""binned AS (SELECT *, {nearest_sql('depth')} AS bin FROM {src}),
by_bin AS (SELECT {names_}bin, {_SCORES}{c} FROM binned GROUP BY {names_}bin), total AS (SELECT {names_}{_SCORES}{c} FROM binned {group} {having}),
skill AS (SELECT {s_names}s.depth, COALESCE(b.n, 0) AS n, COALESCE(b.n_pairs, 0) AS n_pairs, b.rmse, b.bias, b.r{cc} FROM (SELECT {names_}UNNEST({STD}) AS depth FROM total) s LEFT JOIN by_bin b ON s.depth = b.bin{on}
    UNION ALL SELECT {names_}NULL, n, n_pairs, rmse, bias, r{', css' if css else ''} FROM total)"""


_ROUND = "depth, n, n_pairs, ROUND(rmse, 6) AS rmse, ROUND(bias, 6) AS bias, ROUND(r, 6) AS pearson_r"


def _holey(t: Tables):
    """Predictions with missing predictions and missing truths in different places."""
    hole = (F.col("iy") + F.col("ix")) % 7 == 0
    truth_hole = (F.col("iy") * 2 + F.col("ix")) % 11 == 0
    nan = F.lit(float("nan"))
    return t.f_pred.select("day", "iy", "ix", "lat", "depth", F.when(hole, nan).otherwise(F.col("pred")).alias("pred"),
                           F.when(truth_hole, nan).otherwise(F.col("obs")).alias("obs"), "sigma")


_HOLEY_SQL = """holey AS (SELECT day, iy, ix, lat, depth, CASE WHEN (iy + ix) % 7 = 0 THEN NULL ELSE pred END AS pred, CASE WHEN (iy * 2 + ix) % 11 = 0 THEN NULL ELSE obs END AS obs, sigma FROM f_pred)"""


def _scored(df):
    return rounded(df, "rmse", "bias", "pearson_r", *(["css"] if "css" in df.columns else []))


@query("rmse_bias_mse", "SELECT depth, ROUND(SQRT(AVG((pred - obs) * (pred - obs))), 6) AS rmse, ROUND(AVG(pred - obs), 6) AS bias, ROUND(AVG((pred - obs) * (pred - obs)), 6) AS mse FROM holey GROUP BY depth", ("f_pred",), _HOLEY_SQL)
def rmse_bias_mse(t: Tables):
    p, o = N.finite(F.col("pred")), N.finite(F.col("obs"))
    return _holey(t).groupBy("depth").agg(r(S.rmse(p, o)).alias("rmse"), r(S.mean_bias(p, o)).alias("bias"), r(S.mse(p, o)).alias("mse"))


@query("pearson", """SELECT iy, ix, depth, CAST(YEAR(day) * 100 + MONTH(day) AS INT) AS ym, ROUND(CASE WHEN COUNT(pred - obs) >= 3 AND SQRT(VAR_POP(CASE WHEN obs IS NOT NULL THEN pred END) * VAR_POP(CASE WHEN pred IS NOT NULL THEN obs END)) * COUNT(pred - obs) >= 1e-12 THEN CORR(pred, obs) END, 6) AS r
    FROM holey GROUP BY 1, 2, 3, 4""", ("f_pred",), _HOLEY_SQL)
def pearson(t: Tables):
    """Per cell, level and month: many groups have fewer than three pairs."""
    ym = (F.year("day") * 100 + F.month("day")).cast("int").alias("ym")
    return _holey(t).groupBy("iy", "ix", "depth", ym).agg(r(S.pearson(N.finite(F.col("pred")), N.finite(F.col("obs")))).alias("r"))


_CLIM_SQL = "withclim AS (SELECT p.*, AVG(obs) OVER (PARTITION BY depth) AS clim FROM f_pred p)"


def _with_clim(t: Tables):
    clim = t.f_pred.groupBy("depth").agg(F.avg("obs").alias("clim"))
    return t.f_pred.join(clim, "depth")


@query("css", """SELECT CAST(AVG(CASE WHEN depth BETWEEN 50 AND 200 THEN css END) >= 0.4e0 AS BOOLEAN) AS passed, ROUND(AVG(CASE WHEN depth BETWEEN 50 AND 200 THEN css END), 6) AS mean_css
    FROM (SELECT depth, 1 - AVG((pred - obs) * (pred - obs)) / AVG((clim - obs) * (clim - obs)) AS css FROM withclim GROUP BY depth)""", ("f_pred",), _CLIM_SQL)
def css(t: Tables):
    """Skill against the level mean: mean of the 50-200 m levels and the pass flag."""
    p, o, c = F.col("pred"), F.col("obs"), F.col("clim")
    by_depth = _with_clim(t).groupBy("depth").agg(S.climatology_skill(S.mse(p, o), S.mse(c, o)).alias("css"))
    return rounded(S.thermocline_skill(by_depth), "mean_css")


@query("depthwise_skill", f"SELECT {_ROUND}, ROUND(css, 6) AS css FROM skill", ("f_pred",), _CLIM_SQL + ", " + skill_sql("withclim", css=True))
def depthwise_skill(t: Tables):
    return _scored(S.skill_by(_with_clim(t), [], clim="clim"))


@query("cube_skill", f"SELECT yr, {_ROUND} FROM skill", ("f_pred",), f"{_HOLEY_SQL}, cube AS (SELECT CAST(YEAR(day) AS INT) AS yr, depth, pred, obs FROM holey WHERE (iy + ix) % 5 <> 0), " + skill_sql("cube", "yr"))
def cube_skill(t: Tables):
    """Per year on a validity mask."""
    df = _holey(t).withColumn("yr", F.year("day")).withColumn("valid", (F.col("iy") + F.col("ix")) % 5 != 0)
    return _scored(S.cube_skill(df, ["yr"], valid="valid"))


@query("surface_match", f"SELECT {_ROUND} FROM skill", ("f_pred",), "surf AS (SELECT 0e0 AS depth, pred, obs FROM f_pred WHERE depth = 0 AND iy <> 4), " + skill_sql("surf"))
def surface_match(t: Tables):
    from gridsonde.operators.match import surface_match as match
    surface = t.f_pred.filter("depth = 0")
    pred = surface.select("day", "iy", "ix", "pred", (F.col("iy") != 4).alias("ok"))
    return _scored(match(pred, surface.select("day", "iy", "ix", "obs"), valid="ok"))


@query("skill_report", f"SELECT {_ROUND} FROM skill", ("f_pred",), skill_sql("f_pred"))
def skill_report(t: Tables):
    """Score rows written as JSON lines and read back."""
    path = write_rows_json(S.skill_by(t.f_pred, []), scratch_path(t.spark, "skill_report"))
    schema = "depth double, n bigint, n_pairs bigint, rmse double, bias double, pearson_r double"
    return _scored(t.spark.read.schema(schema).json(path))


@query("brier", "SELECT depth, ROUND(AVG(POW(LEAST(1e0, GREATEST(0e0, (pred - 2e1) / 1e1)) - LEAST(1e0, GREATEST(0e0, obs - 24e0)), 2)), 6) AS brier FROM f_pred GROUP BY depth", ("f_pred",))
def brier(t: Tables):
    b = S.brier((F.col("pred") - 20.0) / 10.0, F.col("obs") - 24.0)
    return t.f_pred.groupBy("depth").agg(r(b).alias("brier"))


_COLUMN_SQL = """pcol AS (SELECT cid, depth, theta AS obs, theta + (sp - 3.45e1 - 1e-3 * depth) * 3 AS pred, sp + 1.3e-7 * depth AS sp FROM f_column)"""


def _pred_columns(t: Tables):
    noise = (F.col("sp") - 34.5 - F.lit(1e-3) * F.col("depth")) * 3.0
    return t.f_column.select("cid", "depth", F.col("theta").alias("obs"), (F.col("theta") + noise).alias("pred"), (F.col("sp") + F.lit(1.3e-7) * F.col("depth")).alias("sp"))


@query("inversion_brier", """SELECT ROUND(AVG(CASE WHEN p <> o THEN 1e0 ELSE 0e0 END), 6) AS brier, COUNT(*) AS n_columns FROM (SELECT cid, COALESCE(BOOL_OR(dp > 0.05e0), FALSE) AS p, COALESCE(BOOL_OR(d > 0.05e0), FALSE) AS o FROM
    (SELECT cid, LEAD(pred) OVER w - pred AS dp, LEAD(obs) OVER w - obs AS d FROM pcol WINDOW w AS (PARTITION BY cid ORDER BY depth)) GROUP BY cid)""", ("f_column",), _COLUMN_SQL)
def inversion_brier(t: Tables):
    return rounded(S.inversion_brier(_pred_columns(t), ["cid"], "depth", "pred", "obs"), "brier")


@query("inversion_penalty", """SELECT ROUND(SUM(CASE WHEN ok AND pok THEN CASE WHEN ds > 0.15e0 THEN 0 ELSE GREATEST(dt - 0.05e0, 0e0) END END) / COUNT(CASE WHEN ok AND pok THEN 1 END), 6) AS penalty, ROUND(AVG(GREATEST(dt, 0e0)), 6) AS plain FROM
    (SELECT cid % 6 <> 0 OR depth < 100 AS ok, LAG(cid % 6 <> 0 OR depth < 100) OVER w AS pok, pred - LAG(pred) OVER w AS dt, sp - LAG(sp) OVER w AS ds FROM pcol WINDOW w AS (PARTITION BY cid ORDER BY depth)) WHERE dt IS NOT NULL""", ("f_column",), _COLUMN_SQL)
def inversion_penalty(t: Tables):
    valid = (F.col("cid") % 6 != 0) | (F.col("depth") < 100)
    return rounded(S.inversion_penalty(_pred_columns(t), ["cid"], "depth", "pred", "sp", valid), "penalty", "plain")


_WEIGHT = "GREATEST(COS(RADIANS(lat)), 1e-3) / (SELECT AVG(GREATEST(COS(RADIANS(lat)), 1e-3)) FROM (SELECT DISTINCT lat FROM f_pred))"


def _axis(t: Tables):
    return t.f_pred.select("lat").distinct()


@query("area_weighted_mse", f"""SELECT depth, ROUND(SUM(w * se) / GREATEST(SUM(w), 1e-6), 6) AS mse, ROUND(SUM(hw * se) / GREATEST(SUM(hw), 1e-6), 6) AS half FROM
    (SELECT depth, CASE WHEN (iy + ix) % 5 <> 0 THEN {_WEIGHT} ELSE 0 END AS w, CASE WHEN (iy + ix) % 5 <> 0 THEN 0.5e0 * {_WEIGHT} + 0.5e0 ELSE 0 END AS hw, (pred - obs) * (pred - obs) AS se FROM f_pred) GROUP BY depth""", ("f_pred",))
def area_weighted_mse(t: Tables):
    df = t.f_pred.withColumn("valid", (F.col("iy") + F.col("ix")) % 5 != 0)
    full = S.area_weighted_mse(df, _axis(t), "pred", "obs", valid="valid", keys=["depth"])
    half = S.area_weighted_mse(df, _axis(t), "pred", "obs", valid="valid", keys=["depth"], blend=0.5, out="half")
    return rounded(full.join(half, "depth"), "mse", "half")


@query("masked_depth_rmse", "SELECT depth, ROUND(SQRT(SUM(CASE WHEN (iy + ix) % 5 <> 0 THEN (pred - obs) * (pred - obs) END) / COUNT(CASE WHEN (iy + ix) % 5 <> 0 THEN 1 END)), 6) AS rmse FROM f_pred GROUP BY depth", ("f_pred",))
def masked_depth_rmse(t: Tables):
    df = t.f_pred.withColumn("valid", (F.col("iy") + F.col("ix")) % 5 != 0)
    return rounded(S.masked_depth_rmse(df, "pred", "obs", valid="valid"), "rmse")


@query("scores_over_batches", f"""SELECT depth, ROUND(SQRT(SUM(CASE WHEN ok THEN se END) / COUNT(CASE WHEN ok THEN 1 END)), 6) AS rmse, ROUND(SUM(CASE WHEN ok THEN w * se END) / SUM(CASE WHEN ok THEN w END), 6) AS mse FROM
    (SELECT depth, (iy + ix) % 5 <> 0 AS ok, {_WEIGHT} AS w, (pred - obs) * (pred - obs) AS se FROM f_pred) GROUP BY depth""", ("f_pred",))
def scores_over_batches(t: Tables):
    """States of three batches of days, stored one by one and the second one twice, then merged."""
    df = t.f_pred.withColumn("valid", (F.col("iy") + F.col("ix")) % 5 != 0)
    path = scratch_path(t.spark, "score_states")
    for k in (0, 1, 2, 1):
        part = df.filter(F.dayofmonth("day") % 3 == k)
        S.store_state(S.score_state(part, _axis(t), "pred", "obs", valid="valid"), path, f"part{k}")
    return rounded(S.scores_of_state(S.merged_states(t.spark.read.parquet(path))), "rmse", "mse")


@query("coverage", "SELECT depth, ROUND(AVG(CASE WHEN ABS(obs - pred) <= sigma THEN 1e0 ELSE 0e0 END), 6) AS c1, ROUND(AVG(CASE WHEN ABS(obs - pred) <= 2 * sigma THEN 1e0 ELSE 0e0 END), 6) AS c2 FROM f_pred WHERE (iy + ix) % 5 <> 0 GROUP BY depth", ("f_pred",))
def coverage(t: Tables):
    p, o, s = F.col("pred"), F.col("obs"), F.col("sigma")
    valid = (F.col("iy") + F.col("ix")) % 5 != 0
    return t.f_pred.groupBy("depth").agg(r(S.coverage_share(p, o, s, 1.0, valid)).alias("c1"), r(S.coverage_share(p, o, s, 2.0, valid)).alias("c2"))


@query("gaussian_nll", "SELECT depth, ROUND(AVG(0.5e0 * POW((pred - obs) / EXP(LN(sigma)), 2) + LN(sigma)), 6) AS nll FROM f_pred GROUP BY depth", ("f_pred",))
def gaussian_nll(t: Tables):
    return t.f_pred.groupBy("depth").agg(r(S.gaussian_nll(F.col("pred"), F.log("sigma"), F.col("obs"))).alias("nll"))


@query("slice_error", "SELECT depth, ROUND(AVG(ABS(pred - obs)), 6) AS mean_abs, ROUND(MAX(ABS(pred - obs)), 6) AS max_abs, ROUND(SQRT(AVG((pred - obs) * (pred - obs))), 6) AS rmse FROM f_pred GROUP BY depth", ("f_pred",))
def slice_error(t: Tables):
    return rounded(S.slice_error(t.f_pred, "pred", "obs"), "mean_abs", "max_abs", "rmse")


@query("column_mean_sigma", "SELECT cid, ROUND(AVG(sigma) - 1.234e-9, 6) AS mean_sigma FROM f_ensemble GROUP BY cid", ("f_ensemble",))
def column_mean_sigma(t: Tables):
    return rounded(V.column_mean_sigma(t.f_ensemble, ["cid"], "sigma"), "mean_sigma", shift=1.234e-9)


@query("ensemble_stats", """SELECT cid, k, ROUND(AVG(pred), 6) AS mean, ROUND(STDDEV_POP(pred), 6) AS epistemic, ROUND(AVG(sigma) - 1.234e-9, 6) AS aleatoric,
    ROUND(SQRT(POW(STDDEV_POP(pred), 2) + POW(AVG(sigma), 2) + 1e-12), 6) AS total FROM f_ensemble GROUP BY cid, k""", ("f_ensemble",))
def ensemble_stats(t: Tables):
    out = S.ensemble_stats(t.f_ensemble, ["cid", "k"], "pred", "sigma")
    return rounded(rounded(out, "mean", "epistemic", "total"), "aleatoric", shift=1.234e-9)


_EVAL_SQL = f"""e AS (SELECT day, depth, lat, (iy + ix) % 5 <> 0 AS valid, pred - 25e0 AS pt, obs - 25e0 AS tt, pred_sp - 34e0 AS ps, obs_sp - 34e0 AS ts, sigma, {_WEIGHT} AS w FROM f_pred),
byd AS (SELECT depth, SQRT(SUM(CASE WHEN valid THEN (pt - tt) * (pt - tt) END) / COUNT(CASE WHEN valid THEN 1 END)) AS rt, SQRT(SUM(CASE WHEN valid THEN (ps - ts) * (ps - ts) END) / COUNT(CASE WHEN valid THEN 1 END)) AS rs FROM e GROUP BY depth),
days AS (SELECT day, COALESCE(SUM(CASE WHEN valid THEN w * tt * tt END), 0) / GREATEST(COALESCE(SUM(CASE WHEN valid THEN w END), 0), 1e-6) AS m,
    COALESCE(SUM(CASE WHEN valid AND ABS(tt - pt) <= sigma THEN 1e0 END), 0) / GREATEST(COUNT(CASE WHEN valid THEN 1 END), 1e-6) AS c1,
    COALESCE(SUM(CASE WHEN valid AND ABS(tt - pt) <= 2 * sigma THEN 1e0 END), 0) / GREATEST(COUNT(CASE WHEN valid THEN 1 END), 1e-6) AS c2 FROM e GROUP BY day)"""


@query("split_eval_report", """SELECT COUNT(*) AS n_depths, ROUND(SUM(rt), 6) AS rmse_theta, ROUND(SUM(rs), 6) AS rmse_sp, ROUND(1 - AVG(rt * rt) / (SELECT AVG(m) FROM days), 6) AS css,
    ROUND(1 - (SELECT SUM(CASE WHEN valid THEN w * (pt - tt) * (pt - tt) END) / SUM(CASE WHEN valid THEN w * tt * tt END) FROM e), 6) AS css_consistent,
    ROUND((SELECT AVG(c1) FROM days), 6) AS coverage_1, ROUND((SELECT AVG(c2) FROM days), 6) AS coverage_2 FROM byd""", ("f_pred",), _EVAL_SQL)
def split_eval_report(t: Tables):
    df = t.f_pred.select(
        "day", "depth", "lat", ((F.col("iy") + F.col("ix")) % 5 != 0).alias("valid"), (F.col("pred") - 25.0).alias("pred_theta"), (F.col("obs") - 25.0).alias("true_theta"),
        (F.col("pred_sp") - 34.0).alias("pred_sp"), (F.col("obs_sp") - 34.0).alias("true_sp"), F.col("sigma").alias("sigma_theta"))
    out = S.split_eval_report(df, _axis(t), valid="valid")
    return rounded(out.select(
        F.size("by_depth").cast("bigint").alias("n_depths"), _total("rmse_theta"), _total("rmse_sp"), "css", "css_consistent", "coverage_1", "coverage_2"),
        "rmse_theta", "rmse_sp", "css", "css_consistent", "coverage_1", "coverage_2")


def _total(field: str):
    return F.aggregate("by_depth", F.lit(0.0), lambda a, x: a + x[field]).alias(field)


@query("nearest_std_depth", f"SELECT obs_id, {nearest_sql('depth')} AS bin FROM f_insitu", ("f_insitu",))
def nearest_std_depth(t: Tables):
    return t.f_insitu.select("obs_id", N.nearest_level(F.col("depth")).alias("bin"))


@query("dt_bin", """SELECT COALESCE(CASE WHEN h <= 12 THEN 'dt_0d' WHEN h <= 36 THEN 'dt_1d' WHEN h <= 60 THEN 'dt_2d' END, 'none') AS dt_bin, COUNT(*) AS n FROM (SELECT o_orderkey % 150 / 2e0 AS h FROM orders) GROUP BY 1""")
def dt_bin(t: Tables):
    h = F.col("o_orderkey") % 150 / 2.0
    return t.orders.groupBy(F.coalesce(C.dt_bin(h), F.lit("none")).alias("dt_bin")).agg(F.count(F.lit(1)).alias("n"))
