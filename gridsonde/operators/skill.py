"""Skill scores. Everything is a distributive aggregate, so partial sums combine before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridsonde import constants as K
from gridsonde.functions.numeric import finite, nearest_level, unit
from gridsonde.functions.physics import latitude_weight


def _pair(pred: Column, obs: Column, c: Column) -> Column:
    return F.when(pred.isNotNull() & obs.isNotNull(), c)


def rmse(pred: Column, obs: Column) -> Column:
    return F.sqrt(mse(pred, obs))


def mse(pred: Column, obs: Column) -> Column:
    d = pred - obs
    return F.avg(d * d)


def mean_bias(pred: Column, obs: Column) -> Column:
    return F.avg(pred - obs)


def pearson(pred: Column, obs: Column) -> Column:
    """Correlation of complete pairs; NULL for fewer than three or without spread.

    Built from moments because ``corr`` itself divides by zero on constant groups in ANSI mode.
    """
    p, o = _pair(pred, obs, pred), _pair(pred, obs, obs)
    n = F.count(p)
    spread = F.sqrt(F.var_pop(p) * F.var_pop(o))
    return F.when((n >= 3) & (spread * n >= 1e-12), F.covar_pop(p, o) / spread)


def climatology_skill(mse_model: Column, mse_clim: Column) -> Column:
    """1 - model error / climatology error; NULL unless the latter is positive."""
    return F.when(finite(mse_model).isNotNull() & (finite(mse_clim) > 0), 1.0 - mse_model / mse_clim)


def thermocline_skill(by_depth: DataFrame, depth: str = "depth", css: str = "css", need: float = 0.40) -> DataFrame:
    """Mean skill of the 50-200 m levels and whether it reaches the pass mark."""
    mean = F.avg(F.when(F.col(depth).between(50.0, 200.0), F.col(css)))
    return by_depth.agg(mean.alias("mean_css"), (mean >= need).alias("passed"))


def brier(probability: Column, truth: Column) -> Column:
    d = unit(probability) - unit(truth)
    return F.avg(d * d)


def skill_by(df: DataFrame, names: Sequence[str], pred: str = "pred", obs: str = "obs", depth: str = "depth",
             clim: str | None = None, levels: Sequence[float] = K.STANDARD_DEPTHS) -> DataFrame:
    """RMSE, bias and correlation per nearest standard depth and overall (``depth`` NULL), per name.

    One GROUPING SETS aggregation gives both. All levels are listed; ``n`` counts known
    predictions, ``n_pairs`` complete pairs. With ``clim`` the skill against it is added.
    """
    p, o = finite(F.col(pred)), finite(F.col(obs))
    cols = [*[F.col(n) for n in names], nearest_level(F.col(depth), levels).alias("__bin"), p.alias("p"), o.alias("o")]
    if clim:
        cols.append(finite(F.col(clim)).alias("c"))
    rows = df.select(*cols)
    p, o = F.col("p"), F.col("o")
    aggs = [F.grouping("__bin").alias("__all"), F.count(p).alias("n"), F.count(_pair(p, o, p)).alias("n_pairs"),
            rmse(p, o).alias("rmse"), mean_bias(p, o).alias("bias"), pearson(p, o).alias("pearson_r")]
    if clim:
        aggs.append(climatology_skill(mse(p, o), mse(F.col("c"), o)).alias("css"))
    sets = rows.groupingSets([[*names, "__bin"], list(names)], *names, "__bin").agg(*aggs)
    metrics = ["n", "n_pairs", "rmse", "bias", "pearson_r", *(["css"] if clim else [])]
    # The total row of each name lists all levels; measured levels are folded in by one small regrouping.
    total = F.array(F.struct(F.lit(None).cast("double").alias("d"), F.lit(True).alias("own")),
                    *[F.struct(F.lit(float(z)).alias("d"), F.lit(False).alias("own")) for z in levels])
    level = F.array(F.struct(F.col("__bin").alias("d"), F.lit(True).alias("own")))
    spread = sets.filter((F.col("__all") == 1) | F.col("__bin").isNotNull()).select(
        "*", F.explode(F.when(F.col("__all") == 1, total).otherwise(level)).alias("__s"))
    own = F.col("__s")["own"]
    return spread.groupBy(*names, F.col("__s")["d"].alias("depth")).agg(*[
        (F.coalesce(F.max(F.when(own, F.col(m))), F.lit(0)) if m in ("n", "n_pairs") else F.max(F.when(own, F.col(m)))).alias(m)
        for m in metrics])


def cube_skill(df: DataFrame, names: Sequence[str] = (), valid: str | None = None, **columns) -> DataFrame:
    """Depth-wise skill of a gridded cube where it is valid; without a mask where both are known."""
    pred, obs = F.col(columns.get("pred", "pred")), F.col(columns.get("obs", "obs"))
    keep = F.col(valid) if valid else finite(pred).isNotNull() & finite(obs).isNotNull()
    return skill_by(df.filter(keep), names, **columns)


def inversion_events(df: DataFrame, keys: Sequence[str], depth: str, values: Sequence[str], eps: float = 0.05) -> DataFrame:
    """Per column and value: does it warm downwards by more than ``eps`` between two levels?"""
    w = Window.partitionBy(*keys).orderBy(depth)
    steps = df.select(*keys, *[(F.lead(v).over(w) - F.col(v) > eps).alias(v) for v in values])
    return steps.groupBy(*keys).agg(*[F.coalesce(F.bool_or(v), F.lit(False)).alias(v) for v in values])


def inversion_brier(df: DataFrame, keys: Sequence[str], depth: str, pred: str, obs: str, eps: float = 0.05) -> DataFrame:
    named = df.select(*keys, depth, F.col(pred).alias("__p"), F.col(obs).alias("__o"))
    events = inversion_events(named, keys, depth, ["__p", "__o"], eps)
    return events.agg(brier(F.col("__p").cast("double"), F.col("__o").cast("double")).alias("brier"),
                      F.count(F.lit(1)).alias("n_columns"))


def inversion_penalty(df: DataFrame, keys: Sequence[str], depth: str, theta: str, sp: str, valid: Column | None = None,
                      eps: float = 0.05, ds: float = 0.15) -> DataFrame:
    """Mean warming beyond ``eps`` per valid level pair, not counting salinity-capped pairs.

    ``plain`` is the unmasked variant: the mean positive step.
    """
    w = Window.partitionBy(*keys).orderBy(depth)
    ok = F.lit(True) if valid is None else F.coalesce(valid, F.lit(False))
    rows = df.select(*keys, depth, F.col(theta).alias("t"), F.col(sp).alias("s"), ok.alias("ok"))
    steps = rows.select(
        (F.col("t") - F.lag("t").over(w)).alias("dt"), (F.col("s") - F.lag("s").over(w)).alias("ds"),
        (F.col("ok") & F.lag("ok").over(w)).alias("pair"))
    relu = F.greatest(F.col("dt") - eps, F.lit(0.0))
    illegal = F.when(F.col("pair"), F.when(F.col("ds") > ds, F.lit(0.0)).otherwise(relu))
    n = F.count_if(F.col("pair")).cast("double")
    return steps.filter(F.col("dt").isNotNull()).agg(
        (F.coalesce(F.sum(illegal), F.lit(0.0)) / F.greatest(n, F.lit(1e-6))).alias("penalty"),
        F.avg(F.greatest(F.col("dt"), F.lit(0.0))).alias("plain"))


def area_weighted_mse(df: DataFrame, lat_axis: DataFrame, pred: str, obs: str, lat: str = "lat", valid: str | None = None,
                      keys: Sequence[str] = (), blend: float = 1.0, out: str = "mse") -> DataFrame:
    """Squared error weighted by cos(latitude) over its mean on the latitude *axis*.

    ``blend`` 1 is pure area weighting, 0 uniform. The axis mean is one scalar subquery.
    """
    mean = lat_axis.agg(F.greatest(F.avg(latitude_weight(F.col(lat))), F.lit(1e-6)).alias("m")).scalar()
    area = latitude_weight(F.col(lat)) / mean * blend + (1.0 - blend)
    d = F.col(pred) - F.col(obs)
    weight = F.greatest(area, F.lit(0.0))
    if valid:
        weight = F.when(F.col(valid), weight).otherwise(F.lit(0.0))
    rows = df.select(*keys, weight.alias("w"), (d * d).alias("se"))
    sums = rows.groupBy(*keys).agg(F.sum(F.col("w") * F.coalesce("se", F.lit(0.0))).alias("__n"), F.sum("w").alias("__d"))
    return sums.select(*keys, (F.col("__n") / F.greatest(F.col("__d"), F.lit(1e-6))).alias(out))


def masked_depth_rmse(df: DataFrame, pred: str, obs: str, depth: str = "depth", valid: str | None = None,
                      keys: Sequence[str] = (), out: str = "rmse") -> DataFrame:
    d = F.col(pred) - F.col(obs)
    ok = F.col(valid) if valid else F.lit(True)
    sums = df.groupBy(*keys, depth).agg(F.sum(F.when(ok, d * d)).alias("__n"), F.count_if(ok).cast("double").alias("__d"))
    return sums.select(*keys, depth, F.sqrt(F.coalesce("__n", F.lit(0.0)) / F.greatest(F.col("__d"), F.lit(1e-6))).alias(out))


def score_state(df: DataFrame, lat_axis: DataFrame, pred: str, obs: str, depth: str = "depth", lat: str = "lat", valid: str | None = None,
                keys: Sequence[str] = ()) -> DataFrame:
    """Sums and counts per key and level, from which scores of any union of batches follow: n, se, w, w_se.

    One partial aggregate; the state has a row per key and level however large the batch is. The axis mean of the
    weights belongs to the grid, so it is the same for every batch.
    """
    mean = lat_axis.agg(F.greatest(F.avg(latitude_weight(F.col(lat))), F.lit(1e-6)).alias("m")).scalar()
    ok = F.coalesce(F.col(valid), F.lit(False)) if valid else F.lit(True)
    d = F.col(pred) - F.col(obs)
    weight = F.when(ok, F.greatest(latitude_weight(F.col(lat)) / mean, F.lit(0.0))).otherwise(F.lit(0.0))
    rows = df.select(*keys, depth, ok.cast("double").alias("n"), F.when(ok, d * d).alias("se"), weight.alias("w"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.groupBy(*keys, depth).agg(F.sum("n").alias("n"), zero(F.sum("se")).alias("se"), F.sum("w").alias("w"),
                                          zero(F.sum(F.col("w") * F.col("se"))).alias("w_se"))


def store_state(state: DataFrame, path: str, batch: str) -> str:
    """Keep the state of one batch; a batch stored again replaces itself, so that a retried job counts once."""
    rows = state.withColumn("batch", F.lit(batch)).hint("rebalance")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)
    return path


def merged_states(states: DataFrame, keys: Sequence[str] = (), depth: str = "depth") -> DataFrame:
    """The state of all batches together; merged states can be merged again."""
    return states.groupBy(*keys, depth).agg(*[F.sum(c).alias(c) for c in ("n", "se", "w", "w_se")])


def scores_of_state(state: DataFrame, keys: Sequence[str] = (), depth: str = "depth") -> DataFrame:
    """Masked RMSE and area-weighted squared error per key and level, as of all rows at once."""
    at_least = lambda c: F.greatest(F.col(c), F.lit(1e-6))
    return state.select(*keys, depth, F.sqrt(F.col("se") / at_least("n")).alias("rmse"), (F.col("w_se") / at_least("w")).alias("mse"))


def coverage_share(pred: Column, obs: Column, sigma: Column, k: float, valid: Column | None = None) -> Column:
    """Aggregate: share of valid cells whose error is within ``k`` spreads."""
    inside = F.coalesce((F.abs(obs - pred) <= sigma * k).cast("double"), F.lit(0.0))
    if valid is None:
        return F.avg(inside)
    n = F.greatest(F.count_if(valid).cast("double"), F.lit(1e-6))
    return F.coalesce(F.sum(F.when(valid, inside)), F.lit(0.0)) / n


def ensemble_stats(df: DataFrame, keys: Sequence[str], pred: str, sigma: str) -> DataFrame:
    """Mean, epistemic and aleatoric spread of repeated predictions and their total."""
    s = df.groupBy(*keys).agg(F.avg(pred).alias("mean"), F.stddev_pop(pred).alias("epistemic"), F.avg(sigma).alias("aleatoric"))
    e, a = F.col("epistemic"), F.col("aleatoric")
    return s.withColumn("total", F.sqrt(e * e + a * a + 1e-12))


def gaussian_nll(pred: Column, log_sigma: Column, target: Column) -> Column:
    z = (pred - target) / F.exp(log_sigma)
    return F.avg(z * z * 0.5 + log_sigma)


def slice_error(df: DataFrame, pred: str, obs: str, keys: Sequence[str] = ("depth",)) -> DataFrame:
    d = F.abs(F.col(pred) - F.col(obs))
    return df.groupBy(*keys).agg(F.avg(d).alias("mean_abs"), F.max(d).alias("max_abs"), rmse(F.col(pred), F.col(obs)).alias("rmse"))


def split_eval_report(df: DataFrame, lat_axis: DataFrame, frame: str = "day", depth: str = "depth", lat: str = "lat",
                      valid: str | None = None) -> DataFrame:
    """Roll-up of residual predictions: per-depth errors, skill against zero, coverage.

    Columns of ``df``: pred_theta, true_theta, pred_sp, true_sp, sigma_theta. ``css`` divides the
    unweighted mean over depths by the mean over frames of the area-weighted error of predicting
    zero, as published; ``css_consistent`` uses area weighting and pooling for both.
    """
    mean = lat_axis.agg(F.greatest(F.avg(latitude_weight(F.col(lat))), F.lit(1e-6)).alias("m")).scalar()
    ok = F.col(valid) if valid else F.lit(True)
    p, t, sigma = F.col("pred_theta"), F.col("true_theta"), F.col("sigma_theta")
    d_t, d_s = p - t, F.col("pred_sp") - F.col("true_sp")
    rows = df.select(
        frame, depth, ok.cast("double").alias("n"), F.when(ok, latitude_weight(F.col(lat)) / mean).alias("w"),
        F.when(ok, d_t * d_t).alias("se_t"), F.when(ok, d_s * d_s).alias("se_s"), F.when(ok, t * t).alias("sq"),
        F.when(ok & (F.abs(d_t) <= sigma), 1.0).alias("in1"), F.when(ok & (F.abs(d_t) <= sigma * 2.0), 1.0).alias("in2"))
    # The only pass over the cube: sums per frame and depth, from which both views are small re-aggregations.
    cell = rows.groupBy(frame, depth).agg(
        *[F.sum(c).alias(c) for c in ("n", "w", "se_t", "se_s", "in1", "in2")],
        F.sum(F.col("w") * F.col("se_t")).alias("w_se"), F.sum(F.col("w") * F.col("sq")).alias("w_sq"))

    def total(c: str) -> Column:
        return F.coalesce(F.sum(c), F.lit(0.0))

    def share(num: str, den: str) -> Column:
        return total(num) / F.greatest(total(den), F.lit(1e-6))

    by_depth = cell.groupBy(depth).agg(F.sqrt(share("se_t", "n")).alias("rmse_theta"), F.sqrt(share("se_s", "n")).alias("rmse_sp"))
    by_frame = cell.groupBy(frame).agg(
        share("w_sq", "w").alias("clim"), share("in1", "n").alias("c1"), share("in2", "n").alias("c2"),
        total("w_se").alias("w_se"), total("w_sq").alias("w_sq"))
    depths = by_depth.select(
        F.struct(F.col(depth).alias("depth"), "rmse_theta", "rmse_sp").alias("level"),
        (F.col("rmse_theta") * F.col("rmse_theta")).alias("mse"))
    both = depths.unionByName(by_frame.drop(frame), allowMissingColumns=True)
    report = both.agg(
        F.sort_array(F.collect_list("level")).alias("by_depth"), F.avg("mse").alias("mse"), F.avg("clim").alias("clim"),
        F.avg("c1").alias("coverage_1"), F.avg("c2").alias("coverage_2"), F.sum("w_se").alias("w_se"), F.sum("w_sq").alias("w_sq"))
    return report.select(
        "by_depth", climatology_skill(F.col("mse"), F.col("clim")).alias("css"),
        climatology_skill(F.col("w_se"), F.col("w_sq")).alias("css_consistent"), "coverage_1", "coverage_2",
        F.lit(0.68).alias("nominal_1"), F.lit(0.95).alias("nominal_2"),
    )
