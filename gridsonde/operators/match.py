"""Nearest-space and nearest-time matching of scattered profiles with gridded columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridsonde import constants as K
from gridsonde.functions.calendar import dt_bin
from gridsonde.functions.numeric import nearest_index
from gridsonde.functions.physics import good_flag
from gridsonde.grid_spec import GridSpec
from gridsonde.operators.skill import skill_by
from gridsonde.operators.vertical import dedupe_levels, hermite_segments, packed_interval, probe

MICROS_PER_HOUR = 3600.0e6
_DAY_MICROS = 86400 * 1000000


def nearest_cell(df: DataFrame, spec: GridSpec, lat: str = "lat", lon: str = "lon",
                 max_radius: float | None = None, in_domain: bool = False) -> DataFrame:
    """Attach the nearest cell of a regular grid; optionally NULL outside the domain or the radius."""
    la, lo = F.col(lat), F.col(lon)
    iy = nearest_index(la, spec.lat_start, spec.resolution, spec.n_lat)
    ix = nearest_index(lo, spec.lon_start, spec.resolution, spec.n_lon)
    ok = la.isNotNull() & lo.isNotNull()
    if in_domain:
        ok = ok & la.between(spec.lat_start, spec.lat_last) & lo.between(spec.lon_start, spec.lon_last)
    out = df.withColumn("iy", iy).withColumn("ix", ix)
    if max_radius is not None:
        ok = ok & (F.abs(spec.lat() - la) <= max_radius) & (F.abs(spec.lon() - lo) <= max_radius)
    ok = F.coalesce(ok, F.lit(False))
    return out.withColumns({"iy": F.when(ok, F.col("iy")), "ix": F.when(ok, F.col("ix"))})


def nearest_on_axis(df: DataFrame, axis: DataFrame, value: str, index: str, centre: str, width: float = 1.0, out: str | None = None) -> DataFrame:
    """Attach the index of the nearest centre of an irregular axis, the lower centre on a tie; NULL for a NULL value.

    Every centre owns the stretch between its neighbours' midpoints and is listed under the buckets of ``width`` that
    it touches; values meet it by equi-join on their bucket, each exactly one. Values beyond the ends belong to the
    end centres. The axis is a dimension table.
    """
    own = axis.select(F.col(index).alias("__i"), F.col(centre).cast("double").alias("__c")).distinct()
    w = Window.orderBy("__c")
    first, last = own.agg(F.min("__c")).scalar(), own.agg(F.max("__c")).scalar()
    cells = own.select("__i", F.coalesce((F.lag("__c").over(w) + F.col("__c")) / 2, F.col("__c") - width).alias("__after"),
                       F.coalesce((F.lead("__c").over(w) + F.col("__c")) / 2, F.col("__c")).alias("__until"))
    bucket = lambda x: F.floor(x / width).cast("bigint")
    cells = cells.withColumn("__b", F.explode(F.sequence(bucket(F.col("__after")), bucket(F.col("__until")))))
    held = df.withColumn("__v", F.when(F.col(value).isNotNull(), F.least(F.greatest(F.col(value).cast("double"), first), last)))
    held = held.withColumn("__vb", bucket(F.col("__v")))
    inside = (F.col("__vb") == F.col("__b")) & (F.col("__v") > F.col("__after")) & (F.col("__v") <= F.col("__until"))
    return held.join(cells, inside, "left").select(*df.columns, F.col("__i").alias(out or index))


def time_cells(times: DataFrame, t: str, tolerance_hours: float, keys: Sequence[str] = ()) -> DataFrame:
    """The stretch of time each axis instant is the nearest one for, cut at the tolerance.

    Bounds are in doubled microseconds, so the midpoint of two instants is exact. The axis is a
    dimension table: one row per model time.
    """
    w = Window.partitionBy(*keys).orderBy("__t")
    axis = times.select(*keys, F.col(t).alias("t_model"), F.unix_micros(t).alias("__t")).distinct()
    reach = F.lit(int(tolerance_hours * MICROS_PER_HOUR)) * 2
    own = F.col("__t") * 2
    before = F.lag("__t").over(w) + F.col("__t")  # exclusive: a tie belongs to the earlier instant
    after = F.lead("__t").over(w) + F.col("__t")
    return axis.select(
        *keys, "t_model", "__t", F.greatest(F.coalesce(before, own - reach - 1), own - reach - 1).alias("__after"),
        F.least(F.coalesce(after, own + reach), own + reach).alias("__until"),
    )


def nearest_time(obs: DataFrame, times: DataFrame, ts: str, t: str, tolerance_hours: float = 60.0,
                 keys: Sequence[str] = (), bucket_micros: int = _DAY_MICROS) -> DataFrame:
    """Nearest model time of each observation within a tolerance, the earlier one on a tie.

    Every model time owns one stretch of the time line; it is listed under the time buckets it
    touches and observations meet it by equi-join on their bucket, each matching at most one. The
    axis side is small; a hot bucket of observations is split by AQE's skew join or, when the axis
    is broadcast, never shuffled. Observations without a match keep NULL.
    """
    cells = time_cells(times, t, tolerance_hours, keys)
    span = 2 * bucket_micros
    cells = cells.withColumn("__b", F.explode(F.sequence(
        F.floor(F.col("__after") / span).cast("bigint"), F.floor(F.col("__until") / span).cast("bigint"))))
    o = obs.withColumn("__o", F.unix_micros(F.col(ts).cast("timestamp")))
    o = o.withColumn("__ob", F.floor(F.col("__o") * 2 / span).cast("bigint"))
    joined = o.alias("o").join(
        cells.alias("c"),
        (F.col("o.__ob") == F.col("c.__b")) & (F.col("o.__o") * 2 > F.col("c.__after"))
        & (F.col("o.__o") * 2 <= F.col("c.__until"))
        & _all_equal(keys),
        "left",
    )
    dt = F.abs(F.col("c.__t") - F.col("o.__o")) / F.lit(MICROS_PER_HOUR)
    return joined.select(*[F.col(f"o.{c}") for c in obs.columns], F.col("c.t_model").alias("t_model"), dt.alias("dt_hours"))


def _all_equal(keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & (F.col(f"o.{k}") == F.col(f"c.{k}"))
    return cond


def qc_filter(levels: DataFrame, keys: Sequence[str], position_flag: str = "position_qc", time_flag: str = "time_qc",
              temp_flag: str = "temp_qc", pres_flag: str = "pres_qc", psal_flag: str = "psal_qc", depth: str = "depth",
              temp: str = "temp", psal: str = "psal", min_levels: int = 3) -> DataFrame:
    """Quality control of level rows.

    Bad position or time drops the profile; bad temperature or pressure clears temperature and
    depth; bad salinity clears salinity; profiles with fewer than three temperatures are dropped.
    The count is an aggregate joined back (map-side combined), so a huge profile is not one task.
    """
    good = good_flag(F.col(temp_flag)) & good_flag(F.col(pres_flag))
    kept = levels.filter(good_flag(F.col(position_flag)) & good_flag(F.col(time_flag))).withColumns({
        temp: F.when(good, F.col(temp)), depth: F.when(good, F.col(depth)),
        psal: F.when(good_flag(F.col(psal_flag)), F.col(psal)),
    })
    enough = kept.groupBy(*keys).agg(F.count(temp).alias("__n")).filter(F.col("__n") >= min_levels).select(*keys)
    return kept.join(enough, list(keys), "left_semi")


def min_depth_guard(levels: DataFrame, depth: str = "depth", limit: float = K.MIN_INSITU_DEPTH) -> DataFrame:
    return levels.filter(F.col(depth) >= limit)


def shallow_count(levels: DataFrame, depth: str = "depth", temp: str = "temp", limit: float = K.MIN_INSITU_DEPTH) -> DataFrame:
    return levels.agg(F.count_if((F.col(depth) < limit) & F.col(temp).isNotNull()).alias("n_shallow"),
                      F.count_if(F.col(depth) >= limit).alias("n_kept"))


def packed_columns(df: DataFrame, keys: Sequence[str], depth: str, values: Sequence[str], need: int = 2,
                   levels: bool = False, unique: bool = False) -> DataFrame:
    """Columns as one row each with an interval array ``<value>_profile`` per variable.

    Variables may be missing at different levels, so each is interpolated on its own: they become
    rows of one interpolation, and since that stays partitioned by column, one shuffle serves all.
    A variable known at fewer than ``need`` levels has an empty array. ``levels`` adds the given
    levels themselves as an array; it is built on the same partitioning.
    """
    rows = df.select(*keys, F.col(depth).alias("z"), *values)
    keyed = (rows if unique else dedupe_levels(rows, keys, "z", values)).repartition(*keys)
    item = F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).alias("v")) for v in values]))
    long = keyed.select(*keys, "z", item.alias("__i")).select(*keys, "z", "__i.*")
    segs = hermite_segments(long, [*keys, "variable"], "z", ["v"])
    usable = F.col("z1").isNotNull() & (F.col("n") >= need)
    interval = packed_interval(["v"])
    out = segs.groupBy(*keys).agg(*[
        F.sort_array(F.collect_list(F.when(usable & (F.col("variable") == v), interval))).alias(f"{v}_profile")
        for v in values])
    if levels:
        given = keyed.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col("z").alias("depth"), *values))).alias("levels"))
        out = given.join(out, list(keys), "left")
    return out


def argo_match(levels: DataFrame, model: DataFrame, spec: GridSpec, ts: str = "ts", t_model: str = "t_model",
               max_radius: float = K.MATCH_RADIUS_DEG, unique: bool = False, times: DataFrame | None = None) -> DataFrame:
    """Status of every in-situ level and, for ``pair`` rows, model values at its depth.

    ``levels``: profile_id, ts, lat, lon, depth, temp, psal. ``model``: t_model, iy, ix, depth,
    theta, sp. Status is far, time, no_model, shallow, missing or pair. Space is closed form, time
    a bucketed equi-join, the model column an equi-join on (time, cell) with one packed row.
    ``unique`` promises one model row per time, cell and depth; ``times`` is the model's time axis, if at hand.
    """
    placed = nearest_cell(levels, spec, max_radius=max_radius, in_domain=True)
    times = model.select(t_model) if times is None else times
    none = F.lit(None)
    # Levels out of the domain or the tolerance need no model column: they stay out of the joins.
    far = placed.filter(F.col("iy").isNull()).withColumns({"t_model": none.cast("timestamp"), "dt_hours": none.cast("double")})
    timed = nearest_time(placed.filter(F.col("iy").isNotNull()), times, ts, t_model)
    late = timed.filter(F.col("t_model").isNull()).select(far.columns).unionByName(far)
    timed = timed.filter(F.col("t_model").isNotNull())
    # Only the columns that observations touch are shuffled, sorted and packed.
    source = model.withColumnRenamed(t_model, "t_model")
    touched = timed.select("t_model", "iy", "ix").distinct()
    columns = packed_columns(source.join(touched, ["t_model", "iy", "ix"], "left_semi"), ["t_model", "iy", "ix"], "depth", ["theta", "sp"],
                             need=3, unique=unique)
    joined = timed.join(columns, ["t_model", "iy", "ix"], "left").unionByName(late, allowMissingColumns=True)
    joined = joined.withColumn("dt_bin", dt_bin(F.col("dt_hours")))
    z = F.col("depth")
    usable = F.coalesce(F.size("theta_profile"), F.lit(0)) > 0
    status = (
        F.when(F.col("iy").isNull(), "far")
        .when(F.col("dt_bin").isNull(), "time")
        .when(~usable, "no_model")
        .when(F.col("temp").isNotNull() & (z < K.MIN_INSITU_DEPTH), "shallow")
        .when(F.col("temp").isNull() | z.isNull() | (z < K.MIN_INSITU_DEPTH), "missing")
        .otherwise("pair")
    )
    rows = joined.withColumn("status", status)
    pair = F.col("status") == "pair"
    return rows.select(
        *levels.columns, "iy", "ix", "t_model", "dt_hours", "dt_bin", "status",
        F.when(pair, probe(F.col("theta_profile"), "v", z)).alias("temp_model"),
        F.when(pair, probe(F.col("sp_profile"), "v", z)).alias("sp_model"),
    )


def argo_pairs(matched: DataFrame) -> DataFrame:
    return matched.filter(F.col("status") == "pair").drop("status")


def argo_counters(matched: DataFrame, profile: str = "profile_id") -> DataFrame:
    """Pairs, shallow samples, and profiles skipped for distance or time."""
    def profiles(name: str) -> Column:
        return F.countDistinct(F.when(F.col("status") == name, F.col(profile)))

    return matched.agg(
        profiles("far").alias("skipped_far"), profiles("time").alias("skipped_time"),
        F.count_if(F.col("status") == "shallow").alias("skipped_shallow"),
        F.count_if(F.col("status") == "pair").alias("n_pairs"),
    )


def mooring_match(mooring: DataFrame, model: DataFrame, spec: GridSpec, sensor_depths: Sequence[float] = K.MOORING_SENSOR_DEPTHS,
                  tolerance_hours: float = K.MOORING_TOLERANCE_HOURS, unique: bool = False, times: DataFrame | None = None) -> DataFrame:
    """Mooring records against model columns, in both interpolation directions.

    ``mooring``: site, ts, lat, lon, depth, temp, psal. ``model``: t_model, iy, ix, depth, theta,
    sp. ``model_to_mooring`` samples both at the sensor depths, ``mooring_to_standard`` both at the
    model levels; a record with fewer than three known levels gives NULL observations.
    """
    records = mooring.select("site", "ts", "lat", "lon").distinct()
    placed = nearest_time(nearest_cell(records, spec), model.select("t_model") if times is None else times, "ts", "t_model", tolerance_hours)
    placed = placed.filter(F.col("t_model").isNotNull()).select("site", "ts", "iy", "ix", "t_model")
    known = mooring.filter(F.col("depth").isNotNull())
    # Only known levels take part, so a record counts as complete and is extended above its first sensor.
    long = known.select("site", "ts", "depth", F.explode(F.array(*[
        F.struct(F.lit(v).alias("variable"), F.col(v).alias("v")) for v in ("temp", "psal")])).alias("__i"))
    long = long.select("site", "ts", "depth", "__i.*").filter(F.col("v").isNotNull())
    long = dedupe_levels(long, ["site", "ts", "variable"], "depth", ["v"]).repartition("site", "ts")
    segs = hermite_segments(long, ["site", "ts", "variable"], "depth", ["v"])
    usable = F.col("z1").isNotNull() & (F.col("n") >= 3)
    interval = packed_interval(["v"])
    obs = segs.groupBy("site", "ts").agg(*[
        F.sort_array(F.collect_list(F.when(usable & (F.col("variable") == v), interval))).alias(f"{v}_obs")
        for v in ("temp", "psal")])
    touched = model.join(placed.select("t_model", "iy", "ix").distinct(), ["t_model", "iy", "ix"], "left_semi")
    columns = packed_columns(touched, ["t_model", "iy", "ix"], "depth", ["theta", "sp"], levels=True, unique=unique)
    joined = placed.join(obs, ["site", "ts"], "left").join(columns, ["t_model", "iy", "ix"], "left")
    none = F.lit(None).cast("double")
    forward, backward = F.lit("model_to_mooring"), F.lit("mooring_to_standard")
    sensors = F.array(*[F.struct(F.lit(float(z)).alias("depth"), none.alias("theta"), none.alias("sp"), forward.alias("direction"))
                        for z in sensor_depths])
    standard = F.transform("levels", lambda x: F.struct(
        x["depth"].alias("depth"), x["theta"].alias("theta"), x["sp"].alias("sp"), backward.alias("direction")))

    def result(q: Column) -> Column:
        """All values of one depth; evaluated beside the profiles, so that only small rows are exploded."""
        z, to_sensor = q["depth"], q["direction"] == forward

        def model_value(level: str) -> Column:
            return F.when(to_sensor, probe(F.col(f"{level}_profile"), "v", z)).otherwise(q[level])

        return F.struct(z.alias("depth"), model_value("theta").alias("temp_model"), probe(F.col("temp_obs"), "v", z).alias("temp_obs"),
                        model_value("sp").alias("sp_model"), probe(F.col("psal_obs"), "v", z).alias("sp_obs"), q["direction"].alias("direction"))

    depths = F.coalesce(F.concat(sensors, standard), sensors)
    # The array is never empty; the outer form keeps the optimiser from computing it a second time to find out.
    return joined.select("site", "ts", F.explode_outer(F.transform(depths, result)).alias("__q")).select("site", "ts", "__q.*")


def skill_by_dt(pairs: DataFrame) -> DataFrame:
    """Depth-wise scores per time-distance class and variable."""
    return skill_by(_two_variables(pairs, "temp_model", "temp", "sp_model", "psal"), ["dt_bin", "variable"])


def mooring_skill(matched: DataFrame) -> DataFrame:
    """Depth-wise scores per direction and variable."""
    return skill_by(_two_variables(matched, "temp_model", "temp_obs", "sp_model", "sp_obs"), ["direction", "variable"])


def _two_variables(df: DataFrame, theta: str, theta_obs: str, sp: str, sp_obs: str) -> DataFrame:
    """Temperature and salinity as rows (variable, pred, obs)."""
    pair = F.explode(F.array(
        F.struct(F.lit("theta").alias("variable"), F.col(theta).alias("pred"), F.col(theta_obs).alias("obs")),
        F.struct(F.lit("sp").alias("variable"), F.col(sp).alias("pred"), F.col(sp_obs).alias("obs"))))
    rest = [c for c in df.columns if c not in (theta, theta_obs, sp, sp_obs)]
    return df.select(*rest, pair.alias("__p")).select(*rest, "__p.*")


def surface_match(pred: DataFrame, obs: DataFrame, on: Sequence[str] = ("day", "iy", "ix"), valid: str | None = None) -> DataFrame:
    """Score the 0 m level against an independent surface product."""
    joined = pred.join(obs, list(on))
    if valid:
        joined = joined.filter(F.col(valid))
    return skill_by(joined.withColumn("depth", F.lit(0.0)), [])


def point_lookup(stations: DataFrame, cube: DataFrame, mask: DataFrame, spec: GridSpec, depth: str = "depth",
                 values: Sequence[str] = ("theta", "sp"), on: Sequence[str] = ("iy", "ix"), land: str = "land") -> DataFrame:
    """All levels of the column nearest to each station, as an array; stations on land are dropped."""
    ids = stations.columns
    placed = nearest_cell(stations, spec)
    sea = mask.filter(~F.coalesce(F.col(land), F.lit(False))).select("iy", "ix")
    placed = placed.join(sea, ["iy", "ix"], "left_semi")
    touched = cube.join(placed.select(*on).distinct(), list(on), "left_semi")
    columns = touched.groupBy(*on).agg(F.sort_array(F.collect_list(F.struct(depth, *values))).alias("levels"))
    return placed.join(columns, list(on), "left").select(*ids, "iy", "ix", "levels")
