"""Water-column operators: shape-preserving interpolation, isotherms, mixed layer, heat content.

A *column* is the set of rows sharing ``keys``; its length is bounded by the number of distinct
depths. Everything here needs one shuffle on ``keys``: knot slopes come from ordered windows,
sampling explodes each knot interval inside the same stage, and the reductions group by the same
keys, so the (much longer) sampled profile is never shuffled, sorted or stored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridsonde import constants as K
from gridsonde.functions.numeric import finite, unit
from gridsonde.functions.physics import sigma_theta


def dedupe_levels(df: DataFrame, keys: Sequence[str], depth: str, values: Sequence[str],
                  order: str | None = None) -> DataFrame:
    """One row per column and depth; partial aggregation shrinks repeated copies before the shuffle.

    All values come from one row. ``order`` names the original position: the first row counts. Without it
    the first one in the order of the values does, those with the fewest missing before others, so that the
    result does not depend on row order.
    """
    whole = F.struct(*[F.col(v) for v in values])
    lacking = F.lit(0)
    for v in values:
        lacking = lacking + F.col(v).isNull().cast("int")
    kept = F.min_by(whole, F.struct(F.col(order), lacking, whole)) if order else F.min(F.struct(lacking.alias("__lacking"), whole.alias("v")))["v"]
    return df.groupBy(*keys, depth).agg(kept.alias("__kept")).select(*keys, depth, *[F.col("__kept")[v].alias(v) for v in values])


def _interior_slope(h0: Column, m0: Column, h1: Column, m1: Column) -> Column:
    """Weighted harmonic mean of the two secant slopes, zero at a local extremum."""
    w0, w1 = h1 * 2.0 + h0, h1 + h0 * 2.0
    return F.when(F.signum(m0) * F.signum(m1) <= 0, F.lit(0.0)).otherwise((w0 + w1) / (w0 / m0 + w1 / m1))


def _end_slope(h0: Column, m0: Column, h1: Column, m1: Column) -> Column:
    """Three-point slope at an end, limited so that the end piece stays monotone."""
    d = ((h0 * 2.0 + h1) * m0 - h0 * m1) / (h0 + h1)
    return (F.when(F.signum(d) != F.signum(m0), F.lit(0.0))
            .when((F.signum(m0) != F.signum(m1)) & (F.abs(d) > F.abs(m0) * 3.0), m0 * 3.0)
            .otherwise(d))


def spread_columns(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Shuffle by column key into the session's full number of shuffle partitions.

    Sampling multiplies rows after the shuffle (15 levels to 1001 metres), so partitions must not be
    merged by their small size before it, as adaptive execution would do.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def column_levels(df: DataFrame, keys: Sequence[str], depth: str, values: Sequence[str], unique: bool) -> DataFrame:
    """Level rows brought together by column, repeated depths merged beforehand unless ``unique``.

    A column's size is then bounded by its distinct depths, however often its rows are repeated.
    """
    rows = df.select(*keys, depth, *values)
    return spread_columns(rows if unique else dedupe_levels(rows, keys, depth, values), keys)


def hermite_segments(df: DataFrame, keys: Sequence[str], depth: str, values: Sequence[str],
                     min_levels: int = 3, carry: dict[str, Column] | None = None, expected: int | None = None) -> DataFrame:
    """Knot intervals of each column with the cubic of every value as ``<value>_seg``.

    ``values`` must be known at the same levels; levels where any is NULL or not finite are dropped.
    A column is *complete* when no level was dropped, nor any of ``expected`` levels is absent; it needs two
    levels, a partial one needs ``min_levels``. Each column keeps at least its first row; ``z1`` is NULL where there is no usable
    interval. Depths must be distinct within a column (:func:`column_levels`). ``carry`` adds
    whole-column aggregates of the input, evaluated in the same window pass.
    """
    wz = Window.partitionBy(*keys).orderBy("z0")
    w = wz.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # one sort serves both
    known = None
    for v in values:
        known = F.col(v).isNotNull() if known is None else known & F.col(v).isNotNull()
    known = known & F.col("z0").isNotNull()
    carry = carry or {}
    knots = (
        df.select(*keys, F.col(depth).cast("double").alias("z0"),
                  *[finite(F.col(c).cast("double")).alias(c) for c in df.columns if c not in keys and c != depth])
        .select("*", F.greatest(F.count(F.lit(1)).over(w), F.lit(expected or 0)).alias("n_all"), F.count_if(known).over(w).alias("n"),
                *[c.over(w).alias(name) for name, c in carry.items()])
        .filter(known)
    )
    z = F.col("z0")
    shifted = [F.lag(z, 1).over(wz).alias("__zp"), F.lag(z, 2).over(wz).alias("__zpp"),
               F.lead(z, 1).over(wz).alias("__zn"), F.lead(z, 2).over(wz).alias("__znn")]
    for v in values:
        c = F.col(v)
        shifted += [F.lag(c, 1).over(wz).alias(f"__{v}_p"), F.lag(c, 2).over(wz).alias(f"__{v}_pp"),
                    F.lead(c, 1).over(wz).alias(f"__{v}_n"), F.lead(c, 2).over(wz).alias(f"__{v}_nn")]
    base = [*keys, "z0", "n_all", "n", *carry, *values]
    k = knots.select(*base, *shifted)
    zp, zpp, zn, znn = (F.col(f"__{s}") for s in ("zp", "zpp", "zn", "znn"))
    slopes = []
    for v in values:
        c = F.col(v)
        p, pp, n, nn = (F.col(f"__{v}_{s}") for s in ("p", "pp", "n", "nn"))
        m_prev, m_next = (c - p) / (z - zp), (n - c) / (zn - z)
        m_prev2, m_next2 = (p - pp) / (zp - zpp), (nn - n) / (znn - zn)
        d = (
            F.when(zp.isNotNull() & zn.isNotNull(), _interior_slope(z - zp, m_prev, zn - z, m_next))
            .when(zn.isNotNull() & znn.isNotNull(), _end_slope(zn - z, m_next, znn - zn, m_next2))
            .when(zp.isNotNull() & zpp.isNotNull(), _end_slope(z - zp, m_prev, zp - zpp, m_prev2))
            .when(zn.isNotNull(), m_next)
            .when(zp.isNotNull(), m_prev)
        )
        slopes.append(d.alias(f"__{v}_d"))
    k = k.select(*base, "__zp", F.col("__zn").alias("z1"), "__znn", *[f"__{v}_n" for v in values], *slopes)
    k = k.select(*k.columns, *[F.lead(f"__{v}_d").over(wz).alias(f"__{v}_d1") for v in values])
    usable = (F.col("n") >= min_levels) | ((F.col("n") == F.col("n_all")) & (F.col("n") >= 2))
    h = F.col("z1") - z
    segs = []
    for v in values:
        m = (F.col(f"__{v}_n") - F.col(v)) / h
        d0, d1 = F.col(f"__{v}_d"), F.col(f"__{v}_d1")
        segs.append(F.struct(F.col(v).alias("y"), d0.alias("b"), ((m * 3.0 - d0 * 2.0 - d1) / h).alias("c"),
                             ((d0 + d1 - m * 2.0) / (h * h)).alias("d")).alias(f"{v}_seg"))
    first = F.col("__zp").isNull()
    return k.filter(F.col("z1").isNotNull() | first).select(
        *keys, *carry, "z0", F.when(usable, F.col("z1")).alias("z1"), first.alias("is_first"),
        F.col("__znn").isNull().alias("is_last"), (F.col("n") == F.col("n_all")).alias("complete"), "n", *segs,
    ).filter(F.col("z1").isNotNull() | F.col("is_first"))


def cubic(seg: Column, s: Column) -> Column:
    """The interval's polynomial ``s`` metres below its upper knot."""
    return seg["y"] + s * (seg["b"] + s * (seg["c"] + s * seg["d"]))


def pchip(df: DataFrame, keys: Sequence[str], depth: str, value: str | Sequence[str], step: float = 1.0,
          z_min: float = 0.0, z_max: float = K.PROFILE_DEPTH_MAX, out: str = "z", unique: bool = False) -> DataFrame:
    """Shape-preserving cubic interpolation onto the regular axis ``z_min, z_min+step .. z_max``.

    Several values known at the same levels are sampled together. Targets outside the known range
    give no row, except above the first level of a complete column, where the first cubic is extended.
    ``unique`` promises one row per column and depth and saves the merging of repeated levels.
    """
    values = [value] if isinstance(value, str) else list(value)
    segs = hermite_segments(column_levels(df, keys, depth, values, unique), keys, depth, values)
    low, high = _sample_range(step, z_min, z_max)
    sampled = segs.select(*keys, "z0", *[f"{v}_seg" for v in values], F.explode(
        F.when(low <= high, F.sequence(low, high))).alias("__i"))
    z = F.col("__i") * F.lit(float(step))
    return sampled.select(*keys, z.alias(out), *[cubic(F.col(f"{v}_seg"), z - F.col("z0")).alias(v) for v in values])


def _sample_range(step: float, z_min: float, z_max: float) -> tuple[Column, Column]:
    """First and last multiple of ``step`` that an interval answers for."""
    up = F.ceil(F.col("z0") / step)
    low = F.when(F.col("is_first") & F.col("complete"), F.ceil(F.lit(z_min / step))).otherwise(
        F.greatest(up, F.ceil(F.lit(z_min / step))))
    down = F.when(F.col("is_last"), F.floor(F.col("z1") / step)).otherwise(F.ceil(F.col("z1") / step) - 1)
    high = F.when(F.col("z1").isNotNull(), F.least(down, F.floor(F.lit(z_max / step))))
    return low.cast("int"), high.cast("int")


def packed_interval(values: Sequence[str]) -> Column:
    """One interval of a packed column; ``lo`` is where it starts to answer."""
    lo = F.when(F.col("is_first") & F.col("complete"), F.lit(-1.0e30)).otherwise(F.col("z0"))
    return F.struct("z0", "z1", lo.alias("lo"), "is_last", "complete", *[f"{v}_seg" for v in values])


def pack_segments(segs: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row per column with its intervals as an array ordered by depth (at most one per level).

    The compact form serves many probes per column: the probing side is joined on the column key
    and each probe is answered from the array, so a hot column can be split by AQE's skew join.
    """
    item = F.when(F.col("z1").isNotNull(), packed_interval(values))
    return segs.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("profile"))


def probe(profile: Column, value: str, z: Column) -> Column:
    """Value of a packed column at depth ``z``: NULL outside its range, extended above a complete one.

    The cubic is evaluated inside the lambda, so that the search runs once per probe.
    """
    hit = F.filter(profile, lambda s: (z >= s["lo"]) & ((z < s["z1"]) | (s["is_last"] & (z == s["z1"]))))
    return F.get(F.transform(hit, lambda s: cubic(s[f"{value}_seg"], z - s["z0"])), 0)


def pchip_levels(df: DataFrame, keys: Sequence[str], depth: str, value: str,
                 levels: Sequence[float] = K.STANDARD_DEPTHS, clamp_deep: bool = False,
                 unique: bool = False, expected: int | None = None) -> DataFrame:
    """Interpolation onto fixed levels, one row per column and level; ``expected`` as in :func:`hermite_segments`.

    Levels above the known range take the shallowest value, levels below it NULL; ``clamp_deep``
    keeps the deepest value for complete columns instead.
    """
    segs = hermite_segments(column_levels(df, keys, depth, [value], unique), keys, depth, [value], expected=expected)
    packed = pack_segments(segs, keys, [value])
    rows = packed.select(*keys, "profile", F.explode(F.array(*[F.lit(float(z)) for z in levels])).alias(depth))
    top = F.get("profile", 0)["z0"]
    z = F.greatest(F.col(depth), top)
    if clamp_deep:
        last = F.element_at("profile", -1)
        z = F.when(F.get("profile", 0)["complete"], F.least(z, last["z1"])).otherwise(z)
    out = F.when(F.size("profile") > 0, probe(F.col("profile"), value, z))
    return rows.select(*keys, depth, out.alias(value))


# --- indices of an already sampled profile -------------------------------------------------------


def _next_level(df: DataFrame, keys: Sequence[str], depth: str, values: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(depth)
    return df.select(
        *df.columns, F.lead(depth).over(w).alias("__zn"), *[F.lead(v).over(w).alias(f"__{v}_n") for v in values]
    )


def _fraction(top: Column, span: Column) -> Column:
    return F.when(F.abs(span) > 1e-12, unit(top / span)).otherwise(F.lit(0.0))


def _downward_crossing(v: Column, vn: Column, z: Column, zn: Column, target: float) -> Column:
    """Depth where a pair of levels passes from ``>= target`` to ``< target``; NULL otherwise."""
    frac = _fraction(v - target, v - vn)
    return F.when((v >= target) & (vn < target), z + frac * (zn - z))


def isotherm_depth(df: DataFrame, keys: Sequence[str], depth: str, value: str, targets: dict[str, float]) -> DataFrame:
    """First downward crossing of each target; the first known level if that is already colder.

    Missing levels must be present as NULL rows; pairs next to them do not count.
    """
    pairs = _next_level(df, keys, depth, [value])
    v, vn, z, zn = F.col(value), F.col(f"__{value}_n"), F.col(depth), F.col("__zn")
    known = pairs.withColumn("__known", F.when(v.isNotNull(), z))
    aggs = [F.min("__known").alias("__z_top"), F.min_by(v, F.col("__known")).alias("__v_top")]
    aggs += [F.min(_downward_crossing(v, vn, z, zn, t)).alias(f"__{name}") for name, t in targets.items()]
    per = known.groupBy(*keys).agg(*aggs)
    return per.select(*keys, *[
        F.when(F.col("__v_top") < t, F.col("__z_top")).otherwise(F.col(f"__{name}")).alias(name)
        for name, t in targets.items()
    ])


def _reference_value(df: DataFrame, keys: Sequence[str], depth: str, value: str, z_ref: float) -> DataFrame:
    """Attach the value at the level nearest to ``z_ref`` and that level; NULL if too far away."""
    off = F.abs(F.col(depth) - z_ref)
    candidate = F.struct(off.alias("off"), F.col(depth).alias("z"), F.col(value).alias("v"))
    near = F.min(F.when(off <= K.REFERENCE_DEPTH_TOLERANCE, candidate))  # the shallower level on a tie
    return df.withColumn("__ref", near.over(Window.partitionBy(*keys)))


def mixed_layer_depth(df: DataFrame, keys: Sequence[str], depth: str, rho: str, drho: float = K.MIXED_LAYER_DRHO,
                      z_ref: float = K.REFERENCE_DEPTH, out: str = "mld") -> DataFrame:
    """First level at or below ``z_ref`` that is denser than there by ``drho``, interpolated."""
    pairs = _next_level(_reference_value(df, keys, depth, rho, z_ref), keys, depth, [rho])
    ref = F.col("__ref")
    a0, a1 = F.col(rho) - ref["v"], F.col(f"__{rho}_n") - ref["v"]
    frac = _fraction(F.lit(drho) - a0, a1 - a0)
    crossing = F.when((F.col("__zn") >= ref["z"]) & (a1 >= drho), F.col(depth) + frac * (F.col("__zn") - F.col(depth)))
    return pairs.groupBy(*keys).agg(F.min(crossing).alias(out))


def isothermal_layer_depth(df: DataFrame, keys: Sequence[str], depth: str, ct: str, dt: float = K.ISOTHERMAL_LAYER_DT,
                           z_ref: float = K.REFERENCE_DEPTH, out: str = "ild") -> DataFrame:
    """First level at or below ``z_ref`` that is colder than there by ``dt``, interpolated."""
    pairs = _next_level(_reference_value(df, keys, depth, ct, z_ref), keys, depth, [ct])
    target = F.col("__ref")["v"] - dt
    t0, t1 = F.col(ct), F.col(f"__{ct}_n")
    frac = _fraction(t0 - target, t0 - t1)
    crossing = F.when((F.col("__zn") >= F.col("__ref")["z"]) & (t1 <= target),
                      F.col(depth) + frac * (F.col("__zn") - F.col(depth)))
    return pairs.groupBy(*keys).agg(F.min(crossing).alias(out))


def barrier_thickness(ild: Column, mld: Column, mean_sigma: Column | None = None) -> Column:
    """ILD minus MLD where positive; NULL where the salinity spread is too large."""
    blt = F.when(ild > mld, ild - mld)
    return blt if mean_sigma is None else F.when(mean_sigma <= K.BARRIER_SIGMA_MAX, blt)


def heat_potential(df: DataFrame, keys: Sequence[str], depth: str, ct: str, rho: str, out: str = "tchp") -> DataFrame:
    """Heat above 26 degrees down to that isotherm, kJ/cm2; NULL if the column stays warmer."""
    pairs = _next_level(df, keys, depth, [ct, rho])
    v, vn, z, zn = F.col(ct), F.col(f"__{ct}_n"), F.col(depth), F.col("__zn")
    w = Window.partitionBy(*keys)
    known = F.when(v.isNotNull(), z)
    d26 = F.when(F.min_by(v, known).over(w) < K.HEAT_ISOTHERM, F.min(known).over(w)).otherwise(
        F.min(_downward_crossing(v, vn, z, zn, K.HEAT_ISOTHERM)).over(w))
    layer = _heat_layer(v, vn, F.col(rho), F.col(f"__{rho}_n"), zn - z)
    per = pairs.withColumn("__d26", d26).groupBy(*keys).agg(
        F.max("__d26").alias("__d26"), F.sum(F.when((z + zn) / 2.0 <= F.col("__d26"), layer)).alias("__e"))
    return per.select(*keys, F.when(F.col("__d26").isNotNull(), F.coalesce("__e", F.lit(0.0))
                                    * K.KJ_CM2_PER_J_M2).alias(out))


def _heat_layer(v: Column, vn: Column, rho: Column, rho_n: Column, dz: Column) -> Column:
    """Energy of one layer in J/m2, NULL when a value is missing."""
    def excess(t: Column) -> Column:
        return F.when(t.isNotNull(), F.greatest(t - K.HEAT_ISOTHERM, F.lit(0.0)))

    return (rho + rho_n) / 2.0 * K.HEAT_CAPACITY * (excess(v) + excess(vn)) / 2.0 * dz


# --- fused index chain ----------------------------------------------------------------------------

INDICES = ("d26", "z20", "mld", "ild", "blt", "tchp")


def column_indices(df: DataFrame, keys: Sequence[str], depth: str, ct: str, rho: str, sigma_sp: str | None = None,
                   z_max: float = K.PROFILE_DEPTH_MAX, unique: bool = False, wanted: Sequence[str] = INDICES,
                   expected: int | None = None) -> DataFrame:
    """TCHP, MLD, Z20, ILD, BLT and D26 of every column on the 1 m axis, in one shuffle and one sort.

    ``wanted`` names the indices to return; metres are sampled only as far as those need. ``expected`` is the
    number of levels of a complete column, if absent levels are to count as missing.

    Each interval evaluates its own metre samples and pairs its first one with the last sample of the
    interval above, carried down by a running window over the knots. Because an interval is monotone,
    its end samples tell whether a search has ended there, so deeper ones are not sampled at all.
    """
    level_known = finite(F.col(ct)).isNotNull() & finite(F.col(rho)).isNotNull()
    src = df.select(*keys, depth, F.when(level_known, F.col(ct)).alias("ct"), F.when(level_known, F.col(rho)).alias("rho"),
                    *([F.col(sigma_sp).alias("__sigma")] if sigma_sp else []))
    carry = {"mean_sigma": F.avg("__sigma")} if sigma_sp else {}
    values = [c for c in src.columns if c not in (*keys, depth)]
    segs = hermite_segments(column_levels(src, keys, depth, values, unique), keys, depth, ["ct", "rho"], carry=carry, expected=expected)
    low, high = _sample_range(1.0, 0.0, z_max)
    s = segs.withColumn("lo", low).withColumn("hi", high)
    has = F.col("lo") <= F.col("hi")
    ct_seg, rho_seg, z0 = F.col("ct_seg"), F.col("rho_seg"), F.col("z0")
    ref = F.lit(int(K.REFERENCE_DEPTH))

    def at(seg: Column, z: Column) -> Column:
        return F.when(has, cubic(seg, z - z0))

    s = s.select(
        *s.columns, at(ct_seg, F.col("lo")).alias("ct_lo"), at(ct_seg, F.col("hi")).alias("ct_hi"),
        at(rho_seg, F.col("lo")).alias("rho_lo"), at(rho_seg, F.col("hi")).alias("rho_hi"),
        F.when(has, F.col("lo")).alias("z_lo"),
        F.when(ref.between(F.col("lo"), F.col("hi")), at(ct_seg, ref)).alias("ct_at"),
        F.when(ref.between(F.col("lo"), F.col("hi")), at(rho_seg, ref)).alias("rho_at"),
    )
    wz = Window.partitionBy(*keys).orderBy("z0")
    whole = wz.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    earlier = wz.rowsBetween(Window.unboundedPreceding, -1)
    s = s.select(
        *s.columns, F.last("ct_hi", True).over(earlier).alias("ct_prev"),
        F.last("rho_hi", True).over(earlier).alias("rho_prev"),
        F.min("z_lo").over(whole).alias("z_top"), F.min_by("ct_lo", "z_lo").over(whole).alias("ct_top"),
        F.max("ct_at").over(whole).alias("ct_ref"), F.max("rho_at").over(whole).alias("rho_ref"),
    )

    def crosses(target: float) -> Column:
        t = F.lit(target)
        return F.coalesce(((F.col("ct_prev") >= t) & (F.col("ct_lo") < t))
                          | ((F.col("ct_lo") >= t) & (F.col("ct_hi") < t)), F.lit(False))

    def reaches(hit_lo: Column, hit_hi: Column) -> Column:
        return F.coalesce(((F.col("lo") > ref) & hit_lo) | ((F.col("hi") > ref) & hit_hi), F.lit(False))

    t_ild = F.col("ct_ref") - K.ISOTHERMAL_LAYER_DT
    t_mld = F.col("rho_ref") + K.MIXED_LAYER_DRHO
    found = {
        "d26": crosses(K.HEAT_ISOTHERM),
        "z20": crosses(K.THERMOCLINE_ISOTHERM),
        "mld": reaches(F.col("rho_lo") >= t_mld, F.col("rho_hi") >= t_mld),
        "ild": reaches(F.col("ct_lo") <= t_ild, F.col("ct_hi") <= t_ild),
    }
    s = s.select(*s.columns, *[
        F.coalesce(F.max(d.cast("int")).over(earlier), F.lit(0)).alias(f"done_{n}") for n, d in found.items()
    ])
    cold26, cold20 = F.col("ct_top") < K.HEAT_ISOTHERM, F.col("ct_top") < K.THERMOCLINE_ISOTHERM
    need = F.lit(False)
    for names, still in ((("d26", "tchp"), (F.col("done_d26") == 0) & ~cold26), (("z20",), (F.col("done_z20") == 0) & ~cold20),
                         (("mld", "blt"), (F.col("done_mld") == 0) & (F.col("hi") > ref)), (("ild", "blt"), (F.col("done_ild") == 0) & (F.col("hi") > ref))):
        if set(names) & set(wanted):
            need = need | still
    # 26 degrees may be passed between two intervals, and the lower one may warm again: then only its first pair is above.
    s = s.withColumn("passed_26", F.coalesce((F.col("ct_prev") >= K.HEAT_ISOTHERM) & (F.col("ct_lo") < K.HEAT_ISOTHERM), F.lit(False)))
    metres = F.when(has & (F.col("is_first") | need), F.sequence("lo", "hi"))
    rows = s.filter(F.col("is_first") | (has & need)).select(
        *keys, *carry, "ct_seg", "rho_seg", "z0", "lo", "ct_prev", "rho_prev", "z_top", "ct_top", "ct_ref", "rho_ref",
        "done_d26", "passed_26", F.explode_outer(metres).alias("z"))
    z = F.col("z")
    start = z == F.col("lo")
    rows = rows.select(
        *keys, *carry, (z - 1).cast("double").alias("z"), "z_top", "ct_top", "ct_ref", "rho_ref", "done_d26",
        (F.col("passed_26") & ~start).alias("below_26"), F.when(start, F.col("ct_prev")).otherwise(cubic(ct_seg, z - 1 - z0)).alias("v0"),
        F.when(start, F.col("rho_prev")).otherwise(cubic(rho_seg, z - 1 - z0)).alias("r0"),
        cubic(ct_seg, z - z0).alias("v1"), cubic(rho_seg, z - z0).alias("r1"),
    )
    v0, v1, r0, r1, z = (F.col(c) for c in ("v0", "v1", "r0", "r1", "z"))
    t26 = K.HEAT_ISOTHERM
    cross26 = _downward_crossing(v0, v1, z, z + 1, t26)
    above = (v0 >= t26) & ((v1 >= t26) | (cross26 - z >= 0.5))
    heat = F.when((F.col("done_d26") == 0) & ~F.col("below_26") & above, _heat_layer(v0, v1, r0, r1, F.lit(1.0)))
    a0, a1 = r0 - F.col("rho_ref"), r1 - F.col("rho_ref")
    mld = F.when((z >= K.REFERENCE_DEPTH) & (a1 >= K.MIXED_LAYER_DRHO),
                 z + _fraction(F.lit(K.MIXED_LAYER_DRHO) - a0, a1 - a0))
    ild = F.when((z >= K.REFERENCE_DEPTH) & (v1 <= t_ild), z + _fraction(v0 - t_ild, v0 - v1))
    per = rows.groupBy(*keys).agg(
        F.max("ct_top").alias("ct_top"), F.min("z_top").alias("z_top"),
        F.min(cross26).alias("x26"), F.min(_downward_crossing(v0, v1, z, z + 1, K.THERMOCLINE_ISOTHERM)).alias("x20"),
        F.sum(heat).alias("heat"), F.min(mld).alias("mld"), F.min(ild).alias("ild"),
        *[F.max(c).alias(c) for c in carry],
    )
    d26 = F.when(cold26, F.col("z_top").cast("double")).otherwise(F.col("x26"))
    z20 = F.when(cold20, F.col("z_top").cast("double")).otherwise(F.col("x20"))
    tchp = F.when(d26.isNotNull(), F.when(cold26, F.lit(0.0)).otherwise(
        F.coalesce(F.col("heat"), F.lit(0.0)) * K.KJ_CM2_PER_J_M2))
    blt = barrier_thickness(F.col("ild"), F.col("mld"), F.col("mean_sigma") if sigma_sp else None)
    out = {"d26": d26, "z20": z20, "mld": F.col("mld"), "ild": F.col("ild"), "blt": blt, "tchp": tchp}
    return per.select(*keys, *[out[name].alias(name) for name in INDICES if name in wanted])


# --- serving and dashboard variants on the given levels ------------------------------------------


def vertical_diff(df: DataFrame, keys: Sequence[str], depth: str, value: str, eps: float = 0.05) -> DataFrame:
    """Difference, gradient and inversion flag between each level and the one below it."""
    pairs = _next_level(df, keys, depth, [value]).filter(F.col("__zn") > F.col(depth))
    diff = F.col(f"__{value}_n") - F.col(value)
    return pairs.select(
        *keys, ((F.col(depth) + F.col("__zn")) / 2.0).alias("z_mid"), diff.alias("diff"),
        (diff / (F.col("__zn") - F.col(depth))).alias("grad"), (diff > eps).alias("inversion"),
    )


def thermocline_core(df: DataFrame, keys: Sequence[str], depth: str, value: str) -> DataFrame:
    """Mid-depth of the most negative gradient, the shallowest on a tie."""
    g = vertical_diff(df, keys, depth, value).filter(F.col("grad").isNotNull())
    best = g.groupBy(*keys).agg(F.min(F.struct("grad", "z_mid")).alias("__m"))
    return best.select(*keys, F.col("__m")["z_mid"].alias("z_mid"), F.col("__m")["grad"].alias("grad"))


def serving_indices(df: DataFrame, keys: Sequence[str], depth: str, theta: str, land: str | None = None) -> DataFrame:
    """Coarse-level Z20, MLD, TCHP and BLT: the last crossing wins and defaults stand in for none.

    TCHP is NULL where a level is missing: part of a column is no heat content.
    """
    w = Window.partitionBy(*keys)
    pairs = _next_level(df, keys, depth, [theta]).withColumn("__t0", F.min_by(theta, depth).over(w))
    t1, t2, z1, z2 = F.col(theta), F.col(f"__{theta}_n"), F.col(depth), F.col("__zn")

    def last_crossing(target: Column) -> Column:
        at = z1 + (target - t1) / (t2 - t1 + 1e-6) * (z2 - z1)
        hit = (t1 >= target) & (t2 < target)
        return F.max_by(F.when(hit, at), F.when(hit, z1))

    excess = F.when(t1.isNotNull() & t2.isNotNull(),
                    (F.greatest(t1 - 26.0, F.lit(0.0)) + F.greatest(t2 - 26.0, F.lit(0.0))) / 2.0)
    per = pairs.groupBy(*keys).agg(
        F.coalesce(last_crossing(F.lit(20.0)), F.lit(K.SERVING_Z20_DEFAULT)).alias("z20"),
        F.coalesce(last_crossing(F.col("__t0") - 0.2), F.lit(K.SERVING_MLD_DEFAULT)).alias("mld"),
        F.when(F.count_if(t1.isNull()) == 0, F.coalesce(F.sum(excess * (z2 - z1) * K.SERVING_HEAT_FACTOR), F.lit(0.0))).alias("tchp"),
        *([F.max(land).alias("__land")] if land else []),
    )
    per = per.withColumn("blt", F.greatest(F.col("mld") - 10.0, F.lit(0.0)))
    names = ["z20", "mld", "tchp", "blt"]
    if not land:
        return per.select(*keys, *names)
    sea = ~F.coalesce(F.col("__land"), F.lit(False))
    return per.select(*keys, *[F.when(sea, F.col(n)).alias(n) for n in names], F.col("__land").alias("land"))


def isothermal_layer_from_surface(df: DataFrame, keys: Sequence[str], depth: str, theta: str, dt: float = 0.5,
                                  out: str = "ild") -> DataFrame:
    """First level colder than the surface by ``dt``, interpolated; the deepest level if none is."""
    w = Window.partitionBy(*keys)
    pairs = _next_level(df, keys, depth, [theta]).withColumn("__t0", F.min_by(theta, depth).over(w))
    t1, t2, z1, z2 = F.col(theta), F.col(f"__{theta}_n"), F.col(depth), F.col("__zn")
    target, drop = F.col("__t0") - dt, t1 - t2
    at = F.when(drop <= 0, z2).otherwise(z1 + (z2 - z1) * unit((t1 - target) / F.when(drop > 0, drop)))
    return pairs.groupBy(*keys).agg(
        F.coalesce(F.min(F.when(t2 <= target, at)), F.max(z1)).alias(out)
    )


def _clamped_pieces(df: DataFrame, keys: Sequence[str], depth: str, values: Sequence[str]) -> DataFrame:
    """Linear pieces between levels plus constant ones above the first and below the last level."""
    w = Window.partitionBy(*keys).orderBy(depth)
    c = _next_level(df, keys, depth, values).withColumn("__first", F.lag(depth).over(w).isNull())
    far = F.lit(1.0e9)
    z, zn = F.col(depth).cast("double"), F.col("__zn").cast("double")

    def piece(a: Column, b: Column, ends: list[tuple[Column, Column]]) -> Column:
        cols = [a.alias("za"), b.alias("zb")]
        for (ya, yb), v in zip(ends, values):
            cols += [ya.alias(f"{v}_a"), yb.alias(f"{v}_b")]
        return F.struct(*cols)

    flat = [(F.col(v), F.col(v)) for v in values]
    own = piece(z, F.coalesce(zn, far),
                [(F.col(v), F.when(zn.isNull(), F.col(v)).otherwise(F.col(f"__{v}_n"))) for v in values])
    top = F.when(F.col("__first"), piece(-far, z, flat))
    return c.select(*keys, F.explode(F.array_compact(F.array(top, own))).alias("p")).select(*keys, "p.*")


def linear_interp(df: DataFrame, keys: Sequence[str], depth: str, values: Sequence[str],
                  levels: Sequence[float], out: str = "z") -> DataFrame:
    """Linear values at fixed depths, held constant beyond both ends."""
    pieces = _clamped_pieces(df, keys, depth, values)
    targets = F.array(*[F.lit(float(z)) for z in levels])
    rows = pieces.withColumn(out, F.explode(F.filter(
        targets, lambda t: (t > F.col("za")) & (t <= F.col("zb")))))
    t = (F.col(out) - F.col("za")) / (F.col("zb") - F.col("za"))
    return rows.select(*keys, out, *[
        (F.col(f"{v}_a") + t * (F.col(f"{v}_b") - F.col(f"{v}_a"))).alias(v) for v in values
    ])


def layer_heat(df: DataFrame, keys: Sequence[str], depth: str, theta: str,
               layers: Sequence[tuple[str, float, float]] = K.HEAT_LAYERS) -> DataFrame:
    """Heat above 26 degrees inside fixed depth layers, trapezoid over levels and layer edges."""
    pieces = _clamped_pieces(df, keys, depth, [theta])
    table = F.array(*[F.struct(F.lit(n).alias("layer"), F.lit(float(a)).alias("top"), F.lit(float(b)).alias("bottom"))
                      for n, a, b in layers])
    rows = pieces.withColumn("__l", F.explode(table)).select("*", "__l.*")
    a, b = F.greatest("za", "top"), F.least("zb", "bottom")

    def theta_at(z: Column) -> Column:
        return F.col(f"{theta}_a") + (z - F.col("za")) / (F.col("zb") - F.col("za")) * (
            F.col(f"{theta}_b") - F.col(f"{theta}_a"))

    def excess(z: Column) -> Column:
        return F.greatest(theta_at(z) - 26.0, F.lit(0.0))

    kj = F.when(b > a, (excess(a) + excess(b)) / 2.0 * (b - a) * (K.RHO_SEA * K.LAYER_HEAT_CAPACITY / 1e7))
    return rows.groupBy(*keys, "layer").agg(F.coalesce(F.sum(kj), F.lit(0.0)).alias("kj"))


def sounding_summary(df: DataFrame, keys: Sequence[str], depth: str, theta: str, sp: str,
                     mld: str | None = None, blt: str | None = None) -> DataFrame:
    """One row per profile: density and gradient arrays, isothermal layer, barrier, core, layer heat.

    The parts share the column key, so after the first shuffle they meet without another one.
    """
    keyed = df.repartition(*keys)
    keys = list(keys)
    ild = isothermal_layer_from_surface(keyed, keys, depth, theta)
    core = thermocline_core(keyed, keys, depth, theta).withColumnsRenamed({"z_mid": "core_z", "grad": "core_grad"})
    grads = vertical_diff(keyed, keys, depth, theta).groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("z_mid", "grad"))).alias("gradient"))
    extra = [F.max(c).alias(f"__{n}") for n, c in (("mld", mld), ("blt", blt)) if c]
    sigma = keyed.groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct(
            F.col(depth).alias("z"), sigma_theta(F.col(theta), F.col(sp)).alias("sigma")))),
            lambda s: s["sigma"]).alias("sigma"), *extra)
    heat = layer_heat(keyed, keys, depth, theta).groupBy(*keys).agg(*[
        F.max(F.when(F.col("layer") == name, F.col("kj"))).alias("kj_" + name.replace("-", "_"))
        for name, _, _ in K.HEAT_LAYERS])
    out = ild.join(core, keys, "left").join(grads, keys, "left").join(sigma, keys, "left").join(heat, keys, "left")
    if mld:
        fallback = F.greatest(F.col("ild") - F.col("__mld"), F.lit(0.0))
        given = F.when(F.col("__blt") > 0, F.col("__blt")) if blt else F.lit(None).cast("double")
        out = out.withColumn("blt", F.coalesce(given, fallback))
    return out.drop("__mld", "__blt")


def uncertainty_band(df: DataFrame, value: str, sigma: str, widths: Sequence[int] = (1, 2)) -> DataFrame:
    """Value plus and minus whole multiples of its spread."""
    cols = {}
    for k in widths:
        cols[f"lo_{k}"] = F.col(value) - F.col(sigma) * k
        cols[f"hi_{k}"] = F.col(value) + F.col(sigma) * k
    return df.withColumns(cols)


def column_mean_sigma(df: DataFrame, keys: Sequence[str], sigma: str, out: str = "mean_sigma") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(sigma).alias(out))


def level_nearest_to(df: DataFrame, keys: Sequence[str], depth: str, value: str, target: float) -> DataFrame:
    """Depth of the level whose value is nearest to ``target``, the shallower one on a tie."""
    off = F.when(F.col(value).isNotNull(), F.struct(F.abs(F.col(value) - target), F.col(depth)))
    return df.groupBy(*keys).agg(F.min_by(depth, off).alias(depth))


def level_axis(df: DataFrame, keys: Sequence[str], depth: str, out: str = "axis") -> DataFrame:
    """Ascending array of the distinct depths of every column."""
    return df.groupBy(*keys).agg(F.sort_array(F.collect_set(depth)).alias(out))
