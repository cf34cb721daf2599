"""Nested profile records as level rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridsonde.functions.numeric import finite, nearest_site

_LEVEL_FIELDS = ("depth", "temp", "psal", "temp_qc", "pres_qc", "psal_qc")


def profiles_to_rows(records: DataFrame, ids: Sequence[str] = ("profile_id",), position: str = "level") -> DataFrame:
    """Multi-level profile records to one row per level.

    Arrays: depth and temp, optionally psal and per-level flags. Absent salinity is NULL and absent
    flags count as good; position and time flags are per record.
    """
    have = set(records.columns)
    arrays = [c for c in _LEVEL_FIELDS if c in have]
    rest = [c for c in records.columns if c not in arrays]
    rows = records.select(*rest, F.posexplode(F.arrays_zip(*arrays)).alias(position, "__l"))
    level = {c: F.col("__l")[c] for c in arrays}
    for c in ("depth", "temp", "psal"):
        level[c] = finite(level[c].cast("double")) if c in level else F.lit(None).cast("double")
    for c in ("temp_qc", "pres_qc", "psal_qc"):
        level.setdefault(c, F.lit("1"))
    out = rows.select(*rest, position, *[v.alias(c) for c, v in level.items()])
    for c in ("position_qc", "time_qc"):
        if c not in out.columns:
            out = out.withColumn(c, F.lit("1"))
    return out


def mooring_to_rows(records: DataFrame, site: str | None = "site") -> DataFrame:
    """Mooring records (arrays times, depths, temp[time][depth], psal) to rows (site, ts, depth, ...).

    The position of a record is the mean of its reported ``lats``/``lons``. Records without a site
    name get that of the closest fixed site.
    """
    lat, lon = (F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / F.size(c) for c in ("lats", "lons"))
    base = records.withColumn("lat", lat).withColumn("lon", lon)
    near = nearest_site(F.col("lat"), F.col("lon"))
    base = base.withColumn("site", near if site is None or site not in records.columns else F.coalesce(F.col(site), near))
    has_salt = "psal" in records.columns
    by_time = base.select("site", "lat", "lon", "depths", "temp", *(["psal"] if has_salt else []),
                          F.posexplode("times").alias("__i", "ts"))
    i = F.col("__i")
    cells = F.arrays_zip(F.col("depths").alias("depth"), F.get("temp", i).alias("temp"),
                         *([F.get("psal", i).alias("psal")] if has_salt else []))
    rows = by_time.select("site", "lat", "lon", "ts", F.explode(cells).alias("c"))
    psal = finite(F.col("c.psal")) if has_salt else F.lit(None).cast("double")
    return rows.select("site", "lat", "lon", "ts", F.col("c.depth").alias("depth"),
                       finite(F.col("c.temp")).alias("temp"), psal.alias("psal"))


_DOUBLES = T.ArrayType(T.DoubleType())
PROFILE_SCHEMA = T.StructType(
    [T.StructField("label", T.StringType()), T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())]
    + [T.StructField(n, _DOUBLES) for n in (
        "depths", "potential_temperature", "practical_salinity", "conservative_temperature", "absolute_salinity",
        "uncertainty_theta", "uncertainty_sp", "argo_temperature", "argo_salinity")]
    + [T.StructField(n, T.DoubleType()) for n in ("TCHP", "MLD", "Z20", "BLT", "CIP")]
)
CASE_STUDY_SCHEMA = T.StructType([
    T.StructField("meta", T.MapType(T.StringType(), T.StringType())),
    T.StructField("track", T.ArrayType(T.StructType([
        T.StructField("date", T.StringType()), T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType()),
        T.StructField("vmax_kt", T.DoubleType()), T.StructField("mslp_hpa", T.DoubleType())]))),
    T.StructField("profiles", T.MapType(T.StringType(), PROFILE_SCHEMA)),
])


def load_case_study(spark: SparkSession, path: str) -> DataFrame:
    """Case-study documents (one JSON object per file) as nested rows."""
    return spark.read.schema(CASE_STUDY_SCHEMA).json(path, multiLine=True)


def parse_case_study(df: DataFrame, text: str) -> DataFrame:
    """Case-study documents held as JSON text in a column."""
    return df.withColumn("__doc", F.from_json(text, CASE_STUDY_SCHEMA)).select(
        *[c for c in df.columns if c != text], "__doc.*")


def case_profile_rows(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Dated profiles as level rows."""
    p = docs.select(*keep, F.explode("profiles").alias("date", "p"))
    arrays = {"depth": "depths", "theta": "potential_temperature", "sp": "practical_salinity",
              "sigma_theta": "uncertainty_theta", "sigma_sp": "uncertainty_sp", "argo_temp": "argo_temperature",
              "argo_sal": "argo_salinity"}
    zipped = F.arrays_zip(*[_or_empty(F.col("p")[src]).alias(name) for name, src in arrays.items()])
    rows = p.select(*keep, "date", F.col("p.lat").alias("lat"), F.col("p.lon").alias("lon"),
                    F.posexplode(zipped).alias("level", "l"))
    defaults = {"sigma_theta": 0.2, "sigma_sp": 0.05}  # used by the dashboard when spreads are absent
    out = [F.coalesce(F.col("l")[n], F.lit(defaults[n])).alias(n) if n in defaults else F.col("l")[n].alias(n)
           for n in arrays]
    return rows.select(*keep, "date", "lat", "lon", "level", *out)


def _or_empty(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<double>"))


def case_index_rows(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Dated index values of each document."""
    p = docs.select(*keep, F.explode("profiles").alias("date", "p"))
    return p.select(*keep, "date", *[F.col("p")[n].alias(n.lower()) for n in ("TCHP", "MLD", "Z20", "BLT", "CIP")])


def case_track_rows(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return docs.select(*keep, F.explode("track").alias("t")).select(*keep, "t.*")
