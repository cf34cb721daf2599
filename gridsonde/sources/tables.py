"""Table sources and sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridsonde import constants as K
from gridsonde.functions.numeric import wrap_longitude


def read_many(spark: SparkSession, paths: Sequence[str], source_column: str | None = None) -> DataFrame | None:
    """Every file set of a list of Parquet paths or globs as one table; None when nothing matches.

    Sets with different columns are united by name, absent columns being NULL.
    """
    tables = []
    for i, path in enumerate(paths):
        try:
            t = spark.read.parquet(path)
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                continue
            raise
        tables.append(t.withColumn(source_column, F.lit(i)) if source_column else t)
    if not tables:
        return None
    return union_tables(*tables)


def union_tables(*tables: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def alias_columns(df: DataFrame, aliases: Mapping[str, Sequence[str]], ignore_case: bool = False) -> DataFrame:
    """Rename the first matching source column to each canonical name; keep names already there."""
    rename: dict[str, str] = {}
    have = {c.lower(): c for c in df.columns} if ignore_case else {c: c for c in df.columns}
    for name, candidates in aliases.items():
        if name in df.columns:
            continue
        for c in candidates:
            key = c.lower() if ignore_case else c
            if key in have and have[key] not in rename:
                rename[have[key]] = name
                break
    return df.withColumnsRenamed(rename) if rename else df


def standardize_coords(df: DataFrame, wrap: bool | None = None) -> DataFrame:
    """Canonical names for latitude, longitude, depth and time; 0..360 longitudes become -180..180.

    Longitudes are wrapped only if their maximum exceeds 180 while their minimum is positive. That
    takes one aggregate as a scalar subquery unless ``wrap`` says so beforehand.
    """
    names = {"lat": K.LAT_NAMES, "lon": K.LON_NAMES, "depth": K.DEPTH_NAMES, "time": K.TIME_NAMES}
    out = alias_columns(df, names, ignore_case=True)
    if "lon" not in out.columns or wrap is False:
        return out
    lon = F.col("lon")
    if wrap:
        return out.withColumn("lon", wrap_longitude(lon))
    needs = out.agg(((F.max("lon") > 180.0) & (F.min("lon") > 0.0)).alias("w")).scalar()
    return out.withColumn("lon", F.when(needs, wrap_longitude(lon)).otherwise(lon))


def wind_columns(df: DataFrame) -> tuple[str, str]:
    """Names of the eastward and northward 10 m wind columns."""
    def find(exact: set[str], letter: str) -> str | None:
        named = [c for c in df.columns if c.lower() in exact]
        loose = [c for c in df.columns if letter in c.lower() and "10" in c and c not in named]
        return next(iter(named + loose), None)

    u = find({"u10", "10u", "eastward_wind"}, "u")
    v = find({"v10", "10v", "northward_wind"}, "v")
    if u is None or v is None:
        raise KeyError(f"no 10 m wind columns among {df.columns}")
    return u, v


def to_storage_types(df: DataFrame) -> DataFrame:
    """Doubles to float, booleans to 0/1 bytes; everything else as it is."""
    changed = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DoubleType):
            changed[f.name] = F.col(f.name).cast("float")
        elif isinstance(f.dataType, T.BooleanType):
            changed[f.name] = F.col(f.name).cast("tinyint")
    return df.withColumns(changed) if changed else df


def _with_month(df: DataFrame, day: str) -> DataFrame:
    return df.withColumn("month", F.date_format(day, "yyyy-MM"))


def write_table(df: DataFrame, path: str, day: str | None = None, sort: Sequence[str] = ("iy", "ix", "depth")) -> str:
    """Overwrite a Parquet table with storage types, partitioned by month when it has a day column.

    The rebalance hint clusters rows by month, merges small months into one task and splits months
    beyond the advisory partition size over several, so neither tiny nor huge files appear; rows are
    sorted inside for tight row-group statistics.
    """
    out = to_storage_types(df)
    if day:
        order = [c for c in (day, *sort) if c in out.columns]
        out = _with_month(out, day).hint("rebalance", "month").sortWithinPartitions("month", *order)
        out.write.mode("overwrite").option("compression", "zstd").partitionBy("month").parquet(path)
    else:
        out.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return path


def append_days(df: DataFrame, path: str, day: str = "day", idempotent: bool = True) -> str:
    """Add days to a day-partitioned table, creating it if absent.

    ``idempotent`` replaces the partitions of the days it brings, so a repeated run (after a lost
    executor or a retried job) leaves one copy; otherwise rows are appended.
    """
    out = to_storage_types(df).hint("rebalance", day)
    writer = out.write.option("compression", "zstd").partitionBy(day)
    if idempotent:
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    else:
        writer.mode("append").parquet(path)
    return path


def write_bucketed(df: DataFrame, table: str, keys: Sequence[str], buckets: int) -> str:
    """Overwrite a catalogue table bucketed and sorted by its join keys.

    Tables bucketed alike by (say) cell join, aggregate and window on those keys without a shuffle,
    which pays off for a cube that meets its climatology or mask again and again.
    """
    first, *rest = keys
    df.write.mode("overwrite").format("parquet").bucketBy(buckets, first, *rest).sortBy(first, *rest).saveAsTable(table)
    return table


def write_rows_json(df: DataFrame, path: str) -> str:
    """Score rows as JSON lines, missing scores as null."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return path
