"""Daily means over a stream of readings (an extension: the batch form is operators.climate.daily_mean)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from gridsonde.operators.climate import daily_mean


def read_stream(spark: SparkSession, folder: str, schema: T.StructType, files: str | None = None,
                files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files appearing in a folder, optionally only those matching the glob ``files``."""
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("pathGlobFilter", files)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def stream_daily_mean(stream: DataFrame, ts: str, keys: Sequence[str], values: Sequence[str], lateness: str = "1 day") -> DataFrame:
    """Mean per UTC day and key; a day is emitted once the watermark has passed its end.

    State is one row per key and open day.
    """
    day = F.window(ts, "1 day")
    grouped = stream.withWatermark(ts, lateness).groupBy(day.alias("__w"), *keys).agg(*[F.avg(v).alias(v) for v in values])
    return grouped.select(*keys, F.to_date("__w.start").alias("day"), *values)


def with_open_days(batch: DataFrame, path: str, ts: str, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The days that a finished stream emitted to ``path`` and those it left open, from the same source as a batch.

    A stream that will get no more input never passes the watermark of its last days. Days after the last
    emitted one are complete in the source, so they are computed there; call it once the query has ended.
    """
    rows = daily_mean(batch, ts, list(keys), list(values)).select(*keys, "day", *values)
    emitted = batch.sparkSession.read.schema(rows.schema).parquet(path)
    last = F.coalesce(emitted.agg(F.max("day")).scalar(), F.lit("0001-01-01").cast("date"))
    return emitted.unionByName(rows.filter(F.col("day") > last))


def append_to(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append-mode Parquet sink with exactly-once file commits."""
    writer = stream.writeStream.outputMode("append").format("parquet").option("path", path).option(
        "checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
