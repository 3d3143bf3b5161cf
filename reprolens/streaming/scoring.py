"""Scoring and watching streams with maps that were trained before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.mapping import map_rows


def map_stream(stream: DataFrame, codebook: DataFrame, columns: list[str]) -> DataFrame:
    """Best units of the rows of a stream. The codebook is static and small, so each
    micro-batch is mapped without state or shuffle."""
    return map_rows(stream, codebook, {"data": tuple(columns)})


def windowed_quality(mapped: DataFrame, time: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows and mean distance to the map per time window; rows later than ``late`` are left out."""
    w = F.window(F.col(time).cast("timestamp"), window)
    out = mapped.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(w.alias("w"))
    return out.agg(F.count(F.lit(1)).alias("n"), F.avg("distance").alias("mean_distance")).select(F.col("w.start").alias("start"), "n", "mean_distance")


def write_mapped(mapped: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append mapped rows to Parquet, exactly once per micro-batch, until the input ends."""
    return mapped.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
