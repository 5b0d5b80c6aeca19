"""Incremental ingest: new files of points become fragments of the pyramid as they arrive.

Each micro-batch is tiled like a batch job and appended under its own epoch, so a replayed batch replaces what its
first attempt wrote. Per-zoom totals are kept by a streaming aggregation of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.pyramid import merged_points, over_zooms, point_tiles


def point_stream(spark: SparkSession, path: str, schema, most_files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(path)


def tiled(points: DataFrame, bounds: tuple[float, float, float, float], top: int, x: str = "x", y: str = "y") -> DataFrame:
    """Points with fixed world bounds as rows of all zooms; stateless, so it works on streams too."""
    x0, y0, x1, y1 = bounds
    df = points.na.drop(subset=[x, y]).withColumn("nx", (F.col(x) - x0) / (x1 - x0)).withColumn("ny", (F.col(y) - y0) / (y1 - y0))
    return point_tiles(df, top)


def append_to_pyramid(points: DataFrame, bounds: tuple[float, float, float, float], top: int, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends the fragments of a point stream to a table in folders epoch=N/zoom=M."""

    def write(batch: DataFrame, epoch: int) -> None:
        tiled(batch, bounds, top).write.mode("overwrite").partitionBy("zoom").parquet(f"{target}/epoch={epoch}")

    writer = points.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def running_lod(points: DataFrame, bounds: tuple[float, float, float, float], top: int, group: str) -> DataFrame:
    """Weighted points by zoom, cell and group over a stream: sums merge, so state is one row a cell."""
    x0, y0, x1, y1 = bounds
    df = points.na.drop(subset=["x", "y"]).withColumn("nx", (F.col("x") - x0) / (x1 - x0)).withColumn("ny", (F.col("y") - y0) / (y1 - y0))
    return merged_points(over_zooms(df, top), group)


def windowed_counts(events: DataFrame, time: str, group: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by window and group; rows later than the watermark are dropped and old state goes."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), group).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), group, "n")
