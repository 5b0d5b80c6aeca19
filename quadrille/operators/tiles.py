"""Tables about tiles: statistics, indexes, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TILE2 = ["zoom", "tile_x", "tile_y"]
TILE3 = [*TILE2, "tile_d"]


def tile_stats(df: DataFrame, tile: list[str], points: Column, box: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Features, points and bounds of each tile."""
    parts = [F.count(F.lit(1)).alias("num_features"), F.sum(points).alias("num_points")]
    for axis, (low, high) in box.items():
        parts += [F.min(low).alias(f"min_{axis}"), F.max(high).alias(f"max_{axis}")]
    return df.groupBy(*tile).agg(*parts)


def zoom_counts(df: DataFrame, tile: list[str] = TILE2) -> DataFrame:
    """Tiles and rows by zoom. Distinct tiles first, so counting needs no wide state."""
    per = df.groupBy(*tile).agg(F.count(F.lit(1)).alias("rows"))
    return per.groupBy("zoom").agg(F.count(F.lit(1)).alias("tiles"), F.sum("rows").alias("rows"))


def tile_name(*parts: Column) -> Column:
    return F.concat_ws("/", *[p.cast("string") for p in parts])


def feature_index(df: DataFrame, feature: str, tile: list[str] = TILE2) -> DataFrame:
    """Per feature its tiles in order (as text) and their number by zoom."""
    own = df.select(feature, *tile).distinct()
    per_zoom = own.groupBy(feature, "zoom").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct(*tile))).alias("_t"))
    name = lambda t: F.concat_ws("/", *[t[c].cast("string") for c in tile])
    per_zoom = per_zoom.withColumn("_names", F.array_join(F.transform("_t", name), " "))
    rows = F.sort_array(F.collect_list(F.struct("zoom", "n", "_names")))
    out = per_zoom.groupBy(feature).agg(rows.alias("_z"))
    return out.select(feature, F.array_join(F.transform("_z", lambda z: z["_names"]), " ").alias("tiles"), F.array_join(F.transform("_z", lambda z: F.concat(z["zoom"].cast("string"), F.lit(":"), z["n"].cast("string"))), ",").alias("tile_counts"))


def canonical(df: DataFrame, tile: list[str]) -> DataFrame:
    """Rows in tile order and a total order inside, without a global sort: tiles are range-partitioned."""
    return df.repartitionByRange(*tile).sortWithinPartitions(*tile, "feature_id", "geom_type", "positions")


def splat(points: DataFrame, low: float, high: float, size: int, order: str, value: str) -> DataFrame:
    """A raster of ``size``: the value of the last point, by ``order``, that falls on a pixel."""
    to = lambda c: F.greatest(F.lit(0), F.least(F.lit(size - 1), F.floor((F.col(c) - low) / F.lit(float(high - low)) * (size - 1) + 0.5))).cast("int")
    return points.select(to("x").alias("px"), to("y").alias("py"), F.col(order).alias("_o"), F.col(value).alias("_v")).groupBy("px", "py").agg(F.max_by("_v", "_o").alias(value))


def skew_guard(df: DataFrame, tile: list[str], size: Column, most: int) -> DataFrame:
    """Tiles whose encoded size would exceed ``most`` bytes: callers fail early, with their names."""
    return df.groupBy(*tile).agg(F.sum(size).alias("bytes")).where(F.col("bytes") > most)
