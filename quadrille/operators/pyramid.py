"""The tile pyramid: explode features over zooms and tiles, reduce detail by zoom, read back with pruning.

Points and boxes never leave Catalyst: a zoom range is an exploded sequence, a tile is arithmetic, so the range
join against the grid needs no join at all. Filters come before the explode, tags after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import grid


def bounds(df: DataFrame, *axes: str, names: tuple[str, ...] = ()) -> DataFrame:
    """One row: <name>_min and <name>_max of each axis; (0, 1) where there are no values. Map-side combined."""
    names = names or axes
    parts = []
    for a, n in zip(axes, names, strict=True):
        parts += [F.coalesce(F.min(a), F.lit(0.0)).alias(f"{n}_min"), F.coalesce(F.max(a), F.lit(1.0)).alias(f"{n}_max")]
    return df.agg(*parts)


def bounds_of(*tables: tuple[DataFrame, str, str]) -> DataFrame:
    """Bounds over several tables with their own x and y columns."""
    every = None
    for df, x, y in tables:
        part = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
        every = part if every is None else every.unionByName(part)
    return bounds(every, "x", "y")


def squared(box: DataFrame) -> DataFrame:
    """Bounds widened to a square around the same minimum."""
    side = F.greatest(F.col("x_max") - F.col("x_min"), F.col("y_max") - F.col("y_min"))
    return box.select("x_min", "y_min", (F.col("x_min") + side).alias("x_max"), (F.col("y_min") + side).alias("y_max"))


def normalised(df: DataFrame, box: DataFrame | None = None, x: str = "x", y: str = "y", scale: float = 1.0) -> DataFrame:
    """Adds nx and ny in [0, 1]; rows with a null coordinate go. ``box`` is the one-row table of bounds."""
    df = df.na.drop(subset=[x, y])
    if scale != 1.0:
        df = df.withColumn(x, F.col(x) * F.lit(scale)).withColumn(y, F.col(y) * F.lit(scale))
    box = box if box is not None else bounds(df, x, y, names=("x", "y"))
    df = df.crossJoin(F.broadcast(box))  # one row
    df = df.withColumn("nx", grid.project(F.col(x), F.col("x_min"), F.col("x_max"))).withColumn("ny", grid.project(F.col(y), F.col("y_min"), F.col("y_max")))
    return df.drop("x_min", "x_max", "y_min", "y_max")


def clipped_points(df: DataFrame, box: dict[str, tuple[float, float]], closed: bool = False) -> DataFrame:
    """Points inside a box, given by column; half-open, or with its upper bounds. A filter the scan can take."""
    for name, (low, high) in box.items():
        df = df.where(grid.inside(F.col(name), low, high, closed))
    return df


def over_zooms(df: DataFrame, top: int, low: int = 0) -> DataFrame:
    """A row per zoom: one pass instead of a union of levels."""
    return df.withColumn("zoom", F.explode(F.sequence(F.lit(low), F.lit(top))))


def point_tiles(df: DataFrame, top: int, low: int = 0, nx: str = "nx", ny: str = "ny") -> DataFrame:
    """(point x zoom) with tile_x and tile_y. Points outside [0, 1] are in the root tile alone."""
    z = F.col("zoom")
    tx = F.when(z == 0, F.lit(0)).otherwise(grid.tile_index(F.col(nx), z))
    ty = F.when(z == 0, F.lit(0)).otherwise(grid.tile_index(F.col(ny), z))
    return over_zooms(df, top, low).withColumn("tile_x", tx).withColumn("tile_y", ty).where("tile_x is not null and tile_y is not null")


def box_tiles(df: DataFrame, top: int, low: int = 0, buffer: float = 0.0, axes: tuple[tuple[str, str, str], ...] = (("min_x", "max_x", "tile_x"), ("min_y", "max_y", "tile_y"))) -> DataFrame:
    """(box x tile) for every tile whose buffered interval a box meets, in two or three axes."""
    df = over_zooms(df, top, low)
    for a, b, name in axes:
        first, last = grid.tile_range(F.col(a), F.col(b), F.col("zoom"), buffer)
        df = df.withColumn("_first", first).withColumn("_last", last).where("_first <= _last")
        df = df.withColumn(name, F.explode(F.sequence("_first", "_last"))).drop("_first", "_last")
    return df


def decimated(df: DataFrame, top: int, fid: str = "fid", zoom: str = "zoom") -> DataFrame:
    """Keeps a point at a zoom if its id is a multiple of 2**(top - zoom)."""
    return df.where(F.pmod(F.col(fid), grid.tiles_at(F.greatest(F.lit(top) - F.col(zoom), F.lit(0)))) == 0)


def merged_points(df: DataFrame, *group: str, x: str = "x", y: str = "y", base: int = 1) -> DataFrame:
    """Weighted points: per zoom, grid cell and group the count and the sums of x and y.

    Sums are given, not means, so that partial results merge. Cells are base * 2**zoom an axis, clipped to range.
    """
    cells = F.lit(base) * grid.tiles_at(F.col("zoom"))
    cell = lambda n: F.greatest(F.lit(0), F.least(cells - 1, F.floor(F.col(n) * cells).cast("long")))
    df = df.withColumn("cell_x", cell("nx")).withColumn("cell_y", cell("ny"))
    return df.groupBy("zoom", "cell_x", "cell_y", *group).agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("sum_x"), F.sum(y).alias("sum_y"))


def capped(df: DataFrame, cap: int, cell: list[str], order: list[Column]) -> DataFrame:
    """At most ``cap`` rows a cell, by a total order (a hash of the id stands in for a random draw).

    Rank-limited windows are filtered per partition before the shuffle (WindowGroupLimit), so a hot cell sends
    ``cap`` rows a task.
    """
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*cell).orderBy(*order))).where(F.col("_n") <= cap).drop("_n")


def top_k(df: DataFrame, k: int, group: list[str], order: list[Column], rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group and their rank."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= k)


def read(df: DataFrame, zoom: int | None = None, feature_id: int | None = None, tile_x: int | None = None, tile_y: int | None = None, tile_d: int | None = None) -> DataFrame:
    """Equality filters on a pyramid: zoom prunes partitions, the others are pushed to the Parquet scan."""
    for name, value in (("zoom", zoom), ("feature_id", feature_id), ("tile_x", tile_x), ("tile_y", tile_y), ("tile_d", tile_d)):
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def in_ring(df: DataFrame, nx: float, ny: float, ring: int) -> DataFrame:
    """Tiles within ``ring`` tiles of the one that holds the point, at every zoom."""
    z = F.col("zoom")
    return df.where(grid.ring_distance(F.col("tile_x"), F.col("tile_y"), grid.tile_index(F.lit(nx), z), grid.tile_index(F.lit(ny), z)) <= ring)


def nearest_zoom(df: DataFrame, key: list[str], target: Column) -> DataFrame:
    """The available zoom nearest to a target; the finer one of equals."""
    return df.groupBy(*key).agg(F.min_by("zoom", F.struct(F.abs(F.col("zoom") - target), -F.col("zoom"))).alias("zoom"))


def screen_space_zoom(distance: Column, error_at_root: float, factor: float, most: float, top: int) -> Column:
    """The first zoom whose screen-space error (error / 2**zoom * factor / distance) is at most ``most``."""
    need = F.ceil(F.log2(F.lit(error_at_root * factor / most) / F.greatest(distance, F.lit(1e-9))))
    return F.greatest(F.lit(0), F.least(F.lit(top), need)).cast("int")


def ancestors(df: DataFrame) -> DataFrame:
    """A row per tile and ancestor (itself included): up_zoom, up_x, up_y."""
    k = F.explode(F.sequence(F.lit(0), F.col("zoom")))
    df = df.withColumn("up_zoom", k)
    down = grid.tiles_at(F.col("zoom") - F.col("up_zoom"))
    return df.withColumn("up_x", F.floor(F.col("tile_x") / down).cast("long")).withColumn("up_y", F.floor(F.col("tile_y") / down).cast("long"))


def drill_down(wanted: DataFrame, held: DataFrame) -> DataFrame:
    """For each wanted tile, the nearest ancestor among the tiles held: src_zoom, src_x, src_y."""
    held = held.select(F.col("zoom").alias("up_zoom"), F.col("tile_x").alias("up_x"), F.col("tile_y").alias("up_y")).distinct()
    found = ancestors(wanted).join(held, ["up_zoom", "up_x", "up_y"])
    best = found.groupBy("zoom", "tile_x", "tile_y").agg(F.max(F.struct("up_zoom", "up_x", "up_y")).alias("up"))
    return best.select("zoom", "tile_x", "tile_y", F.col("up.up_zoom").alias("src_zoom"), F.col("up.up_x").alias("src_x"), F.col("up.up_y").alias("src_y"))


def tile_children(tiles: DataFrame) -> DataFrame:
    """Tiles joined with their children one zoom finer: an equi-join on the parent's key."""
    kids = tiles.select((F.col("zoom") - 1).alias("zoom"), F.floor(F.col("tile_x") / 2).cast("long").alias("tile_x"), F.floor(F.col("tile_y") / 2).cast("long").alias("tile_y"), F.col("tile_x").alias("child_x"), F.col("tile_y").alias("child_y"))
    return tiles.join(kids, ["zoom", "tile_x", "tile_y"])


def wrapped(df: DataFrame, x: str = "nx") -> DataFrame:
    """The world and its copies one width to either side (world: -1, 0, 1)."""
    df = df.withColumn("world", F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)])))
    return df.withColumn(x, F.col(x) + F.col("world"))
