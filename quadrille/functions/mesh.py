"""Meshes as rows of vertices and faces: clustering, deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from ..operators.sequences import dense_ids


def clustered_vertices(df: DataFrame, cells: dict[str, Column]) -> GroupedData:
    """Vertices grouped by the cell they fall in: name -> coordinate in units of the cell."""
    for name, value in cells.items():
        df = df.withColumn(name, F.floor(value).cast("long"))
    return df.groupBy(*cells)


def vertex_index(df: DataFrame, coordinates: list[str], order: str) -> DataFrame:
    """Adds idx, the number of a vertex among distinct ones in the order of their first occurrence."""
    first = df.groupBy(*coordinates).agg(F.min(order).alias("_first"))
    return df.join(dense_ids(first, ["_first"], "idx").drop("_first"), coordinates)
