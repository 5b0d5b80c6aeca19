"""Facet stores: attributes kept beside the tiles, wide (a column a marker) or long (a row a non-zero value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tags import without

#: Rows of a Parquet row group of the long store; genes are sorted, so groups can be skipped by their range.
ROW_GROUP = 65_536


def expression(matrix: DataFrame, genes: DataFrame, cells: DataFrame) -> DataFrame:
    """(gene, cell_id, count) from 1-based (row, col, count) and the index tables (position, gene) and (position,
    cell_id). The index tables are small; the planner broadcasts them if they are."""
    g = genes.select(F.col("position").alias("row"), "gene")
    c = cells.select(F.col("position").alias("col"), "cell_id")
    return matrix.join(g, "row").join(c, "col").select("gene", "cell_id", "count")


def totals(long: DataFrame) -> DataFrame:
    """Per cell the sum of counts over all genes."""
    return long.groupBy("cell_id").agg(F.sum("count").alias("total_counts"))


def top_genes(long: DataFrame, n: int) -> DataFrame:
    """Per cell the total over all genes and the ``n`` genes of the largest counts; ties by gene."""
    order = Window.partitionBy("cell_id").orderBy(F.desc("count"), "gene")
    best = long.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    best = best.groupBy("cell_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "gene"))), lambda x: x["gene"]), ",").alias("top"))
    return totals(long).join(best, "cell_id")


def sparse_json(long: DataFrame) -> DataFrame:
    """Per cell a JSON object of its non-zero counts, in the order of genes."""
    own = F.sort_array(F.collect_list(F.struct("gene", "count")))
    return long.where("count <> 0").groupBy("cell_id").agg(F.to_json(F.map_from_entries(own)).alias("expression"))


def dense_vectors(long: DataFrame, panel: list[str], cells: DataFrame) -> DataFrame:
    """Per cell its counts in the order of ``panel``, zeros included. One aggregation, no panel x cells join."""
    sums = long.groupBy("cell_id").agg(*[F.coalesce(F.sum(F.when(F.col("gene") == g, F.col("count"))), F.lit(0)).alias(f"_{i}") for i, g in enumerate(panel)])
    own = cells.select("cell_id").join(sums, "cell_id", "left")
    return own.select("cell_id", F.array(*[F.coalesce(F.col(f"_{i}"), F.lit(0)) for i in range(len(panel))]).alias("vector"))


def gene_list(long: DataFrame) -> DataFrame:
    return long.select("gene").distinct().orderBy("gene")


def wide(long: DataFrame, markers: list[str]) -> DataFrame:
    """cell_id and a float column a marker; nulls where a cell has none."""
    return long.groupBy("cell_id").agg(*[F.sum(F.when(F.col("gene") == m, F.col("count"))).cast("float").alias(m) for m in markers])


def write_wide(store: DataFrame, path: str) -> None:
    """Column pruning reads one marker and the key; byte-stream split suits floats."""
    store.write.mode("overwrite").option("compression", "snappy").parquet(path)


def write_long(long: DataFrame, path: str, parts: int | None = None) -> None:
    """Range-partitioned and sorted by gene name: a gene's rows are neighbours, other row groups are skipped."""
    ranged = long.repartitionByRange(parts, "gene", "cell_id") if parts else long.repartitionByRange("gene", "cell_id")
    ranged.sortWithinPartitions("gene", "cell_id").write.mode("overwrite").option("parquet.block.row.count.limit", ROW_GROUP).parquet(path)


def gene_lookup(long: DataFrame, cells: DataFrame, gene: str) -> DataFrame:
    """Every cell with its count of one gene, 0 where it has none. The gene's filter is pushed to the scan."""
    own = long.where(F.col("gene") == gene).groupBy("cell_id").agg(F.sum("count").alias("count"))
    return cells.select("cell_id").join(own, "cell_id", "left").select("cell_id", F.coalesce("count", F.lit(0)).alias("count"))


def marker_lookup(store: DataFrame, cells: DataFrame, marker: str) -> DataFrame:
    """Every cell with one marker of the wide store; two columns are read."""
    return cells.select("cell_id").join(store.select("cell_id", F.col(marker).alias("value")), "cell_id", "left")


def scale_of(df: DataFrame, column: str, share: float = 0.999, most: int = 65_535) -> DataFrame:
    """One row: the winsorised value of a unit of the quantised column, 1 where that would be 0."""
    step = F.percentile(column, F.lit(share)) / F.lit(float(most))
    return df.agg(F.when(step > 0, step).otherwise(F.lit(1.0)).alias("scale"))


def quantised(df: DataFrame, column: str, scale: Column, most: int = 65_535) -> Column:
    """round-half-even(value / scale), clipped to [0, most]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(float(most)), F.rint(F.col(column) / scale))).cast("int")


def migrate(tiles: DataFrame, markers: list[str], key: str = "cell_id", tags: str = "tags") -> tuple[DataFrame, DataFrame]:
    """(lean tiles, wide store): marker tags leave the tiles; of a cell's rows the one of the coarsest zoom, then the
    first tile, fills the store. Geometry stays as it is."""
    lean = tiles.withColumn(tags, without(F.col(tags), markers))
    columns = [F.element_at(tags, F.lit(m)).try_cast("float").alias(m) for m in markers]
    rows = tiles.where(F.map_contains_key(tags, key)).select(F.element_at(tags, F.lit(key)).alias("cell_id"), F.struct("zoom", "tile_x", "tile_y", "feature_id").alias("_at"), F.struct(*columns).alias("_v"))
    store = rows.groupBy("cell_id").agg(F.min_by("_v", "_at").alias("v")).select("cell_id", "v.*")
    return lean, store


def same_geometry(before: DataFrame, after: DataFrame, columns: list[str]) -> bool:
    """Whether two tables have the same rows of geometry, as often."""
    a, b = before.select(*columns), after.select(*columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def geometry_changes(before: DataFrame, after: DataFrame, columns: list[str], group: str) -> DataFrame:
    """(group, missing, added): rows of ``before`` that ``after`` lacks, and the other way round, as often as they are."""
    # one exchange for both directions: a row of either table by how much oftener it is in the other
    sides = before.select(*columns, F.lit(1).alias("_d")).unionByName(after.select(*columns, F.lit(-1).alias("_d")))
    rows = sides.groupBy(*columns).agg(F.sum("_d").alias("_d"), F.max("_d").alias("_in"))
    more = lambda c: F.coalesce(F.sum(F.greatest(c, F.lit(0).cast("long"))), F.lit(0).cast("long"))
    known = F.max(F.when(F.col("_in") > 0, 1))
    found = rows.groupBy(group).agg(more(F.col("_d")).alias("missing"), more(-F.col("_d")).alias("added"), known.alias("_in"))
    return found.where("_in = 1 or added > 0").drop("_in")
