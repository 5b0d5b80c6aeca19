"""Sources whose rows are tables already: points, vertex rows, meshes, matrices, annotations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def rings(df: DataFrame, ident: str, x: str, y: str, order: str, least: int = 3) -> DataFrame:
    """(id, ring) from a vertex a row: vertices in order, groups of fewer than ``least`` dropped. Grouping is over
    the whole input, wherever a group's rows lie."""
    df = df.na.drop(subset=[ident, x, y])
    own = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(x).alias("x"), F.col(y).alias("y"))))
    out = df.groupBy(F.col(ident).alias("id")).agg(own.alias("ring")).where(F.size("ring") >= least)
    return out.withColumn("ring", F.transform("ring", lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"))))


def matrix_market(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(row, col, count) and the index tables (position, gene) and (position, cell_id) of a 10x matrix folder.

    Positions are 1-based line numbers. A matrix whose shape is the transpose of (features, barcodes) is turned; any
    other shape raises ValueError.
    """
    def numbered(name: str, column: str, field: int) -> DataFrame:
        lines = spark.read.text(f"{folder}/{name}", wholetext=True).select(F.posexplode(F.split(F.rtrim("value", F.lit("\n")), "\r?\n")).alias("i", "line"))
        return lines.select((F.col("i") + 1).cast("long").alias("position"), F.split("line", "\t")[field].alias(column))

    genes, cells = numbered("features.tsv.gz", "gene", 1), numbered("barcodes.tsv.gz", "cell_id", 0)
    lines = spark.read.text(f"{folder}/matrix.mtx.gz").where("not startswith(value, '%') and trim(value) <> ''").select(F.split(F.trim("value"), r"\s+").alias("c"))
    # the size line is the first that isn't a comment; a gzip file is one partition, so it is that partition's first
    shape = [int(v) for v in lines.first()["c"]]
    have = (genes.count(), cells.count())
    if tuple(shape[:2]) not in (have, have[::-1]):
        raise ValueError(f"the matrix is {shape[0]} x {shape[1]}, the index tables have {have[0]} and {have[1]} rows")
    flip = tuple(shape[:2]) != have
    w = lines.withColumn("_i", F.monotonically_increasing_id()).where("_i > 0")
    row, col = (1, 0) if flip else (0, 1)
    coo = w.select(F.col("c")[row].cast("long").alias("row"), F.col("c")[col].cast("long").alias("col"), F.col("c")[2].cast("double").cast("long").alias("count"))
    return coo, genes, cells


def clusters(spark: SparkSession, path: str) -> DataFrame:
    """(cell_id, cluster) of a CSV file with columns Barcode and Cluster in any case; other clusters than whole numbers go."""
    from ..operators.tags import pick_alias

    df = spark.read.option("header", True).csv(path)
    a, b = pick_alias(df.columns, ["barcode", "cell_id"]), pick_alias(df.columns, ["cluster"])
    return df.select(F.col(a).alias("cell_id"), F.col(b).try_cast("int").alias("cluster")).where("cluster is not null")


#: Columns of a cell summary that become tags where they exist (fixed values).
SUMMARY = ("x_centroid", "y_centroid", "transcript_counts", "total_counts", "cell_area", "nucleus_area")


def cell_summary(df: DataFrame, selected: DataFrame | None = None, key: str = "cell_id") -> DataFrame:
    own = df.select(key, *[c for c in SUMMARY if c in df.columns])
    return own.join(selected.select(key), key, "left_semi") if selected is not None else own


def pixel_size(spark: SparkSession, path: str) -> float:
    """pixel_size of an experiment's JSON file."""
    return float(spark.read.text(path, wholetext=True).select(F.get_json_object("value", "$.pixel_size")).first()[0])


def annotations(spark: SparkSession, path: str, classes: list[str] | None = None, pattern: str | None = None) -> DataFrame:
    """Rows of a TSV of neurons whose root_id is a number, of given classes or names by a pattern."""
    df = spark.read.option("header", True).option("sep", "\t").csv(path).where("root_id rlike '^[0-9]+$'")
    df = df.where(F.col("super_class").isin(classes)) if classes else df
    return df.where(F.col("cell_type").rlike(pattern)) if pattern else df


def with_coordinates(cells: DataFrame, coordinates: DataFrame, key: str = "cell_label") -> DataFrame:
    """Cells left-joined with coordinates (colliding columns get _ccf), and x, y, z from the first set there is."""
    from ..operators.relations import suffixed

    out = suffixed(cells, coordinates, key, "_ccf")
    for a in "xyz":
        names = [c for c in (f"{a}_ccf", f"{a}_reconstructed", f"{a}_section", a) if c in out.columns]
        out = out.withColumn(f"pos_{a}", F.coalesce(*[F.col(n).cast("double") for n in names]) if names else F.lit(None).cast("double"))
    return out


def label_rows(spark: SparkSession, path: str) -> DataFrame:
    """(label, n, z0, z1, y0, y1, x0, x1) of the labels over 0 of .npy volumes or images, by file.

    TIFF needs a reader that isn't here; it raises ImportError.
    """
    if path.lower().endswith((".tif", ".tiff")):
        import tifffile  # noqa: F401  not installed everywhere

    def run(batches):
        import io

        import pyarrow as pa

        for batch in batches:
            rows = []
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                volume = np.load(io.BytesIO(data), allow_pickle=False)
                volume = volume[None] if volume.ndim == 2 else volume
                at = np.nonzero(volume > 0)
                labels, of, count = np.unique(volume[at], return_inverse=True, return_counts=True)
                for k, (label, n) in enumerate(zip(labels.tolist(), count.tolist(), strict=True)):
                    own = [a[of == k] for a in at]
                    rows.append((name, int(label), n, *[int(v) for a in own for v in (a.min(), a.max())]))
            kinds = [pa.string()] + [pa.int64()] * 8
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["path", "label", "n", "z0", "z1", "y0", "y1", "x0", "x1"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, label long, n long, z0 long, z1 long, y0 long, y1 long, x0 long, x1 long")


def label_rectangles(rows: DataFrame, least: int = 1) -> DataFrame:
    """The pixel rectangle of each label of at least ``least`` pixels, as a ring."""
    x0, x1, y0, y1 = (F.col(c).cast("double") for c in ("x0", "x1", "y0", "y1"))
    ring = F.array(F.array(x0, y0), F.array(x1 + 1, y0), F.array(x1 + 1, y1 + 1), F.array(x0, y1 + 1))
    return rows.where(F.col("n") >= least).select("label", "n", F.array(ring).alias("parts"))


def random_polygons(spark: SparkSession, grid: int, cell: float, least: int = 5, most: int = 32, seed: int = 1) -> DataFrame:
    """One convex polygon inside each cell of a grid x grid square, and metas of each kind; the same for a seed."""
    ident = F.col("id")
    u = lambda k: F.pmod(F.xxhash64(ident, F.lit(seed), F.lit(k)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    n = (F.lit(least) + F.floor(u(0) * (most - least + 1))).cast("int")
    cx, cy = (ident % grid + 0.5) * cell, (F.floor(ident / grid) + 0.5) * cell
    radius = (0.25 + 0.24 * u(1)) * cell
    # vertices on a circle in order of angle make a convex ring
    ring = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array(cx + radius * F.cos((i + u(2)) * 6.283185307179586 / n), cy + radius * F.sin((i + u(2)) * 6.283185307179586 / n)))
    tags = F.create_map(F.lit("string_meta"), F.concat(F.lit("v"), F.floor(u(3) * 40).cast("string")), F.lit("int_meta"), F.floor(u(4) * 40).cast("string"), F.lit("float_meta"), F.round(u(5), 4).cast("string"))
    return spark.range(grid * grid).select(ident.alias("fid"), F.lit(3).cast("tinyint").alias("kind"), F.array(ring).alias("parts"), tags.alias("tags"))


def random_3d(spark: SparkSession, n: int, kind: str = "tin", seed: int = 1) -> DataFrame:
    """``n`` points, lines of five vertices or clusters of four triangles in the unit cube."""
    ident = F.col("id")
    u = lambda k: F.pmod(F.xxhash64(ident, F.lit(seed), F.lit(k)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    centre = [0.1 + 0.8 * u(a) for a in range(3)]
    vertex = lambda k: F.array(*[centre[a] + 0.05 * (u(10 + 3 * k + a) - 0.5) for a in range(3)])
    code, parts = {
        "point": (1, F.array(F.array(F.array(*centre)))),
        "line": (2, F.array(F.array(*[vertex(k) for k in range(5)]))),
        "tin": (5, F.array(*[F.array(*[vertex(3 * t + k) for k in range(3)]) for t in range(4)])),
    }[kind]
    return spark.range(n).select(ident.alias("fid"), F.lit(code).cast("tinyint").alias("kind"), parts.alias("parts"), F.create_map(F.lit("i"), ident.cast("string")).alias("tags"))


def arrow_features(spark: SparkSession, table, geometry_column: str = "geometry") -> DataFrame:
    """Feature rows of an Arrow table with a WKB column; the other columns become tags. Nothing is written: the
    table is small enough to be in memory already."""
    from .features import tabled_features

    return tabled_features(spark.createDataFrame(table), geometry_column)


def example_files(spark: SparkSession, folder: str, suffix: str = ".json") -> list[str]:
    """Names of the files in a folder that end in ``suffix``, in order."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder).select("path")
    return sorted(r["path"].rsplit("/", 1)[-1] for r in files.collect())


#: Where a morphology image may lie in an output folder, the best first (fixed values).
MORPHOLOGY = ("morphology_focus/ch0000_dapi.ome.tif", "morphology_focus/morphology_focus_0000.ome.tif", "morphology_focus.ome.tif")


def morphology_image(names: list[str]) -> str | None:
    """The first known place of a morphology image among a folder's file names."""
    return next((m for m in MORPHOLOGY if m in names), None)
