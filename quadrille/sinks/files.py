"""Files from rows: (path, content) rows are written by the executors through Arrow's file systems; tables by Spark."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_files(rows: DataFrame, root: str) -> int:
    """Writes each row's content to root/path and returns the number of files. A retried task writes the same bytes
    to the same place, so lost executors do no harm."""

    def run(batches):
        from pyarrow import fs

        for batch in batches:
            where, base = fs.FileSystem.from_uri(root if "://" in root else f"file://{root}")
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                at = f"{base}/{path}"
                where.create_dir(at.rpartition("/")[0], recursive=True)
                with where.open_output_stream(at) as out:
                    out.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return rows.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def write_json(spark: SparkSession, document: dict | list, root: str, path: str) -> None:
    write_files(spark.createDataFrame([(path, json.dumps(document).encode())], "path string, content binary"), root)


def write_pyramid(rows: DataFrame, path: str, codec: str = "zstd", most_rows: int | None = None, sort: tuple[str, ...] = ("tile_x", "tile_y", "feature_id")) -> None:
    """A Parquet table in folders zoom=N. Zooms are spread over tasks by tile, not one task a zoom, and sorted, so
    tile filters skip row groups."""
    out = rows.repartition("zoom", *[c for c in ("tile_x", "tile_y", "tile_d") if c in rows.columns]).sortWithinPartitions("zoom", *sort).write.mode("overwrite").partitionBy("zoom").option("compression", codec)
    (out.option("maxRecordsPerFile", most_rows) if most_rows else out).parquet(path)


def write_single(rows: DataFrame, path: str, codec: str = "zstd") -> None:
    """One file sorted by zoom, for tables that fit in a task."""
    rows.coalesce(1).sortWithinPartitions("zoom").write.mode("overwrite").option("compression", codec).parquet(path)


def repartitioned(spark: SparkSession, source: str, target: str, most_bytes: int) -> dict[str, int]:
    """Rewrites a pyramid so that no file holds more than about ``most_bytes`` of geometry; returns rows a file by zoom."""
    df = spark.read.parquet(source)
    sizes = df.groupBy("zoom").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("positions") + F.octet_length("indices")).alias("bytes")).collect()
    per = {r["zoom"]: max(1, int(r["n"] * most_bytes // max(r["bytes"], 1))) for r in sizes}
    files = F.lit(1)
    for r in sizes:
        files = F.when(F.col("zoom") == r["zoom"], F.lit(-(-r["n"] // per[r["zoom"]]))).otherwise(files)
    df.withColumn("_part", F.pmod(F.xxhash64("feature_id", "tile_x", "tile_y"), files)).repartition("zoom", "_part").drop("_part").write.mode("overwrite").partitionBy("zoom").option("maxRecordsPerFile", min(per.values(), default=1)).parquet(target)
    return {str(k): v for k, v in per.items()}


def prime(spark: SparkSession, source: str, table: str) -> None:
    """Keeps a table in Spark's columnar cache under a name, for repeated reads."""
    spark.read.parquet(source).createOrReplaceTempView(table)
    spark.catalog.cacheTable(table)


def deprime(spark: SparkSession, table: str) -> None:
    spark.catalog.uncacheTable(table)
    spark.catalog.dropTempView(table)


def run_summary(errors: DataFrame, done: int) -> dict[str, int]:
    """Counts of an error log by severity, and of what went well."""
    return {"ok": done} | {r["severity"]: r["n"] for r in errors.groupBy("severity").agg(F.count(F.lit(1)).alias("n")).collect()}
