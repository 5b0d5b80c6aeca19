"""Converters by name, and the command line: python -m quadrille.registry list | convert FORMAT INPUT OUTPUT [--config FILE]."""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import facets, fragments, pyramid, tags
from .sinks import files, tilesets
from .sources import features, tables

Converter = Callable[[SparkSession, str, str, dict], dict]
_CONVERTERS: dict[str, Converter] = {}


def register(name: str) -> Callable[[Converter], Converter]:
    def add(f: Converter) -> Converter:
        _CONVERTERS[name] = f
        return f

    return add


def list_formats() -> list[str]:
    return sorted(_CONVERTERS)


def convert(spark: SparkSession, kind: str, source: str, target: str, config: dict | None = None) -> dict:
    """Runs a converter; returns what it wrote. An unknown format raises ValueError."""
    if kind not in _CONVERTERS:
        raise ValueError(f"unknown format {kind!r}; known: {', '.join(list_formats())}")
    return _CONVERTERS[kind](spark, source, target, config or {})


def feature_bounds(df: DataFrame, axes: int = 2) -> tuple[float, ...]:
    """World bounds of feature rows; the unit square or cube without any."""
    vertex = lambda k: F.transform(F.flatten("parts"), lambda p: p[k])
    low = [F.coalesce(F.min(F.array_min(vertex(k))), F.lit(0.0)).alias(f"a{k}") for k in range(axes)]
    high = [F.coalesce(F.max(F.array_max(vertex(k))), F.lit(1.0)).alias(f"b{k}") for k in range(axes)]
    row = df.agg(*low, *high).first()
    return tuple(float(row[f"{n}{k}"]) for n in "ab" for k in range(axes))


def _split_facets(df: DataFrame, policy: tags.FacetPolicy) -> tuple[DataFrame, DataFrame | None]:
    """Lean features and the wide store of what the policy takes out of their tags."""
    rows = tags.map_entries_of(df, "fid", "tags")
    number = F.col("value").try_cast("double")
    names = rows.groupBy("name").agg(F.count_distinct("value").alias("n_distinct"), F.bool_and(number.isNotNull()).alias("numeric"))
    keys = [r["name"] for r in tags.facet_keys(names, policy).where("facet").select("name").orderBy("name").collect()]
    if not keys:
        return df, None
    key = F.coalesce(F.element_at("tags", F.lit(policy.key)), F.col("fid").cast("string"))
    store = df.select(key.alias("cell_id"), *[F.element_at("tags", F.lit(k)).try_cast("float").alias(k) for k in keys])
    return df.withColumn("tags", tags.without(F.col("tags"), keys)), store


def _write_2d(spark: SparkSession, df: DataFrame, target: str, config: dict, layer: str) -> dict:
    top, low = config.get("max_zoom", 4), config.get("min_zoom", 0)
    box = tuple(config["bounds"]) if config.get("bounds") else feature_bounds(df)
    store = None
    if "facets" in config:
        df, store = _split_facets(df, tags.FacetPolicy.from_config(config["facets"]))
    frags = fragments.fragments(df, box, top, low, config.get("buffer", 64 / 4096), config.get("simplify", True), config.get("polygon_tolerances"), gate=config.get("tag_min_zoom")).persist()
    out = {"bounds": list(box), "tiles": files.write_files(tilesets.mvt_tiles(frags, layer), f"{target}/vectors")}
    files.write_pyramid(fragments.encoded(frags, box), f"{target}/parquet")
    stats = tags.property_ranges(tags.map_entries_of(df, "fid", "tags"))
    files.write_json(spark, tilesets.tilejson(layer, box, low, top, stats), target, "metadata.json")
    if store is not None:
        facets.write_wide(store, f"{target}/facets/expression.parquet")
        out["facets"] = store.columns[1:]
    frags.unpersist()
    return out


@register("geojson")
def convert_geojson(spark: SparkSession, source: str, target: str, config: dict) -> dict:
    """GeoJSON files to vector tiles, a Parquet pyramid, metadata and, by a policy, a facet store."""
    return _write_2d(spark, features.geojson(spark, source, promote_id=config.get("promote_id")), target, config, config.get("layer", "features"))


@register("obj")
def convert_obj(spark: SparkSession, source: str, target: str, config: dict) -> dict:
    """OBJ meshes to levels of detail, glTF tiles with their tileset, and a Parquet pyramid."""
    import numpy as np
    import pyarrow as pa

    meshes = features.meshes(spark, source)
    row = features.mesh_bounds(meshes).first()
    box = tuple(config["bounds"]) if config.get("bounds") else tuple(float(row[f"{a}_{e}"]) for e in ("min", "max") for a in "xyz")

    def parts(batches):
        for batch in batches:
            rows = []
            for p, i in zip(batch.column("positions").to_pylist(), batch.column("indices").to_pylist(), strict=True):
                v, f = np.frombuffer(p, "<f4").reshape(-1, 3), np.frombuffer(i, "<u4").reshape(-1, 3)
                rows.append(v[f].astype(float).tolist())
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(rows, pa.list_(pa.list_(pa.list_(pa.float64())))), batch.column("tags")], names=["name", "parts", "tags"])

    from .operators.sequences import dense_ids

    own = meshes.select("name", "positions", "indices", "tags").mapInArrow(parts, f"name string, parts {features.PARTS}, tags map<string,string>")
    own = dense_ids(own, ["name"]).select("fid", F.lit(5).cast("tinyint").alias("kind"), "parts", "tags")
    frags = fragments.fragments(own, box, config.get("max_zoom", 2)).persist()
    out = {"bounds": list(box), "meshes": row["meshes"], "tiles": files.write_files(tilesets.glb_tiles(frags, box), f"{target}/3dtiles")}
    files.write_json(spark, tilesets.tileset(frags, box), f"{target}/3dtiles", "tileset.json")
    files.write_pyramid(fragments.encoded(frags, box), f"{target}/parquet")
    frags.unpersist()
    return out


@register("xenium")
def convert_xenium(spark: SparkSession, source: str, target: str, config: dict) -> dict:
    """Cell and transcript tables to one set of tiles, a pyramid a layer, weighted points by zoom, and a long facet store."""
    scale = 1.0 / features_scale(spark, source)
    place = F.struct("_metadata.file_path", "_metadata.row_index").alias("_pos")  # Spark packs files by size, in any order
    cells = features.polygons(spark.read.parquet(f"{source}/cell_boundaries.parquet").select("*", place), "cell_id", "vertex_x", "vertex_y", "_pos", "cells", scale)
    spots = tags.quality_filter(spark.read.parquet(f"{source}/transcripts.parquet"), "feature_name", "qv" if config.get("qv", True) else None)
    spots = features.points(spots, "x_location", "y_location", "feature_name", "gene", "transcripts", scale)
    box = pyramid.bounds_of((spots, "x", "y"), (cells.select(F.explode(F.col("parts")[0]).alias("p")).select(F.col("p")[0].alias("x"), F.col("p")[1].alias("y")), "x", "y")).first()
    bounds = (box["x_min"], box["y_min"], box["x_max"], box["y_max"])
    out = _write_2d(spark, cells, f"{target}/cells", config | {"bounds": bounds}, "cells")
    low = spark.createDataFrame([(bounds[0], bounds[2], bounds[1], bounds[3])], "x_min double, x_max double, y_min double, y_max double")
    lod = pyramid.merged_points(pyramid.over_zooms(pyramid.normalised(spots.withColumn("gene", F.element_at("tags", F.lit("gene"))), low), config.get("max_zoom", 4)), "gene")
    lod.write.mode("overwrite").partitionBy("zoom").parquet(f"{target}/transcripts")
    try:
        coo, genes, ids = tables.matrix_market(spark, f"{source}/cell_feature_matrix")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    else:
        facets.write_long(facets.expression(coo, genes, ids), f"{target}/facets/expression.parquet")
        out["genes"] = genes.count()
    return out


def features_scale(spark: SparkSession, source: str) -> float:
    return tables.pixel_size(spark, f"{source}/experiment.xenium")


@register("labelmask")
def convert_labelmask(spark: SparkSession, source: str, target: str, config: dict) -> dict:
    """The rectangles of a label volume's labels, with properties, as vector tiles and a pyramid."""
    rows = tables.label_rectangles(tables.label_rows(spark, source), config.get("min_pixels", 1))
    own = rows.select(F.col("label").alias("fid"), F.lit(3).cast("tinyint").alias("kind"), "parts", F.create_map(F.lit("label"), F.col("label").cast("string"), F.lit("n"), F.col("n").cast("string")).alias("tags"))
    if config.get("properties"):
        from .operators.relations import by_label

        p = spark.read.parquet(config["properties"])
        key = config.get("id_column", "label")
        names = [c for c in p.columns if c != key]
        more = F.map_filter(F.create_map(*[x for c in names for x in (F.lit(c), F.col(c).cast("string"))]), lambda k, v: v.isNotNull())
        joined = by_label(own, p.select(F.col(key).alias("key"), more.alias("more")), "fid")
        own = joined.withColumn("tags", tags.merge_maps(F.col("tags"), F.col("more"))).drop("more")
    return _write_2d(spark, own, target, config, "labels")


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quadrille")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list")
    one = commands.add_parser("convert")
    for name in ("format", "source", "target"):
        one.add_argument(name)
    one.add_argument("--config", help="a JSON file")
    a = parser.parse_args(arguments)
    if a.command == "list":
        print("\n".join(list_formats()))
        return 0
    config = json.load(open(a.config)) if a.config else {}
    print(json.dumps(convert(SparkSession.builder.getOrCreate(), a.format, a.source, a.target, config)))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
