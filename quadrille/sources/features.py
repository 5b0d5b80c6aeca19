"""Features from text and binary files: GeoJSON, OBJ, SWC, GeoParquet, CityJSON, GLB, tiles, label volumes.

A feature row is fid long, kind tinyint (1 point, 2 line, 3 polygon, 4 surface, 5 TIN), parts (vertices of coordinates
of parts; rings without their repeated last vertex) and tags map<string,string>. Files are read by Spark's own readers,
so any store that Spark reaches works; parsing of one file or feature happens inside Arrow batches.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..codecs import glb, mvt, tile3d
from ..functions import geometry
from ..operators.sequences import dense_ids
from ..operators.tags import scalar_tags

PARTS = "array<array<array<double>>>"
FEATURE = f"fid long, kind tinyint, parts {PARTS}, tags map<string,string>"


def flat_geometries(g: dict | None) -> Iterator[tuple[int, list]]:
    """(kind, parts) of a geometry: points and lines of multi-geometries one by one, the rings of all polygons
    together, collections member by member. Rings of under 3 and lines of under 2 vertices go."""
    if not g:
        return
    kind, c = g.get("type"), g.get("coordinates")
    if kind == "GeometryCollection":
        for x in g.get("geometries") or []:
            yield from flat_geometries(x)
    elif kind in ("Point", "MultiPoint"):
        for p in [c] if kind == "Point" else c or []:
            if p:
                yield geometry.POINT, [[list(map(float, p))]]
    elif kind in ("LineString", "MultiLineString"):
        for line in [c] if kind == "LineString" else c or []:
            if len(line) >= 2:
                yield geometry.LINE, [[list(map(float, p)) for p in line]]
    elif kind in ("Polygon", "MultiPolygon", "TIN", "PolyhedralSurface"):
        rings = c or [] if kind == "Polygon" else [r for polygon in c or [] for r in polygon]
        rings = [r[:-1] if len(r) > 1 and r[0] == r[-1] else r for r in rings]
        rings = [[list(map(float, p)) for p in r] for r in rings if len(r) >= 3]
        if rings:
            yield {"TIN": geometry.TIN, "PolyhedralSurface": geometry.SURFACE}.get(kind, geometry.POLYGON), rings


def _parsed(df: DataFrame, keep: list[str]) -> DataFrame:
    """Explodes the JSON text in column ``geometry`` into (keep..., part, kind, parts)."""
    kinds = dict(df.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in keep) + f", part int, kind tinyint, parts {PARTS}"

    def run(batches):
        for batch in batches:
            rows, index = [], []
            for i, text in enumerate(batch.column("geometry").to_pylist()):
                try:
                    found = list(flat_geometries(json.loads(text) if text else None))
                except (ValueError, TypeError, KeyError):
                    found = []  # not a geometry
                for part, (kind, parts) in enumerate(found):
                    rows.append((part, kind, parts))
                    index.append(i)
            own = batch.take(pa.array(index, pa.int64()))
            arrays = [own.column(c) for c in keep] + [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int8()), pa.array([r[2] for r in rows], pa.list_(pa.list_(pa.list_(pa.float64()))))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "part", "kind", "parts"])

    return df.select(*keep, "geometry").mapInArrow(run, schema)


def geojson(spark: SparkSession, *paths: str, promote_id: str | None = None, generate_id: bool = False) -> DataFrame:
    """Feature rows of GeoJSON files: collections, features or bare geometries; what can't be read gives none.

    fid numbers geometries in the order of file, feature and part. The feature's own id, or the property
    ``promote_id``, becomes tag "id".
    """
    if promote_id and generate_id:
        raise ValueError("promote_id and generate_id exclude each other")
    one = "type string, id string, featureClass string, geometry string, properties string"
    files = spark.read.text(list(paths), wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))
    top = files.withColumn("j", F.from_json("text", f"{one}, features array<struct<type:string,id:string,featureClass:string,geometry:string,properties:string>>"))
    bare = F.struct(F.lit("Feature").alias("type"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("featureClass"), F.col("text").alias("geometry"), F.lit(None).cast("string").alias("properties"))
    single = F.struct("j.type", "j.id", "j.featureClass", "j.geometry", "j.properties")
    rows = top.select("file", F.posexplode(F.when(F.col("j.type") == "FeatureCollection", F.col("j.features")).when(F.col("j.type") == "Feature", F.array(single)).otherwise(F.array(bare))).alias("pos", "f"))
    tags = F.coalesce(scalar_tags(F.col("f.properties")), F.create_map().cast("map<string,string>"))
    ident = F.coalesce(F.element_at(tags, F.lit(promote_id)), F.col("f.id")) if promote_id else F.col("f.id")
    extra = F.map_filter(F.create_map(F.lit("id"), ident, F.lit("featureClass"), F.col("f.featureClass")), lambda k, v: v.isNotNull())
    from ..operators.tags import merge_maps

    rows = rows.select("file", "pos", F.col("f.geometry").alias("geometry"), merge_maps(tags, extra).alias("tags"))
    out = dense_ids(_parsed(rows, ["file", "pos", "tags"]), ["file", "pos", "part"])
    if generate_id:
        out = out.withColumn("tags", merge_maps(F.col("tags"), F.create_map(F.lit("id"), F.col("fid").cast("string"))))
    return out.select("fid", "kind", "parts", "tags")


def points(df: DataFrame, x: str, y: str, prop: str | None = None, name: str = "gene", layer: str = "points", scale: float = 1.0) -> DataFrame:
    """Points of any table with two coordinate columns, as columns (no arrays): x, y, tags."""
    tags = [F.lit("layer_type"), F.lit(layer)] + ([F.lit(name), F.col(prop).cast("string")] if prop else [])
    return df.na.drop(subset=[x, y]).select((F.col(x).cast("double") * scale).alias("x"), (F.col(y).cast("double") * scale).alias("y"), F.create_map(*tags).alias("tags"))


def polygons(df: DataFrame, ident: str, x: str, y: str, order: str, layer: str = "polygons", scale: float = 1.0) -> DataFrame:
    """Feature rows of a vertex-a-row table; tags layer_type and cell_id."""
    from .tables import rings

    own = rings(df.withColumn(x, F.col(x).cast("double") * scale).withColumn(y, F.col(y).cast("double") * scale), ident, x, y, order)
    ring = F.transform("ring", lambda v: F.array(v["x"], v["y"]))
    ring = F.when(F.element_at(ring, 1) == F.element_at(ring, -1), F.slice(ring, 1, F.size(ring) - 1)).otherwise(ring)
    tags = F.create_map(F.lit("layer_type"), F.lit(layer), F.lit("cell_id"), F.col("id").cast("string"))
    return dense_ids(own, ["id"]).select("fid", F.lit(geometry.POLYGON).cast("tinyint").alias("kind"), F.array(ring).alias("parts"), tags.alias("tags")).where(F.size(F.col("parts")[0]) >= 3)


def features(df: DataFrame) -> DataFrame:
    """Feature rows of a table in the intermediate form: xy (flat), geom_type, ring_lengths, tags; 3D with z."""
    dims = 3 if "z" in df.columns else 2
    n = F.floor(F.size("xy") / 2).cast("int")
    vertex = (lambda i: F.array(F.col("xy")[2 * i], F.col("xy")[2 * i + 1], F.col("z")[i])) if dims == 3 else (lambda i: F.array(F.col("xy")[2 * i], F.col("xy")[2 * i + 1]))
    flat = F.transform(F.sequence(F.lit(0), n - 1), vertex)
    from ..functions.flat import split_rings

    parts = F.when(F.coalesce(F.size("ring_lengths"), F.lit(0)) > 0, split_rings(flat, F.col("ring_lengths"))).otherwise(F.array(flat))
    own = df.where("size(xy) >= 2")
    return own.select("fid", F.col("geom_type").cast("tinyint").alias("kind"), parts.cast(PARTS).alias("parts"), "tags")


# --- text formats -------------------------------------------------------------------------------------------------


def swc(spark: SparkSession, *paths: str) -> DataFrame:
    """(neuron, id, type, x, y, z, r, parent) of SWC text: 7 columns, # comments, whole numbers written as floats."""
    from ..functions.text import neuron_name

    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(list(paths)).select(neuron_name(F.input_file_name()).alias("neuron"), F.trim("value").alias("line"), parts.alias("c")).where("line <> '' and not startswith(line, '#') and size(c) >= 7")
    number = lambda i: F.col("c")[i].try_cast("double")
    return rows.select("neuron", number(0).cast("int").alias("id"), number(1).cast("int").alias("type"), number(2).alias("x"), number(3).alias("y"), number(4).alias("z"), number(5).alias("r"), number(6).cast("int").alias("parent"))


def valid_trees(nodes: DataFrame) -> DataFrame:
    """(neuron, problem) of trees without a root or with parents that don't exist."""
    own = nodes.select("neuron", F.col("id").alias("parent")).distinct().withColumn("_known", F.lit(True))
    joined = nodes.join(own, ["neuron", "parent"], "left")
    found = joined.groupBy("neuron").agg(F.max((F.col("parent") < 0).cast("int")).alias("roots"), F.sum(((F.col("parent") >= 0) & F.col("_known").isNull()).cast("int")).alias("lost"))
    return found.where("roots = 0 or lost > 0").select("neuron", F.when(F.col("roots") == 0, "no root").otherwise("unknown parent").alias("problem"))


def swc_text(nodes: DataFrame) -> DataFrame:
    """One line of text a node, in the order of ids inside a neuron."""
    return nodes.select("neuron", "id", F.concat_ws(" ", *[F.col(c).cast("string") for c in ("id", "type", "x", "y", "z", "r", "parent")]).alias("value")).sortWithinPartitions("neuron", "id")


def parse_obj(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Vertices and triangles of OBJ text: v/vt/vn corners, negative indices, faces of more corners as fans."""
    vertices, faces = [], []
    for line in text.splitlines():
        word = line.split()
        if not word:
            continue
        if word[0] == "v":
            vertices.append([float(v) for v in word[1:4]])
        elif word[0] == "f":
            corner = [int(w.split("/")[0]) for w in word[1:]]
            corner = [c - 1 if c > 0 else len(vertices) + c for c in corner]
            faces += [[corner[0], corner[i], corner[i + 1]] for i in range(1, len(corner) - 1)]
    return np.array(vertices, np.float64).reshape(-1, 3), np.array(faces, np.int64).reshape(-1, 3)


def _files(spark: SparkSession, paths: tuple[str, ...], glob: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(list(paths)).select("path", "content")


MESH = "name string, positions binary, indices binary, tags map<string,string>"


def _name(path: str) -> str:
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[0]


def meshes(spark: SparkSession, *paths: str, kind: str = "obj") -> DataFrame:
    """(name, positions, indices, tags) of OBJ, GLB or CityJSON files as float32 and uint32 bytes."""
    parsers = {"obj": lambda c: [("", parse_obj(c.decode()), {})], "glb": lambda c: [("", (lambda p, i: (p, i.reshape(-1, 3)))(*glb.decode(c)), {})], "cityjson": cityjson}

    def run(batches):
        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    for sub, (v, f), tags in parsers[kind](content):
                        rows.append((sub or _name(path), v.astype("<f4").tobytes(), f.astype("<u4").tobytes(), list(({"name": sub or _name(path)} | tags).items())))
                except (ValueError, IndexError, KeyError, UnicodeDecodeError):
                    continue  # a broken file doesn't stop the others; ``unreadable`` lists it
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.map_(pa.string(), pa.string()))], names=["name", "positions", "indices", "tags"])

    return _files(spark, paths, f"*.{'json' if kind == 'cityjson' else kind}").mapInArrow(run, MESH)


def unreadable(spark: SparkSession, found: DataFrame, *paths: str, glob: str | None = None) -> DataFrame:
    """An error log: files of which no row came out (phase, severity, item, message)."""
    names = _files(spark, paths, glob).select("path", F.regexp_replace(F.regexp_extract("path", "([^/]*)$", 1), r"\.[^.]*$", "").alias("name"))
    return names.join(found.select("name").distinct(), "name", "left_anti").select(F.lit("parse").alias("phase"), F.lit("error").alias("severity"), F.col("path").alias("item"), F.lit("no rows").alias("message"))


def cityjson(content: bytes, lod: str | None = None) -> list[tuple[str, tuple[np.ndarray, np.ndarray], dict]]:
    """(object, mesh, attributes) of a CityJSON file: scaled whole numbers, the wanted level of detail or the
    finest one, boundaries as fans."""
    doc = json.loads(content)
    t = doc.get("transform", {"scale": [1, 1, 1], "translate": [0, 0, 0]})
    v = np.array(doc["vertices"], float).reshape(-1, 3) * t["scale"] + t["translate"]
    out = []

    def rings(b):
        if b and isinstance(b[0], int):
            yield b
        else:
            for x in b:
                yield from rings(x)

    for name, item in doc.get("CityObjects", {}).items():
        shapes = sorted(item.get("geometry", []), key=lambda g: str(g.get("lod", "")))
        if shapes:
            g = next((s for s in shapes if str(s.get("lod")) == str(lod)), shapes[-1])
            f = np.array([[r[0], r[i], r[i + 1]] for r in rings(g["boundaries"]) for i in range(1, len(r) - 1)], np.int64).reshape(-1, 3)
            vertices, f = geometry.compacted(v, f) if len(f) else (v[:0], f)
            out.append((name, (vertices, f), {k: str(x) for k, x in item.get("attributes", {}).items() if isinstance(x, str | int | float)}))
    return out


def mesh_tables(df: DataFrame, positions: str, indices: str, prop: str | None = None, name: str = "name", layer: str = "meshes") -> DataFrame:
    """Meshes of a table with float32 and uint32 blobs."""
    tags = [F.lit("layer_type"), F.lit(layer)] + ([F.lit(name), F.col(prop).cast("string")] if prop else [])
    key = F.col(prop).cast("string") if prop else F.lit("")
    return df.where(f"{positions} is not null and {indices} is not null").select(key.alias("name"), F.col(positions).alias("positions"), F.col(indices).alias("indices"), F.create_map(*tags).alias("tags"))


def mesh_bounds(df: DataFrame) -> DataFrame:
    """Bounds of all meshes and their counts: x_min ... z_max, meshes, vertices, faces."""

    def run(batches):
        for batch in batches:
            rows = []
            for p, i in zip(batch.column("positions").to_pylist(), batch.column("indices").to_pylist(), strict=True):
                v = np.frombuffer(p, "<f4").reshape(-1, 3).astype(float)
                if len(v):
                    rows.append((*v.min(axis=0), *v.max(axis=0), len(v), len(i) // 12))
            cols = list(zip(*rows, strict=True)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in cols[:6]] + [pa.array(c, pa.int64()) for c in cols[6:]], names=["x0", "y0", "z0", "x1", "y1", "z1", "v", "f"])

    per = df.select("positions", "indices").mapInArrow(run, "x0 double, y0 double, z0 double, x1 double, y1 double, z1 double, v long, f long")
    low = [F.coalesce(F.min(f"{a}0"), F.lit(0.0)).alias(f"{a}_min") for a in "xyz"]
    high = [F.coalesce(F.max(f"{a}1"), F.lit(1.0)).alias(f"{a}_max") for a in "xyz"]
    return per.agg(*low, *high, F.count(F.lit(1)).alias("meshes"), F.sum("v").alias("vertices"), F.sum("f").alias("faces"))


def geoparquet(spark: SparkSession, path: str, column: str = "geometry") -> DataFrame:
    """Feature rows of a (Geo)Parquet table with WKB; the other columns become tags."""
    return tabled_features(spark.read.parquet(path), column)


def tabled_features(df: DataFrame, column: str = "geometry") -> DataFrame:
    """Feature rows of a table with a WKB column, in the order of its id (or first other) column."""
    rest = [c for c in df.columns if c not in (column, "bbox")]
    tags = F.map_filter(F.create_map(*[x for c in rest for x in (F.lit(c), F.col(c).cast("string"))]), lambda k, v: v.isNotNull()) if rest else F.create_map().cast("map<string,string>")
    order = [c for c in ("id",) if c in df.columns] or rest[:1]
    as_json = F.udf(lambda b: json.dumps(geometry.from_wkb(bytes(b))) if b is not None else None, "string", useArrow=True)
    rows = df.select(*[F.col(c).cast("string").alias(f"_{c}") for c in order], tags.alias("tags"), as_json(F.col(column)).alias("geometry"))
    keep = [*[f"_{c}" for c in order], "tags"]
    return dense_ids(_parsed(rows, keep), [*keep[:-1], "part"]).select("fid", "kind", "parts", "tags")


# --- tile directories ---------------------------------------------------------------------------------------------


def mvt_tiles(spark: SparkSession, path: str, bounds: tuple[float, float, float, float], zoom: int | None = None, tile_x: int | None = None, tile_y: int | None = None) -> DataFrame:
    """Features of a directory {z}/{x}/{y}.pbf in world coordinates; key filters come from paths, so other tiles
    are not opened."""
    from ..functions.text import parse_tile_path, tile_of
    from ..operators.pyramid import read

    z, x, y = parse_tile_path(tile_of(F.col("path")))
    files = _files(spark, (path,), "*.pbf").withColumn("zoom", z).withColumn("tile_x", x).withColumn("tile_y", y).where("zoom is not null")
    files = read(files, zoom=zoom, tile_x=tile_x, tile_y=tile_y)
    x0, y0, x1, y1 = bounds

    def run(batches):
        for batch in batches:
            rows = []
            for z, tx, ty, data in zip(*(batch.column(c).to_pylist() for c in ("zoom", "tile_x", "tile_y", "content")), strict=True):
                for layer in mvt.decode(data):
                    world = lambda p, e=layer["extent"], n=2**z, tx=tx, ty=ty: [float(np.float32(x0 + (tx + p[0] / e) / n * (x1 - x0))), float(np.float32(y0 + (ty + p[1] / e) / n * (y1 - y0)))]
                    for f in layer["features"]:
                        rows.append((z, tx, ty, layer["name"], f["id"] or 0, f["kind"], [[world(p) for p in part] for part in f["parts"]], [(k, str(v)) for k, v in f["tags"].items()]))
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int8(), pa.list_(pa.list_(pa.list_(pa.float64()))), pa.map_(pa.string(), pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["zoom", "tile_x", "tile_y", "layer", "feature_id", "geom_type", "parts", "tags"])

    return files.mapInArrow(run, f"zoom int, tile_x int, tile_y int, layer string, feature_id long, geom_type tinyint, parts {PARTS}, tags map<string,string>")


def tiles_3d(spark: SparkSession, path: str, zoom: int | None = None) -> DataFrame:
    """Features of a directory {z}/{x}/{y}/{d}.pbf3 in tile units: parts, or positions and indices for meshes."""
    from ..functions.text import parse_tile_path, tile_of

    names = ["zoom", "tile_x", "tile_y", "tile_d"]
    files = _files(spark, (path,), "*.pbf3")
    for c, n in zip(parse_tile_path(tile_of(F.col("path")), 3), names, strict=True):
        files = files.withColumn(n, c)
    files = files.where(F.col("zoom") == zoom) if zoom is not None else files.where("zoom is not null")

    def run(batches):
        for batch in batches:
            rows = []
            for *key, data in zip(*(batch.column(c).to_pylist() for c in [*names, "content"]), strict=True):
                for layer in tile3d.decode(data):
                    for f in layer["features"]:
                        parts = [[[float(v) for v in p] for p in part] for part in f.get("parts", [])]
                        rows.append((*key, layer["name"], f["id"], f["kind"], parts, f["positions"].tobytes() if "positions" in f else None, f["indices"].tobytes() if "indices" in f else None, [(k, str(v)) for k, v in f["tags"].items()]))
            kinds = [pa.int32()] * 4 + [pa.string(), pa.int64(), pa.int8(), pa.list_(pa.list_(pa.list_(pa.float64()))), pa.binary(), pa.binary(), pa.map_(pa.string(), pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[*names, "layer", "feature_id", "geom_type", "parts", "positions", "indices", "tags"])

    return files.mapInArrow(run, f"zoom int, tile_x int, tile_y int, tile_d int, layer string, feature_id long, geom_type tinyint, parts {PARTS}, positions binary, indices binary, tags map<string,string>")


def tileset(spark: SparkSession, path: str) -> DataFrame:
    """(depth, uri, geometric_error, box) of the tiles of a tileset.json, by a walk over its one document."""
    doc = json.loads(spark.read.text(path, wholetext=True).first()[0])
    rows, todo = [], [(0, doc["root"])]
    while todo:
        depth, tile = todo.pop()
        for content in [tile["content"]] if tile.get("content") else tile.get("contents", []):
            rows.append((depth, content["uri"], float(tile.get("geometricError", 0)), [float(v) for v in tile["boundingVolume"]["box"]]))
        todo += [(depth + 1, c) for c in tile.get("children", [])]
    return spark.createDataFrame(rows, "depth int, uri string, geometric_error double, box array<double>")
