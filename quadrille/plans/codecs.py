"""Registered queries of the geometry algorithms and binary formats. Some have no SQL form; tests hold them against
fixtures. Clipping is compared by the length and area in every tile, the rest that has SQL by what can be counted."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..codecs import glb, precomputed, tile3d
from ..functions import clipping
from ..functions.text import tile_of
from ..operators import fragments as frag
from ..sinks import tilesets
from ..sources import features as source
from . import queries as q

BOUNDS = (0.0, 0.0, 110000.0, 60.0)


def lines(spark, d) -> DataFrame:
    """Feature rows of orders as polylines of their line items."""
    v = q.vertices(spark, d).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "x", "y"))).alias("v")).where("size(v) >= 2")
    part = F.transform("v", lambda p: F.array(p["x"].cast("double"), p["y"].cast("double")))
    return v.select(F.col("id").alias("fid"), F.lit(2).cast("tinyint").alias("kind"), F.array(part).alias("parts"), F.create_map(F.lit("id"), F.col("id").cast("string")).alias("tags"))


def areas(spark, d) -> DataFrame:
    df = lines(spark, d).where(F.size(F.col("parts")[0]) >= 3)
    return df.withColumn("kind", F.lit(3).cast("tinyint"))


def solids(spark, d) -> DataFrame:
    """A triangle a part in the unit cube."""
    p = q.Tables(spark, d).part
    at = [(F.col("p_partkey") * m % 97) / 100.0 for m in (1, 7, 31)]
    corner = lambda dx, dy: F.array(at[0] + dx, at[1] + dy, at[2])
    ring = F.array(corner(0.0, 0.0), corner(0.02, 0.0), corner(0.0, 0.02))
    return p.select(F.col("p_partkey").alias("fid"), F.lit(5).cast("tinyint").alias("kind"), F.array(ring).alias("parts"), F.create_map(F.lit("brand"), F.col("p_brand")).alias("tags"))


#: No vertex lies on an edge of a tile here, as vertices are whole numbers.
OFF_GRID = (0.0, 0.0, 110001.0, 61.0)

_EDGES = f"""WITH {q._VERTICES}, u AS (SELECT id, pos, n, x / 110001.0 AS ax, y / 61.0 AS ay FROM v),
g AS (SELECT CAST(z.range AS INT) AS zoom, gx.range AS tile_x, gy.range AS tile_y, pow(2, z.range) AS m FROM range(0, 3) z, range(0, 4) gx, range(0, 4) gy WHERE gx.range < pow(2, z.range) AND gy.range < pow(2, z.range)),
b AS (SELECT *, tile_x / m AS x0, (tile_x + 1) / m AS x1, tile_y / m AS y0, (tile_y + 1) / m AS y1 FROM g),"""


def _measured(features: DataFrame, size, unit: int) -> DataFrame:
    """Fragments of three zooms with their parts' sizes in whole units; those of less than half a unit go."""
    found = frag.fragments(features, OFF_GRID, 2, simplify=False, measure=size).drop("geom_type")
    return found.withColumn("size", F.floor(F.abs("size") * unit + 0.5).cast("long")).where("size > 0")


@q.query(f"""{_EDGES} e AS (SELECT id, ax, ay, lead(ax) OVER w - ax AS dx, lead(ay) OVER w - ay AS dy FROM u WINDOW w AS (PARTITION BY id ORDER BY pos)),
c AS (SELECT id, zoom, tile_x, tile_y, sqrt(dx * dx + dy * dy) AS long,
greatest(0, CASE WHEN dx <> 0 THEN least((x0 - ax) / dx, (x1 - ax) / dx) ELSE 0 END, CASE WHEN dy <> 0 THEN least((y0 - ay) / dy, (y1 - ay) / dy) ELSE 0 END) AS t0,
least(1, CASE WHEN dx <> 0 THEN greatest((x0 - ax) / dx, (x1 - ax) / dx) ELSE 1 END, CASE WHEN dy <> 0 THEN greatest((y0 - ay) / dy, (y1 - ay) / dy) ELSE 1 END) AS t1
FROM e, b WHERE dx IS NOT NULL AND (dx <> 0 OR (ax >= x0 AND ax < x1)) AND (dy <> 0 OR (ay >= y0 AND ay < y1)))
SELECT * FROM (SELECT id AS feature_id, zoom, tile_x, tile_y, CAST(floor(sum((t1 - t0) * long) * 1000000 + 0.5) AS BIGINT) AS size FROM c WHERE t1 > t0 GROUP BY ALL) WHERE size > 0""")
def clip_polyline(spark, d):
    """The length of every polyline in every tile of three zooms, in millionths of the world's width; the SQL clips
    each segment by itself."""
    return _measured(lines(spark, d), clipping.lengths, 1_000_000)


@q.query(f"""{_EDGES} e AS (SELECT id, ax, ay, coalesce(lead(ax) OVER w, first_value(ax) OVER w) AS ex, coalesce(lead(ay) OVER w, first_value(ay) OVER w) AS ey FROM u WHERE n >= 3 WINDOW w AS (PARTITION BY id ORDER BY pos)),
c AS (SELECT *, ax + (ex - ax) * (ca - ay) / (ey - ay) AS sx, ax + (ex - ax) * (cb - ay) / (ey - ay) AS tx
FROM (SELECT *, greatest(y0, least(y1, ay)) AS ca, greatest(y0, least(y1, ey)) AS cb FROM e, b WHERE ay <> ey) WHERE ca <> cb),
k AS (SELECT id, zoom, tile_x, tile_y, cb - ca AS dy, CASE WHEN abs(tx - sx) < 1e-12 THEN greatest(x0, least(x1, sx)) - x0 ELSE
((CASE WHEN tx <= x0 THEN 0 WHEN tx < x1 THEN (tx - x0) * (tx - x0) / 2 ELSE (x1 - x0) * (x1 - x0) / 2 + (x1 - x0) * (tx - x1) END)
- (CASE WHEN sx <= x0 THEN 0 WHEN sx < x1 THEN (sx - x0) * (sx - x0) / 2 ELSE (x1 - x0) * (x1 - x0) / 2 + (x1 - x0) * (sx - x1) END)) / (tx - sx) END AS wide FROM c)
SELECT * FROM (SELECT id AS feature_id, zoom, tile_x, tile_y, CAST(floor(abs(sum(wide * dy)) * 1000000 + 0.5) AS BIGINT) AS size FROM k GROUP BY ALL) WHERE size > 0""")
def clip_polygon(spark, d):
    """The area, by winding, of every polygon in every tile of three zooms, in millionths of the world's; the SQL
    integrates along the edges and clips nothing."""
    return _measured(areas(spark, d), clipping.areas, 1_000_000)


@q.query()
def dp_simplify(spark, d):
    found = frag.fragments(lines(spark, d), BOUNDS, 3, extent=16)
    return found.groupBy("zoom").agg(F.count(F.lit(1)).alias("n"), F.sum(F.aggregate("parts", F.lit(0), lambda a, p: a + F.size(p))).alias("vertices"))


@q.query("""WITH c AS (SELECT p_partkey AS fid, (p_partkey * 1 % 97) / 100.0 AS x, (p_partkey * 7 % 97) / 100.0 AS y FROM part), z AS (SELECT range AS zoom, CAST(pow(2, range) AS BIGINT) AS n FROM range(0, 3))
SELECT CAST(zoom AS INT) AS zoom, sum((least(n - 1, floor((x + 0.02) * n)) - floor(x * n) + 1) * (least(n - 1, floor((y + 0.02) * n)) - floor(y * n) + 1))::BIGINT AS faces FROM c, z GROUP BY zoom""")
def octree_faces(spark, d):
    """Whole faces in every octree tile they overlap, by arithmetic alone."""
    df = solids(spark, d).select("fid", F.col("parts")[0].alias("vertices"), F.array(F.lit(0), F.lit(1), F.lit(2)).alias("faces"))
    return frag.face_tiles(df, (0.0, 0.0, 0.0, 1.0, 1.0, 1.0), 2).groupBy("zoom").agg(F.count(F.lit(1)).alias("faces"))


@q.query()
def tile_table(spark, d):
    found = frag.encoded(frag.fragments(lines(spark, d), BOUNDS, 2), BOUNDS)
    return found.groupBy("zoom").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("positions")).alias("bytes"), F.sum(F.octet_length("indices")).alias("index_bytes"))


@q.query()
def mvt_roundtrip(spark, d):
    """Vector tiles made and counted."""
    files = tilesets.mvt_tiles(frag.fragments(areas(spark, d), BOUNDS, 2), "areas")
    return files.select("path", F.octet_length("content").alias("bytes"))


def _face_texts(corners: list[np.ndarray]) -> list[str]:
    """The faces of each feature (whole numbers, 3 x 3 a face) as text, corners and faces in order."""
    every = np.concatenate([np.zeros((0, 3, 3)), *corners]).astype(np.int64)
    order = np.lexsort((every[:, :, 2], every[:, :, 1], every[:, :, 0]), axis=-1)
    rows = np.take_along_axis(every, order[:, :, None], axis=1).reshape(-1, 9).tolist()
    texts, at, out = ["%d %d %d,%d %d %d,%d %d %d" % tuple(r) for r in rows], 0, []
    for c in corners:
        out.append("|".join(sorted(texts[at : at + len(c)])))
        at += len(c)
    return out


def _features3(files: DataFrame) -> DataFrame:
    """path, fid, brand and faces, in hundredths of the world, of the features in 3D vector tiles."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                zoom, *tile = (int(n) for n in path.removesuffix(".pbf3").split("/"))
                found = [f for layer in tile3d.decode(content.as_py()) for f in layer["features"]]
                sizes = [len(f["positions"]) for f in found]
                world = (np.concatenate([np.zeros((0, 3)), *(f["positions"] for f in found)]) / 4096 + tile) / 2**zoom
                own = np.split(np.rint(world * 100), np.cumsum(sizes)[:-1])
                faces = _face_texts([v[f["indices"]].reshape(-1, 3, 3) for v, f in zip(own, found, strict=False)])
                columns = [pa.array([path] * len(found), pa.string()), pa.array([f["id"] for f in found], pa.int64()), pa.array([f["tags"]["brand"] for f in found], pa.string()), pa.array(faces, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "fid", "brand", "faces"])

    return files.select(tile_of(F.col("path")).alias("path"), "content").mapInArrow(run, "path string, fid long, brand string, faces string")


_FACES = """WITH c AS (SELECT p_partkey AS fid, p_brand AS brand, p_partkey % 97 AS a, p_partkey * 7 % 97 AS b, p_partkey * 31 % 97 AS c FROM part),
t AS (SELECT 0 AS zoom, 0 AS x, 0 AS y, 0 AS d UNION ALL SELECT 1, x.range, y.range, d.range FROM range(0, 2) x, range(0, 2) y, range(0, 2) d)
SELECT concat_ws('/', zoom, x, y, d) || '{end}' AS path, {ident}, brand, concat_ws(' ', a, b, c) || ',' || concat_ws(' ', a, b + 2, c) || ',' || concat_ws(' ', a + 2, b, c) AS faces
FROM c, t WHERE zoom = 0 OR (x BETWEEN a // 50 AND (a + 2) // 50 AND y BETWEEN b // 50 AND (b + 2) // 50 AND d = c // 50)"""


@q.query(_FACES.format(end=".pbf3", ident="fid"))
def pbf3_roundtrip(spark, d):
    """3D vector tiles made and read back: every face that meets a tile, whole."""
    return _features3(tilesets.pbf3_tiles(frag.fragments(solids(spark, d), (0.0, 0.0, 0.0, 1.0, 1.0, 1.0), 1), "solids"))


def _features_glb(files: DataFrame) -> DataFrame:
    """path, name, brand and faces, in hundredths, of the nodes in binary glTF tiles."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                content = content.as_py()
                doc, (positions, corners) = glb.document(content), glb.decode(content)
                nodes = doc.get("nodes", [])
                sizes = [doc["accessors"][doc["meshes"][n["mesh"]]["primitives"][0]["indices"]]["count"] for n in nodes]
                whole = np.rint(positions.astype(float) * 100)[corners].reshape(-1, 3, 3)
                faces = _face_texts(np.split(whole, np.cumsum(sizes)[:-1] // 3) if nodes else [])
                columns = [[path] * len(nodes), [n["name"] for n in nodes], [n["extras"]["brand"] for n in nodes], faces]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["path", "name", "brand", "faces"])

    return files.select(tile_of(F.col("path")).alias("path"), "content").mapInArrow(run, "path string, name string, brand string, faces string")


@q.query(_FACES.format(end=".glb", ident="CAST(fid AS VARCHAR) AS name"))
def glb_roundtrip(spark, d):
    """Binary glTF tiles made and read back: a node a feature, every face that meets the tile, whole."""
    box = (0.0, 0.0, 0.0, 1.0, 1.0, 1.0)
    return _features_glb(tilesets.glb_tiles(frag.fragments(solids(spark, d), box, 1), box))


def _decoded(files: DataFrame, read) -> DataFrame:
    """path and what ``read`` (path, bytes to text) finds in each file."""

    def run(batches):
        for batch in batches:
            rows = zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array([read(p, c) for p, c in rows], pa.string())], names=["path", "found"])

    return files.select("path", "content").mapInArrow(run, "path string, found string")


def _numbers(rows) -> str:
    return ",".join(" ".join(str(int(v)) for v in r) for r in rows)


def _mesh_text(path: str, content: bytes) -> str:
    """Corners of every face in hundredths, in order; a manifest as it is."""
    if ":" not in path:
        return content.decode()
    vertices, faces = precomputed.read_mesh(content)
    return _face_texts([np.rint(vertices.astype(float) * 100)[faces]])[0]


@q.query("""WITH c AS (SELECT p_partkey AS k, p_partkey % 97 AS a, p_partkey * 7 % 97 AS b, p_partkey * 31 % 97 AS c FROM part)
SELECT CAST(k AS VARCHAR) AS path, '{"fragments": ["' || k || ':0"]}' AS found FROM c UNION ALL
SELECT k || ':0', concat_ws(' ', a, b, c) || ',' || concat_ws(' ', a, b + 2, c) || ',' || concat_ws(' ', a + 2, b, c) FROM c""")
def precomputed_meshes(spark, d):
    """Manifests and meshes, read back: whole faces, each once however many tiles it is in."""
    box = (0.0, 0.0, 0.0, 1.0, 1.0, 1.0)
    return _decoded(tilesets.precomputed_meshes(frag.fragments(solids(spark, d), box, 1), box), _mesh_text)


@q.query()
def feature_centric_pbf3(spark, d):
    files, _ = tilesets.feature_pbf3(frag.fragments(solids(spark, d), (0.0, 0.0, 0.0, 1.0, 1.0, 1.0), 1), 1)
    return files.select("path", F.octet_length("content").alias("bytes"))


def trees(spark, d) -> DataFrame:
    """Orders as neuron trees: item k hangs on item k // 2."""
    v = q.vertices(spark, d)
    return v.select(F.col("id").cast("string").alias("neuron"), F.col("pos").alias("id"), (F.col("pos") % 3).cast("int").alias("type"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("pos").cast("double").alias("z"), F.lit(1.0).alias("r"), F.when(F.col("pos") == 1, -1).otherwise(F.floor(F.col("pos") / 2)).cast("int").alias("parent"))


def _skeleton_text(path: str, content: bytes) -> str:
    """Positions, edges, radii and types."""
    vertices, edges, found = precomputed.read_skeleton(content, ["radius", "type"])
    return "|".join([_numbers(vertices), _numbers(sorted(edges.tolist(), key=lambda e: e[1])), _numbers(zip(found["radius"], found["type"], strict=True))])


@q.query(f"""WITH {q._VERTICES} SELECT CAST(id AS VARCHAR) AS path, string_agg(concat_ws(' ', x, y, pos), ',' ORDER BY pos) || '|' ||
coalesce(string_agg(concat_ws(' ', pos // 2 - 1, pos - 1), ',' ORDER BY pos) FILTER (pos > 1), '') || '|' || string_agg('1 ' || pos % 3, ',' ORDER BY pos) AS found FROM v GROUP BY id""")
def skeleton_encode(spark, d):
    """Skeletons of all trees, read back."""
    return _decoded(tilesets.skeletons(trees(spark, d)), _skeleton_text)


@q.query("SELECT CAST(l_orderkey AS VARCHAR) AS neuron, CAST(count(*) AS BIGINT) AS nodes FROM lineitem GROUP BY l_orderkey")
def morphology_size(spark, d):
    return frag.morphology(trees(spark, d)).select("neuron", "nodes")


@q.query()
def tree_paths(spark, d):
    return frag.tree_paths(trees(spark, d)).select("neuron", "path", "type", F.size("points").alias("vertices"))


@q.query()
def tube_meshes(spark, d):
    found = frag.tubes(frag.tree_paths(trees(spark, d)))
    return found.groupBy("name").agg(F.count(F.lit(1)).alias("tubes"), F.sum(F.octet_length("positions") / 12).alias("vertices"))


@q.query()
def mesh_levels(spark, d):
    """Quadric levels of detail of icospheres, a mesh a supplier."""
    from ..functions.geometry import icosphere

    v, f = icosphere(np.zeros(3), 1.0, 2)
    s = q.Tables(spark, d).supplier
    meshes = s.select(F.col("s_name").alias("name"), F.lit(v.astype("<f4").tobytes()).alias("positions"), F.lit(f.astype("<u4").tobytes()).alias("indices"), F.create_map(F.lit("n"), F.col("s_name")).alias("tags"))
    out = frag.simplified_meshes(meshes, 2, base=1)
    return out.select("name", "zoom", (F.octet_length("indices") / 12).cast("long").alias("faces"))


@q.query()
def random_polygons(spark, d):
    from ..sources.tables import random_polygons

    return random_polygons(spark, 20, 500.0).select("fid", F.size(F.col("parts")[0]).alias("vertices"))


@q.query()
def geojson_scan(spark, d):
    """Orders written as GeoJSON text and read by the geometry parser."""
    g = F.to_json(F.struct(F.lit("LineString").alias("type"), F.col("parts")[0].alias("coordinates")))
    rows = lines(spark, d).select("fid", g.alias("geometry"))
    return source._parsed(rows, ["fid"]).select("fid", "kind", F.size(F.col("parts")[0]).alias("vertices"))


@q.query()
def sharded_container(spark, d):
    rows = q.Tables(spark, d).customer.select(F.col("c_custkey").alias("key"), F.col("c_name").cast("binary").alias("content"))
    return tilesets.sharded(rows, "key", 2, 3).select("path", F.octet_length("content").alias("bytes"))


@q.query()
def overview_png(spark, d):
    """A raster pyramid of the point density of line items."""
    p = q.points(spark, d).select(F.floor(F.col("nx") * 31.999).cast("int").alias("x"), F.floor(F.col("ny") * 31.999).cast("int").alias("y"))
    n = p.groupBy("x", "y").agg(F.count(F.lit(1)).cast("double").alias("v"))
    full = spark.range(32 * 32).select((F.col("id") % 32).cast("int").alias("x"), F.floor(F.col("id") / 32).cast("int").alias("y")).join(n, ["x", "y"], "left").na.fill(0.0)
    own = full.groupBy(F.floor(F.col("x") / 8).alias("tile_x"), F.floor(F.col("y") / 8).alias("tile_y")).agg(F.sort_array(F.collect_list(F.struct("y", "x", "v"))).alias("p"))
    out = tilesets.raster_pyramid(own.select("tile_x", "tile_y", F.transform("p", lambda s: s["v"].cast("float")).alias("pixels")), 2, 8)
    return out.select("zoom", "tile_x", "tile_y", F.octet_length("content").alias("bytes"))


