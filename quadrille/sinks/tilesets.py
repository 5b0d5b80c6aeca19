"""Tile files and their metadata: vector tiles, 3D tiles, glTF tiles, Neuroglancer folders, tile documents.

Encoding works in two steps. Each fragment's message is made in a map stage; what meets in a tile is finished bytes
or rows of one tile. A tile that exceeds a limit can be found first with ``operators.tiles.skew_guard``.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..codecs import glb, mvt, precomputed, tile3d
from ..functions import clipping, geometry, grid
from ..functions.text import tile_of, tile_path  # noqa: F401  tile_of: of files named here
from ..operators.sequences import in_groups
from ..operators.tiles import TILE2, TILE3

FILE = "path string, content binary"

#: Features a glTF tile file holds at most: its JSON takes half a kilobyte a node.
GLB_NODES = 1 << 14


def _quantised(parts: list, zoom: int, tile: tuple, extent: int, half_even: bool) -> list[list[tuple]]:
    n = 2**zoom
    out = []
    for p in parts:
        v = extent * (np.array(p) * n - np.array(tile))
        v = np.rint(v) if half_even else np.copysign(np.floor(np.abs(v) + 0.5), v)
        out.append([tuple(int(c) for c in row) for row in v])
    return out


def _typed(tags) -> dict:
    """Tags as numbers and truths where their text is one."""
    out = {}
    for k, v in tags or []:
        try:
            out[k] = int(v) if v.lstrip("-").isdigit() else {"true": True, "false": False}.get(v, None)
            out[k] = float(v) if out[k] is None else out[k]
        except ValueError:
            out[k] = v
    return out


def mvt_messages(frags: DataFrame, extent: int = 4096) -> DataFrame:
    """Fragments with their geometry as packed commands in tile units: a map stage over whole Arrow batches."""

    def run(batches):
        for batch in batches:
            v, off, row = clipping.flat(batch.column("parts"), 2)
            zoom, x, y, kinds = (batch.column(c).to_numpy(zero_copy_only=False) for c in (*TILE2, "geom_type"))
            of = np.repeat(row, np.diff(off))
            scaled = extent * (v * np.exp2(zoom[of])[:, None] - np.column_stack([x[of], y[of]]))
            whole = np.copysign(np.floor(np.abs(scaled) + 0.5), scaled).astype(np.int64)
            out = [b""] * batch.num_rows
            for kind in np.unique(kinds[row]):
                own = np.flatnonzero(kinds[row] == kind)
                for i, g in enumerate(mvt.encode_geometries(int(kind), *clipping.take(whole, off, own), row[own], batch.num_rows)):
                    out[i] = g or out[i]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in (*TILE2, "feature_id", "geom_type")] + [pa.array(out, pa.binary()), batch.column("tags")], names=[*TILE2, "feature_id", "geom_type", "geometry", "tags"])

    own = frags.where(F.col("geom_type") <= geometry.POLYGON).select(*TILE2, "feature_id", "geom_type", "parts", "tags")
    kinds = dict(own.dtypes)
    return own.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in (*TILE2, "feature_id", "geom_type")) + ", geometry binary, tags map<string,string>")


def mvt_tiles(frags: DataFrame, layer: str, extent: int = 4096, most: int = 1 << 17) -> DataFrame:
    """(path, content) of {z}/{x}/{y}.pbf, one a tile that has features. Only finished messages meet in a tile; see
    ``_dealt`` for tiles of more than ``most`` features, whose further files are {y}-1.pbf and so on."""

    def run(table: pa.Table) -> pa.Table:
        (zoom, x, y), piece = (table.column(c)[0].as_py() for c in TILE2), table.column("_piece")[0].as_py()
        table = table.take(pa.array(np.argsort(table.column("feature_id").to_numpy(), kind="stable")))
        rows = (r for part in table.to_batches(max_chunksize=4096) for r in zip(*(part.column(c).to_pylist() for c in ("feature_id", "geom_type", "geometry", "tags")), strict=True))
        path = f"{zoom}/{x}/{y}" + (f"-{piece}" if piece else "") + ".pbf"
        return pa.table({"path": [path], "content": pa.array([mvt.encode_rows(layer, rows, extent, _typed)], pa.binary())})

    many = pieces_of(frags.where(F.col("geom_type") <= geometry.POLYGON), most, TILE2)
    return _dealt(mvt_messages(frags, extent), many, TILE2).groupBy(*TILE2, "_piece").applyInArrow(run, FILE).where("length(content) > 0")


def merged_layers(*layers: DataFrame) -> DataFrame:
    """Tiles of the same path in one: their bytes end to end, in the order of the layers."""
    every = None
    for i, df in enumerate(layers):
        part = df.withColumn("_i", F.lit(i))
        every = part if every is None else every.unionByName(part)
    parts = F.transform(F.sort_array(F.collect_list(F.struct("_i", "content"))), lambda s: s["content"])
    return every.groupBy("path").agg(F.aggregate(parts, F.lit(b""), lambda a, b: F.concat(a, b)).alias("content"))


def pieces_of(tiles: DataFrame, most: int, keys: list[str] = TILE3) -> dict[tuple, int]:
    """Tiles of more than ``most`` fragments and the number of files they take; all others take one."""
    n = F.count(F.lit(1))
    rows = tiles.groupBy(*keys).agg(n.alias("n")).where(F.col("n") > most).collect()  # at most a row a ``most`` fragments
    return {tuple(r[k] for k in keys): -(-r["n"] // most) for r in rows}


def _dealt(frags: DataFrame, many: dict[tuple, int], keys: list[str]) -> DataFrame:
    """Adds _piece: the features of a tile of too many are dealt by a hash over several files, so no task holds such a
    tile: the root has all features, whatever their number."""
    if not many:
        return frags.withColumn("_piece", F.lit(0))
    known = frags.sparkSession.createDataFrame([(*k, n) for k, n in many.items()], frags.select(*keys).schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ") + ", _pieces int")
    piece = F.pmod(F.xxhash64("feature_id"), F.coalesce("_pieces", F.lit(1))).cast("int")
    return frags.join(F.broadcast(known), keys, "left").withColumn("_piece", piece).drop("_pieces")


def _files(frags: DataFrame, most: int, extension: str, encode) -> DataFrame:
    """(path, content) of {z}/{x}/{y}/{d}, a file a tile, by ``encode`` (tile, its rows in the order of ids); a tile of
    more than ``most`` features has further files {d}-1 and so on."""

    def run(table: pa.Table) -> pa.Table:
        key, piece = tuple(table.column(c)[0].as_py() for c in TILE3), table.column("_piece")[0].as_py()
        table = table.take(pa.array(np.argsort(table.column("feature_id").to_numpy(), kind="stable")))
        path = "/".join(map(str, key)) + (f"-{piece}" if piece else "") + extension
        return pa.table({"path": [path], "content": pa.array([encode(key, table)], pa.binary())})

    own = frags.select(*TILE3, "feature_id", "geom_type", "parts", "tags")
    return _dealt(own, pieces_of(own, most), TILE3).groupBy(*TILE3, "_piece").applyInArrow(run, FILE)


def pbf3_tiles(frags: DataFrame, layer: str, extent: int = 4096, most: int = 1 << 14) -> DataFrame:
    """(path, content) of {z}/{x}/{y}/{d}.pbf3; see ``_files`` for tiles of more than ``most`` features."""

    def encode(key: tuple, table: pa.Table) -> bytes:
        return tile3d.encode_layer(layer, _messages(table, [key] * table.num_rows, extent), extent, extent)

    return _files(frags, most, ".pbf3", encode)


def _surfaces(column: pa.ListArray, move) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Positions and indices of rows of faces, all at once; ``move`` takes vertices and their rows."""
    v, off, row = clipping.flat(column, 3)
    corners, part = geometry.fans(off)
    v = move(v, np.repeat(row, np.diff(off)))
    found, v_off, faces, f_off = geometry.meshes(v[corners].reshape(-1, 3), row[part], len(column))
    return np.split(found, v_off[1:-1]), np.split(faces, f_off[1:-1])


def _messages(table: pa.Table, keys: list[tuple], extent: int) -> list[dict]:
    """The features of rows in units of the tile that ``keys`` gives for each."""
    ids, kinds, tags = (table.column(c).to_pylist() for c in ("feature_id", "geom_type", "tags"))
    column = table.column("parts").combine_chunks()
    column = column if isinstance(column, pa.Array) else column.chunk(0)
    faces = np.flatnonzero(np.array(kinds) >= geometry.SURFACE)
    out: list = [None] * len(ids)
    if len(faces):
        at = np.array([keys[i] for i in faces], float).reshape(-1, 4)
        found = _surfaces(column.take(pa.array(faces)), lambda v, row: extent * (v * np.exp2(at[row, :1]) - at[row, 1:]))
        for i, v, f in zip(faces.tolist(), *found, strict=True):
            out[i] = {"id": ids[i], "kind": kinds[i], "positions": v, "indices": f, "tags": _typed(tags[i])}
    for i in np.flatnonzero(np.array(kinds) < geometry.SURFACE).tolist():
        zoom, *tile = keys[i]
        out[i] = {"id": ids[i], "kind": kinds[i], "parts": _quantised(column[i].as_py(), zoom, tuple(tile), extent, True), "tags": _typed(tags[i])}
    return out


def feature_pbf3(frags: DataFrame, top: int, extent: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(files, manifest): a file a feature with a layer a zoom (lod_0 is the finest), and each feature's bounds,
    tags and number of levels."""

    def run(batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        table = pa.Table.from_batches([batch])
        rows, zooms = _messages(table, [(0, 0, 0, 0)] * batch.num_rows, extent), batch.column("zoom").to_pylist()
        paths, files = [], []
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            out = []
            while a < b:  # zooms come from the finest on
                end = a + 1
                while end < b and zooms[end] == zooms[a]:
                    end += 1
                out.append(tile3d.encode_layer(f"lod_{top - zooms[a]}", rows[a:end], extent, extent))
                a = end
            paths.append(f"{rows[b - 1]['id']}.pbf3")
            files.append(b"".join(out))
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(files, pa.binary())], names=["path", "content"])

    own = frags.select(*TILE3, "feature_id", "geom_type", "parts", "tags")
    files = in_groups(own, "feature_id", [F.desc("zoom"), *TILE3[1:]], run, FILE)
    axis = lambda k: F.transform(F.flatten("parts"), lambda p: p[k])
    finest = F.col("zoom") == top
    box = [f(F.when(finest, g(axis(k)))).alias(f"{n}_{a}") for k, a in enumerate("xyz") for f, g, n in ((F.min, F.array_min, "min"), (F.max, F.array_max, "max"))]
    return files, frags.groupBy("feature_id").agg(*box, F.count_distinct("zoom").alias("lods"), F.first("tags").alias("tags"))


def glb_tiles(frags: DataFrame, bounds: tuple[float, ...], most: int = GLB_NODES) -> DataFrame:
    """(path, content) of tiles {z}/{x}/{y}/{d}.glb with a node a feature; see ``_files`` for tiles of more than
    ``most`` features, whose files ``tileset`` lists."""
    start = np.array(bounds[:3], float)
    span = np.array(bounds[3:], float) - start

    def encode(key: tuple, table: pa.Table) -> bytes:
        ids, kinds, tags = (table.column(c).to_pylist() for c in ("feature_id", "geom_type", "tags"))
        column = table.column("parts").combine_chunks()
        column = column if isinstance(column, pa.Array) else column.chunk(0)
        nodes: list = [None] * len(ids)
        faces = np.flatnonzero(np.array(kinds) >= geometry.SURFACE)
        if len(faces):
            for i, v, f in zip(faces.tolist(), *_surfaces(column.take(pa.array(faces)), lambda v, _: v * span + start), strict=True):
                nodes[i] = {"positions": v, "indices": f}
        for i in np.flatnonzero(np.array(kinds) < geometry.SURFACE).tolist():
            own = [np.array(p) * span + start for p in column[i].as_py()]
            if kinds[i] == geometry.LINE:
                base = np.cumsum([0] + [len(p) for p in own])
                nodes[i] = {"positions": np.concatenate(own), "indices": np.concatenate([b + np.repeat(np.arange(len(p)), 2)[1:-1] for b, p in zip(base, own, strict=False)]), "mode": glb.LINES}
            else:
                nodes[i] = {"positions": np.concatenate(own), "indices": None, "mode": glb.POINTS}
        return glb.encode([n | {"name": str(i), "extras": dict(t or [])} for n, i, t in zip(nodes, ids, tags, strict=True)])

    return _files(frags, most, ".glb", encode)


def tileset(tiles: DataFrame, bounds: tuple[float, ...], most: int = GLB_NODES) -> dict:
    """tileset.json of the tiles that exist, a row of ``tiles`` a feature. The driver holds one entry a tile, as the
    document does; a tile of several files (see ``glb_tiles``) lists them all."""
    top = tiles.agg(F.max("zoom")).first()[0] or 0
    diagonal = float(np.linalg.norm(np.array(bounds[3:]) - np.array(bounds[:3])))
    axes = [grid.tile_bounds(F.col("zoom"), F.col(c), float(bounds[k]), float(bounds[k + 3])) for k, c in enumerate(("tile_x", "tile_y", "tile_d"))]
    rows = tiles.select(*TILE3).distinct().select(*TILE3, grid.box_volume(axes).alias("box"), grid.geometric_error(F.col("zoom"), top, diagonal).alias("error")).orderBy(*TILE3).collect()
    many = pieces_of(tiles, most)
    found: dict[tuple, dict] = {}
    centre = [(a + b) / 2 for a, b in zip(bounds[:3], bounds[3:], strict=True)]
    half = [(b - a) / 2 for a, b in zip(bounds[:3], bounds[3:], strict=True)]
    root = {"boundingVolume": {"box": [*centre, half[0], 0, 0, 0, half[1], 0, 0, 0, half[2]]}, "geometricError": diagonal, "refine": "REPLACE"}
    for r in rows:
        key = tuple(r[c] for c in TILE3)
        tile = {"boundingVolume": {"box": list(r["box"])}, "geometricError": r["error"], "refine": "REPLACE", "content": {"uri": "/".join(map(str, key)) + ".glb"}}
        if key in many:
            del tile["content"]
            tile["contents"] = [{"uri": "/".join(map(str, key)) + (f"-{i}" if i else "") + ".glb"} for i in range(many[key])]
        if key[0] == 0:
            root = tile
        else:
            up = (key[0] - 1, *(c >> 1 for c in key[1:]))
            while up not in found and up[0] > 0:
                up = (up[0] - 1, *(c >> 1 for c in up[1:]))
            found.get(up, root).setdefault("children", []).append(tile)
        found[key] = tile
    return {"asset": {"version": "1.1"}, "geometricError": diagonal, "root": root}


def tilejson(name: str, bounds: tuple[float, ...], low: int, top: int, fields: DataFrame, tiles: str = "{z}/{x}/{y}.pbf") -> dict:
    """TileJSON 3.0 with each property's type, range and values (rows of ``tags.property_ranges``)."""
    rows = fields.orderBy("name").collect()
    layer = {"id": name, "minzoom": low, "maxzoom": top, "fields": {r["name"]: r["kind"] for r in rows}}
    layer["fieldranges"] = {r["name"]: [r["low"], r["high"]] for r in rows if r["kind"] == "Number"}
    layer["fieldenums"] = {r["name"]: r["enums"].split(",") for r in rows if r["kind"] == "String" and r["enums"]}
    return {"tilejson": "3.0.0", "name": name, "tiles": [tiles], "bounds": list(bounds), "minzoom": low, "maxzoom": top, "vector_layers": [layer]}


def tilejson_3d(name: str, bounds: tuple[float, ...], low: int, top: int, counts: DataFrame, fields: DataFrame, id_fields: list[str] | None = None, encodings: tuple[str, ...] = ("pbf3",)) -> dict:
    out = tilejson(name, bounds, low, top, fields, "{z}/{x}/{y}/{d}.pbf3")
    centre = [(a + b) / 2 for a, b in zip(bounds[:3], bounds[3:], strict=True)]
    return out | {"bounds3d": list(bounds), "center3d": centre, "depthsize": float(bounds[5] - bounds[2]), "encodings": list(encodings), "id_fields": id_fields or [], "zoom_counts": {str(r["zoom"]): r["tiles"] for r in counts.orderBy("zoom").collect()}}


# --- Neuroglancer -------------------------------------------------------------------------------------------------


def precomputed_meshes(frags: DataFrame, bounds: tuple[float, ...]) -> DataFrame:
    """(path, content) of legacy meshes: a manifest and a fragment a feature, from the finest zoom alone."""
    start, span = np.array(bounds[:3], float), np.array(bounds[3:], float) - np.array(bounds[:3], float)
    top = frags.agg(F.max("zoom")).first()[0]

    def run(batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        v, off, row = clipping.flat(batch.column("parts"), 3)
        corners, part = geometry.fans(off)
        own = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        v, v_off, faces, f_off = geometry.meshes((v * span + start)[corners].reshape(-1, 3), own[row[part]], len(starts) - 1)
        ids = batch.column("feature_id").take(pa.array(starts[:-1])).to_pylist()
        data = [precomputed.mesh(a, b) for a, b in zip(np.split(v, v_off[1:-1]), np.split(faces, f_off[1:-1]), strict=True)]
        # {id} is the manifest's name, {id}:0 the fragment's, as the format has it
        paths = [p for i in ids for p in (str(i), f"{i}:0")]
        content = [c for i, d in zip(ids, data, strict=True) for c in (json.dumps(precomputed.mesh_manifest(i)).encode(), d)]
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(content, pa.binary())], names=["path", "content"])

    own = frags.where((F.col("zoom") == (top or 0)) & (F.col("geom_type") >= geometry.SURFACE))
    return in_groups(own.select(*TILE3, "feature_id", "parts"), "feature_id", TILE3, run, FILE)


def sharded(rows: DataFrame, key: str, minishard_bits: int, shard_bits: int) -> DataFrame:
    """(path, content) of shard files of (key, content) rows."""

    def numbered(batches):
        for batch in batches:
            shards = [precomputed.shard_of(k, minishard_bits, shard_bits)[0] for k in batch.column("key").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("content"), pa.array(shards, pa.int64())], names=["key", "content", "shard"])

    def run(table: pa.Table) -> pa.Table:
        number = table.column("shard")[0].as_py()
        data = precomputed.shard(list(zip(table.column("key").to_pylist(), table.column("content").to_pylist(), strict=True)), minishard_bits)
        return pa.table({"path": [f"{number:0{-(-shard_bits // 4)}x}.shard"], "content": pa.array([data], pa.binary())})

    placed = rows.select(F.col(key).cast("long").alias("key"), "content").mapInArrow(numbered, "key long, content binary, shard long")
    return placed.groupBy("shard").applyInArrow(run, FILE)


def skeletons(nodes: DataFrame) -> DataFrame:
    """(path, content) of a skeleton a neuron; the path is its number in the order of names."""

    def run(batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        columns = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "parent", *"xyzr", "type")}
        data = precomputed.skeletons(starts, columns["id"], columns["parent"], np.column_stack([columns[c] for c in "xyz"]), [columns["r"], columns["type"]])
        return pa.RecordBatch.from_arrays([batch.column("neuron").take(pa.array(starts[:-1])), data], names=["path", "content"])

    return in_groups(nodes, "neuron", ["id"], run, FILE)


def point_annotations(points: DataFrame, ident: Column | None = None) -> tuple[bytes, dict]:
    """One annotation file of (x, y, z) rows and its info; it is one file by its format, so keep it small."""
    rows = points.select((ident if ident is not None else F.monotonically_increasing_id()).alias("i"), "x", "y", "z").orderBy("i").collect()
    p = np.array([[r["x"], r["y"], r["z"]] for r in rows], float).reshape(-1, 3)
    low, high = (p.min(axis=0).tolist(), p.max(axis=0).tolist()) if len(p) else ([0.0] * 3, [1.0] * 3)
    return precomputed.annotations("POINT", p, np.array([r["i"] for r in rows])), precomputed.annotation_info("POINT", low, high)


def segment_properties(features: DataFrame, key: str = "fid") -> dict:
    """Properties of all segments; the document is one by its format."""
    rows = features.select(key, "tags").orderBy(key).collect()
    return precomputed.segment_properties([(r[0], _typed((r["tags"] or {}).items())) for r in rows])


def viewer_state(layers: list[dict], position: list[float] | None = None) -> dict:
    return {"layers": layers, "navigation": {"pose": {"position": {"voxelCoordinates": position or [0, 0, 0]}}}}


def viewer_layer(kind: str, name: str, source: str, **options) -> dict:
    """A layer of a viewer's state: segmentation (skeletons, meshes) or annotation."""
    return {"type": kind, "name": name, "source": source if source.startswith("precomputed://") else f"precomputed://{source}"} | options


# --- GeoParquet ---------------------------------------------------------------------------------------------------


def geoparquet(features: DataFrame, path: str) -> dict:
    """Writes id, WKB geometry and a column a property; returns the file metadata entry "geo" (types, bounds)."""
    names = sorted(r[0] for r in features.select(F.explode(F.map_keys("tags"))).distinct().collect())

    def run(batches):
        for batch in batches:
            blobs, kinds, boxes = [], [], []
            for kind, parts in zip(batch.column("kind").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                g = geojson_geometry(kind, parts)
                blobs.append(geometry.to_wkb(g))
                kinds.append(geometry.wkb_type(blobs[-1]))
                p = np.array([v[:2] for part in parts for v in part])
                boxes.append([*p.min(axis=0).tolist(), *p.max(axis=0).tolist()])
            yield pa.RecordBatch.from_arrays([batch.column("fid"), pa.array(blobs, pa.binary()), pa.array(kinds), pa.array(boxes), batch.column("tags")], names=["id", "geometry", "_kind", "_box", "tags"])

    rows = features.select("fid", "kind", "parts", "tags").mapInArrow(run, "id long, geometry binary, _kind string, _box array<double>, tags map<string,string>")
    rows.select("id", "geometry", *[F.element_at("tags", F.lit(n)).alias(n) for n in names]).write.mode("overwrite").parquet(path)
    box = rows.agg(F.collect_set("_kind").alias("kinds"), *[f(F.col("_box")[i]).alias(f"b{i}") for i, f in enumerate((F.min, F.min, F.max, F.max))]).first()
    return {"version": "1.1.0", "primary_column": "geometry", "columns": {"geometry": {"encoding": "WKB", "geometry_types": sorted(box["kinds"]), "bbox": [box[f"b{i}"] for i in range(4)]}}}


def geojson_geometry(kind: int, parts: list) -> dict:
    """A feature's parts as a GeoJSON-like geometry, rings closed."""
    close = lambda r: [*r, r[0]] if r[0] != r[-1] else r
    if kind == geometry.POINT:
        points = [p for part in parts for p in part]
        return {"type": "Point", "coordinates": points[0]} if len(points) == 1 else {"type": "MultiPoint", "coordinates": points}
    if kind == geometry.LINE:
        return {"type": "LineString", "coordinates": parts[0]} if len(parts) == 1 else {"type": "MultiLineString", "coordinates": parts}
    if kind == geometry.POLYGON:
        return {"type": "Polygon", "coordinates": [close(r) for r in parts]}
    return {"type": "TIN" if kind == geometry.TIN else "PolyhedralSurface", "coordinates": [[close(r)] for r in parts]}


def paths_of(df: DataFrame, extension: str, keys: list[str] = TILE2) -> DataFrame:
    return df.select(tile_path(*[F.col(k) for k in keys], extension=extension).alias("path")).distinct()


# --- rasters ------------------------------------------------------------------------------------------------------


def png(pixels: np.ndarray) -> bytes:
    """An 8-bit grey or RGB image as PNG."""
    import struct
    import zlib

    pixels = np.ascontiguousarray(pixels, np.uint8)
    colour = 2 if pixels.ndim == 3 else 0
    lines = np.concatenate([np.zeros((len(pixels), 1), np.uint8), pixels.reshape(len(pixels), -1)], axis=1).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", pixels.shape[1], pixels.shape[0], 8, colour, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def raster_pyramid(chunks: DataFrame, top: int, size: int = 256) -> DataFrame:
    """(zoom, tile_x, tile_y, content) PNG tiles from rows (tile_x, tile_y, pixels float32 of size x size): contrast
    from the 1st to the 99th percentile of all pixels, each zoom half of the finer one by means of 2 x 2."""
    values = chunks.select(F.explode("pixels").alias("v")).agg(F.percentile("v", F.array(F.lit(0.01), F.lit(0.99))).alias("p")).first()["p"]
    low, high = values if values else (0.0, 1.0)

    def halved(table: pa.Table) -> pa.Table:
        out = np.zeros((2 * size, 2 * size))
        for x, y, p in zip(*(table.column(c).to_pylist() for c in ("tile_x", "tile_y", "pixels")), strict=True):
            a, b = (y & 1) * size, (x & 1) * size
            out[a : a + size, b : b + size] = np.array(p).reshape(size, size)
        small = out.reshape(size, 2, size, 2).mean(axis=(1, 3))
        return pa.table({"zoom": pa.array([table.column("zoom")[0].as_py() - 1], pa.int32()), "tile_x": [table.column("tile_x")[0].as_py() >> 1], "tile_y": [table.column("tile_y")[0].as_py() >> 1], "pixels": pa.array([small.ravel().tolist()], pa.list_(pa.float64()))})

    schema = "zoom int, tile_x long, tile_y long, pixels array<double>"
    level = chunks.select(F.lit(top).alias("zoom"), F.col("tile_x").cast("long").alias("tile_x"), F.col("tile_y").cast("long").alias("tile_y"), F.col("pixels").cast("array<double>").alias("pixels"))
    every = level
    for _ in range(top):
        level = level.groupBy(F.floor(F.col("tile_x") / 2).alias("_x"), F.floor(F.col("tile_y") / 2).alias("_y")).applyInArrow(halved, schema)
        every = every.unionByName(level)

    def image(batches):
        for batch in batches:
            tiles = [png(np.clip((np.array(p).reshape(size, size) - low) / max(high - low, 1e-12) * 255 + 0.5, 0, 255)) for p in batch.column("pixels").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in TILE2), pa.array(tiles, pa.binary())], names=[*TILE2, "content"])

    return every.mapInArrow(image, "zoom int, tile_x long, tile_y long, content binary")
