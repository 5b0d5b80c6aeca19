"""Exports of whole collections: glTF scenes, GeoJSON, OBJ text, multi-resolution meshes, manifests, sparse arrays."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..codecs import glb, precomputed
from ..functions import geometry, grid
from ..operators.tiles import TILE3
from .tilesets import FILE, geojson_geometry


def scene(features: DataFrame, color_by: str | None = None, color_map: dict[str, tuple] | None = None, y_up: bool = True, row_width: float | None = None, gap: float = 0.0) -> bytes:
    """A binary glTF of a collection small enough for one document: surfaces as triangles, polygons by ear clipping,
    lines and points as such; colours by a tag; and, with ``row_width``, features side by side in rows."""
    nodes, at = [], 0
    rows = features.select("fid", "kind", "parts", "tags").orderBy("fid").collect()
    sizes = [np.ptp(np.array([p[:2] for part in r["parts"] for p in part]), axis=0) for r in rows]
    slot = max((float(s[0]) for s in sizes), default=0.0) + gap
    if row_width is not None and sizes and slot > row_width + gap:
        raise ValueError("a feature is wider than a row")
    per = int((row_width + gap) // slot) if row_width is not None and slot > 0 else 0
    height = max((float(s[1]) for s in sizes), default=0.0) + gap
    for r in rows:
        parts = [np.array([[*p, 0.0][:3] for p in part], float) for part in r["parts"]]
        tags = dict(r["tags"] or {})
        node: dict = {"name": str(r["fid"]), "extras": tags, "colour": (color_map or {}).get(tags.get(color_by)) if color_by else None}
        if per:
            node["translation"] = [at % per * slot, at // per * height, 0.0]
        at += 1
        if r["kind"] == geometry.POINT:
            node |= {"positions": np.concatenate(parts), "mode": glb.POINTS}
        elif r["kind"] == geometry.LINE:
            base = np.cumsum([0] + [len(p) for p in parts])
            node |= {"positions": np.concatenate(parts), "mode": glb.LINES, "indices": np.concatenate([b + np.repeat(np.arange(len(p)), 2)[1:-1] for b, p in zip(base, parts, strict=False)])}
        elif r["kind"] == geometry.POLYGON:
            v, f = geometry.triangulated(parts)
            node |= {"positions": v, "indices": f}
        else:
            v, of = geometry.indexed(np.concatenate([p[[0, i, i + 1]] for p in parts for i in range(1, len(p) - 1)]))
            node |= {"positions": v, "indices": geometry.good_faces(of.reshape(-1, 3))}
        nodes.append(node)
    return glb.encode(nodes, y_up=y_up)


def geojson(features: DataFrame) -> DataFrame:
    """A JSON text a feature, geometry and properties as GeoJSON has them; lines of a feature sequence."""
    shape = F.udf(lambda k, p: json.dumps(geojson_geometry(k, p)), "string", useArrow=True)
    own = features.select("fid", shape("kind", "parts").alias("g"), F.to_json("tags").alias("t"))
    return own.select("fid", F.concat(F.lit('{"type":"Feature","id":'), F.col("fid").cast("string"), F.lit(',"geometry":'), "g", F.lit(',"properties":'), "t", F.lit("}")).alias("value"))


def tile_geojson(layer: dict, zoom: int, x: int, y: int) -> list[dict]:
    """Features of a decoded vector-tile layer in degrees (Web Mercator)."""
    size = layer["extent"] * 2**zoom

    def degrees(p):
        lon = (p[0] + layer["extent"] * x) / size * 360 - 180
        lat = np.degrees(2 * np.arctan(np.exp(np.pi * (1 - 2 * (p[1] + layer["extent"] * y) / size))) - np.pi / 2)
        return [float(lon), float(lat)]

    return [{"type": "Feature", "geometry": geojson_geometry(f["kind"], [[degrees(p) for p in part] for part in f["parts"]]), "properties": f["tags"]} for f in layer["features"]]


def obj_files(meshes: DataFrame) -> DataFrame:
    """(path, content) of OBJ text a mesh."""

    def run(batches):
        for batch in batches:
            texts = []
            for p, i in zip(batch.column("positions").to_pylist(), batch.column("indices").to_pylist(), strict=True):
                v, f = np.frombuffer(p, "<f4").reshape(-1, 3), np.frombuffer(i, "<u4").reshape(-1, 3).astype(int) + 1
                texts.append("".join([*(f"v {a:.9g} {b:.9g} {c:.9g}\n" for a, b, c in v), *(f"f {a} {b} {c}\n" for a, b, c in f)]).encode())
            yield pa.RecordBatch.from_arrays([pa.array([f"{n}.obj" for n in batch.column("name").to_pylist()]), pa.array(texts, pa.binary())], names=["path", "content"])

    return meshes.select("name", "positions", "indices").mapInArrow(run, FILE)


def multilod_meshes(frags: DataFrame, bounds: tuple[float, ...], top: int, bits: int = 10) -> DataFrame:
    """(path, content) of multi-resolution meshes: per feature the fragments' bytes, level after level, and an index
    with positions in Morton order. Vertices are quantised to ``bits`` inside their tile; no further compression."""
    start, span = np.array(bounds[:3], float), np.array(bounds[3:], float) - np.array(bounds[:3], float)

    def run(table: pa.Table) -> pa.Table:
        fid = table.column("feature_id")[0].as_py()
        levels: dict[int, dict[tuple, list]] = {}
        for r in table.sort_by("code").to_pylist():
            levels.setdefault(top - r["zoom"], {}).setdefault((r["tile_x"], r["tile_y"], r["tile_d"]), []).extend(r["parts"])
        data, places, sizes = b"", [], []
        for lod in range(max(levels) + 1):
            own, size = levels.get(lod, {}), []
            for tile, parts in own.items():
                corners = np.concatenate([np.array(p)[[0, i, i + 1]] for p in parts for i in range(1, len(p) - 1)])
                local = np.clip((corners * 2 ** (top - lod) - np.array(tile)) * (2**bits - 1), 0, 2**bits - 1)
                v, of = geometry.indexed(np.floor(local + 0.5))
                raw = precomputed.mesh(v, geometry.good_faces(of.reshape(-1, 3)))
                data, size = data + raw, [*size, len(raw)]
            places.append(np.array(list(own), np.int64).reshape(-1, 3))
            sizes.append(np.array(size, np.int64))
        index = precomputed.multilod_manifest((span / 2**top).tolist(), start.tolist(), [float(2**k) for k in range(len(places))], places, sizes)
        return pa.table({"path": [f"{fid}.index", f"{fid}"], "content": pa.array([index, data], pa.binary())})

    code = grid.morton3(F.col("tile_x"), F.col("tile_y"), F.col("tile_d"), bits=21)
    own = frags.where(F.col("geom_type") >= geometry.SURFACE).select(*TILE3, "feature_id", "parts", code.alias("code"))
    return own.groupBy("feature_id").applyInArrow(run, FILE)


def line_annotations(features: DataFrame) -> tuple[bytes, dict]:
    """One annotation file of all segments of line features; it is one file by its format."""
    segment = F.transform(F.sequence(F.lit(0), F.size("p") - 2), lambda i: F.concat(F.get("p", i), F.get("p", i + 1)))
    rows = features.where("kind = 2").select("fid", F.posexplode("parts").alias("n", "p")).where("size(p) > 1").select("fid", "n", F.posexplode(segment).alias("i", "s")).orderBy("fid", "n", "i").collect()
    s = np.array([r["s"] for r in rows], float).reshape(-1, 6)
    both = s.reshape(-1, 3)
    low, high = (both.min(axis=0).tolist(), both.max(axis=0).tolist()) if len(both) else ([0.0] * 3, [1.0] * 3)
    return precomputed.annotations("LINE", s, np.arange(len(s))), precomputed.annotation_info("LINE", low, high)


def manifest(entries: list[tuple[str, str]]) -> list[dict]:
    """The list of pyramids a viewer offers: (id, path)."""
    return [{"id": i, "path": p} for i, p in entries]


def compressed_columns(long: DataFrame) -> DataFrame:
    """(gene, cells, counts, indptr): the columns of a sparse matrix by gene; a column's start is a prefix sum."""
    from ..operators.sequences import prefix_offsets

    own = F.sort_array(F.collect_list(F.struct("cell_id", "count")))
    columns = long.groupBy("gene").agg(own.alias("c")).select(F.lit(0).alias("_g"), "gene", F.transform("c", lambda x: x["cell_id"]).alias("cells"), F.transform("c", lambda x: x["count"]).alias("counts"), F.size("c").cast("long").alias("n"))
    return prefix_offsets(columns, ["_g"], "gene", "n").select("gene", "cells", "counts", F.col("offset").alias("indptr"))


def golden_colours(n: int, lightness: float = 0.55, saturation: float = 0.65) -> list[str]:
    """``n`` colours whose hues are a golden angle apart."""
    import colorsys

    turn = (3 - 5**0.5) / 2
    return ["#" + "".join(f"{round(255 * c):02x}" for c in colorsys.hls_to_rgb(i * turn % 1, lightness, saturation)) for i in range(n)]


def colour_of(tag: Column, colours: dict[str, str], other: str = "#808080") -> Column:
    pairs = F.create_map(*[F.lit(x) for p in colours.items() for x in p]) if colours else F.create_map().cast("map<string,string>")
    return F.coalesce(F.element_at(pairs, tag), F.lit(other))


def vocabulary(text: str | dict) -> dict:
    """A vocabulary of terms: a URI stays one, JSON or a dict becomes name -> (uri, label)."""

    if isinstance(text, str):
        if not text.lstrip().startswith("{"):
            return {"uri": text, "terms": {}}
        text = json.loads(text)
    return {"uri": text.get("namespace", ""), "terms": {k: (t.get("uri", ""), t.get("label", k)) if isinstance(t, dict) else (t, k) for k, t in text.get("terms", {}).items()}}


