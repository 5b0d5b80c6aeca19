"""Features to fragments: clipping over the tiles of every zoom, detail by zoom, bytes of positions and indices.

Points and boxes are exploded in Catalyst (see ``pyramid``). Here are the kinds that need real clipping; each feature
is worked through on its own in an Arrow batch, so the explode is a map stage and a hot tile gathers nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clipping, geometry
from ..sources.features import PARTS
from .sequences import in_groups

KEYS = ["tile_x", "tile_y", "tile_d"]


def fragments(features: DataFrame, bounds: tuple[float, ...], top: int, low: int = 0, buffer: float = 0.0, simplify: bool = True, polygon_tolerances: dict[int, float] | None = None, extent: int = 4096, gate: dict[str, int] | None = None, measure: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(feature_id, geom_type, zoom, tile keys, parts in [0, 1], tags) of feature rows.

    ``measure`` (vertices and offsets of parts to a number a part) gives its sum over a fragment's parts as size in
    place of parts and tags, so that no geometry leaves the stage that cuts it.

    ``bounds``: world minimum and maximum of 2 or 3 axes, (x0, y0[, z0], x1, y1[, z1]). Lines are simplified by a tile
    unit below the finest zoom; polygons only where ``polygon_tolerances`` names a zoom.
    """
    axes = len(bounds) // 2
    start = np.array(bounds[:axes], float)
    span = np.array(bounds[axes:], float) - start
    span[span == 0] = 1
    keys = KEYS[:axes]

    def detailed(kind: int, v: np.ndarray, off: np.ndarray, zoom: int) -> tuple[np.ndarray, np.ndarray]:
        lines = kind == geometry.LINE
        rings = kind == geometry.POLYGON and axes == 2 and bool(polygon_tolerances) and zoom in polygon_tolerances
        least = 2 if lines else 4
        if not simplify or zoom >= top or not (lines or rings) or not (np.diff(off) > least).any():
            return v, off
        step = 2.0**-zoom / extent if lines else polygon_tolerances[zoom]
        segment, size = lines and axes == 3, np.diff(off)
        keep = np.ones(len(v), bool)
        if least == 2:  # of three vertices, the middle one's distance decides; all such parts at once
            i = off[:-1][size == 3]
            a, p, b = v[i], v[i + 1], v[i + 2]
            d, e = b - a, p - a
            n = (d * d).sum(axis=1)
            t = (e * d).sum(axis=1) / np.where(n == 0, 1, n)
            t = np.where(n == 0, 0, np.clip(t, 0, 1) if segment else t)
            keep[i + 1] = ((e - t[:, None] * d) ** 2).sum(axis=1) > step * step
        longer = size > max(least, 3 if least == 2 else least)
        if longer.any():
            keep[np.repeat(longer, size)] = geometry.kept_of(*clipping.take(v, off, np.flatnonzero(longer)), step, least, segment)
        return v[keep], np.concatenate([[0], np.cumsum(np.add.reduceat(keep, off[:-1], dtype=np.int64))])

    def run(batches):
        for batch in batches:
            v, off, row = clipping.flat(batch.column("parts"), axes)
            v, kinds = (v - start) / span, batch.column("kind").to_numpy(zero_copy_only=False)
            for kind in np.unique(kinds[row]):
                own = np.flatnonzero(kinds[row] == kind)
                # faces of one kind of surface are clipped alike, so kinds are worked through one by one
                for zoom, w, o, feature, tile in clipping.descend(int(kind), *clipping.take(v, off, own), row[own], top, low, buffer):
                    if not len(feature):
                        continue
                    w, o = detailed(int(kind), w, o, zoom)
                    order = np.lexsort((np.arange(len(feature)), *tile.T[::-1], feature))
                    w, o = clipping.take(w, o, order)
                    feature, tile = feature[order], tile[order]
                    new = np.append(True, (feature[1:] != feature[:-1]) | (tile[1:] != tile[:-1]).any(axis=1))
                    at = np.flatnonzero(new)
                    if measure:
                        own_keys = [batch.column(c).take(pa.array(feature[at])) for c in ("fid", "kind")]
                        arrays = [*own_keys, pa.array(np.full(len(at), zoom, np.int32)), *[pa.array(tile[at, k]) for k in range(axes)], pa.array(np.add.reduceat(measure(w, o).astype(float), at))]
                        yield pa.RecordBatch.from_arrays(arrays, names=["feature_id", "geom_type", "zoom", *keys, "size"])
                        continue
                    table = batch.take(pa.array(feature[at]))
                    arrays = [table.column("fid"), table.column("kind"), pa.array(np.full(len(at), zoom, np.int32)), *[pa.array(tile[at, k]) for k in range(axes)], clipping.nested(w, o, np.append(at, len(feature))), table.column("tags")]
                    yield pa.RecordBatch.from_arrays(arrays, names=["feature_id", "geom_type", "zoom", *keys, "parts", "tags"])

    schema = "feature_id long, geom_type tinyint, zoom int, " + "".join(f"{k} long, " for k in keys) + ("size double" if measure else f"parts {PARTS}, tags map<string,string>")
    out = features.select("fid", "kind", "parts", "tags").mapInArrow(run, schema)
    if gate:
        from .tags import zoom_gate

        out = out.withColumn("tags", zoom_gate(F.col("tags"), F.col("zoom"), gate))
    return out


def face_tiles(meshes: DataFrame, bounds: tuple[float, ...], top: int, low: int = 0) -> DataFrame:
    """(feature_id, face, zoom, tile_x, tile_y, tile_d, corners) of meshes: whole faces in every tile they overlap.

    Faces are exploded and their tile ranges are arithmetic, so this is Catalyst alone.
    """
    from .pyramid import box_tiles

    corners = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda f: F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda k: F.get(F.col("vertices"), F.get(F.col("faces"), (3 * f + k).cast("int")))))
    own = meshes.withColumn("n", F.floor(F.size("faces") / 3).cast("int")).where("n > 0").select("fid", F.posexplode(corners).alias("face", "corners"))
    axes = []

    def along(k: int):
        return F.transform("corners", lambda c: (c[k] - F.lit(float(bounds[k]))) / F.lit(float(bounds[k + 3] - bounds[k] or 1)))

    for k, a in enumerate("xyz"):
        n = along(k)
        own = own.withColumn(f"min_{a}", F.array_min(n)).withColumn(f"max_{a}", F.array_max(n))
        axes.append((f"min_{a}", f"max_{a}", KEYS[k]))
    return box_tiles(own, top, low, axes=tuple(axes)).select(F.col("fid").alias("feature_id"), "face", "zoom", *KEYS, "corners")


def _places(first: np.ndarray, size: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The places of all items of some rows, whose items start at ``first``."""
    first, size = first[which], size[which]
    return np.arange(int(size.sum())) + np.repeat(first - np.cumsum(size) + size, size)


def _blobs(data: np.ndarray, sizes: np.ndarray) -> pa.BinaryArray:
    """``data`` cut into bytes of the given sizes."""
    off = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data))])


def encoded(frags: DataFrame, bounds: tuple[float, ...]) -> DataFrame:
    """The tile table: feature ids, codes, positions (float32 world), indices (uint32), ring lengths, tags.

    Lines have segment pairs as indices, surfaces and TINs triangles of distinct vertices, others none.
    """
    axes = len(bounds) // 2
    start = np.array(bounds[:axes], float)
    span = np.array(bounds[axes:], float) - start
    span[span == 0] = 1
    keys = ["zoom", *KEYS[:axes]]

    def run(batches):
        for batch in batches:
            v, off, row = clipping.flat(batch.column("parts"), axes)
            v, kinds, n = v * span + start, batch.column("geom_type").to_numpy(zero_copy_only=False), batch.num_rows
            size, kind = np.diff(off), kinds[row]
            of = np.repeat(row, size)
            vertices = np.bincount(of, minlength=n)
            first = np.concatenate([[0], np.cumsum(vertices)])
            positions = v.astype("<f4")
            # a segment starts at every vertex of a line but the last one of a part
            begins = np.delete(np.arange(len(v)), off[1:] - 1)
            begins = begins[kinds[of[begins]] == geometry.LINE]
            indices = np.column_stack([begins, begins + 1]) - first[of[begins]][:, None]
            words = 2 * np.bincount(of[begins], minlength=n)
            flat_indices = indices.astype("<u4").ravel()
            faces = np.flatnonzero(kind >= geometry.SURFACE)
            if len(faces):
                w, o = clipping.take(v, off, faces)
                corners, part = geometry.fans(o)
                found, v_off, face, f_off = geometry.meshes(w[corners].reshape(-1, 3), row[faces][part], n)
                # rows are of one kind each, so those of faces take the place of their plain vertices
                solid = kinds >= geometry.SURFACE
                mixed = np.where(solid, np.diff(v_off), vertices)
                ends = np.cumsum(mixed)
                out = np.empty((int(ends[-1]), axes), "<f4")
                out[_places(ends - mixed, mixed, solid)], out[_places(ends - mixed, mixed, ~solid)] = found, positions[~solid[of]]
                more = np.where(solid, 3 * np.diff(f_off), words)
                last = np.cumsum(more)
                whole = np.empty(int(last[-1]), "<u4")
                whole[_places(last - more, more, solid)], whole[_places(last - more, more, ~solid)] = face.ravel(), flat_indices
                positions, vertices, flat_indices, words = out, mixed, whole, more
            rings = np.flatnonzero(kind == geometry.POLYGON)
            lengths = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[rings], minlength=n))]).astype(np.int32)), pa.array(size[rings].astype(np.int32)))
            arrays = [_blobs(positions, 4 * axes * vertices), _blobs(flat_indices, 4 * words), lengths]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in [*keys, "feature_id", "geom_type"]] + arrays + [batch.column("tags")], names=[*keys, "feature_id", "geom_type", "positions", "indices", "ring_lengths", "tags"])

    schema = "zoom int, " + "".join(f"{k} long, " for k in keys[1:]) + "feature_id long, geom_type tinyint, positions binary, indices binary, ring_lengths array<int>, tags map<string,string>"
    return frags.select(*keys, "feature_id", "geom_type", "parts", "tags").mapInArrow(run, schema)


def simplified_meshes(meshes: DataFrame, top: int, base: int = 8, quadric: bool = True) -> DataFrame:
    """(name, zoom, positions, indices, tags): a level per zoom, each collapsed from the finer one."""

    def levels(p: bytes, i: bytes) -> list[tuple[int, bytes, bytes]]:
        out = []
        v, f = np.frombuffer(p, "<f4").reshape(-1, 3).astype(float), np.frombuffer(i, "<u4").reshape(-1, 3).astype(np.int64)
        for zoom in range(top, -1, -1):
            if zoom < top and len(f) > 4:
                budget = max(1, min(6 * (base * 2**zoom) ** 2, len(f) // 3))
                cell = max(float(np.ptp(v, axis=0).max()) / (base * 2**zoom), 1e-12)
                v, f = geometry.collapsed(v, f, budget) if quadric else geometry.decimated_mesh(v, f, cell)
            out.append((zoom, v.astype("<f4").tobytes(), f.astype("<u4").tobytes()))
        return out

    def run(batches):
        known = lru_cache(64)(levels)  # equal meshes, as of many instances of one shape, are collapsed once
        for batch in batches:
            rows = []
            for name, p, i, tags in zip(*(batch.column(c).to_pylist() for c in ("name", "positions", "indices", "tags")), strict=True):
                rows += [(name, *level, tags) for level in known(p, i)]
            kinds = [pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.map_(pa.string(), pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["name", "zoom", "positions", "indices", "tags"])

    # few rows of much work each, often of one file: spread over all cores
    spread = max(meshes.sparkSession.sparkContext.defaultParallelism, int(meshes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return meshes.repartition(spread, "name").mapInArrow(run, "name string, zoom int, positions binary, indices binary, tags map<string,string>")


def point_clouds(frags: DataFrame, key: str, label: str) -> DataFrame:
    """Per neuron all vertices of its fragments and its first label by tile."""
    own = frags.select(key, label, F.struct("zoom", "tile_x", "tile_y").alias("_at"), F.flatten("parts").alias("_p"))
    return own.groupBy(key).agg(F.flatten(F.collect_list("_p")).alias("points"), F.min_by(label, "_at").alias(label))


def tree_paths(nodes: DataFrame) -> DataFrame:
    """(neuron, path, type, points) of SWC nodes: unbranched chains, cut where the compartment changes."""

    def run(batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        ids, parents, kinds = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "parent", "type"))
        xyz = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in "xyzr"])
        tree, path, found, points, size = [], [], [], [], []
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            own, n = kinds[a:b].tolist(), len(path)
            for chain in geometry.branches(ids[a:b], parents[a:b]):
                for kind, part in geometry.split_by_kind(chain, own) or [(own[chain[0]], chain)]:
                    tree.append(a)
                    path.append(len(path) - n)
                    found.append(kind)
                    points += [a + i for i in part]
                    size.append(len(part))
        flat = pa.array(xyz[np.array(points, np.int64)].ravel())
        vertices = pa.ListArray.from_arrays(pa.array(np.arange(len(points) + 1, dtype=np.int32) * 4), flat)
        lines = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), vertices)
        return pa.RecordBatch.from_arrays([batch.column("neuron").take(pa.array(tree, pa.int64())), pa.array(path, pa.int32()), pa.array(found, pa.int32()), lines], names=["neuron", "path", "type", "points"])

    return in_groups(nodes, "neuron", ["id"], run, "neuron string, path int, type int, points array<array<double>>")


def tubes(paths: DataFrame, sides: int = 8, smooth: int = 1, most: int | None = None) -> DataFrame:
    """Tube meshes of paths (x, y, z, r): name, positions, indices, tags."""

    def run(batches):
        for batch in batches:
            column = batch.column("points")
            off = column.offsets.to_numpy().astype(np.int64)
            start = column.values.offsets.to_numpy()[off[0] : off[-1]] if off[-1] > off[0] else np.zeros(0, np.int64)
            values = column.values.values.to_numpy(zero_copy_only=False)
            p, off = np.column_stack([values[start + k] for k in range(4)]).astype(float), off - off[0]
            if most:
                at = [geometry.thinned(p[a:b], most) + a for a, b in zip(off[:-1], off[1:], strict=True)]
                p, off = p[np.concatenate([np.zeros(0, np.int64), *at])], np.concatenate([[0], np.cumsum([len(i) for i in at])]).astype(np.int64)
            if smooth > 1:
                curves = [np.column_stack(geometry.smoothed_with_radii(p[a:b, :3], p[a:b, 3], smooth)) for a, b in zip(off[:-1], off[1:], strict=True)]
                p, off = np.concatenate([np.zeros((0, 4)), *curves]), np.concatenate([[0], np.cumsum([len(c) for c in curves])]).astype(np.int64)
            neurons, kinds = batch.column("neuron").to_pylist(), batch.column("type").to_pylist()
            positions, indices = [b""] * len(neurons), [b""] * len(neurons)
            long = np.flatnonzero(np.diff(off) > 1)
            for i, a, b in zip(long.tolist(), *geometry.tubes(*clipping.take(p, off, long), sides), strict=True):
                positions[i], indices[i] = a, b
            for i in np.flatnonzero(np.diff(off) == 1).tolist():
                v, f = geometry.icosphere(p[off[i], :3], max(float(p[off[i], 3]), 1e-3))
                positions[i], indices[i] = v.astype("<f4").tobytes(), f.astype("<u4").tobytes()
            items = pa.array([t for n, k in zip(neurons, kinds, strict=True) for t in (n, str(k))], pa.string())
            tags = pa.MapArray.from_arrays(pa.array(np.arange(len(neurons) + 1, dtype=np.int32) * 2), pa.array(["name", "type"] * len(neurons), pa.string()), items)
            yield pa.RecordBatch.from_arrays([batch.column("neuron"), pa.array(positions, pa.binary()), pa.array(indices, pa.binary()), tags], names=["name", "positions", "indices", "tags"])

    return paths.select("neuron", "type", "points").mapInArrow(run, "name string, positions binary, indices binary, tags map<string,string>")


def morphology(nodes: DataFrame) -> DataFrame:
    """Bounds, centroid and size of each tree."""
    return nodes.groupBy("neuron").agg(*[f(a).alias(f"{n}_{a}") for a in "xyz" for f, n in ((F.min, "min"), (F.max, "max"), (F.avg, "mean"))], F.count(F.lit(1)).alias("nodes"))
