"""3D tiles in protocol buffers: points, lines and polygons as delta-coded whole numbers with a separate z list,
meshes as float32 positions and uint32 indices.

A feature is a dict with id, kind (1 point, 2 line, 3 polygon, 4 surface, 5 TIN), parts (lists of (x, y, z)) or, for
meshes, positions (n x 3) and indices; tags; and optional radii.
"""

from __future__ import annotations

import struct

import numpy as np

from . import mvt, wire


def encode_layer(name: str, features: list[dict], extent: int = 4096, extent_z: int = 4096) -> bytes:
    words, body = wire.Dictionary(), []
    for f in features:
        own = wire.whole(1, f.get("id") or 0) + wire.packed(2, words.tags(f.get("tags") or {})) + wire.whole(3, f["kind"])
        if f["kind"] >= 4:
            own += wire.block(7, np.asarray(f["positions"], "<f4").tobytes()) + wire.block(8, np.asarray(f["indices"], "<u4").tobytes())
        else:
            parts = [p for p in f["parts"] if len(p) >= (f["kind"] if f["kind"] > 1 else 1)]
            z = [int(v[2]) for p in parts for v in p]
            own += wire.packed(4, mvt.encode_geometry(f["kind"], [[(int(v[0]), int(v[1])) for v in p] for p in parts]))
            own += wire.packed(5, [wire.zigzag(b - a) for a, b in zip([0, *z[:-1]], z, strict=True)])
        if f.get("radii") is not None:
            own += wire.block(6, np.asarray(f["radii"], "<f4").tobytes())
        body.append(wire.block(2, own))
    out = wire.whole(15, 3) + wire.block(1, name.encode()) + b"".join(body)
    out += b"".join(wire.block(3, k.encode()) for k in words.keys) + b"".join(wire.block(4, wire.tile_value(v)) for _, v in words.values)
    return wire.block(1, out + wire.whole(5, extent) + wire.whole(6, extent_z))


def decode(data: bytes) -> list[dict]:
    layers = []
    for number, body in wire.fields(data):
        if number != 1:
            continue
        layer = {"name": "", "extent": 4096, "extent_z": 4096, "features": []}
        keys, values, raw = [], [], []
        for k, v in wire.fields(body):
            if k == 1:
                layer["name"] = v.decode()
            elif k == 2:
                raw.append(v)
            elif k == 3:
                keys.append(v.decode())
            elif k == 4:
                values.append(wire.read_tile_value(v))
            elif k in (5, 6):
                layer["extent" if k == 5 else "extent_z"] = v
        for item in raw:
            f, tags, geometry, z = {"id": 0, "kind": 0}, [], [], []
            for k, v in wire.fields(item):
                if k == 1:
                    f["id"] = v
                elif k == 2:
                    tags = wire.unpacked(v)
                elif k == 3:
                    f["kind"] = v
                elif k == 4:
                    geometry = wire.unpacked(v)
                elif k == 5:
                    z = np.cumsum([wire.unzigzag(d) for d in wire.unpacked(v)]).tolist()
                elif k == 6:
                    f["radii"] = list(struct.unpack(f"<{len(v) // 4}f", v))
                elif k == 7:
                    f["positions"] = np.frombuffer(v, "<f4").reshape(-1, 3)
                elif k == 8:
                    f["indices"] = np.frombuffer(v, "<u4")
            f["tags"] = {keys[a]: values[b] for a, b in zip(tags[::2], tags[1::2], strict=True)}
            if f["kind"] < 4:
                heights = iter(z)
                f["parts"] = [[(x, y, next(heights)) for x, y in p] for p in mvt.decode_geometry(f["kind"], geometry)]
            layer["features"].append(f)
        layers.append(layer)
    return layers
