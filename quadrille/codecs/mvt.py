"""Vector tiles (Mapbox Vector Tile 2.1): features in tile units to bytes and back.

A feature is a dict with id, kind (1 point, 2 line, 3 polygon), parts (lists of (x, y) whole numbers; rings without
their repeated last vertex) and tags.
"""

from __future__ import annotations

import numpy as np

from . import wire

MOVE, TO, CLOSE = 1, 2, 7


def encode_geometry(kind: int, parts: list[list[tuple[int, int]]]) -> list[int]:
    out, x, y = [], 0, 0

    def run(command: int, points) -> None:
        nonlocal x, y
        out.append(command | len(points) << 3)
        for px, py in points:
            out.extend((wire.zigzag(px - x) & 0xFFFFFFFF, wire.zigzag(py - y) & 0xFFFFFFFF))
            x, y = px, py

    if kind == 1:
        points = [p for part in parts for p in part]
        if points:
            run(MOVE, points)
        return out
    for part in parts:
        if len(part) >= kind:
            run(MOVE, part[:1])
            run(TO, part[1:])
            if kind == 3:
                out.append(CLOSE | 1 << 3)
    return out


def varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of whole numbers under 2**35, end to end, and each one's number of bytes."""
    v = values.astype(np.uint64)
    size = 1 + sum((v >= np.uint64(1 << 7 * k)).astype(np.int64) for k in range(1, 5))
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(5):
        at = np.flatnonzero(size > k)
        out[start[at] + k] = (v[at] >> np.uint64(7 * k) & np.uint64(0x7F)).astype(np.uint8) | np.where(size[at] > k + 1, 128, 0).astype(np.uint8)
    return out, size


def encode_geometries(kind: int, v: np.ndarray, off: np.ndarray, row: np.ndarray, rows: int) -> list[bytes]:
    """What ``encode_geometry`` gives for many features of one kind, as packed bytes: whole-number vertices and the
    offsets of parts, each of a row, in order."""
    if kind == 1:  # all points of a feature are one move
        new = np.append(True, row[1:] != row[:-1]) if len(row) else np.zeros(0, bool)
        off, row = np.append(off[:-1][new], off[-1]), row[new]
    n = np.diff(off)
    delta = v.astype(np.int64).copy()
    delta[1:] -= v[:-1].astype(np.int64)
    first = off[:-1][np.append(True, row[1:] != row[:-1])] if len(row) else off[:0]
    delta[first] = v[first]  # the cursor starts at 0 in each feature
    coded = ((delta << 1) ^ (delta >> 63)) & 0xFFFFFFFF
    head = 1 if kind == 1 else 2  # numbers before and between the vertices of a part
    many = 2 * n + head + (kind == 3)
    start = np.cumsum(many) - many
    out = np.zeros(int(many.sum()), np.int64)
    of = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(v)) - np.repeat(off[:-1], n)
    at = start[of] + 1 + 2 * place + (place > 0) * (head - 1)
    out[at], out[at + 1] = coded[:, 0], coded[:, 1]
    if kind == 1:
        out[start] = MOVE | n << 3
    else:
        out[start], out[start + 3] = MOVE | 1 << 3, TO | n - 1 << 3
        if kind == 3:
            out[start + many - 1] = CLOSE | 1 << 3
    raw, size = varints(out)
    per = np.zeros(rows, np.int64)
    np.add.at(per, row, np.add.reduceat(size, start) if len(start) else 0)
    ends = np.cumsum(per)
    whole = raw.tobytes()
    return [whole[b - a : b] for a, b in zip(per.tolist(), ends.tolist(), strict=True)]


def encode_rows(name: str, rows, extent: int = 4096, typed=lambda pairs: dict(pairs)) -> bytes:
    """A layer from (id, kind, packed geometry, tag pairs) rows; ``typed`` turns pairs into values, once per pair."""
    words, body, known = wire.Dictionary(), [], {}
    for ident, kind, geometry, pairs in rows:
        if not geometry:
            continue
        tags = []
        for pair in pairs or ():
            if pair not in known:
                known[pair] = wire.packed(2, words.tags(typed([pair])))[2:]
            tags.append(known[pair])
        own = wire.whole(1, ident) + (wire.block(2, b"".join(tags)) if tags else b"") + wire.whole(3, kind) + wire.block(4, geometry)
        body.append(wire.block(2, own))
    if not body:
        return b""
    out = wire.whole(15, 2) + wire.block(1, name.encode()) + b"".join(body)
    out += b"".join(wire.block(3, k.encode()) for k in words.keys) + b"".join(wire.block(4, wire.tile_value(v)) for _, v in words.values)
    return wire.block(3, out + wire.whole(5, extent))


def decode_geometry(kind: int, commands: list[int]) -> list[list[tuple[int, int]]]:
    parts: list[list[tuple[int, int]]] = []
    x = y = at = 0
    while at < len(commands):
        command, count = commands[at] & 7, commands[at] >> 3
        at += 1
        if command == CLOSE:
            continue
        for _ in range(count):
            x, y = x + wire.unzigzag(commands[at]), y + wire.unzigzag(commands[at + 1])
            at += 2
            if command == MOVE and not (kind == 1 and parts):
                parts.append([])
            parts[-1].append((x, y))
    return parts


def encode_layer(name: str, features: list[dict], extent: int = 4096) -> bytes:
    """One layer as the bytes of a tile; tiles of several layers are their layers' bytes end to end."""
    words, body = wire.Dictionary(), b""
    for f in features:
        geometry = encode_geometry(f["kind"], f["parts"])
        if geometry:
            own = wire.whole(1, f["id"]) if f.get("id") is not None else b""
            own += wire.packed(2, words.tags(f.get("tags") or {})) + wire.whole(3, f["kind"]) + wire.packed(4, geometry)
            body += wire.block(2, own)
    if not body:
        return b""
    out = wire.whole(15, 2) + wire.block(1, name.encode()) + body
    out += b"".join(wire.block(3, k.encode()) for k in words.keys) + b"".join(wire.block(4, wire.tile_value(v)) for _, v in words.values)
    return wire.block(3, out + wire.whole(5, extent))


def merge(*tiles: bytes) -> bytes:
    """Layers of the same tile in one."""
    return b"".join(tiles)


def decode(data: bytes) -> list[dict]:
    """Layers: name, extent and features as given to ``encode_layer``."""
    layers = []
    for number, body in wire.fields(data):
        if number != 3:
            continue
        layer = {"name": "", "extent": 4096, "features": []}
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
            elif k == 5:
                layer["extent"] = v
        for item in raw:
            f, tags, geometry = {"id": None, "kind": 0}, [], []
            for k, v in wire.fields(item):
                if k == 1:
                    f["id"] = v
                elif k == 2:
                    tags = wire.unpacked(v)
                elif k == 3:
                    f["kind"] = v
                elif k == 4:
                    geometry = wire.unpacked(v)
            f["tags"] = {keys[a]: values[b] for a, b in zip(tags[::2], tags[1::2], strict=True)}
            f["parts"] = decode_geometry(f["kind"], geometry)
            layer["features"].append(f)
        layers.append(layer)
    return layers
