"""Neuroglancer's precomputed formats: meshes, skeletons, annotations, segment properties, sharded containers."""

from __future__ import annotations

import struct
from collections.abc import Iterable

import numpy as np
import pyarrow as pa

from ..functions.geometry import good_faces, indexed, murmur3_64


def mesh(vertices: np.ndarray, faces: np.ndarray) -> bytes:
    """A legacy mesh fragment: vertex count, float32 positions, uint32 indices."""
    return struct.pack("<I", len(vertices)) + np.asarray(vertices, "<f4").tobytes() + np.asarray(faces, "<u4").tobytes()


def read_mesh(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    (n,) = struct.unpack_from("<I", data)
    return np.frombuffer(data, "<f4", 3 * n, 4).reshape(-1, 3), np.frombuffer(data, "<u4", offset=4 + 12 * n).reshape(-1, 3)


def fragments_mesh(parts: Iterable[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Triangles (n x 3 x 3) of a feature's fragments as one mesh: shared vertices and faces once, degenerate ones none."""
    corners = np.concatenate([np.asarray(p, "<f4").reshape(-1, 3) for p in parts] or [np.zeros((0, 3), "<f4")])
    if not len(corners):
        return corners, np.zeros((0, 3), np.int64)
    vertices, of = indexed(corners)
    return vertices, good_faces(of.reshape(-1, 3))


def mesh_info() -> dict:
    return {"@type": "neuroglancer_legacy_mesh"}


def mesh_manifest(segment: int) -> dict:
    return {"fragments": [f"{segment}:0"]}


def skeleton(vertices: np.ndarray, edges: np.ndarray, attributes: dict[str, np.ndarray]) -> bytes:
    out = struct.pack("<II", len(vertices), len(edges)) + np.asarray(vertices, "<f4").tobytes() + np.asarray(edges, "<u4").tobytes()
    return out + b"".join(np.asarray(a, "<f4").tobytes() for a in attributes.values())


def skeletons(starts: np.ndarray, ids: np.ndarray, parents: np.ndarray, xyz: np.ndarray, attributes: list[np.ndarray]) -> pa.BinaryArray:
    """What ``skeleton`` gives for many trees, whose nodes stand end to end in the order of ids; ``starts``: where each
    tree's nodes start, and the end. A node whose parent isn't in its tree has no edge."""
    n, trees = np.diff(starts), len(starts) - 1
    of = np.repeat(np.arange(trees), n)
    place = np.arange(len(ids)) - starts[:-1][of]
    known, number = np.unique(np.concatenate([ids, parents]), return_inverse=True)
    own, up = number.ravel()[: len(ids)] + of * len(known), number.ravel()[len(ids) :] + of * len(known)
    at = np.maximum(np.searchsorted(own, up, side="right") - 1, 0)
    child = np.flatnonzero(own[at] == up) if len(own) else at
    m = np.bincount(of[child], minlength=trees)
    edge = np.arange(len(child)) - (np.cumsum(m) - m)[of[child]]
    words = 2 + (3 + len(attributes)) * n + 2 * m
    ends = np.cumsum(words)
    base = ends - words
    out = np.zeros(int(words.sum()), "<u4")
    out[base], out[base + 1] = n, m
    first, edges = base[of] + 2 + 3 * place, (base + 2 + 3 * n)[of[child]] + 2 * edge
    for k in range(3):
        out[first + k] = xyz[:, k].astype("<f4").view("<u4")
    out[edges], out[edges + 1] = place[at[child]], place[child]
    for k, a in enumerate(attributes):
        out[(base + 2 + 3 * n + 2 * m + k * n)[of] + place] = a.astype("<f4").view("<u4")
    off = np.concatenate([[0], 4 * ends]).astype("<i4")
    return pa.BinaryArray.from_buffers(pa.binary(), trees, [None, pa.py_buffer(off), pa.py_buffer(out)])


def read_skeleton(data: bytes, attributes: list[str]) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    n, m = struct.unpack_from("<II", data)
    at = 8 + 12 * n + 8 * m
    found = {}
    for i, name in enumerate(attributes):
        found[name] = np.frombuffer(data, "<f4", n, at + 4 * n * i)
    return np.frombuffer(data, "<f4", 3 * n, 8).reshape(-1, 3), np.frombuffer(data, "<u4", 2 * m, 8 + 12 * n).reshape(-1, 2), found


def skeleton_info(transform: list[float] | None = None, attributes: tuple[str, ...] = ("radius", "type")) -> dict:
    """``transform``: the top three rows of an affine matrix; the unit matrix otherwise."""
    unit = [1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0, 0]
    return {"@type": "neuroglancer_skeletons", "transform": [float(v) for v in transform or unit], "vertex_attributes": [{"id": a, "data_type": "float32", "num_components": 1} for a in attributes]}


def annotations(kind: str, rows: np.ndarray, ids: np.ndarray) -> bytes:
    """Points (n x 3) or lines (n x 6): count, coordinates, ids."""
    width = {"POINT": 3, "LINE": 6}[kind]
    return struct.pack("<Q", len(rows)) + np.asarray(rows, "<f4").reshape(-1, width).tobytes() + np.asarray(ids, "<u8").tobytes()


def read_annotations(kind: str, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    (n,) = struct.unpack_from("<Q", data)
    width = {"POINT": 3, "LINE": 6}[kind]
    return np.frombuffer(data, "<f4", n * width, 8).reshape(n, width), np.frombuffer(data, "<u8", n, 8 + 4 * n * width)


def annotation_info(kind: str, low: list[float], high: list[float], names: tuple[str, ...] = ("x", "y", "z"), unit: str = "m", scale: float = 1.0) -> dict:
    chunk = [max(b - a, 1e-9) for a, b in zip(low, high, strict=True)]
    return {
        "@type": "neuroglancer_annotations_v1", "dimensions": {n: [scale, unit] for n in names}, "lower_bound": low, "upper_bound": high, "annotation_type": kind,
        "properties": [], "relationships": [], "by_id": {"key": "by_id"}, "spatial": [{"key": "spatial0", "grid_shape": [1] * len(names), "chunk_size": chunk, "limit": 1 << 31}],
    }


def segment_properties(rows: list[tuple[int, dict]]) -> dict:
    """A property a key: numbers (uint32 if all are whole and not negative, else float32), text otherwise; "" where
    a text is missing, 0 where a number is."""
    keys = list(dict.fromkeys(k for _, tags in rows for k in tags))
    out = []
    for key in keys:
        values = [tags.get(key) for _, tags in rows]
        have = [v for v in values if v is not None]
        if have and len(have) == len(values) and all(isinstance(v, int | float) and not isinstance(v, bool) for v in have):
            kind = "uint32" if all(float(v).is_integer() and 0 <= v < 1 << 32 for v in have) and not any(isinstance(v, float) for v in have) else "float32"
            out.append({"id": key, "type": "number", "data_type": kind, "values": values})
        else:
            out.append({"id": key, "type": "label" if key == (keys[0] if keys else "") else "string", "values": ["" if v is None else str(v) for v in values]})
    return {"@type": "neuroglancer_segment_properties", "inline": {"ids": [str(i) for i, _ in rows], "properties": out}}


def shard_of(key: int, minishard_bits: int, shard_bits: int, preshift: int = 0) -> tuple[int, int]:
    """(shard, minishard) of a key by the low 64 bits of MurmurHash3 x86_128."""
    h = murmur3_64(key >> preshift)
    return (h >> minishard_bits) & ((1 << shard_bits) - 1), h & ((1 << minishard_bits) - 1)


def sharding(minishard_bits: int, shard_bits: int, preshift: int = 0) -> dict:
    return {
        "@type": "neuroglancer_uint64_sharded_v1", "preshift_bits": preshift, "hash": "murmurhash3_x86_128", "minishard_bits": minishard_bits, "shard_bits": shard_bits,
        "minishard_index_encoding": "raw", "data_encoding": "raw",
    }


def shard(entries: list[tuple[int, bytes]], minishard_bits: int, preshift: int = 0) -> bytes:
    """One shard file: the index of minishards, the data, and delta-coded minishard indexes."""
    by: dict[int, list[tuple[int, bytes]]] = {}
    for key, data in sorted(entries, key=lambda e: e[0]):
        by.setdefault(shard_of(key, minishard_bits, 0, preshift)[1], []).append((key, data))
    body, indexes, index = bytearray(), {}, np.zeros((1 << minishard_bits, 2), "<u8")
    for m in sorted(by):
        rows, last_key, end = [], 0, 0
        for key, data in by[m]:
            rows.append((key - last_key, len(body) - end, len(data)))
            body.extend(data)
            last_key, end = key, len(body)
        indexes[m] = np.array(rows, "<u8").T.tobytes()
    for m, raw in indexes.items():
        index[m] = (len(body), len(body) + len(raw))
        body.extend(raw)
    return index.tobytes() + bytes(body)


def read_shard(data: bytes, key: int, minishard_bits: int, preshift: int = 0) -> bytes | None:
    m, head = shard_of(key, minishard_bits, 0, preshift)[1], 16 << minishard_bits
    start, end = np.frombuffer(data, "<u8", 2, 16 * m).tolist()
    if start == end:
        return None
    ids, offsets, sizes = np.frombuffer(data[head + start : head + end], "<u8").reshape(3, -1).astype(np.int64)
    ids = np.cumsum(ids)
    ends = np.cumsum(offsets + sizes)
    hit = np.flatnonzero(ids == key)
    return data[head + int(ends[hit[0]] - sizes[hit[0]]) : head + int(ends[hit[0]])] if len(hit) else None


def multilod_manifest(chunk: list[float], origin: list[float], scales: list[float], fragments: list[np.ndarray], sizes: list[np.ndarray]) -> bytes:
    """The index of a multi-resolution mesh: per level fragment positions in Morton order and byte sizes."""
    out = np.asarray([*chunk, *origin], "<f4").tobytes() + struct.pack("<I", len(scales)) + np.asarray(scales, "<f4").tobytes()
    out += np.zeros((len(scales), 3), "<f4").tobytes() + np.asarray([len(f) for f in fragments], "<u4").tobytes()
    for f, s in zip(fragments, sizes, strict=True):
        out += np.asarray(f, "<u4").reshape(-1, 3).T.tobytes() + np.asarray(s, "<u4").tobytes()
    return out
