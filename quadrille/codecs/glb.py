"""Binary glTF 2.0: meshes, lines and points to bytes, and the triangles back."""

from __future__ import annotations

import json
import struct

import numpy as np

#: Fixed values of the format.
MAGIC, JSON_CHUNK, BIN_CHUNK = 0x46546C67, 0x4E4F534A, 0x004E4942
FLOAT, UINT32, ARRAY, ELEMENTS = 5126, 5125, 34962, 34963
POINTS, LINES, TRIANGLES = 0, 1, 4


def assemble(nodes: list[dict], y_up: bool = False, extras: dict | None = None) -> tuple[dict, bytes]:
    """(document, buffer) of nodes: positions (n x 3), indices or None, mode, and optional colour (r, g, b, a), name,
    translation and extras."""
    doc: dict = {"asset": {"version": "2.0", "generator": "quadrille"}, "scene": 0, "scenes": [{"nodes": []}], "nodes": [], "meshes": [], "accessors": [], "bufferViews": [], "buffers": []}
    if extras:
        doc["asset"]["extras"] = extras
    data = bytearray()

    def view(raw: bytes, target: int) -> int:
        data.extend(b"\0" * (-len(data) % 4))
        doc["bufferViews"].append({"buffer": 0, "byteOffset": len(data), "byteLength": len(raw), "target": target})
        data.extend(raw)
        return len(doc["bufferViews"]) - 1

    materials: dict[tuple, int] = {}
    for node in nodes:
        p = np.asarray(node["positions"], "<f4").reshape(-1, 3)
        if not len(p):
            continue
        p = np.ascontiguousarray(np.column_stack([p[:, 0], p[:, 2], -p[:, 1]]).astype("<f4")) if y_up else p
        doc["accessors"].append({"bufferView": view(p.tobytes(), ARRAY), "componentType": FLOAT, "count": len(p), "type": "VEC3", "min": p.min(axis=0).tolist(), "max": p.max(axis=0).tolist()})
        primitive: dict = {"attributes": {"POSITION": len(doc["accessors"]) - 1}, "mode": node.get("mode", TRIANGLES)}
        if node.get("indices") is not None:
            i = np.asarray(node["indices"], "<u4").ravel()
            doc["accessors"].append({"bufferView": view(i.tobytes(), ELEMENTS), "componentType": UINT32, "count": len(i), "type": "SCALAR"})
            primitive["indices"] = len(doc["accessors"]) - 1
        if node.get("colour"):
            primitive["material"] = materials.setdefault(tuple(node["colour"]), len(materials))
        doc["meshes"].append({"primitives": [primitive]})
        own: dict = {"mesh": len(doc["meshes"]) - 1}
        own |= {k: node[k] for k in ("name", "translation", "extras") if node.get(k)}
        doc["scenes"][0]["nodes"].append(len(doc["nodes"]))
        doc["nodes"].append(own)
    if materials:
        doc["materials"] = [{"pbrMetallicRoughness": {"baseColorFactor": list(c)}, "doubleSided": True} for c in materials]
    doc["buffers"] = [{"byteLength": len(data)}] if data else []
    return {k: v for k, v in doc.items() if v != []}, bytes(data)


def encode(nodes: list[dict], **options) -> bytes:
    doc, data = assemble(nodes, **options)
    text = json.dumps(doc, separators=(",", ":")).encode()
    text += b" " * (-len(text) % 4)
    data += b"\0" * (-len(data) % 4)
    out = struct.pack("<II", len(text), JSON_CHUNK) + text
    if data:
        out += struct.pack("<II", len(data), BIN_CHUNK) + data
    return struct.pack("<III", MAGIC, 2, 12 + len(out)) + out


def document(data: bytes) -> dict:
    """The JSON chunk alone: names and extras without reading geometry."""
    magic, _, _, size, kind = struct.unpack_from("<IIIII", data)
    if magic != MAGIC or kind != JSON_CHUNK:
        raise ValueError("not a binary glTF")
    return json.loads(data[20 : 20 + size])


def decode(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Positions and triangle corners of all primitives, indices moved so that they stand in one mesh."""
    doc = document(data)
    at = 20 + struct.unpack_from("<I", data, 12)[0]
    body = data[at + 8 :] if at < len(data) else b""

    def values(i: int) -> np.ndarray:
        a = doc["accessors"][i]
        v = doc["bufferViews"][a["bufferView"]]
        kind = {5121: "<u1", 5123: "<u2", UINT32: "<u4", FLOAT: "<f4"}[a["componentType"]]
        width = {"SCALAR": 1, "VEC2": 2, "VEC3": 3, "VEC4": 4}[a["type"]]
        return np.frombuffer(body, kind, a["count"] * width, v.get("byteOffset", 0) + a.get("byteOffset", 0)).reshape(-1, width)

    positions, corners, base = [np.zeros((0, 3), "<f4")], [np.zeros(0, np.int64)], 0
    for mesh in doc.get("meshes", []):
        for p in mesh["primitives"]:
            if p.get("mode", TRIANGLES) == TRIANGLES:
                v = values(p["attributes"]["POSITION"])
                i = values(p["indices"]).ravel().astype(np.int64) if "indices" in p else np.arange(len(v))
                positions.append(v)
                corners.append(i + base)
                base += len(v)
    return np.concatenate(positions), np.concatenate(corners)
