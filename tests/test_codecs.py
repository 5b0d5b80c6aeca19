import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quadrille.codecs import glb, mvt, precomputed, tile3d, wire
from quadrille.functions.geometry import murmur3_64


@given(st.integers(-(2**31), 2**31 - 1))
def test_zigzag_and_varints(v):
    assert wire.unzigzag(wire.zigzag(v)) == v
    assert wire.read_varint(wire.varint(wire.zigzag(v)), 0)[0] == wire.zigzag(v)


def test_commands_of_the_published_example():
    assert mvt.encode_geometry(3, [[(3, 6), (8, 12), (20, 34)]]) == [9, 6, 12, 18, 10, 12, 24, 44, 15]
    assert mvt.encode_geometry(1, [[(25, 17)]]) == [9, 50, 34]


vertex = st.tuples(st.integers(-200, 5000), st.integers(-200, 5000))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.tuples(st.just(1), st.lists(st.lists(vertex, min_size=1, max_size=5), min_size=1, max_size=1)), st.tuples(st.just(2), st.lists(st.lists(vertex, min_size=2, max_size=5), min_size=1, max_size=3)), st.tuples(st.just(3), st.lists(st.lists(vertex, min_size=3, max_size=5), min_size=1, max_size=3))), max_size=5))
def test_vector_tiles_round_trip(features):
    tags = {"s": "é", "i": -5, "u": 7, "f": 0.5, "b": True, "z": 0, "none": None}
    rows = [{"id": i, "kind": k, "parts": p, "tags": tags} for i, (k, p) in enumerate(features)]
    layers = mvt.decode(mvt.merge(mvt.encode_layer("a", rows), mvt.encode_layer("b", rows, 512)))
    assert [(x["name"], x["extent"]) for x in layers] == ([("a", 4096), ("b", 512)] if rows else [])
    for layer in layers:
        assert layer["features"] == [r | {"tags": {k: v for k, v in tags.items() if v is not None}} for r in rows]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3), st.lists(st.lists(st.lists(vertex, min_size=3, max_size=5), min_size=1, max_size=3), min_size=1, max_size=5))
def test_many_geometries_at_once(kind, features):
    parts = [p for f in features for p in f]
    v, off = np.array([c for p in parts for c in p]), np.cumsum([0] + [len(p) for p in parts])
    row = np.repeat(np.arange(len(features)), [len(f) for f in features])
    got = mvt.encode_geometries(kind, v, off, row, len(features) + 1)
    assert [wire.unpacked(g) for g in got] == [*(mvt.encode_geometry(kind, f) for f in features), []]
    rows = [(i, kind, g, [("a", "1"), ("b", str(i % 2))]) for i, g in enumerate(got)]
    want = [{"id": i, "kind": kind, "parts": [[c for p in f for c in p]] if kind == 1 else f, "tags": {"a": "1", "b": str(i % 2)}} for i, f in enumerate(features)]
    assert mvt.decode(mvt.encode_rows("l", rows))[0]["features"] == want


def test_3d_tiles_round_trip():
    mesh = {"id": 3, "kind": 5, "positions": np.arange(9, dtype="<f4").reshape(3, 3), "indices": np.array([0, 1, 2]), "tags": {"a": 1}, "radii": [0.5, 1.5]}
    line = {"id": 4, "kind": 2, "parts": [[(1, 2, -3), (4, 5, 6)], [(0, 0, 9), (7, 7, 7)]], "tags": {"a": 1, "b": "x"}}
    (layer,) = tile3d.decode(tile3d.encode_layer("l", [mesh, line], 4096, 100))
    assert (layer["name"], layer["extent"], layer["extent_z"]) == ("l", 4096, 100)
    a, b = layer["features"]
    assert (a["positions"] == mesh["positions"]).all() and a["indices"].tolist() == [0, 1, 2] and a["radii"] == [0.5, 1.5]
    assert b == line


def test_glb_round_trip():
    p = np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0]], float)
    data = glb.encode([{"positions": p, "indices": [0, 1, 2], "name": "n", "extras": {"k": "v"}, "colour": [1, 0, 0, 1]}, {"positions": p + 5, "indices": None, "mode": glb.POINTS}, {"positions": p + 9, "indices": [2, 1, 0]}])
    v, i = glb.decode(data)
    assert v.tolist() == np.concatenate([p, p + 9]).tolist() and i.tolist() == [0, 1, 2, 5, 4, 3]
    doc = glb.document(data)
    assert doc["nodes"][0] == {"mesh": 0, "name": "n", "extras": {"k": "v"}} and len(data) % 4 == 0
    assert glb.decode(glb.encode([{"positions": [[1, 2, 3]], "indices": [0, 0, 0]}], y_up=True))[0].tolist() == [[1, 3, -2]]
    assert glb.decode(glb.encode([]))[0].shape == (0, 3)
    with pytest.raises(ValueError):
        glb.document(b"x" * 24)


def test_precomputed_meshes_skeletons_annotations():
    t = np.array([[[0, 0, 0], [1, 0, 0], [0, 1, 0]], [[1, 0, 0], [0, 1, 0], [1, 1, 0]], [[0, 0, 0], [0, 0, 0], [1, 0, 0]]], float)
    v, f = precomputed.fragments_mesh(t)
    assert len(v) == 4 and len(f) == 2
    a, b = precomputed.read_mesh(precomputed.mesh(v, f))
    assert (a == v).all() and (b == f).all()
    x, e, at = precomputed.read_skeleton(precomputed.skeleton(v, np.array([[0, 1]]), {"radius": np.ones(4), "type": np.arange(4)}), ["radius", "type"])
    assert (x == v).all() and e.tolist() == [[0, 1]] and at["type"].tolist() == [0, 1, 2, 3]
    rows, ids = precomputed.read_annotations("LINE", precomputed.annotations("LINE", np.arange(12).reshape(2, 6), np.array([5, 6])))
    assert rows.tolist() == np.arange(12).reshape(2, 6).tolist() and ids.tolist() == [5, 6]
    assert len(precomputed.skeleton_info()["transform"]) == 12


def test_segment_properties():
    p = precomputed.segment_properties([(1, {"name": "a", "v": 100.5, "n": 1}), (2, {"name": "b", "v": 200.0, "n": 2, "x": "y"})])["inline"]
    kinds = {q["id"]: (q["type"], q.get("data_type"), q["values"]) for q in p["properties"]}
    assert kinds == {"name": ("label", None, ["a", "b"]), "v": ("number", "float32", [100.5, 200.0]), "n": ("number", "uint32", [1, 2]), "x": ("string", None, ["", "y"])}


def test_shards():
    rows = [(k, bytes([k % 256]) * (k % 7)) for k in range(200)]
    for s in range(4):
        own = [r for r in rows if precomputed.shard_of(r[0], 3, 2)[0] == s]
        data = precomputed.shard(own, 3)
        assert all(precomputed.read_shard(data, k, 3) == v for k, v in own) and precomputed.read_shard(data, 10**6, 3) is None
    assert precomputed.shard_of(42, 4, 0)[1] == murmur3_64(42) & 15
