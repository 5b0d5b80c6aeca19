"""Groups and tiles of any size: what used to meet in one task or take a call a group."""

import numpy as np
import pyarrow as pa

from quadrille.codecs import glb, precomputed, tile3d
from quadrille.functions import clipping, geometry
from quadrille.operators import fragments, sequences
from quadrille.sinks import tilesets

CUBE = (0.0, 0.0, 0.0, 1.0, 1.0, 1.0)


def solids(spark, n=40):
    ring = lambda i: [[i / 100, 0.1, 0.1], [i / 100 + 0.01, 0.1, 0.1], [i / 100, 0.11, 0.1]]
    return spark.createDataFrame([(i, 5, [ring(i)], {"n": f"a{i % 3}"}) for i in range(n)], "fid long, kind tinyint, parts array<array<array<double>>>, tags map<string,string>")


def dealt(files, extension):
    """The files of the root tile, by path."""
    return {r.path: bytes(r.content) for r in files.collect() if r.path.startswith("0/") and r.path.endswith(extension)}


def test_a_tile_of_many_features_takes_several_vector_tile_files(spark):
    frags = fragments.fragments(solids(spark), CUBE, 0)
    one, many = dealt(tilesets.pbf3_tiles(frags, "l"), ".pbf3"), dealt(tilesets.pbf3_tiles(frags, "l", most=10), ".pbf3")
    rows = lambda files: sorted((f["id"], f["tags"]["n"], f["positions"].tolist(), f["indices"].tolist()) for c in files.values() for layer in tile3d.decode(c) for f in layer["features"])
    assert list(one) == ["0/0/0/0.pbf3"] and len(many) == 4 and rows(one) == rows(many) and len(rows(one)) == 40


def test_a_tile_of_many_features_takes_several_gltf_files(spark):
    frags = fragments.fragments(solids(spark), CUBE, 0)
    one, many = dealt(tilesets.glb_tiles(frags, CUBE), ".glb"), dealt(tilesets.glb_tiles(frags, CUBE, most=10), ".glb")
    names = lambda files: sorted(n["name"] for c in files.values() for n in glb.document(c)["nodes"])
    assert list(one) == ["0/0/0/0.glb"] and len(many) == 4 and names(one) == names(many) and len(names(one)) == 40
    root = tilesets.tileset(frags, CUBE, most=10)["root"]
    assert sorted(c["uri"] for c in root["contents"]) == sorted(many) and tilesets.tileset(frags, CUBE)["root"]["content"]["uri"] == "0/0/0/0.glb"


def test_meshes_of_many_rows_at_once():
    r = np.random.default_rng(1)
    sizes = [4, 0, 7, 1, 30]
    corners = r.integers(0, 3, (3 * sum(sizes), 3)) / 3
    row = np.repeat(np.arange(5), sizes)
    v, v_off, f, f_off = geometry.meshes(corners, row, 5)
    for k in range(5):
        own = corners.reshape(-1, 3, 3)[row == k].reshape(-1, 3)
        if len(own):
            vertices, of = geometry.indexed(own)
            assert np.array_equal(v[v_off[k] : v_off[k + 1]], vertices) and np.array_equal(f[f_off[k] : f_off[k + 1]], geometry.good_faces(of.reshape(-1, 3)))
        else:
            assert v_off[k] == v_off[k + 1] and f_off[k] == f_off[k + 1]


def test_groups_stay_whole_over_batches():
    keys = ["a", "a", "b", "b", "b", "b", None, None, "c"]
    for size in (1, 2, 3, 4, 9):
        batches = [pa.RecordBatch.from_pydict({"k": pa.array(keys[i : i + size], pa.string()), "i": list(range(len(keys)))[i : i + size]}) for i in range(0, len(keys), size)]
        groups = [batch.column("i").to_pylist()[a:b] for batch, starts in sequences.whole_groups(batches, "k") for a, b in zip(starts[:-1], starts[1:], strict=True)]
        assert groups == [[0, 1], [2, 3, 4, 5], [6, 7], [8]]


def test_skeletons_of_many_trees_at_once():
    r = np.random.default_rng(2)
    ids, parents, starts = [], [], [0]
    for n in (1, 5, 3):
        ids += list(range(10, 10 + n))
        parents += [-1] + [10 + int(r.integers(0, i)) for i in range(1, n)]
        starts.append(len(ids))
    ids, parents, xyz, radius = np.array(ids), np.array(parents), r.random((9, 3)), r.random(9)
    found = precomputed.skeletons(np.array(starts), ids, parents, xyz, [radius, np.arange(9)]).to_pylist()
    for k, (a, b) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
        edges = np.array([(p - 10, i) for i, p in enumerate(parents[a:b]) if p >= 0]).reshape(-1, 2)
        assert found[k] == precomputed.skeleton(xyz[a:b], edges, {"radius": radius[a:b], "type": np.arange(9)[a:b]})


def test_tubes_of_many_paths_at_once():
    r = np.random.default_rng(3)
    sizes = [2, 5, 3]
    off, p = np.concatenate([[0], np.cumsum(sizes)]), r.random((10, 4))
    p[3] = p[2]  # a segment of no length
    for i, (positions, indices) in enumerate(zip(*geometry.tubes(p, off, 6), strict=True)):
        v, f = geometry.tube(p[off[i] : off[i + 1], :3], p[off[i] : off[i + 1], 3], 6)
        assert np.allclose(np.frombuffer(positions, "<f4").reshape(-1, 3), v, atol=1e-6) and np.array_equal(np.frombuffer(indices, "<u4").reshape(-1, 3), f)


def test_many_lines_are_simplified_as_each_by_itself():
    r = np.random.default_rng(4)
    sizes = r.integers(1, 12, 300)
    off = np.concatenate([[0], np.cumsum(sizes)])
    v = r.integers(0, 6, (off[-1], 2)) / 6.0
    for segment in (False, True):
        for least in (2, 4):
            one = np.concatenate([geometry.kept(v[a:b], 0.21, least, segment) for a, b in zip(off[:-1], off[1:], strict=True)])
            assert np.array_equal(one, geometry.kept_of(v, off, 0.21, least, segment))


def test_fragments_are_measured_where_they_are_cut(spark):
    rows = [(1, 2, [[[0.1, 0.1], [0.9, 0.1]]], {}), (2, 2, [[[0.1, 0.2], [0.2, 0.2]], [[0.1, 0.3], [0.1, 0.4]]], {})]
    df = spark.createDataFrame(rows, "fid long, kind tinyint, parts array<array<array<double>>>, tags map<string,string>")
    found = fragments.fragments(df, (0.0, 0.0, 1.0, 1.0), 1, measure=clipping.lengths)
    assert {(r.feature_id, r.zoom, r.tile_x): round(r.size, 9) for r in found.collect()} == {(1, 0, 0): 0.8, (1, 1, 0): 0.4, (1, 1, 1): 0.4, (2, 0, 0): 0.2, (2, 1, 0): 0.2}
    assert clipping.areas(np.array([[0, 0], [2, 0], [0, 2.0], [0, 0], [0, 1], [1, 0.0]]), np.array([0, 3, 6])).tolist() == [2.0, -0.5]


def test_equal_meshes_are_collapsed_once_and_over_all_cores(spark):
    v, f = geometry.icosphere(np.zeros(3), 1.0, 1)
    rows = [(f"m{i}", bytearray(v.astype("<f4").tobytes()), bytearray(f.astype("<u4").tobytes()), {}) for i in range(40)]
    df = spark.createDataFrame(rows, "name string, positions binary, indices binary, tags map<string,string>").coalesce(1)
    out = fragments.simplified_meshes(df, 1, base=1)
    assert out.rdd.getNumPartitions() > 1 and out.select("zoom", "positions", "indices").distinct().count() == 2 and out.count() == 80


def test_changes_take_one_exchange_and_runs_no_aggregation(spark):
    from quadrille.operators import facets

    df = spark.createDataFrame([(1, i, k) for i, k in enumerate(["a", "a", None, None, "b", "a"], 1)] + [(2, 1, "a")], "id long, pos int, kind string")
    own = sequences.runs(df, ["id"], "pos", "kind")
    assert sorted((tuple(r) for r in own.collect()), key=lambda r: r[:2]) == [(1, 1, "a", 1, 2, 2), (1, 2, None, 3, 4, 2), (1, 3, "b", 5, 5, 1), (1, 4, "a", 6, 6, 1), (2, 1, "a", 1, 1, 1)]
    assert "Aggregate" not in own._jdf.queryExecution().optimizedPlan().toString()
    changes = facets.geometry_changes(df, df.where("pos > 1"), ["id", "pos"], "id")
    assert {tuple(r) for r in changes.collect()} == {(1, 1, 0), (2, 1, 0)} and changes._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 2


def test_a_large_table_is_spread_by_its_size(spark, tmp_path, monkeypatch):
    spark.range(1000).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    assert sequences.spread(df, "id") is df
    monkeypatch.setattr(sequences, "_SHARE", 100)
    assert sequences.spread(df, "id").rdd.getNumPartitions() > 4


def test_a_flat_tile_of_many_features_takes_several_files(spark, tmp_path):
    from quadrille.codecs import mvt
    from quadrille.sinks import files
    from quadrille.sources import features

    rows = [(i, 3, [[[0.1, 0.1], [0.1 + i / 100, 0.1], [0.1, 0.2]]], {"id": str(i)}) for i in range(1, 41)]
    frags = fragments.fragments(spark.createDataFrame(rows, "fid long, kind tinyint, parts array<array<array<double>>>, tags map<string,string>"), (0.0, 0.0, 1.0, 1.0), 0)
    one, many = dealt(tilesets.mvt_tiles(frags, "l"), ".pbf"), dealt(tilesets.mvt_tiles(frags, "l", most=10), ".pbf")
    of = lambda files: sorted((f["id"], f["tags"]["id"], str(f["parts"])) for c in files.values() for layer in mvt.decode(c) for f in layer["features"])
    assert list(one) == ["0/0/0.pbf"] and len(many) == 4 and of(one) == of(many) and len(of(one)) == 40
    files.write_files(tilesets.mvt_tiles(frags, "l", most=10), f"{tmp_path}/v")
    assert features.mvt_tiles(spark, f"{tmp_path}/v", (0.0, 0.0, 1.0, 1.0), zoom=0, tile_x=0, tile_y=0).count() == 40
