import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quadrille.codecs import glb, precomputed
from quadrille.functions import geometry, udfs
from quadrille.operators import fragments, sequences
from quadrille.sinks import exports
from quadrille.sources import features, tables

CUBE = (0.0, 0.0, 0.0, 1.0, 1.0, 1.0)


def shapes(spark):
    square = [[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [0.0, 2.0]]
    rows = [(0, 3, [square], {"t": "a"}), (1, 2, [[[0.0, 0.0], [1.0, 1.0], [2.0, 0.0]]], {"t": "b"}), (2, 1, [[[1.0, 1.0]]], {}), (3, 5, [[[0.0, 0.0, 1.0], [1.0, 0.0, 1.0], [0.0, 1.0, 1.0]]], {})]
    return spark.createDataFrame(rows, "fid long, kind tinyint, parts array<array<array<double>>>, tags map<string,string>")


def test_scene(spark):
    data = exports.scene(shapes(spark), "t", {"a": (1, 0, 0, 1)}, row_width=5.0, gap=0.5)
    doc = glb.document(data)
    assert [n["name"] for n in doc["nodes"]] == ["0", "1", "2", "3"] and len(doc["materials"]) == 1
    assert doc["nodes"][1]["translation"] == [2.5, 0.0, 0.0] and doc["nodes"][2]["translation"] == [0.0, 2.5, 0.0]
    assert len(glb.decode(data)[1]) == 9
    with pytest.raises(ValueError):
        exports.scene(shapes(spark), row_width=1.0)


def test_text_exports(spark):
    rows = [json.loads(r.value) for r in exports.geojson(shapes(spark)).orderBy("fid").collect()]
    assert rows[0]["geometry"]["coordinates"][0][0] == rows[0]["geometry"]["coordinates"][0][-1] and rows[1]["properties"] == {"t": "b"}
    v = np.array([[0, 0, 0], [1, 0, 0], [0, 0.5, 0]], "<f4")
    m = spark.createDataFrame([("m", v.tobytes(), np.array([0, 1, 2], "<u4").tobytes())], "name string, positions binary, indices binary")
    back = features.parse_obj(bytes(exports.obj_files(m).first().content).decode())
    assert back[0].tolist() == v.tolist() and back[1].tolist() == [[0, 1, 2]]
    layer = {"extent": 4096, "features": [{"kind": 1, "parts": [[(2048, 2048)]], "tags": {}}]}
    assert exports.tile_geojson(layer, 0, 0, 0)[0]["geometry"]["coordinates"] == pytest.approx([0.0, 0.0])


def test_multi_resolution_meshes(spark):
    rows = spark.createDataFrame([(7, 5, [[[0.1, 0.1, 0.1], [0.9, 0.1, 0.1], [0.1, 0.9, 0.1]]], {})], "fid long, kind tinyint, parts array<array<array<double>>>, tags map<string,string>")
    out = {r.path: bytes(r.content) for r in exports.multilod_meshes(fragments.fragments(rows, CUBE, 1), CUBE, 1).collect()}
    index = out["7.index"]
    assert np.frombuffer(index, "<u4", 1, 24)[0] == 2
    per = np.frombuffer(index, "<u4", 2, 28 + 8 + 24)
    assert per.tolist() == [4, 1]  # lod 0 is the finest: whole faces in each of four tiles
    v, f = precomputed.read_mesh(out["7"][: len(out["7"]) // 5])
    assert len(v) == 3 and len(f) == 1


def test_annotations_manifest_colours(spark):
    line = shapes(spark).where("fid = 1").withColumn("parts", F.array(F.transform(F.col("parts")[0], lambda p: F.concat(p, F.array(F.lit(5.0))))))
    data, info = exports.line_annotations(line)
    assert precomputed.read_annotations("LINE", data)[0].tolist() == [[0, 0, 5, 1, 1, 5], [1, 1, 5, 2, 0, 5]] and info["annotation_type"] == "LINE"
    assert exports.manifest([("a", "p")]) == [{"id": "a", "path": "p"}]
    assert len(set(exports.golden_colours(20))) == 20
    assert [r[0] for r in shapes(spark).orderBy("fid").select(exports.colour_of(F.element_at("tags", F.lit("t")), {"a": "#ff0000"})).collect()][:2] == ["#ff0000", "#808080"]
    assert exports.vocabulary("http://x")["uri"] == "http://x" and exports.vocabulary('{"terms":{"a":"u"}}')["terms"] == {"a": ("u", "a")}
    long = spark.createDataFrame([("b", "1", 5), ("a", "2", 1), ("a", "1", 2)], "gene string, cell_id string, count long")
    assert [(r.gene, r.cells, r.counts, r.indptr) for r in exports.compressed_columns(long).orderBy("gene").collect()] == [("a", ["1", "2"], [2, 1], 0), ("b", ["1"], [5], 2)]


def test_ids_arrow_and_places(spark):
    df = spark.createDataFrame([(5, 1), (None, 2), (5, 3), (9, 4)], "id long, pos int")
    assert [r.uid for r in sequences.unique_ids(df, "id", ["pos"]).orderBy("pos").collect()] == [5, 10, 11, 9]
    table = pa.table({"id": ["x", "y"], "geometry": [geometry.to_wkb({"type": "Point", "coordinates": [1.0, 2.0]}), None]})
    got = tables.arrow_features(spark, table).collect()
    assert [(r.kind, r.parts, r.tags) for r in got] == [(1, [[[1.0, 2.0]]], {"id": "x"})]
    assert tables.morphology_image(["morphology_focus.ome.tif", "a"]) == "morphology_focus.ome.tif" and tables.morphology_image([]) is None


def test_sql_functions(spark):
    assert len(udfs.register(spark)) == 9
    row = spark.sql("""SELECT quad_clip_line(array(array(0D, 0D), array(4D, 4D)), 0, 1D, 2D) AS l, quad_simplify(array(array(0D, 0D), array(1D, 0D), array(2D, 0D)), 0.1D, 2) AS s,
        quad_from_wkb(quad_to_wkb('{"type":"Point","coordinates":[1.0,2.0]}')) AS g, quad_murmur3(42L) AS h, size(quad_triangulate(array(array(array(0D,0D), array(1D,0D), array(1D,1D), array(0D,1D))))) AS t""").first()
    assert row.l == [[[1.0, 1.0], [2.0, 2.0]]] and len(row.s) == 2 and json.loads(row.g)["coordinates"] == [1.0, 2.0] and row.t == 2
    assert row.h == np.uint64(0xC20B94F95119F47A).astype(np.int64)
