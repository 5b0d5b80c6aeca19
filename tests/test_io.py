import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille import registry
from quadrille.codecs import glb, mvt, precomputed, tile3d
from quadrille.functions import geometry
from quadrille.operators import fragments, tags
from quadrille.sinks import files, tilesets
from quadrille.sources import features, tables
from quadrille.streaming import incremental

UNIT = (0.0, 0.0, 1.0, 1.0)
CUBE = (0.0, 0.0, 0.0, 1.0, 1.0, 1.0)


def collection(*shapes):
    return {"type": "FeatureCollection", "features": [{"type": "Feature", "id": str(i), "geometry": g, "properties": {"n": i, "s": f"v{i}", "skip": None, "list": [1], "deep": {"a": 1}}} for i, g in enumerate(shapes)]}


@pytest.fixture
def geojson(tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    poly = [[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]], [[1, 1], [2, 1], [2, 2], [1, 1]]]
    shapes = [{"type": "Point", "coordinates": [1, 2]}, None, {"type": "MultiPoint", "coordinates": [[3, 3], [4, 4]]}, {"type": "Polygon", "coordinates": poly}, {"type": "GeometryCollection", "geometries": [{"type": "LineString", "coordinates": [[0, 0], [4, 4]]}, {"type": "LineString", "coordinates": [[0, 0]]}]}]
    (d / "a.json").write_text(json.dumps(collection(*shapes)))
    (d / "b.json").write_text(json.dumps({"type": "MultiPolygon", "coordinates": [poly, [[[5, 5], [6, 5], [6, 6], [5, 5]]]]}))
    (d / "c.json").write_text("not json")
    return str(d)


def test_geojson(spark, geojson):
    rows = features.geojson(spark, geojson).orderBy("fid").collect()
    assert [(r.fid, r.kind, len(r.parts)) for r in rows] == [(0, 1, 1), (1, 1, 1), (2, 1, 1), (3, 3, 2), (4, 2, 1), (5, 3, 3)]
    assert rows[0].tags == {"id": "0", "n": "0", "s": "v0"} and len(rows[3].parts[0]) == 4 and rows[5].tags == {}
    promoted = features.geojson(spark, geojson, promote_id="s").where("fid = 0").first()
    assert promoted.tags["id"] == "v0"
    with pytest.raises(ValueError):
        features.geojson(spark, geojson, promote_id="s", generate_id=True)


def test_converter_writes_tiles_that_read_back(spark, geojson, tmp_path):
    out = str(tmp_path / "out")
    said = registry.convert(spark, "geojson", geojson, out, {"max_zoom": 2, "simplify": False, "facets": {"include": ["n"], "threshold": 64}})
    assert said["bounds"] == [0, 0, 6, 6] and said["facets"] == ["n"] and said["tiles"] > 3
    back = features.mvt_tiles(spark, f"{out}/vectors", (0.0, 0.0, 6.0, 6.0), zoom=0)
    points = {tuple(r.parts[0][0]) for r in back.where("geom_type = 1").collect()}
    assert {(round(a), round(b)) for a, b in points} == {(1, 2), (3, 3), (4, 4)} and "n" not in back.first().tags
    table = spark.read.parquet(f"{out}/parquet")
    assert {r.zoom for r in table.select("zoom").distinct().collect()} == {0, 1, 2}
    from quadrille.operators.pyramid import read

    plan = read(table, zoom=1, tile_x=0)._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "EqualTo(tile_x,0)" in plan
    meta = json.load(open(f"{out}/metadata.json"))
    assert meta["tilejson"] == "3.0.0" and meta["vector_layers"][0]["fieldenums"]["s"][0] == "v0"
    assert spark.read.parquet(f"{out}/facets/expression.parquet").columns == ["cell_id", "n"]
    with pytest.raises(ValueError):
        registry.convert(spark, "nothing", "", "")
    assert registry.list_formats() == ["geojson", "labelmask", "obj", "xenium"]


def test_vertex_rows(spark):
    """Regular polygons about random centres, vertices dealt at random, next to what makes no ring."""
    rng, rows, want = np.random.default_rng(29), [], {}
    for k, sides in enumerate([3, 5, 8, 13]):
        turn = 2 * np.pi * np.arange(sides) / sides
        ring = rng.uniform(-90, 90, 2) + rng.uniform(2, 9) * np.column_stack([np.cos(turn), np.sin(turn)])
        ring = np.vstack([ring, ring[:1]]) if k % 2 else ring  # closed or not
        want[f"p{k}"] = ring[:sides]
        rows += [(j, f"p{k}", *v) for j, v in enumerate(ring.tolist())]
    rows += [(0, "short", 1.0, 2.0), (1, "short", 3.0, 4.0), (0, "none", None, 5.0)]
    rows = [rows[i] for i in rng.permutation(len(rows))]
    df = spark.createDataFrame(rows, "pos int, cell_id string, x double, y double").repartition(3)
    got = {r.tags["cell_id"]: np.array(r.parts[0]) for r in features.polygons(df, "cell_id", "x", "y", "pos").collect()}
    assert got.keys() == want.keys()
    for name, ring in want.items():
        assert abs(abs(geometry.signed_area(got[name])) - abs(geometry.signed_area(ring))) < 1e-9 and np.allclose(np.sort(got[name], axis=0), np.sort(ring, axis=0))
    every = np.vstack(list(want.values()))
    assert np.allclose(registry.feature_bounds(features.polygons(df, "cell_id", "x", "y", "pos")), [*every.min(axis=0), *every.max(axis=0)])


def test_swc(spark, tmp_path):
    text = "# comment\n1 1 0 0 0 5 -1\n2 3 10 5 2 1 1\n3 3 20 10 5 1 2\n4 3 30 8 7 1 3\n5 3 25 15 6 1 3\n6.0 2 -5 -3 1 1 1.0\n7 2 -15 -8 3 1 6\n8 2 -25 -12 5 1 7\nbad line\n"
    (tmp_path / "n1.CNG.swc").write_text(text)
    (tmp_path / "broken.swc").write_text("1 1 0 0 0 1 7\n")
    nodes = features.swc(spark, str(tmp_path)).persist()
    own = nodes.where("neuron = 'n1'")
    m = fragments.morphology(own).first()
    assert (m.nodes, m.min_x, m.min_y, m.max_z, m.mean_x, m.mean_y, m.mean_z) == (8, -25, -12, 7, 5.0, 1.875, 3.625)
    assert [tuple(r) for r in features.valid_trees(nodes).collect()] == [("broken", "no root")]
    paths = fragments.tree_paths(own).collect()
    assert sorted((r.type, len(r.points)) for r in paths) == [(2, 4), (3, 2), (3, 2), (3, 3)]
    files_ = tilesets.skeletons(own).first()
    v, e, at = precomputed.read_skeleton(bytes(files_.content), ["radius", "type"])
    assert len(v) == 8 and len(e) == 7 and at["radius"][0] == 5
    assert features.swc_text(own).orderBy("id").first().value == "1 1 0.0 0.0 0.0 5.0 -1"
    assert fragments.tubes(fragments.tree_paths(own), 6).count() == 4


def test_meshes(spark, tmp_path):
    (tmp_path / "quad.obj").write_text("v 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\nf 1/1/1 2//2 3 -1\n")
    (tmp_path / "bad.obj").write_text("v 0 0\nf 1 2 x\n")
    found = features.meshes(spark, str(tmp_path))
    r = found.where("name = 'quad'").first()
    assert np.frombuffer(r.indices, "<u4").tolist() == [0, 1, 2, 0, 2, 3] and r.tags == {"name": "quad"}
    assert [x.item.rsplit("/", 1)[1] for x in features.unreadable(spark, found, str(tmp_path), glob="*.obj").collect()] == ["bad.obj"]
    b = features.mesh_bounds(found).first()
    assert (b.x_min, b.x_max, b.z_max, b.meshes, b.vertices, b.faces) == (0, 1, 0, 1, 4, 2)
    out = str(tmp_path / "out")
    said = registry.convert(spark, "obj", str(tmp_path), out, {"max_zoom": 1, "bounds": [0, 0, 0, 1, 1, 1]})
    tiles = features.tileset(spark, f"{out}/3dtiles/tileset.json").collect()
    assert said["tiles"] == len(tiles) and {t.depth for t in tiles} == {0, 1} and all(len(t.box) == 12 for t in tiles)
    assert glb.decode(open(f"{out}/3dtiles/0/0/0/0.glb", "rb").read())[1].tolist() == [0, 1, 2, 0, 2, 3]
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "m.glb").write_bytes(glb.encode([{"positions": [[0, 0, 0], [1, 0, 0], [0, 1, 0]], "indices": [0, 1, 2]}]))
    assert features.meshes(spark, str(tmp_path / "g"), kind="glb").first().name == "m"
    city = {"vertices": [[0, 0, 0], [10, 0, 0], [10, 10, 0], [0, 10, 0]], "transform": {"scale": [0.1] * 3, "translate": [1, 1, 1]}, "CityObjects": {"b": {"attributes": {"h": 3}, "geometry": [{"lod": "1", "boundaries": [[[0, 1, 2, 3]]]}]}}}
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "c.json").write_text(json.dumps(city))
    r = features.meshes(spark, str(tmp_path / "c"), kind="cityjson").first()
    assert r.name == "b" and np.frombuffer(r.positions, "<f4").max() == 2 and r.tags["h"] == "3"


def test_matrix_market(spark, tmp_path):
    def put(name, text):
        with gzip.open(tmp_path / name, "wt") as f:
            f.write(text)

    put("features.tsv.gz", "id1\tGENE_C\nid2\tGENE_A\n")
    put("barcodes.tsv.gz", "1\n2\n3\n")
    put("matrix.mtx.gz", "%%MatrixMarket\n%x\n2 3 3\n1 2 1\n2 1 5\n2 3 9\n")
    coo, genes, cells = tables.matrix_market(spark, str(tmp_path))
    from quadrille.operators.facets import expression

    want = {("GENE_C", "2", 1), ("GENE_A", "1", 5), ("GENE_A", "3", 9)}
    assert {tuple(r) for r in expression(coo, genes, cells).collect()} == want
    put("matrix.mtx.gz", "%%MatrixMarket\n3 2 3\n2 1 1\n1 2 5\n3 2 9\n")
    assert {tuple(r) for r in expression(*tables.matrix_market(spark, str(tmp_path))).collect()} == want
    put("matrix.mtx.gz", "%%MatrixMarket\n7 7 1\n1 1 1\n")
    with pytest.raises(ValueError):
        tables.matrix_market(spark, str(tmp_path))


def test_small_tables(spark, tmp_path):
    (tmp_path / "c.csv").write_text("barcode,CLUSTER\na,1\nb,x\n")
    assert [tuple(r) for r in tables.clusters(spark, str(tmp_path / "c.csv")).collect()] == [("a", 1)]
    (tmp_path / "e.xenium").write_text('{"pixel_size": 0.2125}')
    assert tables.pixel_size(spark, str(tmp_path / "e.xenium")) == 0.2125
    (tmp_path / "a.tsv").write_text("root_id\tsuper_class\tcell_type\n12\tcentral\tPN1\nx1\tcentral\tPN2\n13\toptic\tT4\n")
    assert [r.root_id for r in tables.annotations(spark, str(tmp_path / "a.tsv"), ["optic"]).collect()] == ["13"]
    cells = spark.createDataFrame([("c", 1.0)], "cell_label string, x double")
    ccf = spark.createDataFrame([("c", 5.0)], "cell_label string, x double")
    assert tables.with_coordinates(cells, ccf).first().pos_x == 5.0
    s = spark.createDataFrame([("a", 1.0, 2)], "cell_id string, x_centroid double, other int")
    assert tables.cell_summary(s, spark.createDataFrame([("a",)], "cell_id string")).columns == ["cell_id", "x_centroid"]
    volume = np.zeros((1, 4, 5), np.int32)
    volume[0, 1:3, 2:5], volume[0, 0, 0] = 7, 1
    np.save(tmp_path / "v.npy", volume)
    rows = tables.label_rows(spark, str(tmp_path / "v.npy"))
    assert sorted((r.label, r.n, r.x0, r.x1, r.y0, r.y1) for r in rows.collect()) == [(1, 1, 0, 0, 0, 0), (7, 6, 2, 4, 1, 2)]
    assert tables.label_rectangles(rows, 2).first().parts[0][2] == [5.0, 3.0]
    spark.createDataFrame([("7", "x")], "label string, kind string").write.parquet(str(tmp_path / "props"))
    registry.convert(spark, "labelmask", str(tmp_path / "v.npy"), str(tmp_path / "lm"), {"properties": str(tmp_path / "props"), "max_zoom": 0})
    back = {r.feature_id: r.tags.get("kind") for r in spark.read.parquet(str(tmp_path / "lm/parquet")).collect()}
    assert back == {1: None, 7: "x"}


def test_generators(spark):
    rows = tables.random_polygons(spark, 10, 5.0).collect()
    assert len(rows) == 100 and all(5 <= len(r.parts[0]) <= 32 for r in rows)
    for r in rows[:20]:
        p = np.array(r.parts[0])
        e = np.roll(p, -1, axis=0) - p
        f = np.roll(e, -1, axis=0)
        assert (e[:, 0] * f[:, 1] - e[:, 1] * f[:, 0] > 0).all()
    assert [len(tables.random_3d(spark, 3, k).first().parts) for k in ("point", "line", "tin")] == [1, 1, 4]


def test_3d_tiles_and_neuroglancer(spark, tmp_path):
    lattice = [(x * 6 + y * 2 + z, (x + 0.5) / 4, (y + 0.5) / 4, (z + 0.5) / 3) for x in range(4) for y in range(2) for z in range(3)]
    df = spark.createDataFrame([(i, 5, [[[a - 0.04, b - 0.04, c], [a + 0.04, b - 0.04, c], [a, b + 0.04, c]]], {"i": str(i)}) for i, (_, a, b, c) in enumerate(lattice)], "fid long, kind tinyint, parts array<array<array<double>>>, tags map<string,string>")
    frags = fragments.fragments(df, CUBE, 2)
    again = fragments.fragments(df.repartition(5), CUBE, 2)
    assert frags.drop("tags").exceptAll(again.drop("tags")).isEmpty() and frags.count() == again.count()
    out = str(tmp_path / "t")
    assert files.write_files(tilesets.pbf3_tiles(frags, "l"), out) == frags.select("zoom", "tile_x", "tile_y", "tile_d").distinct().count()
    back = features.tiles_3d(spark, out, 0)
    assert back.count() == 24 and back.first().geom_type == 5 and len(back.first().positions) == 36
    meshes = {r.path: bytes(r.content) for r in tilesets.precomputed_meshes(frags, CUBE).collect()}
    assert len(meshes) == 48 and json.loads(meshes["3"]) == {"fragments": ["3:0"]} and len(precomputed.read_mesh(meshes["3:0"])[1]) == 1
    own, manifest = tilesets.feature_pbf3(frags, 2)
    layers = [x["name"] for x in tile3d.decode(bytes(own.first().content))]
    assert layers == ["lod_0", "lod_1", "lod_2"] and manifest.count() == 24 and manifest.first().lods == 3
    shards = tilesets.sharded(df.select(F.col("fid").alias("key"), F.lit(b"x").alias("content")), "key", 2, 1).collect()
    assert {r.path for r in shards} <= {"0.shard", "1.shard"}
    assert tilesets.segment_properties(df.limit(3))["inline"]["properties"][0]["data_type"] == "uint32"
    data, info = tilesets.point_annotations(spark.createDataFrame([(1.0, 2.0, 3.0)], "x double, y double, z double"))
    assert precomputed.read_annotations("POINT", data)[0].tolist() == [[1, 2, 3]] and info["lower_bound"] == [1, 2, 3]
    j = tilesets.tilejson_3d("n", CUBE, 0, 2, spark.createDataFrame([(0, 1)], "zoom int, tiles long"), tags.property_ranges(tags.map_entries_of(df, "fid", "tags")))
    assert j["zoom_counts"] == {"0": 1} and j["vector_layers"][0]["fieldranges"]["i"] == [0, 23]
    assert tilesets.viewer_state([tilesets.viewer_layer("segmentation", "s", "http://x")])["layers"][0]["source"] == "precomputed://http://x"


def test_merged_layers_geoparquet_raster_and_repartition(spark, tmp_path):
    df = spark.createDataFrame([(i, 3, [[[0.1 * i, 0.1], [0.1 * i + 0.05, 0.1], [0.1 * i, 0.2]]], {"a": str(i)}) for i in range(5)], "fid long, kind tinyint, parts array<array<array<double>>>, tags map<string,string>")
    frags = fragments.fragments(df, UNIT, 1)
    both = tilesets.merged_layers(tilesets.mvt_tiles(frags, "a"), tilesets.mvt_tiles(frags, "b"))
    assert [x["name"] for x in mvt.decode(bytes(both.where("path = '0/0/0.pbf'").first().content))] == ["a", "b"]
    meta = tilesets.geoparquet(df, str(tmp_path / "g"))
    assert meta["columns"]["geometry"]["geometry_types"] == ["Polygon"] and meta["columns"]["geometry"]["bbox"][1] == 0.1
    back = features.geoparquet(spark, str(tmp_path / "g")).orderBy("fid").collect()
    assert [r.tags["a"] for r in back] == ["0", "1", "2", "3", "4"] and len(back[0].parts[0]) == 3
    table = fragments.encoded(frags, UNIT)
    files.write_pyramid(table, str(tmp_path / "p"))
    files.write_single(table, str(tmp_path / "s"))
    files.repartitioned(spark, str(tmp_path / "p"), str(tmp_path / "r"), 40)
    cols = table.columns
    serial = lambda d: d.select([F.to_json("tags") if c == "tags" else c for c in cols])
    assert serial(spark.read.parquet(str(tmp_path / "r"))).exceptAll(serial(spark.read.parquet(str(tmp_path / "p")))).isEmpty()
    files.prime(spark, str(tmp_path / "p"), "primed")
    assert spark.table("primed").count() == table.count()
    files.deprime(spark, "primed")
    chunks = spark.createDataFrame([(x, y, [float(x + y)] * 16) for x in range(2) for y in range(2)], "tile_x int, tile_y int, pixels array<float>")
    images = tilesets.raster_pyramid(chunks, 1, 4).collect()
    assert len(images) == 5 and all(bytes(r.content).startswith(b"\x89PNG") for r in images)
    errors = spark.createDataFrame([("error",), ("error",), ("fatal",)], "severity string")
    assert files.run_summary(errors, 7) == {"ok": 7, "error": 2, "fatal": 1}


def test_streams(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.range(100).select((F.col("id") / 100).alias("x"), (F.col("id") / 100).alias("y"), (F.col("id") % 3).cast("string").alias("g")).repartition(4).write.parquet(src)
    schema = spark.read.parquet(src).schema
    stream = incremental.point_stream(spark, src, schema, 1)
    incremental.append_to_pyramid(stream, UNIT, 2, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 300 and out.select("epoch").distinct().count() == 4
    q = incremental.running_lod(stream, UNIT, 1, "g").writeStream.format("memory").queryName("lod").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    q.awaitTermination()
    from quadrille.operators.pyramid import merged_points, over_zooms

    batch = merged_points(over_zooms(spark.read.parquet(src).withColumn("nx", F.col("x")).withColumn("ny", F.col("y")), 1), "g")
    key = ["zoom", "cell_x", "cell_y", "g", "n"]
    assert spark.table("lod").select(key).exceptAll(batch.select(key)).isEmpty() and spark.table("lod").count() == batch.count()


def test_cell_tables_end_to_end(spark, tmp_path):
    src = tmp_path / "x"
    src.mkdir()
    (src / "experiment.xenium").write_text('{"pixel_size": 0.5}')
    v = [(f"c{i}", float(i * 10 + a), float(b)) for i in range(3) for a, b in ((0, 0), (5, 0), (5, 5), (0, 0))]
    spark.createDataFrame(v, "cell_id string, vertex_x double, vertex_y double").coalesce(1).write.parquet(f"{src}/cell_boundaries.parquet")
    t = [(float(i % 20), float(i % 5), "GeneA" if i % 2 else "NegControlX", 30.0 if i % 3 else 5.0) for i in range(60)]
    spark.createDataFrame(t, "x_location double, y_location double, feature_name string, qv double").write.parquet(f"{src}/transcripts.parquet")
    said = registry.convert(spark, "xenium", str(src), str(tmp_path / "o"), {"max_zoom": 2})
    assert said["tiles"] > 1 and "genes" not in said
    lod = spark.read.parquet(str(tmp_path / "o/transcripts"))
    assert {r.zoom: r.n for r in lod.groupBy("zoom").agg(F.sum("n").alias("n")).collect()} == {0: 20, 1: 20, 2: 20}
