import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.functions import flat, grid, text
from quadrille.operators import facets, fragments, pyramid, relations, sequences, tags, tiles


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column.alias("x")).first()["x"]


def test_morton_and_ids(spark):
    rows = [(0, 0, 0, 0), (1, 0, 0, 1), (0, 1, 0, 2), (0, 0, 1, 4), (1, 1, 1, 7)]
    df = spark.createDataFrame(rows, "x int, y int, z int, want long")
    m = grid.morton3(F.col("x"), F.col("y"), F.col("z"))
    assert all(r.a == r.want == r.b for r in df.select("want", m.alias("a"), grid.morton3(F.col("x"), F.col("y"), F.col("z"), bits=21).alias("b")).collect())
    ids = spark.range(1024).select(grid.tile_id3(F.lit(3), F.col("id"), F.col("id"), F.col("id")).alias("i"), grid.tile_id3(F.lit(4), F.col("id"), F.col("id"), F.col("id")).alias("j"))
    assert ids.select("i").union(ids.select("j")).distinct().count() == 2048
    big = (1 << 21) - 1
    assert one(spark, grid.morton3(F.lit(big), F.lit(0), F.lit(0), bits=21)) == sum(1 << 3 * i for i in range(21))


def test_points_buffers_and_edges_against_the_interval_rule(spark):
    rng = random.Random(1)
    values = [rng.choice([rng.random(), rng.randrange(17) / 16, -0.1, 1.05, 1.0]) for _ in range(300)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "fid long, v double")
    for buffer in (0.0, 64 / 4096, 0.3):
        own = df.select("fid", F.col("v").alias("min_x"), F.col("v").alias("max_x"))
        got = {(r.fid, r.zoom, r.tile_x) for r in pyramid.box_tiles(own, 4, buffer=buffer, axes=(("min_x", "max_x", "tile_x"),)).collect()}
        want = set()
        for i, v in enumerate(values):
            want.add((i, 0, 0))
            for z in range(1, 5):
                n = 2**z
                want |= {(i, z, k) for k in range(n) if k / n - buffer / n <= v < (k + 1) / n + buffer / n + (1e-10 if k == n - 1 else 0)}
        assert got == want


def test_points_at_edges(spark):
    df = spark.createDataFrame([(0, 0.25, 0.75), (1, 1.0, 1.0), (2, 1.2, 0.5)], "fid long, nx double, ny double")
    got = {(r.fid, r.zoom): (r.tile_x, r.tile_y) for r in pyramid.point_tiles(df, 2).collect()}
    assert got == {(0, 0): (0, 0), (0, 1): (0, 1), (0, 2): (1, 3), (1, 0): (0, 0), (1, 1): (1, 1), (1, 2): (3, 3), (2, 0): (0, 0)}


def test_degenerate_bounds_and_scale(spark):
    df = spark.createDataFrame([(5.0, 5.0), (5.0, None)], "x double, y double")
    assert [(r.nx, r.ny) for r in pyramid.normalised(df).collect()] == [(0.0, 0.0)]
    box = spark.createDataFrame([(10.0, 110.0, 20.0, 220.0)], "x_min double, x_max double, y_min double, y_max double")
    assert pyramid.normalised(spark.createDataFrame([(60.0, 120.0)], "x double, y double"), box).select("nx", "ny").first() == (0.5, 0.5)
    assert pyramid.bounds(df.limit(0), "x", "y").first() == (0.0, 1.0, 0.0, 1.0)


def test_rounding_rules(spark):
    df = spark.createDataFrame([(0.5 / 4096,), (1.5 / 4096,), (2.5 / 4096,)], "n double")
    up = [r[0] for r in df.select(grid.tile_integer(F.col("n"), F.lit(0), F.lit(0))).collect()]
    even = [r[0] for r in df.select(grid.tile_integer(F.col("n"), F.lit(0), F.lit(0), half_even=True)).collect()]
    assert (up, even) == ([1, 2, 3], [0, 2, 2])
    assert one(spark, grid.zigzag(F.lit(-2))) == 3 and one(spark, grid.unzigzag(F.lit(3).cast("long"))) == -2
    assert one(spark, grid.command(7, F.lit(1))) == 15


def test_schedules(spark):
    z = F.lit(3)
    share = 50 / (8 * 4096)
    want = {"default": share**2, "linear": share, "constant": (50 / 4096) ** 2, "slow_exponential": share**1.5, "logarithmic": 50 / (np.log(5) * 4096), "step": (4 * share) ** 2}
    for name, value in want.items():
        assert one(spark, grid.tolerance(name, z)) == pytest.approx(value)
    assert one(spark, grid.tolerance(lambda zoom, o: zoom * o["tolerance"], z, tolerance=2)) == 6


def test_mercator_wrap_and_screen_error(spark):
    assert one(spark, grid.mercator_x(F.lit(0.0))) == 0.5 and one(spark, grid.mercator_y(F.lit(0.0))) == pytest.approx(0.5)
    assert one(spark, grid.mercator_y(F.lit(90.0))) == 0 and one(spark, grid.mercator_y(F.lit(-90.0))) == 1
    assert one(spark, pyramid.screen_space_zoom(F.lit(10.0), 160.0, 1.0, 2.0, 8)) == 3
    df = spark.createDataFrame([(0.5,)], "nx double")
    assert sorted(r.nx for r in pyramid.wrapped(df).collect()) == [-0.5, 0.5, 1.5]


def test_facet_policy(spark):
    df = spark.createDataFrame([("cell_id", 200, False), ("cell_type", 3, False), ("m_CD8", 5000, True), ("area", 5000, True), ("n_genes", 5000, True)], "name string, n_distinct long, numeric boolean")
    policy = tags.FacetPolicy.from_config({"include": ["m_*"], "exclude": ["area"], "keep_inline": ["cell_type"], "threshold": 64, "other": 1})
    got = {r.name for r in tags.facet_keys(df, policy).where("facet").collect()}
    assert got == {"m_CD8", "n_genes"}
    assert [bool(re.search(tags.glob(p), "m_x.y")) for p in ("m_*", "m?x.y", "[lm]_*", "[!m]*", "m_x")] == [True, True, True, False, False]


def test_tags(spark):
    df = spark.createDataFrame([(1, '{"a":1,"b":[1],"c":null,"d":"x","e":{"f":1}}', 2)], "id int, j string, zoom int")
    t = tags.scalar_tags(F.col("j"))
    got = df.select(t.alias("t"), tags.zoom_gate(t, F.col("zoom"), {"a": 3, "d": 1}).alias("g"), tags.serialised(tags.merge_maps(t, F.create_map(F.lit("a"), F.lit("9")))).alias("s"), tags.renamed(t, "a", "A").alias("r"), tags.zoom_gate(t, F.col("zoom"), {}).alias("n")).first()
    assert (got.t, got.g, got.s, got.r, got.n) == ({"a": "1", "d": "x"}, {"d": "x"}, "a=9;d=x", {"A": "1", "d": "x"}, {"a": "1", "d": "x"})
    assert tags.pick_alias(["X", "Cluster"], ["cluster", "x"]) == "Cluster"
    with pytest.raises(KeyError):
        tags.pick_alias(["a"], ["b"])


def test_filters(spark):
    df = spark.createDataFrame([(1, "5", "Ab"), (2, "x", None), (3, "NaN", "ab"), (4, "50", "")], "id int, v string, n string")
    ids = lambda d: sorted(r.id for r in d.collect())
    assert ids(tags.numeric_filter(df, "v", 1, 10)) == [1] and ids(tags.numeric_filter(df, "v", low=6)) == [4]
    assert ids(tags.category_filter(df, "n", [""])) == [2, 4] and ids(tags.category_filter(df, "n", [])) == [1, 2, 3, 4]
    assert ids(tags.name_search(df, "n", "AB")) == [1, 3]
    q = spark.createDataFrame([("NegControl_1", 40.0), ("GeneA", 10.0), ("GeneA", 20.0), ("blank", 30.0)], "g string, qv double")
    assert tags.quality_filter(q, "g", "qv").count() == 1


def test_facet_stores(spark, tmp_path):
    coo = spark.createDataFrame([(2, 1, 5), (4, 1, 3), (1, 2, 1), (2, 3, 9)], "row long, col long, count long")
    genes = spark.createDataFrame([(1, "GENE_C"), (2, "GENE_A"), (3, "GENE_D"), (4, "GENE_B")], "position long, gene string")
    cells = spark.createDataFrame([(1, "1"), (2, "2"), (3, "3")], "position long, cell_id string")
    long = facets.expression(coo, genes, cells)
    assert {r.cell_id: r.total_counts for r in facets.totals(long).collect()} == {"1": 8, "2": 1, "3": 9}
    dense = {r.cell_id: r.vector for r in facets.dense_vectors(long, ["GENE_C", "GENE_A", "GENE_D", "GENE_B"], cells).collect()}
    assert dense == {"1": [0, 5, 0, 3], "2": [1, 0, 0, 0], "3": [0, 9, 0, 0]}
    facets.write_long(long, f"{tmp_path}/long", 1)
    rows = [(r.gene, r.cell_id) for r in spark.read.parquet(f"{tmp_path}/long").collect()]
    assert rows == [("GENE_A", "1"), ("GENE_A", "3"), ("GENE_B", "1"), ("GENE_C", "2")]
    plan = facets.gene_lookup(spark.read.parquet(f"{tmp_path}/long"), cells, "GENE_A")
    assert {r.cell_id: r["count"] for r in plan.collect()} == {"1": 5, "2": 0, "3": 9}
    assert "EqualTo(gene,GENE_A)" in plan._jdf.queryExecution().toString()
    facets.write_wide(facets.wide(long, ["GENE_A", "GENE_B"]), f"{tmp_path}/wide")
    marker = facets.marker_lookup(spark.read.parquet(f"{tmp_path}/wide"), cells, "GENE_B")
    assert {r.cell_id: r.value for r in marker.collect()} == {"1": 3.0, "2": None, "3": None}
    assert "ReadSchema: struct<cell_id:string,GENE_B:float>" in marker._jdf.queryExecution().toString()


def test_facet_migration_keeps_geometry(spark):
    t = [(z, 0, 0, i, bytes([i]), {"cell_id": f"c{i}", "g_A": str(i), "m_x": "1"}) for z in (0, 1) for i in range(3)]
    df = spark.createDataFrame(t, "zoom int, tile_x long, tile_y long, feature_id long, positions binary, tags map<string,string>")
    lean, store = facets.migrate(df, ["g_A"])
    assert {r.cell_id: r.g_A for r in store.collect()} == {"c0": 0.0, "c1": 1.0, "c2": 2.0}
    assert all(set(r.tags) == {"cell_id", "m_x"} for r in lean.collect())
    assert facets.same_geometry(df, lean, ["zoom", "feature_id", "positions"]) and not facets.same_geometry(df, lean.limit(5), ["positions"])


@pytest.mark.parametrize("sizes,size,batches,mixed", [((8, 8, 8), 8, 3, 0), ((4, 4, 8), 8, 2, 1), ((3, 2), 4, 1, 1)])
def test_batches(spark, sizes, size, batches, mixed):
    df = spark.createDataFrame([(t, i) for t, n in enumerate(sizes) for i in range(n)], "tile int, i int")
    rows = sequences.batches(df, ["tile"], ["i"], size).collect()
    by = {}
    for r in rows:
        by.setdefault(r.batch, []).append(r)
    assert len(by) == batches and all(sorted(r.slot for r in b) == list(range(size)) for b in by.values())
    assert sum(len({r.tile for r in b}) > 1 for b in by.values()) == mixed


def test_sequences(spark):
    df = spark.createDataFrame([(g, i, i * i) for g in "ab" for i in range(50)], "g string, i int, v int").repartition(7)
    assert [r.fid for r in sequences.dense_ids(df, ["g", "i"]).orderBy("g", "i").collect()] == list(range(100))
    assert {(r.g, r.i): r.delta for r in sequences.deltas(df, ["g"], "i", "v").collect()}[("a", 5)] == 9
    assert sequences.first_n(df, "i", 3).count() == 6 and sequences.sampled(df, 5, "i", 1).count() == 5
    parts = {}
    for r in sequences.split(df, "g", [F.col("i")]).collect():
        parts[r.split] = parts.get(r.split, 0) + 1
    assert parts == {"train": 80, "val": 10, "test": 10}
    boxes = spark.createDataFrame([(i, 2.0, 1.0) for i in range(5)], "i int, w double, h double")
    assert [(r.dx, r.dy) for r in sequences.laid_out(boxes, "i", "w", "h", 7.0, 1.0).orderBy("i").collect()] == [(0.0, 0.0), (3.0, 0.0), (0.0, 2.0), (3.0, 2.0), (0.0, 4.0)]
    with pytest.raises(ValueError):
        sequences.laid_out(boxes, "i", "w", "h", 1.0, 0.0)


def test_relations(spark):
    terms = spark.createDataFrame([(985, "Primary motor area", "MOp"), (500, "Motor", "MO")], "id long, name string, acronym string")
    stems = spark.createDataFrame([("Primary motor area",), ("MOp",), ("region_985",), ("unknown",)], "stem string")
    got = {r.stem: r.term_id for r in relations.ontology_match(stems, terms).collect()}
    assert got == {"Primary motor area": 985, "MOp": 985, "region_985": 985, "unknown": None}
    rows = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c"), (2, "c"), (2, "a")], "k int, v string")
    assert {r.k: r.v for r in relations.majority(rows, "k", "v").collect()} == {1: "a", 2: "c"}


def test_text(spark):
    df = spark.createDataFrame([("x/3/1/2.pbf", "zoom=4/tile_x=7", "/d/a.b.CNG.swc", '{"A.B":5,"C":-2.5}')], "p string, h string, s string, j string")
    z, x, y = text.parse_tile_path(F.col("p"))
    got = df.select(z, x, y, *text.parse_hive_path(F.col("h"), ["zoom", "tile_x", "tile_y"]), text.neuron_name(F.col("s")), text.inline_lookup(F.col("j"), "A.B"), text.inline_lookup(F.col("j"), "C"), text.inline_lookup(F.col("j"), "D"), text.label(F.lit("a_bc")), text.hex_colour(F.lit(1), F.lit(171), F.lit(255))).first()
    assert tuple(got) == (3, 1, 2, 4, 7, None, "a.b", 5.0, -2.5, 0.0, "A Bc", "#01abff")
    assert one(spark, text.rgb(F.lit("#1F9D5A"))) == [31, 157, 90] and text.url_state({"a": 1}, "u") == "u#!%7B%22a%22%3A1%7D"
    assert one(spark, flat.delta_decoded(flat.delta_encoded(F.array(*[F.lit(v).cast("long") for v in (3, 5, 2)])))) == [3, 5, 2]


def test_splat(spark):
    p = spark.createDataFrame([(0.0, 0.0, 1, "a"), (10.0, 10.0, 2, "b"), (-10.0, -10.0, 3, "c"), (0.0, 0.0, 4, "d")], "x double, y double, o int, c string")
    assert {(r.px, r.py): r.c for r in tiles.splat(p, -10.0, 10.0, 5, "o", "c").collect()} == {(2, 2): "d", (4, 4): "b", (0, 0): "c"}


def test_tile_rows(spark):
    df = spark.createDataFrame([(0, 2, [[[0.1, 0.1], [0.5, 0.5], [0.9, 0.1]]], {"k": "v"}), (1, 3, [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0]], [[0.2, 0.2], [0.4, 0.2], [0.4, 0.4]]], {}), (2, 1, [[[0.5, 0.5]]], {})], "fid long, kind tinyint, parts array<array<array<double>>>, tags map<string,string>")
    frags = fragments.fragments(df, (0.0, 0.0, 1.0, 1.0), 1, simplify=False)
    assert {(r.zoom, r.tile_x, r.tile_y) for r in frags.where("feature_id = 1").collect()} == {(0, 0, 0), (1, 0, 0), (1, 0, 1), (1, 1, 0), (1, 1, 1)}
    rows = {r.feature_id: r for r in fragments.encoded(frags.where("zoom = 0"), (0.0, 0.0, 1.0, 1.0)).collect()}
    assert np.frombuffer(rows[0].indices, "<u4").tolist() == [0, 1, 1, 2] and rows[0].ring_lengths == []
    assert rows[1].ring_lengths == [4, 3] and len(rows[1].positions) == 56
    world = fragments.encoded(fragments.fragments(df.where("fid = 2").withColumn("parts", F.array(F.array(F.array(F.lit(50.0), F.lit(50.0))))), (0.0, 0.0, 100.0, 100.0), 0), (0.0, 0.0, 100.0, 100.0)).first()
    assert np.frombuffer(world.positions, "<f4").tolist() == [50.0, 50.0] and world.indices == b""


def test_expression_gate(spark):
    df = spark.createDataFrame([(1, 3, [[[0.1, 0.1], [0.15, 0.1], [0.15, 0.15], [0.1, 0.15]]], {"total_counts": "42", "expression": "{}"})], "fid long, kind tinyint, parts array<array<array<double>>>, tags map<string,string>")
    got = {r.zoom: set(r.tags) for r in fragments.fragments(df, (0.0, 0.0, 1.0, 1.0), 4, gate={"expression": 3}).collect()}
    assert got == {z: {"total_counts"} | ({"expression"} if z >= 3 else set()) for z in range(5)}


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_dense_ids_of_many_rows_with_payload(spark, adaptive):
    """More rows than a range partitioner samples, an order with ties, a value that a third of the rows hold."""
    n = 1_000_000
    key = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.pmod(F.xxhash64("id"), F.lit(50_000)))
    df = spark.range(n, numPartitions=16).select(key.alias("k"), F.col("id").alias("payload"), F.repeat(F.lit("x"), 20).alias("wide"))
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        got = sequences.dense_ids(df, ["k"])
        row = got.agg(F.count(F.lit(1)), F.countDistinct("fid"), F.min("fid"), F.max("fid"), F.countDistinct("payload")).first()
        assert tuple(row) == (n, n, 0, n - 1, n)
        assert got.select("k", "payload").exceptAll(df.select("k", "payload")).isEmpty()
        spans = got.groupBy("k").agg(F.min("fid").alias("a"), F.max("fid").alias("b"), F.count(F.lit(1)).alias("c"))
        assert spans.where("b - a + 1 <> c").isEmpty()
        low = spans.orderBy("a").select("k").limit(100).collect()
        assert [r.k for r in low] == sorted(r.k for r in low)
        totals = sequences.running_totals(spans.select("k", "c", "a"), ["k"], "c")
        assert totals.where("before <> a").isEmpty()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)


def test_callers_of_dense_ids_keep_all_rows(spark, tmp_path):
    from quadrille.functions import mesh
    from quadrille.sources import features

    n = 300_000
    rows = spark.range(n, numPartitions=8)
    dup = rows.select(F.when(F.col("id") % 2 == 0, F.lit(3)).otherwise(F.col("id")).alias("k"), "id", F.repeat(F.lit("y"), 30).alias("wide"))
    uid = sequences.unique_ids(dup, "k", ["id"])
    assert tuple(uid.agg(F.count(F.lit(1)), F.countDistinct("uid"), F.countDistinct("id")).first()) == (n, n, n)
    laid = sequences.laid_out(rows.select("id", F.lit(1.0).alias("w"), F.lit(1.0).alias("h")), "id", "w", "h", 999.0, 1.0)
    assert tuple(laid.agg(F.count(F.lit(1)), F.countDistinct("dx", "dy")).first()) == (n, n)
    points = rows.select("id", *[F.pmod(F.xxhash64("id", F.lit(i)), F.lit(60)).alias(c) for i, c in enumerate("xyz")])
    index = mesh.vertex_index(points, ["x", "y", "z"], "id")
    row = index.agg(F.count(F.lit(1)), F.countDistinct("id"), F.countDistinct("idx"), F.max("idx"), F.countDistinct("x", "y", "z")).first()
    assert row[0] == row[1] == n and row[2] == row[3] + 1 == row[4]
    (tmp_path / "files").mkdir()
    for i in range(20):
        own = ",".join(f'{{"type": "Feature", "geometry": {{"type": "Point", "coordinates": [{k}, 1]}}, "properties": {{"n": {k}}}}}' for k in range(i, n, 20))
        (tmp_path / "files" / f"{i}.geojson").write_text(f'{{"type": "FeatureCollection", "features": [{own}]}}')
    found = features.geojson(spark, str(tmp_path / "files"))
    assert tuple(found.agg(F.count(F.lit(1)), F.countDistinct("fid"), F.max("fid")).first()) == (n, n, n - 1)
