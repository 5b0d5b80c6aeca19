"""Queries do the whole job: nothing of the input is left out."""

import __spark_entry__ as entry
from quadrille.operators import tags
from quadrille.plans import queries as q

TABLES = "/root/testdata/sf0.001"


def test_every_tree_has_tubes(spark):
    want = {str(r[0]) for r in spark.read.parquet(f"{TABLES}/lineitem.parquet").select("l_orderkey").distinct().collect()}
    assert {r["name"] for r in entry.queries()["tube_meshes"](spark, TABLES).collect()} == want


def test_every_order_has_a_morton_rank(spark):
    got = entry.queries()["morton_order_rank"](spark, TABLES).collect()
    n = spark.read.parquet(f"{TABLES}/orders.parquet").count()
    assert sorted(r["rank"] for r in got) == list(range(1, n + 1))


def test_every_point_is_wrapped(spark):
    got = entry.queries()["world_wrap"](spark, TABLES)
    assert got.count() == 3 * q.points(spark, TABLES).count()


def test_every_vertex_has_an_index(spark):
    got = entry.queries()["vertex_dedup"](spark, TABLES)
    assert got.count() == q.order_points(spark, TABLES).count()


def test_all_values_of_a_property_are_listed(spark):
    rows = spark.createDataFrame([("p", f"v{i:03}") for i in range(100)], "name string, value string")
    assert tags.property_ranges(rows).first()["enums"] == ",".join(f"v{i:03}" for i in range(100))


def test_one_changed_row_shows(spark):
    from quadrille.operators import facets

    a = spark.createDataFrame([(1, 0, 2.0), (1, 0, 2.0), (2, 1, 3.0)], "fid long, zoom int, x double")
    b = spark.createDataFrame([(1, 0, 2.0), (2, 1, 3.5)], "fid long, zoom int, x double")
    got = {r.zoom: (r.missing, r.added) for r in facets.geometry_changes(a, b, ["fid", "zoom", "x"], "zoom").collect()}
    assert got == {0: (1, 0), 1: (1, 1)} and {(r.missing, r.added) for r in facets.geometry_changes(a, a, ["fid", "zoom", "x"], "zoom").collect()} == {(0, 0)}


def test_proofs_have_rows(spark):
    for name in ("anti_unmatched", "name_search", "strip_difference"):
        assert entry.queries()[name](spark, TABLES).count() > 0
