"""Column functions and joins on fixtures: edges, nulls and empty values."""

from pyspark.sql import functions as F

from quadrille.functions import grid, text
from quadrille.operators import pyramid, relations


def test_boxes_are_half_open_unless_closed(spark):
    df = spark.createDataFrame([(0.0, 5.0), (1.0, 5.0), (2.0, 5.0), (1.0, None), (-0.5, 5.0), (1.0, 9.0)], "x double, y double")
    box = {"x": (0.0, 2.0), "y": (5.0, 9.0)}
    assert sorted(r.x for r in pyramid.clipped_points(df, box).collect()) == [0.0, 1.0]
    assert sorted(tuple(r) for r in pyramid.clipped_points(df, box, closed=True).collect()) == [(0.0, 5.0), (1.0, 5.0), (1.0, 9.0), (2.0, 5.0)]
    assert pyramid.clipped_points(df.limit(0), box).count() == 0


def test_fate_of_intervals_and_boxes(spark):
    rows = [(0.0, 0.5, "outside"), (0.0, 1.0, "across"), (1.0, 1.5, "inside"), (1.0, 2.0, "across"), (2.0, 3.0, "outside"), (0.0, 9.0, "across")]
    df = spark.createDataFrame(rows, "a double, b double, want string").withColumn("got", grid.interval_fate(F.col("a"), F.col("b"), 1.0, 2.0))
    assert all(r.got == r.want for r in df.collect())
    both = lambda p, q: spark.range(1).select(grid.box_fate(F.lit(p), F.lit(q)).alias("f")).first().f
    assert both("inside", "inside") == "inside" and both("inside", "across") == "across" and both("across", "outside") == "outside"


def test_annotations_that_hold_text(spark):
    bodies = spark.createDataFrame([(1,), (2,), (3,), (None,)], "k int")
    notes = spark.createDataFrame([(1, "a", None, 5), (2, " ", "", None), (None, "x", "y", 1), (9, "z", "z", 9)], "k int, type string, side string, n int")
    rows = {r.k: r.annotations for r in relations.annotated(bodies, notes, "k", ["type", "side", "n"]).collect()}
    assert rows == {1: {"type": "a", "n": "5"}, 2: {}, 3: {}, None: {}}
    assert relations.annotated(bodies, notes.limit(0), "k", ["type"]).where("size(annotations) = 0").count() == 4


def test_annotations_of_several_rows_give_a_row_each(spark):
    notes = spark.createDataFrame([(1, "a"), (1, "b")], "k int, type string")
    found = relations.annotated(spark.createDataFrame([(1,)], "k int"), notes, "k", ["type"])
    assert sorted(r.annotations["type"] for r in found.collect()) == ["a", "b"]


def test_dates(spark):
    names = spark.createDataFrame([("2024-02-29", True), ("2024-2-29", False), ("a2024-02-29", False), ("", False)], "name string, want boolean")
    assert all(r.got == r.want for r in names.withColumn("got", text.is_dated(F.col("name"))).collect())
    days = spark.createDataFrame([("1970-01-01", "0"), ("1969-12-31", "-86400000"), ("2024-02-29", "1709164800000"), (None, None)], "day string, want string")
    assert all(r.got == r.want for r in days.withColumn("got", text.epoch_millis(F.col("day").cast("date"))).collect())
