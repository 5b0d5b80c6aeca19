"""Registered queries of column functions and small joins: axes, boxes, paths, names, colours, tags, annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import flat, grid, text
from ..operators import facets, pyramid, relations, tags
from . import queries as q

#: A box whose bounds many points lie on, as quantities are whole numbers.
BOX = {"x": (20000.0, 60000.0), "y": (10.0, 30.0)}


def paths(spark, d) -> DataFrame:
    """id, path: the vertices of an order, in order."""
    return q.vertices(spark, d).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "x", "y"))).alias("path"))


def _positions(path):
    return F.array_join(F.transform(path, lambda p: p["pos"].cast("string")), " ")


# --- axes and boxes -----------------------------------------------------------------------------------------------


@q.query("""WITH p AS (SELECT p_partkey AS k, p_retailprice AS x, CAST(p_size AS DOUBLE) AS y, CAST(p_partkey * 7 % 97 AS DOUBLE) AS z FROM part),
b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM p)
SELECT k, CAST(floor((x - x0) / (x1 - x0) * 1000000) AS BIGINT) AS ix, CAST(floor((y - y0) / (y1 - y0) * 1000000) AS BIGINT) AS iy,
CAST(floor((z - z0) / (z1 - z0) * 1000000) AS BIGINT) AS iz, round(x, 6) AS back_x, round(y, 6) AS back_y, round(z, 6) AS back_z FROM p, b""")
def project_3d(spark, d):
    """Three axes to the unit cube and back."""
    p = q.Tables(spark, d).part.select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("x"), F.col("p_size").cast("double").alias("y"), (F.col("p_partkey") * 7 % 97).cast("double").alias("z"))
    df = p.crossJoin(F.broadcast(pyramid.bounds(p, "x", "y", "z")))  # one row
    unit = {a: grid.project(F.col(a), F.col(f"{a}_min"), F.col(f"{a}_max")) for a in "xyz"}
    whole = [F.floor(n * 1000000).cast("long").alias(f"i{a}") for a, n in unit.items()]
    back = [F.round(grid.unproject(n, F.col(f"{a}_min"), F.col(f"{a}_max")), 6).alias(f"back_{a}") for a, n in unit.items()]
    return df.select("k", *whole, *back)


@q.query("""WITH p AS (SELECT l_orderkey * 8 + l_linenumber AS fid, l_extendedprice * 0.2125 AS x, l_quantity * 0.2125 AS y FROM lineitem WHERE l_extendedprice IS NOT NULL AND l_quantity IS NOT NULL),
b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p)
SELECT fid, x, y, CAST(floor((x - x0) / (x1 - x0) * 1000000) AS BIGINT) AS ix, CAST(floor((y - y0) / (y1 - y0) * 1000000) AS BIGINT) AS iy FROM p, b""")
def scaled_points(spark, d):
    """Coordinates scaled before they are projected."""
    raw = q.Tables(spark, d).lineitem.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("fid"), F.col("l_extendedprice").alias("x"), F.col("l_quantity").cast("double").alias("y"))
    df = pyramid.normalised(raw, scale=0.2125)
    return df.select("fid", "x", "y", F.floor(F.col("nx") * 1000000).cast("long").alias("ix"), F.floor(F.col("ny") * 1000000).cast("long").alias("iy"))


@q.query("""SELECT p_partkey AS k, CAST(floor(((p_partkey % 360 - 180) / 360.0 + 0.5) * 1000000 + 0.5) AS BIGINT) AS mx,
CAST(floor((0.5 - 0.25 * ln((1 + sin(radians(p_size * 3 - 75))) / (1 - sin(radians(p_size * 3 - 75)))) / pi()) * 1000000 + 0.5) AS BIGINT) AS my FROM part""")
def mercator(spark, d):
    """Longitude and latitude to Web Mercator's unit square, in millionths."""
    micro = lambda n: F.floor(n * 1000000 + 0.5).cast("long")
    lon, lat = F.col("p_partkey") % 360 - 180, F.col("p_size") * 3 - 75
    return q.Tables(spark, d).part.select(F.col("p_partkey").alias("k"), micro(grid.mercator_x(lon)).alias("mx"), micro(grid.mercator_y(lat)).alias("my"))


_RING_BOXES = f"""WITH {q._VERTICES}, r AS (SELECT id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM v WHERE n >= 3 GROUP BY id)"""


def _ring_boxes(spark, d) -> DataFrame:
    boxes = [f("x" if a == "x" else "y").cast("double").alias(a + str(i)) for a in "xy" for i, f in enumerate((F.min, F.max))]
    return q.vertices(spark, d).groupBy("id").agg(F.count(F.lit(1)).alias("n"), *boxes).where("n >= 3")


@q.query(f"""{_RING_BOXES}, b AS (SELECT min(x0) AS x0, max(x1) AS x1, min(y0) AS y0, max(y1) AS y1, greatest(max(x1) - min(x0), max(y1) - min(y0)) AS side FROM r)
SELECT CAST(x0 AS DOUBLE) AS x_min, CAST(y0 AS DOUBLE) AS y_min, CAST(x0 + side AS DOUBLE) AS x_max, CAST(y0 + side AS DOUBLE) AS y_max FROM b""")
def square_bounds(spark, d):
    """Bounds of polygons alone, widened to a square."""
    r = _ring_boxes(spark, d)
    return pyramid.squared(pyramid.bounds_of((r, "x0", "y0"), (r, "x1", "y1")))


@q.query(f"""{_RING_BOXES} SELECT id, CASE WHEN x0 >= 60000 OR x1 < 20000 OR y0 >= 30 OR y1 < 10 THEN 'outside'
WHEN x0 >= 20000 AND x1 < 60000 AND y0 >= 10 AND y1 < 30 THEN 'inside' ELSE 'across' END AS fate FROM r""")
def box_accept_reject(spark, d):
    """Which rings need clipping at all."""
    fates = [grid.interval_fate(F.col(f"{a}0"), F.col(f"{a}1"), *BOX[a]) for a in "xy"]
    return _ring_boxes(spark, d).select("id", grid.box_fate(*fates).alias("fate"))


_BOX_POINTS = "SELECT l_orderkey * 8 + l_linenumber AS fid, l_extendedprice AS x, l_quantity AS y FROM lineitem WHERE l_extendedprice >= 20000 AND l_quantity >= 10"


def _line_points(spark, d) -> DataFrame:
    return q.Tables(spark, d).lineitem.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("fid"), F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("y"))


@q.query(f"SELECT * FROM ({_BOX_POINTS}) WHERE x < 60000 AND y < 30")
def clip_points(spark, d):
    """Points in a half-open box."""
    return pyramid.clipped_points(_line_points(spark, d), BOX)


@q.query(f"SELECT * FROM ({_BOX_POINTS}) WHERE x <= 60000 AND y <= 30")
def clip_points_closed(spark, d):
    """Points in a box with its upper bounds."""
    return pyramid.clipped_points(_line_points(spark, d), BOX, closed=True)


@q.query("SELECT o_orderkey AS k, CAST(greatest(0, least(8, ceil(log2(1048576.0 / greatest(o_totalprice, 1e-9))))) AS INT) AS zoom FROM orders")
def screen_space_zoom(spark, d):
    """The first zoom whose error on the screen is small enough at a distance."""
    zoom = pyramid.screen_space_zoom(F.col("o_totalprice"), 4096.0, 512.0, 2.0, 8)
    return q.Tables(spark, d).orders.select(F.col("o_orderkey").alias("k"), zoom.alias("zoom"))


# --- vertices -----------------------------------------------------------------------------------------------------


@q.query(f"""WITH {q._VERTICES}, r AS (SELECT DISTINCT id, n, range AS ring FROM v, range(0, 2))
SELECT r.id, CAST(r.ring AS INT) AS ring, coalesce(string_agg(CAST(v.pos AS VARCHAR), ' ' ORDER BY v.pos), '') AS vertices
FROM r LEFT JOIN v ON v.id = r.id AND (v.pos > r.n // 2) = (r.ring = 1) GROUP BY r.id, r.ring""")
def ring_split(spark, d):
    """Vertices cut into rings by their lengths; a ring of no vertices stays a ring."""
    half = F.floor(F.size("path") / 2).cast("int")
    rings = paths(spark, d).select("id", F.posexplode(flat.split_rings(F.col("path"), F.array(half, F.size("path") - half))).alias("ring", "part"))
    return rings.select("id", "ring", _positions(F.col("part")).alias("vertices"))


@q.query(f"""WITH {q._VERTICES}, r AS (SELECT id, n, arg_min((x, y), pos) = arg_max((x, y), pos) AS shut FROM v GROUP BY id, n)
SELECT id, n + CASE WHEN shut THEN 0 ELSE 1 END = 4 AS tin FROM r""")
def tin_detection(spark, d):
    """Whether a closed ring is a triangle."""
    corners = F.transform("path", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    return paths(spark, d).select("id", flat.is_tin(F.array(flat.closed(corners))).alias("tin"))


@q.query(f"""WITH {q._VERTICES} SELECT id, string_agg(CAST(pos AS VARCHAR), ' ' ORDER BY pos) AS vertices FROM v
WHERE n <= 3 OR pos IN (1, CAST(floor((n - 1) / 2.0 + 0.5) AS BIGINT) + 1, n) GROUP BY id""")
def path_thinning(spark, d):
    """At most three vertices of a path, both ends among them."""
    return paths(spark, d).select("id", _positions(flat.thinned(F.col("path"), 3)).alias("vertices"))


# --- names, paths, colours ----------------------------------------------------------------------------------------


@q.query(f"""WITH {q._POINTS}, u AS (SELECT DISTINCT zoom, tile_x, tile_y FROM t)
SELECT zoom, tile_x, CASE WHEN tile_y % 2 = 0 THEN CAST(tile_y AS VARCHAR) ELSE 'none' END AS tile_y, tile_y AS was_y FROM u""")
def hive_path_parse(spark, d):
    """Numbers of partition folders; one that holds no number gives null."""
    u = q.tiled(spark, d).select("zoom", "tile_x", "tile_y").distinct()
    y = F.concat(F.when(F.col("tile_y") % 2 == 0, "").otherwise("no"), F.col("tile_y").cast("string"))
    path = F.concat(F.lit("tiles/zoom="), F.col("zoom").cast("string"), F.lit("/tile_x="), F.col("tile_x").cast("string"), F.lit("/tile_y="), y, F.lit("/part-0.parquet"))
    zoom, x, y = text.parse_hive_path(path, ["zoom", "tile_x", "tile_y"])
    return u.select(zoom.alias("zoom"), x.cast("long").alias("tile_x"), F.coalesce(y.cast("string"), F.lit("none")).alias("tile_y"), F.col("tile_y").alias("was_y"))


@q.query("SELECT s_suppkey AS k, s_name AS name FROM supplier")
def neuron_names(spark, d):
    """Names of neurons from paths with and without the mark of a standardised file."""
    end = F.element_at(F.array(F.lit(".CNG.swc"), F.lit(".cng.swc"), F.lit(".swc")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    return q.Tables(spark, d).supplier.select(F.col("s_suppkey").alias("k"), text.neuron_name(F.concat(F.lit("data/a.b/"), F.col("s_name"), end)).alias("name"))


@q.query("SELECT p_partkey AS k, array_to_string([upper(w[1]) || lower(w[2:]) for w in string_split(p_type, ' ')], ' ') AS label FROM part")
def label_formatting(spark, d):
    name = F.replace(F.lower("p_type"), F.lit(" "), F.lit("_"))
    return q.Tables(spark, d).part.select(F.col("p_partkey").alias("k"), text.label(name).alias("label"))


@q.query("""SELECT p_partkey AS k, printf('#%02x%02x%02x', p_partkey % 256, p_partkey * 7 % 256, p_size) AS colour,
CAST(p_partkey % 256 AS INT) AS r, CAST(p_partkey * 7 % 256 AS INT) AS g, CAST(p_size AS INT) AS b FROM part""")
def colour_roundtrip(spark, d):
    """Three numbers to #rrggbb and back."""
    colour = text.hex_colour(F.col("p_partkey") % 256, F.col("p_partkey") * 7 % 256, F.col("p_size"))
    df = q.Tables(spark, d).part.select(F.col("p_partkey").alias("k"), colour.alias("colour"))
    return df.select("k", "colour", *[text.rgb(F.col("colour"))[i].alias(c) for i, c in enumerate("rgb")])


@q.query("""SELECT o_orderkey AS k, o_orderkey % 2 = 0 AS dated, CAST(epoch_ms(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)) AS VARCHAR) AS millis FROM orders""")
def dated_folders(spark, d):
    """Names of folders that are dates, and dates in milliseconds."""
    day = F.col("o_orderdate").cast("date")
    name = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "").otherwise("run-"), day.cast("string"))
    return q.Tables(spark, d).orders.select(F.col("o_orderkey").alias("k"), text.is_dated(name).alias("dated"), text.epoch_millis(day).alias("millis"))


# --- tags and joins -----------------------------------------------------------------------------------------------


@q.query("SELECT s_suppkey AS k, CAST(floor(s_acctbal) AS BIGINT) AS v FROM supplier")
def column_alias(spark, d):
    """Columns found by the first of several names, in any case."""
    s = q.Tables(spark, d).supplier
    k, v = tags.pick_alias(s.columns, ["cell_id", "S_SuppKey"]), tags.pick_alias(s.columns, ["S_ACCTBAL", "s_name"])
    return s.select(F.col(k).alias("k"), F.floor(F.col(v)).cast("long").alias("v"))


@q.query("SELECT p_partkey AS k, 'key=' || p_partkey || ';size=' || p_size AS tags FROM part")
def tag_stringify(spark, d):
    own = F.create_map(F.lit("size"), F.col("p_size").cast("long"), F.lit("key"), F.col("p_partkey"))
    return q.Tables(spark, d).part.select(F.col("p_partkey").alias("k"), tags.serialised(tags.stringified(own)).alias("tags"))


@q.query("""SELECT p_partkey AS k, 'brand=' || p_brand || CASE WHEN s_suppkey IS NULL THEN ';size=' || p_size ELSE ';name=' || s_name || ';size=S' END AS tags
FROM part LEFT JOIN supplier ON s_suppkey = p_partkey""")
def tags_at_write(spark, d):
    """A table of tags joined with features as they are written; its values win."""
    t = q.Tables(spark, d)
    own = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string"))
    more = t.supplier.select(F.col("s_suppkey").alias("k"), F.create_map(F.lit("name"), F.col("s_name"), F.lit("size"), F.lit("S")).alias("more"))
    return tags.attach_maps(t.part.select(F.col("p_partkey").alias("k"), own.alias("tags")), more, "k").select("k", tags.serialised(F.col("tags")).alias("tags"))


@q.query("""SELECT p_partkey AS k, concat_ws(';', CASE WHEN s_suppkey % 3 <> 0 THEN 'name=' || s_name END, 'nation=' || s_nationkey) AS annotations
FROM part LEFT JOIN supplier ON s_suppkey = p_partkey""")
def mesh_metadata(spark, d):
    """Bodies with their annotations that aren't empty."""
    t = q.Tables(spark, d)
    name = F.when(F.col("s_suppkey") % 3 == 0, " ").otherwise(F.col("s_name"))
    notes = t.supplier.select(F.col("s_suppkey").alias("k"), name.alias("name"), F.col("s_nationkey").alias("nation"), F.lit(None).cast("string").alias("side"))
    own = relations.annotated(t.part.select(F.col("p_partkey").alias("k")), notes, "k", ["name", "nation", "side"])
    return own.select("k", tags.serialised(F.col("annotations")).alias("annotations"))


@q.query(f"WITH {q._LONG} SELECT o_orderkey AS cell_id, r.count::FLOAT AS value FROM orders LEFT JOIN (SELECT * FROM f WHERE gene = 'R') r ON cell_id = o_orderkey")
def facet_marker_lookup(spark, d):
    """Every cell with one marker of the wide store; null where it has none."""
    return facets.marker_lookup(facets.wide(q._long(spark, d), ["A", "N", "R"]), q._cells(spark, d), "R")
