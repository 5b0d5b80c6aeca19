"""The registered queries of the spatial operators over the driver's tables, each with equivalent DuckDB SQL.

Stand-ins: lineitem rows are points (price, quantity) with genes (return flag) and vertex rows of rings (order, line);
events are transcripts with JSON tags; customers, parts and orders are cells and features; embeddings are flat
coordinate arrays; nations and regions form a tree. Results hold whole numbers, text and exactly reproducible doubles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import flat, grid, text
from ..operators import facets, pyramid, relations, sequences, tags, tiles

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import codecs, columns  # noqa: F401  register more queries

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import codecs, columns  # noqa: F401

    return dict(_SQL)


class Tables:
    """The driver's tables by name."""

    def __init__(self, spark: SparkSession, d: str):
        self._spark, self._d = spark, d

    def __getattr__(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._d}/{name}.parquet")


def points(spark, d) -> DataFrame:
    """fid, x, y, gene, nx, ny of line items."""
    t = Tables(spark, d).lineitem
    df = t.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("fid"), F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("y"), F.col("l_returnflag").alias("gene"))
    return pyramid.normalised(df)


_POINTS = """
b AS (SELECT min(l_extendedprice) AS x0, max(l_extendedprice) AS x1, min(l_quantity) AS y0, max(l_quantity) AS y1 FROM lineitem),
p AS (SELECT l_orderkey * 8 + l_linenumber AS fid, l_extendedprice AS x, l_quantity AS y, l_returnflag AS gene,
             (l_extendedprice - x0) / (x1 - x0) AS nx, (l_quantity - y0) / (y1 - y0) AS ny FROM lineitem, b),
z AS (SELECT CAST(range AS INT) AS zoom, CAST(pow(2, range) AS BIGINT) AS n FROM range(0, 5)),
t AS (SELECT p.*, z.zoom, z.n, least(CAST(floor(nx * n) AS BIGINT), n - 1) AS tile_x, least(CAST(floor(ny * n) AS BIGINT), n - 1) AS tile_y FROM p, z)
"""


_OPOINTS = _POINTS.replace("lineitem", "orders").replace("l_orderkey * 8 + l_linenumber", "o_orderkey").replace("l_extendedprice", "o_totalprice").replace("l_quantity", "CAST(o_custkey AS DOUBLE)").replace("l_returnflag", "o_orderstatus")


def order_points(spark, d) -> DataFrame:
    """The same of orders, whose ids are unique."""
    o = Tables(spark, d).orders
    return pyramid.normalised(o.select(F.col("o_orderkey").alias("fid"), F.col("o_totalprice").alias("x"), F.col("o_custkey").cast("double").alias("y"), F.col("o_orderstatus").alias("gene")))


def tiled(spark, d, top: int = 4) -> DataFrame:
    return pyramid.point_tiles(points(spark, d), top)


# --- projection and assignment ------------------------------------------------------------------------------------


@query(f"WITH {_POINTS} SELECT fid, CAST(floor(nx * 1000000) AS BIGINT) AS ix, CAST(floor(ny * 1000000) AS BIGINT) AS iy FROM p")
def project_normalize(spark, d):
    return points(spark, d).select("fid", F.floor(F.col("nx") * 1000000).cast("long").alias("ix"), F.floor(F.col("ny") * 1000000).cast("long").alias("iy"))


@query(f"WITH {_POINTS} SELECT fid, abs(nx * (x1 - x0) + x0 - x) < 1e-6 AS back FROM p, b")
def unproject_world(spark, d):
    df, box = points(spark, d), pyramid.bounds(Tables(spark, d).lineitem, "l_extendedprice", names=("x",))
    back = grid.unproject(F.col("nx"), F.col("x_min"), F.col("x_max"))
    return df.crossJoin(F.broadcast(box)).select("fid", (F.abs(back - F.col("x")) < 1e-6).alias("back"))


@query(f"WITH {_POINTS} SELECT fid, zoom, tile_x, tile_y FROM t")
def tile_assign_points(spark, d):
    return tiled(spark, d).select("fid", "zoom", "tile_x", "tile_y")


@query(f"""WITH {_POINTS},
g AS (SELECT z.zoom, z.n, i.range AS i FROM z, range(0, 16) i WHERE i.range < z.n)
SELECT p.fid, gx.zoom, gx.i AS tile_x, gy.i AS tile_y FROM p JOIN g gx ON gx.zoom = 0 OR (nx * gx.n >= gx.i - 0.25 AND nx * gx.n < gx.i + 1 + 0.25 + CASE WHEN gx.i = gx.n - 1 THEN 1e-10 ELSE 0 END)
JOIN g gy ON gy.zoom = gx.zoom AND (gy.zoom = 0 OR (ny * gy.n >= gy.i - 0.25 AND ny * gy.n < gy.i + 1 + 0.25 + CASE WHEN gy.i = gy.n - 1 THEN 1e-10 ELSE 0 END))""")
def tile_assign_buffered(spark, d):
    df = points(spark, d).select("fid", F.col("nx").alias("min_x"), F.col("nx").alias("max_x"), F.col("ny").alias("min_y"), F.col("ny").alias("max_y"))
    return pyramid.box_tiles(df, 4, buffer=0.25).select("fid", "zoom", "tile_x", "tile_y")


@query(f"""WITH {_POINTS} SELECT zoom, tile_x AS cell_x, tile_y AS cell_y, gene, count(*) AS n, CAST(sum(CAST(round(x * 100) AS BIGINT)) AS BIGINT) AS sum_x,
CAST(sum(CAST(y AS BIGINT)) AS BIGINT) AS sum_y FROM t GROUP BY ALL""")
def merge_lod(spark, d):
    df = pyramid.over_zooms(points(spark, d), 4).withColumn("x", F.round(F.col("x") * 100).cast("long")).withColumn("y", F.col("y").cast("long"))
    return pyramid.merged_points(df, "gene")


@query(f"""WITH {_POINTS}, g AS (SELECT zoom, tile_x AS cell_x, tile_y AS cell_y, CAST(y AS BIGINT) AS marker, count(*) AS n FROM t GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY zoom, cell_x, cell_y ORDER BY n DESC, marker) AS rank FROM g) WHERE rank <= 2""")
def merge_lod_topk(spark, d):
    df = pyramid.over_zooms(points(spark, d).withColumn("marker", F.col("y").cast("long")), 4)
    own = pyramid.merged_points(df, "marker").select("zoom", "cell_x", "cell_y", "marker", "n")
    return pyramid.top_k(own, 2, ["zoom", "cell_x", "cell_y"], [F.desc("n"), F.col("marker")]).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {_POINTS} SELECT fid, zoom FROM t WHERE fid % (1 << (4 - zoom)) = 0")
def point_decimation(spark, d):
    return pyramid.decimated(tiled(spark, d), 4).select("fid", "zoom")


@query(f"""WITH {_OPOINTS} SELECT fid, zoom, tile_x, tile_y FROM (SELECT *, row_number() OVER (PARTITION BY zoom, tile_x, tile_y ORDER BY (fid * 2654435761) % 4294967296, fid) AS k
FROM t) WHERE k <= 10""")
def cap_per_cell(spark, d):
    order = [F.pmod(F.col("fid") * F.lit(2654435761), F.lit(4294967296)), F.col("fid")]
    return pyramid.capped(pyramid.point_tiles(order_points(spark, d), 4), 10, ["zoom", "tile_x", "tile_y"], order).select("fid", "zoom", "tile_x", "tile_y")


@query(f"WITH {_POINTS} SELECT fid, tile_x, tile_y FROM t WHERE zoom = 3 AND tile_x = 2 AND tile_y = 5")
def pyramid_filter_read(spark, d):
    return pyramid.read(tiled(spark, d), zoom=3, tile_x=2, tile_y=5).select("fid", "tile_x", "tile_y")


@query(f"""WITH {_POINTS}, u AS (SELECT DISTINCT zoom, n, tile_x, tile_y FROM t)
SELECT zoom, tile_x, tile_y FROM u WHERE greatest(abs(tile_x - CAST(floor(0.3 * n) AS BIGINT)), abs(tile_y - CAST(floor(0.6 * n) AS BIGINT))) <= 1""")
def ring_filter(spark, d):
    return pyramid.in_ring(tiled(spark, d).select("zoom", "tile_x", "tile_y").distinct(), 0.3, 0.6, 1)


@query("""WITH o AS (SELECT o_orderstatus AS k, CAST(o_custkey % 7 AS INT) AS zoom FROM orders WHERE o_custkey % 7 <> 3),
d AS (SELECT DISTINCT k, zoom FROM o) SELECT k, arg_min(zoom, abs(zoom - 3) * 100 - zoom) AS zoom FROM d GROUP BY k""")
def nearest_zoom_choice(spark, d):
    df = Tables(spark, d).orders.select(F.col("o_orderstatus").alias("k"), (F.col("o_custkey") % 7).cast("int").alias("zoom")).where("zoom <> 3").distinct()
    return pyramid.nearest_zoom(df, ["k"], F.lit(3))


@query(f"""WITH {_POINTS}, u AS (SELECT DISTINCT zoom, tile_x, tile_y FROM t WHERE zoom = 4),
h AS (SELECT DISTINCT zoom, tile_x, tile_y FROM t WHERE zoom <= 2 AND (tile_x + tile_y) % 2 = 0),
c AS (SELECT u.*, h.zoom AS src_zoom, h.tile_x AS src_x, h.tile_y AS src_y, row_number() OVER (PARTITION BY u.zoom, u.tile_x, u.tile_y ORDER BY h.zoom DESC) AS k
FROM u JOIN h ON h.tile_x = u.tile_x >> (u.zoom - h.zoom) AND h.tile_y = u.tile_y >> (u.zoom - h.zoom))
SELECT zoom, tile_x, tile_y, src_zoom, src_x, src_y FROM c WHERE k = 1""")
def ancestor_drilldown(spark, d):
    own = tiled(spark, d).select("zoom", "tile_x", "tile_y").distinct()
    return pyramid.drill_down(own.where("zoom = 4"), own.where("zoom <= 2 AND (tile_x + tile_y) % 2 = 0"))


@query(f"""WITH {_POINTS}, u AS (SELECT DISTINCT zoom, tile_x, tile_y FROM t)
SELECT a.zoom, a.tile_x, a.tile_y, b.tile_x AS child_x, b.tile_y AS child_y FROM u a JOIN u b ON b.zoom = a.zoom + 1 AND b.tile_x >> 1 = a.tile_x AND b.tile_y >> 1 = a.tile_y""")
def tile_tree_children(spark, d):
    return pyramid.tile_children(tiled(spark, d).select("zoom", "tile_x", "tile_y").distinct())


@query(f"WITH {_POINTS} SELECT fid, CAST(w.range AS INT) AS world, CAST(floor((nx + w.range) * 1000) AS BIGINT) AS ix FROM p, range(-1, 2) w")
def world_wrap(spark, d):
    return pyramid.wrapped(points(spark, d)).select("fid", "world", F.floor(F.col("nx") * 1000).cast("long").alias("ix"))


# --- grid expressions ---------------------------------------------------------------------------------------------

_XYZ = "x AS (SELECT o_orderkey AS k, o_orderkey % 1024 AS a, o_custkey % 1024 AS b, (o_orderkey * 7) % 1024 AS c FROM orders)"
_MORTON = " + ".join(f"(((a >> {i}) & 1) << {3 * i}) + (((b >> {i}) & 1) << {3 * i + 1}) + (((c >> {i}) & 1) << {3 * i + 2})" for i in range(10))


def _xyz(spark, d) -> DataFrame:
    o = Tables(spark, d).orders
    return o.select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 1024).alias("a"), (F.col("o_custkey") % 1024).alias("b"), (F.col("o_orderkey") * 7 % 1024).alias("c"))


_WIDE = "w AS (SELECT o_orderkey AS k, (o_orderkey * 7919) % 2097152 AS a, (o_custkey * 104729) % 2097152 AS b, (o_orderkey * 15485863) % 2097152 AS c FROM orders)"
_MORTON21 = " + ".join(f"(CAST((a >> {i}) & 1 AS BIGINT) << {3 * i}) + (CAST((b >> {i}) & 1 AS BIGINT) << {3 * i + 1}) + (CAST((c >> {i}) & 1 AS BIGINT) << {3 * i + 2})" for i in range(21))


@query(f"WITH {_XYZ}, {_WIDE} SELECT x.k, x.code, w.code21 FROM (SELECT k, {_MORTON} AS code FROM x) x JOIN (SELECT k, {_MORTON21} AS code21 FROM w) w USING (k)")
def morton_encode(spark, d):
    """Codes of 10 bits an axis, and of 21 with all bits in use."""
    o = Tables(spark, d).orders
    wide = [(F.col(c).cast("long") * m) % 2097152 for c, m in (("o_orderkey", 7919), ("o_custkey", 104729), ("o_orderkey", 15485863))]
    low = [F.col("o_orderkey") % 1024, F.col("o_custkey") % 1024, F.col("o_orderkey") * 7 % 1024]
    return o.select(F.col("o_orderkey").alias("k"), grid.morton3(*low).alias("code"), grid.morton3(*wide, bits=21).alias("code21"))


@query(f"WITH {_XYZ} SELECT k, a, b, c FROM x")
def morton_roundtrip(spark, d):
    back = grid.unmorton3(grid.morton3(F.col("a"), F.col("b"), F.col("c")))
    return _xyz(spark, d).select("k", *[v.alias(n) for v, n in zip(back, "abc", strict=True)])


@query(f"WITH {_XYZ} SELECT k, ({_MORTON}) + (CAST(10 AS BIGINT) << 30) AS id3, ((1 << 10) * b + a) * 32 + 10 AS id2 FROM x")
def tile_id(spark, d):
    z = F.lit(10)
    return _xyz(spark, d).select("k", grid.tile_id3(z, F.col("a"), F.col("b"), F.col("c")).alias("id3"), grid.tile_id2(z, F.col("a"), F.col("b")).alias("id2"))


@query(f"WITH {_XYZ} SELECT k, row_number() OVER (ORDER BY {_MORTON}, k) AS rank FROM x")
def morton_order_rank(spark, d):
    own = _xyz(spark, d).withColumn("code", grid.morton3(F.col("a"), F.col("b"), F.col("c")))
    return sequences.dense_ids(own, ["code", "k"], "rank").select("k", (F.col("rank") + 1).alias("rank"))


@query(f"""WITH {_POINTS} SELECT fid, zoom, CAST(floor(4096.0 * (nx * n - tile_x) + 0.5) AS BIGINT) AS px,
CAST(round_even(4096.0 * (ny * n - tile_y), 0) AS BIGINT) AS py FROM t WHERE zoom IN (0, 3)""")
def tile_local_integers(spark, d):
    df = tiled(spark, d).where("zoom in (0, 3)")
    z = F.col("zoom")
    return df.select("fid", "zoom", grid.tile_integer(F.col("nx"), z, F.col("tile_x")).alias("px"), grid.tile_integer(F.col("ny"), z, F.col("tile_y"), half_even=True).alias("py"))


@query(f"""WITH {_POINTS}, q AS (SELECT fid, zoom, n, tile_x, floor(4096.0 * (nx * n - tile_x) + 0.5) AS px FROM t WHERE zoom = 2)
SELECT fid, CAST(floor((((tile_x + px / 4096.0) / n) * (x1 - x0) + x0) * 1000) AS BIGINT) AS wx FROM q, b""")
def tile_world_inverse(spark, d):
    box = pyramid.bounds(Tables(spark, d).lineitem, "l_extendedprice", names=("x",))
    df = tiled(spark, d).where("zoom = 2").withColumn("px", grid.tile_integer(F.col("nx"), F.col("zoom"), F.col("tile_x"))).crossJoin(F.broadcast(box))
    world = grid.tile_position(F.col("px"), F.col("zoom"), F.col("tile_x"), F.col("x_min"), F.col("x_max"))
    return df.select("fid", F.floor(world * 1000).cast("long").alias("wx"))


@query(f"""WITH {_POINTS}, u AS (SELECT DISTINCT zoom, n, tile_x, tile_y FROM t)
SELECT zoom, tile_x, tile_y, (CAST(tile_x AS DOUBLE) / n) * 100.0 + 0.0 AS x0, (CAST(tile_x + 1 AS DOUBLE) / n) * 100.0 + 0.0 AS x1,
CASE WHEN zoom >= 4 THEN 0.0 ELSE 500.0 / pow(2.0, zoom) END AS error FROM u""")
def tile_world_bounds(spark, d):
    own = tiled(spark, d).select("zoom", "tile_x", "tile_y").distinct()
    low, high = grid.tile_bounds(F.col("zoom"), F.col("tile_x"), 0.0, 100.0)
    return own.select("zoom", "tile_x", "tile_y", low.alias("x0"), high.alias("x1"), grid.geometric_error(F.col("zoom"), 4, 500.0).alias("error"))


@query("""SELECT CAST(range AS INT) AS zoom, CASE WHEN range >= 6 THEN 0.0 ELSE pow(2.0, -range) END AS tolerance,
CAST(floor(50.0 / (pow(2.0, range) * 4096.0) * 1e9) AS BIGINT) AS linear, CAST(floor((50.0 / 4096) * (50.0 / 4096) * 1e9) AS BIGINT) AS constant,
CAST(floor((50.0 / 4096) / ln(range + 2.0) * 1e6) AS BIGINT) AS logarithmic FROM range(0, 9)""")
def tolerance_schedule(spark, d):
    z = F.col("zoom")
    at = lambda name, m: F.floor(grid.tolerance(name, z) * m).cast("long").alias(name)
    return spark.range(9).select(F.col("id").cast("int").alias("zoom")).select("zoom", grid.zoom_tolerance(z, 6).alias("tolerance"), at("linear", 1e9), at("constant", 1e9), at("logarithmic", 1e6))


@query("""WITH s AS (SELECT p_partkey AS k, p_size * 300 AS cur, z.range AS z FROM part, range(0, 5) z)
SELECT k, CAST(z AS INT) AS zoom, CASE WHEN z >= 4 THEN cur ELSE greatest(3, least(18 * CAST(pow(4 * pow(2, z), 2) AS BIGINT), CASE 4 - z WHEN 1 THEN cur // 3 WHEN 2 THEN cur // 3 // 3
WHEN 3 THEN cur // 3 // 3 // 3 ELSE cur // 3 // 3 // 3 // 3 END, cur)) END AS budget FROM s""")
def triangle_budget(spark, d):
    df = pyramid.over_zooms(Tables(spark, d).part.select(F.col("p_partkey").alias("k"), (F.col("p_size") * 300).cast("long").alias("cur")), 4)
    return df.select("k", "zoom", grid.triangle_budget(F.col("cur"), F.col("zoom"), 4, 4).alias("budget"))


@query(f"WITH {_POINTS} SELECT fid, CAST(greatest(0, least(65535, floor((x - x0) * 65535.0 / (x1 - x0) + 0.5))) AS BIGINT) AS q FROM p, b")
def quantize_positions(spark, d):
    df = points(spark, d).crossJoin(F.broadcast(pyramid.bounds(Tables(spark, d).lineitem, "l_extendedprice", names=("x",))))
    return df.select("fid", grid.quantise(F.col("x"), F.col("x_min"), F.col("x_max"), 65535).alias("q"))


@query("""WITH s AS (SELECT quantile_cont(o_totalprice, 0.999) / 65535.0 AS scale FROM orders)
SELECT o_orderkey AS k, CAST(greatest(0.0, least(65535.0, CAST(round_even(o_totalprice / scale, 0) AS DOUBLE))) AS INT) AS q FROM orders, s""")
def quantize_u16(spark, d):
    o = Tables(spark, d).orders
    return o.crossJoin(F.broadcast(facets.scale_of(o, "o_totalprice"))).select(F.col("o_orderkey").alias("k"), facets.quantised(o, "o_totalprice", F.col("scale")).alias("q"))


# --- tags, filters, metadata --------------------------------------------------------------------------------------


@query("SELECT o_orderkey AS k, coalesce(c_mktsegment, '') AS segment, coalesce(c_nationkey, -1) AS nation FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 = 0) ON o_custkey = c_custkey")
def attach_tags(spark, d):
    t = Tables(spark, d)
    attributes = t.customer.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_nationkey")
    return tags.attach(t.orders, attributes, "o_custkey").select(F.col("o_orderkey").alias("k"), F.coalesce("c_mktsegment", F.lit("")).alias("segment"), F.coalesce("c_nationkey", F.lit(-1)).alias("nation"))


@query("SELECT event_id AS k, CAST(z.range AS INT) AS zoom, 'event_type=' || event_type || CASE WHEN z.range >= 3 THEN ';k=' || json_extract_string(props, '$.k') ELSE '' END AS tags FROM events, range(0, 5) z")
def tag_zoom_gate(spark, d):
    e = Tables(spark, d).events
    df = pyramid.over_zooms(e.select(F.col("event_id").alias("k"), tags.merge_maps(tags.scalar_tags(F.col("props")), F.create_map(F.lit("event_type"), F.col("event_type"))).alias("t")), 4)
    return df.select("k", "zoom", tags.serialised(tags.zoom_gate(F.col("t"), F.col("zoom"), {"k": 3})).alias("tags"))


@query("SELECT event_id AS id, 'K=' || json_extract_string(props, '$.k') AS tags FROM events")
def tag_rename_drop(spark, d):
    t = tags.merge_maps(tags.scalar_tags(F.col("props")), F.create_map(F.lit("event_type"), F.col("event_type")))
    return Tables(spark, d).events.select(F.col("event_id").alias("id"), tags.serialised(tags.renamed(tags.without(t, ["event_type"]), "k", "K")).alias("tags"))


@query("SELECT c_custkey AS k FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def selected_semi_join(spark, d):
    t = Tables(spark, d)
    keys = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return relations.present(t.customer, keys, "c_custkey").select(F.col("c_custkey").alias("k"))


@query("SELECT c_custkey AS k FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def anti_unmatched(spark, d):
    t = Tables(spark, d)
    return relations.absent(t.customer, t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey").select(F.col("c_custkey").alias("k"))


@query("""SELECT o_orderkey AS k, c_name AS cell, n_name AS nation, r_name AS region FROM orders LEFT JOIN customer ON o_custkey = c_custkey
LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def four_way_cell_join(spark, d):
    t = Tables(spark, d)
    base = t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c_custkey"))
    out = relations.left_all(base, (t.customer, "c_custkey"), (t.nation.withColumnRenamed("n_nationkey", "c_nationkey"), "c_nationkey"), (t.region.withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey"))
    return out.select("k", F.col("c_name").alias("cell"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"))


@query("""WITH s AS (SELECT s_suppkey AS k, CASE s_suppkey % 4 WHEN 0 THEN upper(n_name) WHEN 1 THEN substr(n_name, 1, 3) WHEN 2 THEN 'region_' || n_nationkey ELSE 'none' END AS stem
FROM supplier JOIN nation ON s_nationkey = n_nationkey),
m AS (SELECT match, arg_max(id, way * 1000 + id) AS id FROM (SELECT n_nationkey AS id, lower(n_name) AS match, 2 AS way FROM nation UNION ALL SELECT n_nationkey, lower(substr(n_name, 1, 3)), 1 FROM nation) GROUP BY match)
SELECT k, stem, coalesce(m.id, d.n_nationkey, -1) AS term FROM s LEFT JOIN m ON m.match = lower(stem) LEFT JOIN nation d ON d.n_nationkey = try_cast(regexp_replace(stem, '[^0-9]', '', 'g') AS BIGINT)""")
def ontology_fallback_match(spark, d):
    t = Tables(spark, d)
    n = t.nation
    s = t.supplier.join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    way = F.col("s_suppkey") % 4
    stem = F.when(way == 0, F.upper("n_name")).when(way == 1, F.substring("n_name", 1, 3)).when(way == 2, F.concat(F.lit("region_"), F.col("n_nationkey").cast("string"))).otherwise("none")
    terms = n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.substring("n_name", 1, 3).alias("acronym"))
    return relations.ontology_match(s.select(F.col("s_suppkey").alias("k"), stem.alias("stem")), terms).select("k", "stem", F.coalesce("term_id", F.lit(-1)).alias("term"))


@query("SELECT event_id AS k FROM events WHERE value >= 20 AND NOT regexp_matches(lower(event_type), '^(negcontrol|blank|antisense|deprecated|unassigned)')")
def quality_control_filter(spark, d):
    return tags.quality_filter(Tables(spark, d).events, "event_type", "value").select(F.col("event_id").alias("k"))


@query("SELECT event_id AS k FROM events WHERE try_cast(json_extract_string(props, '$.k') AS DOUBLE) BETWEEN 10 AND 50")
def attribute_filter_numeric(spark, d):
    df = Tables(spark, d).events.withColumn("v", F.get_json_object("props", "$.k"))
    return tags.numeric_filter(df, "v", 10, 50).select(F.col("event_id").alias("k"))


@query("SELECT c_custkey AS k FROM customer WHERE coalesce(c_mktsegment, '') IN ('BUILDING', 'MACHINERY')")
def attribute_filter_categorical(spark, d):
    return tags.category_filter(Tables(spark, d).customer, "c_mktsegment", ["BUILDING", "MACHINERY"]).select(F.col("c_custkey").alias("k"))


@query("SELECT p_partkey AS k FROM part WHERE contains(lower(p_name), lower('Ed Wid'))")
def name_search(spark, d):
    return tags.name_search(Tables(spark, d).part, "p_name", "Ed Wid").select(F.col("p_partkey").alias("k"))


_PROPS = """e AS (SELECT o_orderkey AS k, unnest(['status', 'cust', 'priority', 'one']) AS name, unnest([o_orderstatus, CAST(o_custkey AS VARCHAR), o_orderpriority, 'x']) AS value FROM orders)"""


def _props(spark, d) -> DataFrame:
    o = Tables(spark, d).orders.select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("cust"), F.col("o_orderpriority").alias("priority"), F.lit("x").alias("one"))
    return tags.entries(o, "k", ["status", "cust", "priority", "one"])


@query(f"""WITH {_PROPS} SELECT name, CASE WHEN bool_and(try_cast(value AS DOUBLE) IS NOT NULL) THEN 'numeric' ELSE 'categorical' END AS kind, count(DISTINCT value) AS n_distinct,
min(try_cast(value AS DOUBLE)) AS low, max(try_cast(value AS DOUBLE)) AS high FROM e GROUP BY name HAVING count(DISTINCT value) > 1""")
def filterable_attributes(spark, d):
    return tags.filterable(_props(spark, d))


@query(f"""WITH {_PROPS} SELECT name, CASE WHEN bool_or(try_cast(value AS DOUBLE) IS NOT NULL) THEN 'Number' ELSE 'String' END AS kind, min(try_cast(value AS DOUBLE)) AS low,
max(try_cast(value AS DOUBLE)) AS high, string_agg(DISTINCT CASE WHEN try_cast(value AS DOUBLE) IS NULL THEN value END, ',' ORDER BY CASE WHEN try_cast(value AS DOUBLE) IS NULL THEN value END) AS enums FROM e GROUP BY name""")
def property_ranges_enums(spark, d):
    return tags.property_ranges(_props(spark, d))


@query("SELECT DISTINCT unnest(json_keys(props)) AS key FROM events UNION SELECT 'event_type'")
def key_union(spark, d):
    t = tags.merge_maps(tags.scalar_tags(F.col("props")), F.create_map(F.lit("event_type"), F.col("event_type")))
    return Tables(spark, d).events.select(F.explode(F.map_keys(t)).alias("key")).distinct()


@query("""WITH c AS (SELECT unnest(['p_partkey', 'p_name', 'p_brand', 'p_type', 'p_size', 'p_retailprice']) AS name, unnest([count(DISTINCT p_partkey), count(DISTINCT p_name), count(DISTINCT p_brand),
count(DISTINCT p_type), count(DISTINCT p_size), count(DISTINCT p_retailprice)]) AS n_distinct, unnest([true, false, false, false, true, true]) AS numeric FROM part)
SELECT name, n_distinct, numeric, CASE WHEN name = 'p_partkey' OR name = 'p_name' THEN false WHEN regexp_matches(name, '^p_t.*$') THEN true ELSE numeric AND n_distinct > 64 END AS facet FROM c""")
def facet_key_selection(spark, d):
    part = Tables(spark, d).part
    policy = tags.FacetPolicy(key="p_partkey", keep_inline=["p_name"], include=["p_t*"], threshold=64)
    return tags.facet_keys(tags.cardinality(part, ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]), policy)


@query("SELECT event_id AS k, CAST(json_extract(props, '$.k') AS BIGINT) AS v FROM events")
def inline_json_lookup(spark, d):
    return Tables(spark, d).events.select(F.col("event_id").alias("k"), text.inline_lookup(F.col("props"), "k").cast("long").alias("v"))


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN CAST(c_custkey AS VARCHAR) WHEN contains(c_name, CAST(c_custkey AS VARCHAR)) THEN c_name ELSE c_name || ' (' || c_custkey || ')' END AS name FROM customer")
def id_fallback_name(spark, d):
    name = F.when(F.col("c_custkey") % 5 != 0, F.col("c_name"))
    return Tables(spark, d).customer.select(F.col("c_custkey").alias("k"), text.display_name(F.col("c_custkey"), name).alias("name"))


@query("SELECT p_partkey AS k, CASE WHEN p_size % 7 = 0 THEN 'undefined' WHEN p_size % 7 = 1 THEN 'soma' WHEN p_size % 7 = 2 THEN 'axon' WHEN p_size % 7 = 3 THEN 'basal_dendrite' WHEN p_size % 7 = 4 THEN 'apical_dendrite' ELSE 'type_' || (p_size % 7) END AS compartment FROM part")
def compartment_name(spark, d):
    return Tables(spark, d).part.select(F.col("p_partkey").alias("k"), text.compartment(F.col("p_size") % 7).alias("compartment"))


@query("SELECT o_orderkey AS k, CAST(o_orderkey % 9 AS INT) AS zoom, CAST(o_custkey AS INT) AS x, CAST(o_orderkey % 100 AS INT) AS y FROM orders")
def tile_path_roundtrip(spark, d):
    o = Tables(spark, d).orders
    path = text.tile_path(F.lit("root"), F.col("o_orderkey") % 9, F.col("o_custkey"), F.col("o_orderkey") % 100, extension=".pbf")
    return o.select(F.col("o_orderkey").alias("k"), *[c.alias(n) for c, n in zip(text.parse_tile_path(path), ("zoom", "x", "y"), strict=True)])


@query("""SELECT name, CASE WHEN name = 'cust' THEN 'int64' WHEN name = 'price' THEN 'float64' ELSE 'string' END AS kind FROM (SELECT unnest(['cust', 'price', 'status', 'mixed']) AS name)""")
def type_inference(spark, d):
    o = Tables(spark, d).orders.select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("cust"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderkey") % 2 == 0, "1").otherwise("a").alias("mixed"))
    return tags.entries(o, "k", ["cust", "price", "status", "mixed"]).groupBy("name").agg(text.column_kind(F.col("value")).alias("kind"))


# --- facets -------------------------------------------------------------------------------------------------------

_LONG = "f AS (SELECT l_orderkey AS cell_id, l_returnflag AS gene, CAST(sum(l_quantity) AS BIGINT) AS count FROM lineitem GROUP BY ALL)"


def _long(spark, d) -> DataFrame:
    t = Tables(spark, d).lineitem
    return t.groupBy(F.col("l_orderkey").alias("cell_id"), F.col("l_returnflag").alias("gene")).agg(F.sum("l_quantity").cast("long").alias("count"))


def _cells(spark, d) -> DataFrame:
    return Tables(spark, d).orders.select(F.col("o_orderkey").alias("cell_id"))


@query(f"WITH {_LONG} SELECT o_orderkey AS cell_id, coalesce(count, 0) AS count FROM orders LEFT JOIN (SELECT * FROM f WHERE gene = 'R') ON cell_id = o_orderkey")
def facet_gene_lookup(spark, d):
    return facets.gene_lookup(_long(spark, d), _cells(spark, d), "R")


@query(f"WITH {_LONG} SELECT cell_id, sum(CASE WHEN gene = 'A' THEN count END)::FLOAT AS A, sum(CASE WHEN gene = 'N' THEN count END)::FLOAT AS N, sum(CASE WHEN gene = 'R' THEN count END)::FLOAT AS R FROM f GROUP BY cell_id")
def facet_wide_pivot(spark, d):
    return facets.wide(_long(spark, d), ["A", "N", "R"])


@query(f"""WITH {_LONG}, r AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY count DESC, gene) AS k FROM f)
SELECT cell_id, CAST(sum(count) AS BIGINT) AS total_counts, string_agg(CASE WHEN k <= 2 THEN gene END, ',' ORDER BY k) AS top FROM r GROUP BY cell_id""")
def expression_totals_topn(spark, d):
    return facets.top_genes(_long(spark, d), 2)


@query(f"""WITH {_LONG} SELECT cell_id, '{{' || string_agg('"' || gene || '":' || count, ',' ORDER BY gene) || '}}' AS expression FROM f WHERE count <> 0 GROUP BY cell_id""")
def sparse_expression_json(spark, d):
    return facets.sparse_json(_long(spark, d))


@query(f"""WITH {_LONG} SELECT o_orderkey AS cell_id, coalesce(sum(CASE WHEN gene = 'R' THEN count END), 0) || ',' || coalesce(sum(CASE WHEN gene = 'A' THEN count END), 0) || ',' ||
coalesce(sum(CASE WHEN gene = 'N' THEN count END), 0) AS vector FROM orders LEFT JOIN f ON cell_id = o_orderkey GROUP BY o_orderkey""")
def dense_expression_vector(spark, d):
    return facets.dense_vectors(_long(spark, d), ["R", "A", "N"], _cells(spark, d)).select("cell_id", F.array_join("vector", ",").alias("vector"))


@query("SELECT DISTINCT l_returnflag AS gene FROM lineitem")
def distinct_genes(spark, d):
    return facets.gene_list(Tables(spark, d).lineitem.select(F.col("l_returnflag").alias("gene")))


@query("SELECT 'gene' || (l_partkey % 5) AS gene, 'cell' || (l_suppkey % 11) AS cell_id, count(*) AS count FROM lineitem GROUP BY ALL")
def matrix_index_join(spark, d):
    t = Tables(spark, d).lineitem
    coo = t.groupBy((F.col("l_partkey") % 5 + 1).alias("row"), (F.col("l_suppkey") % 11 + 1).alias("col")).agg(F.count(F.lit(1)).alias("count"))
    genes = spark.range(1, 6).select(F.col("id").alias("position"), F.concat(F.lit("gene"), F.col("id") - 1).alias("gene"))
    cells = spark.range(1, 12).select(F.col("id").alias("position"), F.concat(F.lit("cell"), F.col("id") - 1).alias("cell_id"))
    return facets.expression(coo, genes, cells)


@query("SELECT o_orderkey AS cell_id, CAST(o_totalprice AS FLOAT) AS m_price FROM orders")
def facet_migration(spark, d):
    o = Tables(spark, d).orders
    t = F.create_map(F.lit("cell_id"), F.col("o_orderkey").cast("string"), F.lit("m_price"), F.col("o_totalprice").cast("string"))
    rows = pyramid.over_zooms(o.select(t.alias("tags"), F.col("o_orderkey").alias("feature_id"), F.lit(0).alias("tile_x"), F.lit(0).alias("tile_y")), 2)
    return facets.migrate(rows, ["m_price"])[1].select(F.col("cell_id").cast("long").alias("cell_id"), "m_price")


# --- rings and lines ----------------------------------------------------------------------------------------------


_VERTICES = """v AS (SELECT l_orderkey AS id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_returnflag) AS INT) AS pos,
CAST(round(l_extendedprice) AS BIGINT) AS x, CAST(l_quantity AS BIGINT) AS y, l_returnflag AS kind, l_partkey AS part, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)"""


def vertices(spark, d) -> DataFrame:
    """id, pos, x, y, kind, part of line items; line numbers repeat within an order, so pos is a rank by all columns."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_returnflag")
    return sequences.spread(Tables(spark, d).lineitem, "l_orderkey").select(F.col("l_orderkey").alias("id"), F.row_number().over(order).alias("pos"), F.round("l_extendedprice").cast("long").alias("x"), F.col("l_quantity").cast("long").alias("y"), F.col("l_returnflag").alias("kind"), F.col("l_partkey").alias("part"))


def _rings(spark, d) -> DataFrame:
    from ..sources.tables import rings

    return rings(vertices(spark, d), "id", "x", "y", "pos")


@query(f"WITH {_VERTICES} SELECT id, n AS vertices, string_agg(x || ' ' || y, ',' ORDER BY pos) AS ring FROM v WHERE n >= 3 GROUP BY id, n")
def ring_build(spark, d):
    joined = F.array_join(F.transform("ring", lambda p: F.concat(p["x"].cast("long").cast("string"), F.lit(" "), p["y"].cast("long").cast("string"))), ",")
    return _rings(spark, d).select("id", F.size("ring").cast("long").alias("vertices"), joined.alias("ring"))


@query(f"""WITH {_VERTICES}, e AS (SELECT *, lead(x, 1) OVER w AS nx, lead(y, 1) OVER w AS ny, first_value(x) OVER w AS fx, first_value(y) OVER w AS fy FROM v WHERE n >= 3 WINDOW w AS (PARTITION BY id ORDER BY pos))
SELECT id, CAST(sum(x * coalesce(ny, fy) - coalesce(nx, fx) * y) AS DOUBLE) AS doubled FROM e GROUP BY id""")
def ring_area(spark, d):
    return _rings(spark, d).select("id", flat.doubled_area(F.concat("ring", F.slice("ring", 1, 1))).alias("doubled"))


@query(f"""WITH {_VERTICES}, e AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny, first_value(x) OVER w AS fx, first_value(y) OVER w AS fy FROM v WHERE n >= 3 WINDOW w AS (PARTITION BY id ORDER BY pos)),
a AS (SELECT id, sum(x * coalesce(ny, fy) - coalesce(nx, fx) * y) AS d FROM e GROUP BY id)
SELECT id, CASE WHEN d < 0 THEN 'reversed' ELSE 'kept' END AS turn FROM a""")
def ring_rewind(spark, d):
    loop = F.concat("ring", F.slice("ring", 1, 1))
    return _rings(spark, d).select("id", F.when(flat.doubled_area(loop) < 0, "reversed").otherwise("kept").alias("turn"))


@query(f"WITH {_VERTICES}, e AS (SELECT id, pos, x, y, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM v WINDOW w AS (PARTITION BY id ORDER BY pos)) SELECT id, pos, x, y, x2, y2 FROM e WHERE x2 IS NOT NULL")
def segments_from_polyline(spark, d):
    t = vertices(spark, d).select("id", "pos", "x", "y")
    w = Window.partitionBy("id").orderBy("pos")
    return t.withColumn("x2", F.lead("x").over(w)).withColumn("y2", F.lead("y").over(w)).where("x2 is not null")


@query(f"WITH {_VERTICES} SELECT id, pos, CAST(sum(y) OVER (PARTITION BY id ORDER BY pos) - y AS BIGINT) AS start FROM v")
def prefix_offsets(spark, d):
    return sequences.prefix_offsets(vertices(spark, d), ["id"], "pos", "y").select("id", "pos", F.col("offset").alias("start"))


@query("""WITH e AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)
SELECT vec_id, min(CASE WHEN i % 2 = 0 THEN v END) AS min_x, max(CASE WHEN i % 2 = 0 THEN v END) AS max_x, min(CASE WHEN i % 2 = 1 THEN v END) AS min_y, max(CASE WHEN i % 2 = 1 THEN v END) AS max_y FROM e GROUP BY vec_id""")
def bbox_of_flat_array(spark, d):
    (a, b), (c, e) = flat.bbox(F.col("embedding"))
    return Tables(spark, d).embeddings.select("vec_id", a.alias("min_x"), b.alias("max_x"), c.alias("min_y"), e.alias("max_y"))


@query("WITH e AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) SELECT vec_id, CAST(sum(CAST(round(CAST(v AS DOUBLE) * 1000000) AS BIGINT)) AS BIGINT) AS sum_x FROM e WHERE i % 2 = 0 GROUP BY vec_id")
def centroid_of_array(spark, d):
    x = F.transform(flat.axis(F.col("embedding"), 0), lambda v: F.round(v.cast("double") * 1000000).cast("long"))
    return Tables(spark, d).embeddings.select("vec_id", F.aggregate(x, F.lit(0).cast("long"), lambda a, b: a + b).alias("sum_x"))


@query(f"""WITH {_POINTS}, c AS (SELECT *, CAST(floor(x / 640) AS BIGINT) AS cx, CAST(floor(y / 10) AS BIGINT) AS cy FROM p)
SELECT cx, cy, count(*) AS n, CAST(sum(CAST(round(x * 100) AS BIGINT)) AS BIGINT) AS sum_x, min(fid) AS first FROM c GROUP BY cx, cy""")
def vertex_cluster(spark, d):
    from ..functions.mesh import clustered_vertices

    df = points(spark, d)
    return clustered_vertices(df, {"cx": F.col("x") / 640, "cy": F.col("y") / 10}).agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("x") * 100).cast("long")).alias("sum_x"), F.min("fid").alias("first"))


@query(f"""WITH {_OPOINTS.replace("o_totalprice", "floor(o_totalprice / 1000)")}, f AS (SELECT min(fid) AS first, x, y FROM p GROUP BY x, y), r AS (SELECT x, y, dense_rank() OVER (ORDER BY first) - 1 AS idx FROM f)
SELECT fid, idx FROM p JOIN r USING (x, y)""")
def vertex_dedup(spark, d):
    from ..functions.mesh import vertex_index

    return vertex_index(order_points(spark, d).withColumn("x", F.floor(F.col("x") / 1000)), ["x", "y"], "fid").select("fid", "idx")


@query(f"WITH {_VERTICES}, e AS (SELECT id, pos, y - lag(y, 1, CAST(0 AS BIGINT)) OVER (PARTITION BY id ORDER BY pos) AS d FROM v) SELECT id, pos, xor(d * 2, d >> 63) AS z FROM e")
def delta_encode(spark, d):
    return sequences.deltas(vertices(spark, d), ["id"], "pos", "y").select("id", "pos", grid.zigzag(F.col("delta")).alias("z"))


# --- tile tables --------------------------------------------------------------------------------------------------


@query(f"WITH {_POINTS} SELECT zoom, tile_x, tile_y, count(*) AS num_features, count(*) AS num_points, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM t GROUP BY zoom, tile_x, tile_y")
def tile_stats(spark, d):
    return tiles.tile_stats(tiled(spark, d), tiles.TILE2, F.lit(1).cast("long"), {"x": (F.col("x"), F.col("x")), "y": (F.col("y"), F.col("y"))})


@query(f'WITH {_POINTS} SELECT zoom, count(DISTINCT tile_x * 100000 + tile_y) AS tiles, count(*) AS "rows" FROM t GROUP BY zoom')
def zoom_counts(spark, d):
    return tiles.zoom_counts(tiled(spark, d))


@query("SELECT 'orders' AS layer, count(*) AS n FROM orders UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'events', count(*) FROM events")
def layer_counts(spark, d):
    return _layers(spark, d).groupBy("layer").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'orders' AS layer, o_orderkey AS id, o_totalprice AS x FROM orders UNION ALL SELECT 'customer', c_custkey, c_acctbal FROM customer UNION ALL SELECT 'events', event_id, value FROM events")
def union_layers(spark, d):
    return _layers(spark, d)


def _layers(spark, d) -> DataFrame:
    t, out = Tables(spark, d), None
    for name, key, x in (("orders", "o_orderkey", "o_totalprice"), ("customer", "c_custkey", "c_acctbal"), ("events", "event_id", "value")):
        part = getattr(t, name).select(F.lit(name).alias("layer"), F.col(key).alias("id"), F.col(x).alias("x"))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


@query(f"""WITH {_POINTS}, u AS (SELECT DISTINCT gene, zoom, tile_x, tile_y FROM t WHERE zoom <= 2), c AS (SELECT gene, zoom, count(*) AS n FROM u GROUP BY gene, zoom)
SELECT u.gene, string_agg(u.zoom || '/' || tile_x || '/' || tile_y, ' ' ORDER BY u.zoom, tile_x, tile_y) AS tiles,
(SELECT string_agg(c.zoom || ':' || c.n, ',' ORDER BY c.zoom) FROM c WHERE c.gene = u.gene) AS tile_counts FROM u GROUP BY u.gene""")
def feature_index(spark, d):
    return tiles.feature_index(tiled(spark, d, 2), "gene")


@query(f"WITH {_POINTS} SELECT min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max FROM p")
def table_bounds(spark, d):
    return pyramid.bounds(points(spark, d), "x", "y")


@query("SELECT min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max FROM (SELECT l_extendedprice AS x, l_quantity AS y FROM lineitem UNION ALL SELECT o_totalprice, CAST(o_custkey AS DOUBLE) FROM orders)")
def multi_source_bounds(spark, d):
    t = Tables(spark, d)
    return pyramid.bounds_of((t.lineitem, "l_extendedprice", "l_quantity"), (t.orders, "o_totalprice", "o_custkey"))


@query(f"""WITH {_OPOINTS}, s AS (SELECT CAST(greatest(0, least(63, floor(nx * 63 + 0.5))) AS INT) AS px, CAST(greatest(0, least(63, floor(ny * 63 + 0.5))) AS INT) AS py, fid, gene FROM p)
SELECT px, py, arg_max(gene, fid) AS gene FROM s GROUP BY px, py""")
def overview_splat(spark, d):
    df = order_points(spark, d).select("fid", "gene", F.col("nx").alias("x"), F.col("ny").alias("y"))
    return tiles.splat(df, 0.0, 1.0, 64, "fid", "gene")


@query("SELECT n_nationkey AS id, r_regionkey AS parent, n_name AS name, r_name AS parent_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def tree_edges(spark, d):
    t = Tables(spark, d)
    nodes = t.nation.select(F.lit(1).alias("tree"), F.col("n_nationkey").alias("id"), (F.col("n_regionkey") + 100).alias("parent"), F.col("n_name").alias("name"))
    nodes = nodes.unionByName(t.region.select(F.lit(1).alias("tree"), (F.col("r_regionkey") + 100).alias("id"), F.lit(-1).alias("parent"), F.col("r_name").alias("name")))
    return relations.tree_edges(nodes).select("id", (F.col("parent") - 100).cast("int").alias("parent"), "name", "parent_name")


@query("SELECT CAST(n_nationkey AS BIGINT) AS id, 1 AS depth, r_name || '/' || n_name AS path FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT CAST(r_regionkey + 100 AS BIGINT), 0, r_name FROM region")
def ontology_paths(spark, d):
    t = Tables(spark, d)
    nodes = t.nation.select(F.col("n_nationkey").alias("id"), (F.col("n_regionkey") + 100).alias("parent_id"), F.col("n_name").alias("name"))
    nodes = nodes.unionByName(t.region.select((F.col("r_regionkey") + 100).alias("id"), F.lit(None).cast("int").alias("parent_id"), F.col("r_name").alias("name")))
    return relations.paths(nodes)


@query("""WITH s AS (SELECT l_orderkey AS id, mode_type FROM (SELECT l_orderkey, l_returnflag AS mode_type, count(*) AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY count(*) DESC, l_returnflag) AS k FROM lineitem GROUP BY 1, 2) WHERE k = 1)
SELECT id, CASE WHEN id % 5 = 0 THEN 'known' ELSE mode_type END AS kind FROM s""")
def majority_type(spark, d):
    t = Tables(spark, d).lineitem.select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("kind"))
    keys = t.select("id").distinct()
    return relations.with_majority(keys, keys.where("id % 5 = 0").withColumn("kind", F.lit("known")), t, "id", "kind")


@query("SELECT d.doc_id, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN (SELECT CAST(doc_id AS VARCHAR) AS key, quality FROM labels) l ON l.key = CAST(d.doc_id AS VARCHAR)")
def label_property_join(spark, d):
    t = Tables(spark, d)
    props = t.labels.select(F.col("doc_id").cast("string").alias("key"), "quality")
    return relations.by_label(t.documents.select(F.col("doc_id").alias("label")), props).select(F.col("label").alias("doc_id"), F.coalesce("quality", F.lit(-1)).alias("quality"))


@query("SELECT p_partkey AS k, coalesce(s_name, 'part_' || p_partkey) AS name FROM part LEFT JOIN supplier ON s_suppkey = p_partkey")
def stem_default_tags(spark, d):
    t = Tables(spark, d)
    own = tags.attach(t.part.select(F.col("p_partkey").alias("k")), t.supplier.select(F.col("s_suppkey").alias("k"), "s_name"), "k")
    return own.select("k", F.coalesce("s_name", F.concat(F.lit("part_"), F.col("k").cast("string"))).alias("name"))


@query("SELECT c_custkey AS k, c_acctbal AS acctbal, s_acctbal AS acctbal_ccf FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def suffix_merge(spark, d):
    t = Tables(spark, d)
    left = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("acctbal"))
    return relations.suffixed(left, t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("acctbal")), "k", "_ccf")


# --- order --------------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey AS a, l_linenumber AS b, row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS fid FROM lineitem")
def feature_ids(spark, d):
    t = Tables(spark, d).lineitem.select(F.col("l_orderkey").alias("a"), F.col("l_linenumber").alias("b"))
    return sequences.dense_ids(t, ["a", "b"])


@query("SELECT o_orderkey AS k, o_custkey AS c FROM orders WHERE o_custkey IN (SELECT DISTINCT o_custkey FROM orders ORDER BY 1 LIMIT 20)")
def first_n_by_id(spark, d):
    o = Tables(spark, d).orders.select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    return sequences.first_n(o, "c", 20)


@query("SELECT p_brand AS class, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, class LIMIT 3")
def top_classes(spark, d):
    return Tables(spark, d).part.groupBy(F.col("p_brand").alias("class")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "class").limit(3)


@query("SELECT p_type AS class, count(*) AS n FROM part GROUP BY p_type HAVING count(*) >= 20")
def class_threshold(spark, d):
    return Tables(spark, d).part.groupBy(F.col("p_type").alias("class")).agg(F.count(F.lit(1)).alias("n")).where("n >= 20")


_BATCH = f"""WITH {_OPOINTS}, q AS (SELECT fid, tile_x, tile_y, row_number() OVER (PARTITION BY tile_x, tile_y ORDER BY fid) - 1 AS rn, count(*) OVER (PARTITION BY tile_x, tile_y) AS c FROM t WHERE zoom = 3),
a AS (SELECT fid, tile_x || '/' || tile_y || '/' || (rn // 32) AS batch, rn % 32 AS slot FROM q WHERE rn < c // 32 * 32),
r AS (SELECT fid, row_number() OVER (ORDER BY tile_x, tile_y, fid) - 1 AS nth, count(*) OVER () AS total FROM q WHERE rn >= c // 32 * 32)
SELECT * FROM a UNION ALL SELECT fid, 'mixed/' || (nth // 32), nth % 32 FROM r WHERE nth // 32 < total // 32"""


@query(_BATCH)
def tile_batches(spark, d):
    own = pyramid.point_tiles(order_points(spark, d), 3, 3).select("fid", "tile_x", "tile_y")
    return sequences.batches(own, ["tile_x", "tile_y"], ["fid"], 32).select("fid", "batch", F.col("slot").cast("long").alias("slot"))


@query("SELECT p_partkey AS k, p_brand AS class, rank FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rank FROM part) WHERE rank <= 50 // 5")
def stratified_n(spark, d):
    p = Tables(spark, d).part.select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("class"))
    return sequences.stratified_n(p, "class", "k", 50, 5).withColumn("rank", F.col("rank").cast("long"))


@query("SELECT p_type AS t, n, before FROM (SELECT p_type, n, CAST(sum(n) OVER (ORDER BY p_type) - n AS BIGINT) AS before FROM (SELECT p_type, count(*) AS n FROM part GROUP BY p_type)) WHERE before < 900")
def cap_whole_groups(spark, d):
    return sequences.capped_groups(Tables(spark, d).part.select(F.col("p_type").alias("t")), "t", 900)


@query("""SELECT p_partkey AS k, CASE WHEN share < 0.8 THEN 'train' WHEN share < 0.9 THEN 'val' ELSE 'test' END AS split FROM (SELECT p_partkey,
CAST(row_number() OVER (PARTITION BY p_brand ORDER BY (p_partkey * 2654435761) % 4294967296, p_partkey) - 1 AS DOUBLE) / count(*) OVER (PARTITION BY p_brand) AS share FROM part)""")
def split_80_10_10(spark, d):
    p = Tables(spark, d).part.select(F.col("p_partkey").alias("k"), "p_brand")
    return sequences.split(p, "p_brand", [F.pmod(F.col("k") * F.lit(2654435761), F.lit(4294967296)), F.col("k")], (0.8, 0.1)).select("k", "split")


@query("SELECT DISTINCT p_type AS class, dense_rank() OVER (ORDER BY p_type) - 1 AS code FROM part")
def label_encode(spark, d):
    return sequences.encoded_labels(Tables(spark, d).part.select(F.col("p_type").alias("class")), "class").withColumn("code", F.col("code").cast("long"))


@query(f"""WITH {_VERTICES}, f AS (SELECT *, CASE WHEN lag(kind) OVER w = kind THEN 0 ELSE 1 END AS new FROM v WINDOW w AS (PARTITION BY id ORDER BY pos)),
g AS (SELECT *, CAST(sum(new) OVER (PARTITION BY id ORDER BY pos) AS BIGINT) AS run FROM f) SELECT id, run, kind, min(pos) AS first, max(pos) AS last, count(*) AS n FROM g GROUP BY id, run, kind""")
def subpath_runs(spark, d):
    return sequences.runs(vertices(spark, d), ["id"], "pos", "kind")


@query(f"WITH {_VERTICES} SELECT id, part FROM v WHERE pos = 1")
def first_occurrence(spark, d):
    return sequences.first_of(vertices(spark, d), ["id"], [F.col("pos")]).select("id", "part")


@query("SELECT event_type AS k, count(*) AS n, quantile_cont(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95_nearest, quantile_disc(value, 0.99) AS p99_nearest FROM events GROUP BY event_type")
def latency_percentiles(spark, d):
    e = Tables(spark, d).events.select(F.col("event_type").alias("k"), "value")
    return sequences.latency_summary(e, "value", "k").select("k", "n", "p50", "p95_nearest", "p99_nearest")


@query("""WITH s AS (SELECT p_brand AS k, count(*) AS n, avg(CAST(p_size AS DOUBLE) - 25) AS mean, coalesce(stddev_samp(CAST(p_size AS DOUBLE) - 25), 0.0) AS sd FROM part GROUP BY p_brand)
SELECT k, n, CAST(floor(mean * 1000 + 0.0005) AS BIGINT) AS mean, CAST(floor(sd * 1000 + 0.0005) AS BIGINT) AS sd, CAST(floor(mean / (sd / sqrt(n)) * 1000 + 0.0005) AS BIGINT) AS t FROM s""")
def multi_seed_stats(spark, d):
    p = Tables(spark, d).part.select(F.col("p_brand").alias("k"), F.col("p_size").cast("double").alias("a"), F.lit(25.0).alias("b"))
    milli = lambda c: F.floor(F.col(c) * 1000 + 0.0005).cast("long").alias(c)
    return sequences.paired_summary(p, "k", "a", "b").select("k", "n", milli("mean"), milli("sd"), milli("t"))


@query("""WITH g AS (SELECT p_brand AS k, p_size AS w, max(p_retailprice) AS q FROM part GROUP BY 1, 2), l AS (SELECT *, q / lag(q) OVER (PARTITION BY k ORDER BY w) - 1 AS gain FROM g)
SELECT k, coalesce(max(CASE WHEN gain >= 0.05 THEN w END), min(w)) AS knee FROM l GROUP BY k""")
def throughput_knee(spark, d):
    g = Tables(spark, d).part.groupBy(F.col("p_brand").alias("k"), F.col("p_size").alias("w")).agg(F.max("p_retailprice").alias("q"))
    return sequences.knee(g, "k", "w", "q", 0.05)


# --- sets ---------------------------------------------------------------------------------------------------------


@query("SELECT DISTINCT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def key_intersection(spark, d):
    t = Tables(spark, d)
    return t.customer.select(F.col("c_nationkey").alias("k")).intersect(t.supplier.select("s_nationkey"))


@query("SELECT DISTINCT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity < 3")
def strip_difference(spark, d):
    t = Tables(spark, d)
    return t.part.select(F.col("p_partkey").alias("k")).exceptAll(t.lineitem.where("l_quantity < 3").select(F.col("l_partkey").alias("k")).distinct()).distinct()


@query(f"""WITH {_POINTS}, a AS (SELECT fid, zoom, tile_x, tile_y, x, y FROM t WHERE zoom <= 2),
k AS (SELECT fid, zoom, tile_x, tile_y, x, y FROM t WHERE zoom <= 2 AND fid % (1 << (2 - zoom)) = 0),
m AS (SELECT zoom, count(*) AS n FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM k) GROUP BY zoom),
e AS (SELECT zoom, count(*) AS n FROM (SELECT * FROM k EXCEPT ALL SELECT * FROM a) GROUP BY zoom)
SELECT z.zoom, coalesce(m.n, 0) AS missing, coalesce(e.n, 0) AS added FROM (SELECT DISTINCT zoom FROM a) z LEFT JOIN m USING (zoom) LEFT JOIN e USING (zoom)""")
def geometry_fidelity(spark, d):
    """What decimation takes from each zoom of a pyramid, and that it adds nothing."""
    columns = ["fid", "zoom", "tile_x", "tile_y", "x", "y"]
    whole = tiled(spark, d, 2)
    return facets.geometry_changes(whole, pyramid.decimated(whole, 2), columns, "zoom")
