"""Near-duplicate embeddings by exact balls round dense groups and a pivot-permutation index for the rest.

Dense groups. Where sampled vectors are within the threshold of each other, the mean of such a neighbourhood is a
centre. Vectors within the threshold's angle of a centre are core vectors of the nearest one. By the triangle
inequality all that is similar to a core vector is within twice that angle of its centre, so the ball of that radius
round the centre has every pair of its core vectors, and none is missed. All pairs of a ball are compared.

Pivots for the vectors that are no core vectors are a bounded sample of the vectors (least by hash; about twice the square root of their number, ``PIVOTS``
at most), those in dense groups replaced by their centres. Every such vector is described by its ``PREFIX`` nearest pivots in order and stands in the inverted list of
each of them, per label. In a list, pairs that share at least ``SHARED`` pivots are candidates; the list of the
first pivot that a pair shares verifies it, by cosine in double precision, so a pair is counted once (in balls, that
of the first centre of which one of the two is a core vector). Balls and lists of more than ``BLOCK`` vectors are worked through block against block, none is cut. Equal vectors with one label are one
class from the start. Links are counted and joined in the list; pairs are never rows.

Defined results: vectors that are null or zero or hold null or non-finite components, and those without a label,
link with nothing; vectors of different lengths don't link; repeated rows are equal vectors and link; a null vec_id
never is a group's id unless all are null; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..stored import written
from ._shared import Links, components, pick
from .jaccard_join import NAMELESS

THRESHOLD, PIVOTS, PREFIX, SHARED, BLOCK = 0.93, 4096, 8, 2, 2048


def _vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _lists(of: list[np.ndarray] | np.ndarray) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, of)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *of]).astype(np.int32)))


def classes(df: DataFrame) -> DataFrame:
    """node (smallest vec_id), copies, label, v, dims of the distinct valid vectors."""
    good = df.where("label is not null and v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    found = good.groupBy("label", "v").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies"))
    node = F.coalesce("vec_id", F.lit(NAMELESS) + F.xxhash64("label", "v").bitwiseAND(NAMELESS - 1))
    return found.select(node.alias("node"), "copies", "label", "v", F.size("v").alias("dims"))


def centres(p: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Centres of the dense groups of the sampled unit vectors ``p``, the fullest neighbourhood first, and the rest of
    ``p``: what is in no such group. Neighbourhoods move to their means, so that a group has few centres."""
    near = np.concatenate([p[i : i + 512] @ p.T >= threshold for i in range(0, len(p), 512)]) if len(p) else np.zeros((0, 0), bool)
    free, many, found = np.ones(len(p), bool), near.sum(axis=1), []
    while len(p):
        i = int(np.argmax(np.where(free, many, 0)))
        inside = free & near[i]
        if inside.sum() < 2:
            break
        centre = p[i]
        for _ in range(4):
            mean = p[inside].mean(axis=0)
            moved = free & (p @ (mean / np.linalg.norm(mean)) >= threshold)
            if moved.sum() < inside.sum():
                break
            centre, inside = mean / np.linalg.norm(mean), moved
        found.append(centre)
        many = many - near[:, inside].sum(axis=1)
        free &= ~inside
    return np.array(found).reshape(len(found), p.shape[1]), p[free]


def pivots(nodes: DataFrame, threshold: float = THRESHOLD, most: int = PIVOTS) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Unit pivots and centres of dense groups by number of dimensions, from a bounded number of vectors, least by a
    hash."""
    out = {}
    for row in nodes.groupBy("dims").count().orderBy(F.desc("count"), "dims").limit(16).collect():
        many = min(most, max(16, int(2 * row["count"] ** 0.5)))
        rows = nodes.where(F.col("dims") == row["dims"]).orderBy(F.xxhash64("node", F.lit(13)), "node").limit(many).select("v").collect()
        dense, rest = centres(_unit(np.array([r["v"] for r in rows], dtype=np.float64)), threshold)
        out[row["dims"]] = np.concatenate([rest, dense]), dense
    return out


def described(nodes: DataFrame, found: dict[int, tuple[np.ndarray, np.ndarray]], threshold: float = THRESHOLD, prefix: int = PREFIX) -> DataFrame:
    """node, copies, label, v, dims, near: the nearest pivots in order, none for core vectors; home: the centre of a
    core vector, else -1; balls: the centres of the balls that the vector is in. Kinds of vectors without pivots have
    one list, number 0, for all."""
    wide = 2 * threshold**2 - 1 - 1e-9 if threshold > 0 else -2.0

    def run(batches):
        for batch in batches:
            for dims in np.unique(batch.column("dims").to_numpy()):
                part = batch.filter(pa.array(batch.column("dims").to_numpy() == dims))
                p, dense = found.get(int(dims), (None, None))
                home, balls = np.full(part.num_rows, -1, np.int32), [np.zeros(0, np.int32)] * part.num_rows
                if p is None:
                    near = np.zeros((part.num_rows, 1), np.int32)
                else:
                    k, v = min(prefix, len(p)), _unit(_vectors(part.column("v")))
                    dots = v @ p.T
                    near = np.argpartition(-dots, k - 1, axis=1)[:, :k]
                    near = np.take_along_axis(near, np.argsort(-np.take_along_axis(dots, near, 1), axis=1, kind="stable"), 1).astype(np.int32)
                    if len(dense):
                        dots = v @ dense.T
                        home = np.where(dots.max(axis=1) >= threshold + 1e-9, dots.argmax(axis=1), -1).astype(np.int32)
                        balls = [np.flatnonzero(d) for d in dots >= wide]
                near = [own if h < 0 else own[:0] for own, h in zip(near, home, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, _lists(near), pa.array(home), _lists(balls)], names=[*part.schema.names, "near", "home", "balls"])

    return nodes.mapInArrow(run, nodes.schema.simpleString()[7:-1].replace(",", ", ") + ", near array<int>, home int, balls array<int>")


def _linked(table: pa.Table, threshold: float, shared: int) -> pa.Table:
    """node, links, b (a linked node no greater) of all the lists, balls (pivot -1 - centre) or block pairs in ``table``."""
    node, copies, block, pivot, home = (table.column(c).to_numpy() for c in ("node", "copies", "block", "pivot", "home"))
    keys = [table.column(c).to_numpy() for c in ("list", "bi", "bj")]
    order = np.lexsort((node, *keys[::-1]))
    total, links = np.zeros(len(node), np.int64), Links(len(node))
    rank = np.empty(len(node), np.int64)
    rank[np.argsort(node, kind="stable")] = np.arange(len(node))
    change = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    for rows in np.split(order, np.flatnonzero(change) + 1):
        if len(rows) < 2:
            continue
        cross = keys[1][rows[0]] != keys[2][rows[0]]
        p = pivot[rows[0]]
        first = np.where(home[rows] < 0, np.iinfo(np.int32).max, home[rows])  # centre whose ball has a core vector's pairs
        if p < 0 and not (first == -1 - p).any():
            continue
        part = table.take(pa.array(rows))
        x = _vectors(part.column("v"))
        norm = np.linalg.norm(x, axis=1)
        scale = np.where(np.isfinite(norm) & (norm > 1e-150), 1, np.abs(x).max(axis=1))  # extreme values only
        x, norm = x / scale[:, None], np.linalg.norm(x / scale[:, None], axis=1)
        if p >= 0:
            near = _vectors(part.column("near")).astype(np.int64)
            _, column = np.unique(near, return_inverse=True)
            has = np.zeros((len(rows), column.max() + 1), np.float32)
            has[np.repeat(np.arange(len(rows)), near.shape[1]), column.ravel()] = 1
            less = np.zeros_like(has)
            less[np.repeat(np.arange(len(rows)), near.shape[1]), column.ravel()] = near.ravel() < p
        for i in range(0, len(rows), 512):
            cut = slice(i, i + 512)
            if p < 0:
                good = np.minimum(first[cut, None], first[None, :]) == -1 - p
            else:
                good = (has[cut] @ has.T >= min(shared, near.shape[1])) & (less[cut] @ less.T == 0)
            good &= x[cut] @ x.T >= threshold * norm[cut, None] * norm[None, :] * (1 - 1e-12)
            a, b = np.nonzero(good)
            a += i
            a, b = a[a < b], b[a < b]
            if cross:
                ok = block[rows[a]] != block[rows[b]]
                a, b = a[ok], b[ok]
            if not len(a):
                continue
            close = (x[a] * x[b]).sum(axis=1) / (norm[a] * norm[b]) >= threshold
            a, b = rows[a[close]], rows[b[close]]
            np.add.at(total, a, copies[b])
            np.add.at(total, b, copies[a])
            links.join(rank[a], rank[b])
    at = np.empty(len(node), np.int64)
    at[rank] = node
    return pa.table({"node": node, "links": total, "b": at[links.roots()[rank]]})


def embedding_dedup(vectors: DataFrame, threshold: float = THRESHOLD, prefix: int = PREFIX, shared: int = SHARED) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of ``vectors`` (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = pick(vectors, vec_id="vec_id", v="embedding", label="label")
    df = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<double>").alias("v"), F.col("label").cast("string").alias("label"))
    nodes = written(classes(df), "vectors")
    places = F.concat("near", F.transform("balls", lambda c: -1 - c))
    lists = described(nodes, pivots(nodes, threshold), threshold, prefix).withColumn("pivot", F.explode(places)).withColumn("list", F.xxhash64("label", "dims", "pivot"))
    lists = written(lists.select("list", "pivot", "node", "copies", "v", "near", "home"), "lists")
    sizes = lists.groupBy("list").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    lists = lists.join(sizes, "list").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    lists = lists.withColumn("block", F.pmod(F.xxhash64("node", F.lit(9)), "blocks").cast("int"))
    lists = lists.withColumn("to", F.explode(F.expr("sequence(0, blocks - 1)")))
    lists = lists.withColumn("bi", F.least("block", "to")).withColumn("bj", F.greatest("block", "to"))
    g = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("list"), F.lit(8 * parts))).otherwise(F.xxhash64("list", "bi", "bj"))
    found = lists.select("list", "bi", "bj", "block", "pivot", "node", "copies", "v", "near", "home", g.alias("g")).groupBy("g")
    found = found.applyInArrow(lambda t: _linked(t, threshold, shared), "node long, links long, b long")
    # a node stands in several lists; its links add up, and only edges that join go on
    found = written(found.groupBy("node", "b").agg(F.sum("links").alias("links")), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.where("node <> b").select(F.col("node").alias("a"), "b"))
    per = nodes.join(links, "node", "left").join(roots, "node", "left")
    per = per.select(F.col("label").alias("l"), F.col("v").alias("w"), F.coalesce("root", "node").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = df.join(per, (df.label == per.l) & (df.v == per.w), "left")
    root = F.when(F.col("root") < NAMELESS, F.col("root"))
    component = F.coalesce(root, F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op7_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return embedding_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP7_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_dot_product(a.e, a.e) > 0 AND list_dot_product(b.e, b.e) > 0
        AND list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93),
r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT r.a AS vec_id, (SELECT count(*) FROM l WHERE l.a = r.a) AS n_links, min(r.b) AS component_id, min(r.b) = r.a AS kept FROM r GROUP BY r.a
"""
