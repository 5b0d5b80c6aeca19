"""N-gram Jaccard self-join by chosen paths.

Sets are the distinct runs of five words of a text (of all its words, if it has fewer). Texts with the same words
are one class from the start, so groups of copies cost one row. Each class has a sketch of ``COORDINATES``
minima, in which two sets agree in a share that is their similarity on average.

Paths. A run starts with all classes at its root. A node chooses coordinates by a hash of its path, 1 / threshold
on average, and sends each class to the child that its minimum there names, so a pair at the threshold meets in
one child on average however deep the recursion goes. Nodes of at most ``LEAF`` classes are compared by brute
force, by sketches: what is alike gets an edge. In larger ones all are first compared with one class chosen by hash
(the same one wherever it is): what is alike gets an edge to it, and what is almost equal to it leaves, as whatever is
similar to that gets the same edge. A node all of whose classes edges connect already is done; where a few are not, they
join the others' group. The other nodes' classes go on to their children, until no node is large. Twelve runs, with fifteen chosen coordinates at the root, come first, three of them ahead, so that the others
need not do large groups again. Then recall is measured: ``PROBES`` classes against all, by sketches; while less than ``RECALL`` of their pairs are
connected, more runs follow on what is still apart, as long as there are coordinates. A node that is large after
``LEVELS`` levels is a group of its own, compared as a whole.

Verification. Edges only route: classes that they connect are compared exactly. A class is sent as the difference of its
n-gram set and that of its group's first class, which is small among near copies; sizes and differences give the exact
similarity of any pair (the difference of two sets is that of their differences from a third one). Groups of more than
a block are compared block against block, in as many tasks as there are partitions; a block has at most ``BLOCK``
classes and ``BLOCK_BYTES`` of n-grams. Links are counted and joined on the spot, pairs are never rows.

Defined results: null text counts as empty; texts without words are copies of each other and similar to nothing
else; repeated rows are copies, too; a null doc_id never is a class's or group's id unless all are null; an empty
table gives no rows; extra columns are ignored. doc_id identifies a document: rows with one doc_id and several
texts share the links of all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..stored import collected, paths, release, written
from ._shared import BASES, Links, Words, components, documents, mix, rolling, small_batches, text_bytes
from .substring_dedup import joined

NGRAM, THRESHOLD = 5, 0.8
COORDINATES, RUNS, LEAF = 64, 12, 64
#: After so many levels, nodes that are still large and not done are compared as a whole.
LEVELS = 4
#: Classes of a block, least and most, and bytes of its n-grams.
LEAST_BLOCK, BLOCK, BLOCK_BYTES = 128, 2048, 32 << 20
#: Places in which a large node is compared with its chosen class.
SALTS = 16
#: A large node is settled if no more than one in so many of its classes is not connected with the others: these join
#: their group, where all are compared exactly.
STRAY = 8
#: Share of equal minima that makes an edge, and that lets a class leave a large node.
LIKE, SAME = 0.55, 0.9
#: Classes that recall is measured with, and the share of their pairs that must be connected.
PROBES, RECALL = 512, 0.99
#: Ids of classes all of whose doc_ids are null start here.
NAMELESS = 1 << 62


def shingles(words: Words, ngram: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every text's word n-grams, repeats included, and the text of each, in order."""
    h = words.hashes()[0]
    many = np.maximum(words.count - ngram + 1, 0)
    starts = np.repeat(words.first, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    full = rolling(h, ngram, BASES[0])[starts] if len(starts) else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(words.count)), many)
    short = np.flatnonzero((words.count > 0) & (words.count < ngram))
    if not len(short):
        return full, doc
    whole = []
    with np.errstate(over="ignore"):
        for d in short.tolist():
            x = np.uint64(words.count[d])
            for v in h[words.first[d] : words.first[d] + words.count[d]]:
                x = mix(x * BASES[1] + v)
            whole.append(x)
    doc, full = np.concatenate([doc, short]), np.concatenate([full, np.array(whole, np.uint64)])
    order = np.argsort(doc, kind="stable")
    return full[order], doc[order]


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    x = mix(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * BASES[0])
    return x[:COORDINATES] | np.uint64(1), x[COORDINATES:]


def sketches(hashes: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """n x COORDINATES minima (int32); rows of texts without n-grams are zero."""
    out = np.zeros((n, COORDINATES), np.int32)
    if len(hashes):
        first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        own = doc[first]
        with np.errstate(over="ignore"):
            for i, (a, b) in enumerate(zip(*_multipliers(), strict=True)):
                out[own, i] = (np.minimum.reduceat((hashes ^ b) * a, first) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, rid, f1, f2 (a 128-bit hash of the words), sketch."""

    def run(batches):
        for batch in small_batches(batches):
            words = Words(batch.column("text"))
            prints = np.frombuffer(b"".join(xxhash.xxh3_128_digest(t.as_buffer()) for t in joined(words, np.ones(len(words.doc), bool))), "<i8").reshape(-1, 2)
            sketch = sketches(*shingles(words), batch.num_rows)
            arrays = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * COORDINATES), pa.array(sketch.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("rid"), pa.array(prints[:, 0]), pa.array(prints[:, 1]), pa.array(words.count), arrays], names=["doc_id", "rid", "f1", "f2", "n_words", "sketch"])

    return docs.mapInArrow(run, "doc_id long, rid long, f1 long, f2 long, n_words long, sketch array<int>")


def classes(signed: DataFrame) -> DataFrame:
    """node (the smallest doc_id), copies, rep (doc_id and rid of its row), f1, f2, n_words, sketch."""
    rep = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "rid")
    found = signed.groupBy("f1", "f2").agg(F.min(rep).alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n_words").alias("n_words"), F.first("sketch").alias("sketch"))
    return found.withColumn("node", F.coalesce("rep.doc_id", F.lit(NAMELESS) + F.col("f1").bitwiseAND(NAMELESS - 1)))


def _chosen(path: Column) -> Column:
    """The coordinates that a node chooses: one, and in a quarter of nodes another."""
    one = F.pmod(F.xxhash64(path, F.lit(1)), F.lit(COORDINATES))
    two = F.pmod(one + 1 + F.pmod(F.xxhash64(path, F.lit(2)), F.lit(COORDINATES - 1)), F.lit(COORDINATES))
    return F.when(F.pmod(F.xxhash64(path, F.lit(3)), F.lit(4)) == 0, F.array(one, two)).otherwise(F.array(one))


def _children(at: DataFrame) -> DataFrame:
    """path, node, label of the children of (path, node, sketch, label)."""
    down = at.select("node", "path", "sketch", "label", F.explode(_chosen(F.col("path"))).alias("i"))
    return down.select(F.xxhash64("path", "i", F.element_at("sketch", (F.col("i") + 1).cast("int"))).alias("path"), "node", "label")


def _compared(leaves: DataFrame, nodes: DataFrame, groups: int) -> DataFrame:
    """Edges (a, b) inside the leaf nodes (path, node): least-first spanning edges of pairs that are alike."""
    members = leaves.groupBy("path").agg(F.sort_array(F.collect_set("node")).alias("members")).where("size(members) > 1")
    members = members.select("members").distinct().select(F.xxhash64("members").alias("leaf"), F.explode("members").alias("node"))

    def run(table: pa.Table) -> pa.Table:
        leaf, node = table.column("leaf").to_numpy(), table.column("node").to_numpy()
        sketch = table.column("sketch").combine_chunks().flatten().to_numpy().reshape(-1, COORDINATES)
        order = np.lexsort((node, leaf))
        leaf, node, sketch = leaf[order], node[order], sketch[order]
        links = Links(len(node))
        begins = np.flatnonzero(np.append(True, leaf[1:] != leaf[:-1]))
        left, right = [], []
        for i, j in zip(begins.tolist(), [*begins[1:].tolist(), len(leaf)], strict=True):
            own = sketch[i:j]
            for k in range(j - i - 1):
                hit = np.flatnonzero((own[k + 1 :] == own[k]).mean(axis=1) >= LIKE)
                left.append(np.full(len(hit), i + k))
                right.append(i + k + 1 + hit)
        links.join(np.concatenate(left), np.concatenate(right)) if left else None
        roots = links.roots()
        other = roots != np.arange(len(roots))
        return pa.table({"a": node[other], "b": node[roots[other]]})

    rows = members.join(nodes.select("node", "sketch"), "node").withColumn("g", F.pmod(F.xxhash64("leaf", F.lit(5)), F.lit(groups)))
    return rows.groupBy("g").applyInArrow(run, "a long, b long")


def _roots(run: int, runs: int) -> list[int]:
    """The coordinates of the roots of ``runs`` runs from ``run`` on: one each, every fourth run another; none twice."""
    order = np.random.default_rng(11).permutation(COORDINATES).tolist()
    return order[run + run // 4 : run + runs + (run + runs) // 4]


def _sizes(at: DataFrame, labelled: bool, last: bool) -> DataFrame:
    """path, n, m, top (members, those of the commonest label, that label) and b of the nodes of (path, node, label) that
    need comparison. b, of large nodes: the class that all others are compared with, of the ``last`` level the least one."""
    h = F.col("node") if last else F.xxhash64("node", F.lit(6))
    own = [F.count(F.lit(1)).alias("n"), F.min(h).alias("h"), F.min_by("node", h).alias("b")]
    if not labelled:
        nodes = at.groupBy("path").agg(*own).where("n > 1").select("path", "n", F.lit(0).cast("long").alias("m"), F.lit(None).cast("long").alias("top"), "b")
    else:
        sizes = at.groupBy("path", "label").agg(*own)
        most = F.max(F.struct(F.when(F.col("label").isNotNull(), F.col("n")).otherwise(0).alias("m"), "label"))
        # one that nothing is connected to yet is chosen first
        pick = F.min(F.struct(F.lit(False).alias("old") if last else F.col("label").isNotNull().alias("old"), "h", "b"))
        nodes = sizes.groupBy("path").agg(F.sum("n").alias("n"), most.alias("top"), pick["b"].alias("b"))
        # what edges connect already needs no comparison
        nodes = nodes.where("n > 1 and top.m < n").select("path", "n", F.col("top.m").alias("m"), F.col("top.label").alias("top"), "b")
    return nodes.withColumn("b", F.when(F.col("n") > LEAF, F.col("b")))


def candidate_edges(nodes: DataFrame, first: list[int]) -> DataFrame:
    """Edges (a, b) that connect all pairs of (node, sketch, label) found by the paths from roots with the coordinates
    ``first``. label: a class that edges connect it to already, or null; without that column all are null.

    A level is few jobs, as each of them, whatever its rows, leaves plans, metrics and threads in the driver, which are
    collected after it."""
    spark = nodes.sparkSession
    groups = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    roots = F.explode(F.array(*[F.xxhash64(F.lit(i), F.element_at("sketch", i + 1)) for i in first]))
    labelled = "label" in nodes.columns
    at = nodes.select(roots.alias("path"), "node", "label" if labelled else F.lit(None).cast("long").alias("label"))
    edges, leaves = [], []
    sketch = nodes.select("node", "sketch")
    for level in range(1, LEVELS + 1):
        at = written(at, "members")
        sizes = written(_sizes(at, labelled or level > 1, level == LEVELS), "sizes")
        # paths of large nodes are few: joined on their own, their members aren't sent to one task a path
        heavy = sizes.where(F.col("n") > LEAF)
        small = at.join(heavy.select("path"), "path", "left_anti").join(sizes.where(F.col("n") <= LEAF).select("path"), "path", "left_semi")
        leaves.append(small.select("path", "node"))
        if heavy.isEmpty():
            break
        if level == LEVELS:
            edges.append(at.join(heavy.select("path", "b"), "path").select(F.col("node").alias("a"), "b"))
            break
        settled = (F.col("n") - F.col("m")) * STRAY <= F.col("n")
        if labelled or level > 1:
            strays = at.join(heavy.where(settled).select("path", "top"), "path").where(~F.col("label").eqNullSafe(F.col("top")))
            edges.append(strays.select(F.col("node").alias("a"), F.col("top").alias("b")))
        heavy = heavy.where(~settled)
        large = at.join(heavy.select("path"), "path")
        chosen = heavy.select("path", "b").join(sketch.select(F.col("node").alias("b"), F.col("sketch").alias("to")), "b")
        alike = F.expr(f"aggregate(zip_with(sketch, to, (x, y) -> int(x = y)), 0, (s, x) -> s + x) / {COORDINATES}")
        # a node's members meet its chosen class in SALTS places, so a hot node isn't one task's
        salt = F.pmod(F.xxhash64("node", F.lit(4)), F.lit(SALTS)).alias("salt")
        chosen = chosen.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        seen = large.join(sketch, "node").select("path", "node", "sketch", "label", salt).join(chosen, ["path", "salt"])
        seen = written(seen.select("path", "node", "sketch", "b", "label", alike.alias("alike")), "seen")
        edges.append(seen.where(F.col("alike") >= LIKE).select(F.col("node").alias("a"), "b"))
        near, goes = F.col("alike") >= LIKE, (F.col("alike") < SAME) & (F.col("node") != F.col("b"))
        left = seen.groupBy("path").agg(F.min(F.when(near, F.col("label"))).alias("to"), F.sum(goes.cast("int")).alias("left"))
        rest = seen.where(goes).join(left.where("left > 1"), "path")
        rest = written(rest.withColumn("label", F.when(near, F.coalesce("to", "b")).otherwise(F.col("label"))), "rest")
        leaves.append(rest.where(F.col("left") <= LEAF).select("path", "node"))
        at = _children(rest.where(F.col("left") > LEAF))
        collected(spark)
    every = leaves[0]
    for x in leaves[1:]:
        every = every.unionByName(x)
    found = _compared(every, nodes, groups)
    for x in edges:
        found = found.unionByName(x)
    return found


def measured_recall(nodes: DataFrame, clusters: DataFrame, probes: int = PROBES, threshold: float = THRESHOLD) -> float:
    """Share of the similar pairs of ``probes`` classes with all others that are in one cluster; similar by sketches.

    The probes, a fixed number of classes least by a hash, are on the driver and with every task; all else is counted.
    """
    known = nodes.select("node", "sketch").join(clusters, "node", "left").select("node", "sketch", F.coalesce("root", "node").alias("root"))
    chosen = known.orderBy(F.xxhash64("node", F.lit(8)), "node").limit(probes).collect()
    ids = np.array([r["node"] for r in chosen], np.int64)
    roots = np.array([r["root"] for r in chosen], np.int64)
    own = np.array([r["sketch"] for r in chosen], np.int32).reshape(-1, COORDINATES)
    least = int(np.ceil(threshold * COORDINATES))

    def run(batches):
        for batch in batches:
            node, root = batch.column("node").to_numpy(), batch.column("root").to_numpy()
            sketch = np.ascontiguousarray(batch.column("sketch").flatten().to_numpy().reshape(-1, COORDINATES).T)
            similar = connected = 0
            for i, s, r in zip(ids, own, roots, strict=True):
                equal = np.zeros(len(node), np.int8)
                for k in range(COORDINATES):
                    equal += sketch[k] == s[k]
                hit = (equal >= least) & (node != i)
                similar, connected = similar + int(hit.sum()), connected + int((root[hit] == r).sum())
            yield pa.RecordBatch.from_arrays([pa.array([similar]), pa.array([connected])], names=["similar", "connected"])

    row = known.mapInArrow(run, "similar long, connected long").agg(F.sum("similar").alias("s"), F.sum("connected").alias("c")).first()
    return row["c"] / row["s"] if row["s"] else 1.0


def clusters_of(nodes: DataFrame, runs: int, recall: float = RECALL) -> DataFrame:
    """(node, root) of classes that paths connect: a quarter of ``runs`` runs, the rest of them on what these have left
    apart, and as many again until the recall is reached."""
    spark, made, run, found = nodes.sparkSession, len(paths()), 0, None
    known = nodes = nodes.select("node", "sketch")
    while True:
        some = max(runs // 4, 1) if not run else max(runs - run, 0) or runs
        new = candidate_edges(known, _roots(run, some))
        # the clusters so far stand for all edges of earlier runs
        found = components(new if found is None else new.unionByName(found.select(F.col("node").alias("a"), F.col("root").alias("b"))))
        release(spark, *paths()[made:-1])
        collected(spark)
        run += some
        if run >= runs and (not _roots(run, runs) or measured_recall(nodes, found) >= recall):
            return found
        known = nodes.join(found.withColumnRenamed("root", "label"), "node", "left")


def differences(rows: DataFrame) -> DataFrame:
    """root, node, copies, blocks, block, n (n-grams), gone (the n-grams that the text has and its centre has not, or the
    other way round, as sorted 64-bit hashes) of rows with text and centre (the text of their group's first class)."""
    names = ["root", "node", "copies", "blocks", "block"]

    def run(batches):
        for batch in small_batches(batches):
            grams, doc = shingles(Words(batch.column("text")))
            centres = batch.column("centre").dictionary_encode()
            base, base_doc = shingles(Words(centres.dictionary))
            ends = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            base_ends = np.searchsorted(base_doc, np.arange(len(centres.dictionary) + 1))
            base_sets = [np.unique(base[i:j]) for i, j in zip(base_ends[:-1], base_ends[1:], strict=True)]
            size, gone = [], []
            for k, c in enumerate(centres.indices.to_pylist()):
                one = np.unique(grams[ends[k] : ends[k + 1]])
                size.append(len(one))
                gone.append(np.setxor1d(one, base_sets[c], assume_unique=True).astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(size, pa.int64()), pa.array(gone, pa.binary())], names=[*names, "n", "gone"])

    return rows.mapInArrow(run, "root long, node long, copies long, blocks int, block int, n long, gone binary")


def _linked(table: pa.Table, threshold: float) -> pa.Table:
    """node, links (to copies of other nodes) and b (a linked node no greater) of all groups or block pairs."""
    keys = [table.column(c).to_numpy() for c in ("root", "bi", "bj")]
    node, block, copies, n = (table.column(c).to_numpy() for c in ("node", "block", "copies", "n"))
    gone = table.column("gone").to_pylist()
    size = np.array([len(x) // 8 for x in gone], np.int64)
    h = np.frombuffer(b"".join(gone), "<u8")
    start = np.cumsum(size) - size
    order = np.lexsort((node, *keys[::-1]))
    total, links = np.zeros(len(node), np.int64), Links(len(node))
    rank = np.empty(len(node), np.int64)  # union-find roots are least by node
    rank[np.argsort(node, kind="stable")] = np.arange(len(node))
    change = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    for rows in np.split(order, np.flatnonzero(change) + 1):
        cross = keys[1][rows[0]] != keys[2][rows[0]]
        for a, b in _pairs(rows, h, start, size, n, block if cross else None, threshold):
            np.add.at(total, a, copies[b])
            np.add.at(total, b, copies[a])
            links.join(rank[a], rank[b])
    at = np.empty(len(node), np.int64)
    at[rank] = node
    return pa.table({"node": node, "links": total, "b": at[links.roots()[rank]]})


def _pairs(rows: np.ndarray, h: np.ndarray, start: np.ndarray, size: np.ndarray, n: np.ndarray, block: np.ndarray | None, threshold: float, step: int = 1024):
    """Pairs (as two arrays) of ``rows`` with a similarity of at least ``threshold``; across blocks if given.

    Row r has n[r] n-grams, and h[start[r]:][:size[r]] tells it from its group's centre. What two differences share is
    counted by products of 0/1 matrices, ``step`` n-grams at a time; memory holds one count a pair of the two blocks.
    """
    if len(rows) < 2:
        return
    sides = [rows, rows] if block is None else [rows[block[rows] == k] for k in np.unique(block[rows])]
    if len(sides) < 2:
        return
    own = np.repeat(np.arange(len(rows)), size[rows])
    at = np.arange(size[rows].sum()) + np.repeat(start[rows] - (np.cumsum(size[rows]) - size[rows]), size[rows])
    _, column, many = np.unique(h[at], return_inverse=True, return_counts=True)
    shared = many > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    own, column = rows[own[keep]], number[column[keep]]
    by = np.argsort(column, kind="stable")
    own, column = own[by], column[by]
    place = []  # where a row stands on either side, -1 if nowhere
    for side in sides:
        p = np.full(len(size), -1, np.int64)
        p[side] = np.arange(len(side))
        place.append(p)
    both = np.zeros((len(sides[0]), len(sides[1])), np.float32)
    for low in range(0, int(shared.sum()), step):
        i, j = np.searchsorted(column, [low, low + step])
        parts = []
        for side, p in zip(sides, place, strict=True):
            to = p[own[i:j]]
            part = np.zeros((len(side), step), np.float32)
            part[to[to >= 0], column[i:j][to >= 0] - low] = 1
            parts.append(part)
        for k in range(0, len(both), 512):
            both[k : k + 512] += parts[0][k : k + 512] @ parts[1].T
    grams, differ = [n[x].astype(np.float64) for x in sides], [size[x].astype(np.float64) for x in sides]
    for i in range(0, len(both), 256):  # a few rows at a time, to bound memory
        all_grams = grams[0][i : i + 256, None] + grams[1][None, :]
        apart = differ[0][i : i + 256, None] + differ[1][None, :] - 2 * both[i : i + 256]  # n-grams of one of the two
        a, b = np.nonzero(all_grams - apart >= threshold * (all_grams + apart) - 1e-6)
        a += i
        if block is None:
            a, b = a[a < b], b[a < b]
        if len(a):
            yield sides[0][a], sides[1][b]


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, runs: int = RUNS, batch_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, rid, class_id, copies, n_links, component_id, kept: one row per row of ``docs``.

    class_id: smallest doc_id with the same words. n_links: other documents with similarity >= ``threshold``.
    component_id: smallest doc_id that links reach. kept: true for one row of each group.
    """
    spark = docs.sparkSession
    df = documents(docs)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    signed = written(signatures(df), "signatures")
    nodes = written(classes(signed), "classes")
    before = len(paths())
    clusters = clusters_of(nodes.where("n_words > 0"), runs)
    sizes = clusters.join(nodes.select("node", "n_words"), "node").groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.sum("n_words").alias("words"))
    members = clusters.join(sizes, "root").join(nodes.select("node", "copies", "rep"), "node")
    # a large group has about as many pairs of blocks as there are partitions
    room = F.least(F.greatest(F.col("size") / (2 * parts) ** 0.5, F.lit(float(LEAST_BLOCK))), F.lit(float(BLOCK)))
    blocks = F.ceil(F.greatest(F.col("size") / room, F.col("words") * 8 / BLOCK_BYTES)).cast("int")
    members = members.select("root", "node", "copies", F.col("rep.doc_id").alias("d"), F.col("rep.rid").alias("r"), blocks.alias("blocks"))
    members = members.withColumn("block", F.pmod(F.xxhash64("node", F.lit(9)), "blocks").cast("int"))
    # one row of each class has its text
    texts = df.join(members, df.rid.eqNullSafe(members.r) & df.doc_id.eqNullSafe(members.d)).select("root", "node", "copies", "blocks", "block", "text")
    if signed.groupBy("doc_id", "rid").count().where("count > 1").limit(1).count():
        texts = texts.dropDuplicates(["root", "node"])
    texts = written(texts, "texts")
    centres = texts.where("node = root").select("root", F.col("text").alias("centre"))
    told = differences(texts.join(centres, "root").select("root", "node", "copies", "blocks", "block", "text", "centre"))
    told = told.withColumn("to", F.explode(F.expr("sequence(0, blocks - 1)")))
    told = told.withColumn("bi", F.least("block", "to")).withColumn("bj", F.greatest("block", "to"))
    groups = max(-(-text_bytes(df) // batch_bytes), 4 * parts)
    g = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(groups))).otherwise(F.xxhash64("root", "bi", "bj"))
    found = told.select("root", "bi", "bj", "block", "node", "copies", "n", "gone", g.alias("g")).groupBy("g")
    made = len(paths())
    found = written(found.applyInArrow(lambda t: _linked(t, threshold), "node long, links long, b long"), "links")
    release(spark, *paths()[before:made])
    collected(spark)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.where("node <> b").select(F.col("node").alias("a"), "b"))
    per = nodes.select("f1", "f2", "node", "copies", "rep").join(links, "node", "left").join(roots, "node", "left")
    per = per.select("f1", "f2", "node", "rep", "copies", F.coalesce("root", "node").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = signed.select("doc_id", "rid", "f1", "f2").join(per, ["f1", "f2"])
    named = lambda c: F.when(F.col(c) < NAMELESS, F.col(c))
    kept = (F.col("node") == F.col("root")) & F.col("doc_id").eqNullSafe(F.col("rep.doc_id")) & (F.col("rid") == F.col("rep.rid"))
    return out.select("doc_id", "rid", named("node").alias("class_id"), "copies", "n_links", named("root").alias("component_id"), kept.alias("kept"))


def op10_jaccard_join(spark, sf_dir: str) -> DataFrame:
    found = jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "class_id", "n_links", "component_id", "kept")


OP10_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
c AS (SELECT doc_id, w, min(doc_id) OVER (PARTITION BY w) AS class_id, count(*) OVER (PARTITION BY w) AS copies FROM t),
u AS (SELECT class_id, any_value(w) AS w, any_value(copies) AS copies FROM c GROUP BY class_id),
s AS (SELECT DISTINCT class_id, unnest(CASE WHEN len(w) < 5 THEN [w] ELSE list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4]) END) AS g
      FROM u WHERE len(w) > 0),
n AS (SELECT class_id, count(*) AS n FROM s GROUP BY class_id),
p AS (SELECT a.class_id AS a, b.class_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.class_id <> b.class_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.class_id = p.a JOIN n y ON y.class_id = p.b WHERE 10 * i >= 8 * (x.n + y.n - i)),
r(a, b) AS (SELECT class_id, class_id FROM u UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
k AS (SELECT l.a, sum(u.copies) AS links FROM l JOIN u ON u.class_id = l.b GROUP BY l.a)
SELECT c.doc_id, c.class_id, CAST(coalesce(k.links, 0) + c.copies - 1 AS BIGINT) AS n_links, m.component_id, c.doc_id = m.component_id AS kept
FROM c JOIN m ON m.a = c.class_id LEFT JOIN k ON k.a = c.class_id
"""
