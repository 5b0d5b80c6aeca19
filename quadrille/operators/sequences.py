"""Order: ranks, prefix sums, batches, splits and summaries over sorted rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..stored import written


#: Rows a partition that ``monotonically_increasing_id`` leaves room for.
_ROOM = 33


def _hashable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _hashable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (T.MapType, T.VariantType))


def _in_order(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` range-partitioned and sorted by ``order``, written once, with _part and _rank (from 0 in each part).

    Written, because range bounds are sampled and partitions coalesced anew in every exchange: two plans over the
    same rows would number other partitions. Rows that agree in ``order`` are told apart by a hash of their other
    columns, so a value that a third of all rows hold is spread and a retry numbers rows alike; only equal rows
    are interchangeable.
    """
    rest = [F.col(f"`{f.name}`") for f in df.schema.fields if f.name not in order and _hashable(f.dataType)]
    keys = [*[F.col(c) for c in order], *([F.xxhash64(*rest)] if rest else [])]
    rows = written(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    return rows.withColumn("_part", F.shiftright("_at", _ROOM)).withColumn("_rank", F.col("_at").bitwiseAND((1 << _ROOM) - 1)).drop("_at")


def _offset(rows: DataFrame, total: Column) -> DataFrame:
    """``rows`` with _base, the sum of ``total`` over the parts before. One row a part meets in one task."""
    sums = rows.groupBy("_part").agg(total.alias("_n"))
    bases = sums.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_base"))
    return rows.join(F.broadcast(bases), "_part")


def dense_ids(df: DataFrame, order: list[str], name: str = "fid") -> DataFrame:
    """0-based ids in the order of ``order`` without a window over all rows: rank in the part, plus the rows before
    the part. Writes ``df`` once, in order, to the shared folder."""
    own = _offset(_in_order(df, order), F.count(F.lit(1)))
    return own.withColumn(name, (F.col("_base") + F.col("_rank")).cast("long")).drop("_part", "_rank", "_base")


def running_totals(df: DataFrame, order: list[str], size: str, name: str = "before") -> DataFrame:
    """The sum of ``size`` over all rows before, in the order of ``order``, without a window over all rows."""
    own = _offset(_in_order(df, order), F.sum(size))
    inside = F.sum(size).over(Window.partitionBy("_part").orderBy("_rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(size)
    return own.withColumn(name, F.col("_base") + inside).drop("_part", "_rank", "_base")


def unique_ids(df: DataFrame, ident: str, order: list[str], name: str = "uid") -> DataFrame:
    """Whole-number ids without collisions: the first row of an id keeps it, other rows and nulls get new ones above
    the greatest."""
    w = Window.partitionBy(ident).orderBy(*order)
    df = df.withColumn("_keeps", F.col(ident).isNotNull() & (F.row_number().over(w) == 1))
    top = df.agg(F.coalesce(F.max(ident), F.lit(-1)).alias("_top"))
    new = dense_ids(df.where("not _keeps"), order, "_new").crossJoin(F.broadcast(top))
    own = df.where("_keeps").withColumn(name, F.col(ident).cast("long"))
    return own.unionByName(new.withColumn(name, F.col("_top") + 1 + F.col("_new")).drop("_top", "_new")).drop("_keeps")


#: Bytes of a stored table that a task of ``spread`` gets, as far as the session's partitions give it more.
_SHARE = 8 << 20


def spread(df: DataFrame, key: str) -> DataFrame:
    """A stored table by ``key`` over as many partitions as its size asks for, so a task sorts no more rows when the
    table grows; as it is where the session's partitions are enough."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = -(-size // _SHARE)
    return df.repartition(parts, key) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def first_of(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by a total order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def first_n(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows of the ``n`` smallest keys: a top-n (no full sort), then a semi-join."""
    keys = df.select(key).distinct().orderBy(key).limit(n)
    return df.join(F.broadcast(keys), key, "left_semi")


def sampled(df: DataFrame, n: int, key: str, seed: int) -> DataFrame:
    """``n`` rows by a seeded hash of the key."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def stratified_n(df: DataFrame, group: str, key: str, total: int, groups: int) -> DataFrame:
    """The ``total // groups`` smallest keys of each group."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(key))
    return df.withColumn("rank", rank).where(F.col("rank") <= total // groups)


def capped_groups(df: DataFrame, group: str, cap: int) -> DataFrame:
    """Whole groups in their order until the running total of rows reaches ``cap``."""
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    return running_totals(counts, [group], "n").where(F.col("before") < cap)


def split(df: DataFrame, group: str, order: list[Column], shares: tuple[float, float] = (0.8, 0.1)) -> DataFrame:
    """train, val or test by rank inside each group."""
    w = Window.partitionBy(group)
    at = (F.row_number().over(w.orderBy(*order)) - 1) / F.count(F.lit(1)).over(w)
    return df.withColumn("split", F.when(at < shares[0], "train").when(at < sum(shares), "val").otherwise("test"))


def encoded_labels(df: DataFrame, column: str) -> DataFrame:
    """(column, code): the distinct values in order, numbered from 0."""
    return dense_ids(df.select(column).distinct(), [column], "code")


def batches(df: DataFrame, tile: list[str], order: list[str], size: int) -> DataFrame:
    """Batches of ``size`` rows that keep to one tile: full ones inside a tile first; the rest of all tiles, in tile
    order, makes mixed ones; a last short one is dropped. Adds batch (text) and slot. ``order`` is total in a tile."""
    w = Window.partitionBy(*tile)
    df = df.withColumn("_rn", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    full = F.floor(F.col("_n") / size) * size
    own = df.where(F.col("_rn") < full)
    own = own.withColumn("batch", F.concat_ws("/", *tile, F.floor(F.col("_rn") / size).cast("string"))).withColumn("slot", F.col("_rn") % size)
    rest = dense_ids(df.where(F.col("_rn") >= full), [*tile, *order], "_at")
    whole = rest.agg((F.floor(F.count(F.lit(1)) / size) * size).alias("_whole"))
    rest = rest.crossJoin(F.broadcast(whole)).where(F.col("_at") < F.col("_whole")).drop("_whole")
    rest = rest.withColumn("batch", F.concat(F.lit("mixed/"), F.floor(F.col("_at") / size).cast("string"))).withColumn("slot", F.col("_at") % size).drop("_at")
    return own.unionByName(rest).drop("_rn", "_n")


def deltas(df: DataFrame, group: list[str], order: str, column: str) -> DataFrame:
    """Difference to the value before, the value itself at the start."""
    w = Window.partitionBy(*group).orderBy(order)
    return df.withColumn("delta", F.col(column) - F.lag(column, 1, 0).over(w))


def prefix_offsets(df: DataFrame, group: list[str], order: str, size: str) -> DataFrame:
    """Where each part starts if parts stand end to end."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("offset", F.sum(size).over(w) - F.col(size))


def runs(df: DataFrame, group: list[str], order: str, value: str) -> DataFrame:
    """Runs of equal values: (group, run, value, first, last, n)."""
    w = Window.partitionBy(*group).orderBy(order)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & F.lag(order).over(w).isNotNull(), 0).otherwise(1)
    # a run ends where the next one starts, so windows over one order do; an aggregation would hold all runs of a task
    df = df.withColumn("_new", new).withColumn("_before", F.lag(order).over(w)).withColumn("_at", F.row_number().over(w))
    every = Window.partitionBy(*group)
    df = df.withColumn("_end", F.max(order).over(every)).withColumn("_rows", F.count(F.lit(1)).over(every)).where("_new = 1")
    last = F.row_number().over(w) == F.count(F.lit(1)).over(every)
    return df.select(*group, F.row_number().over(w).cast("long").alias("run"), value, F.col(order).alias("first"), F.when(last, F.col("_end")).otherwise(F.lead("_before").over(w)).alias("last"), (F.when(last, F.col("_rows") + 1).otherwise(F.lead("_at").over(w)) - F.col("_at")).cast("long").alias("n"))


def whole_groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches sorted by ``key`` cut anew, so that each holds whole groups alone, and where these start, and the end.
    A batch's last group waits for the next one."""

    def given(held: list[pa.RecordBatch]) -> tuple[pa.RecordBatch, np.ndarray]:
        batch = pa.concat_batches(held)
        codes = batch.column(key).dictionary_encode("encode").indices.to_numpy()
        return batch, np.concatenate([[0], np.flatnonzero(codes[1:] != codes[:-1]) + 1, [len(codes)]]).astype(np.int64)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = batch.column(key).dictionary_encode("encode").indices.to_numpy()
        others = np.flatnonzero(codes != codes[-1])
        cut = int(others[-1]) + 1 if len(others) else 0
        if cut or (held and held[-1].column(key)[-1].as_py() != batch.column(key)[0].as_py()):
            yield given([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield given(held)


def in_groups(df: DataFrame, key: str, order: list, run: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """``run`` over batches of whole groups of ``key``, each in the order of ``order``, and where the groups start: many
    small groups a call, where a grouped map makes a call, and a stream of its own, for every one."""

    def every(batches):
        for batch, starts in whole_groups(batches, key):
            yield run(batch, starts)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(every, schema)


def latency_summary(df: DataFrame, value: str, *group: str) -> DataFrame:
    """Interpolated p50 and p95, nearest-rank p95 and p99."""
    return df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.percentile(value, F.lit(0.5)).alias("p50"), F.percentile(value, F.lit(0.95)).alias("p95"),
        F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {value})").alias("p95_nearest"), F.expr(f"percentile_disc(0.99) WITHIN GROUP (ORDER BY {value})").alias("p99_nearest"))


def paired_summary(df: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """n, mean difference, sample deviation (0 for one row) and paired t of a - b."""
    d = F.col(a) - F.col(b)
    out = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean"), F.coalesce(F.stddev_samp(d), F.lit(0.0)).alias("sd"))
    return out.withColumn("t", F.when(F.col("sd") > 0, F.col("mean") / (F.col("sd") / F.sqrt(F.col("n")))))


def knee(df: DataFrame, group: str, k: str, throughput: str, least_gain: float) -> DataFrame:
    """The last k whose throughput exceeds the one before by at least a share, per group; else the first."""
    before = F.lag(throughput).over(Window.partitionBy(group).orderBy(k))
    gains = df.withColumn("_gain", F.when(before.isNotNull(), F.col(throughput) / before - 1))
    return gains.groupBy(group).agg(F.coalesce(F.max(F.when(F.col("_gain") >= least_gain, F.col(k))), F.min(k)).alias("knee"))


def laid_out(df: DataFrame, order: str, width: str, height: str, row_width: float, gap: float) -> DataFrame:
    """Places boxes in rows of a fixed number of equal slots (the widest box): x and y offsets. Raises where the
    widest box exceeds a row."""
    top = df.agg(F.max(width).alias("w"), F.max(height).alias("h")).first()
    if top["w"] is None:
        return df.withColumn("dx", F.lit(0.0)).withColumn("dy", F.lit(0.0))
    slots = int((row_width + gap) // (top["w"] + gap))
    if not slots:
        raise ValueError("a box is wider than a row")
    df = dense_ids(df, [order], "_slot")
    return df.withColumn("dx", (F.col("_slot") % slots) * F.lit(float(top["w"] + gap))).withColumn("dy", F.floor(F.col("_slot") / slots) * F.lit(float(top["h"] + gap))).drop("_slot")
