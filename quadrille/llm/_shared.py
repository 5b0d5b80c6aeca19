"""Helpers that every operator of this subpackage uses: column picking, word arrays, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..stored import collected, paths, release, written

#: The white space that contracts name as [\x20\x09-\x0D].
WHITE = " \t\n\x0b\x0c\r"

def pick(df: DataFrame, **names: str) -> DataFrame:
    """The columns ``names`` (new name -> name in ``df``), by exact spelling first.

    Extra columns whose names clash, also those that differ in case only, do no harm: columns are taken by
    position. The first of several with the same name counts.
    """
    have = df.columns
    lower = [c.lower() for c in have]
    plain = df.toDF(*[f"c{i}" for i in range(len(have))])
    at = {new: have.index(old) if old in have else lower.index(old.lower()) for new, old in names.items()}
    return plain.select(*[F.col(f"c{i}").alias(new) for new, i in at.items()])


def documents(docs: DataFrame, *extra: str) -> DataFrame:
    """doc_id long, text string (null counts as empty), and ``rid`` long, a hash of both.

    (doc_id, rid) is a row's identity in joins: it needs no generated row numbers, which a retried task could
    number anew. Rows that agree in both are repeated rows and share every decision.

    Sets the session's limit on an Arrow batch to 16 MB, so long texts don't fill a Python worker's memory.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    df = pick(docs, doc_id="doc_id", text="text", **{x: x for x in extra})
    return df.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.xxhash64("doc_id", "text").alias("rid"),
        *extra,
    )


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts: one number, to size batches and buckets by."""
    return docs.agg(F.sum(F.octet_length(F.col("text")).cast("long"))).first()[0] or 0


def small_batches(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches to about ``limit`` bytes of ``column``, so memory doesn't follow text length.

    A text longer than ``limit`` gets a batch of its own.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        sizes = np.nan_to_num(np.asarray(pc.binary_length(batch.column(at)).to_numpy(zero_copy_only=False), dtype=np.float64))
        ends, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


BLANKS = np.zeros(256, dtype=bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True
#: All ASCII but letters, for words without punctuation; and ASCII letters folded to lower case.
NO_LETTERS = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])
FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a batch of texts, or others by ``delimiters``, as flat arrays.

    count[d]: words of text d. first[d]: index of its first word. codes: an int32 per word, equal for equal
    words of the batch. distinct: the Arrow array that codes point into.
    """

    def __init__(self, texts: pa.Array, delimiters: np.ndarray = BLANKS, fold: np.ndarray | None = None):
        texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
        raw = texts.buffers()[2] if n else None
        data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        inside = ~delimiters[data]
        before = np.empty_like(inside)
        before[:1] = False
        before[1:] = inside[:-1]
        before[offsets[:-1][offsets[:-1] < len(data)]] = False  # a text's first byte follows nothing
        starts = np.flatnonzero(inside & ~before)
        kept = data[inside] if fold is None else fold[data[inside]]
        rank = np.cumsum(inside, dtype=np.int64)  # bytes kept up to and with each
        words = np.append(rank[starts] - 1, len(kept)) if len(starts) else np.zeros(1, np.int64)
        self.first = np.searchsorted(starts, offsets[:-1])
        self.count = np.searchsorted(starts, offsets[1:]) - self.first
        self.arrow = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(words.astype(np.int64)), pa.py_buffer(kept)])
        coded = self.arrow.dictionary_encode()
        self.codes = coded.indices.to_numpy(zero_copy_only=False)
        self.distinct = coded.dictionary
        self.doc = np.repeat(np.arange(n), self.count)

    def listed(self) -> list[bytes]:
        """``distinct`` as a list; words hold no blank, so one can part them."""
        n = len(self.distinct)
        if not n:
            return []
        size = np.diff(np.frombuffer(self.distinct.buffers()[1], np.int64)[self.distinct.offset : self.distinct.offset + n + 1])
        at = int(np.frombuffer(self.distinct.buffers()[1], np.int64)[self.distinct.offset])
        out = np.full(int(size.sum()) + n, 32, np.uint8)
        inside = np.ones(len(out), bool)
        inside[np.cumsum(size + 1) - 1] = False
        out[inside] = np.frombuffer(self.distinct.buffers()[2], np.uint8)[at : at + int(size.sum())]
        return out.tobytes().split(b" ")[:-1]

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes a word, the halves of its XXH3-128."""
        whole = b"".join(xxhash.xxh3_128_digest(w) for w in self.listed())
        pairs = np.frombuffer(whole, dtype="<u8").reshape(-1, 2)
        return pairs[self.codes, 0].copy(), pairs[self.codes, 1].copy()


class Ragged:
    """Arrays of numbers by key, end to end in one array."""

    def __init__(self, kind: type = np.uint32):
        self.code: dict = {}
        self.flat, self.size, self.start = np.zeros(0, kind), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, keys: list, values: np.ndarray, sizes: np.ndarray) -> None:
        self.code.update(zip(keys, range(len(self.size), len(self.size) + len(keys)), strict=True))
        self.flat, self.size = np.concatenate([self.flat, values.astype(self.flat.dtype)]), np.concatenate([self.size, sizes])
        self.start = np.cumsum(self.size) - self.size

    def codes(self, keys: list) -> np.ndarray:
        return np.fromiter(map(self.code.__getitem__, keys), dtype=np.int64, count=len(keys))

    def take(self, codes: np.ndarray) -> np.ndarray:
        size = self.size[codes]
        return self.flat[np.arange(size.sum()) + np.repeat(self.start[codes] - (np.cumsum(size) - size), size)]


#: Odd multipliers of the polynomial hashes, modulo 2**64.
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def rolling(hashes: np.ndarray, width: int, base: np.uint64) -> np.ndarray:
    """A polynomial hash of every run of ``width`` consecutive values; runs may cross texts, so mask them.

    Coefficients are random 64-bit word hashes, so runs that differ collide with a chance of about 2**-60.
    """
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    # doubling: hash of 2**k values from two of 2**(k-1)
    out, done, power, part, size = np.zeros(n, np.uint64), 0, base, hashes, 1
    bits = width
    with np.errstate(over="ignore"):
        while bits:
            if bits & 1:
                out = out * power + part[done : done + n]
                done += size
            bits >>= 1
            if bits:
                part = part[: len(part) - size] * power + part[size:]
                power = power * power
                size *= 2
    return mix(out)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit value over all (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def per_batch(function: Callable[[pa.RecordBatch], pa.RecordBatch | None], column: str = "text", limit: int = 4 << 20):
    """A mapInArrow function that hands ``function`` small batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, column, limit):
            if (out := function(batch)) is not None:
                yield out

    return run


class Links:
    """Union-find over 0..n-1 with the smallest index of a set as its root."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Links a[i] with b[i]: hooks roots on smaller ones and halves paths until nothing changes."""
        a, b = np.asarray(a), np.asarray(b)
        while len(a):
            ra, rb = self.roots()[a], self.up[b]
            differ = ra != rb
            if not differ.any():
                return
            a, b = a[differ], b[differ]
            np.minimum.at(self.up, np.maximum(ra, rb)[differ], np.minimum(ra, rb)[differ])

    def roots(self) -> np.ndarray:
        while True:
            up = self.up[self.up]
            if np.array_equal(up, self.up):
                return up
            self.up = up


#: Edges that one task connects, at most: some 200 MB of its Python worker.
LOCAL = 1 << 20


def _connected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, root of all edges (a, b) of a task."""
    sides = [(batch.column("a").to_numpy(), batch.column("b").to_numpy()) for batch in batches if batch.num_rows]
    if sides:
        a, b = (np.concatenate(x) for x in zip(*sides, strict=True))
        node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        links = Links(len(node))
        links.join(at[: len(a)], at[len(a) :])
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(node[links.roots()])], names=["node", "root"])


def components(edges: DataFrame, tag: str = "cc", local: int | None = None) -> DataFrame:
    """(node, root) for every node of ``edges`` (a long, b long): root is the smallest node it reaches.

    Each round sends every node's neighbours and itself to the smallest neighbour (large star), then every
    node and its smaller neighbours to the smallest (small star); rounds are logarithmic in the longest path.
    Rows stay linear in the edges, minima are combined before the shuffle, and joins on hot nodes can be
    split. Each round is written to the shared folder, so lineage doesn't grow. The minima tell when all edges are
    stars (each node but the smallest has one neighbour, and that is smaller): no further round has to show it, and they
    are the result.

    As soon as a round has no more than ``local`` edges (``LOCAL`` if not given), one task connects them: a round is some
    twenty jobs, whose plans, metrics and threads the driver holds, however few the edges are.
    """
    spark, made, local = edges.sparkSession, len(paths()), LOCAL if local is None else local
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), tag)
    while True:
        if now.count() <= local:
            roots = written(now.coalesce(1).mapInArrow(_connected, "node long, root long"), tag)
            release(spark, *paths()[made:-1])
            return roots
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # minima are tables of their own, so that the joins below are plain ones, which can split a hot node
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        low = written(low.select("a", F.least("a", "m").alias("m"), ((F.col("m") < F.col("a")) & (F.col("n") > 1)).alias("open")), tag)
        if low.where("open").isEmpty():
            release(spark, *paths()[made:-1])
            return low.select(F.col("a").alias("node"), F.col("m").alias("root"))
        large = both.join(low.select("a", "m"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.where("a <> b").distinct(), tag)
        least = written(large.groupBy("a").agg(F.min("b").alias("m")), tag)
        small = large.join(least, "a")
        small = small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b")
        now = written(small.distinct(), tag)
        release(spark, *paths()[made:-1])
        collected(spark)
