"""Exact deduplication: stateful streaming over a digest log, state on disk, full bytes checked on hits.

Every row's normalised text (all of ``[\\x20\\x09-\\x0D]`` deleted) becomes a digest. A digest that occurs twice in a
call, or that the state already knows, is a hit: the whole normalised texts of its rows are compared with each other
and with the text that the state's locator leads to. Texts that share a digest but not their bytes get a variant
number each. Then (digest, variant) with a stable identifier (doc_id), a content locator (the call whose folder
``content`` has the text, its key, and the row's doc_id and hash of the original text) go to a log that Structured
Streaming drains into RocksDB state keyed by (digest, variant). There is no watermark and so no expiry: a later call
with the same ``state_dir`` goes on from the state that earlier calls left. Only then are contents kept, one text of
each (digest, variant); a call without ``state_dir`` has its contents in ``docs``.

Counts, best rows and compared texts (the least and greatest of a digest) are combined before the shuffle, so a group
that holds a third of all rows sends one row a partition. Texts without a hit mostly stay where they are: Spark's
runtime Bloom filter of the hits, of a fixed size, is applied at their scan.

Defined results: null text counts as empty, and all empty texts are equal; ties go to the smallest doc_id, a null
doc_id last; of repeated rows (same doc_id, same text) each gets a result row, all of them marked like one; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..stored import exists, new_path, release, written
from ._shared import WHITE, documents

STREAM_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",  # memory holds the stores of running tasks only
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "16",
    "spark.sql.streaming.stateStore.rocksdb.blockCacheSizeMB": "8",
}
#: A Bloom filter of at most 8 MB, whatever the sizes of both sides; where it is full, more texts are shuffled.
FILTER_CONF = {
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1000t",
    "spark.sql.optimizer.runtime.bloomFilter.expectedNumItems": "4000000",
    "spark.sql.optimizer.runtime.bloomFilter.numBits": "67108864",
}
KEY = ["digest", "variant"]


@contextmanager
def configured(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def normalised(text: Column) -> Column:
    return F.translate(text, WHITE, "")


def best(n_chars: Column, doc_id: Column, rid: Column) -> Column:
    """Compares least for the row that stays: most code points, then smallest doc_id, null last."""
    return F.struct((-n_chars).alias("less"), doc_id.isNull().alias("unknown"), doc_id.alias("doc_id"), rid.alias("rid"))


def texts(docs: DataFrame) -> DataFrame:
    """doc_id, rid, norm, digest (lowercase hex SHA-256 of the normalised text), n_chars of the original."""
    df = documents(docs).withColumn("norm", normalised(F.col("text")))
    return df.select("doc_id", "rid", "norm", F.sha2("norm", 256).alias("digest"), F.char_length("text").cast("long").alias("n_chars"))


def stream_into_state(log: DataFrame, state_dir: str) -> None:
    """Appends ``log`` to the log in ``state_dir`` and drains it into keyed state."""
    spark = log.sparkSession
    log.write.mode("append").option("compression", "zstd").parquet(f"{state_dir}/log")
    with configured(spark, STREAM_CONF):
        stream = spark.readStream.schema(log.schema).parquet(f"{state_dir}/log")
        keep = F.min(best(F.col("n_chars"), F.col("doc_id"), F.col("rid"))).alias("keep")
        kept = stream.groupBy(*KEY).agg(keep, F.count(F.lit(1)).alias("group_size"), F.max(-F.col("call")).alias("first"))
        query = kept.writeStream.format("noop").outputMode("update").option("checkpointLocation", f"{state_dir}/state").trigger(availableNow=True).start()
        query.awaitTermination()


def state(spark: SparkSession, state_dir: str) -> DataFrame | None:
    """digest, variant, keep (see ``best``), group_size and call (the locator: content/call=N has the text)."""
    if not exists(spark, f"{state_dir}/state"):
        return None
    rows = spark.read.format("statestore").load(f"{state_dir}/state")
    # the state names its values after their functions
    return rows.select("key.*", F.col("value.min").alias("keep"), F.col("value.count").alias("group_size"), (-F.col("value.max")).alias("call"))


def contents(spark: SparkSession, state_dir: str) -> DataFrame:
    """digest, variant, norm and call of the texts that earlier calls have kept."""
    return spark.read.schema("digest string, variant long, norm string, call long").parquet(f"{state_dir}/content")


def clashes(docs: DataFrame, hits: DataFrame, known: DataFrame | None) -> DataFrame:
    """Digests among ``hits`` whose texts, those ``known`` from earlier calls included, do not all have the same bytes.

    The least and greatest text of a digest are taken, combined before the shuffle; where they are equal, all are.
    """
    every = texts(docs).select("digest", "norm")
    spans = every.groupBy("digest").agg(F.min("norm").alias("low"), F.max("norm").alias("high")).join(hits, "digest", "left_semi")
    if known is not None:
        spans = spans.unionByName(known.join(hits, "digest", "left_semi").select("digest", F.col("norm").alias("low"), F.col("norm").alias("high")))
        spans = spans.groupBy("digest").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return spans.where("low <> high").select("digest")


def variants(docs: DataFrame, clashing: DataFrame, known: DataFrame | None) -> DataFrame:
    """digest, norm, variant of the texts of clashing digests; texts that are known keep their number."""
    found = texts(docs).join(clashing, "digest", "left_semi").select("digest", "norm").distinct()
    if known is None:
        return found.withColumn("variant", F.row_number().over(Window.partitionBy("digest").orderBy("norm")).cast("long") - 1)
    both = found.join(known.select("digest", "norm", "variant"), ["digest", "norm"], "left")
    top = known.groupBy("digest").agg(F.max("variant").alias("top"))
    new = both.where("variant is null").drop("variant").join(top, "digest", "left")
    rank = F.row_number().over(Window.partitionBy("digest").orderBy("norm")).cast("long")
    return both.where("variant is not null").unionByName(new.select("digest", "norm", (F.coalesce("top", F.lit(-1).cast("long")) + rank).alias("variant")))


def exact_dedup(docs: DataFrame, state_dir: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, rid, keep_id, group_size, kept, digest.

    With ``state_dir`` (a folder all executors see), rows of earlier calls with the same folder count too, and hits
    on them are checked against the texts kept there.
    """
    spark, lasting = docs.sparkSession, state_dir is not None
    state_dir = state_dir or new_path(spark, "exact-dedup")
    log = written(texts(docs).drop("norm"), "digests")
    old, known = state(spark, state_dir), None
    seen = log.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    if old is not None:
        old = written(old, "old-state")
        known = contents(spark, state_dir)
        seen = seen.join(old.select("digest", F.lit(1).alias("before")).distinct(), "digest", "left").select("digest", (F.col("n") + F.coalesce("before", F.lit(0))).alias("n"))
    call = (old.agg(F.max("call")).first()[0] or 0) + 1 if old is not None else 0
    seen = written(seen, "digest-counts")
    with configured(spark, FILTER_CONF):
        clashing = written(clashes(docs, seen.where("n > 1"), known), "digest-clashes")
    if clashing.isEmpty():
        log = log.withColumn("variant", F.lit(0).cast("long"))
    else:  # different bytes with one digest: told apart by the whole text
        told = written(variants(docs, clashing, known), "variants")
        apart = texts(docs).join(told, ["digest", "norm"]).drop("norm")
        log = written(log.join(clashing, "digest", "left_anti").withColumn("variant", F.lit(0).cast("long")).unionByName(apart), "variant-log")
    log = log.withColumn("call", F.lit(call).cast("long"))
    if lasting:
        new = texts(docs).join(told, ["digest", "norm"], "left") if not clashing.isEmpty() else texts(docs).withColumn("variant", F.lit(None).cast("long"))
        new = new.select("digest", F.coalesce("variant", F.lit(0).cast("long")).alias("variant"), "norm")
        new = new if old is None else new.join(old, KEY, "left_anti")
        new.groupBy(*KEY).agg(F.min("norm").alias("norm")).write.mode("overwrite").option("compression", "zstd").parquet(f"{state_dir}/content/call={call}")
    stream_into_state(log, state_dir)
    now = written(state(spark, state_dir), "digest-state")
    if not lasting:
        release(spark, state_dir)
    kept = F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("rid") == F.col("keep.rid"))
    return log.drop("call").join(now, KEY).select("doc_id", "rid", F.col("keep.doc_id").alias("keep_id"), "group_size", kept.alias("kept"), "digest")


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    found = exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP8_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS raw, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
k AS (SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(raw) DESC, doc_id) AS keep_id,
      count(*) OVER (PARTITION BY norm) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM k
"""
