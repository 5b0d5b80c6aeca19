"""Line deduplication on hashes: texts stay where they are, decisions travel as sparse bitmaps.

Each line becomes a row (128-bit hash of its key, document, position). Rows are range-partitioned
by hash and sorted by hash, document and position, and one pass over the sorted stream finds each key's first
occurrence and its number of documents. Keys so frequent that they would fill a partition (found by a bounded
heavy-hitters sketch, which only routes) skip that shuffle: they are counted with map-side combining and their
totals, a few rows a shuffle partition at most, are broadcast. Decisions return as one map a document from word number
(position div 64) to the 64 drop bits there; words without a dropped line are left out.

A key is the line with all of ``[\\x20\\x09-\\x0D]`` stripped at both ends and A-Z lower-cased. Defined results:
null or empty text has one empty line; keys of under ``min_length`` code points always stay; repeated rows (same
doc_id, same text) are one document and share their decisions; an empty table gives no rows; extra
columns are ignored unless named in ``carry``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..stored import written
from ._shared import WHITE, documents

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A key with more than one part in ``SHARE`` of a shuffle partition's mean rows is heavy.
SHARE = 4


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(WHITE)), UPPER, LOWER)


def occurrences(docs: DataFrame, min_length: int = 1) -> DataFrame:
    """doc_id, rid, h1, h2, pos: one row per line whose key has at least ``min_length`` code points."""
    keys = F.transform(F.split("text", "\n", -1), lambda x: line_key(x))
    lines = documents(docs).select("doc_id", "rid", F.posexplode(keys).alias("pos", "key")).where(F.char_length("key") >= min_length)
    return lines.select("doc_id", "rid", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"), "pos")


def heavy_keys(occ: DataFrame) -> list[int]:
    """First hashes of keys with more than a quarter of a shuffle partition's mean share of rows. No more than
    ``SHARE`` keys a partition can have so many, so none is left out, and their number doesn't follow the data.

    They only choose a row's path. Both paths give the same decisions.
    """
    most = SHARE * int(occ.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    row = occ.agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(h1, {most}, {max(4096, 16 * most)})").alias("top")).first()
    return [x["item"] for x in row["top"] or [] if x["count"] > max(row["n"] // most, 100)]


def drops(docs: DataFrame, min_docs: int, keep_first: bool, min_length: int = 1) -> DataFrame:
    """doc_id, rid, dropped, n_dropped: the bitmap map<int, bigint> of each document that loses lines.

    A key found in at least ``min_docs`` documents loses all its lines or, with ``keep_first``, all but its
    first by (doc_id, rid, position).
    """
    occ = written(occurrences(docs, min_length), "lines")
    heavy = heavy_keys(occ)
    is_heavy = F.col("h1").isin(heavy) if heavy else F.lit(False)

    ordered = Window.partitionBy("h1", "h2").orderBy("doc_id", "rid", "pos")
    light = occ.where(~is_heavy).repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2", "doc_id", "rid", "pos")
    doc = F.struct("doc_id", "rid")
    light = light.select("*", F.rank().over(ordered).alias("nth"), F.coalesce(F.lag(doc).over(ordered) != doc, F.lit(True)).cast("int").alias("new_doc"))
    light = light.withColumn("n_docs", F.sum("new_doc").over(Window.partitionBy("h1", "h2")))
    flagged = light.where(F.col("n_docs") >= min_docs)
    flagged = (flagged.where("nth > 1") if keep_first else flagged).select("doc_id", "rid", "pos")

    if heavy:
        own = occ.where(is_heavy)
        by_doc = own.groupBy("h1", "h2", "doc_id", "rid").agg(F.min("pos").alias("pos"))
        totals = by_doc.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.min(F.struct("doc_id", "rid", "pos")).alias("first"))
        many = own.join(F.broadcast(totals.where(F.col("n_docs") >= min_docs)), ["h1", "h2"])
        many = many.where(F.struct("doc_id", "rid", "pos") != F.col("first")) if keep_first else many
        flagged = flagged.unionByName(many.select("doc_id", "rid", "pos"))

    words = flagged.distinct().groupBy("doc_id", "rid", F.expr("pos div 64").cast("int").alias("word"))
    words = words.agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"), F.count(F.lit(1)).alias("n"))
    return words.groupBy("doc_id", "rid").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("dropped"), F.sum("n").alias("n_dropped"))


def line_dedup(docs: DataFrame, min_docs: int = 2, keep_first: bool = True, min_length: int = 1, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns ``carry``, n_lines, n_dropped, kept (the lines that stay, joined by \n)."""
    found = drops(docs, min_docs, keep_first, min_length).select(F.col("doc_id").alias("d"), F.col("rid").alias("r"), "dropped", "n_dropped")
    df = documents(docs, *carry)
    df = df.join(found, df.rid.eqNullSafe(found.r) & df.doc_id.eqNullSafe(found.d), "left")
    kept = F.expr("array_join(filter(split(text, '\n', -1), (x, i) -> getbit(coalesce(dropped[i div 64], 0L), i % 64) = 0), '\n')")
    return df.select(
        "doc_id",
        *carry,
        F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("dropped").isNull(), F.col("text")).otherwise(kept).alias("kept"),
    )


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    found = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), min_docs=10, keep_first=False, min_length=1)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN f.key IS NULL THEN line END, chr(10) ORDER BY pos), '')) AS kept_sha256
FROM k LEFT JOIN f USING (key) GROUP BY doc_id
"""
