"""A pipeline for training text: quality, repeated lines, near duplicates, repeated passages, packing.

STAGES lists (name, function). Each function takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns
a DataFrame, which ``run`` writes as Parquet to the shared folder and reads again as the next stage's ``docs``. All
but the last return the columns of documents, with n_chars set anew where the text changed. No stage but the first
(quality) and the third (near duplicates) drops a row; a text that loses all its lines or words stays as an empty one.

Null text counts as empty from the first stage on, and an empty table passes through all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm import jaccard_join, line_dedup, packing, quality, substring_dedup
from quadrille.llm._shared import documents, pick
from quadrille.stored import paths, release, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
CARRIED = ("lang", "source", "n_chars")


def _with_text(df: DataFrame, text: str) -> DataFrame:
    return df.select("doc_id", F.col(text).alias("text"), "lang", "source", F.char_length(text).cast("long").alias("n_chars"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model scores under 0.5 go."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model, CARRIED).where("predicted = 1").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in at least ten documents stay in the first one only, so no text vanishes altogether."""
    return _with_text(line_dedup.line_dedup(docs, min_docs=10, keep_first=True, carry=CARRIED), "kept")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that similarity links, the one with the smallest doc_id stays, once."""
    found = written(jaccard_join.jaccard_join(docs).where("kept").select(F.col("doc_id").alias("d"), F.col("rid").alias("r")), "kept")
    rows = documents(docs, *CARRIED)
    stays = rows.join(found.distinct(), rows.rid.eqNullSafe(F.col("r")) & rows.doc_id.eqNullSafe(F.col("d")), "left_semi")
    if found.groupBy("d", "r").count().where("count > 1").limit(1).count():  # repeated rows
        stays = stays.dropDuplicates(["doc_id", "rid"])
    return stays.select(*COLUMNS)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in runs of 35 that occur elsewhere, too, go."""
    return _with_text(substring_dedup.without_repeats(docs, window=35, carry=CARRIED), "kept")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens, with their ids."""
    return packing.pack(pick(docs, doc_id="doc_id", text="text"), packing.default_tokenizer())


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("jaccard_join", near_duplicate_stage),
    ("substring_dedup", substring_stage),
    ("packing", packing_stage),
]

#: The quality model cannot be written in SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage has written is deleted once the next one's result stands."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), paths()
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(spark, *[p for p in paths()[:-1] if p not in before])
    return docs
