"""Passages of texts as numbers, and bounded samples of labelled rows, for the classifiers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Words, documents, pick

#: Words of a passage.
PASSAGE = 100
#: Shares of the 128 ASCII characters and of all others (bytes), then word statistics.
CHARACTERS, STATISTICS = 129, 5
WIDTH = CHARACTERS + STATISTICS


def passages(texts: pa.Array, size: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """Each passage's text number and features; a text without words has one passage.

    Features: square roots of byte shares; distinct words by words; words equal to the one before; mean and
    spread of word length; words by ``size``.
    """
    words = Words(texts)
    n = len(texts)
    per = np.maximum(-(-words.count // size), 1)
    base = np.cumsum(per) - per
    whose = np.repeat(np.arange(n), per)
    total = int(per.sum())
    place = np.arange(len(words.doc)) - np.repeat(words.first, words.count)
    passage = base[words.doc] + place // size
    length = np.diff(np.frombuffer(words.arrow.buffers()[1], dtype=np.int64)[: len(words.doc) + 1]) if len(words.doc) else np.zeros(0, np.int64)
    data = np.frombuffer(words.arrow.buffers()[2], dtype=np.uint8) if len(words.doc) else np.zeros(0, np.uint8)
    of_byte = np.repeat(passage, length)
    shares = np.bincount(of_byte * CHARACTERS + np.minimum(data, 128), minlength=total * CHARACTERS).reshape(total, CHARACTERS)
    out = np.zeros((total, WIDTH), np.float32)
    out[:, :CHARACTERS] = np.sqrt(shares / np.maximum(shares.sum(axis=1, keepdims=True), 1))
    count = np.maximum(np.bincount(passage, minlength=total), 1)
    pairs = np.unique(passage * np.int64(len(words.distinct) + 1) + words.codes)
    out[:, CHARACTERS] = np.bincount(pairs // (len(words.distinct) + 1), minlength=total) / count
    same = np.zeros(len(words.doc), bool)
    same[1:] = (words.codes[1:] == words.codes[:-1]) & (passage[1:] == passage[:-1])
    out[:, CHARACTERS + 1] = np.bincount(passage, weights=same, minlength=total) / count
    mean = np.bincount(passage, weights=length, minlength=total) / count
    out[:, CHARACTERS + 2] = np.log1p(mean)
    out[:, CHARACTERS + 3] = np.log1p(np.sqrt(np.maximum(np.bincount(passage, weights=length.astype(float) ** 2, minlength=total) / count - mean**2, 0)))
    out[:, CHARACTERS + 4] = np.bincount(passage, minlength=total) / size
    return whose, out


def remainder(divisor: int):
    """crc32(doc_id as text) mod ``divisor``; null for a null doc_id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor


def held_out(divisor: int, rest: int):
    """Rows that no model learns from; a null doc_id isn't one of them, but has no label either."""
    return F.coalesce(remainder(divisor) == rest, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, columns: list[str], keep, bound: int) -> DataFrame:
    """doc_id, text and label ``columns`` (as float) of at most ``bound`` rows, whole texts of any length, for fitting.

    The bound is a parameter of the fit alone: rows are those least by a hash of doc_id among labelled ones for
    which ``keep`` holds, with all labels known, one per doc_id. Label rows that disagree about a document teach
    nothing.
    """
    known = pick(labels, doc_id="doc_id", **{c: c for c in columns})
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("double").alias(c) for c in columns]).na.drop().where(keep)
    known = known.groupBy("doc_id").agg(*[F.min(c).alias(c) for c in columns], *[F.max(c).alias(f"{c}__most") for c in columns])
    for c in columns:
        known = known.where(F.col(c) == F.col(f"{c}__most")).drop(f"{c}__most")
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    return documents(docs).join(F.broadcast(known), "doc_id").select("doc_id", "text", *columns)
