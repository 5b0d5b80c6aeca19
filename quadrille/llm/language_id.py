"""Language identification with hyperdimensional profiles.

Every letter has a random +-1 vector. A letter trigram's vector binds (multiplies) its letters' vectors, each
permuted (rotated) by its place. A text's profile bundles (adds) the vectors of all its trigrams. A language's
prototype bundles its texts' unit profiles; the mean prototype is taken off all of them, since what languages
share tells nothing. A text gets the language whose prototype has the greatest cosine with its profile.

Learning reads every row it may read: partitions add profiles up, and languages x dimensions sums reach the
driver, so the model's size doesn't follow the data. Words are bounded by one blank on either side; letters are
lower-cased; whatever isn't a letter counts as a blank.

A text of any length is read whole; the vectors of ``SLICE`` distinct trigrams are in memory at once.

Defined results: null text, or text without a letter, gives ``und`` and score 0; ties go to the first language by
name; rows with null lang teach nothing; where nothing can be learnt all rows give ``und``; repeated rows get a row
each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._features import held_out
from ._shared import documents, small_batches

DIMENSIONS, SEED = 1024, 20240229
#: Distinct trigrams whose vectors a worker keeps; others are bound anew when met.
CACHE = 12_000
#: Trigrams whose vectors are bundled at once.
SLICE = 4096
#: Sharpness of the score, a softmax over cosines.
SHARPNESS = 20.0


class Trigrams:
    """Counts of letter trigrams in texts, and the trigrams' vectors."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        self.dimensions, self.seed = dimensions, seed
        self.letters: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.table = np.zeros((0, dimensions), np.float32)
        self.lower = np.zeros(0x110000, np.int32)
        self.known = np.zeros(0x110000, bool)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            self.letters[code] = np.random.default_rng([self.seed, code]).choice(np.array([-1, 1], np.int8), self.dimensions)
        return self.letters[code]

    def vectors(self, keys: np.ndarray) -> np.ndarray:
        """One +-1 row per packed trigram."""
        out = np.empty((len(keys), self.dimensions), np.int8)
        for i, key in enumerate(keys.tolist()):
            a, b, c = key >> 42, key >> 21 & 0x1FFFFF, key & 0x1FFFFF
            np.multiply(np.roll(self.letter(a), 2), np.roll(self.letter(b), 1), out=out[i])
            out[i] *= self.letter(c)
        return out

    def codes(self, text: str) -> np.ndarray:
        """Lower-cased letters as code points, 0 for all else, with runs of 0 as one and a 0 at both ends."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        new = np.unique(points)
        for p in new[~self.known[new]].tolist():
            low = chr(p).lower()
            self.lower[p] = ord(low[0]) if chr(p).isalpha() else 0
            self.known[p] = True
        low = np.concatenate([[0], self.lower[points], [0]])
        return low[(low != 0) | np.concatenate([[True], low[:-1] != 0])]

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The texts' distinct packed trigrams in order, then for each trigram and text that has it, in this order: the
        trigram's number, the text's and the count."""
        parts = [self.codes(t).astype(np.int64) for t in texts]
        packed = [x[:-2] << 42 | x[1:-1] << 21 | x[2:] for x in parts]
        keys, at = np.unique(np.concatenate(packed), return_inverse=True)
        doc = np.repeat(np.arange(len(texts)), [len(x) for x in packed])
        pairs, many = np.unique(at * np.int64(len(texts)) + doc, return_counts=True)
        return keys, *np.divmod(pairs, max(len(texts), 1)), many.astype(np.float32)

    def bundles(self, texts: int, keys: np.ndarray, at: np.ndarray, doc: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The sum of the trigrams' vectors times weight, for each text; ``SLICE`` trigrams at a time, so memory
        follows the dimensions, not the trigrams of a text."""
        out = np.zeros((texts, self.dimensions), np.float32)
        for low in range(0, len(keys), SLICE):
            part = keys[low : low + SLICE]
            i, j = np.searchsorted(at, [low, low + len(part)])
            dense = np.zeros((texts, len(part)), np.float32)
            dense[doc[i:j], at[i:j] - low] = weight[i:j]
            out += dense @ self.table_of(part)
        return out

    def table_of(self, keys: np.ndarray) -> np.ndarray:
        """The vectors of ``keys``, from the cache where it has them."""
        at = np.fromiter((self.rows.get(k, -1) for k in keys.tolist()), dtype=np.int64, count=len(keys))
        new = np.flatnonzero(at < 0)
        take = new[: max(0, CACHE - len(self.rows))]
        if len(take):
            if len(self.rows) + len(take) > len(self.table):
                grown = np.empty((min(CACHE, max(2 * len(self.table), len(self.rows) + len(take), 1024)), self.dimensions), np.float32)
                grown[: len(self.rows)] = self.table[: len(self.rows)]
                self.table = grown
            at[take] = np.arange(len(self.rows), len(self.rows) + len(take))
            self.table[at[take]] = self.vectors(keys[take])
            self.rows.update(zip(keys[take].tolist(), at[take].tolist(), strict=True))
        out = self.table[at] if len(self.table) else np.empty((len(keys), self.dimensions), np.float32)
        rest = new[len(take) :]
        if len(rest):
            out[rest] = self.vectors(keys[rest])
        return out


def text_groups(batches):
    """Small batches of at most 256 texts and, unless one text is longer, half a megabyte."""
    for batch in small_batches(batches, limit=1 << 19):
        for start in range(0, batch.num_rows, 256):
            yield batch.slice(start, 256)


def prototypes(docs: DataFrame, dimensions: int = DIMENSIONS, seed: int = SEED) -> tuple[list[str], np.ndarray]:
    """Languages in order, and their centred unit prototypes, from ``docs`` with text and lang."""
    rows = documents(docs, "lang").where("lang is not null").select("text", F.col("lang").cast("string"))

    def run(batches):
        grams, sums = Trigrams(dimensions, seed), {}
        for batch in text_groups(batches):
            keys, at, doc, many = grams.counts(batch.column("text").to_pylist())
            if not len(keys):
                continue
            norm = np.sqrt(np.bincount(doc, weights=many.astype(np.float64) ** 2, minlength=batch.num_rows))
            names, code = np.unique(batch.column("lang").to_pylist(), return_inverse=True)
            # a language's texts add up: one bundle a language
            pairs, where = np.unique(at * np.int64(len(names)) + code[doc], return_inverse=True)
            weight = np.bincount(where, weights=many / np.maximum(norm, 1)[doc]).astype(np.float32)
            found = grams.bundles(len(names), keys, *np.divmod(pairs, len(names)), weight)
            for lang, v in zip(names.tolist(), found, strict=True):
                sums[lang] = sums.get(lang, 0) + v.astype(np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([x.tolist() for x in sums.values()])], names=["lang", "sums"])

    parts = rows.mapInArrow(run, "lang string, sums array<double>")
    # a fixed number of sums a language: combined before the shuffle and in it
    sums = parts.select("lang", F.posexplode("sums").alias("i", "v")).groupBy("lang", "i").agg(F.sum("v").alias("v"))
    found = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("v")).orderBy("lang").collect()
    langs = [r["lang"] for r in found]
    if not langs:
        return [], np.zeros((0, dimensions))
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), 1e-12)
    m = unit(np.array([[x["v"] for x in r["v"]] for r in found]))
    return langs, unit(m - m.mean(axis=0)) if len(m) > 1 else m


def identify(docs: DataFrame, langs: list[str], model: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) for every row."""
    weights = np.ascontiguousarray(model.T, dtype=np.float32)

    def run(batches):
        grams = Trigrams(model.shape[1], seed)
        for batch in text_groups(batches):
            keys, at, doc, many = grams.counts(batch.column("text").to_pylist())
            names, scores = np.full(batch.num_rows, "und", dtype=object), np.zeros(batch.num_rows)
            some = np.bincount(doc, minlength=batch.num_rows) > 0
            if some.any() and langs:
                profiles = grams.bundles(batch.num_rows, keys, at, doc, many)[some]
                cosines = (profiles @ weights).astype(np.float64) / np.maximum(np.linalg.norm(profiles, axis=1, keepdims=True), 1e-12)
                best = cosines.argmax(axis=1)
                names[some] = np.array(langs, dtype=object)[best]
                scores[some] = 1 / np.exp(SHARPNESS * (cosines - cosines.max(axis=1, keepdims=True))).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    return documents(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = prototypes(docs.where(~held_out(4, 2)))
    return identify(docs, *model).select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")
