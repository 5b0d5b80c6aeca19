"""Toxicity by a chain of classifiers over the annotated categories.

Categories are predicted one after the other. Each has a ridge logistic model, with either value of its label
weighing the same, over character and word statistics,
the presence of words that tell the category apart, and the logits of the categories before it. When a later
model is fitted, the earlier categories' logits come from models that have not seen the row (``FOLDS`` folds by
a hash of doc_id, words chosen anew in each), as it will meet them on new rows. The same logits set each
category's threshold, which is moved to probability 0.5. The driver fits on a bounded sample
of labelled rows (``SAMPLE``, a parameter); scoring is one pass without a shuffle over whole texts.

Words are runs of letters with A-Z lower-cased. Defined results: null text counts as empty; a category with labels
of one value has that value as its probability, without any 0.5; repeated rows get a row each; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._features import WIDTH, held_out, labelled_sample, passages
from ._shared import FOLD, NO_LETTERS, Words, documents, small_batches

#: Labelled rows that a fit reads at most; folds; words a model may use; least chi-square of such a word; ridge.
SAMPLE, FOLDS, MOST_WORDS, LEAST_CHI, RIDGE = 6000, 5, 256, 30.0, 0.01
#: (category, label column, label value that means the category), in the order of the chain.
CHAIN = (("low_quality", "quality", 0.0), ("toxic", "toxic", 1.0))


def present(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of the batch, and (text, word) pairs, each once."""
    words = Words(texts, NO_LETTERS, FOLD)
    pairs = np.unique(words.doc * np.int64(max(1, len(words.distinct))) + words.codes)
    return words.distinct, *np.divmod(pairs, max(1, len(words.distinct)))


def statistics(texts: pa.Array) -> np.ndarray:
    """Features of the whole texts, without the number of words."""
    return passages(texts, 1 << 40)[1][:, : WIDTH - 1].astype(np.float64)


@dataclass
class Logistic:
    """A ridge logistic model over statistics, words and earlier logits."""

    words: list[bytes] = field(default_factory=list)
    weights: np.ndarray | None = None
    shift: float = 0.0
    constant: float | None = None

    def matrix(self, dense: np.ndarray, vocabulary: pa.Array, doc: np.ndarray, word: np.ndarray, before: np.ndarray) -> np.ndarray:
        x = np.zeros((len(dense), 1 + dense.shape[1] + before.shape[1] + len(self.words)))
        x[:, 0] = 1
        x[:, 1 : 1 + dense.shape[1]] = dense
        x[:, 1 + dense.shape[1] : x.shape[1] - len(self.words)] = before / 4
        if self.words and len(vocabulary):
            at = pc.index_in(vocabulary, value_set=pa.array(self.words, vocabulary.type)).fill_null(-1).to_numpy(zero_copy_only=False)[word]
            x[doc[at >= 0], x.shape[1] - len(self.words) + at[at >= 0]] = 1
        return x

    def choose(self, vocabulary: pa.Array, doc: np.ndarray, word: np.ndarray, y: np.ndarray) -> None:
        """Keeps the words whose presence and the category have the greatest chi-square."""
        n, yes = len(y), y.sum()
        have = np.bincount(word, minlength=len(vocabulary)).astype(float)
        both = np.bincount(word, weights=y[doc], minlength=len(vocabulary))
        chi = n * (both * n - have * yes) ** 2 / np.maximum(have * (n - have) * yes * (n - yes), 1e-9)
        best = np.lexsort((np.arange(len(chi)), -chi))[:MOST_WORDS]
        self.words = sorted(w.as_py() for w in vocabulary.take(pa.array(best[chi[best] >= LEAST_CHI])))

    def fit(self, dense, vocabulary, doc, word, before, y) -> Logistic:
        if len(y) == 0 or y.min() == y.max():
            self.constant = float(y[0]) if len(y) else 0.5
            return self
        self.choose(vocabulary, doc, word, y)
        x = self.matrix(dense, vocabulary, doc, word, before)
        w = np.zeros(x.shape[1])
        penalty = np.full(x.shape[1], RIDGE)
        penalty[0] = 1e-6
        even = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))  # both values count alike
        for _ in range(12):  # Newton's method
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            s = even * np.maximum(p * (1 - p), 1e-6)
            step = np.linalg.solve(x.T @ (x * s[:, None]) + np.diag(penalty), x.T @ (even * (y - p)) - penalty * w)
            w += step
            if np.abs(step).max() < 1e-4:
                break
        self.weights = w
        return self

    def logit(self, dense, vocabulary, doc, word, before) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(dense), (self.constant - 0.5) * 40)
        return np.clip(self.matrix(dense, vocabulary, doc, word, before) @ self.weights - self.shift, -20, 20)


def _rows(doc: np.ndarray, word: np.ndarray, take: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    new = np.full(len(take), -1)
    new[take] = np.arange(take.sum())
    keep = take[doc]
    return new[doc[keep]], word[keep]


def threshold(logits: np.ndarray, y: np.ndarray) -> float:
    """Where balanced accuracy is greatest; the middle of the widest gap that reaches it."""
    by = np.argsort(logits, kind="stable")
    cuts = np.concatenate([[logits[by[0]] - 2], logits[by], [logits[by[-1]] + 2]])
    yes, no = np.append(0, np.cumsum(y[by])), np.append(0, np.cumsum(1 - y[by]))
    gain = no / max(no[-1], 1) - yes / max(yes[-1], 1)  # rows below the cut
    gaps = np.where(np.isclose(gain, gain.max()), np.diff(cuts), -1)
    at = int(gaps.argmax())
    return float((cuts[at] + cuts[at + 1]) / 2)


def fit_chain(dense, vocabulary, doc, word, labels: np.ndarray, fold: np.ndarray) -> list[Logistic]:
    """One model a column of ``labels``, each fitted on out-of-fold logits of the columns before."""
    models, before = [], np.zeros((len(dense), 0))
    for k in range(labels.shape[1]):
        y = labels[:, k]
        models.append(Logistic().fit(dense, vocabulary, doc, word, before, y))
        unseen = np.zeros(len(y))
        for f in range(FOLDS):
            out = fold == f
            if out.any():
                part = Logistic().fit(dense[~out], vocabulary, *_rows(doc, word, ~out), before[~out], y[~out])
                unseen[out] = part.logit(dense[out], vocabulary, *_rows(doc, word, out), before[out])
        if len(y) and models[-1].constant is None:
            models[-1].shift = threshold(unseen, y)
        before = np.column_stack([before, np.clip(unseen - models[-1].shift, -20, 20)])
    return models


def encoded(df: DataFrame, columns: list[str]) -> DataFrame:
    """doc_id, ``columns``, and statistics (float64) and distinct words (line by line) of the text."""

    def run(batches):
        for batch in small_batches(batches, limit=1 << 20):
            texts = batch.column("text")
            dense = [row.tobytes() for row in statistics(texts)]
            vocabulary, doc, word = present(texts)
            ends = np.searchsorted(doc, np.arange(batch.num_rows + 1)).tolist()
            own = vocabulary.take(pa.array(word)).to_pylist()
            lists = [b"\n".join(own[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ["doc_id", *columns]] + [pa.array(dense, pa.binary()), pa.array(lists, pa.binary())], names=["doc_id", *columns, "dense", "words"])

    return df.mapInArrow(run, "doc_id long, " + "".join(f"{c} double, " for c in columns) + "dense binary, words binary")


def fit(docs: DataFrame, labels: DataFrame, keep=None, chain=CHAIN, sample: int = SAMPLE) -> list[Logistic]:
    """Models of ``chain``'s categories from at most ``sample`` labelled rows for which ``keep`` holds."""
    columns = list(dict.fromkeys(c for _, c, _ in chain))
    chosen = labelled_sample(docs, labels, columns, F.lit(True) if keep is None else keep, sample)
    rows = encoded(chosen, columns).toPandas().sort_values(["doc_id", "dense", "words"])
    dense = np.frombuffer(b"".join(rows.dense), np.float64).reshape(len(rows), WIDTH - 1)
    lists = [w.split(b"\n") if w else [] for w in rows.words]
    coded = pa.array([w for own in lists for w in own], pa.large_binary()).dictionary_encode()
    doc = np.repeat(np.arange(len(rows)), [len(own) for own in lists])
    y = np.column_stack([(rows[c].to_numpy() == value).astype(float) for _, c, value in chain])
    fold = np.array([xxhash.xxh32_intdigest(str(i)) % FOLDS for i in rows.doc_id], dtype=np.int64)
    return fit_chain(dense, coded.dictionary, doc, coded.indices.to_numpy(zero_copy_only=False), y, fold)


def score(docs: DataFrame, models: list[Logistic], chain=CHAIN) -> DataFrame:
    """doc_id and the probability p_<category> of each category, for every row."""
    names = [f"p_{name}" for name, _, _ in chain]

    def run(batches):
        for batch in small_batches(batches):
            texts = batch.column("text")
            dense, (vocabulary, doc, word), before = statistics(texts), present(texts), np.zeros((batch.num_rows, 0))
            for model in models:
                before = np.column_stack([before, model.logit(dense, vocabulary, doc, word, before)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(p) for p in 1 / (1 + np.exp(-before.T))]], names=["doc_id", *names])

    return documents(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{n} double" for n in names))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """Learns from labelled rows whose crc32(doc_id as text) mod 3 is not 1; score is that of the last category."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    models = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out(3, 1))
    found = score(docs, models)
    return found.select("doc_id", held_out(3, 1).alias("held_out"), "p_low_quality", F.col("p_toxic").alias("score"), (F.col("p_toxic") >= 0.5).cast("int").alias("predicted"))
