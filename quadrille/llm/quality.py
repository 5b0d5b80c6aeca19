"""Quality by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded (see ``_features``) and mapped to a hidden vector h;
gated attention gives it the weight softmax(w . (tanh(V h) * sigmoid(U h))); the weighted sum of the hidden
vectors is the document's representation, of which a logistic unit makes the score. Only documents have labels:
which passages matter is learnt. The model is fitted by the driver on a bounded sample of labelled rows
(``SAMPLE``) and, of a text with more than ``BAG`` passages, on that many at even distances over the whole text; both
are parameters of the fit alone. Scoring is one pass without a shuffle over all rows and all passages.

Defined results: null text counts as empty, and a text without words has one passage of zeros; with labels of
one value only, every score is that value; without any, 0.5; repeated rows get a row each; an empty table gives no
rows; extra columns are ignored unless carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._features import WIDTH, held_out, labelled_sample, passages
from ._shared import documents, small_batches

#: Labelled rows that a fit reads at most, and passages a row; hidden units; attention units; passes.
SAMPLE, BAG, HIDDEN, ATTENTION, PASSES = 6000, 256, 24, 12, 30


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


class AttentionModel:
    """Bags in, scores out. ``first`` has the index of every bag's first passage."""

    def __init__(self, width: int = WIDTH, hidden: int = HIDDEN, attention: int = ATTENTION, seed: int = 7):
        r = np.random.default_rng(seed)
        scale = lambda a, b: r.normal(size=(a, b)) / np.sqrt(a)
        self.shift, self.scale, self.constant = np.zeros(width), np.ones(width), None
        self.p = {"W": scale(width, hidden), "b": np.zeros(hidden), "V": scale(hidden, attention), "U": scale(hidden, attention), "w": np.zeros((attention, 1)), "c": scale(hidden, 1), "d": np.zeros(1)}

    def _forward(self, x, first):
        p = self.p
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * g @ p["w"])[:, 0]
        sizes = np.diff(np.append(first, len(x)))
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), sizes))
        a = e / np.repeat(np.add.reduceat(e, first), sizes)
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        return h, t, g, a, z, sizes, (z @ p["c"])[:, 0] + p["d"][0]

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(first), float(self.constant))
        return _sigmoid(self._forward((x - self.shift) / self.scale, first)[-1])

    def attention(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The passages' weights, which add up to 1 in a bag."""
        return self._forward((x - self.shift) / self.scale, first)[3]

    def fit(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, passes: int = PASSES, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> AttentionModel:
        if len(y) == 0 or y.min() == y.max():
            self.constant = 0.5 if len(y) == 0 else float(y[0])
            return self
        self.shift, self.scale = x.mean(axis=0), x.std(axis=0) + 0.02
        x = (x - self.shift) / self.scale
        sizes = np.diff(np.append(first, len(x)))
        r, step = np.random.default_rng(seed), 0
        m, v = {k: np.zeros_like(a) for k, a in self.p.items()}, {k: np.zeros_like(a) for k, a in self.p.items()}
        for one in range(passes):
            order = r.permutation(len(y))
            for i in range(0, len(y), 128):
                bags = order[i : i + 128]
                size = sizes[bags]
                begin = np.cumsum(size) - size
                rows = np.arange(size.sum()) + np.repeat(first[bags] - begin, size)
                grads = self._gradients(x[rows], begin, y[bags])
                step += 1
                for k, g in grads.items():
                    g = g + decay * self.p[k]
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.001 * (g * g - v[k])
                    now = rate * (1 - one / passes) + 1e-4
                    self.p[k] -= now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def _gradients(self, x, first, y):
        p = self.p
        h, t, g, a, z, sizes, s = self._forward(x, first)
        ds = ((_sigmoid(s) - y) / len(y))[:, None]
        dz = np.repeat(ds @ p["c"].T, sizes, axis=0)
        da = (dz * h).sum(axis=1)
        de = (a * (da - np.repeat(np.add.reduceat(a * da, first), sizes)))[:, None]
        dtg = de @ p["w"].T
        dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
        dh = (a[:, None] * dz + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
        return {"W": x.T @ dh, "b": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "c": z.T @ ds, "d": ds.sum(axis=0)}


def spread(n: int, most: int) -> np.ndarray:
    """The numbers of at most ``most`` of ``n`` passages, at even distances from the first to the last."""
    return np.arange(n) if n <= most else np.round(np.linspace(0, n - 1, most)).astype(np.int64)


def encoded(df: DataFrame, most: int = BAG) -> DataFrame:
    """The columns of ``df`` but text, and ``bag``: the features of at most ``most`` passages as little-endian float32."""
    kept = [f for f in df.schema.fields if f.name != "text"]
    schema = T.StructType([*kept, T.StructField("bag", T.BinaryType())])

    def run(batches):
        for batch in small_batches(batches):
            whose, x = passages(batch.column("text"))
            at = np.searchsorted(whose, np.arange(batch.num_rows + 1))
            bags = [x[i + spread(j - i, most)].astype("<f4").tobytes() for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in kept] + [pa.array(bags, pa.binary())], names=[f.name for f in kept] + ["bag"])

    return df.mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, keep=None, sample: int = SAMPLE) -> AttentionModel:
    """A model of label ``quality`` from at most ``sample`` labelled rows for which ``keep`` (a Column) holds."""
    chosen = labelled_sample(docs, labels, ["quality"], F.lit(True) if keep is None else keep, sample)
    rows = encoded(chosen).toPandas().sort_values(["doc_id", "bag"])
    bags = [np.frombuffer(b, dtype="<f4").reshape(-1, WIDTH) for b in rows.bag]
    sizes = np.array([len(b) for b in bags], np.int64)
    x = np.concatenate(bags).astype(np.float64) if bags else np.zeros((0, WIDTH))
    return AttentionModel().fit(x, np.cumsum(sizes) - sizes, (rows.quality.to_numpy() > 0).astype(float))


def score(docs: DataFrame, model: AttentionModel, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``carry``, text, score (0 to 1) and predicted (1 if score >= 0.5) for every row."""
    df = documents(docs, *carry).drop("rid")
    kept = df.schema.fields
    schema = T.StructType([*kept, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches):
        for batch in small_batches(batches):
            whose, x = passages(batch.column("text"))
            s = model.score(x, np.searchsorted(whose, np.arange(batch.num_rows)))
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in kept] + [pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[f.name for f in kept] + ["score", "predicted"])

    return df.mapInArrow(run, schema)


def op6_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels, ~held_out(3, 1))
    return score(docs, model).select("doc_id", held_out(3, 1).alias("held_out"), "score", "predicted")
