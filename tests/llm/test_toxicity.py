import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quadrille.llm import toxicity as x

WORDS = [a + b + c for a in ("ka", "lo", "mi") for b in ("ne", "ru", "so") for c in ("ta", "ve", "zi")]
RUDE = ["blargh", "snork"]


def text(rng, rude, n=120):
    words = rng.choices(WORDS, k=n)
    if rude:
        words.insert(rng.randrange(n), rng.choice(RUDE).title() + "!")
    return " ".join(words)


def test_words_and_pairs():
    vocabulary, doc, word = x.present(pa.array(["B a,a 1", "", "éb-A"]))
    assert sorted((int(d), vocabulary[int(w)].as_py()) for d, w in zip(doc, word, strict=True)) == [(0, b"a"), (0, b"b"), (2, b"a"), (2, "éb".encode())]


def test_later_models_learn_from_out_of_fold_logits(monkeypatch):
    """The logits a later model is fitted on come from models that have not seen their rows."""
    seen = []
    real = x.Logistic.fit

    def spy(self, dense, vocabulary, doc, word, before, y):
        seen.append((len(y), before.shape[1]))
        return real(self, dense, vocabulary, doc, word, before, y)

    monkeypatch.setattr(x.Logistic, "fit", spy)
    r = np.random.default_rng(2)
    dense, y = r.normal(size=(100, 3)), r.integers(0, 2, size=(100, 2)).astype(float)
    models = x.fit_chain(dense, pa.array([], pa.large_binary()), np.zeros(0, int), np.zeros(0, int), y, np.arange(100) % x.FOLDS)
    assert seen == [(100, k) if i == 0 else (80, k) for k in range(2) for i in range(1 + x.FOLDS)] and len(models) == 2


def test_threshold_is_in_the_middle_of_the_gap():
    assert x.threshold(np.array([-5.0, -4, -1, 3]), np.array([0.0, 0, 1, 1])) == -2.5


def test_held_out_accuracy(spark):
    rng = random.Random(4)
    rows = [(i, text(rng, i % 4 == 0), int(i % 4 == 0)) for i in range(400)]
    odd = [(1000, None), (1001, ""), (1002, text(rng, False, 40_000)), (1003, text(rng, True, 40_000)), (None, "a")]
    docs = spark.createDataFrame([(i, t, 1) for i, t, _ in rows] + [(i, t, 1) for i, t in odd] + [(0, rows[0][1], 1)], "doc_id long, text string, P_toxic int").repartition(3)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(3, 1, 1), (None, 1, 1), (5, None, 0)], "doc_id long, quality int, toxic int")
    models = x.fit(docs, labels, ~x.held_out(3, 1))
    assert set(w.encode() for w in RUDE) <= set(models[1].words)
    got = {}
    for r in x.score(docs, models).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert len(got[0]) == 2 and sum(map(len, got.values())) == len(rows) + len(odd) + 1
    held = [(got[i][0].p_toxic >= 0.5, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(held) > 90 and sum(p == y for p, y in held) >= 0.98 * len(held)
    assert got[1003][0].p_toxic >= 0.5 > got[1002][0].p_toxic and got[0][0].p_low_quality == pytest.approx(0, abs=1e-6)


def test_no_labels_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.p_toxic for r in x.score(docs, x.fit(docs, labels)).collect()] == [0.5]
    assert x.score(docs.limit(0), x.fit(docs, labels)).count() == 0
