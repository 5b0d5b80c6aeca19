import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quadrille.llm import quality as x
from quadrille.llm._features import CHARACTERS, passages

GOOD = "the sun rose over a quiet field while the old farmer walked home slowly".split()


def good(rng, n=250):
    return " ".join(rng.choices(GOOD, k=n)) + "."


def bad(rng, n=250):
    return " ".join(rng.choice(["BUY", "NOW", "$$$", "click", "!!!"]) for _ in range(n))


def test_passages_by_hand():
    whose, f = passages(pa.array(["a a bb", "", "c " * 250]))
    assert whose.tolist() == [0, 1, 2, 2, 2]
    assert f[0, ord("a")] == pytest.approx(0.5**0.5) and f[0, CHARACTERS] == pytest.approx(2 / 3) and f[0, CHARACTERS + 1] == pytest.approx(1 / 3)
    assert (f[1] == 0).all() and f[4, CHARACTERS + 4] == pytest.approx(0.5)


def test_gradients_are_those_of_the_loss():
    r = np.random.default_rng(1)
    m = x.AttentionModel(5, 4, 3)
    for k in m.p:
        m.p[k] = r.normal(size=m.p[k].shape)
    data, first, y = r.normal(size=(9, 5)), np.array([0, 2, 3]), np.array([1.0, 0.0, 1.0])
    loss = lambda: -np.mean([np.log(s if t else 1 - s) for s, t in zip(m.score(data, first), y, strict=True)])
    grads = m._gradients(data, first, y)
    for k, g in grads.items():
        for at in np.ndindex(g.shape):
            old = m.p[k][at]
            m.p[k][at] = old + 1e-6
            up = loss()
            m.p[k][at] = old - 1e-6
            assert (up - loss()) / 2e-6 == pytest.approx(g[at], abs=1e-5), (k, at)
            m.p[k][at] = old
    a = m.attention(data, first)
    assert np.add.reduceat(a, first) == pytest.approx(np.ones(3))


def test_held_out_accuracy_and_attention(spark):
    rng = random.Random(5)
    rows = [(i, good(rng) + " " + (bad(rng) if i % 3 == 0 else good(rng)), int(i % 3 != 0)) for i in range(300)]
    odd = [(1000, None), (1001, ""), (1002, "x" * 300_000), (None, "the sun"), (1003, good(rng, 50_000))]
    docs = spark.createDataFrame([(i, t, "z") for i, t, _ in rows] + [(i, t, "z") for i, t in odd] + [(rows[0][0], rows[0][1], "z")], "doc_id long, text string, Score string").repartition(3)
    labels = spark.createDataFrame([(i, q, None) for i, _, q in rows] + [(1, 0, None), (7, None, None), (None, 1, None), (999, 1, None)], "doc_id long, quality int, toxic int")
    model = x.fit(docs, labels, ~x.held_out(3, 1))
    got = {}
    for r in x.score(docs, model).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert len(got[0]) == 2 and sum(map(len, got.values())) == len(rows) + len(odd) + 1
    held = [(got[i][0].predicted, q) for i, _, q in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(p == q for p, q in held) >= 0.97 * len(held) and len(held) > 60
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for v in got.values() for r in v)


def test_one_kind_of_label_none_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert {r.score for r in x.score(docs, x.fit(docs, labels)).collect()} == {1.0}
    assert {r.score for r in x.score(docs, x.fit(docs, labels.limit(0))).collect()} == {0.5}
    assert x.score(docs.limit(0), x.fit(docs, labels)).count() == 0
