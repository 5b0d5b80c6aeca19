import numpy as np
import pytest

from quadrille.llm import embedding_dedup as x

SCHEMA = "vec_id long, embedding array<float>, label int, Node string, v string"


def brute(rows):
    n = len(rows)
    ok = [l is not None and e is not None and all(c is not None and np.isfinite(c) for c in e) and any(e) for _, e, l in rows]
    near = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.array(rows[k][1], np.float32).astype(float) for k in (i, j))
                near[i, j] = near[j, i] = a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.93
    reach = np.eye(n, dtype=bool) | near
    while True:
        more = reach @ reach
        if (more == reach).all():
            break
        reach = more
    return {rows[i][0]: (int(near[i].sum()), min(rows[k][0] for k in np.flatnonzero(reach[i]))) for i in range(n)}


def corpus(seed, dims=24):
    r = np.random.default_rng(seed)
    rows = []
    for _ in range(60):
        center, label = r.normal(size=dims), int(r.integers(0, 3))
        for _ in range(int(r.integers(1, 8))):
            rows.append((center + r.normal(size=dims) * r.choice([0.05, 0.2, 0.3, 0.5]), label))
    center = r.normal(size=dims)
    rows += [(center + r.normal(size=dims) * 0.1, 1) for _ in range(70)] + [(center, 1)] * 5 + [(center * 3, 1), (center, 2), (center, None)]
    rows = [(i, [float(np.float32(c)) for c in e], l) for i, (e, l) in enumerate(rows)]
    n, odd = len(rows), rows[0][1]
    extra = [None, [0.0] * dims, [float("nan"), *odd[1:]], [float("inf"), *odd[1:]], [None, *odd[1:]], odd[:-1], odd[:-1], [], [1e-30, *[0.0] * (dims - 1)], [1e-25, *[0.0] * (dims - 1)]]
    return rows + [(n + i, e, 1) for i, e in enumerate(extra)]


@pytest.mark.parametrize("seed,block", [(1, 2048), (2, 16)])
def test_recall_and_precision_against_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(x, "BLOCK", block)
    rows = corpus(seed)
    want = brute(rows)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in x.embedding_dedup(spark.createDataFrame([(*r, "a", "b") for r in rows], SCHEMA).repartition(3)).collect()}
    assert got.keys() == want.keys()
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(v[0] for v in got.values()) >= 0.99 * sum(v[0] for v in want.values())
    assert sum(got[i][1] == want[i][1] for i in want) >= 0.99 * len(want)
    assert all(k == (i == c) for i, (_, c, k) in got.items())


def hot(n, share, noise, dims=64, seed=5):
    """Unit-variance background of one label with a group of independent noise round one centre."""
    r = np.random.default_rng(seed)
    many, centre = int(n * share), r.normal(size=dims)
    return np.concatenate([centre + noise * r.normal(size=(many, dims)), r.normal(size=(n - many, dims))]).astype(np.float32)


@pytest.mark.parametrize("noise", [0.2, 0.3])  # median cosines of 0.96 and 0.92
def test_no_link_is_lost_in_a_large_dense_group(spark, noise):
    v = hot(3000, 0.6, noise)
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    want = (u @ u.T >= 0.93).sum(axis=1) - 1
    rows = [(i, e.tolist(), 1) for i, e in enumerate(v)]
    got = {r.vec_id: r.n_links for r in x.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert all(got[i] <= want[i] for i in got)
    assert sum(got.values()) >= 0.999 * want.sum()


def test_repeated_rows_and_null_ids(spark):
    rows = [(2, [1.0, 2.0], 1), (2, [1.0, 2.0], 1), (None, [1.0, 2.1], 1), (None, [5.0, -1.0], 1), (None, [5.0, -1.0], 1)]
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in x.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()), key=repr)
    assert got == [(2, 2, 2), (2, 2, 2), (None, 1, None), (None, 1, None), (None, 2, 2)]


def test_empty_table(spark):
    assert x.embedding_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
