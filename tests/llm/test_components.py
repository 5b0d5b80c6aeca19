"""Connected components: the result, and that no round only shows that the last one was done."""

import random

import pytest
from pyspark.sql import functions as F

from quadrille.llm import _shared, jaccard_join


def least(edges):
    up = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {x: find(x) for x in up}


@pytest.mark.parametrize("kind", ["stars", "path", "random", "none"])
def test_roots(spark, kind):
    rng = random.Random(4)
    edges = {
        "stars": [(k, k // 10 * 10) for k in range(60) if k % 10],
        "path": list(zip(range(40), range(1, 41), strict=True)),
        "random": [(rng.randrange(80), rng.randrange(80)) for _ in range(70)],
        "none": [],
    }[kind]
    df = spark.createDataFrame(edges * 2, "a long, b long")
    assert {r.node: r.root for r in _shared.components(df).collect()} == least([e for e in edges if e[0] != e[1]])


def test_stars_need_no_round(spark, monkeypatch):
    """Two tables are written, the edges and their minima: five before, whose plans and metrics the driver keeps."""
    written, own = [], _shared.written
    monkeypatch.setattr(_shared, "written", lambda df, tag: written.append(tag) or own(df, tag))
    found = _shared.components(spark.createDataFrame([(k, 0) for k in range(1, 9)], "a long, b long"))
    assert found.agg(F.max("root"), F.count("node")).first() == (0, 9) and len(written) == 2


def test_a_level_of_large_nodes_writes_four_tables(spark, monkeypatch):
    """Members, sizes, what is compared and what is left; a fifth held the members of large nodes before."""
    tags, own = [], jaccard_join.written
    monkeypatch.setattr(jaccard_join, "written", lambda df, tag: tags.append(tag) or own(df, tag))
    rows = [(k, [0] * 32 + [k] * 32, None) for k in range(jaccard_join.LEAF + 6)]
    edges = jaccard_join.candidate_edges(spark.createDataFrame(rows, "node long, sketch array<int>, label long"), [0])
    assert edges.columns == ["a", "b"] and tags[:4] == ["members", "sizes", "seen", "rest"]


@pytest.mark.parametrize("local", [0, 6, 25])
def test_rounds_and_one_task_agree(spark, local):
    """Rounds to the end, rounds until few edges are left, one task at once."""
    edges = [(k, k + 1) for k in range(0, 20)] + [(40 + k, 40) for k in range(1, 5)]
    found = _shared.components(spark.createDataFrame(edges, "a long, b long"), local=local)
    assert {r.node: r.root for r in found.collect()} == least(edges)


def test_few_edges_need_no_round(spark, monkeypatch):
    """A path's edges and roots are written: before, also the tables of every round."""
    written, own = [], _shared.written
    monkeypatch.setattr(_shared, "written", lambda df, tag: written.append(tag) or own(df, tag))
    found = _shared.components(spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long"))
    assert found.agg(F.max("root"), F.count("node")).first() == (0, 41) and len(written) == 2


def test_the_driver_drops_what_a_level_leaves(spark, monkeypatch):
    """After a level that has another below it; never before."""
    calls, own = [], jaccard_join.collected
    monkeypatch.setattr(jaccard_join, "collected", lambda s: calls.append(s) or own(s))
    rows = [(k, [0] * 32 + [k] * 32, None) for k in range(jaccard_join.LEAF + 6)]
    jaccard_join.candidate_edges(spark.createDataFrame(rows, "node long, sketch array<int>, label long"), [0])
    assert calls
