import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.llm import jaccard_join as x
from quadrille.llm._shared import BASES, rolling

SCHEMA = "doc_id long, text string, Node string, copies string"


def brute(rows):
    words = [tuple(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t in rows]
    sets = [{w[i : i + 5] for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    n, near = len(rows), defaultdict(set)
    for i in range(n):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if words[i] == words[j] or union and 10 * len(sets[i] & sets[j]) >= 8 * union:
                near[i].add(j)
                near[j].add(i)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for k in near[todo.pop()] - seen:
                seen.add(k)
                todo.append(k)
        out.append((rows[i][0], min(rows[k][0] for k in range(n) if words[k] == words[i]), len(near[i]), min(rows[k][0] for k in seen)))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    fresh = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    common = fresh(30)
    texts = [None, "", " \n", "a", "a ", "a b c d", "a b c d e", "x " * 50, "x " * 60, " ".join(fresh(30_000))]
    for size in (2, 3, 5, 90):
        base = fresh(rng.randrange(60, 120))
        for _ in range(size):
            own = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                own[rng.randrange(len(own))] = "changed" + str(rng.randrange(9))
            texts.append(" ".join(own))
    texts += [" ".join(fresh(20) + common) for _ in range(30)] + [" ".join(fresh(40)) for _ in range(30)]
    texts += texts[-2:]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed,leaf,block", [(1, 64, 2048), (2, 8, 16)])
def test_against_brute_force(spark, monkeypatch, seed, leaf, block):
    monkeypatch.setattr(x, "LEAF", leaf)
    monkeypatch.setattr(x, "BLOCK", block)
    monkeypatch.setattr(x, "LEAST_BLOCK", min(block, x.LEAST_BLOCK))
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, "a", "b") for r in rows], SCHEMA).repartition(3)
    got = x.jaccard_join(docs, batch_bytes=50_000).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links, r.component_id) for r in got) == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(3, "a b c d e f"), (3, "a b c d e f"), (None, "a  b c d e f"), (None, "q"), (None, "q")], SCHEMA.split(", Node")[0])
    got = sorted(((r.doc_id, r.class_id, r.n_links, r.component_id) for r in x.jaccard_join(docs).collect()), key=repr)
    assert got == [(3, 3, 2, 3)] * 2 + [(None, 3, 2, 3), (None, None, 1, None), (None, None, 1, None)]


def test_empty_table(spark):
    assert x.jaccard_join(spark.createDataFrame([], SCHEMA)).count() == 0


def test_pairs_at_the_threshold_meet_in_nodes_that_stay_large(spark):
    """Every coordinate has few values, so all nodes are large for two levels; pairs agree in 51 of 64."""
    r = np.random.default_rng(3)
    a = r.integers(0, 8, (3000, x.COORDINATES))
    b = a.copy()
    for row in b:
        i = r.permutation(x.COORDINATES)[:13]
        row[i] = (row[i] + r.integers(1, 8, 13)) % 8
    rows = [(i, s.tolist()) for i, s in enumerate(np.concatenate([a, b]))]
    edges = x.candidate_edges(spark.createDataFrame(rows, "node long, sketch array<int>").withColumn("label", F.lit(None).cast("long")), x._roots(0, x.RUNS))
    root = {e["node"]: e["root"] for e in x.components(edges).collect()}
    assert sum(i in root and root[i] == root.get(i + 3000) for i in range(3000)) >= 0.999 * 3000


def template_corpus(rng, n):
    """Pairs a little over or under the threshold; half of all texts share a long template, and some are mutual copies."""
    word = lambda: f"w{rng.randrange(50_000)}"
    template = [word() for _ in range(60)]
    texts = []
    for k in range(n // 2):
        base = ([*template] if k % 2 else []) + [word() for _ in range(rng.randrange(90, 140))]
        other = list(base)
        for _ in range(rng.choice([1, 2, 2, 3])):
            other[rng.randrange(len(other))] = word()
        texts += [" ".join(base), " ".join(other)]
    hot = [word() for _ in range(120)]
    for _ in range(n // 4):
        own = list(hot)
        for _ in range(rng.randrange(1, 4)):
            own[rng.randrange(len(own))] = word()
        texts.append(" ".join(own))
    return texts


def test_recall_on_skewed_texts_against_brute_force(spark):
    """All links of 5,000 texts, found by an inverted index of all n-grams, with a group of a fifth of them."""
    texts = template_corpus(random.Random(12), 4000)
    got = {r.doc_id: r for r in x.jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets = [frozenset(zip(*(t.split()[k:] for k in range(5)), strict=False)) for t in texts]
    at = defaultdict(list)
    for i, grams in enumerate(sets):
        for g in grams:
            at[g].append(i)
    want, have = 0, 0
    for i, grams in enumerate(sets):
        shared = defaultdict(int)
        for g in grams:
            for j in at[g]:
                shared[j] += 1
        n = sum(10 * c >= 8 * (len(grams) + len(sets[j]) - c) for j, c in shared.items() if j != i)
        assert got[i].n_links <= n
        want, have = want + n, have + got[i].n_links
    assert want > 100_000 and have >= 0.999 * want


def test_runs_go_on_until_the_measured_recall(spark, monkeypatch):
    r = np.random.default_rng(5)
    a = r.integers(0, 1 << 30, (400, x.COORDINATES))
    b = a.copy()
    for row in b:
        i = r.permutation(x.COORDINATES)[:12]
        row[i] = r.integers(0, 1 << 30, 12)
    rows = [(i, 9, s.tolist()) for i, s in enumerate(np.concatenate([a, b]))]
    nodes = spark.createDataFrame(rows, "node long, n_words long, sketch array<int>")
    rounds, own = [], x.candidate_edges
    monkeypatch.setattr(x, "candidate_edges", lambda n, first: rounds.append(first) or own(n, first))
    few = x.clusters_of(nodes, 1, 0.0)
    assert len(rounds) == 1 and 0.6 < x.measured_recall(nodes, few, 800) < 0.95
    all_of = x.clusters_of(nodes, 1, 1.0)
    assert len(rounds) > 2 and x.measured_recall(nodes, all_of, 800) == 1.0
    used = [c for f in rounds[1:] for c in f]
    assert len(used) == len(set(used))


def test_differences_give_the_similarity_of_any_pair():
    rng = np.random.default_rng(7)
    sets = [np.unique(rng.integers(0, 400, 300)).astype(np.uint64) for _ in range(40)]
    gone = [np.setxor1d(s, sets[3]) for s in sets]
    size = np.array([len(g) for g in gone])
    args = np.concatenate(gone), np.cumsum(size) - size, size, np.array([len(s) for s in sets])
    for block in (None, np.arange(40) % 2):
        got = {tuple(sorted(p)) for a, b in x._pairs(np.arange(40), *args, block, 0.37, 64) for p in zip(a.tolist(), b.tolist(), strict=True)}
        near = {(i, j) for j in range(40) for i in range(j) if len(np.intersect1d(sets[i], sets[j])) >= 0.37 * len(np.union1d(sets[i], sets[j]))}
        assert got == {p for p in near if block is None or p[0] % 2 != p[1] % 2} and got


def test_query_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    df = x.op10_jaccard_join(spark, "/root/testdata/sf0.001")
    assert df.columns == ["doc_id", "class_id", "n_links", "component_id", "kept"]
    assert sorted((r.doc_id, r.class_id, r.n_links, r.component_id) for r in df.collect()) == brute(docs)


def test_sketches_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 4000).astype(np.uint64)
    b = np.concatenate([a[:3600], rng.integers(0, 2**63, 400).astype(np.uint64)])
    s = x.sketches(np.concatenate([a, b]), np.repeat([0, 2], 4000), 3)
    assert abs((s[0] == s[2]).mean() - 3600 / 4400) < 0.15 and (s[1] == 0).all()


def test_rolling_hashes_equal_only_equal_runs():
    words = np.random.default_rng(1).integers(0, 3, 3000).astype(np.uint64) * BASES[1]
    h = rolling(words, 6, BASES[0])
    by = {}
    for i in range(len(h)):
        by.setdefault(tuple(words[i : i + 6].tolist()), set()).add(int(h[i]))
    assert all(len(v) == 1 for v in by.values()) and len({next(iter(v)) for v in by.values()}) == len(by)
