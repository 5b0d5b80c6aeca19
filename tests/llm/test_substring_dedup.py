import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quadrille.llm import substring_dedup as x

SCHEMA = "doc_id long, text string, B string, kept string"


def brute(rows, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), " ".join(v for i, v in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


def corpus(rng, window):
    fresh = lambda n, k=300: [f"w{rng.randrange(k)}" for _ in range(n)]
    shared = [fresh(rng.randrange(window - 2, 3 * window)) for _ in range(6)]
    rows = [None, "", "one two", "a " * (2 * window), "b " * window, "c d " * window, " ".join(fresh(5000)), " \n\x0b".join(shared[0]), "é\x85x " * 3]
    for _ in range(40):
        parts = [fresh(rng.randrange(0, 2 * window))]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(shared)[rng.randrange(4) :], fresh(rng.randrange(0, window))]
        rows.append(rng.choice([" ", "\n", "  "]).join(v for p in parts for v in p))
    rows += [rows[-1], rows[-2]]
    return [(i, t) for i, t in enumerate(rows)] + [(20, rows[20]), (None, rows[21])]


@pytest.mark.parametrize("window", [35, 5])
@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, window, seed):
    rows = corpus(random.Random(seed), window)
    docs = spark.createDataFrame([(*r, "b", "k") for r in rows], SCHEMA).repartition(3)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in x.without_repeats(docs, window, batch_bytes=3000).collect()), key=repr)
    assert got == brute(rows, window)


def test_symbols_follow_from_the_words_of_their_interval():
    rng = np.random.default_rng(3)
    core = rng.integers(0, 40, 60)
    found = []
    for _ in range(30):
        before, after = rng.integers(0, 40, rng.integers(0, 9)), rng.integers(0, 40, rng.integers(0, 9))
        words = np.concatenate([before, core, after]).astype(np.uint64) * x.BASES[0]
        s = x.Symbols((words, words * x.BASES[1]), np.zeros(len(words), np.int64), 5)
        assert all((np.diff(v) >= 0).all() for v in (s.start, s.lo, s.hi))
        inside = (s.lo >= len(before)) & (s.hi <= len(before) + 60)
        found.append({tuple(int(v) for v in r) for r in np.column_stack([s.names[0], s.names[1], s.start - len(before), s.lo - len(before), s.hi - len(before)])[inside].astype(object)})
    assert all(f == found[0] for f in found) and found[0]


def test_windows_have_one_name_just_where_their_words_are_equal():
    rng = random.Random(4)
    parts = [" ".join(rng.choice("abc") for _ in range(50)) for _ in range(5)]
    texts = [" ".join([f"x{k}", rng.choice(parts), f"y{k}", rng.choice(parts), "z " * rng.randrange(60)]) for k in range(60)]
    batch = x.Batch(pa.array(texts), 35, 5)
    words = [w.decode() for w in batch.words.listed()]
    flat = [words[c] for c in batch.words.codes]
    of, back = {}, {}
    for start, *name in zip(batch.starts.tolist(), *[n.tolist() for n in batch.names(np.arange(len(batch.starts)))], strict=True):
        run = tuple(flat[start : start + 35])
        assert of.setdefault(run, name) == name and back.setdefault(tuple(name), run) == run
    assert len(of) < len(batch.starts) and batch.anchored.mean() > 0.5


def test_a_third_of_all_rows_repeated(spark):
    """Repeated rows, adjacent in one file, go to many batches, and each gets its row."""
    rng = random.Random(6)
    text = " ".join(f"v{rng.randrange(500)}" for _ in range(60))
    docs = spark.createDataFrame([(1, text)] * 300 + [(i, f"{i} " * 3) for i in range(2, 602)], "doc_id long, text string").coalesce(1)
    got = x.without_repeats(docs, 35, batch_bytes=2000).collect()
    assert len(got) == 900 and all((r.n_words, r.n_removed) == (60, 60) for r in got if r.doc_id == 1)


def test_query_has_the_contract_s_columns(spark):
    df = x.op5_substring_dedup(spark, "/root/testdata/sf0.001")
    assert df.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    import hashlib

    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    want = [(i, n, k, hashlib.sha256(t.encode()).hexdigest()) for i, n, k, t in brute(docs, 35)]
    assert sorted(map(tuple, df.collect())) == sorted(want)


def test_empty_table(spark):
    assert x.without_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
