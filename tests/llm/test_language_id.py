import random
import re
import zlib
from collections import Counter

import numpy as np

from quadrille.llm.language_id import SHARPNESS, Trigrams, identify, op3_language_id, prototypes

SYLLABLES = {"aa": ["ka", "lo", "mi", "ne"], "bb": ["strü", "pf", "ei", "zack"], "cc": ["шо", "ба", "ли", "ду"]}


def text(lang, rng, words=40):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=3)) for _ in range(words))


def test_profile_is_the_sum_of_bound_rotated_letters():
    g = Trigrams(64, 1)
    got = g.bundles(2, *g.counts(["Ab ab", "x"]))[0]
    v = {c: g.letter(ord(c) if c else 0).astype(int) for c in ("", "a", "b")}
    want = 2 * (np.roll(v[""], 2) * np.roll(v["a"], 1) * v["b"] + np.roll(v["a"], 2) * np.roll(v["b"], 1) * v[""]) + np.roll(v["b"], 2) * np.roll(v[""], 1) * v["a"]
    assert (got == want).all()


def test_held_out_accuracy_and_defined_results(spark):
    rng = random.Random(3)
    rows = [(i, text(lang, rng), lang, "s") for i, lang in enumerate(rng.choices(list(SYLLABLES), k=300))]
    odd = [(900, None, "aa", None), (901, "12 !?", "aa", None), (902, text("cc", rng, 30_000), None, None), (903, "", None, None), (None, rows[0][1], None, None)]
    docs = spark.createDataFrame(rows + odd + rows[:2], "doc_id long, text string, lang string, Score string").repartition(3)
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    model = prototypes(spark.createDataFrame([r for r in rows + odd if not held(r[0])], docs.schema))
    got = {}
    for r in identify(docs, *model).collect():
        got.setdefault(r.doc_id, []).append((r.lang_pred, r.score))
    assert got[0][0][0] == got[0][1][0] and abs(got[0][0][1] - got[0][1][1]) < 1e-9
    assert sum(map(len, got.values())) == len(rows) + len(odd) + 2
    assert sum(got[i][0][0] == lang for i, _, lang, _ in rows if held(i)) == sum(held(r[0]) for r in rows)
    assert [got[i][0] for i in (900, 901, 903)] == [("und", 0.0)] * 3 and got[902][0][0] == "cc"
    assert all(0 <= s <= 1 for x in got.values() for _, s in x)


def brute_vector(trigram, dimensions, seed):
    """Three letters bound: the first rotated by two, the second by one."""
    v = [np.random.default_rng([seed, ord(c) if c != " " else 0]).choice(np.array([-1, 1], np.int8), dimensions).astype(float) for c in trigram]
    return np.roll(v[0], 2) * np.roll(v[1], 1) * v[2]


def brute_profile(text, dimensions, seed):
    low = " " + re.sub(" +", " ", "".join(c.lower()[0] if c.isalpha() else " " for c in text or "")) + " "
    low = re.sub(" +", " ", low)
    return sum((brute_vector(low[i : i + 3], dimensions, seed) for i in range(len(low) - 2)), np.zeros(dimensions))


def test_model_and_scores_against_brute_force(spark):
    rng, dim, seed = random.Random(5), 128, 9
    rows = [(i, text(lang, rng, rng.randrange(1, 9)), lang) for i, lang in enumerate(rng.choices(list(SYLLABLES), k=40))]
    rows += [(90, "Ünd, 3 KA-lo", "bb"), (91, None, "aa"), (92, "...", "aa"), (93, "a" * 500, None), (94, "", "cc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    langs, model = prototypes(docs, dim, seed)
    unit = lambda m: m / np.linalg.norm(m, axis=-1, keepdims=True)
    count_norm = lambda t: np.linalg.norm(list(Counter(grams(t)).values()))
    grams = lambda t: [low[i : i + 3] for low in [re.sub(" +", " ", " " + "".join(c.lower()[0] if c.isalpha() else " " for c in t) + " ")] for i in range(len(low) - 2)]
    sums = {}
    for _, t, lang in rows:
        if lang and t and grams(t):
            sums[lang] = sums.get(lang, 0) + brute_profile(t, dim, seed) / count_norm(t)
    want = unit(np.array([sums[x] for x in sorted(sums)]))
    want = unit(want - want.mean(axis=0))
    assert langs == sorted(sums) and np.abs(model - want).max() < 1e-5
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify(docs, langs, model, seed).collect()}
    for i, t, _ in rows:
        if not any(c.isalpha() for c in t or ""):
            assert got[i] == ("und", 0.0)
            continue
        cosines = unit(brute_profile(t, dim, seed)) @ want.T
        e = np.exp(SHARPNESS * (cosines - cosines.max()))
        assert got[i][0] == langs[int(cosines.argmax())] and abs(got[i][1] - 1 / e.sum()) < 1e-4


def test_memory_does_not_follow_the_trigrams_of_a_text(monkeypatch):
    rng = random.Random(8)
    long = " ".join("".join(chr(0x4E00 + rng.randrange(9000)) for _ in range(3)) for _ in range(60_000))
    g, most = Trigrams(64, 1), []
    own = g.table_of
    monkeypatch.setattr(g, "table_of", lambda keys: most.append(len(keys)) or own(keys))
    keys, at, doc, many = g.counts([long, "ab"])
    got = g.bundles(2, keys, at, doc, many)
    assert len(keys) > 100_000 and max(most) <= 4096
    assert (got[1] == g.bundles(1, *g.counts(["ab"]))[0]).all()


def test_query_has_the_contract_s_columns(spark):
    df = op3_language_id(spark, "/root/testdata/sf0.001")
    assert df.dtypes[:4] == [("doc_id", df.dtypes[0][1]), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")]
    rows = df.collect()
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    known = {r.lang for r in docs.values() if r.lang} | {"und"}
    assert {r.lang_pred for r in rows} <= known


def test_empty_table_and_nothing_to_learn(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = prototypes(none)
    assert identify(none, *model).count() == 0
    assert [r.lang_pred for r in identify(spark.createDataFrame([(1, "abc", None)], none.schema), *model).collect()] == ["und"]
