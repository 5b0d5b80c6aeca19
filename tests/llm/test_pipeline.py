import random
import re
from collections import Counter

import pytest

import corpus_pipeline as p
from quadrille.stored import paths

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b + c for a in ("ka", "lo", "mi", "ze") for b in ("ne", "ru", "so") for c in ("ta", "ve", "zi")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(10)) for _ in range(n))


def corpus(rng):
    passage = prose(rng, 60)
    texts = [prose(rng, 80) + "\nall rights reserved\n" + prose(rng, 30) for _ in range(60)]
    texts += [" ".join(rng.choice(["BUY", "NOW!!!", "$$$"]) for _ in range(120)) for _ in range(40)]
    copied = prose(rng, 100)
    texts += [copied] * 12 + [copied.replace(copied.split()[50], "other", 1)]
    texts += [prose(rng, 40) + " " + passage + " " + prose(rng, 40) for _ in range(3)]
    texts += [None, "", prose(rng, 20_000)]
    return [(i, t, "en", None if i == 3 else "src", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows = corpus(random.Random(8))
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([*rows, rows[5]], SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 0 if t and "BUY" in t else 1, 0) for i, t, *_ in rows if i % 3], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, rows


def test_each_stage_on_its_own_input(spark, folder):
    d, rows = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    before, frames = [tuple(r) for r in docs.collect()], [docs]
    for name, stage in p.STAGES[:-1]:
        docs = p.written(stage(spark, docs, d), "test")
        frames.append(docs)
        assert docs.columns == list(p.COLUMNS), name
        now = [tuple(r) for r in docs.collect()]
        was = {r[0]: r[1] or "" for r in before}
        if name == "quality":
            junk = {r[0] for r in rows if "BUY" in (r[1] or "")}
            assert {r[0] for r in now} >= {r[0] for r in rows if len(r[1] or "") > 100} - junk and not junk & {r[0] for r in now}
        if name == "line_dedup":
            assert [r[0] for r in now if "all rights reserved" in r[1]] == [0] * sum(r[0] == 0 for r in now)
            holders = {}
            for i in sorted(was):
                for line in was[i].split("\n"):
                    holders.setdefault(line.strip().lower(), []).append(i)
            gone = {line: own[0] for line, own in holders.items() if line and len(set(own)) >= 10}
            for r in now:
                assert r[1] == "\n".join(x for x in was[r[0]].split("\n") if gone.get(x.strip().lower(), r[0]) == r[0])
            assert len(gone) == 2
        if name == "jaccard_join":
            shingles = {r[0]: {tuple(w[i : i + 5]) for w in [re.findall(r"\S+", r[1])] for i in range(max(1, len(w) - 4))} for r in now}
            ids = sorted(shingles)
            assert len(ids) == len(now)
            assert not [(a, b) for a in ids for b in ids if a < b and len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b])]
        if name == "substring_dedup":
            seen = Counter(tuple(w[i : i + 35]) for t in was.values() for w in [re.findall(r"\S+", t)] for i in range(len(w) - 34))
            for r in now:
                w = re.findall(r"\S+", was[r[0]])
                gone = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
                assert r[1] == " ".join(x for j, x in enumerate(w) if j not in gone) and r[4] == len(r[1])
            assert any(len(t) > len(r[1]) + 200 for r in now for t in [was[r[0]]])
        before = now
    pieces = p.STAGES[-1][1](spark, docs, d).collect()
    assert sorted({r.doc_id for r in pieces}) == sorted(r[0] for r in before)
    had = paths()
    assert sorted((r.doc_id, r.start, r.length) for r in pieces) == sorted((r.doc_id, r.start, r.length) for r in p.run(spark, d).collect())
    assert len(paths()) == len(had) + 1


def test_empty_table(spark, folder, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder[0]}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0
