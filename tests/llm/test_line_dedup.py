from collections import defaultdict

import pytest

from quadrille.llm import line_dedup as x

WHITE = " \t\n\x0b\x0c\r"


def brute(rows, min_docs, keep_first, min_length=1):
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s.strip(WHITE))
    docs, first = defaultdict(set), {}
    for i, t in rows:
        for p, line in enumerate((t or "").split("\n")):
            docs[low(line)].add((i, t or ""))
            first[low(line)] = min(first.get(low(line), (i, p)), (i, p))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        bad = [len(low(q)) >= min_length and len(docs[low(q)]) >= min_docs and not (keep_first and first[low(q)] == (i, p)) for p, q in enumerate(lines)]
        out.append((i, len(lines), sum(bad), "\n".join(q for q, b in zip(lines, bad, strict=True) if not b)))
    return sorted(out)


def rows():
    long = "\n".join(f"line {k % 1500}" for k in range(3000))
    base = [(i, f" Shared\t\nown {i}\n\nshared\nÉtat\n{'two' if i < 2 else 'x' + str(i)}") for i in range(12)]
    return [*base, (50, None), (51, ""), (52, "\n\n"), (53, "état\nShared\x0b"), (54, long), (55, long), (12, "own 3\r\nown 4"), base[0]]


@pytest.mark.parametrize("min_docs,keep_first,min_length", [(2, True, 1), (2, False, 1), (10, False, 1), (2, True, 5)])
@pytest.mark.parametrize("heavy", [False, True])
def test_against_brute_force(spark, monkeypatch, min_docs, keep_first, min_length, heavy):
    if heavy:
        monkeypatch.setattr(x, "heavy_keys", lambda occ: [r[0] for r in occ.groupBy("h1").count().where("count > 5").select("h1").collect()])
    docs = spark.createDataFrame([(i, t, "a", "b") for i, t in rows()], "doc_id long, text string, kept string, H1 string").repartition(3)
    got = sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in x.line_dedup(docs, min_docs, keep_first, min_length).collect())
    assert got == brute(rows(), min_docs, keep_first, min_length)


def test_heavy_keys_are_found(spark):
    docs = spark.createDataFrame([(i, "the line") for i in range(900)] + [(i, f"l{i}") for i in range(900, 1800)], "doc_id long, text string")
    assert len(x.heavy_keys(x.occurrences(docs))) == 1


def test_query_and_sql_against_brute_force(spark, tmp_path):
    """All six kinds of white space at the ends of lines, in twelve documents; inside a line they count."""
    import hashlib

    import duckdb

    ends = ["\r", "\x0b", "\x0c", "\t", " ", "", "\r ", " \x0c\x0b", "\x85", "\u00a0", "", "\r"]
    docs = [(i, f"{e if i % 2 else ''}Same Line{e}\nown {i}\nin{e}side\n\n") for i, e in enumerate(ends)]
    docs += [(i, f"same line\r\nI {i}") for i in range(20, 28)] + [(90, None), (91, "\x0bSAME LINE")]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    want = sorted((i, n, k, hashlib.sha256(t.encode()).hexdigest()) for i, n, k, t in brute(docs, 10, False))
    got = x.op4_line_dedup(spark, str(tmp_path))
    assert [c for c in got.columns] == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    assert sorted(map(tuple, got.collect())) == want
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        assert sorted(db.execute(f"SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM ({x.OP4_SQL})").fetchall()) == want


def test_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a\nb"), (None, "a\nc"), (1, "b")], "doc_id long, text string")
    assert sorted(r.kept for r in x.line_dedup(docs, 2, False).collect()) == ["", "", "c"]
    assert x.line_dedup(docs.limit(0)).count() == 0
