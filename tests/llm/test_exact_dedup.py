from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quadrille.llm import exact_dedup as x
from quadrille.stored import new_path

SCHEMA = "doc_id long, text string, KEEP string, digest string"


def brute(rows):
    norm = lambda t: "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i or 0, i))
    return sorted(((i, min(groups[norm(t)])[3], len(groups[norm(t)])) for i, t in rows), key=repr)


def run(spark, rows):
    got = x.exact_dedup(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)).collect()
    assert all(r.kept or r.doc_id != r.keep_id or r.group_size > 1 for r in got)
    return sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=repr)


def test_groups_ties_nulls_long_and_repeated_rows(spark):
    rows = [(5, "a b"), (3, "ab"), (4, "a\tb"), (9, "é b"), (7, None), (8, ""), (1, " \n "), (2, "x" * 200_000), (6, "x" * 200_000), (None, "ab"), (5, "a b"), (11, "A b")]
    assert run(spark, rows) == brute(rows)


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 10**6), st.text("aB \t\n\x85é", max_size=4)), min_size=1, max_size=25, unique_by=lambda r: r[0]))
def test_random(spark, rows):
    assert run(spark, rows) == brute(rows)


def test_state_goes_on_without_expiry(spark):
    where = new_path(spark, "state")
    one = lambda rows: {r.doc_id: (r.keep_id, r.group_size) for r in x.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), where).collect()}
    assert one([(4, "a b"), (5, "q")]) == {4: (4, 1), 5: (5, 1)}
    assert one([(1, "ab"), (2, "a  b")]) == {1: (2, 3), 2: (2, 3)}


def test_equal_digests_with_other_bytes_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(x.F, "sha2", lambda c, n: x.F.lit("same"))
    rows = [(1, "a"), (2, " a"), (3, "b")]
    assert run(spark, rows) == brute(rows)


def test_hits_on_earlier_calls_are_checked_by_their_bytes(spark, monkeypatch):
    """One digest for all texts: later calls must tell theirs from the texts that the locators lead to."""
    monkeypatch.setattr(x.F, "sha2", lambda c, n: x.F.lit("same"))
    where, seen = new_path(spark, "state"), []
    for rows in ([(4, "a b"), (5, "q")], [(1, "ab"), (2, "a  b"), (6, "new"), (7, " new")], [(8, "q"), (9, "new"), (3, "other")]):
        seen += rows
        want = {i: (k, n) for i, k, n in brute(seen)}
        got = x.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), where).collect()
        assert {r.doc_id: (r.keep_id, r.group_size) for r in got} == {i: want[i] for i, _ in rows}


def test_texts_without_a_hit_are_filtered_before_they_are_shuffled(spark, tmp_path):
    spark.range(2000).selectExpr("id as doc_id", "concat('text ', id % 1900) as text").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    seen = x.written(x.texts(docs).groupBy("digest").agg(x.F.count(x.F.lit(1)).alias("n")), "seen")
    with x.configured(spark, x.FILTER_CONF):
        plan = x.clashes(docs, seen.where("n > 1"), None)._jdf.queryExecution().executedPlan().toString()
    assert "might_contain" in plan
    below = plan[plan.rindex("might_contain") :]
    assert "partial_min" not in below.split("FileScan")[0]  # the filter stands between the scan and the partial sums


def test_empty_table(spark):
    assert x.exact_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
