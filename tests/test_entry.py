"""The entry points, and every registered query beside its SQL on the smallest tables."""

import importlib
import sys

import pytest

import __spark_entry__ as entry
import compare

TABLES = "/root/testdata/sf0.001"
SPATIAL = sorted(importlib.import_module("quadrille.plans.queries").queries())


def test_flagship_query(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["zoom", "cell_x", "cell_y", "gene", "n", "sum_x", "sum_y"]


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SPATIAL)
def test_query(spark, name):
    said = compare.compare(spark, TABLES, name)
    assert ": same" in said or ", no SQL" in said, said


def test_without_the_text_operators(monkeypatch):
    """The entry points work where quadrille.llm and corpus_pipeline are gone."""
    for name in [m for m in sys.modules if m.startswith(("quadrille.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)

    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name == "quadrille.llm" or name.startswith("quadrille.llm.") or name == "corpus_pipeline":
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    monkeypatch.delattr(importlib.import_module("quadrille"), "llm", raising=False)
    assert sorted(entry.queries()) == SPATIAL
