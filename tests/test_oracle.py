"""Every registered query against its DuckDB oracle over the same derived tables."""

import importlib.util
import os

import pytest

from harness import ROOT, compare, duck

_spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
entry_mod = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(entry_mod)

from souk.plans.registry import REGISTRY  # noqa: E402

QUERIES = {n: f for n, f in entry_mod.queries().items() if n in REGISTRY}
ORACLE = {n: q for n, q in entry_mod.oracle_sql().items() if n in REGISTRY}


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, sf_dir, con, name):
    ok, msg = compare(QUERIES[name](spark, sf_dir), con, ORACLE[name])
    assert ok, f"{name}: {msg}"


def test_entry_smoke(spark):
    df = entry_mod.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["id", "name", "email", "completed", "avg_rating", "reviews_count", "balance"]
