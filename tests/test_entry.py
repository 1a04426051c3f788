"""Driver contract: entry smoke, registry coverage and oracle agreement at sf0.001."""

import importlib.util
import os
import sys

import pytest

from cohortlens.plans.queries import QUERIES

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def load(name, path):
    spec = importlib.util.spec_from_file_location(name, path)
    mod = importlib.util.module_from_spec(spec)
    sys.modules[name] = mod
    spec.loader.exec_module(mod)
    return mod


E = load("spark_entry_under_test", os.path.join(ROOT, "__spark_entry__.py"))
OC = load("oracle_check_under_test", os.path.join(ROOT, "tools", "oracle_check.py"))


def test_entry_smoke(spark):
    rows = E.entry(spark).collect()
    assert len(rows) == 5 and [r.BMI_Index for r in rows] == [1, 2, 3, 4, 5]


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(E.queries())
    assert set(QUERIES) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle_small(spark, name):
    ok, msg = OC.compare(spark, OC.duck("/root/testdata/sf0.001"), "/root/testdata/sf0.001", name,
                         E.queries(), E.oracle_sql())
    assert ok, msg
