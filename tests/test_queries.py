"""Every registered query against its SQL, on the smallest tables; the others must run."""

import pytest

from textcohort import plans

from .conftest import DATA
from .oracle import assert_same, database


@pytest.fixture(scope="module")
def db():
    return database(DATA)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_matches_sql(spark, db, name):
    assert_same(plans.QUERIES[name](spark, DATA), db, plans.ORACLES[name])
    assert db.sql(plans.ORACLES[name]).limit(1).fetchall(), "the SQL finds nothing, so it shows nothing"


#: SQL that rightly finds nothing in the tables; test_without_sql and test_operators show what these find.
NOTHING = {"X03"}


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES) - NOTHING))
def test_gives_rows(spark, name):
    df = plans.QUERIES[name](spark, DATA)
    assert df.columns and df.count() > 0


def test_entry_imports_without_the_subpackage(monkeypatch):
    import importlib
    import importlib.util
    import sys

    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda n, *a: None if n.startswith(("textcohort.llm", "corpus_pipeline")) else real(n, *a))
    sys.modules.pop("__spark_entry__", None)
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    assert "M11" in names and "pipeline" not in names and not any(n.startswith("op") for n in names)
    assert set(entry.oracle_sql()) <= set(names)
    sys.modules.pop("__spark_entry__", None)
