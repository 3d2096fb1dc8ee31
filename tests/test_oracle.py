import importlib
import os

import pytest
from oracle import DATA, both, database

import __spark_entry__ as entry

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
CORE = {k: (m.QUERIES[k], s) for m in map(importlib.import_module, entry.MODULES) for k, s in m.ORACLE.items()}


@pytest.fixture(scope="module")
def db():
    pytest.importorskip("duckdb")
    return database()


@pytest.mark.parametrize("name", CORE)
def test_query_gives_what_its_sql_gives(spark, db, name):
    got, want = both(spark, db, *CORE[name])
    assert got == want
