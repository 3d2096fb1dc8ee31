import os

import pytest
from oracle import DATA, both, database

from termforge.llm import queries as Q

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    pytest.importorskip("duckdb")
    return database()


@pytest.mark.parametrize("name", Q.ORACLE)
def test_query_gives_what_its_sql_gives(spark, db, name):
    got, want = both(spark, db, Q.QUERIES[name], Q.ORACLE[name])
    assert got == want
