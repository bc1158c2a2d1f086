"""Every registered query against its SQL on the small data, compared exactly."""

import pytest

import __spark_entry__ as entry
from tools import compare as tool

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    return tool.database(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, database, name):
    line = tool.compare(spark, database, FOLDER, name, entry.queries()[name],
                        entry.oracle_sql().get(name))
    assert line.startswith(("ok", "rows")), line


def test_entry_has_rows_and_a_stable_schema(spark):
    first, second = entry.entry(spark), entry.entry(spark)
    assert first.schema == second.schema and first.count() > 0


def test_every_own_query_has_sql():
    """Queries of the corpus operators are held against brute force in their own tests; some have SQL too."""
    corpus = {name for name in entry.queries() if name.startswith("op") and name[2].isdigit()} | {"pipeline"}
    assert set(entry.queries()) - corpus == set(entry.oracle_sql()) - corpus
