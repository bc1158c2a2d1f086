"""The SQL of corpus queries against the operators on odd documents: nulls, blanks, ties, repeated rows."""

import duckdb
import pytest

from tests.llm.cases import frame, odd_rows
from tests.llm.test_secret_scan import TEXTS, hex_keys
from tidemark.llm import decontamination, fill_middle, nearduplicates, oracle, quality, secret_scan, sharding
from tools.compare import rows_of

ITEMS = [(1, "one two three"), (2, odd_rows()[4][1]), (None, "12345 67890"), (3, None), (4, " - "), (10, odd_rows()[4][1][30:200])]


def told_apart(rows):
    """Rows whose doc_id is known and occurs once."""
    ids = [r[0] for r in rows]
    return [r for r in rows if r[0] is not None and ids.count(r[0]) == 1]


CASES = {
    "quality": (quality.judge, oracle.QUALITY, odd_rows()),
    "secrets": (secret_scan.scan, oracle.SECRETS, odd_rows() + [(100 + i, t, "en", "a", 0) for i, t in enumerate(
        TEXTS + [t for texts in hex_keys() for t in texts])]),
    "decontamination": (lambda docs: decontamination.contamination(
        docs, docs.sparkSession.createDataFrame(ITEMS, "item_id long, text string")), oracle.DECONTAMINATION, odd_rows()),
    "fill_middle": (fill_middle.report, oracle.FILL_MIDDLE, odd_rows() + [(200 + i, t, "en", "a", 0) for i, t in enumerate(
        ["\n", "a\nb", "a\n\nb\n", "<P>", "é\n𝔘\n" * 9])]),
    "shards": (sharding.byte_shards, oracle.SHARDS, odd_rows()),
    "near_duplicates": (nearduplicates.duplicates, oracle.NEAR_DUPLICATES, told_apart(odd_rows())),
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("some", [True, False])
def test_sql_equals_operator(spark, name, some):
    run, text, rows = CASES[name]
    rows = rows if some else []
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.execute("CREATE TABLE benchmark(item_id BIGINT, text VARCHAR)")
    for row in rows:
        con.execute("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", list(row))
    for row in ITEMS:
        con.execute("INSERT INTO benchmark VALUES (?, ?)", list(row))
    got, want = run(frame(spark, rows)), con.execute(text)
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(columns, want.fetchall())
