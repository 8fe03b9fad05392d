"""The driver's contract."""

import __spark_entry__ as entry


def test_every_statement_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_flagship_query_has_a_stable_schema(spark):
    assert entry.entry(spark).columns == ["query_id", "doc_id", "score", "rank"]
