"""The contract file imports and its parts fit together."""

import __spark_entry__ as e


def test_sql_only_for_registered_queries():
    assert set(e.oracle_sql()) <= set(e.queries())
