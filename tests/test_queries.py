"""Each query that has SQL gives the same rows as DuckDB on the smallest tables."""

from collections import Counter

import duckdb
import pytest

from tidewire.plans import catalog, certificates, decode_catalog, reply_catalog, report_catalog, tables_catalog, tree_catalog

SF = "/root/testdata/sf0.001"
TABLES = ("events", "pages", "documents", "customer", "orders", "lineitem")
QUERIES = catalog.QUERIES | decode_catalog.QUERIES | report_catalog.QUERIES | certificates.QUERIES | reply_catalog.QUERIES | tree_catalog.QUERIES | tables_catalog.QUERIES
ORACLES = catalog.ORACLES | decode_catalog.ORACLES | report_catalog.ORACLES | certificates.ORACLES | reply_catalog.ORACLES | tree_catalog.ORACLES | tables_catalog.ORACLES
CASES = sorted(ORACLES)
#: Queries whose right answer has no rows.
EMPTY = {"filter_empty_set"}


@pytest.fixture(scope="module")
def con():
    found = duckdb.connect()
    for name in TABLES:
        found.execute(f"create view {name} as select * from read_parquet('{SF}/{name}.parquet')")
    return found


def rounded(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", CASES)
def test_same_rows_as_sql(spark, con, name):
    got = QUERIES[name](spark, SF)
    wanted = con.execute(ORACLES[name])
    columns = sorted(c[0] for c in wanted.description)
    assert sorted(got.columns) == columns
    at = [[c[0] for c in wanted.description].index(c) for c in columns]
    rows = wanted.fetchall()
    assert bool(rows) != (name in EMPTY)
    expected = Counter(tuple(rounded(row[i]) for i in at) for row in rows)
    assert Counter(tuple(rounded(row[c]) for c in columns) for row in got.collect()) == expected
