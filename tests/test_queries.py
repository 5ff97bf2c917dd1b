"""Every core query with SQL runs over the smallest test data and agrees with DuckDB."""

import datetime
import decimal
import os

import duckdb
import pytest

from clausemill.plans import registry

DATA = "/root/testdata/sf0.001"


def plain(value):
    if hasattr(value, "asDict"):
        value = value.asDict(recursive=True)
    if isinstance(value, float):
        return round(value, 5)
    if isinstance(value, decimal.Decimal):
        return round(float(value), 5)
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(DATA):
        pytest.skip("no test data here")
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"create view {name.split('.')[0]} as select * from '{DATA}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_agrees_with_sql(spark, duck, name):
    frame = registry.queries()[name](spark, DATA)
    columns = sorted(frame.columns)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=repr)
    cursor = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert sorted(names) == columns
    assert mine == theirs


#: Searches with a walk over a lattice or readings of texts in Python; compared with brute force in test_answers.py.
ROWS_ONLY = {
    "d8_lattice_seeds", "d9_bridged_terms", "d10_teleport", "d13_discovered_golden", "j10_direct_tiers", "x9_routed_golden", "x11_public_search", "x11_zero_results", "x12_resolved_clauses", "x13_read_clauses", "x14_clause_records", "x15_followed_clauses", "x39_graph_grid",
}


@pytest.mark.parametrize("name", sorted(ROWS_ONLY))
def test_runs(spark, name):
    registry.queries()[name](spark, DATA).collect()


def test_every_other_query_has_sql():
    assert set(registry.queries()) - set(registry.oracle_sql()) == ROWS_ONLY
