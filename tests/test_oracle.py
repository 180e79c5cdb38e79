"""Every registered query against DuckDB on the same tables."""

import re

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from trolley.plans.oracle import all_sql
from trolley.plans.registry import all_queries
from trolley.sources import events_log
from tests.conftest import DATA

QUERIES, SQL = all_queries(), all_sql()


ORDERED = re.compile(r"ORDER BY [^()]*$")


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(repr(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{DATA}/sf0.01/events.parquet'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert len(QUERIES) >= 54


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, duck, name):
    result = QUERIES[name](spark, f"{DATA}/sf0.01")
    found = duck.execute(SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(result.columns) == sorted(columns)
    mine, theirs = result.collect(), found.fetchall()
    assert rows_of(result.columns, mine) == rows_of(columns, theirs)
    if ORDERED.search(SQL[name]):  # the SQL orders its rows, so their order counts
        place = [columns.index(c) for c in result.columns]
        assert [tuple(r) for r in mine] == [tuple(r[i] for i in place) for r in theirs]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_every_event_is_used(spark, sf):
    events = events_log.read_events(spark, f"{DATA}/{sf}")
    raw = events_log.raw_from_events(events)
    copies = events.filter("event_id % 90 = 0").count()
    own = raw.filter("user_session IS NULL OR user_session NOT LIKE 'bot-%'").count()
    assert own - copies == events.count()


def test_limits_are_reached(spark):
    sf = f"{DATA}/sf0.1"
    assert QUERIES["abandonment_by_brand"](spark, sf).count() == 15
    assert "6th+ visit" in {r.visit_stage for r in QUERIES["abandonment_by_visit_stage"](spark, sf).collect()}


def test_entry(spark):
    assert {r.outcome for r in entry(spark).collect()} == {"purchased", "removed", "abandoned_silent"}
