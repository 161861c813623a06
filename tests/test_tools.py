"""The query API against its SQL, its limits, and one meeting derived anew."""

import os

import duckdb
import pytest

from parley.operators import gates as Q
from parley.plans import queries
from parley.plans.tools import Tools, rederive
from parley.sources.adapters import World

from test_queries import DIR, TABLES, plain

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
ADDED = [n for n in queries.oracle_sql() if n.startswith(("api_", "gt_18"))]


@pytest.mark.parametrize("name", ADDED)
def test_equals_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as from '{DIR}/{t}.parquet'")
    df, want = queries.queries()[name](spark, DIR), c.sql(queries.oracle_sql()[name])
    got = df.collect()
    assert got and plain(got, df.columns) == plain(want.fetchall(), want.columns)


def test_limits(spark):
    tools = Tools(World(spark, DIR))
    for call in (lambda: tools.search_brain("x", 21), lambda: tools.list_claims(limit=0), lambda: tools.list_meetings(101), lambda: tools.get_evidence("m1", ["S001"] * 11)):
        with pytest.raises(ValueError):
            call()
    assert tools.get_entity("no such thing at all").mentions.count() == 0
    assert tools.get_meeting("nowhere").meeting.count() == 0
    assert "## Topics" in tools.refresh_brain_md()


def test_rederived_mentions_are_of_one_meeting_and_gated(spark):
    rows = rederive(World(spark, DIR), "m5")[2].collect()
    assert {r["meeting_id"] for r in rows} <= {"m5"} and {r["gate"] for r in rows} <= {"passed", "blocked"}


def test_unsourced_prose(spark):
    lines = spark.createDataFrame([("a", "Hi Maya"), ("b", "see you at 5 on Friday"), ("c", "he said “we will buy”"), ("d", 'a "no"'), ("e", None)], "path string, text string")
    assert {(r["path"], r["rule"]) for r in Q.unsourced_failures(lines).collect()} == {("b", "verbatim-number"), ("c", "exact-quote")}
