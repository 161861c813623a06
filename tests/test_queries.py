"""Every query with SQL against DuckDB on the smallest tables."""

import ast
import datetime
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from parley.plans import queries as Q

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
SQL = Q.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as from '{DIR}/{t}.parquet'")
    return c


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda x: round(x, 6) if isinstance(x, float) else x.isoformat() if isinstance(x, datetime.datetime) else x
    return sorted(tuple(str(value(r[i])) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = Q.queries()[name](spark, DIR)
    want = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert plain(df.collect(), df.columns) == plain(want.fetchall(), want.columns)


def test_entry(spark):
    assert entry.entry(spark).count() == 3


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_recaps_hold_all_passed_claims(spark):
    w = Q.World(spark, DIR)
    got = Q._recaps(w).selectExpr("sum(size(key_decisions))", "sum(size(action_items))").first()
    kinds = {r["kind"]: r["count"] for r in w.claims.where("gate = 'passed' and get_json_object(body, '$.task') is not null").groupBy("kind").count().collect()}
    assert tuple(got) == (kinds.get("decision", 0), kinds.get("action_item", 0))


def test_notes_are_validated_for_all_claims(spark):
    w = Q.World(spark, DIR)
    assert Q._leaves(w).count() == Q._cites(w).count() > 0


def test_every_helper_of_the_registry_is_named_once():
    # Queries are lambdas that look their helpers up when they run: a name given twice changes the queries before it.
    tree = ast.parse(open(Q.__file__).read())
    assigned = Counter(t.id for n in tree.body if isinstance(n, ast.Assign) for t in n.targets if isinstance(t, ast.Name))
    assigned.update(n.name for n in tree.body if isinstance(n, ast.FunctionDef))
    assert [name for name, n in assigned.items() if n > 1] == []


def test_lists_of_all_rows_have_no_limit(spark):
    # A frame with a LIMIT is cut at some size of its tables, whatever the number.
    for name in ("flt_2_optional_predicates", "flt_9_edited_body", "flt_18_upcoming_window", "ag_2_counts_per_meeting", "ag_3_distinct_speakers"):
        plan = Q.queries()[name](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
        assert "GlobalLimit" not in plan and "LocalLimit" not in plan, name


def test_owners_of_meetings_are_made_in_several_tasks(spark):
    df = Q.queries()["cp_13_meeting_meta"](spark, DIR)
    assert df.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert "array_union" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_backoff_is_told_for_the_runs_of_the_table(spark):
    assert Q.queries()["sn_13_backoff"](spark, DIR).count() == spark.read.parquet(f"{DIR}/events.parquet").count()
