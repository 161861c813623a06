"""Scripted compositions: bad, bad, good; soft only; never good; and the configuration."""

import json

from pyspark.sql import functions as F

from parley import config
from parley.operators import segments
from parley.plans import compose


def notes(*leaves):
    return json.dumps({"themes": [{"text": "Decisions", "children": [{"text": t, "source": s} for t, s in leaves]}]})


def test_compose(spark):
    u = spark.createDataFrame([(m, 0, "Ann", "customer", "We agreed to pay $40 a seat", 0.0, 5.0, None) for m in ("a", "b", "c")], "meeting_id string, idx int, speaker string, speaker_role string, text string, offset_s double, duration_s double, confidence double")
    owners = spark.createDataFrame([(m, ["Ann"]) for m in ("a", "b", "c")], "meeting_id string, names array<string>")
    good, wrong, none = ("They agreed to pay $40 a seat", ["S001"]), ("They agreed to pay $50 a seat", ["S001"]), ("Nobody said so", ["S9"])
    title = ("Seat price", ["S001"])
    tries = [("a", 1, notes(wrong)), ("a", 2, notes(none)), ("a", 3, notes(good)), ("b", 1, notes(title)), ("b", 2, notes(title)), ("c", 1, notes(wrong)), ("c", 2, notes(wrong)), ("c", 3, notes(good, wrong, none))]
    got = {r["meeting_id"]: r for r in compose.compose(spark.createDataFrame(tries, "meeting_id string, attempt int, json string"), segments.segments(u), owners).collect()}
    assert [got[m]["outcome"] for m in "abc"] == ["clean", "soft", "pruned"]
    assert got["a"]["markdown"] == got["c"]["markdown"] == "- Decisions\n  - They agreed to pay $40 a seat [S001]"
    assert "Seat price" in got["b"]["markdown"]


def test_config():
    assert config.load("not json") == config.Config() and config.load("[1]") == config.Config()
    assert config.load('{"model": "x", "retry_attempts": "three"}').model == "x" and config.load('{"retry_attempts": "three"}').retry_attempts == 3
    assert config.fill("Hi {{name}}{{gone}}!", {"name": "Ann"}) == "Hi Ann!"
