"""The stored index: questions, replaced and removed meetings, merging, against flat postings and plain counting."""

import random
from collections import Counter

import pytest
from test_retrieval import CHUNKS, brute

from parley.operators import retrieve as R
from parley.operators import search_index as X

SCHEMA = "id long, meeting_id string, text string, speakers string"
WORDS = ["price", "prices", "pricing", "plan", "plans", "Zoë", "hand", "hills", "over", "the", "migrate", "migration", "café", "lunch"]
ASKED = (["prices", "migr"], ["hand"], ["hand", "zebra"], ["prices", "prices"], ["migrations", "bo"], ["zoe"], ["pl"], ["the", "p"], ["zebra"], ["over", "hills", "cafe"])


def chunks_of(r, meetings, start=0):
    return [(start + i, f"m{r.choice(meetings)}", " ".join(r.choice(WORDS) for _ in range(r.randint(0, 12))), r.choice([None, "Bo", "Zoë, Ann"])) for i in range(90)]


def same_answers(index, flat, asked=ASKED[4:8]):
    for terms in asked:
        want = sorted(((r["chunk_id"], r["score"]) for r in R.bm25(flat, terms).collect()), key=lambda x: (-x[1], x[0]))
        for k in (3, 1000) if len(asked) > 4 else (5,):
            got = [(r["chunk_id"], r["score"]) for r in index.search(terms, k).collect()]
            assert [g[0] for g in got] == [w[0] for w in want[:k]], (terms, k)
            assert all(abs(g[1] - w[1]) < 1e-9 for g, w in zip(got, want)), terms


def same_index(index, chunks, spark):
    """index holds what a full build over chunks holds."""
    full = R.index(spark.createDataFrame(chunks, SCHEMA))
    key = lambda df: sorted(map(tuple, df.select("chunk_id", "term", "tf", "dl").collect()))
    assert key(index.flat().postings) == key(full.postings)
    assert (index.n, index.length) == (len(chunks), round(full.totals.first()["avgdl"] * len(chunks)))
    df = Counter(t for _, t, _, _ in key(full.postings))
    assert {r["term"]: r["n"] for r in index._read("terms").groupBy("term").agg(R.F.sum("df").alias("n")).where("n <> 0").collect()} == dict(df)
    assert sorted(map(tuple, index.chunks().select("id", "meeting_id", "text", "speakers").collect()), key=str) == sorted(chunks, key=str)
    return full


@pytest.fixture
def many_shards(monkeypatch):
    monkeypatch.setattr(X, "SHARD_BITS", 2)
    monkeypatch.setattr(X, "FIRST_SHARDS", 2)


def test_scores_equal_a_plain_computation(spark, tmp_path):
    index = X.StoredIndex.create(spark, str(tmp_path / "ix")).update(spark.createDataFrame(CHUNKS, SCHEMA))
    for terms in ASKED[:4]:
        want = brute(terms)
        got = {r["chunk_id"]: r["score"] for r in index.search(terms, 100).collect()}
        assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-9 for i in want), terms


def test_updates_removals_and_merges_equal_full_builds(spark, tmp_path, many_shards):
    r = random.Random(8)
    now = chunks_of(r, range(12))
    index = X.StoredIndex.create(spark, str(tmp_path / "ix")).update(spark.createDataFrame(now, SCHEMA))
    same_answers(index, R.index(spark.createDataFrame(now, SCHEMA)), ASKED)
    for step in range(1):
        new = chunks_of(r, range(3 * step, 3 * step + 5), 1000 * (step + 1))
        gone = {c[1] for c in new} | {"m11"}
        index = index.update(spark.createDataFrame(new, SCHEMA), spark.createDataFrame([("m11",), ("never",)], "meeting_id string"))
        now = [c for c in now if c[1] not in gone] + new
    full = same_index(index, now, spark)
    same_answers(index, full)
    again = X.StoredIndex.open(spark, index.path)
    assert again == index and len(again.segments) == 2
    again = again.remove(spark.createDataFrame([(now[-1][1],)], "meeting_id string"))
    now = [c for c in now if c[1] != now[-1][1]]
    merged = again.merge()
    merged.vacuum()
    assert len(merged.segments) == 1 and not (tmp_path / "ix" / "segment=0").exists()
    same_answers(merged, same_index(merged, now, spark), ASKED[1:2])
    assert X.StoredIndex.open(spark, index.path) == merged


def test_many_replaced_meetings_are_joined_not_named(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "NAMED", 2)
    r = random.Random(4)
    first, second = chunks_of(r, range(9)), chunks_of(r, range(4), 500)
    index = X.StoredIndex.create(spark, str(tmp_path / "ix")).update(spark.createDataFrame(first, SCHEMA)).update(spark.createDataFrame(second, SCHEMA))
    gone = {c[1] for c in second}
    same_index(index, [c for c in first if c[1] not in gone] + second, spark)


def test_empty_index_and_questions_without_terms(spark, tmp_path):
    index = X.StoredIndex.create(spark, str(tmp_path / "ix"))
    assert index.search(["price"], 3).count() == 0 and index.remove(spark.createDataFrame([("m",)], "meeting_id string")) == index
    index = index.update(spark.createDataFrame([(1, None, "price", None), (2, "m", None, None)], SCHEMA))
    assert index.search([], 3).count() == 0
    assert [r["chunk_id"] for r in index.search(["price"], 3).collect()] == [1]


def test_a_question_reads_the_row_groups_of_its_terms(spark, tmp_path):
    index = X.StoredIndex.create(spark, str(tmp_path / "ix")).update(spark.createDataFrame(CHUNKS, SCHEMA))
    plan = index._heads(R.F.col("term") == "price")._jdf.queryExecution().toString()
    assert "EqualTo(term,price)" in plan and "entries" not in plan.split("ReadSchema:")[1].split("\n")[0]
