"""Retrieval against a plain computation: stems, column weights, frequencies over the whole index, null offsets."""

import math
import re
import os
from collections import Counter, defaultdict

import pytest

from parley.functions.stem import fold, porter
from parley.operators import graph as G
from parley.operators import retrieve as R
from parley.plans import ask, queries
from parley.sources.adapters import AS_OF_MS, World

CHUNKS = [
    (1, "m1", "Ann: the migrations of the pricing data are late", "Ann, Bo"),
    (2, "m1", "Bo: migrating prices is the plan for prices", "Bo"),
    (3, "m2", "Eve: we price every migration by hand", "Eve, Migrant"),
    (4, "m2", "Eve: nothing to say about it", None),
    (5, "m3", "Zoë: prices prices prices", "Zoe"),
    (6, "m3", "the hand", "Bo"),
    (7, "m3", "over the hills", "Bo"),
]


def tokens(text):
    return [porter(w) for w in re.findall(r"\w+", fold(text or ""))]


def brute(terms, chunks=CHUNKS):
    rows = {i: (Counter(tokens(t)), Counter(tokens(s)), len(tokens(t)) + len(tokens(s))) for i, _, t, s in chunks}
    n, avg = len(rows), sum(r[2] for r in rows.values()) / len(rows)
    looked = [porter(t) for t in terms]

    def tf(row, q, prefix):
        hit = [w for c in row[:2] for w in c if (w.startswith(looked[q]) if prefix and q == len(looked) - 1 else w == looked[q])]
        return sum(10 * row[0][w] + 2 * row[1][w] for w in set(hit))

    strict = {i for i, r in rows.items() if all(tf(r, q, True) for q in range(len(looked)))}
    prefix = bool(strict)
    chosen = strict or {i for i, r in rows.items() if any(tf(r, q, False) for q in range(len(looked)))}
    df = [sum(tf(r, q, prefix) > 0 for r in rows.values()) for q in range(len(looked))]
    idf = [max(1e-6, math.log((n - d + 0.5) / (d + 0.5))) for d in df]
    return {i: sum(idf[q] * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * rows[i][2] / avg)) for q in range(len(looked)) if (f := tf(rows[i], q, prefix))) for i in chosen}


def test_bm25_equals_a_plain_computation(spark, tmp_path):
    chunks = spark.createDataFrame(CHUNKS, "id long, meeting_id string, text string, speakers string")
    ix = R.index(chunks)
    ix.save(str(tmp_path / "index"))
    again = R.Index.load(spark, str(tmp_path / "index"))
    for terms in (["prices", "migr"], ["hand"], ["hand", "zebra"], ["prices", "prices"], ["migrations", "bo"], ["zoe"]):
        want = brute(terms)
        for one in (ix, again):
            got = {r["chunk_id"]: r["score"] for r in R.bm25(one, terms).collect()}
            assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-9 for i in want), terms


def test_mentions_without_an_offset_fall_back_to_the_first_window(spark):
    chunks = spark.createDataFrame([(1, "m", 0, 0.0, 10.0), (2, "m", 2, 8.0, 70.0), (3, "m", 4, 60.0, 75.0)], "id long, meeting_id string, src_id long, start_offset_s double, end_offset_s double")
    mentions = spark.createDataFrame([("a", "m", None), ("b", "m", 9.0), ("c", "m", 65.0), ("d", "m", 500.0), ("e", "other", 1.0)], "entity_id string, meeting_id string, offset_s double")
    got = {r["entity_id"]: r["chunk_id"] for r in G.nearest_chunks(mentions, chunks).collect()}
    assert got == {"a": 1, "b": 1, "c": 3, "d": 1}


DIR = "/root/testdata/sf0.001"


def plain_retrieval(w, question, with_graph, top):
    """(chunk_id, meeting_id, score, text) of a question, from collected tables."""
    chunks = w.chunks.collect()
    started = {r["id"]: r["started_at"] for r in w.meetings.collect()}
    terms = [t for t in re.sub(r"[^a-z0-9\s]", " ", question.lower()).split() if len(t) >= 2 and t not in R.T.STOP_QUERY]
    lexical = brute(terms, [(c["id"], c["meeting_id"], c["text"], c["speakers"]) for c in chunks])
    fused = defaultdict(float)
    for rank, i in enumerate(sorted(lexical, key=lambda i: (-round(lexical[i], 12), i))[:60]):
        fused[i] += 1 / (61 + rank)
    if with_graph:
        seeds = {e["id"] for e in w.entities.collect() if e["merged_into"] is None and any(t in e["norm"] for t in terms)}
        topics = w.entities.where("kind = 'topic' and merged_into is null")
        hop = {e["dst"] for e in G.related_edges(topics).collect() if e["src"] in seeds} - seeds
        found = {(-(m["entity_id"] in seeds), m["entity_id"], m["meeting_id"], m["offset_s"]) for m in w.entity_mentions.collect() if m["gate"] == "passed" and m["entity_id"] in seeds | hop}
        at = {}
        for place, (_, _, meeting, offset) in enumerate(sorted(found)[:80]):
            own = [c for c in chunks if c["meeting_id"] == meeting]
            inside = [c for c in own if c["start_offset_s"] <= offset <= c["end_offset_s"]]
            near = min(inside, key=lambda c: (c["end_offset_s"] - c["start_offset_s"], c["id"])) if inside else min(own, key=lambda c: c["src_id"], default=None)
            if near:
                at.setdefault(near["id"], place)
        for rank, i in enumerate(sorted(at, key=lambda i: (at[i], i))[:60]):
            fused[i] += 0.6 / (61 + rank)
    rows = {c["id"]: c for c in chunks}
    score = {i: f * (1 + 0.15 * math.exp(-max(0.0, (AS_OF_MS - started[rows[i]["meeting_id"]]) / 86_400_000) / 180)) for i, f in fused.items()}
    out, seen = [], Counter()
    for i in sorted(score, key=lambda i: (-round(score[i], 12), i)):
        seen[rows[i]["meeting_id"]] += 1
        if seen[rows[i]["meeting_id"]] <= 3:
            out.append((i, rows[i]["meeting_id"], score[i], rows[i]["text"]))
    return out[:top]


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_registered_questions_equal_a_plain_computation(spark):
    w, asked = World(spark, DIR), queries.queries()
    for name, top in (("cp_8_retrieve_hybrid", 12), ("api_2_search_brain", 8)):
        got, want = asked[name](spark, DIR).collect(), plain_retrieval(w, "red rod the person", True, top)
        assert sorted((r["chunk_id"], r["meeting_id"]) for r in got) == sorted(x[:2] for x in want) and got
        assert all(abs(r["score"] - {x[0]: x[2] for x in want}[r["chunk_id"]]) < 1e-9 for r in got)
    got = asked["cp_9_ask_extractive"](spark, DIR).collect()
    assert sorted(map(tuple, got)) == sorted((i, m, text[:80]) for i, m, _, text in plain_retrieval(w, ask.QUESTION, False, 12)[:3])
