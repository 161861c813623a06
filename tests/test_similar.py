"""Similarity joins against all pairs, with keys that most labels have."""

import random

import plain_labels as P
import pytest

from parley.operators import entities as E
from parley.operators import graph as G
from parley.operators import similar as S

WORDS = ["pricing", "prices", "rollout", "roll", "dashboard", "sales", "cs", "anz", "deck", "board", "onboarding", "q3", "review", "reviews"]


def some_labels(r, n, hot=True):
    out = set()
    while len(out) < n:
        words = [r.choice(WORDS) if r.random() < 0.6 else "".join(r.choice("abcdeint") for _ in range(r.randint(2, 9))) for _ in range(r.randint(1, 7))]
        if hot and r.random() < 0.9:
            words.insert(r.randint(0, len(words)), "customer")
        out.add(" ".join(words))
    return [(f"topic:{i:03d}", x) for i, x in enumerate(sorted(out))]


@pytest.mark.parametrize("hot", [3, 1000])
def test_relate_equals_all_pairs(spark, monkeypatch, hot):
    labels = some_labels(random.Random(hot), 110) + [("x1", ""), ("x2", "the of"), ("x3", "customer"), ("x4", "the customer")]
    monkeypatch.setattr(S.candidate_pairs, "__defaults__", (hot, "id", "label"))
    got = {(r["a"], r["b"]): r["score"] for r in G.relate(spark.createDataFrame(labels, "id string, label string")).collect()}
    want = {}
    for i, (a, la) in enumerate(sorted(labels)):
        for b, lb in sorted(labels)[i + 1 :]:
            score = P.alike(la, lb)
            if set(P.toks(la)) & set(P.toks(lb)) and 0.15 <= score < 0.72:
                want[a, b] = score
    assert set(got) == set(want) and all(abs(got[p] - want[p]) < 1e-9 for p in want)


def test_a_token_of_most_labels_makes_few_candidates(spark):
    def count(n):
        r = random.Random(n)
        word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8))
        labels = [(f"t{i}", " ".join([*(word() for _ in range(4)), *(["ok"] if r.random() < 0.9 else []), *(word() for _ in range(4))])) for i in range(n)]
        return S.candidate_pairs(spark.createDataFrame(labels, "id string, label string"), 0.15, hot=50).count()

    few, many = count(300), count(1200)
    # All pairs that share the token: 36,000 and 583,000.
    assert many < 16 * max(few, 300) and many < 40_000


@pytest.mark.parametrize("hot", [2, 1000])
def test_containment_and_best_match_equal_all_pairs(spark, monkeypatch, hot):
    r = random.Random(hot + 1)
    entities = [(i, r.choice(["topic", "topic", "person"]), x, x, "e" if r.random() < 0.1 else None) for i, x in some_labels(r, 60)]
    cands = [(r.choice(["topic", "person"]), x) for _, x in some_labels(r, 50)] + [("topic", "customer"), ("topic", "customer anz"), ("topic", "")]
    monkeypatch.setattr(S.two_best, "__defaults__", (hot,))
    e = spark.createDataFrame(entities, "id string, kind string, label string, norm string, merged_into string")
    c = spark.createDataFrame(cands, "kind string, surface string")
    live = [x for x in entities if x[4] is None]
    inside = set()
    for kind, s in cands:
        for i, k, label, *_ in live:
            x, y = set(P.toks(s)), set(P.toks(label))
            if k == kind and x and y and (x <= y or y <= x):
                inside.add((s, i))
    assert {(x["surface"], x["entity_id"]) for x in E.contained(c, e).collect()} == inside
    got = {x["surface"]: (x["entity_id"], round(x["score"], 9), round(x["runner_up"], 9)) for x in E.best_lexical(c, e).collect()}
    for kind, s in cands:
        scores = sorted(((-round(P.alike(s, label), 9), i) for i, k, label, *_ in live if k == kind))
        if scores and scores[0][0] < 0:
            assert got[s] == (scores[0][1], -scores[0][0], -scores[1][0] + 0.0), s


def test_names_that_differ_in_a_number_do_not_meet_pair_by_pair(spark, monkeypatch):
    made = []
    met = S._met
    monkeypatch.setattr(S, "_met", lambda *a: made.append(met(*a)) or made[-1])
    names = [(i, f"Fact m{i}", "person", (i * 37) % 400) for i in range(400)]
    rows = spark.createDataFrame(names, "id int, label string, kind string, at int")
    one, two = S.featured(rows, "id", "label", "kind", "at"), S.featured(rows.where("id % 2 = 0"), "id", "label", "kind", "at")
    got = {}
    for r in S.two_best(one, two, ["kind"], hot=20, entered="at", now="at").collect():
        got.setdefault(r["id"], {})[r["place"]] = round(r["score"], 9)
    for i, label, _, at in names:
        scores = sorted((round(P.alike(label, other), 9) for j, other, _, t in names if j % 2 == 0 and t < at), reverse=True)[:2]
        assert got.get(i, {}) == dict(enumerate(scores, 1)), label
    # 400 x 200 pairs of rows; shapes are few, and a bar that shared words cannot reach makes no pairs at all.
    assert len(made) == 1 and made[0].count() < 4000
    assert S.candidate_pairs(rows.withColumn("id", rows["id"].cast("string")), 0.67, hot=20).count() < 400
