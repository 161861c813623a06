"""Resolution over all meetings against a plain version that takes one candidate after the other."""

import random
import re

import plain_labels as P
import pytest

from parley.operators import entities as E
from parley.operators import resolution as R
from parley.plans import queries as Q

DIR = "/root/testdata/sf0.001"

WORDS = ["pricing", "prices", "rollout", "dashboard", "sales", "anz", "deck", "board", "onboarding", "migration", "migrations", "warehouse", "issue"]
PLACEHOLDER = re.compile(r"(you|them|me|myself|agent|customer|speaker ?[0-9]*|room ?[0-9]*|unknown)")


def slug(kind, surface):
    return kind + ":" + P.dashed(surface)


def plain(cands, entities):
    """One after the other, with a growing list of entities and aliases."""
    known = [(i, k, label) for i, k, label, _, m in sorted(entities) if m is None]
    ids, dead = {e[0] for e in entities}, {e[0] for e in entities if e[4] is not None}
    aliases = {}
    for i, k, _, norm, m in sorted(entities):
        if m is None:
            aliases.setdefault((k, norm), i)
    out = []
    for meeting in sorted({c[0] for c in cands}):
        local, found = list(known), []
        for _, kind, surface, seq, proof in sorted((c for c in cands if c[0] == meeting), key=lambda c: c[3]):
            own, norm, toks = slug(kind, surface), P.norm(surface), P.toks(surface)
            same = [k for k in local if k[1] == kind]
            inside = next((k for k in same if toks and (kt := P.toks(k[2])) and (set(toks) <= set(kt) or set(kt) <= set(toks))), None)
            scored = sorted(((P.alike(surface, k[2]), k[0]) for k in same), key=lambda x: -round(x[0], 9))
            best, second = scored[0] if scored else (0.0, None), scored[1][0] if len(scored) > 1 else 0.0
            if (kind, norm) in aliases:
                r = (aliases[kind, norm], "alias", 1.0, 0.0)
            elif any(k[0] == own for k in local):
                r = (own, "slug", 0.95, 0.0)
            elif inside:
                r = (inside[0], "contains", 0.9, 0.0)
            elif best[0] >= 0.72:
                r = (best[1], "lexical", best[0], second)
            else:
                r = (None, "none", best[0], second)
                local.append((own, kind, surface))
            placeholder = kind == "person" and PLACEHOLDER.fullmatch(norm)
            blocked = bool(placeholder) or not proof or (r[1] == "lexical" and r[2] - r[3] < 0.05)
            found.append((kind, surface, seq, r, blocked, bool(placeholder), own, norm))
            out.append((meeting, kind, surface, seq, r[0], r[1], round(r[2], 6), round(r[3], 6), blocked))
        for late in (False, True):
            for kind, surface, _, r, blocked, placeholder, own, norm in found:
                if blocked != late or placeholder:
                    continue
                id_ = own if blocked else r[0] or own
                if id_ not in ids:
                    ids.add(id_)
                    known.append((id_, kind, surface))
                if not blocked and id_ not in dead:
                    aliases.setdefault((kind, norm), id_)
    return sorted(out, key=str)


def found(spark, cands, entities):
    c = spark.createDataFrame(cands, "meeting_id string, kind string, surface string, seq int, has_proof boolean")
    e = spark.createDataFrame(entities, "id string, kind string, label string, norm string, merged_into string")
    rows = R.resolve_all(c, e).collect()
    return sorted(((r["meeting_id"], r["kind"], r["surface"], r["seq"], r["entity_id"], r["matcher"], round(r["score"], 6), round(r["runner_up"], 6), r["blocked"]) for r in rows), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_one_after_the_other(spark, seed):
    r = random.Random(seed)
    label = lambda: " ".join(r.choice(WORDS) for _ in range(r.choice([1, 2, 2, 3, 3, 4])))
    entities = {}
    for _ in range(8):
        x = label()
        entities[slug("topic", x)] = (slug("topic", x), "topic", x, x, "topic:gone" if r.random() < 0.25 else None)
    cands = []
    for m in range(14):
        names = {}
        for _ in range(r.randint(1, 7)):
            kind = r.choice(["topic", "topic", "topic", "person"])
            x = label() if kind == "topic" else r.choice(["You", "Ann Lee", "Ann", "speaker 2", "Bo", "Ann-Lee"])
            names.setdefault((kind, P.norm(x)), x)
        cands += [(f"m{m:02d}", kind, x, i, r.random() > 0.2) for i, ((kind, _), x) in enumerate(names.items())]
    got, want = found(spark, cands, list(entities.values())), plain(cands, list(entities.values()))
    assert got == want


def test_entities_of_one_meeting_are_known_to_the_next(spark):
    cands = [("m1", "topic", "warehouse migration issue", 0, True), ("m1", "topic", "warehouse migration", 1, True), ("m2", "topic", "Warehouse migration!", 0, True), ("m3", "topic", "migration", 0, False), ("m4", "topic", "migration", 0, True)]
    got = {(r[0], r[3]): r[4:6] for r in found(spark, cands, [])}
    assert got == {("m1", 0): (None, "none"), ("m1", 1): ("topic:warehouse-migration-issue", "contains"), ("m2", 0): ("topic:warehouse-migration-issue", "alias"), ("m3", 0): ("topic:warehouse-migration-issue", "contains"), ("m4", 0): ("topic:migration", "slug")}


def test_the_registered_query_equals_one_after_the_other(spark):
    w = Q.World(spark, DIR)
    cands = R.with_proof(E.candidates(w.utterances, Q._recaps(w)), w.utterances)
    numbered = R._occurrences(cands, w.entities).select("meeting_id", "kind", "surface", "seq", "has_proof").collect()
    want = plain(list(map(tuple, numbered)), [tuple(r) for r in w.entities.select("id", "kind", "label", "norm", "merged_into").collect()])
    got = Q.queries()["cp_3_resolve"](spark, DIR).select("meeting_id", "kind", "surface", "entity_id", "matcher", "score", "runner_up", "blocked").collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(((*x[:3], *x[4:]) for x in want), key=str) and got


def test_no_candidates(spark):
    assert found(spark, [], [("topic:a", "topic", "a", "a", None)]) == []
