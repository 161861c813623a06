"""Conversation repair against a search over all edits."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from parley.llm import registry, turn_repair

SPACE = " \t\n\x0b\f\r"
NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [] if kind == 0 else [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def cheapest(rows, faults):
    """(cost, audit, lines) by best-first search over whole edit strings: least cost, then least string."""
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, roles, lines = heapq.heappop(heap)
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, lines
        state = (at, roles[-1:], len(roles) == 0)
        if (state, "done") in seen or len(audit) > 3 * len(rows) + 4:
            continue
        seen.add((state, "done"))
        fits = lambda r: bool(re.fullmatch("s?(ua)*u?", roles + r))
        for role in ("user", "assistant"):
            if fits(role[0]):
                heapq.heappush(heap, (cost + 5, audit + "I", at, roles + role[0], (*lines, f"{role}:")))
        if at < len(rows):
            heapq.heappush(heap, (cost + 2, audit + "D", at + 1, roles, lines))
            if faults[at] not in ("blank", "duplicate"):
                own, more = rows[at], 5 * (faults[at] == "truncated")
                if own[2] and fits(own[2][0]):
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, roles + own[2][0], (*lines, f"{own[2]}:{own[3]}")))
                for role in ("user", "assistant"):
                    if fits(role[0]):
                        heapq.heappush(heap, (cost + 1 + more, audit + "R", at + 1, roles + role[0], (*lines, f"{role}:{own[3]}")))


def plain(rows):
    groups = {c: [] for c, *_ in rows}
    for r in damage(rows):
        groups[r[0]].append(r)
    out = []
    for conv, own in groups.items():
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, faults = set(), []
        for _, _, role, text in own:
            t = text.rstrip(SPACE)
            faults.append("blank" if not t else "duplicate" if (role, text) in seen else "truncated" if t[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, lines = cheapest(own, faults)
        out.append((conv, gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def random_rows(r, conversations, longest):
    texts = ["Yes.", "No!", "Why?", "well", "", " \t", "é.", "so. ", "x\n", "One. Two. Three"]
    roles = ["user", "assistant", "system", "tool", "uploader", "", None]
    rows = []
    for c in range(conversations):
        turns = r.sample(range(longest * 2), r.randint(1, longest))
        for i, t in enumerate(sorted(turns)):
            usual = "user" if i % 2 == 0 else "assistant"
            rows.append((c, t if r.random() > 0.03 else None, usual if r.random() > 0.3 else r.choice(roles), r.choice(texts) if r.random() > 0.6 else f"Text {c} {i}." if r.random() > 0.02 else None))
    return rows


@pytest.mark.parametrize("bits", [12, 3, 1])
def test_equals_search_over_all_edits(spark, tmp_path, monkeypatch, bits):
    monkeypatch.setattr(turn_repair, "SLICE_BITS", bits)
    rows = random_rows(random.Random(bits), 60, 14)
    rows += [(None, i, "user" if i % 2 else "assistant", f"t{i}.") for i in range(9)] + [(1 << 60, i, "system", "s.") for i in range(3)] + [((1 << 60) + 1, 0, "user", "u.")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = registry.op11_turn_repair(spark, str(tmp_path))
    assert got.columns == NAMES
    assert sorted((tuple(x) for x in got.collect()), key=str) == plain(rows)


def test_conversation_over_many_slices_equals_one_slice(spark, monkeypatch):
    rows = [(7, i, r, t) for i, (_, _, r, t) in enumerate(random_rows(random.Random(9), 40, 20))]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = []
    for bits in (20, 2):
        monkeypatch.setattr(turn_repair, "SLICE_BITS", bits)
        found.append([tuple(x) for x in turn_repair.summary(turn_repair.repair(frame)).collect()])
    assert found[0] == found[1] and len(found[0]) == 1


def test_repaired_turns_alternate(spark):
    rows = random_rows(random.Random(11), 30, 12)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("pos", turn_repair.F.lit(1)).withColumn("code", turn_repair.F.lit("x"))
    by = defaultdict(str)
    for r in turn_repair.repaired_turns(turn_repair.repair(frame)).orderBy("pos", "place").collect():
        by[r["conv_id"]] += r["role"][0]
    assert by and all(re.fullmatch("s?(ua)+", x) for x in by.values())


def test_empty_table_and_all_dropped(spark, tmp_path):
    gone = [(c, t, "user", "Hi.") for c in range(200) for t in [3] if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    for name, rows in (("none", []), ("gone", gone)):
        spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / name / "conversations.parquet"))
        got = sorted(map(tuple, registry.op11_turn_repair(spark, str(tmp_path / name)).collect()))
        assert got == [(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c, *_ in rows]
