"""Line templates against the rule in plain Python, on leaves with several templates."""

import hashlib
import random
from collections import Counter, defaultdict

import xxhash

from parley.llm import line_templates as L
from parley.llm import registry


def token_hash(token):
    h = xxhash.xxh64_intdigest(token.encode(), seed=42)
    return h - (1 << 64) if h >> 63 else h


def masked(line):
    return " ".join(L.WILD if any(c.isdigit() for c in t) else t for t in line.split())


def constants(lines):
    """{position: token} that a majority of the lines has."""
    counts = Counter((i, t) for line in lines for i, t in enumerate(line))
    return {i: t for (i, t), n in counts.items() if n >= L.MAJORITY * len(lines)}


def members(lines):
    c = constants(lines)
    return {x for x in lines if len(c) >= L.SIMILARITY * len(x) and all(x[i] == t for i, t in c.items())}


def templates(leaf, docs):
    """Sets of lines (token tuples) of a leaf that one template covers; docs: documents of each line."""
    enough = lambda lines: len(lines) > 1 and sum(len(docs[x]) for x in lines) >= L.MIN_DOCS
    if not enough(leaf) or len(next(iter(leaf))) < L.MIN_TOKENS:
        return []
    own = members(leaf)
    found, groups = [own], [leaf - own]
    while groups:
        group = groups.pop()
        if not enough(group):
            continue
        inside = members(group)
        if inside:
            c = constants(group)
            found.append({x for x in leaf if all(x[i] == t for i, t in c.items())})
        counts = Counter((i, t) for line in group for i, t in enumerate(line))
        usable = {k: n for k, n in counts.items() if 1 < n < L.MAJORITY * len(group)}
        next_ = defaultdict(set)
        for x in group - inside:
            if routes := [(usable[i, t], -i, token_hash(t)) for i, t in enumerate(x) if (i, t) in usable]:
                next_[max(routes)].add(x)
        groups += next_.values()
    return found


def plain(rows):
    """{doc: (lines, dropped, kept text)}."""
    docs, leaves = defaultdict(set), defaultdict(set)
    for d, text in rows:
        for line in text.split("\n"):
            if m := tuple(masked(line).split()):
                docs[m].add(d)
                leaves[len(m), m[: L.LEAD]].add(m)
    first = {}

    def recurs(lines):
        where = set().union(*(docs[x] for x in lines)) if lines else set()
        if len(where) >= L.MIN_DOCS:
            for x in lines:
                first[x] = min(first.get(x, min(where)), min(where))

    for leaf in leaves.values():
        for x in leaf:
            recurs({x})
        for lines in templates(leaf, docs):
            recurs(lines)
    out = {}
    for d, text in rows:
        lines = text.split("\n")
        kept = [x for x in lines if d <= first.get(tuple(masked(x).split()), d)]
        out[d] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def leaf_rows(r):
    """Documents whose lines share their length and first tokens: a few templates, their variants, and noise."""
    rows, bodies = [], [[f"w{k}{chr(97 + j)}" for j in range(5)] for k in "abc"]
    for d in range(60):
        lines = []
        for _ in range(r.randint(1, 3)):
            body = list(r.choice(bodies)) if r.random() < 0.8 else ["n" + r.choice("pqrstu") for _ in range(5)]
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                body[r.randrange(5)] = r.choice(["x", "y", "z", "v", "u"]) + r.choice("mnop")
            lines.append(" ".join(["See", "also", "our", *body] if r.random() < 0.9 else ["Go", "to", str(r.randrange(99)), *body]))
        rows.append((d, "\n".join(lines)))
    return rows


def test_split_leaves_equal_the_rule_in_plain_python(spark, tmp_path):
    dropped = 0
    for seed in range(4):
        rows = leaf_rows(random.Random(seed))
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / f"{seed}/documents.parquet"))
        got = {x["doc_id"]: (x["n_lines"], x["n_dropped"], x["kept_sha256"]) for x in registry.op2_line_templates(spark, str(tmp_path / str(seed))).collect()}
        assert got == plain(rows)
        dropped += sum(x[1] for x in got.values())
    assert dropped > 100
