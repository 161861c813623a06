"""Importance resampling against a plain computation."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from parley.llm import importance

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def feature_buckets(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(words) - n + 1)], len(words)


def plain(docs, target, percent=5):
    raw, aim = Counter(), Counter()
    for _, t in docs:
        raw.update(feature_buckets(t)[0])
    for t in target:
        aim.update(feature_buckets(t)[0])
    total, wanted = sum(raw.values()), sum(aim.values())
    out, able = [], []
    for at, (i, t) in enumerate(docs):
        buckets, words = feature_buckets(t)
        weight = sum(math.floor(1000 * math.log((aim[b] + 1) * (total + 10000) / ((raw[b] + 1) * (wanted + 10000)))) for b in buckets)
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
            if words >= 20:
                able.append((-score, i, -len(buckets), at))
        out.append([i, len(buckets), weight, score, None])
    for rank, key in enumerate(sorted(able)[: percent * len(able) // 100], 1):
        out[key[-1]][-1] = rank
    return out


def rows_of(df):
    return sorted(([r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]] for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def docs():
    r = random.Random(3)
    vocabulary = ["Alpha", "beta", "ñandú", "Ωmega", "x" * 70, "y" * 48, "7up", "GAMMA", "delta", "été"]
    texts = [" ".join(r.choice(vocabulary) + r.choice(["", "", str(r.randint(0, 30))]) for _ in range(r.choice([0, 1, 2, 19, 20, 40, 90]))) for _ in range(400)]
    return [(r.randint(-(1 << 63), (1 << 63) - 1) if i % 9 == 0 else i, t) for i, t in enumerate(texts)]


def test_features_equal_plain_in_windows_of_any_size(monkeypatch):
    texts = [None, "", "a", "A b", "É ñ x", " ... ", "x" * 100 + " " + "y" * 48 + " z " + "w" * 49, "Hello, World 12 foo-bar", "one two", "three"]
    for window in (1 << 22, 7, 50):
        monkeypatch.setattr(importance, "WINDOW", window)
        got, words = [[] for _ in texts], Counter()
        for doc, buckets, new in importance.features(pa.array(texts)):
            for d, b in zip(doc.tolist(), buckets.tolist()):
                got[d].append(b)
            words.update(new.tolist())
        for i, t in enumerate(texts):
            assert (sorted(got[i]), words[i]) == (sorted(feature_buckets(t)[0]), feature_buckets(t)[1])


def test_equals_plain_computation(spark, docs):
    target = ["alpha beta delta " * 5, "été gamma", None]
    got = importance.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string"), percent=10)
    assert rows_of(got) == sorted(plain(docs, target, 10), key=str)


def test_odd_rows_ties_and_clashing_names(spark):
    text = "alpha beta gamma " * 10
    docs = [(1, text)] * 30 + [(2, None), (3, ""), (None, text), (None, text), (4, "one"), (5, "b " * 5000)]
    frame = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, score int, rank int")
    got = importance.resample(frame, spark.createDataFrame([], "text string"), percent=50)
    assert rows_of(got)[0][0] is not None and rows_of(got) == sorted(plain(docs, [], 50), key=str)
    empty = importance.resample(frame.limit(0), frame)
    assert empty.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"] and empty.count() == 0


def test_radix_selection_finds_every_key(spark):
    r = random.Random(5)
    values = [r.randint(-(1 << 63), (1 << 63) - 1) for _ in range(200)] + [-1, 0, 1, 0, 0, 5, 5, (1 << 63) - 1, -(1 << 63)]
    frame = spark.createDataFrame([(v,) for v in values], "v long").cache()
    for largest in (True, False):
        order = sorted(values, reverse=largest)
        for k in (1, 2, 100, 104, len(values)):
            found, before = importance.kth(frame, "v", k, largest)
            assert found == order[k - 1] and before == order.index(found)
