"""Operators against brute force, on hand-made and generated cases."""

import base64
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.llm import byte_bpe, cross_polytope, line_templates, mixed_language, norm_topk, simhash, soft_mixing, suffix_dedup, url_rules, warc_fixity

VEC = "vec_id long, embedding array<float>, id string, vector string, dim int"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def vectors(spark, data):
    """A table with extra columns whose names clash with internal ones."""
    return spark.createDataFrame([(i, v, "x", "y", 0) for i, v in data], VEC)


# --- searches ----------------------------------------------------------------------------------
ODD = [(2007, None), (2008, [0.0, 0.0, 0.0]), (2009, [1.0, None, 0.0]), (2011, [float("nan"), 1.0, 0.0]), (2012, [float("inf"), 1.0, 0.0]), (None, [1.0, 1.0, 1.0])]


def test_nearest_ties_and_odd_vectors(spark):
    t = vectors(spark, [(0, [1.0, 0.0, 0.0]), (3, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (5, [1.0, 0.0]), *ODD])
    assert rows(cross_polytope.nearest(t, F.col("id") == 0, k=5)) == [(0, 1, 2, 1.0), (0, 2, 3, 1.0), (0, 3, 1, 0.0)]
    assert cross_polytope.nearest(t.limit(0), F.col("id") == 0).count() == 0


def test_nearest_with_queries_in_parts(spark, monkeypatch):
    rnd = np.random.default_rng(4)
    t = spark.createDataFrame([(i, [float(x) for x in rnd.normal(size=8)]) for i in range(240)], "vec_id long, embedding array<double>")
    found = []
    for most in (1 << 15, 3):
        monkeypatch.setattr(cross_polytope, "QUERY_ROWS", most)
        found.append(rows(cross_polytope.nearest(t, F.col("id") % 5 == 0)))
    assert found[0] == found[1] and len(found[0]) == 48 * 5


def test_nearest_recall(spark):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(1500, 24)).astype(np.float32)
    t = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<float>")
    got = {(r["query_id"], r["vec_id"]) for r in cross_polytope.nearest(t, F.col("id") % 50 == 0).collect()}
    u = data / np.linalg.norm(data, axis=1)[:, None]
    s = u[::50] @ u.T
    s[np.arange(30), np.arange(0, 1500, 50)] = -9
    want = {(50 * q, int(v)) for q, r in enumerate(np.argsort(-s, axis=1)[:, :5]) for v in r}
    assert len(got & want) / len(want) >= 0.9 and len(got) == 150


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 16))
    assert np.allclose((cross_polytope.hadamard(x) ** 2).sum(axis=1), (x**2).sum(axis=1))


def brute_products(data, k):
    ok = {i: [int(np.floor(1024 * float(np.float32(x)))) for x in v] for i, v in data if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q in ok:
        if q % 100 == 0:
            s = sorted((-sum(a * b for a, b in zip(ok[q], v)), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))
            out += [(q, r + 1, i, -p) for r, (p, i) in enumerate(s[:k])]
    return sorted(out)


@pytest.mark.parametrize("spread", [0.0, 2.0])
def test_top_products(spark, monkeypatch, spread):
    monkeypatch.setattr(norm_topk, "BLOCK_ROWS", 64)
    rng = np.random.default_rng(2)
    data = [(i, (rng.normal(size=8) * np.exp(spread * rng.normal())).tolist()) for i in range(450)] + [(1000, [1.0] * 8), (1001, [1.0] * 8)] + ODD
    assert rows(norm_topk.top_k(vectors(spark, data), F.col("id") % 100 == 0)) == brute_products(data, 10)


def test_top_products_prune_but_lose_nothing():
    import pandas as pd

    rng = np.random.default_rng(3)
    m = rng.integers(-5, 6, (300, 6))
    q = np.vstack([m[0] * 3, m[1]])
    frame = lambda x, ids, **c: pd.DataFrame({"id": ids, "vector": [*x], "norm": np.sqrt((x * x).sum(axis=1).astype(float)), **c})
    s = m @ q.T
    theta = np.sort(s, axis=0)[-4].astype(float)
    got = norm_topk.search_block(frame(m, np.arange(300)), frame(q, np.array([900, 901]), theta=theta), 4)
    for c, own in enumerate((900, 901)):
        want = sorted((-s[i, c], i) for i in range(300))[:4]
        assert [(-r.score, r.vec_id) for r in got[got.query_id == own].itertuples()] == want


# --- SimHash -----------------------------------------------------------------------------------
def union(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {n: find(n) for n in nodes}


def test_links_span_every_close_pair(spark):
    rnd = random.Random(4)
    centre = rnd.getrandbits(64)
    fps = {centre} | {centre ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for _ in range(150)} | {rnd.getrandbits(64) for _ in range(50)} | {0, 3, 2**64 - 1}
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    t = spark.createDataFrame([(f,) for f in signed], "fp long")
    close = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2]
    found = [(r["a"], r["b"]) for r in simhash.links(t).collect()]
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 2 for a, b in found)
    assert union(found, signed) == union(close, signed)


def test_near_duplicates(spark):
    long = " ".join(f"word{i}" for i in range(400))
    docs = spark.createDataFrame([(5, long, 1), (3, long.upper(), 1), (9, "quite another text", 1), (2, None, 1), (8, "", 1), (8, "", 1), (None, "  ", 1)], "doc_id long, text string, fp int")
    got = simhash.near_duplicates(docs)
    assert got.columns == ["doc_id", "fp", "component_id"]
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["component_id"]) for r in got.collect()) == [(False, 2, 2), (False, 3, 3), (False, 5, 3), (False, 8, 2), (False, 8, 2), (False, 9, 9), (True, 0, 2)]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_fingerprint_counts_repeats_and_shingles():
    import xxhash

    h = [xxhash.xxh64_intdigest(s, 42) for s in (b"a b c", b"b c a", b"c a b", b"a b c")]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > 4)
    assert simhash.fingerprint("A b\tC a\nb c") == want
    assert simhash.fingerprint("One two") == xxhash.xxh64_intdigest(b"one two", 42) and simhash.fingerprint(" \t") == 0


def test_components_of_a_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {r["node"]: r["root"] for r in simhash.components(e).collect()} == {**{i: 0 for i in range(1, 41)}, 101: 100}


# --- suffix arrays -----------------------------------------------------------------------------
def brute_removed(docs):
    seen, out = set(), []
    for d, t in sorted(docs):
        b = (t or "").encode()
        mark, own = [False] * len(b), set()
        for p in range(len(b) - 49):
            own.add(w := b[p : p + 50])
            if w in seen:
                mark[p : p + 50] = [True] * 50
        seen |= own
        spans = sum(m and not (i and mark[i - 1]) for i, m in enumerate(mark))
        out.append((d, len(b), sum(mark), spans, hashlib.sha256(bytes(x for x, m in zip(b, mark) if not m)).hexdigest()))
    return out


@pytest.mark.parametrize("crowd, at_once", [(2048, 256), (1, 256), (2048, 0), (2048, 1), (3, 2)])
def test_repeats_equal_brute_force(spark, monkeypatch, crowd, at_once):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 700)
    real, anchored = suffix_dedup.settle, suffix_dedup.anchored
    monkeypatch.setattr(suffix_dedup, "anchored", lambda f, b: anchored(f, b, 40, at_once))
    monkeypatch.setattr(suffix_dedup, "settle", lambda g, b: real(g, b, crowd))
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abé ") for _ in range(6))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(12) for _ in range(3)]
    docs = [(i, text(rnd.randrange(5, 60)) + rnd.choice(shared)[rnd.randrange(20) :] + text(rnd.randrange(20)) + rnd.choice(shared)) for i in range(40)]
    docs += [(50, docs[3][1]), (51, docs[3][1]), (52, None), (53, ""), (54, "a" * 400), (55, "a" * 120 + "b"), (56, "x" * 50), (57, "x" * 49), (58, "y" * 3 + "x" * 50)]
    t = spark.createDataFrame([(d, x, 0) for d, x in docs], "doc_id long, text string, key int")
    assert rows(suffix_dedup.remove_repeats(t, with_kept=False)) == brute_removed(docs)


def test_repeats_odd_rows(spark):
    a, b = "p" * 30 + "q" * 40, "r" * 80
    t = spark.createDataFrame([(1, a), (1, a), (2, a), (None, a), (3, b), (3, a)], "doc_id long, text string")
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"]) for r in suffix_dedup.remove_repeats(t).collect()]
    assert got.count((1, 70, 0)) == 2 and (2, 70, 70) in got and (None, 70, 0) in got and len(got) == 6
    assert suffix_dedup.remove_repeats(t.limit(0)).count() == 0


def test_two_stage_order_and_prefixes():
    rng = np.random.default_rng(0)
    for k in range(60):
        d = rng.choice(rng.integers(0, 256, rng.integers(1, 5)), rng.integers(1, 200)).astype(np.uint8)
        d = np.r_[d, d[: len(d) // 2], d] if k % 3 == 0 else d
        order, b = suffix_dedup.two_stage_order(d, 50), bytes(d)
        cut = [b[i : i + 50] for i in order]
        assert sorted(order) == list(range(len(d))) and cut == sorted(cut)
        lcp = suffix_dedup.common_prefixes(d, order, 50)
        for i in range(1, len(order)):
            x, y = cut[i - 1], cut[i]
            m = next((j for j in range(min(len(x), len(y))) if x[j] != y[j]), min(len(x), len(y)))
            assert lcp[i] == m


# --- byte-level BPE ----------------------------------------------------------------------------
TEXTS = ["", "Hello world", "  two  spaces \n\n end ", "l'été naïve — “quotes” 123,456.78", "日本語テキスト", "👩‍👩‍👧 emoji", "don't we'll I'M", "a" * 3000, "\x1c\x1d\x85\u2003x\u200b", "tab\tnew\r\n", "x" * 50 + "é" * 50, "ÅÄÖ ʼn ßẞ ǅ"]


def test_bpe_equals_tiktoken(spark):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    tok = byte_bpe.Tokenizer(spark, path, P.PATTERN)
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate([*TEXTS, None])], "doc_id long, text string, ids int")
    got = {r["doc_id"]: r for r in tok.digest(docs).collect()}
    for i, t in enumerate([*TEXTS, None]):
        ids = enc.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), t
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    encoded = tok.encode(docs)
    back = {r["doc_id"]: bytes(r["bytes"]).decode() for r in tok.decode(encoded).collect()}
    assert back == {i: t or "" for i, t in enumerate([*TEXTS, None])}
    assert tok.digest(docs.limit(0)).count() == 0


# --- languages ---------------------------------------------------------------------------------
def test_languages(spark):
    de = "der schnelle braune fuchs springt über den faulen hund und die katze schläft "
    en = "the quick brown fox jumps over the lazy dog while the cat is sleeping "
    train = spark.createDataFrame([(de * 5, "de"), (en * 5, "en"), (None, "en"), ("x", None)], "text string, lang string")
    model = mixed_language.train(train)
    assert model[0] == ["de", "en"]
    docs = spark.createDataFrame([(1, en), (2, de.upper()), (3, en * 3 + de), (4, None), (5, "123 !!"), (6, ""), (6, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in mixed_language.identify(docs, model).collect()}
    assert [got[i]["lang_pred"] for i in range(1, 7)] == ["en", "de", "en", "und", "und", "und"]
    assert sorted(got[3]["langs"]) == ["de", "en"] and 0.6 < got[3]["score"] < 0.9 and got[1]["score"] == 1 and got[4]["score"] == 0
    nothing = mixed_language.train(train.limit(0))
    assert {r["lang_pred"] for r in mixed_language.identify(docs, nothing).collect()} == {"und"}
    assert rows(mixed_language.label(docs.withColumn("lang", F.lit("zz")), model, 0.3).select("doc_id", "lang")) == [(1, "en"), (2, "de"), (3, "en")]


def test_held_out(spark):
    import zlib

    got = {r["doc_id"]: r["h"] for r in spark.range(50).select(F.col("id").alias("doc_id")).withColumn("h", mixed_language.held_out("doc_id")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(50)}


# --- lines -------------------------------------------------------------------------------------
def test_line_templates(spark):
    page = lambda i: f"Page {i} of the yearly report on trade"
    kind = ["apples", "pears", "plums", "grapes", "figs", "dates", "limes"]
    docs = [(i, f"own{'x' * i} words that stay in place\n{page(i)}\nPlease see our full terms about {kind[i]} on the web") for i in range(7)]
    docs += [(20, None), (21, ""), (22, "\n\n"), (23, page(3)), (23, page(3)), (None, page(4))]
    t = spark.createDataFrame([(d, x, "k") for d, x in docs], "doc_id long, text string, line string")
    by = {}
    for r in line_templates.counted(t).collect():
        by.setdefault(r["doc_id"], []).append((r["text"], r["n_lines"], r["n_dropped"]))
    assert by[0] == [(docs[0][1], 3, 0)]
    assert all(by[i] == [(docs[i][1].split("\n")[0], 3, 2)] for i in range(1, 7))
    assert by[20] == [(None, 0, 0)] and by[21] == [("", 1, 0)] and by[22] == [("\n\n", 3, 0)] and by[23] == [("", 1, 1)] * 2 and by[None] == [(page(4), 1, 0)]
    assert line_templates.drop_templates(t.limit(0)).count() == 0


def test_two_templates_and_noise_in_one_leaf(spark):
    lead, letters = "see our terms", "abcdefghij"
    name = lambda i: "".join(letters[int(d)] for d in str(1000 + i))
    one = [f"{lead} about {name(i)} on the web page of today" for i in range(30)]
    two = [f"{lead} and then call {name(i)} or write to us" for i in range(30)]
    noise = [f"{lead} " + " ".join(name(100 + 8 * i + j) for j in range(8)) for i in range(40)]
    t = spark.createDataFrame(list(enumerate(one + two + noise)), "doc_id int, text string")
    assert {len(x.split()) for x in one + two} == {11}
    gone = {r["doc_id"] for r in line_templates.counted(t).where("n_dropped = 1").collect()}
    assert gone == set(range(1, 30)) | set(range(31, 60))


def test_few_repeats_stay(spark):
    t = spark.createDataFrame([(i, "a line that only five documents share\nown " + "z" * i) for i in range(5)], "doc_id long, text string")
    assert rows(line_templates.counted(t).select("n_dropped")) == [(0,)] * 5


# --- urls --------------------------------------------------------------------------------------
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
CASES = [("http://WWW.Example.com/en/x?q#f", "www.example.com", "/en/x", "www.example.com/en/", "allow"), ("https://m.example.com/en/1", "m.example.com", "/en/1", "example.com/en/", "block"), ("http://badexample.com/en/", "badexample.com", "/en/", "com/", "allow"), ("http://a.net/es", "a.net", "/es", None, "allow"), ("http://a.net/es/", "a.net", "/es/", "net/es/", "block"), ("http://a.com", "a.com", "", None, "allow"), ("nourl", "", "", None, "allow"), (None, "", "", None, "allow"), ("x://h?a/b://c", "h", "", None, "allow"), ("http://É.com/\n/x", "É.com", "/\n/x", "com/", "allow")]


def test_urls(spark):
    pages = spark.createDataFrame([(i, c[0], "h") for i, c in enumerate(CASES)], "page_id long, url string, host string")
    none = url_rules.mine(spark.createDataFrame([], "url string, label string"))
    got = rows(url_rules.judge(pages, RULES, none).select("page_id", "host", "path", "rule", "verdict"))
    assert got == [(i, *c[1:]) for i, c in enumerate(CASES)]


def test_mined_rules(spark):
    urls = [(f"http://spam{i % 3}.bad.org/win/{i}", "block") for i in range(60)] + [(f"http://site{i}.good.org/win/{i}", "allow") for i in range(60)] + [(f"http://x.good.org/{i}", None) for i in range(5)]
    mined = url_rules.mine(spark.createDataFrame(urls, "url string, label string"))
    assert mined.where("confidence < 0.6").count() == 0 and mined.count() > 0
    pages = spark.createDataFrame([(1, "http://new.bad.org/win/9"), (2, "http://new.good.org/win/9"), (3, "http://else.org/"), (1, "http://new.bad.org/win/9")], "page_id long, url string")
    assert rows(url_rules.judge(pages, RULES, mined).select("page_id", "verdict")) == [(1, "block"), (1, "block"), (2, "allow"), (3, "allow")]


# --- mixing ------------------------------------------------------------------------------------
def test_mixing_reaches_targets(spark):
    rnd = random.Random(8)
    words = {"a": ["apple", "ant", "arc"], "b": ["bear", "bus", "bee"]}
    docs = [(i, " ".join(rnd.choice(words["a" if i % 4 else "b"]) for _ in range(30 + i % 7)), "a" if i % 4 else "b") for i in range(200)] + [(900, None, None), (901, "", None), (901, "", None)]
    t = spark.createDataFrame(docs, "doc_id long, text string, label string")
    model = soft_mixing.fit(t)
    got = soft_mixing.mix(t, model, {"a": 0.5, "b": 0.5})
    sums = got.agg(*(F.sum(F.col("tokens") * F.col("rate") * F.element_at("p", i + 1)) for i in (0, 1))).first()
    assert abs(sums[0] / sums[1] - 1) < 1e-3 and got.where("rate < 0").count() == 0 and got.count() == 203
    spread = got.agg(F.sum("copies"), F.sum("rate")).first()
    assert abs(spread[0] / spread[1] - 1) < 0.1
    plain = soft_mixing.mix(t, soft_mixing.fit(t.limit(0)), {"a": 1.0})
    assert plain.where("rate <> 1 or copies <> 1").count() == 0
    assert soft_mixing.mix(t.limit(0), model, {"a": 1.0}).count() == 0


# --- WARC --------------------------------------------------------------------------------------
def replica(spark, data):
    return spark.createDataFrame([(f, o, r, 1) for f, o, r in data], "file long, ordinal long, record string, hash int")


def test_audit_finds_damage(spark):
    good = [(f, o, f"record {f} {o}") for f in range(40) for o in range(35)]
    bad = [x for x in good if x != (7, 34, "record 7 34")]
    bad[100] = (*bad[100][:2], "record 2 3X"[:11])
    bad[500] = (*bad[500][:2], bad[500][2].replace("record", "recorD"))
    bad.append((41, 0, "new"))
    got = {(r["file"], r["ordinal"], r["status"]) for r in warc_fixity.audit(replica(spark, good), replica(spark, bad)).collect()}
    assert (7, 34, "missing") in got and (41, 0, "extra") in got and (bad[500][0], bad[500][1], "differs") in got
    f = bad[100][0]
    assert {x[0] for x in got} == {7, 41, bad[500][0], f}
    assert warc_fixity.audit(replica(spark, good), replica(spark, good)).count() == 0
    assert warc_fixity.audit(replica(spark, []), replica(spark, [])).count() == 0
    assert rows(warc_fixity.audit(replica(spark, [(0, 0, None), (None, 1, "x")]), replica(spark, [(0, 0, "y")])).select("status")) == [("differs",)]


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://x/{i}", "é\r\n\r\nbody" * i) for i in range(5)], "page_id long, url string, html string")
    records = pages.select((F.col("page_id") % 2).alias("file"), F.col("page_id").alias("ordinal"), warc_fixity.record_of(F.col("page_id"), F.col("url"), F.col("html")).alias("record"))
    warc_fixity.write_warc(records, str(tmp_path / "w"))
    got = sorted(bytes(r["payload"]).decode() for r in warc_fixity.read_warc(spark, str(tmp_path / "w")).collect())
    assert got == sorted("é\r\n\r\nbody" * i for i in range(5))
