"""The pipeline's stages on a small corpus with planted cases."""

import random

import corpus_pipeline
from parley.llm import registry, shingle_overlap

LABEL = "doc_id long, quality int, toxic int"


def corpus(spark, tmp_path):
    rnd = random.Random(3)
    vocab = {"en": ["the", "river", "runs", "slowly", "under", "old", "bridges", "towards", "morning", "light"], "de": ["der", "fluss", "fließt", "langsam", "unter", "alten", "brücken", "gegen", "morgen", "licht"]}
    text = lambda lang, n: " ".join(rnd.choice(vocab[lang]) + rnd.choice(["", "s", "n", "er"]) for _ in range(n))
    docs = [(i, text("en" if i % 3 else "de", 120), "en" if i % 3 else "de", f"src{i % 4}", 0) for i in range(60)]
    docs += [(100 + i, docs[7][1], "en", "src0", 0) for i in range(4)] + [(200, "1234 !!", "en", "src0", 0), (201, None, None, "src1", 0)]
    docs = [(d, "shared footer about nothing at all\n" + t if t and d < 60 and d % 5 == 0 else t, lang, s, n) for d, t, lang, s, n in docs]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1 if i % 7 else 0, 0) for i in range(0, 60, 2)], LABEL).write.parquet(str(tmp_path / "labels.parquet"))
    return docs


def test_stages(spark, tmp_path):
    docs = corpus(spark, tmp_path)
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    now, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(str(tmp_path / f"out-{name}"))
        now = spark.read.parquet(str(tmp_path / f"out-{name}"))
        if name != "encode":
            assert now.columns == columns
        kept[name] = [r["doc_id"] for r in now.collect()]
    assert set(kept["language_id"]) == {d[0] for d in docs} - {200, 201}
    assert sorted(kept["line_dedup"]) == sorted(kept["language_id"])
    assert set(kept["near_dedup"]) == {d[0] for d in docs if d[0] < 60}
    assert set(kept["encode"]) == set(kept["mixing"]) <= set(kept["near_dedup"])


def test_footer_goes_but_for_the_first(spark, tmp_path):
    corpus(spark, tmp_path)
    out = corpus_pipeline.line_dedup(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path))
    assert [r["doc_id"] for r in out.where("text like 'shared footer%'").collect()] == [0]
    assert out.where("text is not null and n_chars <> length(text)").count() == 0


def test_registry():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 14))
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_edited_copies_go(spark, tmp_path):
    rnd = random.Random(5)
    base = [f"word{rnd.randrange(4000)}" for _ in range(150)]
    edited = lambda *at: " ".join("changed" + str(i) if i in at else w for i, w in enumerate(base))
    texts = {1: edited(), 2: edited(20), 3: edited(40, 110), 4: edited(10, 30, 50, 70, 90, 110, 130), 5: edited(20, 60, 100), 6: "other words entirely", 7: "Other  WORDS entirely"}
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect()}
    assert kept == {1, 4, 6}


def test_links_equal_brute_force(spark):
    rnd = random.Random(11)
    groups = [[f"w{rnd.randrange(900)}" for _ in range(60)] for _ in range(6)]
    texts = [" ".join("x%d" % rnd.randrange(10**6) if rnd.random() < rate else w for w in rnd.choice(groups)) for rate in (0.005, 0.02, 0.04) for _ in range(40)] + ["", None, " \t", "a b", "A b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    sets, root = [shingle_overlap.shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if shingle_overlap.jaccard(sets[i], sets[j]) >= 0.8 and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    roots = {r["node"]: r["root"] for r in shingle_overlap.linked(docs).collect()}
    found = [roots.get(r["n"], r["n"]) for r in docs.orderBy("doc_id").select(shingle_overlap.node(docs.text).alias("n")).collect()]
    assert [found.index(f) for f in found] == root
    assert len(set(root)) > 12 and shingle_overlap.linked(docs.limit(0)).count() == 0


def test_bitmaps_of_two_lengths(spark):
    long = [f"word{i}" for i in range(1040)]
    docs = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(long[:1000]))], "doc_id int, text string")
    assert shingle_overlap.linked(docs).count() == 1


def test_null_and_repeated_ids(spark, tmp_path):
    rnd = random.Random(8)
    text = lambda: " ".join(f"word{rnd.randrange(5000)}" for _ in range(60))
    a, b, c, d, e = (text() for _ in range(5))
    rows = [(None, a), (None, a), (None, b), (4, b), (7, c), (7, d), (7, d), (7, c + " end"), (9, c), (None, e), (None, e + " end")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r["doc_id"], r["text"].removesuffix(" end")) for r in corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect()]
    assert sorted(kept, key=str) == sorted([(None, a), (4, b), (7, c), (7, d), (None, e)], key=str)
    spark.createDataFrame([], LABEL).write.parquet(str(tmp_path / "labels.parquet"))
    mixed = corpus_pipeline.mixing(spark, spark.createDataFrame(docs.distinct().collect(), docs.schema), str(tmp_path))
    assert sorted(map(str, mixed.collect())) == sorted(map(str, docs.distinct().collect()))


def test_mixing_draws_row_by_row(spark, tmp_path):
    corpus(spark, tmp_path)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    same = docs.where("text is not null and doc_id < 60").selectExpr("if(doc_id % 2 = 0, cast(null as bigint), 5L) doc_id", "text", "lang", "source", "n_chars")
    ids = {r["doc_id"] for r in corpus_pipeline.mixing(spark, same.unionByName(docs), str(tmp_path)).collect()}
    assert {None, 5} <= ids


CLASH = ["row", "doc", "id", "lines", "leaf", "_id", "_lines", "_copies", "node", "of", "whole", "p", "tokens", "rate", "copies", "text_hash", "h", "g", "label"]


def test_odd_rows_and_clashing_names_in_every_stage(spark, tmp_path):
    rnd = random.Random(4)
    prose = lambda n: " ".join(rnd.choice(["the", "river", "runs", "under", "old", "bridges", "light"]) + rnd.choice(["", "s", "er"]) for _ in range(n))
    long = prose(30000)
    rows = [(1, prose(80)), (1, prose(80)), (None, prose(80)), (None, None), (3, ""), (4, None), (5, long), (6, "12 34"), (7, prose(3)), (7, prose(3))]
    rows += [rows[0]] * 3
    extra = ", ".join(f"{c} string" for c in CLASH) + ", tags map<string,int>"
    data = [(d, t, "en", "s", 0, *CLASH, {"a": 1}) for d, t in rows]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, " + extra)
    spark.createDataFrame([(1, 1, 0), (5, 0, 0), (7, 1, 1)], LABEL).write.parquet(str(tmp_path / "labels.parquet"))
    want = {"language_id": 9, "line_dedup": 13, "near_dedup": 8, "mixing": None, "encode": 13}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        kept = out.collect()
        if name != "encode":
            assert out.columns == docs.columns and all(tuple(r[c] for c in CLASH) == tuple(CLASH) and r["tags"] == {"a": 1} for r in kept), name
        assert want[name] is None or len(kept) == want[name], (name, [(r["doc_id"], (r["text"] or "")[:20]) for r in kept])
        none = stage(spark, docs.limit(0), str(tmp_path))
        assert none.count() == 0 and (name == "encode" or none.columns == docs.columns), name
