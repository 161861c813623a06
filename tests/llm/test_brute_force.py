"""Operators that SQL cannot express against brute force on small inputs."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.llm import mixed_language, soft_mixing, url_rules


# --- mixing ------------------------------------------------------------------------------------
def best_totals(p, n, t):
    """Totals of the non-negative least-squares problem: the best over all sets of rates that are not zero."""
    a, best = (p * n[:, None]).T, (float(t @ t), np.zeros(len(t)))
    for size in range(1, len(n) + 1):
        for free in itertools.combinations(range(len(n)), size):
            r = np.linalg.lstsq(a[:, free], t, rcond=None)[0]
            if (r >= -1e-12).all():
                off = a[:, free] @ r - t
                best = min(best, (float(off @ off), a[:, free] @ r), key=lambda x: x[0])
    return best[1]


CASES = {
    "clipped": ([(10, [0.9, 0.1]), (10, [0.1, 0.9]), (10, [0.5, 0.5])], [30.0, 0.5]),
    "within reach": ([(10, [0.75, 0.25]), (40, [0.25, 0.75]), (7, [0.5, 0.5])], [20.0, 30.0]),
    "out of reach": ([(10, [0.75, 0.25, 0.0]), (40, [0.25, 0.5, 0.25]), (7, [0.5, 0.25, 0.25])], [1.0, 2.0, 60.0]),
    "nothing wanted": ([(10, [0.75, 0.25]), (40, [0.25, 0.75])], [0.0, 0.0]),
    "one domain wanted": ([(10, [0.75, 0.25]), (40, [0.25, 0.75]), (5, [1.0, 0.0])], [25.0, 0.0]),
    "one row": ([(9, [0.25, 0.75])], [5.0, 1.0]),
}


@pytest.mark.parametrize("case", CASES)
def test_rates_are_least_squares(spark, case):
    rows, t = CASES[case]
    w = spark.createDataFrame(rows, "tokens long, p array<double>")
    steps, totals = soft_mixing.fit_rates(w, np.array(t))
    p, n = np.array([r[1] for r in rows]), np.array([float(r[0]) for r in rows])
    assert np.abs(totals - best_totals(p, n, np.array(t))).max() < 1e-6
    rates = soft_mixing.replayed(p, steps)
    assert rates.min() >= 0 and np.allclose((n * rates) @ p, totals, atol=1e-9)
    assert np.allclose([r[0] for r in w.select(soft_mixing._rate(steps)).collect()], rates, atol=1e-9)


def test_random_rates_are_least_squares(spark):
    rnd = np.random.default_rng(4)
    for d in (2, 3):
        p = soft_mixing.on_grid(rnd.dirichlet(np.ones(d), 7))
        n = rnd.integers(1, 90, 7).astype(float)
        t = (p * n[:, None]).sum(axis=0) * np.array([3.0, 0.2, 1.5][:d])
        w = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p)], "tokens long, p array<double>")
        assert np.abs(soft_mixing.fit_rates(w, t)[1] - best_totals(p, n, t)).max() < 1e-6


def test_posteriors_stand_on_the_grid():
    p = soft_mixing.on_grid(np.random.default_rng(1).dirichlet(np.ones(3), 500))
    assert (p >= 0).all() and (p.sum(axis=1) == 1).all() and (p * soft_mixing.GRID == np.rint(p * soft_mixing.GRID)).all()


def test_sample_is_bounded(spark, monkeypatch):
    taken = []
    cells = soft_mixing.np.flatnonzero
    t = spark.range(300).select(F.lit(7).alias("doc_id"), F.concat(F.lit("word "), F.col("id") % 2).alias("text"), (F.col("id") % 2).cast("string").alias("label"))
    monkeypatch.setattr(soft_mixing.np, "flatnonzero", lambda x: taken.append(1) or cells(x))
    domains, w, _ = soft_mixing.fit(t, rows=40)
    assert len(taken) == 40 and set(domains) <= {"0", "1"} and w.shape[1] == len(domains)
    taken.clear()
    soft_mixing.fit(spark.range(30).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), "id").alias("text"), F.lit("x").alias("label")), rows=40)
    assert len(taken) == 30


# --- languages ---------------------------------------------------------------------------------
LETTERS = {"aa": "abcdef", "bb": "efghij", "cc": "klmnop"}


def word(rnd, lang):
    return "".join(rnd.choice(LETTERS[lang]) for _ in range(rnd.randint(2, 7)))


@pytest.mark.parametrize("seed", range(6))
def test_language_sets_equal_brute_force(spark, seed):
    rnd = random.Random(seed)
    train = spark.createDataFrame([(" ".join(word(rnd, lang) for _ in range(400)), lang) for lang in LETTERS], "text string, lang string")
    langs, logp = mixed_language.train(train)
    share = rnd.choice([0, 0, 0.3, 0.5])
    text = " ".join(word(rnd, "cc" if rnd.random() < share else "aa") for _ in range(60))
    cells, starts = mixed_language._trigrams(text)
    ll = np.add.reduceat(logp[cells], starts, axis=0).astype(float)
    p = np.exp(ll - ll.max(axis=1, keepdims=True)).clip(1e-30)

    def value(mix):
        return float(np.log(p @ mix).sum())

    grid = [np.array([i, j, 200 - i - j]) / 200 for i in range(201) for j in range(201 - i)]
    fee = mixed_language.PENALTY * np.log(len(p)) + mixed_language.MARGIN
    best = max(grid, key=lambda m: value(m) - fee * ((m > 0).sum() - 1))
    main, mix = mixed_language.infer(text, logp)
    assert set(np.flatnonzero(mix)) == set(np.flatnonzero(best)) and main == int(best.argmax())
    assert np.abs(mix - best).max() < 0.02 and value(mix) >= value(best) - 0.05


# --- urls --------------------------------------------------------------------------------------
def token_sets(urls, spark):
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string")
    return [frozenset(r["t"]) for r in rows.orderBy("i").select(url_rules.tokens_of(F.col("url")).alias("t")).collect()]


@pytest.fixture(scope="module")
def labelled(spark):
    rnd = random.Random(2)
    urls = [f"http://{rnd.choice(['a', 'b'])}.{rnd.choice(['x', 'y'])}.org/{rnd.choice(['p', 'q'])}/{rnd.choice(['r', 's'])}?{rnd.choice(['k', 'l'])}=1" for _ in range(120)]
    return [(u, "block" if ("/q/" in u) != (rnd.random() < 0.15) else "allow") for u in urls]


def brute_rules(sets, labels, support, confidence):
    n, out = len(sets), {}
    for s in {frozenset(c) for full in set(sets) for k in range(1, len(full) + 1) for c in itertools.combinations(sorted(full), k)}:
        of = [x for x, y in zip(labels, sets) if s <= y]
        for x in set(of):
            if of.count(x) >= support * n and of.count(x) >= confidence * len(of):
                out[(tuple(sorted(s)), x)] = (of.count(x) / len(of), of.count(x) / n)
    return out


def test_mined_rules_equal_brute_force(spark, labelled):
    sets = token_sets([u for u, _ in labelled], spark)
    want = brute_rules(sets, [x for _, x in labelled], max(0.2, url_rules.MIN_COUNT / len(sets)), 0.7)
    got = url_rules.mine(spark.createDataFrame(labelled, "url string, label string"), min_support=0.2, min_confidence=0.7).collect()
    assert {(tuple(r["tokens"]), r["label"]): (pytest.approx(r["confidence"]), pytest.approx(r["support"])) for r in got} == want and len(want) > 10
    often = {t: sum(t in s for s in sets) for t in set().union(*sets)}
    assert all(r["key"] == min(r["tokens"], key=lambda t: (often[t], t)) for r in got)


def test_matches_equal_brute_force_in_scan_and_by_join(spark, labelled):
    mined = url_rules.mine(spark.createDataFrame(labelled, "url string, label string"), min_support=0.2, min_confidence=0.6)
    rules = mined.collect()
    urls = [*{u for u, _ in labelled}, "http://b.y.org/", "http://other.com/p/r", None, "", "http://b.y.org/q/s?z=1&k=2"] * 2
    pages = spark.createDataFrame([(i if i % 3 else None, u) for i, u in enumerate(urls)], "page_id int, url string")
    want = []
    for u, own in zip(urls, token_sets(urls, spark)):
        fits = [(r["confidence"], r["support"], len(r["tokens"]), " ".join(r["tokens"]), r["label"]) for r in rules if set(r["tokens"]) <= own]
        want.append((u or "", max(fits)[4] if fits else "allow"))
    for scan in (10**6, 0):
        got = [(r["url"] or "", r["verdict"]) for r in url_rules.judge(pages, [], mined, scan_rules=scan).collect()]
        assert sorted(got) == sorted(want)
    assert url_rules.judge(pages.limit(0), [], mined).count() == 0


def test_a_fit_in_blocks_equals_one_pass_and_keeps_few_numbers(spark, monkeypatch):
    r = random.Random(7)
    word = lambda: f"w{r.randrange(4000)}"
    rows = [(i, " ".join(word() for _ in range(r.choice([0, 3, 40, 3500]))), r.choice("abc")) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, label string")
    whole = soft_mixing.fit(frame)
    for cells in (np.arange(0), np.arange(5), np.arange(0, soft_mixing.CELLS, 3)):
        assert (soft_mixing._read(soft_mixing._stored(cells)) == cells).all() and len(soft_mixing._stored(cells)) <= min(2 * len(cells), soft_mixing.CELLS // 8)
    monkeypatch.setattr(soft_mixing, "BLOCK", 500)
    parts = soft_mixing.fit(frame)
    assert whole[0] == parts[0] and all(np.allclose(a, b, atol=1e-9) for a, b in zip(whole[1:], parts[1:]))
