"""Many rules through the automaton against the same rules one after the other."""

import random

from parley.operators import corrections

LINE = "meeting_id string, idx int, speaker string, text string"


def test_automaton_equals_the_fold(spark):
    r = random.Random(3)
    words = ["Ann", "anna", "An", "a", "B.o", "bo", "C++", "$x", "é", "Zoë", "price", "prices", "new price", "\\1", "x_y", "7", "(hi)", "ANN lee"]
    rules = [(r.choice(words), r.choice(words + ["", "$1 \\2"]), r.choice(["global", "global", "meeting:m1", "meeting:m2"])) for _ in range(40)]
    lines = [(r.choice(["m1", "m2", "m3", None]), i, r.choice(words + [None]), " ".join(r.choice(words) + r.choice(["", ",", "'s", "."]) for _ in range(r.randint(0, 9)))) for i in range(150)]
    frame = spark.createDataFrame(lines, LINE)
    key = lambda df: sorted((x["idx"], x["speaker"], x["text"]) for x in df.collect())
    got, want = key(corrections.apply_dictionary(frame, rules, 0)), frame
    for i, rule in enumerate(rules):
        want = corrections.apply_dictionary(want, [rule])
        if i % 10 == 9:
            want = spark.createDataFrame(want.collect(), LINE)
    assert sorted(map(str, got)) == sorted(map(str, key(want)))


def test_the_plan_does_not_grow_with_the_rules(spark):
    frame = spark.createDataFrame([("m1", 0, "Ann", "Ann said w7 to w999")], LINE)
    size = lambda n: len(corrections.apply_dictionary(frame, [(f"w{i}", f"v{i}", "global") for i in range(n)])._jdf.queryExecution().toString())
    assert size(1000) < size(10) + 200
    assert corrections.apply_dictionary(frame, [(f"w{i}", f"v{i}", "global") for i in range(1000)]).first()["text"] == "Ann said v7 to v999"
