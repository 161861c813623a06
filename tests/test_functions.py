"""Text and number functions: tables of cases."""

import pytest
from pyspark.sql import functions as F

from parley.functions import numbers as N
from parley.functions import stem as S
from parley.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("text, value", [("two hundred fifty", 250), ("two hundred and fifty", 250), ("twenty five thousand", 25000), ("one million two hundred thousand", 1200000), ("fifteen", 15), ("hundred", 100)])
def test_spelled_numbers(text, value):
    assert [v for _, v in N.spelled(text)] == [value]


def test_spelled_numbers_are_separate_runs():
    assert N.spelled("three cats and seven dogs, zero fish") == [("three", 3), ("seven", 7)]


@pytest.mark.parametrize("text, cited, missing", [
    ("It costs $25,000", "we said 25000 dollars", []), ("It costs $25k", "it was 25,000", []), ("grew 12%", "grew twelve percent", []), ("grew 12%", "grew a lot", ["12%"]), ("grew 12%", "grew 12 percent", []),
    ("on 2024-03-05", "2024 03 05, march 5", []), ("on Friday", "see you fri", []), ("in March", "in april", ["March"]), ("[S001] said three", "x", []),
])
def test_verbatim(text, cited, missing):
    found = N.misses(text, cited)
    assert found == missing


def test_haystack_has_plain_and_spelled_forms():
    hay = N.haystack("Paid 25,000 and two hundred")
    assert "25000" in hay and "200" in hay and "25,000" in hay


@pytest.mark.parametrize("a, b, low, high", [("ANZ rollout", "ANZ pricing", 0.2, 0.4), ("CS dashboard", "sales dashboard", 0.15, 0.72), ("red rod", "red rod", 1.0, 1.0), ("", "x", 0.0, 0.0)])
def test_similarity(spark, a, b, low, high):
    assert low <= one(spark, T.similarity(F.lit(a), F.lit(b))) <= high


def test_short_labels_have_no_trigrams(spark):
    assert one(spark, T.trigrams(F.lit("ab"))) == []


@pytest.mark.parametrize("text, phrase", [("Let's follow up on the pricing page by Friday", "pricing page"), ("Ship the new onboarding flow", "new onboarding flow"), ("the", None), ("We will review the Q3 budget.", "Q3 budget")])
def test_noun_phrase(spark, text, phrase):
    assert one(spark, T.noun_phrase(F.lit(text))) == phrase


def test_word_boundaries_are_ascii(spark):
    assert one(spark, T.replace_word(F.lit("Ann and Anné and ann"), "Ann", "Eva")) == "Eva and Evaé and Eva"


def test_snippet_adds_ellipses(spark):
    text = "x" * 60 + " Ann " + "y" * 60
    s = one(spark, T.snippet(F.lit(text), F.lit("ann")))
    assert s.startswith("…") and s.endswith("…") and "Ann" in s and len(s) == 85
    assert one(spark, T.snippet(F.lit("short"), F.lit("zzz"))) == "short"


def test_quoted_spans(spark):
    assert one(spark, T.quoted_spans(F.lit('he said "we ship." and “not yet”'))) == ["we ship", "not yet"]


@pytest.mark.parametrize("word, stem", [("caresses", "caress"), ("ponies", "poni"), ("hopping", "hop"), ("relational", "relat"), ("happy", "happi"), ("adoption", "adopt"), ("probate", "probat"), ("controlling", "control"), ("sky", "sky")])
def test_porter(word, stem):
    assert S.porter(word) == stem


def test_fold():
    assert S.fold("Éléphant") == "elephant"


def test_text_functions_compute_each_step_once(spark):
    # Written out in full, a step that is named n times is computed n times, or once for each element of a lambda.
    df = spark.createDataFrame([("Review the budget", "budget review")], "a string, b string")
    for made, most in ((T.similarity(F.col("a"), F.col("b")), 8), (T.trigrams(F.col("a")), 2), (T.noun_phrase(F.col("a")), 7)):
        assert df.select(made.alias("v"))._jdf.queryExecution().analyzed().toString().count("regexp_replace(") <= most
