"""Porter's 1980 stemmer and diacritic folding for index terms (SC-26)."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Suffixes of steps 2, 3 and 4 of the published algorithm, and what takes their place.
_STEP2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
]
_STEP3 = [
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""),
]
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _shape(stem: str) -> str:
    """The word as c and v; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(stem):
        out += "v" if ch in "aeiou" or (ch == "y" and i and out[-1] == "c") else "c"
    return out


def _m(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _vowel(stem: str) -> bool:
    return "v" in _shape(stem)


def _cvc(stem: str) -> bool:
    return len(stem) > 2 and _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _longest(word: str, pairs: list[tuple[str, str]], least: int) -> str:
    for suffix, to in sorted(pairs, key=lambda p: -len(p[0])):
        if word.endswith(suffix):
            stem = word[: len(word) - len(suffix)]
            return stem + to if _m(stem) > least else word
    return word


def porter(word: str) -> str:
    if len(word) <= 2 or not word.isascii():
        return word
    for suffix, to in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(suffix):
            word = word[: len(word) - len(suffix)] + to
            break
    again = False
    if word.endswith("eed"):
        word = word[:-1] if _m(word[:-3]) > 0 else word
    elif word.endswith("ed") and _vowel(word[:-2]):
        word, again = word[:-2], True
    elif word.endswith("ing") and _vowel(word[:-3]):
        word, again = word[:-3], True
    if again:
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
            word = word[:-1]
        elif _m(word) == 1 and _cvc(word):
            word += "e"
    if word.endswith("y") and _vowel(word[:-1]):
        word = word[:-1] + "i"
    word = _longest(word, _STEP2, 0)
    word = _longest(word, _STEP3, 0)
    if word.endswith(("sion", "tion")) and not any(word.endswith(s) for s in _STEP4):
        word = word[:-3] if _m(word[:-3]) > 1 else word
    else:
        word = _longest(word, [(s, "") for s in _STEP4], 1)
    if word.endswith("e") and (_m(word[:-1]) > 1 or _m(word[:-1]) == 1 and not _cvc(word[:-1])):
        word = word[:-1]
    if word.endswith("ll") and _m(word) > 1:
        word = word[:-1]
    return word


def fold(text: str) -> str:
    """Lower case without diacritics."""
    if text.isascii():
        return text.lower()
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn")


#: A worker remembers the stems of so many words.
_stem = lru_cache(1 << 17)(porter)


def terms_in(text: str | None) -> list[str]:
    """The index terms of a text, repeated ones too."""
    return [_stem(w) for w in re.findall(r"\w+", fold(text or ""))]


@F.pandas_udf(ArrayType(StringType()))
def index_terms(texts: pd.Series) -> pd.Series:
    return texts.map(terms_in)
