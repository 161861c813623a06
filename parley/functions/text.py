"""Text functions as Column expressions (SC-*)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The four stop-word lists, which differ on purpose.
STOP_QUERY = [
    "which", "what", "who", "when", "where", "why", "how", "did", "does", "do", "is", "are", "was", "were", "the", "a", "an", "of", "to", "for", "and", "or",
    "in", "on", "at", "by", "with", "from", "that", "this", "these", "those", "we", "i", "you", "it", "they", "meetings", "meeting", "discussed",
    "discuss", "talk", "talked", "about",
]
STOP_ENTITY = [
    "the", "a", "an", "of", "to", "for", "and", "or", "is", "are", "in", "on", "at", "by", "with", "from", "that", "this", "our", "your", "their",
]
STOP_TOPIC = [
    "the", "a", "an", "of", "to", "for", "and", "or", "is", "are", "was", "were", "be", "been", "in", "on", "at", "by", "with", "from", "that",
    "this", "these", "those", "we", "i", "you", "he", "she", "it", "they", "our", "your", "their", "my", "me", "us", "them", "will", "would",
    "should", "could", "can", "may", "might", "so", "if", "then", "than", "as", "but", "not", "no", "yes", "ok", "okay", "just", "really", "very",
    "much", "more", "most", "some", "any", "all",
]
STOP_GROUNDING = [
    "a", "an", "and", "the", "to", "of", "in", "on", "for", "with", "is", "are", "was", "were", "be", "been", "it", "its", "this", "that", "they",
    "we", "you", "i", "he", "she", "them", "us", "our", "your", "as", "at", "by", "from", "or", "but", "if", "then", "than", "so", "not", "no",
    "yes", "do", "does", "did", "have", "has", "had", "will", "would", "can", "could", "should", "about", "into", "over", "under", "out", "up",
    "down", "more", "most", "less", "least", "very", "really", "just", "also", "too", "only", "there", "here", "what", "which", "who", "whom",
    "whose",
]


def _list(words: list[str]) -> Column:
    return F.array(*(F.lit(w) for w in words))


def _let(x: Column, of: Callable[[Column], Column]) -> Column:
    """of(x), with x computed once however often `of` names it."""
    return F.element_at(F.transform(F.array(x), of), 1)


def normalize(x: Column) -> Column:
    """Lower case, other than a-z, 0-9 and white space to spaces, runs squeezed, trimmed (SC-1)."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), r"[^a-z0-9\s]", " "), r"\s+", " "))


def slug(kind: Column, label: Column) -> Column:
    """kind:label with runs of other characters as one dash, none at the ends (SC-2)."""
    s = F.regexp_replace(F.lower(label), "[^a-z0-9]+", "-")
    return F.concat(kind, F.lit(":"), F.regexp_replace(s, "^-|-$", ""))


def _tokens(x: Column, stop: list[str]) -> Column:
    return F.filter(F.split(normalize(x), " "), lambda w: (F.length(w) >= 2) & ~F.array_contains(_list(stop), w))


def query_terms(x: Column) -> Column:
    """Words of a question of two letters or more that are no stop words (SC-3)."""
    return _tokens(x, STOP_QUERY)


def entity_tokens(x: Column) -> Column:
    return _tokens(x, STOP_ENTITY)


def jaccard(a: Column, b: Column) -> Column:
    """Over token arrays; 0 if either is empty (SC-4)."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def trigrams(x: Column) -> Column:
    each = lambda n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(n) - 2), lambda i: F.substring(n, i, F.lit(3))))
    return _let(normalize(x), lambda n: F.when(F.length(n) < 3, F.array().cast("array<string>")).otherwise(each(n)))


def _dice(x: Column, y: Column) -> Column:
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(2 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y)))


def dice(a: Column, b: Column) -> Column:
    """Trigram Dice coefficient; 0 if either has no trigram (SC-5)."""
    return _let(F.struct(trigrams(a).alias("x"), trigrams(b).alias("y")), lambda s: _dice(s["x"], s["y"]))


def similarity(a: Column, b: Column) -> Column:
    """0.6 Jaccard + 0.4 Dice + 0.15 for the same last token, at most 1; 0 without tokens (SC-6)."""

    def score(s: Column) -> Column:
        x, y = s["x"], s["y"]
        sum_ = 0.6 * jaccard(x, y) + 0.4 * _dice(s["g"], s["h"]) + F.when(F.try_element_at(x, F.lit(-1)) == F.try_element_at(y, F.lit(-1)), 0.15).otherwise(0.0)
        return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.least(F.lit(1.0), sum_))

    return _let(F.struct(entity_tokens(a).alias("x"), entity_tokens(b).alias("y"), trigrams(a).alias("g"), trigrams(b).alias("h")), score)


def anchors(a: Column, b: Column) -> Column:
    """Tokens of a that b has, in a's order, duplicates kept (SC-7)."""
    y = entity_tokens(b)
    return F.filter(entity_tokens(a), lambda w: F.array_contains(y, w))


def edit_near(a: Column, b: Column) -> Column:
    """Within one edit for words of five letters or fewer (of b), else within two (SC-8)."""
    return F.levenshtein(F.lower(a), F.lower(b)) <= F.when(F.length(b) <= 5, 1).otherwise(2)


#: ASCII word boundaries: letters with accents are no word characters.
_B = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def whole_word(literal: str) -> str:
    """A Java pattern for a literal as whole words in any case (SC-9)."""
    import re

    return f"(?i){_B}{re.sub(r'([.*+?^${}()|\[\]\\\\])', r'\\\1', literal)}{_B}"


def replace_word(x: Column, old: str, new: str) -> Column:
    return F.regexp_replace(x, whole_word(old), new.replace("\\", "\\\\").replace("$", "\\$"))


def snippet(x: Column, token: Column) -> Column:
    """40 characters around the first occurrence, with ellipses; the first 80 without one (SC-10)."""
    at = F.instr(F.lower(x), F.lower(token))
    start = F.greatest(F.lit(1), at - 40)
    end = F.least(F.length(x), at - 1 + F.length(token) + 40)
    cut = F.concat(F.when(start > 1, "…").otherwise(""), F.substring(x, start, end - start + 1), F.when(end < F.length(x), "…").otherwise(""))
    return F.when(at == 0, F.substring(x, 1, 80)).otherwise(cut)


def contains_loosely(haystack: Column, needle: Column) -> Column:
    """The needle as a substring, or at least 70 % of its words of four letters and more (SC-11)."""
    words = F.filter(F.split(needle, " "), lambda w: F.length(w) > 3)
    hits = F.size(F.filter(words, lambda w: F.contains(haystack, w)))
    return (needle != "") & (F.contains(haystack, needle) | ((F.size(words) > 0) & (hits / F.greatest(F.size(words), F.lit(1)) >= 0.7)))


def word_overlap(a: Column, b: Column) -> Column:
    """Shared words of three letters and more over the smaller set; 0 if one is empty (SC-12)."""
    w = lambda x: F.array_distinct(F.filter(F.split(normalize(x), " "), lambda t: F.length(t) > 2))
    x, y = w(a), w(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.least(F.size(x), F.size(y)))


def echo_norm(x: Column) -> Column:
    """Lower case with punctuation deleted, not spaced, and spaces squeezed (SC-13)."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), r"[^a-z0-9\s]", ""), r"\s+", " "))


#: Openings and tails that a noun phrase loses.
LEAD = (r"(?i)^(?:let'?s\s+)?(?:we\s+(?:will\s+|should\s+|need\s+to\s+)?)?(?:keep\s+an\s+eye\s+on|take\s+a\s+look\s+at|follow\s+up\s+on|circle\s+back\s+on|come\s+back\s+with|check\s+in\s+on|"
        r"delay|move|rebuild|build|send|ship|share|update|review|fix|add|create|draft|prepare|escalate|keep|start|stop|finish|confirm|check|decide|agree)\s+(?:the\s+|a\s+|an\s+|our\s+|my\s+|your\s+)?")  # fmt: skip
TAIL = r"(?i)\s+(?:to|by|until|till|before|after|due|of)\s+.*$"


def noun_phrase(x: Column) -> Column:
    """A sentence's closing noun phrase of one to four words, or null (SC-15)."""
    words = lambda t: F.filter(F.split(t, r"\s+"), lambda w: w != "")
    stop = lambda w: F.array_contains(_list(STOP_TOPIC), F.lower(w))
    # Each step is a name of the next: where it is written out thrice, it would be computed as often.
    def shortened(t: Column) -> Column:
        cut = F.regexp_replace(t, TAIL, "")
        return F.when((F.size(words(cut)) >= 1) & (F.length(cut) >= 3), cut).otherwise(t)

    def closing(ws: Column) -> Column:
        last = F.slice(ws, F.greatest(F.lit(1), F.size(ws) - 3), F.lit(4))
        return _let(last, lambda w: F.when((F.size(w) > 1) & stop(F.try_element_at(w, F.lit(1))), F.slice(w, 2, 4)).otherwise(w))

    bare = F.regexp_replace(F.regexp_replace(F.trim(x), "^[\"'“”]|[\"'“”.,;:!?]+$", ""), LEAD, "")
    phrase = F.regexp_replace(_let(bare, shortened), r"(?i)^(?:the|a|an|our|my|your|their)\s+", "")
    out = _let(words(phrase), lambda ws: F.when(F.size(ws) > 0, F.trim(F.regexp_replace(F.array_join(closing(ws), " "), "[.,;:]+$", ""))))
    return _let(out, lambda o: F.when((F.length(o) >= 3) & F.exists(F.split(o, r"\s+"), lambda w: ~stop(w)), o))


def plausible_topic(x: Column) -> Column:
    """No clock time, three letters or more, not mostly digits, at most five words (SC-16)."""
    t = F.trim(x)
    letters, digits = F.regexp_count(t, F.lit("[A-Za-z]")), F.regexp_count(t, F.lit(r"\d"))
    return ~t.rlike(r"^\d{1,2}:\d{2}(:\d{2})?$") & (letters >= 3) & (digits <= letters) & (F.size(F.split(t, r"\s+")) <= 5)


def flat(x: Column) -> Column:
    """Lower case, plain quotes, single spaces (SC-19)."""
    return F.trim(F.regexp_replace(F.translate(F.lower(x), "“”’", "\"\"'"), r"\s+", " "))


def content_words(x: Column) -> Column:
    """(SC-17)"""
    return F.filter(F.split(F.regexp_replace(flat(x), r"[^a-z0-9\s%$.-]", " "), r"\s+"), lambda w: (F.length(w) > 2) & ~F.array_contains(_list(STOP_GROUNDING), w))


def lexical_overlap(x: Column, haystack: Column) -> Column:
    """Share of distinct content words that the haystack holds; 1 without any."""
    words = F.array_distinct(content_words(x))
    return F.when(F.size(words) == 0, 1.0).otherwise(F.size(F.filter(words, lambda w: F.contains(haystack, w))) / F.size(words))


def quoted_spans(x: Column) -> Column:
    """Spans between straight or curly quotes, trimmed of punctuation (SC-18)."""
    spans = F.regexp_extract_all(x, F.lit('[“"]([^“”"]{2,})[”"]'), F.lit(1))
    clean = F.transform(spans, lambda s: F.regexp_replace(F.trim(s), r"^[\s.,;:!?—-]+|[\s.,;:!?—-]+$", ""))
    return F.filter(clean, lambda s: s != "")


def fact_tokens(x: Column) -> Column:
    """Capitalised words and numbers, which an answer must find in its sources (SC-31)."""
    return F.regexp_extract_all(x, F.lit(rf"{_B}(?:[A-Z][a-z]{{2,}}{_B}|\d[\d.,%$/-]*{_B})"), F.lit(0))


def strip_markers(x: Column) -> Column:
    """Text without its [S001, S002] markers (SC-24)."""
    return F.trim(F.regexp_replace(x, r"\s*\[[A-Za-z]\d+(?:\s*,\s*[A-Za-z]\d+)*\]", ""))


def inline_sources(x: Column) -> Column:
    """The distinct ids of a text's markers (SC-24)."""
    return F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(x, F.lit(r"\[([A-Za-z]\d+(?:\s*,\s*[A-Za-z]\d+)*)\]"), F.lit(1)), lambda s: F.split(s, r"\s*,\s*"))))


def clipped(x: Column) -> Column:
    """At most 60 characters: 57, without white space at their end, and an ellipsis (SC-23)."""
    return F.when(F.length(x) > 60, F.concat(F.regexp_replace(F.substring(x, 1, 57), r"\s+$", ""), F.lit("…"))).otherwise(x)


def highlight(x: Column, terms: list[str], width: int = 12) -> Column:
    """A window of tokens around the first one that begins with a term, which stands in bold, with an ellipsis
    where text is left out (SC-25)."""
    tokens = F.split(F.trim(x), r"\s+")
    hit = lambda t: reduce(lambda a, b: a | b, [F.startswith(F.regexp_replace(F.lower(t), "[^a-z0-9]", ""), F.lit(w)) for w in terms])
    first = F.coalesce(F.get(F.filter(F.transform(tokens, lambda t, i: F.when(hit(t), i)), lambda i: i.isNotNull()), F.lit(0)), F.lit(0))
    start = F.greatest(F.lit(0), F.least(first - width // 2, F.size(tokens) - width))
    shown = F.transform(F.slice(tokens, start + 1, F.lit(width)), lambda t: F.when(hit(t), F.concat(F.lit("<b>"), t, F.lit("</b>"))).otherwise(t))
    return F.concat(F.when(start > 0, "…").otherwise(""), F.array_join(shown, " "), F.when(start + width < F.size(tokens), "…").otherwise(""))


def parse_json_loose(x: Column) -> Column:
    """The JSON in a model's answer as text, or null (SN-14): the answer, the inside of its first fence, and
    what stands between its first and last brace, each as it is and without trailing commas."""
    t = F.trim(x)
    fenced = F.trim(F.regexp_extract(t, r"```(?:json)?\s*([\s\S]*?)```", 1))
    braced = F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    bare = lambda c: F.regexp_replace(c, r",\s*([}\]])", "$1")
    valid = lambda c: F.to_json(F.try_parse_json(F.nullif(c, F.lit(""))))
    return F.coalesce(*(valid(v) for c in (t, fenced, braced) for v in (c, bare(c))))


def duration_estimate(text: Column, gap: Column) -> Column:
    """0.38 s a word, 1.5 s at least, at most the gap to the next line (SC-20)."""
    words = F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != ""))
    return F.least(F.greatest(F.lit(1.5), words * 0.38), F.coalesce(gap, F.lit(float("inf"))))


#: Fixed value: names that stand for nobody (SC-30).
PLACEHOLDER = r"^(you|them|me|myself|agent|customer|speaker ?\d*|room ?\d*|unknown)$"


def is_placeholder(x: Column) -> Column:
    return normalize(x).rlike(PLACEHOLDER)


def mask_key(x: Column) -> Column:
    """The last four characters behind dots (SC-32)."""
    return F.when(F.length(x) > 4, F.concat(F.lit("…"), F.substring(x, -4, 4))).otherwise("…")


def safe_filename(x: Column) -> Column:
    return F.regexp_replace(x, r"[^A-Za-z0-9._-]+", "_")
