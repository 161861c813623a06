"""Rules that rewrite words, by the thousand, in one pass (DML-15).

Rules are applied in order and the output of one feeds the next. An automaton over all patterns tells which rules can match a
text at all; the first of them is applied, and only if it changed the text is the text looked through again, for later
rules. So a text costs its length and the few rules that it meets, and a plan is as small for a thousand rules as for one."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import SparkSession

from parley.functions.text import whole_word

_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


class Dictionary:
    """(from, to, scope) rules in order; scope is global or meeting:<id>. Case of ASCII letters doesn't matter."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        self.rules = rules
        self.patterns: list[re.Pattern | None] = [None] * len(rules)
        self.automaton = ahocorasick.Automaton()
        by: dict[str, list[int]] = {}
        for i, (old, _, _) in enumerate(rules):
            if old:
                by.setdefault(old.translate(_ASCII_LOWER), []).append(i)
        for word, at in by.items():
            self.automaton.add_word(word, at)
        if by:
            self.automaton.make_automaton()

    def _met(self, text: str, after: int) -> list[int]:
        """Rules after a given one whose pattern stands somewhere in the text."""
        if not len(self.automaton):
            return []
        return sorted({i for _, at in self.automaton.iter(text.translate(_ASCII_LOWER)) for i in at if i > after})

    def rewrite(self, text: str | None, meeting_id: str | None) -> str | None:
        if not text:
            return text
        met, here = self._met(text, -1), f"meeting:{meeting_id}"
        while met:
            i = met.pop(0)
            old, new, scope = self.rules[i]
            if scope != "global" and (meeting_id is None or scope != here):
                continue
            if self.patterns[i] is None:
                self.patterns[i] = re.compile(whole_word(old), re.ASCII)
            changed = self.patterns[i].sub(lambda _, new=new: new, text)
            if changed != text:
                text, met = changed, self._met(changed, i)
        return text


def rewriter(spark: SparkSession, rules: list[tuple[str, str, str]]):
    """A column function (text, meeting_id) -> text; the rules go to the executors once, as a broadcast."""
    from pyspark.sql.functions import pandas_udf

    shipped = spark.sparkContext.broadcast(rules)

    @pandas_udf("string")
    def rewritten(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        # The automaton is made once a task.
        own = Dictionary(shipped.value)
        for texts, meetings in parts:
            yield pd.Series([own.rewrite(t, m) for t, m in zip(texts, meetings)], dtype=object)

    return rewritten
