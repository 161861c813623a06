"""Corrections of misheard names: find, apply, undo, remember (DML-11..15, SC-8..10, SC-21)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from parley.functions import text as T
from parley.functions.dictionary import rewriter


def occurrences(fields: DataFrame, old: str, new: str) -> DataFrame:
    """fields (target, key, field, text) -> (ref, target, key, field, token, snippet, match): the text
    itself as a whole word in any case, and capitalised words within a small edit distance of it that are
    neither old nor new (DML-11)."""
    exact = fields.where(F.col("text").rlike(T.whole_word(old))).withColumn("token", F.lit(old)).withColumn("match", F.lit("exact"))
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(rf"{T._B}[A-Z][a-zA-Z]{{2,}}{T._B}"), F.lit(0)))
    fuzzy = fields.withColumn("token", F.explode(words)).where(~F.lower("token").isin(old.lower(), new.lower()) & T.edit_near(F.col("token"), F.lit(old)) & (F.abs(F.length("token") - len(old)) <= 2)).withColumn("match", F.lit("fuzzy"))
    rows = exact.unionByName(fuzzy)
    ref = F.concat("target", F.lit(":"), "key", F.lit("#"), "field", F.lit("#"), "token")
    return rows.select(ref.alias("ref"), "target", "key", "field", "token", T.snippet(F.col("text"), F.col("token")).alias("snippet"), "match")


def meeting_fields(meeting_id: str, utterances: DataFrame, claims: DataFrame, meetings: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every text of a meeting that a correction can touch, as (target, key, field, text)."""
    row = lambda df, target, key, field, text: df.select(F.lit(target).alias("target"), key.cast("string").alias("key"), F.lit(field).alias("field"), text.alias("text"))
    own = lambda df, key="meeting_id": df.where(F.col(key) == meeting_id)
    parts = [
        row(own(utterances), "utterance", F.col("idx"), "text", F.col("text")),
        row(own(claims), "claim", F.col("id"), "body", F.coalesce("edited_body", "body")),
        row(own(claims), "claim", F.col("id"), "quote", F.col("quote")),
        row(own(meetings, "id"), "meeting_field", F.lit("title"), "title", F.col("title")),
        row(nodes, "node", F.col("id"), "label", F.col("label")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("text is not null")


def apply(fields: DataFrame, found: DataFrame, accepted: list[str], new: str) -> DataFrame:
    """fields with the accepted occurrences rewritten, and `before` where a text changed: the before-image
    from which undo restores it (DML-12). Tokens of one field are replaced one after another."""
    take = found.where(F.col("ref").isin(accepted)).groupBy("target", "key", "field").agg(F.array_sort(F.collect_set("token")).alias("tokens"))
    rows = fields.join(take, ["target", "key", "field"], "left")
    tokens = sorted({r.rsplit("#", 1)[1] for r in accepted})
    text = F.col("text")
    for t in tokens:
        text = F.when(F.array_contains("tokens", t), T.replace_word(text, t, new)).otherwise(text)
    changed = F.col("tokens").isNotNull()
    return rows.select("target", "key", "field", text.alias("text"), F.when(changed, F.col("text")).alias("before"))


def undo(applied: DataFrame) -> DataFrame:
    """Every touched text as it was (DML-13)."""
    return applied.select("target", "key", "field", F.coalesce("before", "text").alias("text"))


def merge_node(nodes: DataFrame, edges: DataFrame, old: str, new_label: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """A renamed node is merged: its edges move to the node of the new label, doubles go, it goes (DML-14)."""
    new = f"{kind}:" + re.sub("^-|-$", "", re.sub("[^a-z0-9]+", "-", new_label.lower()))
    moved = edges.select(F.when(F.col("src") == old, new).otherwise(F.col("src")).alias("src"), F.when(F.col("dst") == old, new).otherwise(F.col("dst")).alias("dst"), "kind", "meeting_id").dropDuplicates(["src", "dst", "kind", "meeting_id"])
    fresh = nodes.where(F.col("id") == old).select(F.lit(new).alias("id"), F.lit(new_label).alias("label"), F.col("kind"))
    kept = nodes.where(F.col("id") != old)
    return kept.unionByName(fresh.join(kept.select("id"), "id", "left_anti").select(kept.columns)), moved


#: Up to so many rules are Column expressions; more go through one automaton.
FEW_RULES = 8


def apply_dictionary(utterances: DataFrame, rules: list[tuple[str, str, str]], few: int = FEW_RULES) -> DataFrame:
    """Remembered rules (from, to, scope), in order, the output of one feeding the next, on text and
    speaker; scope is global or meeting:<id> (DML-15). The rules are a user's own list."""
    text, speaker = F.col("text"), F.col("speaker")
    if len(rules) > few:
        rewritten = rewriter(utterances.sparkSession, rules)
        return utterances.withColumns({"text": rewritten(text, "meeting_id"), "speaker": rewritten(speaker, "meeting_id")})
    for old, new, scope in rules:
        here = F.lit(True) if scope == "global" else F.col("meeting_id") == scope.partition(":")[2]
        text = F.when(here, T.replace_word(text, old, new)).otherwise(text)
        speaker = F.when(here, T.replace_word(speaker, old, new)).otherwise(speaker)
    return utterances.withColumns({"text": text, "speaker": speaker})


def word_swap(before: str | None, after: str | None) -> tuple[str, str] | None:
    """The one short, capitalised phrase that an edit swapped for another, or None (SC-21)."""
    if not before or not after or before == after or abs(len(before) - len(after)) > 40:
        return None
    a, b = re.split(r"(\s+)", before), re.split(r"(\s+)", after)
    lead = 0
    while lead < min(len(a), len(b)) and a[lead] == b[lead]:
        lead += 1
    tail = 0
    while tail < min(len(a), len(b)) - lead and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    old, new = "".join(a[lead : len(a) - tail]).strip(), "".join(b[lead : len(b) - tail]).strip()
    short = all(0 < len(s) <= 40 and "\n" not in s and len(s.split()) <= 3 and re.match("[A-Z]", s) for s in (old, new))
    return (old, new) if short and old != new else None


@F.pandas_udf(StructType([StructField("old", StringType()), StructField("new", StringType())]))
def detect_word_swap(before: pd.Series, after: pd.Series) -> pd.DataFrame:
    found = [word_swap(a, b) or (None, None) for a, b in zip(before, after)]
    return pd.DataFrame(found, columns=["old", "new"])
