"""One turn of a conversation: enumeration from the claims, or retrieval against all that the thread has seen (CP-10)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.operators import claims as C
from parley.operators import gates as Q
from parley.operators import maintenance as M
from parley.operators import retrieve as R

#: Points of an extractive reply and characters of their quotes, topics that a refusal offers.
POINTS, QUOTE, OFFERED = 3, 80, 4


def corpus_ids(messages: DataFrame, conversation_id: int) -> DataFrame:
    """(chunk_id): the chunks that earlier replies of a thread retrieved; messages: conversation_id, payload (AG-25)."""
    ids = F.from_json(F.get_json_object("payload", "$.chunk_ids"), "array<bigint>")
    return messages.where((F.col("conversation_id") == conversation_id) & F.col("payload").isNotNull()).select(F.explode(ids).alias("chunk_id")).distinct()


def enumerated(question: str, claims: DataFrame, meetings: DataFrame, scope: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(summary, points) of a question that asks for a list: every claim it means, newest meeting first."""
    kind = "decision" if re.search("decision", question, re.I) else "risk" if re.search("risk", question, re.I) else "action_item"
    open_only = kind == "action_item" and not re.search(C.EVERYTHING.removeprefix("(?i)"), question, re.I)
    rows = C.enumerate_claims(claims, meetings, kind, open_only, scope)
    noun = ("open action item" if open_only else "action item") if kind == "action_item" else kind
    return C.enumeration_summary(rows, noun, scope is not None), rows.select("text", "quote", "meeting_id", F.col("title").alias("meeting_title"), "offset_s", "id")


def turn(question: str, fresh: DataFrame, prior: DataFrame, topics: DataFrame, points: DataFrame | None = None) -> DataFrame:
    """(mode, text, quote, meeting_id, chunk_id) of a question that is answered by retrieval.

    fresh are the snippets of this question (with a score), prior those of earlier turns (chunk_id, meeting_id, text); fresh ones
    win. points (text, chunk_id, quote) are a model's; those that the snippets carry make a synthesised reply. Without
    any, the first fresh snippets are quoted; without snippets the reply is refused and offers topics (label)."""
    columns = ["chunk_id", "meeting_id", "text"]
    corpus = M.last_wins(prior.select(columns), fresh.select(columns), ["chunk_id"])
    best = fresh.orderBy(F.desc("score"), "chunk_id").limit(POINTS)
    quoted = best.select("text", "chunk_id", F.substring("text", 1, QUOTE).alias("quote"))

    def gated(some: DataFrame, mode: str) -> DataFrame:
        # Equal points are one; the optimiser would else push the test of the reason through all that it is made of.
        judged = Q.answer_gate(some.select("text", "chunk_id", "quote"), corpus).groupBy("text", "chunk_id", "quote").agg(F.max("reason").alias("reason"))
        kept = judged.where("reason is null")
        return kept.join(corpus.select("chunk_id", "meeting_id"), "chunk_id").select(F.lit(mode).alias("mode"), "text", "quote", "meeting_id", "chunk_id")

    extractive = gated(quoted, "extractive")
    none = F.lit(None).cast("string")
    refused = topics.limit(OFFERED).select(F.lit("refused").alias("mode"), F.col("label").alias("text"), none.alias("quote"), none.alias("meeting_id"), F.lit(None).cast("long").alias("chunk_id"))
    found = extractive if points is None else gated(points, "synthesized").unionByName(extractive)
    rank = lambda c: F.when(c == "synthesized", 0).when(c == "extractive", 1).otherwise(2)
    every = found.unionByName(refused)
    first = every.agg(F.min(rank(F.col("mode"))).alias("best"))
    return every.join(F.broadcast(first)).where(rank(F.col("mode")) == F.col("best")).drop("best")


def retrieved(chunks: DataFrame, meetings: DataFrame, question: str, as_of_ms: int, scope: DataFrame | None = None, ix: R.Index | None = None) -> DataFrame:
    """The snippets of a question, in a project's meetings only where there is a scope (meeting_id)."""
    found = R.retrieve(chunks, meetings, question, as_of_ms, ix=ix)
    return found if scope is None else found.join(scope.select("meeting_id").distinct(), "meeting_id", "left_semi")
