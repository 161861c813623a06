"""Retrieval chunks: sliding windows of utterances, claim and summary chunks (WN-1, CP-7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Window size, stride and text cap of a chunk.
SIZE, STRIDE, CAP = 3, 2, 900
#: Chunk ids of a meeting start at its number times this, so that no global numbering is needed.
SPAN = 1 << 20


def windows(utterances: DataFrame) -> DataFrame:
    """(id, meeting_id, src_id, start_offset_s, end_offset_s, speakers, text): every STRIDE-th window of
    SIZE utterances; a start is the first of its meeting or has an utterance behind it. An id follows
    from the meeting's number and the place, without a sort over meetings."""
    by = Window.partitionBy("meeting_id")
    order = by.orderBy("idx")
    ahead = by.orderBy("pos").rowsBetween(0, SIZE - 1)
    line = F.concat(F.coalesce("speaker", "speaker_role"), F.lit(": "), "text")
    rows = utterances.withColumn("pos", (F.row_number().over(order) - 1).cast("long")).withColumn("n", F.count("*").over(by))
    rows = rows.select(
        "meeting_id", "pos", "n", F.col("offset_s").alias("start_offset_s"), F.max(F.col("offset_s") + F.col("duration_s")).over(ahead).alias("end_offset_s"),
        F.array_join(F.array_sort(F.array_distinct(F.collect_list("speaker").over(ahead))), ", ").alias("speakers"),
        F.substring(F.array_join(F.collect_list(line).over(ahead), "\n"), 1, CAP).alias("text"))
    kept = rows.where((F.col("pos") % STRIDE == 0) & ((F.col("pos") == 0) | (F.col("pos") < F.col("n") - 1)))
    number = F.substring("meeting_id", 2, 20).cast("long")
    return kept.select((number * SPAN + F.col("pos") / STRIDE).cast("long").alias("id"), "meeting_id", F.col("pos").alias("src_id"), "start_offset_s", "end_offset_s", "speakers", "text")


def claim_chunks(claims: DataFrame) -> DataFrame:
    """One chunk of kind claim for each passed claim: kind, label and quote."""
    label = claim_label("body", "quote")
    return claims.where("gate = 'passed'").select("meeting_id", F.lit("claim").alias("kind"), F.col("id").alias("src_id"), F.concat_ws(" — ", "kind", label, "quote").alias("text"))


def summary_chunks(meetings: DataFrame) -> DataFrame:
    """One chunk of kind summary for each meeting that has a summary, else of its title."""
    text = F.coalesce("summary", "title") if "summary" in meetings.columns else F.col("title")
    return meetings.select(F.col("id").alias("meeting_id"), F.lit("summary").alias("kind"), F.lit(0).cast("long").alias("src_id"), text.alias("text"))


def every_chunk(utterances: DataFrame, claims: DataFrame, meetings: DataFrame) -> DataFrame:
    """(meeting_id, kind, src_id, start_offset_s, end_offset_s, speakers, text): the windows, passed claims and
    summaries of all meetings (CP-7); a claim stands at its offset, a summary at the start."""
    w = windows(utterances).select("meeting_id", F.lit("window").alias("kind"), "src_id", "start_offset_s", "end_offset_s", "speakers", "text")
    at = claims.select(F.col("id").alias("src_id"), F.coalesce("offset_s", F.lit(0.0)).alias("start_offset_s"))
    c = claim_chunks(claims).join(at, "src_id")
    none = F.lit(None).cast("string")
    rows = c.unionByName(summary_chunks(meetings).withColumn("start_offset_s", F.lit(0.0)))
    return w.unionByName(rows.select("meeting_id", "kind", "src_id", "start_offset_s", F.col("start_offset_s").alias("end_offset_s"), none.alias("speakers"), "text"))


def claim_label(body: str, quote: str):
    """task, else text, else description, else the quote, else empty: only null is skipped (FLT-10)."""
    field = lambda k: F.get_json_object(body, f"$.{k}")
    return F.coalesce(field("task"), field("text"), field("description"), F.col(quote), F.lit(""))
