"""The segment contract over utterances and payloads (SRC-9, WN-9, SN-16)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Confidence below which a segment was heard poorly; meeting types and the modes they follow from.
LOW, TYPES = 0.6, ["team", "investor", "vendor", "customer", "one_on_one"]
TYPE_OF_MODE = {"investor": "investor", "discovery": "customer", "standup": "team", "one_on_one": "one_on_one"}


def segment_id(idx: Column) -> Column:
    """S001 for index 0; ids from 1000 on keep their width."""
    n = (idx + 1).cast("string")
    return F.concat(F.lit("S"), F.when(F.length(n) < 3, F.lpad(n, 3, "0")).otherwise(n))


def confidence(x: Column) -> Column:
    """Absent means 1; others are clamped to 0..1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(x, F.lit(1.0))))


def segments(utterances: DataFrame) -> DataFrame:
    """(meeting_id, id, speaker, start_ms, end_ms, text, confidence)."""
    start = F.round(F.col("offset_s") * 1000).cast("long")
    speaker = F.coalesce(F.when(F.trim("speaker") != "", F.col("speaker")), "speaker_role", F.lit("a participant"))
    return utterances.select("meeting_id", segment_id(F.col("idx")).alias("id"), speaker.alias("speaker"), start.alias("start_ms"), (start + F.round(F.coalesce("duration_s", F.lit(0.0)) * 1000).cast("long")).alias("end_ms"), "text", confidence(F.col("confidence")).alias("confidence"))


def render(segs: DataFrame) -> DataFrame:
    """(meeting_id, transcript): one `[S001] Speaker: text  (heard poorly)` line a segment."""
    line = F.concat(F.lit("["), "id", F.lit("] "), "speaker", F.lit(": "), "text", F.when(F.col("confidence") < LOW, "  (heard poorly)").otherwise(""))
    return segs.groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct("start_ms", "id", line.alias("line")))).alias("x")).select("meeting_id", F.array_join(F.transform("x", lambda s: s["line"]), "\n").alias("transcript"))


def cited_text(cites: DataFrame, segs: DataFrame) -> DataFrame:
    """cites (key, meeting_id, source array) -> (key, cited): texts of known ids in citing order, joined by spaces."""
    each = cites.select("key", "meeting_id", F.posexplode("source").alias("i", "id")).join(segs.select("meeting_id", "id", "text"), ["meeting_id", "id"])
    joined = each.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("i", "text"))).alias("x")).select("key", F.array_join(F.transform("x", lambda s: s["text"]), " ").alias("cited"))
    return cites.select("key").join(joined, "key", "left").select("key", F.coalesce("cited", F.lit("")).alias("cited"))


def rests_on_low_confidence(cites: DataFrame, segs: DataFrame) -> DataFrame:
    """(key, low): every cited known segment was heard poorly, and there is one (GT-15)."""
    each = cites.select("key", "meeting_id", F.explode("source").alias("id")).join(segs.select("meeting_id", "id", "confidence"), ["meeting_id", "id"])
    low = each.groupBy("key").agg(F.bool_and(F.col("confidence") < LOW).alias("low"))
    return cites.select("key").join(low, "key", "left").select("key", F.coalesce("low", F.lit(False)).alias("low"))


def meeting_type(mode: Column, override: Column) -> Column:
    """A valid override, else what the mode implies, else team."""
    derived = F.coalesce(F.create_map(*(F.lit(x) for kv in TYPE_OF_MODE.items() for x in kv))[mode], F.lit("team"))
    return F.when(override.isin(*TYPES), override).otherwise(derived)


def fingerprint(segs: DataFrame) -> DataFrame:
    """(meeting_id, fingerprint) of the ordered transcript (DML-17)."""
    row = F.concat_ws("|", "id", "speaker", "text")
    return segs.groupBy("meeting_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_ms", "id", row.alias("row")))), lambda s: s["row"]), "\n"), 256).alias("fingerprint"))


def from_payloads(payloads: DataFrame) -> DataFrame:
    """(meeting_id, idx, speaker, text, offset_s, duration_s, confidence) of JSON payloads in any of four
    shapes: a list, or an object with `utterances`, `segments` or `results`. Any other raises (SRC-9)."""
    item = "array<struct<idx:int,speaker:string,speaker_role:string,text:string,offset_s:double,start:double,duration_s:double,confidence:double>>"
    whole = F.struct(*(F.from_json("payload", f"struct<{k}:{item}>")[k].alias(k) for k in ("utterances", "segments", "results")))
    items = F.coalesce(F.when(F.trim("payload").startswith("["), F.from_json("payload", item)), whole["utterances"], whole["segments"], whole["results"])
    rows = payloads.select("meeting_id", F.posexplode(F.coalesce(items, F.raise_error(F.lit("unknown transcript payload")).cast(item))).alias("i", "u"))
    return rows.select("meeting_id", F.coalesce("u.idx", "i").alias("idx"), "u.speaker", "u.speaker_role", "u.text", F.coalesce("u.offset_s", "u.start").alias("offset_s"), "u.duration_s", "u.confidence")
