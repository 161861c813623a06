"""Handoff runs: preconditions, parsing, validation, pruning and rendering in one plan (CP-15, HO-16).

What a model wrote comes as a table of documents (doc_id, meeting_id, json); a run that could not ask it,
or whose document held nothing, ends with a failure code instead of a text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.operators import handoffs as H
from parley.operators import segments as SG
from parley.operators.claims import iso_day
from parley.shared import made


def _outcome(documents: DataFrame, handoff: H.Handoff, meta: DataFrame, segs: DataFrame, owners: DataFrame, titles: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, code, markdown, dropped) of documents; meta: doc_id, title, when and code, null where a run may go on.
    titles replace the aliases of meetings in the text."""
    asked = documents.join(meta.where("code is null").select("doc_id"), "doc_id", "left_semi")
    # Rows are read a dozen times, failures and what is left of the rows thrice: each is made once, and plans stay small.
    # Their files are small, as equal texts are packed, and their rows many: by the files' size Spark would broadcast them.
    rows = made(H.items(asked, handoff)).hint("merge")
    failures = made(H.validate(rows, segs, owners, {s.kind for s in handoff.sections})).hint("merge")
    kept = H.prune(rows, failures, handoff).hint("merge")
    low = SG.rests_on_low_confidence(kept.select(F.concat("doc_id", F.lit("|"), "path").alias("key"), "meeting_id", "source"), segs)
    kept = made(kept.join(low, F.concat("doc_id", F.lit("|"), "path") == F.col("key")).drop("key").withColumnRenamed("low", "low_confidence")).hint("merge")
    named = F.col("owner")
    for alias, title in (titles or {}).items():
        named = F.when((F.col("kind") == "themes") & (F.col("owner") == alias), title).otherwise(named)
    kept = kept.withColumn("owner", named)
    empty = H.empty_documents(asked, rows).withColumn("nothing", F.lit("schema-invalid"))
    gone = rows.groupBy("doc_id").agg(F.count("*").alias("n")).join(kept.groupBy("doc_id").agg(F.count("*").alias("left")), "doc_id", "left")
    replaced = failures.join(rows.where("kind = 'prose'").select("doc_id", "path"), ["doc_id", "path"], "left_semi").select("doc_id", "path").distinct().groupBy("doc_id").agg(F.count("*").alias("prose"))
    counts = gone.join(replaced, "doc_id", "left").select("doc_id", (F.col("n") - F.coalesce("left", F.lit(0)) + F.coalesce("prose", F.lit(0))).alias("dropped"))
    text = H.render(kept, handoff, meta.join(asked.select("doc_id"), "doc_id", "left_semi").select("doc_id", "title", "when"))
    out = meta.select("doc_id", "code").join(empty, "doc_id", "left").join(text, "doc_id", "left").join(counts, "doc_id", "left")
    code = F.coalesce("code", "nothing")
    return out.select("doc_id", code.alias("code"), F.when(code.isNull(), F.col("markdown")).alias("markdown"), F.when(code.isNull(), F.coalesce("dropped", F.lit(0))).cast("long").alias("dropped"))


def run_handoff(documents: DataFrame, handoff: H.Handoff, meetings: DataFrame, utterances: DataFrame, statements: DataFrame, owners: DataFrame) -> DataFrame:
    """(doc_id, code, markdown, dropped) of one kind of document for many meetings. A meeting that is unknown,
    has no transcript, or of whose statements (meeting_id) none was kept ends with the code that says so."""
    if handoff.scope != "meeting":
        raise ValueError(f"{handoff.label} runs across meetings")
    m = meetings.select(F.col("id").alias("meeting_id"), "title", iso_day(F.col("started_at")).alias("when"))
    has = lambda df, name: df.select("meeting_id").distinct().withColumn(name, F.lit(True))
    known = documents.select("doc_id", "meeting_id").join(m, "meeting_id", "left").join(has(utterances, "spoken"), "meeting_id", "left").join(has(statements, "stated"), "meeting_id", "left")
    code = F.when(F.col("title").isNull(), "not-found").when(F.col("spoken").isNull(), "no-transcript").when(F.col("stated").isNull(), "no-statements")
    return _outcome(documents, handoff, known.select("doc_id", "title", "when", code.alias("code")), SG.segments(utterances), owners)


def run_cross_handoff(document: str, handoff: H.Handoff, meeting_ids: list[str], meetings: DataFrame, utterances: DataFrame, as_of: str) -> DataFrame:
    """(doc_id, code, markdown, dropped) of one document over several meetings (a list that somebody chose, or the
    newest customer meetings): citations carry the meeting's alias M1, M2, ... in the order of the list; meetings
    without a transcript get none, and two with one are needed. Titles replace aliases in the text."""
    spark = meetings.sparkSession
    spoken = utterances.where(F.col("meeting_id").isin(meeting_ids)).select("meeting_id").distinct()
    there = {r["meeting_id"]: r["title"] for r in spoken.join(meetings.select(F.col("id").alias("meeting_id"), "title"), "meeting_id").collect()}
    order = [m for m in meeting_ids if m in there]
    code = None if len(order) >= 2 else "no-transcript"
    docs = spark.createDataFrame([("cross", "cross", document)], "doc_id string, meeting_id string, json string")
    meta = spark.createDataFrame([("cross", "", as_of, code)], "doc_id string, title string, when string, code string")
    segs = SG.segments(utterances.where(F.col("meeting_id").isin(order)))
    alias = H.alias_segments(segs, order or [""]).select(F.lit("cross").alias("meeting_id"), "id", "text")
    alias = alias.join(segs.select(F.concat(F.lit("M"), F.array_position(F.array(*map(F.lit, order or [""])), F.col("meeting_id")), F.lit(":"), "id").alias("id"), "confidence"), "id")
    owners = spark.createDataFrame([("cross", [])], "meeting_id string, names array<string>")
    return _outcome(docs, handoff, meta, alias, owners, {f"M{i}": there[m] for i, m in enumerate(order, 1)})
