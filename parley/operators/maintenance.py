"""Derived tables kept in step: upserts, cascades, versions, suggestions, ledgers (DML-*, WN-8, STR-11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_wins(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Insert-or-ignore: rows of old, and of new those whose key is not there (DML-2)."""
    return old.unionByName(new.dropDuplicates(key).join(old.select(*key), key, "left_anti").select(old.columns))


def last_wins(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Insert-or-replace."""
    return old.join(new.select(*key).distinct(), key, "left_anti").select(old.columns).unionByName(new.select(old.columns))


def canonical_labels(nodes: DataFrame, entities: DataFrame) -> DataFrame:
    """A live entity's label overrides the label a node got first (DML-3)."""
    e = entities.where("merged_into is null").select("id", F.col("label").alias("_label"))
    return nodes.join(e, "id", "left").select("id", F.coalesce("_label", "label").alias("label"), "kind")


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes at no end of any edge (JN-8)."""
    return nodes.join(edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct(), "id", "left_anti")


def reprocess(table: DataFrame, fresh: DataFrame, meeting_id: str) -> DataFrame:
    """Delete a meeting's derived rows and put the rebuilt ones (DML-1); idempotent."""
    return table.where(~F.col("meeting_id").eqNullSafe(meeting_id)).unionByName(fresh.select(table.columns))


#: Fixed value: tables that lose a meeting's rows with it.
CASCADE = ["utterances", "claims", "edges", "chunks", "entity_mentions", "runs", "meeting_projects"]


def delete_meeting(tables: dict[str, DataFrame], meeting_id: str) -> dict[str, DataFrame]:
    """All tables without a meeting: its rows, its corrections by scope, its node (DML-4)."""
    out = {k: (v.where(~F.col("meeting_id").eqNullSafe(meeting_id)) if k in CASCADE else v) for k, v in tables.items()}
    if "meetings" in out:
        out["meetings"] = out["meetings"].where(F.col("id") != meeting_id)
    if "nodes" in out:
        out["nodes"] = out["nodes"].where(F.col("id") != meeting_id)
    if "corrections" in out:
        out["corrections"] = out["corrections"].where(F.col("scope") != f"meeting:{meeting_id}")
    return out


def migrate_edges(edges: DataFrame) -> DataFrame:
    """Edges under the wider key: a null meeting becomes the empty one, then one row a key (DML-5)."""
    return edges.withColumn("meeting_id", F.coalesce("meeting_id", F.lit(""))).dropDuplicates(["src", "dst", "kind", "meeting_id"])


def snapshot(versions: DataFrame, current: DataFrame, key: str, created_at: int, throttle_ms: int = 300_000) -> DataFrame:
    """Append the current row before a write, unless the key got a version within the throttle (DML-6, WN-8)."""
    last = versions.groupBy(key).agg(F.max("created_at").alias("_last"))
    due = current.join(last, key, "left").where(F.col("_last").isNull() | (F.lit(created_at) - F.col("_last") >= throttle_ms))
    return versions.unionByName(due.select(*[c for c in versions.columns if c != "created_at"], F.lit(created_at).cast("long").alias("created_at")))


def throttled(times: DataFrame, key: str, gap_ms: int) -> DataFrame:
    """Rows whose predecessor of the same key is gap_ms back or more, or that have none (WN-8)."""
    by = Window.partitionBy(key).orderBy("created_at", "id")
    before = F.lag("created_at").over(by)
    return times.withColumn("_b", before).where(F.col("_b").isNull() | (F.col("created_at") - F.col("_b") >= gap_ms)).drop("_b")


def sticky(generated: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """A generated document, but the edited text where a human has edited it (DML-7)."""
    s = stored.select(key, F.col("edited").alias("_e"), F.col("edited_markdown").alias("_m"))
    return generated.join(s, key, "left").select(key, F.when(F.col("_e") == 1, F.coalesce("_m", "markdown")).otherwise(F.col("markdown")).alias("markdown"), F.coalesce("_e", F.lit(0)).alias("edited"))


def suggestions(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Pending suggestions of a meeting are replaced by fresh ones; accepted and dismissed ones stay and
    keep their project from being suggested again (DML-8). Columns meeting_id, project_id, confidence, status."""
    settled = stored.where("status <> 'pending'")
    touched = fresh.select("meeting_id").distinct()
    pending = stored.where("status = 'pending'").join(touched, "meeting_id", "left_anti").select(stored.columns)
    new = fresh.where("confidence >= 0.5").join(settled.select("meeting_id", "project_id"), ["meeting_id", "project_id"], "left_anti").withColumn("status", F.lit("pending"))
    return settled.unionByName(pending).unionByName(new.select(stored.columns))


def fork(conversations: DataFrame, messages: DataFrame, source: int, target: int) -> tuple[DataFrame, DataFrame]:
    """A copy of a conversation and its messages under a new id (DML-9)."""
    c = conversations.where(F.col("id") == source).withColumn("id", F.lit(target).cast("long"))
    m = messages.where(F.col("conversation_id") == source).withColumn("conversation_id", F.lit(target).cast("long"))
    return conversations.unionByName(c), messages.unionByName(m)


def ledger(begins: DataFrame, finishes: DataFrame) -> DataFrame:
    """Runs from begin and finish events: the last finish of a run counts; a run without one crashed (DML-16, STR-11)."""
    f = finishes.groupBy("id").agg(F.max_by("outcome", "ended_at").alias("outcome"), F.max("ended_at").alias("ended_at"))
    return begins.join(f, "id", "left").select("id", "kind", "started_at", "ended_at", F.coalesce("outcome", F.lit("failed")).alias("outcome"), F.when(F.col("ended_at").isNull(), "crash").alias("failure"))


def cached(statements: DataFrame, prints: DataFrame) -> DataFrame:
    """(meeting_id, json): stored statements whose fingerprint is that of the transcript now; null ones are
    to be computed anew (DML-17)."""
    s = statements.select("meeting_id", "fingerprint", "json")
    return prints.join(s, ["meeting_id", "fingerprint"], "left").select("meeting_id", "fingerprint", "json")


def stale(documents: DataFrame, prints: DataFrame) -> DataFrame:
    """Documents with stale: unedited, and made from another transcript, or empty (DML-18)."""
    p = prints.select("meeting_id", F.col("fingerprint").alias("_now"))
    changed = (F.col("edited") == 0) & (~F.col("fingerprint").eqNullSafe(F.col("_now")) | (F.coalesce(F.trim("markdown"), F.lit("")) == ""))
    return documents.join(p, "meeting_id", "left").withColumn("stale", changed).drop("_now")
