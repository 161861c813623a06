"""The derived graph: nodes, edges, backlinks, neighbourhoods, relatedness (JN-9..21, CP-5, CP-6, AG-14)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.functions import text as T
from parley.operators.similar import candidate_pairs

#: Passed mentions that make a topic a node; the band of similarity that relates topics.
PROMOTE, RELATE_MIN, MERGE_MIN = 3, 0.15, 0.72
#: Seconds of a bucket of the time axis in interval joins.
BUCKET_S = 30


def promoted(mentions: DataFrame) -> DataFrame:
    """Entities with PROMOTE passed mentions or more, whatever they are merged into (AG-11)."""
    return mentions.where("gate = 'passed'").groupBy("entity_id").agg(F.count("*").alias("n")).where(F.col("n") >= PROMOTE).select("entity_id")


def project_graph(entities: DataFrame, mentions: DataFrame, utterances: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): meeting -> topic `mentions`, person -> meeting `attended`; direction matters."""
    m = mentions.where("gate = 'passed'").join(promoted(mentions), "entity_id", "left_semi")
    mentions_e = m.select(F.col("meeting_id").alias("src"), F.col("entity_id").alias("dst"), F.lit("mentions").alias("kind"), "meeting_id")
    person = F.concat(F.lit("person:"), F.replace(F.lower("speaker"), F.lit(" "), F.lit("-")))
    attended = utterances.where("speaker is not null").select(person.alias("src"), F.col("meeting_id").alias("dst"), F.lit("attended").alias("kind"), "meeting_id")
    edges = mentions_e.unionByName(attended).distinct()
    used = edges.where("kind = 'mentions'").select(F.col("dst").alias("id")).union(edges.where("kind = 'attended'").select("src")).distinct()
    return entities.join(used, "id", "left_semi").select("id", "label", "kind"), edges


def relate(topics: DataFrame) -> DataFrame:
    """(a, b, score) for pairs of topics that share a token and whose similarity lies in the band (JN-16)."""
    scored = candidate_pairs(topics, RELATE_MIN).select("a", "b", T.similarity(F.col("la"), F.col("lb")).alias("score"))
    return scored.where((F.col("score") >= RELATE_MIN) & (F.col("score") < MERGE_MIN))


def related_edges(topics: DataFrame) -> DataFrame:
    """Both directions of every related pair, with the empty meeting as a sentinel (CP-6)."""
    r = relate(topics)
    shape = [F.lit("related").alias("kind"), F.lit("").alias("meeting_id")]
    return r.select(F.col("a").alias("src"), F.col("b").alias("dst"), *shape).unionByName(r.select(F.col("b").alias("src"), F.col("a").alias("dst"), *shape))


def backlinks_shared(edges: DataFrame, nodes: DataFrame, meetings: DataFrame, meeting_id: str, side: str) -> DataFrame:
    """Meetings that share an edge end (JN-9 src, JN-10 dst but no meeting node) with a meeting."""
    mine = edges.where(F.col("meeting_id") == meeting_id).select(F.col(side).alias("node"), F.col("meeting_id").alias("own"))
    other = edges.select(F.col(side).alias("node"), F.col("meeting_id").alias("id"))
    met = mine.join(other, "node").where("id <> own").select("node", "id").distinct()
    n = nodes if side == "src" else nodes.where("kind <> 'meeting'")
    return met.join(meetings.select("id", "title"), "id").join(n.select(F.col("id").alias("node"), F.col("label").alias("via")), "node").select("id", "title", "via").distinct()


def backlinks_related(edges: DataFrame, related: DataFrame, nodes: DataFrame, meetings: DataFrame, meeting_id: str) -> DataFrame:
    """Meetings one related hop away: mentions, related, mentions (JN-11)."""
    e1 = edges.where((F.col("meeting_id") == meeting_id) & (F.col("kind") == "mentions")).select(F.col("dst").alias("n1"), F.col("meeting_id").alias("own"))
    hop = related.select(F.col("src").alias("n1"), F.col("dst").alias("n2"))
    e2 = edges.where("kind = 'mentions'").select(F.col("dst").alias("n2"), F.col("meeting_id").alias("id"))
    label = lambda k: nodes.select(F.col("id").alias(k), F.col("label").alias(f"{k}_label"))
    met = e1.join(hop, "n1").join(e2, "n2").where("id <> own").select("id", "n1", "n2").distinct()
    return met.join(meetings.select("id", "title"), "id").join(label("n1"), "n1").join(label("n2"), "n2").select("id", "title", F.concat("n1_label", F.lit(" ~ "), "n2_label").alias("via")).distinct()


def backlinks(edges: DataFrame, related: DataFrame, nodes: DataFrame, meetings: DataFrame, meeting_id: str) -> DataFrame:
    """The three kinds of backlinks, distinct over all (SET-1)."""
    every = edges.unionByName(related)
    a, b = (backlinks_shared(every, nodes, meetings, meeting_id, s) for s in ("src", "dst"))
    return a.unionByName(b).unionByName(backlinks_related(edges, related, nodes, meetings, meeting_id)).distinct()


def neighbours(edges: DataFrame, node: str) -> DataFrame:
    """Undirected neighbours of a node (JN-12): an OR over both ends as a union of two filters."""
    return edges.where(F.col("src") == node).select(F.col("dst").alias("id"), "kind", "meeting_id").union(edges.where(F.col("dst") == node).select("src", "kind", "meeting_id")).distinct()


def nodes_of_meeting(edges: DataFrame, nodes: DataFrame, meeting_id: str) -> DataFrame:
    """Nodes, not meetings, at either end of a meeting's edges (JN-13)."""
    own = edges.where(F.col("meeting_id") == meeting_id)
    ends = own.select(F.col("src").alias("id")).union(own.select("dst")).distinct()
    return nodes.where("kind <> 'meeting'").join(ends, "id", "left_semi")


def co_occurring(edges: DataFrame, node: str) -> DataFrame:
    """Topics in the meetings that mention a topic, by number of these meetings (AG-14)."""
    m = edges.where("kind = 'mentions'")
    here = m.where(F.col("dst") == node).select("meeting_id").distinct()
    return m.join(here, "meeting_id", "left_semi").where(F.col("dst") != node).groupBy("dst").agg(F.count_distinct("meeting_id").alias("n"))


def nearest_chunks(mentions: DataFrame, chunks: DataFrame, key: list[str] | None = None) -> DataFrame:
    """(entity_id, meeting_id, offset_s, chunk_id): the narrowest window around a mention's offset, else,
    and for a mention without an offset, the meeting's first window (JN-14). The time axis is cut into
    buckets of BUCKET_S; a window stands in each that it touches, so the join is on meeting and bucket."""
    key = key or ["entity_id", "meeting_id", "offset_s"]
    c = chunks.select(F.col("id").alias("chunk_id"), "meeting_id", "src_id", "start_offset_s", "end_offset_s")
    first = c.groupBy("meeting_id").agg(F.min_by("chunk_id", "src_id").alias("first_id"))
    bucket = lambda x: F.floor(F.col(x) / BUCKET_S)
    spread = c.where("end_offset_s >= start_offset_s").withColumn("bucket", F.explode(F.sequence(bucket("start_offset_s"), bucket("end_offset_s"))))
    own = mentions.select(*key).distinct()
    hit = own.withColumn("bucket", bucket("offset_s")).join(spread, ["meeting_id", "bucket"]).where((F.col("start_offset_s") <= F.col("offset_s")) & (F.col("end_offset_s") >= F.col("offset_s")))
    best = hit.groupBy(*key).agg(F.min_by("chunk_id", F.struct(F.col("end_offset_s") - F.col("start_offset_s"), "chunk_id")).alias("near_id"))
    best = best.select(*(F.col(k).alias(f"{k}_") for k in key), "near_id")
    # Mentions without an offset meet no window; null-safe equality keeps them.
    same = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in key]
    return own.join(best, same, "left").select(*key, "near_id").join(first, "meeting_id").select(*key, F.coalesce("near_id", "first_id").alias("chunk_id"))
