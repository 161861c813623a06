"""The read-only tools of the query API, as frames: receipted evidence, no bulk transcripts."""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.operators import claims as C
from parley.operators import entities as E
from parley.operators import graph as G
from parley.operators import resolution as RS
from parley.operators import retrieve as R
from parley.operators import segments as SG
from parley.operators.chunks import claim_label
from parley.plans.ask import primer
from parley.sources.adapters import AS_OF_MS, World

#: The most rows a caller may ask for.
MOST_SNIPPETS, MOST_CLAIMS, MOST_MEETINGS, MOST_SEGMENTS = 20, 200, 100, 10


def _within(n: int, most: int) -> int:
    if not 1 <= n <= most:
        raise ValueError(f"a limit must lie in 1..{most}, not {n}")
    return n


def _since_ms(day: str | None) -> int | None:
    """The first millisecond of an ISO date in UTC."""
    if day is None:
        return None
    return int(datetime.datetime.fromisoformat(day).replace(tzinfo=datetime.timezone.utc).timestamp() * 1000)


@dataclass
class Entity:
    entity: DataFrame
    aliases: DataFrame
    mentions: DataFrame
    related: DataFrame


@dataclass
class Meeting:
    meeting: DataFrame
    claims: DataFrame
    threaded_to: DataFrame


class Tools:
    def __init__(self, world: World, as_of_ms: int = AS_OF_MS) -> None:
        self.w, self.as_of_ms = world, as_of_ms

    def _related(self) -> DataFrame:
        return G.related_edges(self.w.entities.where("kind = 'topic' and merged_into is null"))

    def brain_info(self) -> DataFrame:
        """One row: four counts and the newest meeting."""
        w = self.w
        return C.brain_counts(w.meetings, w.entities, w.claims, w.chunks)

    def search_brain(self, query: str, top_n: int = 8) -> DataFrame:
        """Receipted snippets of lexical and graph search."""
        w = self.w
        found = R.retrieve(w.index.chunks(), w.meetings, query, self.as_of_ms, (w.entities, self._related(), w.entity_mentions), _within(top_n, MOST_SNIPPETS), w.index)
        return found.withColumn("date", C.iso_day(F.col("started_at")))

    def list_claims(self, kind: str | None = None, open_only: bool = False, since: str | None = None, limit: int = 50) -> DataFrame:
        """Claims of a kind with their receipts, newest meeting first."""
        return C.list_claims(self.w.claims, self.w.meetings, kind, open_only, _since_ms(since), _within(limit, MOST_CLAIMS))

    def get_entity(self, name_or_id: str) -> Entity:
        """An entity by id or name; all four frames are empty where nothing matches."""
        w = self.w
        entity = C.lookup(w.entities, name_or_id)
        id_ = F.broadcast(entity.select(F.col("id").alias("entity_id")))  # one row at most
        aliases = w.entities.join(id_, F.col("id") == F.col("entity_id"), "left_semi").select(F.col("norm").alias("alias"))
        m = w.meetings.select(F.col("id").alias("meeting_id"), "title", "started_at")
        mentions = w.entity_mentions.where("gate = 'passed'").join(id_, "entity_id", "left_semi").join(m, "meeting_id").select("surface", "quote", "offset_s", "meeting_id", "title", "started_at")
        far = self._related().join(id_, F.col("src") == F.col("entity_id"), "left_semi").select(F.col("dst").alias("id"))
        return Entity(entity.select("id", "kind", "label"), aliases, mentions.orderBy(F.desc("started_at"), "meeting_id", "offset_s", "surface"), far.join(w.nodes.select("id", "label"), "id"))

    def get_meeting(self, meeting_id: str) -> Meeting:
        """A meeting, its passed claims with receipts, and the meetings that share its topics or people."""
        w = self.w
        meeting = w.meetings.where(F.col("id") == meeting_id).withColumn("date", C.iso_day(F.col("started_at")))
        claims = w.claims.where((F.col("meeting_id") == meeting_id) & (F.col("gate") == "passed")).select("id", "kind", claim_label("body", "quote").alias("label"), F.get_json_object("body", "$.owner").alias("owner"), "quote", "offset_s", (F.col("done") != 0).alias("done"))
        return Meeting(meeting, claims, G.backlinks(w.edges, self._related(), w.nodes, w.meetings, meeting_id))

    def list_meetings(self, limit: int = 20, since: str | None = None) -> DataFrame:
        w = self.w
        return C.list_meetings(w.meetings, w.claims, w.utterances, _within(limit, MOST_MEETINGS), _since_ms(since))

    def get_evidence(self, meeting_id: str, segment_ids: list[str]) -> DataFrame:
        """(pos, id, text) of cited segments, in the order asked; unknown ids say so."""
        if len(segment_ids) > MOST_SEGMENTS:
            raise ValueError(f"at most {MOST_SEGMENTS} segment ids")
        spark = self.w.spark
        asked = spark.createDataFrame(list(enumerate(segment_ids)), "pos int, id string")
        segs = SG.segments(self.w.utterances.where(F.col("meeting_id") == meeting_id)).select("id", "text")
        return segs.join(F.broadcast(asked), "id", "right").select("pos", "id", F.when(F.coalesce("text", F.lit("")) == "", F.lit("(unknown segment id)")).otherwise(F.col("text")).alias("text"))

    def refresh_brain_md(self) -> str:
        return primer(self.w)


def rederive(w: World, meeting_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, aliases, mentions) of one meeting, anew from its utterances and passed claims after its
    lines were edited or its speakers told apart (CP-17). The caller replaces the meeting's old mentions
    by them, so that stale ones go."""
    lines = w.utterances.where(F.col("meeting_id") == meeting_id)
    c = w.claims.where((F.col("meeting_id") == meeting_id) & (F.col("gate") == "passed"))
    told = lambda kind, value: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("id", value.alias("v"))))), lambda s: s["v"])
    text = F.coalesce(F.get_json_object("body", "$.text"), F.col("quote"), F.lit(""))
    task = F.coalesce(F.get_json_object("body", "$.task"), F.lit(""))
    none = F.array().cast("array<struct<fact:string,type:string,transcript_quote:string>>")
    recap = c.groupBy("meeting_id").agg(told("decision", text).alias("key_decisions"), F.transform(told("action_item", task), lambda t: F.struct(t.alias("task"))).alias("action_items"))
    recap = recap.withColumn("coverage_gaps", none)
    cands = E.candidates(lines, recap)
    found = RS.resolve_all(RS.with_proof(cands, lines), w.entities)
    return E.store(E.canonical_reason(found))
