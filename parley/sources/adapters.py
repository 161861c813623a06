"""The engine's logical tables over star-schema Parquet files.

conversations stand for transcripts, orders for claims, part names for topics, lineitem for mentions,
events for the run ledger, nations for projects and suppliers for the people directory."""

from __future__ import annotations

import uuid
from functools import cached_property
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from parley.operators.search_index import StoredIndex

#: "Now" of everything that needs a clock.
AS_OF_MS = 1704067200000 + 200 * 3600000
BASE_MS, HOUR_MS = 1704067200000, 3600000


#: Indexes by application and folder.
_INDEXES: dict[tuple[str, str], StoredIndex] = {}


class World:
    """Logical tables of one directory, built on first use."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    @cached_property
    def conversations(self) -> DataFrame:
        return self.raw("conversations")

    @cached_property
    def n_meetings(self) -> DataFrame:
        return self.conversations.agg((F.max("conv_id") + 1).alias("n_meetings"))

    def _meeting_of(self, df: DataFrame, key: str) -> DataFrame:
        """df with meeting_id = 'm' || key mod the number of meetings; the count is one row."""
        return df.join(F.broadcast(self.n_meetings)).withColumn("meeting_id", F.concat(F.lit("m"), (F.col(key) % F.col("n_meetings")).cast("string")))

    @cached_property
    def meetings(self) -> DataFrame:
        c = F.col("conv_id")
        mode = F.when(c % 4 == 0, "investor").when(c % 4 == 1, "discovery").when(c % 4 == 2, "one_on_one").otherwise("standup")
        rows = self.conversations.groupBy("conv_id").agg(F.max("turn").alias("last"))
        return rows.select(F.concat(F.lit("m"), c.cast("string")).alias("id"), F.concat(F.lit("Meeting "), c.cast("string")).alias("title"), mode.alias("mode"), (F.lit(BASE_MS) + c * HOUR_MS).alias("started_at"), (F.col("last").cast("double") * 6 + 5.5).alias("duration_s"))

    @cached_property
    def utterances(self) -> DataFrame:
        c, turn = F.col("conv_id"), F.col("turn")
        speaker = F.when(F.col("role") == "user", F.concat(F.lit("Person "), (c % 12).cast("string"))).when(F.col("role") == "assistant", F.concat(F.lit("Person "), ((c + 5) % 12).cast("string")))
        return self.conversations.select(
            F.concat(F.lit("m"), c.cast("string")).alias("meeting_id"), turn.alias("idx"), speaker.alias("speaker"),
            F.when(F.col("role") == "assistant", "agent").otherwise("customer").alias("speaker_role"), "text",
            (turn.cast("double") * 6).alias("offset_s"), F.lit(5.5).alias("duration_s"),
            F.when((c * 7 + turn) % 11 == 0, 0.42).otherwise(1.0).alias("confidence"))

    @cached_property
    def claims(self) -> DataFrame:
        k = F.col("o_orderkey")
        kind = F.when(k % 5 == 0, "action_item").when(k % 5 == 1, "decision").when(k % 5 == 2, "risk").when(k % 5 == 3, "moment").otherwise("objection")
        owner = F.when(F.col("o_custkey") % 10 == 0, "null").otherwise(F.concat(F.lit('"Person '), (F.col("o_custkey") % 12).cast("string"), F.lit('"')))
        return self._meeting_of(self.raw("orders"), "o_orderkey").select(
            k.alias("id"), "meeting_id", kind.alias("kind"),
            F.concat(F.lit('{"task":"'), "o_orderpriority", F.lit('","owner":'), owner, F.lit(',"due":null}')).alias("body"),
            F.when(k % 17 == 0, F.concat(F.lit('{"task":"edited '), k.cast("string"), F.lit('","owner":null,"due":"Friday"}'))).alias("edited_body"),
            F.when(k % 3 != 0, (k % 8).cast("double") * 6).alias("offset_s"),
            F.when(k % 3 != 1, F.col("o_orderpriority")).alias("quote"),
            F.when(k % 7 == 0, "blocked").otherwise("passed").alias("gate"),
            F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("done"))

    @cached_property
    def topics(self) -> DataFrame:
        return self.raw("part").select(F.col("p_name").alias("label")).distinct().select(F.concat(F.lit("topic:"), F.replace("label", F.lit(" "), F.lit("-"))).alias("id"), F.lit("topic").alias("kind"), "label", F.col("label").alias("norm"))

    @cached_property
    def entities(self) -> DataFrame:
        """Topics and people; every eighth topic by length of its label is merged away."""
        k = (F.col("conv_id") % 12).cast("string")
        people = self.conversations.select(F.concat(F.lit("person:person-"), k).alias("id"), F.lit("person").alias("kind"), F.concat(F.lit("Person "), k).alias("label"), F.concat(F.lit("person "), k).alias("norm")).distinct()
        both = self.topics.unionByName(people)
        return both.withColumn("merged_into", F.when((F.col("kind") == "topic") & (F.length("label") % 8 == 7), "topic:merged"))

    @cached_property
    def entity_mentions(self) -> DataFrame:
        li = self.raw("lineitem").where("l_linenumber = 1 and l_quantity >= 49").select("l_orderkey", "l_partkey")
        rows = li.join(self.raw("part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
        k = F.col("l_orderkey")
        return self._meeting_of(rows, "l_orderkey").select(
            F.concat(F.lit("topic:"), F.replace("p_name", F.lit(" "), F.lit("-"))).alias("entity_id"), "meeting_id", F.col("p_name").alias("surface"),
            F.when(k % 8 == 0, "blocked").otherwise("passed").alias("gate"), ((k % 8).cast("double") * 6).alias("offset_s"),
            (F.lit(0.5) + (k % 5).cast("double") / 10).alias("score"), F.concat(F.lit("quote "), (k % 8).cast("string")).alias("quote")).distinct()

    @cached_property
    def runs(self) -> DataFrame:
        outcome = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "partial").when(F.col("event_type") == "click", "deadline").otherwise("shipped")
        return self.raw("events").select(
            F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.unix_millis(F.col("ts").cast("timestamp")).alias("started_at"), outcome.alias("outcome"),
            F.concat(F.lit("m"), (F.col("user_id") % 100).cast("string")).alias("meeting_id"), F.col("value").alias("units"),
            F.get_json_object("props", "$.k").cast("bigint").alias("tokens_in"))

    @cached_property
    def projects(self) -> DataFrame:
        return self.raw("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))

    @cached_property
    def meeting_projects(self) -> DataFrame:
        return self.conversations.select(F.concat(F.lit("m"), F.col("conv_id").cast("string")).alias("meeting_id"), (F.col("conv_id") % 25).cast("int").alias("project_id")).distinct()

    @cached_property
    def people(self) -> DataFrame:
        s = self.raw("supplier").select(F.col("s_suppkey").cast("long").alias("id"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 3 != 0, F.concat(F.lit("team "), (F.col("s_suppkey") % 4).cast("string"))).alias("team"))
        c = self.conversations.select((F.lit(1000000) + F.col("conv_id") % 8).cast("long").alias("id"), F.concat(F.lit("Person "), (F.col("conv_id") % 8).cast("string")).alias("name"), F.lit(None).cast("string").alias("team")).distinct()
        return s.unionByName(c)

    @cached_property
    def upcoming(self) -> DataFrame:
        """Customers as calendar entries around AS_OF_MS."""
        k = F.col("c_custkey")
        return self.raw("customer").select(k.alias("id"), F.concat(F.lit("Call "), (k % 40).cast("string")).alias("title"), (F.lit(AS_OF_MS) + (k % 97 - 24) * 1800000).alias("at_ms"), F.when(k % 2 == 0, "manual").otherwise("ics").alias("source"), F.when(k % 3 != 0, (k % 25).cast("int")).alias("project_id"))

    @cached_property
    def chunks(self) -> DataFrame:
        from parley.operators.chunks import windows

        return windows(self.utterances)

    @cached_property
    def index(self) -> StoredIndex:
        """The stored index of the chunks: built at the first question of an application, then kept for all."""
        from parley.operators.search_index import StoredIndex
        from parley.shared import shared_dir

        key = (self.spark.sparkContext.applicationId, self.path)
        if key not in _INDEXES:
            at = f"{shared_dir(self.spark)}/index-{uuid.uuid4().hex}"
            _INDEXES[key] = StoredIndex.create(self.spark, at).update(self.chunks)
        return _INDEXES[key]

    @cached_property
    def edges(self) -> DataFrame:
        from parley.operators.graph import project_graph

        return project_graph(self.entities, self.entity_mentions, self.utterances)[1]

    @cached_property
    def nodes(self) -> DataFrame:
        from parley.operators.graph import project_graph

        return project_graph(self.entities, self.entity_mentions, self.utterances)[0].unionByName(self.meetings.select("id", F.col("title").alias("label"), F.lit("meeting").alias("kind")))


#: The same tables for DuckDB, in the order in which they build on each other.
ORACLE = {
    "n_meetings": "select max(conv_id)+1 n from conversations",
    "meetings": """select 'm'||cast(conv_id as varchar) id, 'Meeting '||cast(conv_id as varchar) title,
  case conv_id % 4 when 0 then 'investor' when 1 then 'discovery' when 2 then 'one_on_one' else 'standup' end as mode,
  1704067200000 + conv_id*3600000 started_at, cast(max(turn) as double)*6+5.5 duration_s from conversations group by conv_id""",
    "utterances": """select 'm'||cast(conv_id as varchar) meeting_id, turn idx,
  case role when 'user' then 'Person '||cast(conv_id % 12 as varchar) when 'assistant' then 'Person '||cast((conv_id+5) % 12 as varchar) end speaker,
  case when role='assistant' then 'agent' else 'customer' end speaker_role, text, cast(turn as double)*6 offset_s, cast(5.5 as double) duration_s,
  case when (conv_id*7+turn) % 11 = 0 then cast(0.42 as double) else cast(1 as double) end confidence from conversations""",
    "claims": """select o_orderkey id, 'm'||cast(o_orderkey % (select n from n_meetings) as varchar) meeting_id,
  case o_orderkey % 5 when 0 then 'action_item' when 1 then 'decision' when 2 then 'risk' when 3 then 'moment' else 'objection' end kind,
  '{"task":"'||o_orderpriority||'","owner":'||case when o_custkey % 10 = 0 then 'null' else '"Person '||cast(o_custkey % 12 as varchar)||'"' end||',"due":null}' body,
  case when o_orderkey % 17 = 0 then '{"task":"edited '||cast(o_orderkey as varchar)||'","owner":null,"due":"Friday"}' end edited_body,
  case when o_orderkey % 3 = 0 then null else cast(o_orderkey % 8 as double)*6 end offset_s,
  case when o_orderkey % 3 = 1 then null else o_orderpriority end quote,
  case when o_orderkey % 7 = 0 then 'blocked' else 'passed' end gate, case when o_orderstatus = 'F' then 1 else 0 end done from orders""",
    "topics": "select distinct 'topic:'||replace(p_name,' ','-') id, 'topic' kind, p_name as label, p_name norm from part",
    "entities": """select id, kind, label, norm, case when kind='topic' and length(label) % 8 = 7 then 'topic:merged' end merged_into from (select * from topics union all
  select distinct 'person:person-'||cast(conv_id % 12 as varchar), 'person', 'Person '||cast(conv_id % 12 as varchar), 'person '||cast(conv_id % 12 as varchar) from conversations)""",
    "entity_mentions": """select distinct 'topic:'||replace(p_name,' ','-') entity_id, 'm'||cast(l_orderkey % (select n from n_meetings) as varchar) meeting_id, p_name surface,
  case when l_orderkey % 8 = 0 then 'blocked' else 'passed' end gate, cast(l_orderkey % 8 as double)*6 offset_s,
  cast(0.5 as double) + cast(l_orderkey % 5 as double)/10 score, 'quote '||cast(l_orderkey % 8 as varchar) as quote
  from lineitem join part on l_partkey=p_partkey where l_linenumber=1 and l_quantity>=49""",
    "runs": """select event_id id, event_type kind, epoch_us(ts)//1000 started_at,
  case event_type when 'error' then 'failed' when 'signup' then 'partial' when 'click' then 'deadline' else 'shipped' end outcome,
  'm'||cast(user_id % 100 as varchar) meeting_id, value units, cast(json_extract_string(props,'$.k') as bigint) tokens_in from events""",
    "projects": "select n_nationkey id, n_name as name from nation",
    "meeting_projects": "select distinct 'm'||cast(conv_id as varchar) meeting_id, cast(conv_id % 25 as int) project_id from conversations",
    "people": """select s_suppkey id, s_name as name, case when s_suppkey % 3 = 0 then null else 'team '||cast(s_suppkey % 4 as varchar) end team from supplier
  union all select distinct 1000000+conv_id % 8, 'Person '||cast(conv_id % 8 as varchar), cast(null as varchar) from conversations""",
    "upcoming": f"""select c_custkey id, 'Call '||cast(c_custkey % 40 as varchar) title, {AS_OF_MS} + (c_custkey % 97 - 24) * 1800000 at_ms,
  case when c_custkey % 2 = 0 then 'manual' else 'ics' end source, case when c_custkey % 3 <> 0 then cast(c_custkey % 25 as int) end project_id from customer""",
    "chunks": """select cast(substr(meeting_id,2) as bigint)*1048576+pos//2 id, meeting_id, pos src_id, start_offset_s, end_offset_s, speakers, text from (
  select meeting_id, pos, n, offset_s start_offset_s,
    max(offset_s+duration_s) over w end_offset_s,
    array_to_string(list_sort(list_distinct(list(speaker) over w)), ', ') speakers,
    left(array_to_string(list(coalesce(speaker, speaker_role)||': '||text) over w, chr(10)), 900) as text
  from (select *, row_number() over (partition by meeting_id order by idx)-1 pos, count(*) over (partition by meeting_id) n from utterances)
  window w as (partition by meeting_id order by pos rows between current row and 2 following))
  where pos % 2 = 0 and (pos = 0 or pos < n-1)""",
    "promoted": "select entity_id from entity_mentions where gate='passed' group by 1 having count(*)>=3",
    "edges": """select distinct src, dst, kind, meeting_id from (
  select meeting_id src, entity_id dst, 'mentions' kind, meeting_id from entity_mentions where gate='passed' and entity_id in (from promoted)
  union all select 'person:'||replace(lower(speaker),' ','-'), meeting_id, 'attended', meeting_id from utterances where speaker is not null)""",
    "nodes": """select e.id, e.label, e.kind from entities e where e.id in (select dst from edges where kind='mentions') or e.id in (select src from edges where kind='attended')
  union all select id, title, 'meeting' from meetings""",
}
#: What each of them reads.
_NEEDS = {"claims": ["n_meetings"], "entities": ["topics"], "entity_mentions": ["n_meetings"], "chunks": ["utterances"], "promoted": ["entity_mentions"], "edges": ["entity_mentions", "promoted", "utterances"], "nodes": ["entities", "edges", "meetings"]}


def oracle(body: str) -> str:
    """body with the definitions of the logical tables it names put before it."""
    import re

    wanted: set[str] = set()

    def need(name: str) -> None:
        if name not in wanted:
            wanted.add(name)
            for other in _NEEDS.get(name, []):
                need(other)

    for name in ORACLE:
        if re.search(rf"\b{name}\b", body):
            need(name)
    defs = [f"{n} as ({ORACLE[n]})" for n in ORACLE if n in wanted]
    body = body.strip()
    if body[:5].lower() == "with ":
        return "with " + ", ".join([*defs, body[5:]])
    return ("with " + ", ".join(defs) + " " if defs else "") + body
