"""One query for each operator, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.functions import numbers as N
from parley.functions import stem as S
from parley.functions import text as T
from parley.operators import chunks as K
from parley.operators import claims as C
from parley.operators import corrections as X
from parley.operators import entities as E
from parley.operators import gates as Q
from parley.operators import graph as G
from parley.operators import handoffs as H
from parley.operators import maintenance as M
from parley.operators import outline as O
from parley.operators import resolution as RS
from parley.operators import retrieve as R
from parley.operators import runs as U
from parley.operators import segments as SG
from parley.plans import ask as A
from parley.plans import compose as P
from parley.plans import converse as V
from parley.plans import handoff as Y
from parley.plans import tools as B
from parley.shared import shared_dir
from parley.sources import bundle_store as BS
from parley.sources import calendar as I
from parley.sources import files
from parley.sources.adapters import AS_OF_MS, World, oracle
from parley.streaming import ingest as ST
from parley.streaming import live as L

_FOUND: dict[str, tuple[Callable[[World], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        _FOUND[name] = (f, sql)
        return f

    return add


def _add(name: str, f: Callable[[World], DataFrame], sql: str | None = None) -> None:
    _FOUND[name] = (f, sql)


# --- filters and projections -------------------------------------------------------------------
_add("flt_1_gate_kind", lambda w: C.passed(w.claims, "decision").select("id", "meeting_id"), "select id, meeting_id from claims where gate='passed' and kind='decision'")
_add("flt_2_optional_predicates", lambda w: C.list_claims(w.claims, w.meetings, "risk", True, 1704067200000 + 10 * 3600000, limit=None).select("id", "done", "meeting_id"),
     "select c.id, c.done<>0 done, meeting_id from claims c join meetings m on m.id=meeting_id where c.kind='risk' and gate='passed' and done=0 and started_at >= 1704067200000+10*3600000")
_add("flt_3_kind_whitelist", lambda w: C.passed(w.claims, "no such kind").groupBy("kind").agg(F.count("*").alias("n")), "select kind, count(*) n from claims where gate='passed' and kind='action_item' group by 1")
_add("flt_4_tombstones", lambda w: w.entities.where("merged_into is null").select("id", "label"), "select id, label from entities where merged_into is null")
_add("flt_5_alias_substring", lambda w: R.seeds(w.entities, ["red", "person 1"]), "select distinct id from entities where merged_into is null and (contains(norm,'red') or contains(norm,'person 1'))")
_add("flt_6_speaker_prefix", lambda w: w.utterances.where(F.col("speaker").startswith("Person 1")).select("meeting_id", "idx", "speaker"), "select meeting_id, idx, speaker from utterances where starts_with(speaker,'Person 1')")
_WORDS = "list_filter(string_split(trim(regexp_replace(regexp_replace(lower(coalesce({0},'')),'[^a-z0-9\\s]',' ','g'),'\\s+',' ','g')),' '), lambda x: x<>'')"
_POST = f"wc as (select id, {_WORDS.format('text')} wt, {_WORDS.format('speakers')} ws from chunks), post as (select chunk_id, term, dl, sum(w) tf from (select id chunk_id, unnest(wt) term, 10 w, len(wt)+len(ws) dl from wc union all select id, unnest(ws), 2, len(wt)+len(ws) from wc) group by all)"
_plain = lambda w: R.index(w.chunks, stemmed=False)
_matched = lambda w, *terms: R.matches(_plain(w), [*terms]).where("kept").select("chunk_id").distinct()
_add("flt_7_all_terms_prefix", lambda w: _matched(w, "the", "th"), f"with {_POST} select chunk_id from post group by 1 having bool_or(term='the') and bool_or(starts_with(term,'th'))")
_add("flt_7_any_term_fallback", lambda w: _matched(w, "the", "zzzz"), f"with {_POST} select distinct chunk_id from post where term in ('the','zzzz')")
_add("flt_8_sentinel_inequality", lambda w: w.edges.withColumn("meeting_id", F.when(F.col("meeting_id") == "m1", "").otherwise(F.col("meeting_id"))).where(F.col("meeting_id") != "m2").groupBy("kind").agg(F.count("*").alias("n")),
     "select kind, count(*) n from (select kind, case when meeting_id='m1' then '' else meeting_id end meeting_id from edges) where meeting_id<>'m2' group by 1")
_add("flt_9_edited_body", lambda w: C.list_claims(w.claims, w.meetings, "action_item", limit=None, edited=True).select("id", "label", "due"),
     "select id, coalesce(json_extract_string(b,'$.task'),quote,'') as label, json_extract_string(b,'$.due') due from (select *, coalesce(edited_body,body) b from claims where kind='action_item' and gate='passed')")
_add("flt_10_label_pick", lambda w: w.claims.select("id", K.claim_label("body", "quote").alias("label")), "select id, coalesce(json_extract_string(body,'$.task'),json_extract_string(body,'$.text'),quote,'') as label from claims")
_add("flt_11_json_fields", lambda w: w.claims.select("id", F.get_json_object("body", "$.owner").alias("owner"), F.get_json_object("body", "$.due").alias("due")), "select id, json_extract_string(body,'$.owner') as owner, json_extract_string(body,'$.due') due from claims")
_named = lambda w: w.meetings.withColumn("title", F.when(F.col("started_at") % 7 == 0, "Untitled meeting").when(F.col("started_at") % 7 == 1, "Quick capture 9:30").when(F.col("started_at") % 7 == 2, F.concat(F.lit("Budget of "), "title")).when(F.col("started_at") % 7 == 3, "My Untitled meeting").otherwise(F.col("title")))
_NAMED = "(select * replace (case started_at%7 when 0 then 'Untitled meeting' when 1 then 'Quick capture 9:30' when 2 then 'Budget of '||title when 3 then 'My Untitled meeting' else title end as title) from meetings)"
_add("flt_12_default_title", lambda w: _named(w).where(C.default_title(F.col("title"))).select("id", "title"), f"select id, title from {_NAMED} where title='Untitled meeting' or regexp_matches(title,'^Meeting [0-9]') or starts_with(title,'Quick capture ')")
_add("flt_13_short_recordings", lambda w: w.meetings.where(F.col("duration_s") < L.SHORTEST_S).select("id", "duration_s"), "select id, duration_s from meetings where duration_s < 15")
#: Questions that are dealt out over the utterances by their number.
_ASKED = ["list the open action items", "what are the latest agreed next steps", "which decisions are pending", "who talked about pricing", "every risk so far", "tasks until now", "what were the decisions", "show all completed to-dos", "summarise the call"]
_question = lambda w: w.utterances.select("meeting_id", "idx", F.get(F.array(*map(F.lit, _ASKED)), (F.col("idx") % len(_ASKED)).cast("int")).alias("q"))
_QUESTION = "(select meeting_id, idx, (['" + "','".join(_ASKED) + f"'])[idx%{len(_ASKED)}+1] q from utterances)"
_add("flt_14_enumerative_router", lambda w: _question(w).select("meeting_id", "idx", C.is_enumerative(F.col("q")).alias("enumerate"), C.asked_kind(F.col("q")).alias("kind"), C.asked_open(F.col("q")).alias("open_only")),
     f"select meeting_id, idx, regexp_matches(q, '{C.ENUMERATIVE}') enumerate, case when contains(q,'decision') then 'decision' when contains(q,'risk') then 'risk' else 'action_item' end kind, not (contains(q,'decision') or contains(q,'risk') or regexp_matches(q,'all|every|done|completed')) open_only from {_QUESTION}")
_add("flt_15_limit_before_filter", lambda w: C.newest_then_kept(w.meetings, F.col("mode") == "discovery", 40, 8).select("id", "started_at"),
     "select id, started_at from (select * from meetings order by started_at desc, id limit 40) where mode='discovery' order by started_at desc, id limit 8")
_add("flt_16_log_levels", lambda w: w.runs.select("id", F.when(F.col("outcome") == "failed", 40).when(F.col("outcome") == "partial", 30).otherwise(20).alias("level")).where("level >= 30"), "select id, case outcome when 'failed' then 40 else 30 end as level from runs where outcome in ('failed','partial')")
_add("flt_17_runs_for_ui", lambda w: U.for_ui(w.runs), "select id, kind, meeting_id, started_at, outcome, case outcome when 'shipped' then 'Done' when 'partial' then 'Done, with gaps' when 'deadline' then 'Ran out of time' else 'Failed' end as label from runs")
_UPC = f"(at_ms > {AS_OF_MS}-3600000 and (source='manual' or at_ms between {AS_OF_MS}-300000 and {AS_OF_MS}+48*3600000))"
_add("flt_18_upcoming_window", lambda w: C.upcoming(w.upcoming, AS_OF_MS, None), f"select id, title, at_ms, source from (select *, row_number() over (partition by title, at_ms order by case source when 'manual' then 0 else 1 end, id) n from upcoming where {_UPC}) where n=1")

# --- joins -------------------------------------------------------------------------------------
_add("jn_1_claims_meetings", lambda w: w.claims.join(w.meetings.select(F.col("id").alias("meeting_id"), "title"), "meeting_id").select("id", "title"), "select c.id, title from claims c join meetings m on m.id=c.meeting_id")
_add("jn_2_owner_people", lambda w: C.claim_owners(w.claims, w.people), "select c.id, json_extract_string(body,'$.owner') as owner, p.id person_id from claims c left join people p on lower(json_extract_string(body,'$.owner'))=lower(p.name) where c.kind='action_item' and gate='passed'")
_add("jn_3_left_chain", lambda w: C.claim_owners(w.claims, w.people).join(w.people.select(F.col("id").alias("person_id"), "team"), "person_id", "left").join(w.raw("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("document")), "id", "left").select("id", "owner", "team", "document"),
     "select c.id, json_extract_string(body,'$.owner') as owner, p.team, d.p_name as document from claims c left join people p on lower(json_extract_string(body,'$.owner'))=lower(p.name) left join part d on d.p_partkey=c.id where c.kind='action_item' and gate='passed'")
_add("jn_4_upcoming_projects", lambda w: w.upcoming.join(w.projects.select(F.col("id").alias("project_id"), "name"), "project_id", "left").select("id", "title", "name"), "select u.id, title, p.name from upcoming u left join projects p on p.id=u.project_id")
_add("jn_5_exists", lambda w: w.meetings.join(w.utterances.where("confidence < 0.6").select(F.col("meeting_id").alias("id")), "id", "left_semi").select("id"), "select id from meetings m where exists (select 1 from utterances u where u.meeting_id=m.id and confidence<0.6)")
_add("jn_6_unknown_speakers", lambda w: C.unknown_speakers(w.utterances, w.people), "select distinct speaker from utterances u where speaker is not null and not exists (select 1 from people p where lower(p.name)=lower(speaker))")
_add("jn_7_not_in_projects", lambda w: w.projects.join(w.meeting_projects.where("meeting_id in ('m1','m2','m23')").select(F.col("project_id").alias("id")), "id", "left_anti").select("id", "name"), "select id, name from projects where id not in (select project_id from meeting_projects where meeting_id in ('m1','m2','m23'))")
_add("jn_8_orphan_nodes", lambda w: M.orphans(w.entities.select("id", "label", "kind"), w.edges).select("id"), "select id from entities where id not in (select src from edges union select dst from edges)")
_BACK = lambda side, more: f"select distinct m.id, m.title, n.label via from edges e1 join edges e2 on e1.{side}=e2.{side} and e2.meeting_id<>e1.meeting_id join meetings m on m.id=e2.meeting_id join nodes n on n.id=e1.{side} where e1.meeting_id='m23'{more}"
_add("jn_9_backlinks_src", lambda w: G.backlinks_shared(w.edges, w.nodes, w.meetings, "m23", "src"), _BACK("src", ""))
_add("jn_10_backlinks_dst", lambda w: G.backlinks_shared(w.edges, w.nodes, w.meetings, "m23", "dst"), _BACK("dst", " and n.kind<>'meeting'"))
_TOK = "list_filter(string_split(trim(regexp_replace(regexp_replace(lower({0}),'[^a-z0-9\\s]',' ','g'),'\\s+',' ','g')),' '), lambda x: length(x)>=2 and not list_contains(['" + "','".join(T.STOP_ENTITY) + "'], x))"
_TRI = "list_distinct(list_transform(range(1, greatest(length({0})-1, 1)), lambda i: substr({0}, i, 3)))"
_DICE = "case when length({0})<3 or length({1})<3 then 0.0 else 2.0*len(list_intersect(" + _TRI.format("{0}") + "," + _TRI.format("{1}") + "))/(len(" + _TRI.format("{0}") + ")+len(" + _TRI.format("{1}") + ")) end"
_JAC = "case when len(ta)=0 or len(tb)=0 then 0.0 else len(list_intersect(ta,tb))*1.0/(len(list_distinct(ta))+len(list_distinct(tb))-len(list_intersect(ta,tb))) end"
_SIM = "case when len(ta)=0 or len(tb)=0 then 0.0 else least(1.0, cast(0.6 as double)*(" + _JAC + ")+cast(0.4 as double)*(" + _DICE.format("la", "lb") + ")+case when ta[-1]=tb[-1] then cast(0.15 as double) else 0 end) end"
_REL = "topicset as (select id, label, " + _TOK.format("label") + " t from entities where kind='topic' and merged_into is null), rel as (select a, b, score from (select a, b, round(" + _SIM + ",9) score, ta, tb from (select x.id a, y.id b, x.label la, y.label lb, x.t ta, y.t tb from topicset x join topicset y on x.id<y.id where len(list_intersect(x.t,y.t))>0)) where score>=0.15 and score<0.72), relboth as (select a src, b dst from rel union all select b, a from rel)"
_live = lambda w: w.entities.where("kind = 'topic' and merged_into is null")
_add("jn_11_backlinks_related", lambda w: G.backlinks_related(w.edges, G.related_edges(_live(w)), w.nodes, w.meetings, "m23"),
     "with " + _REL + " select distinct m.id, m.title, n1.label||' ~ '||n2.label via from edges e1 join relboth r on r.src=e1.dst join edges e2 on e2.dst=r.dst and e2.kind='mentions' and e2.meeting_id<>e1.meeting_id join meetings m on m.id=e2.meeting_id join nodes n1 on n1.id=e1.dst join nodes n2 on n2.id=r.dst where e1.meeting_id='m23' and e1.kind='mentions'")
_add("jn_12_neighbours", lambda w: G.neighbours(w.edges, "person:person-1"), "select distinct case when src='person:person-1' then dst else src end id, kind, meeting_id from edges where src='person:person-1' or dst='person:person-1'")
_add("jn_13_nodes_of_meeting", lambda w: G.nodes_of_meeting(w.edges, w.nodes, "m23").select("id", "label"), "select distinct n.id, n.label from nodes n join edges e on (e.src=n.id or e.dst=n.id) where e.meeting_id='m23' and n.kind<>'meeting'")
_NEAR = """select distinct m.entity_id, m.meeting_id, m.offset_s, coalesce(
  (select c.id from chunks c where c.meeting_id=m.meeting_id and start_offset_s<=m.offset_s and end_offset_s>=m.offset_s order by end_offset_s-start_offset_s, c.id limit 1),
  (select c.id from chunks c where c.meeting_id=m.meeting_id order by src_id limit 1)) chunk_id from entity_mentions m"""
_add("jn_14_nearest_chunk", lambda w: G.nearest_chunks(w.entity_mentions, w.chunks), _NEAR)
_add("jn_15_offset_tolerance", lambda w: Q.near_offsets(w.claims.where("offset_s is not null"), w.utterances).select("id"), "select id from claims c where offset_s is not null and exists (select 1 from utterances u where u.meeting_id=c.meeting_id and abs(u.offset_s-c.offset_s)<=15)")
_add("jn_16_similar_topics", lambda w: G.relate(_live(w)).select("a", "b", F.round("score", 6).alias("score")), "with " + _REL + " select a, b, round(score,6) score from rel")
_CAND = lambda w: w.raw("part").select(F.lit("topic").alias("kind"), F.concat("p_name", F.lit(" "), F.lower("p_brand")).alias("surface")).distinct()
_CSQL = "cand as (select distinct 'topic' kind, p_name||' '||lower(p_brand) surface from part)"
_add("jn_17_exact_alias", lambda w: E.exact_aliases(w.raw("part").select(F.lit("topic").alias("kind"), F.upper("p_name").alias("surface")).distinct(), w.entities), "select distinct upper(p_name) surface, e.kind, e.id entity_id from part join entities e on e.norm=lower(p_name) and e.kind='topic' where merged_into is null")
_add("jn_18_containment", lambda w: E.contained(_CAND(w), w.entities),
     f"with {_CSQL} select distinct surface, id entity_id from (select surface, e.id, {_TOK.format('surface')} ta, {_TOK.format('e.label')} tb from cand c join entities e on e.kind=c.kind and merged_into is null) where len(ta)>0 and len(tb)>0 and (len(list_filter(ta, lambda x: not list_contains(tb,x)))=0 or len(list_filter(tb, lambda x: not list_contains(ta,x)))=0)")
_add("jn_19_best_lexical", lambda w: E.best_lexical(_CAND(w), w.entities).select("surface", "entity_id", F.round("score", 6).alias("score"), F.round("runner_up", 6).alias("runner_up")),
     f"with {_CSQL}, sc as (select surface, id, round({_SIM},9) score from (select surface, e.id, trim(regexp_replace(regexp_replace(lower(surface),'[^a-z0-9\\s]',' ','g'),'\\s+',' ','g')) la, lower(e.label) lb, {_TOK.format('surface')} ta, {_TOK.format('e.label')} tb from cand c join entities e on e.kind=c.kind and merged_into is null)), rk as (select *, row_number() over (partition by surface order by score desc, id) n from sc) select surface, max(case when n=1 then id end) entity_id, round(max(case when n=1 then score end),6) score, round(coalesce(max(case when n=2 then score end),0),6) runner_up from rk where n<=2 group by 1")
_TERMS = ["red", "person 1"]
_GM = "with " + _REL + ", sd as (select distinct id from entities where merged_into is null and (contains(norm,'red') or contains(norm,'person 1'))), ev as (select id, 1 is_seed from sd union all select distinct dst, 0 from relboth where src in (from sd) and dst not in (from sd)) select distinct entity_id, meeting_id, offset_s, is_seed from entity_mentions m join ev on ev.id=m.entity_id where gate='passed' order by is_seed desc, entity_id, meeting_id, offset_s limit 80"
_add("jn_20_graph_hop", lambda w: R.graph_mentions(w.entities, G.related_edges(_live(w)), w.entity_mentions, _TERMS), _GM)
_add("jn_21_memory_labels", lambda w: w.entity_mentions.where("meeting_id <> 'm23'").join(w.entity_mentions.where("meeting_id = 'm23'").select("entity_id"), "entity_id", "left_semi").join(w.entities.select(F.col("id").alias("entity_id"), "label"), "entity_id").select("label").distinct().orderBy("label").limit(8),
     "select distinct e.label from entity_mentions m join entities e on e.id=m.entity_id where m.meeting_id<>'m23' and m.entity_id in (select entity_id from entity_mentions where meeting_id='m23') order by 1 limit 8")
_mic = lambda w: w.utterances.where("speaker_role = 'agent'")
_call = lambda w: w.utterances.where("speaker_role = 'customer'").withColumn("offset_s", F.col("offset_s") + 3)
_W3 = "list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower({0}),'[^a-z0-9\\s]',' ','g'),'\\s+',' ','g')),' '), lambda x: length(x)>2))"
_OV = "case when len({0})=0 or len({1})=0 then 0.0 else len(list_intersect({0},{1}))*1.0/least(len({0}),len({1})) end"
_add("jn_22_bleed", lambda w: L.without_bleed(_mic(w), _call(w)).select("meeting_id", "idx"),
     f"with u as (select *, {_W3.format('text')} ws from utterances) select meeting_id, idx from u a where speaker_role='agent' and not exists (select 1 from u b where b.speaker_role='customer' and b.meeting_id=a.meeting_id and abs(a.offset_s-(b.offset_s+3))<4 and {_OV.format('a.ws','b.ws')}>=0.5)")
_frames = lambda w: w.utterances.select("meeting_id", F.concat("meeting_id", F.lit("-"), "idx").alias("utterance_id"), F.when(F.col("speaker_role") == "agent", 0).otherwise(1).alias("channel"), "offset_s", "text", F.lit(True).alias("final"), F.col("idx").alias("seq"))
_add("jn_23_echo", lambda w: L.echoes(_frames(w)),
     f"with u as (select *, {_W3.format('text')} ws, len(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(text),'[^a-z0-9\\s]','','g'),'\\s+',' ','g')),' '), lambda x: x<>'')) nw from utterances) select distinct a.meeting_id, a.meeting_id||'-'||cast(a.idx as varchar) utterance_id from u a join u b on a.meeting_id=b.meeting_id and a.speaker_role='agent' and b.speaker_role='customer' and a.nw>=4 and b.offset_s<=a.offset_s and a.offset_s-b.offset_s<=20 and {_OV.format('a.ws','b.ws')}>=0.6")
_cites = lambda w: w.claims.select(F.col("id").alias("key"), "meeting_id", F.array(SG.segment_id((F.col("id") % 9).cast("int")), SG.segment_id(((F.col("id") + 3) % 5).cast("int"))).alias("source"))
_SEG = "segs as (select meeting_id, 'S'||lpad(cast(idx+1 as varchar),3,'0') id, coalesce(speaker,speaker_role) speaker, cast(offset_s*1000 as bigint) start_ms, text, confidence from utterances)"
_CITE = "cites as (select id as key, meeting_id, 'S'||lpad(cast(id%9+1 as varchar),3,'0') s1, 'S'||lpad(cast((id+3)%5+1 as varchar),3,'0') s2 from claims)"
_add("jn_24_sources_exist", lambda w: Q.source_failures(_cites(w).select("meeting_id", F.col("key").cast("string").alias("path"), "source"), SG.segments(w.utterances)).select("path", "rule", "id"),
     f"with {_SEG}, {_CITE}, e as (select cast(key as varchar) path, meeting_id, unnest([s1,s2]) id from cites) select path, 'source-exists' as rule, id from e where not exists (select 1 from segs where segs.meeting_id=e.meeting_id and segs.id=e.id)")
_add("jn_25_entailment_verdicts", lambda w: Q.entailment_failures(w.claims.select(F.col("id").alias("ordinal"), F.concat(F.lit("p"), "id").alias("path")), w.raw("orders").select(F.col("o_orderkey").alias("i"), (F.col("o_orderstatus") != "F").alias("supported"), F.col("o_orderpriority").alias("why"))),
     "select 'p'||cast(o_orderkey as varchar) path, 'entailment-unsupported' as rule, o_orderpriority detail from orders where o_orderstatus='F'")
_add("jn_26_chunks_by_id", lambda w: w.chunks.where(F.col("id").isin(1 * K.SPAN, 5 * K.SPAN + 1, 9 * K.SPAN)).join(w.meetings.select(F.col("id").alias("meeting_id"), "title"), "meeting_id").select("id", "title", "text"), "select c.id, title, text from chunks c join meetings m on m.id=c.meeting_id where c.id in (1048576, 5*1048576+1, 9*1048576)")
_add("jn_27_project_scope", lambda w: C.enumerate_claims(w.claims, w.meetings, "decision", True, w.meeting_projects.where("project_id in (1, 6)")),
     "select c.id, meeting_id, title, started_at, json_extract_string(body,'$.task') as label, json_extract_string(body,'$.task')||coalesce(' — '||json_extract_string(body,'$.owner'),'') as text, coalesce(quote,'') quote, coalesce(offset_s,0) offset_s from claims c join meetings m on m.id=meeting_id where c.kind='decision' and gate='passed' and done=0 and meeting_id in (select meeting_id from meeting_projects where project_id in (1,6))")

# --- aggregations ------------------------------------------------------------------------------
_add("ag_1_brain_counts", lambda w: C.brain_counts(w.meetings, w.entities, w.claims, w.chunks), "select (select count(*) from meetings) meetings, (select max(started_at) from meetings) newest_meeting, (select count(*) from entities where merged_into is null) entities, (select count(*) from claims where gate='passed') claims, (select count(*) from chunks) chunks")
_ML = """select m.id, m.title, m.mode, m.started_at, m.duration_s, (select count(*) from claims c where c.meeting_id=m.id and c.kind='decision' and gate='passed') decisions,
 (select count(*) from claims c where c.meeting_id=m.id and c.kind='action_item' and gate='passed') action_items,
 (select string_agg(distinct speaker, ',' order by speaker) from utterances u where u.meeting_id=m.id and speaker is not null) participants from meetings m"""
_add("ag_2_counts_per_meeting", lambda w: C.list_meetings(w.meetings, w.claims, w.utterances, None).drop("participants"), f"select * exclude (participants) from ({_ML})")
_add("ag_3_distinct_speakers", lambda w: C.list_meetings(w.meetings, w.claims, w.utterances, None).select("id", "participants"), f"select id, participants from ({_ML})")
_add("ag_4_dashboard", lambda w: w.claims.agg(F.count_if((F.col("kind") == "action_item") & (F.col("gate") == "passed") & (F.col("done") == 0) & (F.col("meeting_id") != "")).alias("open_actions"), F.count_if(F.col("gate") == "blocked").alias("blocked"), F.count("*").alias("n")),
     "select count(*) filter (kind='action_item' and gate='passed' and done=0 and meeting_id<>'') open_actions, count(*) filter (gate='blocked') blocked, count(*) n from claims")
_add("ag_5_per_project", lambda w: C.per_project(w.claims, w.meeting_projects, w.projects, "action_item"), "select p.id, p.name, count(c.id) n from projects p left join meeting_projects mp on mp.project_id=p.id left join claims c on c.meeting_id=mp.meeting_id and c.kind='action_item' and gate='passed' group by all")
_TT = lambda n: f"select s.entity_id, e.label, s.meetings, s.mentions, s.last_seen, q.quote from (select entity_id, count(distinct meeting_id) meetings, count(*) mentions, max(started_at) last_seen from entity_mentions m join meetings t on t.id=m.meeting_id where gate='passed' group by 1) s join entities e on e.id=s.entity_id and merged_into is null and e.kind='topic' left join (select entity_id, quote from (select *, row_number() over (partition by entity_id order by score desc, meeting_id, quote) r from entity_mentions) where r=1) q on q.entity_id=s.entity_id order by s.meetings desc, s.mentions desc, s.entity_id limit {n}"
_add("ag_6_top_topics", lambda w: C.top_topics(w.entity_mentions, w.entities, w.meetings, "topic", 20), _TT(20))
_person_mentions = lambda w: w.utterances.where("speaker is not null").select(T.slug(F.lit("person"), F.col("speaker")).alias("entity_id"), "meeting_id", F.when(F.col("idx") % 5 == 0, "blocked").otherwise("passed").alias("gate"), F.col("confidence").alias("score"), F.col("text").alias("quote"))
_add("ag_7_top_people", lambda w: C.top_topics(_person_mentions(w), w.entities, w.meetings, "person", 20).select("entity_id", "label", "meetings", "mentions", "last_seen"),
     "with pm as (select 'person:'||replace(lower(speaker),' ','-') entity_id, meeting_id from utterances where speaker is not null and idx%5<>0) select entity_id, e.label, count(distinct meeting_id) meetings, count(*) mentions, max(started_at) last_seen from pm join entities e on e.id=entity_id and e.kind='person' and merged_into is null join meetings m on m.id=meeting_id group by 1,2 order by 3 desc, 4 desc, 1 limit 20")
_add("ag_8_project_topics", lambda w: w.entity_mentions.where("gate = 'passed'").join(w.meeting_projects, "meeting_id").groupBy("project_id", "entity_id").agg(F.count_distinct("meeting_id").alias("meetings")), "select project_id, entity_id, count(distinct m.meeting_id) meetings from entity_mentions m join meeting_projects p on p.meeting_id=m.meeting_id where gate='passed' group by all")
_add("ag_9_suggested_topics", lambda w: w.entity_mentions.where("gate = 'passed'").groupBy("entity_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "entity_id").limit(4), "select entity_id, count(*) n from entity_mentions where gate='passed' group by 1 order by 2 desc, 1 limit 4")
_add("ag_10_spanning_topics", lambda w: w.entity_mentions.groupBy("entity_id").agg(F.count_distinct("meeting_id").alias("n")).where("n >= 2"), "select entity_id, count(distinct meeting_id) n from entity_mentions group by 1 having n>=2")
_add("ag_11_promotion", lambda w: G.promoted(w.entity_mentions), "select entity_id from promoted")
_add("ag_12_speaker_stats", lambda w: C.speaker_stats(w.utterances), "select meeting_id, speaker, count(*) as lines, min(offset_s) first_at, arg_min(text, idx) sample from utterances where speaker is not null group by 1,2")
_add("ag_13_strongest_topic", lambda w: C.strongest_topic(w.entity_mentions), "select meeting_id, entity_id from (select meeting_id, entity_id, row_number() over (partition by meeting_id order by count(*) desc, round(sum(score),6) desc, entity_id) r from entity_mentions where gate='passed' group by 1,2) where r=1")
_add("ag_14_co_occurrence", lambda w: (lambda e: e.alias("a").join(e.alias("b"), "meeting_id").where(F.col("a.dst") < F.col("b.dst")).groupBy(F.col("a.dst").alias("a"), F.col("b.dst").alias("b")).agg(F.count_distinct("meeting_id").alias("n")))(w.edges.where("kind = 'mentions'")), "select a.dst a, b.dst b, count(distinct a.meeting_id) n from edges a join edges b on a.meeting_id=b.meeting_id and a.dst<b.dst where a.kind='mentions' and b.kind='mentions' group by 1,2")
_STOPL = "['" + "','".join(T.STOP_TOPIC) + "']"
_NG = f"""with ws as (select meeting_id, idx, list_filter(list_transform(regexp_split_to_array(text,'\\s+'), lambda x: regexp_replace(x,'[^A-Za-z0-9-]','','g')), lambda x: x<>'') as w from utterances),
 g as (select meeting_id, idx, unnest(list_concat(case when len(w)>=2 then list_transform(range(1,len(w)), lambda i: w[i:i+1]) else [] end, case when len(w)>=3 then list_transform(range(1,len(w)-1), lambda i: w[i:i+2]) else [] end)) gram from ws),
 ok as (select meeting_id, trim(regexp_replace(regexp_replace(lower(array_to_string(gram,' ')),'[^a-z0-9\\s]',' ','g'),'\\s+',' ','g')) as key from g where len(list_filter(gram, lambda x: length(x)<3))=0 and len(list_distinct(list_transform(gram, lambda x: lower(x))))>1 and not list_contains({_STOPL}, lower(gram[1])) and not list_contains({_STOPL}, lower(gram[-1])))
 select meeting_id, key, count(*) n from ok group by 1,2 having n>=2"""
_add("ag_15_repeated_ngrams", lambda w: E.repeated_ngrams(w.utterances).select("meeting_id", "key", "n"), _NG)


def _recaps(w: World) -> DataFrame:
    """Made from claims: decisions and actions of all passed claims of each meeting."""
    c = w.claims.where("gate = 'passed'").withColumn("task", F.concat(F.lit("Review the "), F.lower(F.regexp_replace(F.get_json_object("body", "$.task"), "[^A-Za-z ]", "")), F.lit(" budget by Friday")))
    pick = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("id", "task")))), lambda s: s["task"])
    g = c.groupBy("meeting_id").agg(pick("decision").alias("key_decisions"), pick("action_item").alias("acts"))
    gaps = F.array(F.struct(F.concat(F.lit("Fact "), "meeting_id").alias("fact"), F.lit("name").alias("type"), F.lit(None).cast("string").alias("transcript_quote")))
    return g.select("meeting_id", gaps.alias("coverage_gaps"), "key_decisions", F.transform("acts", lambda a: F.struct(a.alias("task"))).alias("action_items"))


_add("ag_16_candidate_fold", lambda w: E.candidates(w.utterances, _recaps(w)).select("meeting_id", "kind", "surface", "source", "weight"))
_add("ag_17_usage_since", lambda w: U.usage_since(w.runs, 10), "select count(*) calls, coalesce(sum(tokens_in),0)::bigint tokens_in from (select * from runs order by id desc limit 200) where id>10")
_steps = lambda w: w.runs.select("id", F.array(F.struct(F.when(F.col("id") % 2 == 0, "core:recap").otherwise("notes").alias("name"), F.when(F.col("outcome") == "failed", "failed").when(F.col("outcome") == "partial", "blocked").otherwise("ok").alias("status")), F.struct(F.lit("index").alias("name"), F.when(F.col("id") % 11 == 0, "failed").otherwise("ok").alias("status"))).alias("steps"), "units", "outcome")
_add("ag_18_decide_exit", lambda w: _steps(w).select("id", U.decide_exit(F.col("steps"), F.when(F.col("outcome") == "deadline", "x")).alias("exit")), "select id, case when outcome='deadline' then 'deadline' when outcome='failed' and id%2=0 then 'failed' when outcome in ('failed','partial') or id%11=0 then 'partial' else 'shipped' end as exit from runs")
_scored_leaves = lambda w: w.utterances.select(F.col("meeting_id").alias("doc_id"), F.col("idx").cast("string").alias("path"), F.when(F.col("idx") % 3 == 0, "unrelated pricing pilot").otherwise(F.col("text")).alias("text"), F.col("text").alias("cited"))
_bad_leaves = lambda w: w.utterances.where("idx % 4 = 1").select(F.col("meeting_id").alias("doc_id"), F.col("idx").cast("string").alias("path"))
_of_meeting = lambda w, *texts: w.meetings.select(F.col("id").alias("doc_id"), F.explode(F.array(*map(F.lit, texts))).alias("text"))
_add("ag_19_eval_scores", lambda w: P.scores(_scored_leaves(w), _bad_leaves(w), _of_meeting(w, "Roadmap"), _of_meeting(w, "unrelated pricing pilot", "no such thing anywhere"), _of_meeting(w, "roadmap", "pilot", "zebra")).select("doc_id", "leaves", *(F.round(c, 9).alias(c) for c in ("strict", "lexical", "statement_recall", "theme_recall"))),
     "select meeting_id doc_id, count(*) leaves, round(avg(case when idx%4=1 then 0.0 else 1.0 end),9) strict, round(avg(case when idx%3=0 then 0.0 else 1.0 end),9) lexical, 0.5::double statement_recall, round(2/3.0::double,9) theme_recall from utterances group by 1")
_add("ag_20_collated_frequency", lambda w: H.collated(w.claims.select(F.col("kind").alias("theme"), F.col("id").cast("string").alias("path")), w.claims.where("gate = 'blocked'").select(F.col("id").cast("string").alias("path"))), "select kind theme, count(*) frequency from claims where gate<>'blocked' group by 1")
_add("ag_21_match_rate", lambda w: w.utterances.groupBy("meeting_id").agg(F.round(F.count("speaker") / F.count("*"), 9).alias("rate"), F.count("*").alias("total")), "select meeting_id, round(count(speaker)*1.0/count(*),9) rate, count(*) total from utterances group by 1")
_add("ag_22_transcript_end", lambda w: w.utterances.groupBy("meeting_id").agg(F.max(F.col("offset_s") + F.col("duration_s")).alias("end_s")), "select meeting_id, max(offset_s+duration_s) end_s from utterances group by 1")
_add("ag_23_enumeration_summary", lambda w: C.enumeration_summary(C.enumerate_claims(w.claims, w.meetings, "decision", True), "decision"), "select n, m, cast(n as varchar)||' decision'||case when n=1 then '' else 's' end||' across '||cast(m as varchar)||' meeting'||case when m=1 then '' else 's' end||', newest first.' summary from (select count(*) n, count(distinct meeting_id) m from claims where kind='decision' and gate='passed' and done=0)")
_add("ag_24_owner_sets", lambda w: w.utterances.where("speaker is not null").groupBy("meeting_id").agg(F.array_join(F.array_sort(F.array_union(F.collect_set("speaker"), F.array(F.lit("Unassigned")))), ",").alias("owners")), "select meeting_id, array_to_string(list_sort(list_append(list(distinct speaker),'Unassigned')),',') owners from utterances where speaker is not null group by 1")
_messages = lambda w: w.raw("conversations").select(F.col("conv_id").alias("conversation_id"), F.when(F.col("role") == "assistant", F.to_json(F.struct(F.lit("extractive").alias("mode"), F.array(F.col("conv_id") * 100 + F.floor(F.col("turn") / 2), F.col("turn").cast("long") % 3).alias("chunk_ids")))).alias("payload"))
_add("ag_25_conversation_corpus", lambda w: V.corpus_ids(_messages(w), 7), "select distinct unnest([conv_id*100+turn//2, turn%3]) chunk_id from conversations where conv_id=7 and role='assistant'")
# --- windows, sorts, sets ----------------------------------------------------------------------
_add("wn_1_sliding_chunks", lambda w: w.chunks, "select id, meeting_id, src_id, start_offset_s, end_offset_s, speakers, text from chunks")
_scored = lambda w: w.chunks.select(F.col("id").alias("chunk_id"), "meeting_id", (F.length("text") % 100 / 100).alias("score"))
_add("wn_2_per_meeting_cap", lambda w: R.capped(_scored(w), 3, 12), "select chunk_id, meeting_id, score from (select *, row_number() over (partition by meeting_id order by score desc, chunk_id) n from (select id chunk_id, meeting_id, (length(text)%100)/100.0::double score from chunks)) where n<=3 order by score desc, chunk_id limit 12")
_add("wn_3_arm_rank", lambda w: R.ranked(_scored(w), 60, F.desc("score")), "select id chunk_id, cast(row_number() over (order by length(text)%100 desc, id)-1 as integer) as rank from chunks order by 2 limit 60")
_add("wn_4_next_gap", lambda w: w.utterances.select("meeting_id", "idx", (F.lead("offset_s").over(Window.partitionBy("meeting_id").orderBy("idx")) - F.col("offset_s")).alias("gap")), "select meeting_id, idx, lead(offset_s) over (partition by meeting_id order by idx)-offset_s gap from utterances")
_add("wn_5_latest_run", lambda w: C.latest_run(w.runs, "purchase", 50), "select meeting_id, arg_min(id, n) id, arg_min(outcome, n) outcome from (select *, row_number() over (partition by meeting_id order by started_at desc, id desc) n from runs) where n<=50 and kind='purchase' group by 1")
_add("wn_6_last_messages", lambda w: w.utterances.withColumn("n", F.row_number().over(Window.partitionBy("meeting_id").orderBy(F.desc("idx")))).where("n <= 8").select("meeting_id", "idx"), "select meeting_id, idx from (select *, row_number() over (partition by meeting_id order by idx desc) n from utterances) where n<=8")
_add("wn_7_dense_reindex", lambda w: L.reindexed(_mic(w).unionByName(_call(w))).select("meeting_id", "offset_s", "text", "idx"), "select meeting_id, offset_s, text, cast(row_number() over (partition by meeting_id order by offset_s, speaker nulls first, text)-1 as integer) idx from (select meeting_id, offset_s, text, speaker from utterances where speaker_role='agent' union all select meeting_id, offset_s+3, text, speaker from utterances where speaker_role='customer')")
_add("wn_8_snapshot_throttle", lambda w: M.throttled(w.runs.select("id", "meeting_id", F.col("started_at").alias("created_at")), "meeting_id", 300000).select("id"), "select id from (select id, started_at-lag(started_at) over (partition by meeting_id order by started_at, id) g from runs) where g is null or g>=300000")
_add("wn_9_segment_ids", lambda w: w.utterances.select("meeting_id", "idx", SG.segment_id(F.col("idx")).alias("id")), "select meeting_id, idx, 'S'||case when idx+1<1000 then lpad(cast(idx+1 as varchar),3,'0') else cast(idx+1 as varchar) end id from utterances")
_add("wn_10_manual_first", lambda w: C.upcoming(w.upcoming, AS_OF_MS), f"select id, title, at_ms, source from (select *, row_number() over (partition by title, at_ms order by case source when 'manual' then 0 else 1 end, id) n from upcoming where {_UPC}) where n=1 order by at_ms, id limit 6")
_add("tk_1_newest", lambda w: w.meetings.orderBy(F.desc("started_at"), "id").limit(20).select("id", "started_at"), "select id, started_at from meetings order by started_at desc, id limit 20")
_add("tk_2_open_first", lambda w: C.todo(w.claims, w.meetings, 30), "select c.id, meeting_id, done, started_at from claims c join meetings m on m.id=meeting_id where c.kind='action_item' and gate='passed' order by done, started_at desc, c.id limit 30")
_BM = _POST + """, st as (select count(*) n, avg(len(wt)+len(ws)) avgdl from wc),
 hits as (select chunk_id, dl, 0 q, tf from post where term='{0}' union all select chunk_id, dl, 1, sum(tf) from post where starts_with(term,'{1}') group by 1,2),
 strict as (select chunk_id from hits group by 1 having count(*)=2), dfs as (select q, count(*) df from hits group by 1),
 bm as (select chunk_id, sum(greatest(1e-6::double, ln((n-df+0.5::double)/(df+0.5::double)))*tf*2.2::double/(tf+1.2::double*(0.25::double+0.75::double*dl/avgdl))) score from hits join dfs using(q), st where chunk_id in (from strict) group by 1)"""
#: A pair of a rare and a frequent term: the frequency of either is counted over all chunks.
_RARE, _OFTEN = "11", "an"
_add("sn_6_bm25", lambda w: R.bm25(_plain(w), [_RARE, _OFTEN]).select("chunk_id", F.round("score", 9).alias("score")), f"with {_BM.format(_RARE, _OFTEN)} select chunk_id, round(score,9) score from bm")
_add("tk_3_bm25_limit", lambda w: R.lexical_arm(_plain(w), [_RARE, _OFTEN]).where("rank < 20"), f"with {_BM.format(_RARE, _OFTEN)} select chunk_id, cast(row_number() over (order by round(score,12) desc, chunk_id)-1 as integer) as rank from bm order by 2 limit 20")
_add("tk_4_seed_first", lambda w: R.graph_mentions(w.entities, G.related_edges(_live(w)), w.entity_mentions, ["red"]).groupBy("is_seed").agg(F.count("*").alias("n")), "select is_seed, count(*) n from (" + _GM.replace(" or contains(norm,'person 1')", "") + ") group by 1")
_add("tk_5_shortest_alias", lambda w: w.entities.where("merged_into is null and contains(norm, 'e')").groupBy("kind").agg(F.min_by("id", F.struct(F.length("norm"), "id")).alias("id")), "select kind, id from (select *, row_number() over (partition by kind order by length(norm), id) r from entities where merged_into is null and contains(norm,'e')) where r=1")
_add("tk_6_three_rungs", lambda w: C.lookup(w.entities, "person 1").unionByName(C.lookup(w.entities, "person:person-2")).unionByName(C.lookup(w.entities, "erson 3")),
     "select id, kind, label, r rung from (select id, kind, label, 2 r from entities where norm='person 1' union all select id, kind, label, 1 from entities where id='person:person-2' union all (select id, kind, label, 3 from entities where contains(norm,'erson 3') order by length(norm), id limit 1))")
_add("tk_7_caseless_sort", lambda w: w.people.orderBy(F.lower("name"), "id").limit(25).select("id", "name"), "select id, name from people order by lower(name), id limit 25")
_add("tk_8_truncations", lambda w: w.claims.groupBy("meeting_id").agg(F.size(F.slice(F.array_sort(F.collect_list("id")), 1, 12)).alias("n")), "select meeting_id, cast(least(count(*),12) as integer) n from claims group by 1")
_add("set_1_backlinks", lambda w: G.backlinks(w.edges, G.related_edges(_live(w)), w.nodes, w.meetings, "m23"),
     "with " + _REL + ", ed as (select src, dst, kind, meeting_id from edges union all select src, dst, 'related', '' from relboth) select distinct m.id, m.title, n.label via from ed e1 join ed e2 on e1.src=e2.src and e2.meeting_id<>e1.meeting_id join meetings m on m.id=e2.meeting_id join nodes n on n.id=e1.src where e1.meeting_id='m23' union select m.id, m.title, n.label from ed e1 join ed e2 on e1.dst=e2.dst and e2.meeting_id<>e1.meeting_id join meetings m on m.id=e2.meeting_id join nodes n on n.id=e1.dst where e1.meeting_id='m23' and n.kind<>'meeting' union select m.id, m.title, n1.label||' ~ '||n2.label from ed e1 join ed r on r.src=e1.dst and r.kind='related' join ed e2 on e2.dst=r.dst and e2.kind='mentions' and e2.meeting_id<>e1.meeting_id join meetings m on m.id=e2.meeting_id join nodes n1 on n1.id=e1.dst join nodes n2 on n2.id=r.dst where e1.meeting_id='m23' and e1.kind='mentions'")
_add("set_2_fresh_wins", lambda w: M.last_wins(w.chunks.where("src_id % 3 <> 0").select("id", F.lit("prior").alias("from")), w.chunks.where("src_id % 3 <> 1").select("id", F.lit("fresh").alias("from")), ["id"]), "select id, case when src_id%3=1 then 'prior' else 'fresh' end \"from\" from chunks")
_add("set_3_seeds_then_hop", lambda w: R.graph_mentions(w.entities, G.related_edges(_live(w)), w.entity_mentions, _TERMS).select("entity_id", "is_seed").distinct(), f"select distinct entity_id, is_seed from ({_GM})")
_add("set_4_owner_union", lambda w: w.people.select("name").union(w.utterances.where("speaker is not null").select("speaker")).union(w.spark.sql("select 'Unassigned'")).distinct(), "select name from people union select speaker from utterances where speaker is not null union select 'Unassigned'")

# --- maintenance -------------------------------------------------------------------------------
_add("dml_1_reprocess", lambda w: M.reprocess(w.utterances.select("meeting_id", "idx"), w.utterances.where("meeting_id = 'm1' and idx < 2").select("meeting_id", "idx"), "m1"), "select meeting_id, idx from utterances where meeting_id<>'m1' or idx<2")
_add("dml_2_upserts", lambda w: M.first_wins(w.projects, w.raw("region").select(F.col("r_regionkey").cast("int").alias("id"), F.col("r_name").alias("name")).union(w.spark.sql("select 99, 'new'")), ["id"]), "select id, name from projects union all select 99, 'new'")
_add("dml_3_canonical_labels", lambda w: M.canonical_labels(w.nodes, w.entities.withColumn("label", F.upper("label"))), "select n.id, coalesce(upper(e.label), n.label) as label, n.kind from nodes n left join entities e on e.id=n.id and merged_into is null")
_add("dml_4_cascade", lambda w: M.delete_meeting({"claims": w.claims, "edges": w.edges}, "m2")["claims"].groupBy("meeting_id").agg(F.count("*").alias("n")), "select meeting_id, count(*) n from claims where meeting_id<>'m2' group by 1")
_add("dml_5_edge_migration", lambda w: M.migrate_edges(w.edges.withColumn("meeting_id", F.when(F.col("kind") == "attended", F.lit(None)).otherwise(F.col("meeting_id")))).select("src", "dst", "kind", "meeting_id"), "select distinct src, dst, kind, case when kind='attended' then '' else meeting_id end meeting_id from edges")
_add("dml_6_versions", lambda w: M.snapshot(w.meetings.where("id in ('m1','m2')").select("id", "title", F.lit(1000).cast("long").alias("created_at")), w.meetings.select("id", "title"), "id", 200000, 300000).groupBy("created_at").agg(F.count("*").alias("n")), "select created_at, count(*) n from (select 1000::bigint created_at from meetings where id in ('m1','m2') union all select 200000::bigint from meetings where id not in ('m1','m2')) group by 1")
_add("dml_7_sticky_edits", lambda w: M.sticky(w.meetings.select("id", F.col("title").alias("markdown")), w.meetings.where("started_at % 7 = 0").select("id", F.lit(1).alias("edited"), F.lit("mine").alias("edited_markdown")), "id"), "select id, case when started_at%7=0 then 'mine' else title end as markdown, case when started_at%7=0 then 1 else 0 end edited from meetings")
_sugg = lambda w: w.meeting_projects.select("meeting_id", "project_id", F.lit(0.9).alias("confidence"), F.when(F.col("project_id") % 3 == 0, "accepted").otherwise("pending").alias("status"))
_add("dml_8_suggestions", lambda w: M.suggestions(_sugg(w), w.meeting_projects.where("project_id % 2 = 0").select("meeting_id", "project_id", F.lit(0.7).alias("confidence"))), "select meeting_id, project_id, cast(case when project_id%2=0 and project_id%3<>0 then 0.7 else 0.9 end as double) confidence, case when project_id%3=0 then 'accepted' else 'pending' end status from meeting_projects")
_add("dml_9_fork", lambda w: M.fork(w.raw("conversations").select(F.col("conv_id").alias("id")).distinct(), w.raw("conversations").select(F.col("conv_id").alias("conversation_id"), "turn", "text"), 1, 999999)[1].where("conversation_id = 999999"), "select 999999 conversation_id, turn, text from conversations where conv_id=1")
_add("dml_10_rederive", lambda w: G.project_graph(w.entities, w.entity_mentions, w.utterances.withColumn("speaker", F.when(F.col("speaker") == "Person 1", "Person 2").otherwise(F.col("speaker"))))[1].where("kind = 'attended'").select("src", "dst"), "select distinct 'person:'||replace(lower(case when speaker='Person 1' then 'Person 2' else speaker end),' ','-') src, meeting_id dst from utterances where speaker is not null")
_fields = lambda w: X.meeting_fields("m23", w.utterances, w.claims, w.meetings, G.nodes_of_meeting(w.edges, w.nodes, "m23"))


def _applied(w: World) -> DataFrame:
    f = _fields(w)
    return X.apply(f, X.occurrences(f, "Meeting", "Session"), ["meeting_field:title#title#Meeting"], "Session")


_FL = "fl as (select 'utterance' target, cast(idx as varchar) as key, 'text' field, text from utterances where meeting_id='m23' union all select 'claim', cast(id as varchar), 'body', coalesce(edited_body,body) from claims where meeting_id='m23' union all select 'claim', cast(id as varchar), 'quote', quote from claims where meeting_id='m23' and quote is not null union all select 'meeting_field','title','title',title from meetings where id='m23' union all select 'node', n.id, 'label', n.label from nodes n where kind<>'meeting' and id in (select src from edges where meeting_id='m23' union select dst from edges where meeting_id='m23'))"
_OCC = """oc as (select *, strpos(lower(text), lower(t)) p from (select *, unnest(['Person','Meeting']) t from fl) where regexp_matches(text, '(^|[^A-Za-z0-9_])'||t||'($|[^A-Za-z0-9_])', 'i'))
  select target||':'||key||'#'||field||'#'||t ref, target, key, field, t as token, 'exact' as match,
   case when p-40>1 then '…' else '' end||substr(text, greatest(1,p-40), least(length(text),p+length(t)-1+40)-greatest(1,p-40)+1)||case when p+length(t)-1+40<length(text) then '…' else '' end snippet from oc"""
_found = lambda w: X.occurrences(_fields(w), "Person", "Ann").where("match = 'exact'").unionByName(X.occurrences(_fields(w), "Meeting", "Session").where("match = 'exact'"))
_add("dml_11_find_occurrences", lambda w: _found(w), f"with {_FL}, " + _OCC)
_add("dml_12_apply_correction", lambda w: _applied(w).select("target", "key", "field", "text"), f"with {_FL} select target, key, field, case when target='meeting_field' then replace(text,'Meeting','Session') else text end as text from fl")
_add("dml_13_undo_correction", lambda w: X.undo(_applied(w)), f"with {_FL} select target, key, field, text from fl")
_add("dml_14_node_merge", lambda w: X.merge_node(w.nodes, w.edges, "person:person-1", "Person 2", "person")[1], "select distinct case when src='person:person-1' then 'person:person-2' else src end src, case when dst='person:person-1' then 'person:person-2' else dst end dst, kind, meeting_id from edges")
_add("dml_15_dictionary", lambda w: X.apply_dictionary(w.utterances, [("Person 1", "Ann", "global"), ("Ann", "Anna", "meeting:m1")]).select("meeting_id", "idx", "speaker"), "select meeting_id, idx, case when speaker='Person 1' then case when meeting_id='m1' then 'Anna' else 'Ann' end else speaker end speaker from utterances")
_add("dml_16_run_ledger", lambda w: M.ledger(w.runs.select("id", "kind", "started_at"), w.runs.where("id % 10 <> 0").select("id", "outcome", (F.col("started_at") + 5).alias("ended_at"))), "select id, kind, started_at, case when id%10<>0 then started_at+5 end ended_at, case when id%10<>0 then outcome else 'failed' end outcome, case when id%10=0 then 'crash' end failure from runs")
_prints = lambda w: SG.fingerprint(SG.segments(w.utterances))
_add("dml_17_statement_cache", lambda w: M.cached(_prints(w).select("meeting_id", F.when(F.col("meeting_id") == "m1", "old").otherwise(F.col("fingerprint")).alias("fingerprint"), F.lit("[]").alias("json")), _prints(w)).select("meeting_id", F.col("json").isNull().alias("stale")), "select distinct meeting_id, meeting_id='m1' stale from utterances")
_add("dml_18_staleness", lambda w: M.stale(_prints(w).select("meeting_id", F.when(F.col("meeting_id") == "m1", "old").otherwise(F.col("fingerprint")).alias("fingerprint"), F.when(F.col("meeting_id") == "m2", 1).otherwise(0).alias("edited"), F.when(F.col("meeting_id") == "m23", "").otherwise("x").alias("markdown")), _prints(w)).select("meeting_id", "stale"), "select distinct meeting_id, meeting_id in ('m1','m23') stale from utterances")

# --- text functions ----------------------------------------------------------------------------
_NORM = "trim(regexp_replace(regexp_replace(lower({0}),'[^a-z0-9\\s]',' ','g'),'\\s+',' ','g'))"
_u = lambda w, **c: w.utterances.select("meeting_id", "idx", *(v.alias(k) for k, v in c.items()))
_us = lambda expr: f"select meeting_id, idx, {expr} from utterances"
_add("sc_1_normalize", lambda w: _u(w, norm=T.normalize(F.col("text"))), _us(_NORM.format("text") + " norm"))
_add("sc_2_slug", lambda w: w.raw("part").select("p_partkey", T.slug(F.lit("topic"), F.concat("p_brand", F.lit(" / "), "p_name", F.lit("!"))).alias("slug")), "select p_partkey, 'topic:'||regexp_replace(regexp_replace(lower(p_brand||' / '||p_name||'!'),'[^a-z0-9]+','-','g'),'^-|-$','','g') slug from part")
_STOPQ = "['" + "','".join(T.STOP_QUERY) + "']"
_add("sc_3_terms", lambda w: _u(w, terms=F.array_join(T.query_terms(F.col("text")), " ")), _us(f"array_to_string(list_filter(string_split({_NORM.format('text')},' '), lambda x: length(x)>=2 and not list_contains({_STOPQ},x)),' ') terms"))
_names_of = lambda w, i, a: w.topics.select(F.col("label").alias(a), F.explode(F.array_distinct(F.concat(T.entity_tokens(F.col("label")), T.trigrams(F.col("label"))))).alias("key"))
_pairs = lambda w, **c: _names_of(w, "i", "a").join(_names_of(w, "j", "b"), "key").where("a < b").select("a", "b").distinct().select("a", "b", *(v.alias(k) for k, v in c.items()))
_PSQL = lambda e: f"select la a, lb b, {e} from (select x.label la, y.label lb, {_TOK.format('x.label')} ta, {_TOK.format('y.label')} tb from topics x join topics y on x.label<y.label) where len(list_intersect(ta,tb))>0 or len(list_intersect({_TRI.format('la')},{_TRI.format('lb')}))>0"
_add("sc_4_jaccard", lambda w: _pairs(w, v=F.round(T.jaccard(T.entity_tokens(F.col("a")), T.entity_tokens(F.col("b"))), 6)), _PSQL(f"round({_JAC},6) v"))
_add("sc_5_dice", lambda w: _pairs(w, v=F.round(T.dice(F.col("a"), F.col("b")), 6)), _PSQL(f"round({_DICE.format('la', 'lb')},6) v"))
_add("sc_6_similarity", lambda w: _pairs(w, v=F.round(T.similarity(F.col("a"), F.col("b")), 6)), _PSQL(f"round({_SIM},6) v"))
_add("sc_7_anchors", lambda w: _pairs(w, v=F.array_join(T.anchors(F.col("a"), F.col("b")), ",")), _PSQL("array_to_string(list_filter(ta, lambda x: list_contains(tb,x)),',') v"))
_add("sc_8_edit_distance", lambda w: _pairs(w, v=T.edit_near(F.substring("a", 1, 6), F.substring("b", 1, 6))), _PSQL("levenshtein(lower(la[1:6]),lower(lb[1:6])) <= case when length(lb[1:6])<=5 then 1 else 2 end v"))
_add("sc_9_whole_word", lambda w: _u(w, hit=F.col("text").rlike(T.whole_word("the"))), _us("regexp_matches(text,'(?i)(^|[^A-Za-z0-9_])the($|[^A-Za-z0-9_])') hit"))
_add("sc_10_snippet", lambda w: _u(w, s=T.snippet(F.col("text"), F.lit("the"))),
     _us("case when strpos(lower(text),'the')=0 then left(text,80) else case when strpos(lower(text),'the')-40>1 then '…' else '' end||substr(text, greatest(1,strpos(lower(text),'the')-40), least(length(text),strpos(lower(text),'the')+42)-greatest(1,strpos(lower(text),'the')-40)+1)||case when strpos(lower(text),'the')+42<length(text) then '…' else '' end end s"))
_HALF = "left(text, 40)"
_add("sc_11_contains_loosely", lambda w: _u(w, v=T.contains_loosely(T.normalize(F.col("text")), T.normalize(F.concat(F.lit("zzzz "), F.substring("text", 1, 40))))),
     f"select meeting_id, idx, n<>'' and (contains(h,n) or (len(ws)>0 and len(list_filter(ws, lambda x: contains(h,x)))*1.0/greatest(len(ws),1)>=0.7)) v from (select *, list_filter(string_split(n,' '), lambda x: length(x)>3) ws from (select meeting_id, idx, {_NORM.format('text')} h, {_NORM.format(chr(39)+'zzzz '+chr(39)+'||'+_HALF)} n from utterances))")
_next = lambda w: w.utterances.withColumn("other", F.coalesce(F.lead("text").over(Window.partitionBy("meeting_id").orderBy("idx")), F.lit("")))
_add("sc_12_word_overlap", lambda w: _next(w).select("meeting_id", "idx", F.round(T.word_overlap(F.col("text"), F.col("other")), 6).alias("v")), f"select meeting_id, idx, round({_OV.format('a','b')},6) v from (select meeting_id, idx, {_W3.format('text')} a, {_W3.format('o')} b from (select *, coalesce(lead(text) over (partition by meeting_id order by idx),'') o from utterances))")
_add("sc_13_echo_norm", lambda w: _u(w, v=T.echo_norm(F.col("text"))), _us("trim(regexp_replace(regexp_replace(lower(text),'[^a-z0-9\\s]','','g'),'\\s+',' ','g')) v"))
_heard = lambda w: w.utterances.withColumn("heard", F.collect_list("text").over(Window.partitionBy("meeting_id").orderBy("idx").rowsBetween(-1, -1)))
_add("sc_14_trim_echo", lambda w: _heard(w).select("meeting_id", "idx", L.trimmed(F.concat(F.lit("well "), F.coalesce(F.get("heard", F.lit(0)), F.lit("")), F.lit(" indeed")), F.col("heard")).alias("v")))
_said = lambda w: w.raw("part").select("p_partkey", "p_name", F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("Review the "), "p_name", F.lit(" by Friday."))).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("Let's follow up on our "), "p_name", F.lit(" "), F.lower("p_brand"))).when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("the wide plan for "), "p_name", F.lit("!"))).otherwise(F.lit("of the")).alias("t"))
_add("sc_15_noun_phrase", lambda w: _said(w).select("p_partkey", T.noun_phrase(F.col("t")).alias("v")),
     "select p_partkey, case p_partkey%4 when 0 then p_name when 1 then p_name||' '||lower(p_brand) when 2 then array_to_string((string_split('wide plan for '||p_name,' '))[-4:],' ') end v from part")
_SIX = ["25,000", "12:30", "ab", "one two three four five six", "Q3", "7 days off"]
_topic = lambda w: w.raw("part").select("p_partkey", F.coalesce(F.get(F.array(*map(F.lit, _SIX)), (F.col("p_partkey") % 8).cast("int")), F.col("p_name")).alias("t"))
_add("sc_16_plausible_topic", lambda w: _topic(w).select("p_partkey", T.plausible_topic(F.col("t")).alias("v")),
     "with t as (select p_partkey, coalesce((['" + "','".join(_SIX) + "'])[p_partkey%8+1], p_name) t from part), n as (select *, len(regexp_extract_all(t,'[A-Za-z]')) l, len(regexp_extract_all(t,'[0-9]')) d from t) select p_partkey, not regexp_full_match(t,'[0-9]{1,2}:[0-9]{2}(:[0-9]{2})?') and l>=3 and d<=l and len(string_split(t,' '))<=5 v from n")
_STOPG = "['" + "','".join(T.STOP_GROUNDING) + "']"
_FLAT = "trim(regexp_replace(translate(lower(text),'“”’','\"\"'''),'\\s+',' ','g'))"
_add("sc_17_content_words", lambda w: _u(w, v=F.array_join(T.content_words(F.col("text")), " ")), _us(f"array_to_string(list_filter(regexp_split_to_array(regexp_replace({_FLAT},'[^a-z0-9\\s%$.-]',' ','g'),'\\s+'), lambda x: length(x)>2 and not list_contains({_STOPG},x)),' ') v"))
_add("sc_18_quoted_spans", lambda w: _u(w, v=F.array_join(T.quoted_spans(F.concat(F.lit('He said "'), F.split("text", " ")[0], F.lit('  x." and “it is”'))), "|")), _us("regexp_replace(trim(regexp_replace(string_split(text,' ')[1]||'  x.','[\\s.,;:!?—-]+$','')),'^[\\s.,;:!?—-]+','')||'|it is' v"))
_add("sc_19_flat", lambda w: _u(w, v=T.flat(F.col("text"))), _us(_FLAT + " v"))
_add("sc_20_duration_estimate", lambda w: _next(w).select("meeting_id", "idx", F.round(T.duration_estimate(F.col("text"), F.lit(6.0)), 6).alias("v")), _us("round(least(greatest(1.5, len(list_filter(regexp_split_to_array(trim(text),'\\s+'), lambda x: x<>''))*0.38::double), 6.0::double),6) v"))
_PEOPLE = ["Anna", "Hannah", "Bo", "Mary Ann", "lowercase"]
_who = lambda k: F.get(F.array(*map(F.lit, _PEOPLE)), (k % len(_PEOPLE)).cast("int"))
_WHO = "(['" + "','".join(_PEOPLE) + "'])[{0}%5+1]"
_add("sc_21_word_swap", lambda w: w.raw("part").select("p_partkey", X.detect_word_swap(F.concat(F.lit("Call "), _who(F.col("p_partkey")), F.lit(" about "), "p_name"), F.concat(F.lit("Call "), _who(F.col("p_partkey") * 3 + 1), F.lit(" about "), "p_name")).alias("s")).select("p_partkey", "s.old", "s.new"),
     f"select p_partkey, case when ok then o end \"old\", case when ok then n end \"new\" from (select *, o<>n and o<>'lowercase' and n<>'lowercase' ok from (select p_partkey, {_WHO.format('p_partkey')} o, {_WHO.format('(p_partkey*3+1)')} n from part))")
_acts = lambda w: w.claims.where("kind = 'action_item'").select("meeting_id", "id", F.when(F.col("id") % 3 == 0, "Agent").when(F.col("id") % 3 == 1, "customer").otherwise("Mary").alias("owner"), F.concat(F.lit("Send erly whes "), F.get_json_object("body", "$.task")).alias("task"))
_add("sc_22_resolve_owner", lambda w: C.resolve_owners(_acts(w), w.utterances).select("id", "owner"),
     """with a as (select meeting_id, id, case id%3 when 0 then 'Agent' when 1 then 'customer' else 'Mary' end as owner, list_filter(string_split('send erly whes '||lower(json_extract_string(body,'$.task')),' '), lambda x: length(x)>3) ws from claims where kind='action_item'),
 m as (select a.id, u.speaker, u.idx, len(list_filter(ws, lambda x: contains(lower(u.text),x))) hits from a join utterances u on u.meeting_id=a.meeting_id and u.speaker_role=lower(a.owner) and u.speaker<>''),
 b as (select id, arg_min(speaker, idx - hits*1000000) best from m where hits>0 group by 1), o as (select meeting_id, speaker_role, min(speaker) only_one from utterances where speaker<>'' group by 1,2 having count(distinct speaker)=1)
 select a.id, coalesce(best, only_one, a.owner) as owner from a left join b on b.id=a.id left join o on o.meeting_id=a.meeting_id and o.speaker_role=lower(a.owner)""")  # fmt: skip
_heads = lambda w: _named(w).withColumn("headline", F.when(F.col("started_at") % 5 == 0, F.concat(F.lit("A headline that is somewhat longer than the sixty characters it may have "), "id")).when(F.col("started_at") % 5 == 1, " short one ").when(F.col("started_at") % 5 == 2, ""))
_add("sc_23_auto_title", lambda w: C.titled(_heads(w), w.entity_mentions, w.entities).select("id", "title"),
     f"""with n as (select *, case started_at%5 when 0 then 'A headline that is somewhat longer than the sixty characters it may have '||id when 1 then 'short one' end headline from {_NAMED}),
 g as (select meeting_id, entity_id, row_number() over (partition by meeting_id order by count(*) desc, round(sum(score),6) desc, entity_id) r from entity_mentions join entities e on e.id=entity_id and e.kind='topic' where gate='passed' group by 1,2), b as (select meeting_id, label from g join entities e on e.id=entity_id where r=1),
 t as (select n.id, title, title='Untitled meeting' or regexp_matches(title,'^Meeting [0-9]') or starts_with(title,'Quick capture ') auto, coalesce(headline, label||' — '||strftime(make_timestamp(started_at*1000),'%b %-d')) s from n left join b on b.meeting_id=n.id)
 select id, case when auto then coalesce(case when length(s)>60 then rtrim(left(s,57))||'…' else s end, title) else title end title from t""")  # fmt: skip
_add("sc_24_strip_markers", lambda w: w.claims.select("id", T.strip_markers(F.concat("kind", F.lit(" done [S001, S002] x [S003]"))).alias("v"), F.array_join(T.inline_sources(F.concat("kind", F.lit(" [S001, S002] x [S001]"))), ",").alias("s")), "select id, kind||' done x' v, 'S001,S002' s from claims")
_add("sc_25_highlight", lambda w: _u(w, v=T.highlight(F.col("text"), ["the", "an"])),
     """with t as (select meeting_id, idx, regexp_split_to_array(trim(text),'\\s+') ws from utterances), h as (select *, list_transform(ws, lambda x: starts_with(regexp_replace(lower(x),'[^a-z0-9]','','g'),'the') or starts_with(regexp_replace(lower(x),'[^a-z0-9]','','g'),'an')) hs from t),
 s as (select *, greatest(0, least(coalesce(list_position(hs,true),1)-1-6, len(ws)-12)) st from h)
 select meeting_id, idx, case when st>0 then '…' else '' end||array_to_string(list_transform(range(st+1, least(st+12,len(ws))+1), lambda i: case when hs[i] then '<b>'||ws[i]||'</b>' else ws[i] end),' ')||case when st+12<len(ws) then '…' else '' end v from s""")  # fmt: skip
_add("sc_26_porter", lambda w: _u(w, v=S.index_terms("text")))
_add("sc_27_template", lambda w: w.meetings.select("id", F.replace(F.replace(F.lit("{{title}} / {{mode}}"), F.lit("{{title}}"), F.col("title")), F.lit("{{mode}}"), F.col("mode")).alias("v")), "select id, title||' / '||mode as v from meetings")
_add("sc_28_flatten_transcript", lambda w: w.utterances.groupBy("meeting_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", F.format_string("[%.1fs] %s: %s", "offset_s", F.coalesce("speaker", "speaker_role"), "text").alias("l")))), lambda s: s["l"]), "\n").alias("v")), "select meeting_id, string_agg('['||printf('%.1f',offset_s)||'s] '||coalesce(speaker,speaker_role)||': '||text, chr(10) order by idx) v from utterances group by 1")
_WISHES = ["draft the follow-up email", "make a pricing table", "what are the action items", "why did the pricing quote move?", "show me how the pricing quote moved", "an update for the investors", "log this in the CRM", "brief before we sign", "post an update", "1:1 recap", "summarise this", "write up the interview", "recurring themes across my calls", "who spoke first?"]
_wish = lambda w: w.claims.select("id", F.get(F.array(*map(F.lit, _WISHES)), (F.col("id") % len(_WISHES)).cast("int")).alias("t"))
_add("sc_29_match_handoff", lambda w: _wish(w).select("id", H.match_handoff(F.col("t")).alias("v")),
     f"select id, case when regexp_matches(t,'{H.EXPLAIN}','i') and not regexp_matches(t,'{H.REQUEST_VERBS}','i') then null " + " ".join(f"when regexp_matches(t,'{p}','i') then '{h}'" for h, p in H.REQUESTS) + " end v from (select id, (['" + "','".join(_WISHES) + f"'])[id%{len(_WISHES)}+1] t from claims)")
_SPOKEN = ["You", "speaker 3", "Room12", "Person 4", "Unknown", "The agent", "AGENT", "Mary"]
_add("sc_30_placeholder", lambda w: w.utterances.select("meeting_id", "idx", T.is_placeholder(F.get(F.array(*map(F.lit, _SPOKEN)), (F.col("idx") % 8).cast("int"))).alias("v")),
     "select meeting_id, idx, regexp_full_match((['" + "','".join(_SPOKEN) + "'])[idx%8+1], '(?i)(you|them|me|myself|agent|customer|speaker ?[0-9]*|room ?[0-9]*|unknown)') v from utterances")
_add("sc_31_fact_tokens", lambda w: _u(w, v=F.size(T.fact_tokens(F.col("text")))), _us("cast(len(list_filter(regexp_extract_all(text,'[A-Za-z0-9_]+'), lambda x: regexp_full_match(x,'[A-Z][a-z]{2,}'))) as integer) v"))
_add("sc_32_mask_and_filename", lambda w: w.raw("part").select("p_partkey", T.mask_key(F.col("p_brand")).alias("m"), T.safe_filename(F.col("p_name")).alias("f")), "select p_partkey, '…'||right(p_brand,4) m, replace(p_name,' ','_') f from part")
#: Sums in words and figures that follow from the order's key: thousands and what is left of a thousand.
_SMALLS = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]
_TENS = ["twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]
_pick = lambda words, c: F.get(F.array(*map(F.lit, words)), (c % len(words)).cast("int"))
_k = lambda: F.col("o_orderkey")
_spelled = lambda: F.concat(_pick(_SMALLS, _k()), F.lit(" thousand "), _pick(_SMALLS, F.floor(_k() / 2)), F.lit(" hundred and "), _pick(_TENS, F.floor(_k() / 3)), F.lit(" "), _pick(_SMALLS, F.floor(_k() / 5)))
_PHRASE = f"({_SMALLS})[o_orderkey%9+1]||' thousand '||({_SMALLS})[o_orderkey//2%9+1]||' hundred and '||({_TENS})[o_orderkey//3%8+1]||' '||({_SMALLS})[o_orderkey//5%9+1]"
_VALUE = "(o_orderkey%9+1)*1000+(o_orderkey//2%9+1)*100+(o_orderkey//3%8+2)*10+(o_orderkey//5%9+1)"
_money = lambda w: w.raw("orders").select("o_orderkey", F.concat(F.lit("It costs $"), F.format_number(F.floor("o_totalprice"), 0), F.lit(", "), _spelled(), F.lit(" units by March")).alias("text"))
_add("sn_1_number_words", lambda w: _money(w).select("o_orderkey", F.element_at(N.number_words("text"), 1)["value"].alias("v"), F.element_at(N.number_words("text"), 1)["phrase"].alias("phrase")), f"select o_orderkey, cast({_VALUE} as bigint) v, {_PHRASE} phrase from orders")
_add("sn_2_haystack", lambda w: _money(w).select("o_orderkey", F.element_at(F.split(N.haystack_of("text"), " ␟ "), -1).alias("v"), F.regexp_extract(F.element_at(F.split(N.haystack_of("text"), " ␟ "), 2), r"\$([0-9]+)", 1).alias("sum")),
     f"select o_orderkey, cast({_VALUE} as varchar) v, cast(cast(floor(o_totalprice) as bigint) as varchar) \"sum\" from orders")
_add("sn_3_numeric_tokens", lambda w: _money(w).select("o_orderkey", F.array_join(F.transform(N.numeric_tokens("text"), lambda t: F.array_join(F.array_sort(t["forms"]), "/")), " | ").alias("v")),
     f"with m as (select o_orderkey, cast(floor(o_totalprice) as bigint) n, cast({_VALUE} as bigint) v, {_PHRASE} p from orders), f as (select *, format('{{:,}}', n) g, format('{{:,}}', v) h from m) select o_orderkey, array_to_string(list_sort(list_distinct(['$'||g||',', g||',', n::varchar, g, n||' dollars', g||' dollars'])),'/')||' | '||array_to_string(list_sort([v::varchar, h, p]),'/')||' | mar/march' v from f")
_cited = lambda: F.when(_k() % 3 == 0, F.lit("in march")).when(_k() % 3 == 1, F.concat(F.lit("some "), _spelled(), F.lit(" of them"))).otherwise(F.lit("nothing"))
_add("sn_4_verbatim_misses", lambda w: _money(w).select("o_orderkey", F.array_join(F.transform(N.verbatim_misses("text", _cited()), lambda t: F.when(t.startswith("$"), "sum").when(t == "March", t).otherwise("words")), "|").alias("v")),
     "select o_orderkey, case o_orderkey%3 when 0 then 'sum|words' when 1 then 'sum|March' else 'sum|words|March' end v from orders")
_add("sn_5_minutes", lambda w: C.minutes(w.utterances, w.meetings), "select m.id, nullif(cast(trunc(coalesce((mx+59)/60,(duration_s+59)/60)) as integer),0) as \"minutes\" from meetings m left join (select meeting_id, max(offset_s) mx from utterances group by 1) u on u.meeting_id=m.id")
_add("sn_7_rank_fusion", lambda w: R.fused(R.ranked(_scored(w), 60, F.desc("score")), R.ranked(_scored(w), 60, F.asc("score"))).select("chunk_id", F.round("fused", 9).alias("fused")),
     "with s as (select id chunk_id, length(text)%100 sc from chunks), a as (select chunk_id, row_number() over (order by sc desc, chunk_id)-1 r from s), b as (select chunk_id, row_number() over (order by sc, chunk_id)-1 r from s) select chunk_id, round(sum(p),9) fused from (select chunk_id, 1.0::double/(61+r) p from a where r<60 union all select chunk_id, 0.6::double/(61+r) from b where r<60) group by 1")
_add("sn_8_recency", lambda w: w.meetings.select("id", F.round(R.recency(F.col("started_at"), AS_OF_MS), 9).alias("v")), f"select id, round(1+0.15::double*exp(-greatest(0.0::double,({AS_OF_MS}-started_at)/86400000.0::double)/180.0::double),9) v from meetings")
_add("sn_9_cost", lambda w: w.runs.select("id", F.round(U.cost(F.when(F.col("id") % 2 == 0, "gpt-4o-mini").otherwise("own-model"), F.coalesce("tokens_in", F.lit(0)), F.lit(100), {"gpt-4o-mini": (0.00015, 0.0006), "own-model": (0.0005, 0.0015)}), 9).alias("v")), "select id, round(case when id%2=0 then coalesce(tokens_in,0)/1000.0::double*0.00015::double+0.1::double*0.0006::double else coalesce(tokens_in,0)/1000.0::double*0.0005::double+0.1::double*0.0015::double end,9) v from runs")
_add("sn_10_iso_day", lambda w: w.meetings.select("id", C.iso_day(F.col("started_at")).alias("v")), "select id, strftime(make_timestamp(started_at*1000),'%Y-%m-%d') v from meetings")
_ZONES = ["America/New_York", "Europe/Berlin", "UTC", "No/Such"]
_add("sn_11_zone_to_epoch", lambda w: w.raw("events").select("event_id", I.to_epoch(F.date_format(F.col("ts").cast("timestamp"), "yyyyMMdd'T'HHmmss"), _pick(_ZONES, F.col("event_id"))).alias("v")),
     "select event_id, epoch_ms(case event_id%4 when 0 then timezone('America/New_York', t) when 1 then timezone('Europe/Berlin', t) else timezone('UTC', t) end) v from (select event_id, date_trunc('second', ts)::timestamp t from events)")
_rule = lambda: F.when(F.col("c_custkey") % 3 == 0, "DAILY;COUNT=5;INTERVAL=2").when(F.col("c_custkey") % 3 == 1, "WEEKLY;BYDAY=MO,WE;UNTIL=20240125T000000Z").otherwise("MONTHLY;COUNT=3")
_feed = lambda w: w.raw("customer").select(F.concat(F.lit("BEGIN:VEVENT\nUID:"), F.col("c_custkey").cast("string"), F.lit("\nSUMMARY:Call\nDTSTART:20240131T100000Z\nRRULE:FREQ="), _rule(), F.lit("\nEND:VEVENT")).alias("value"))
_add("sn_12_recurrence", lambda w: I.events(_feed(w), 1704067200000, 1735689600000).select("uid", "start_ms"),
     "select cast(c_custkey as varchar) uid, epoch_ms(t) start_ms from (select c_custkey, unnest(case c_custkey%3 when 0 then [timestamp '2024-01-31 10:00:00', timestamp '2024-02-02 10:00:00', timestamp '2024-02-04 10:00:00', timestamp '2024-02-06 10:00:00', timestamp '2024-02-08 10:00:00'] when 2 then [timestamp '2024-01-31 10:00:00', timestamp '2024-03-02 10:00:00', timestamp '2024-03-31 10:00:00'] else [] end) t from customer)")
_add("sn_13_backoff", lambda w: w.runs.select("id", (F.col("id") % 5 + 1).cast("int").alias("n"), F.expr("cast(400 * power(2, id % 5) as bigint)").alias("ms")), "select id, (id%5+1)::integer n, (400*pow(2,id%5))::bigint ms from runs")
_answer = lambda w: w.claims.select("id", F.when(F.col("id") % 4 == 0, F.col("body")).when(F.col("id") % 4 == 1, F.concat(F.lit("Here:\n```json\n"), "body", F.lit("\n```\nDone."))).when(F.col("id") % 4 == 2, F.concat(F.lit("Sure: "), F.regexp_replace("body", r"\}$", ",}"), F.lit(" ok"))).otherwise(F.lit("no JSON {at all")).alias("t"))
_add("sn_14_loose_json", lambda w: _answer(w).select("id", F.get_json_object(T.parse_json_loose(F.col("t")), "$.task").alias("v")), "select id, case when id%4<3 then json_extract_string(body,'$.task') end v from claims")
_add("sn_15_budget", lambda w: w.runs.select("id", U.budget_reason(F.col("units"), F.coalesce("tokens_in", F.lit(0)) * 1000, F.lit(50.0), F.lit(60000)).alias("v")), "select id, case when coalesce(tokens_in,0)*1000>60000 then 'deadline-exceeded' when units>=50 then 'budget-exhausted' end v from runs")
_add("sn_16_confidence", lambda w: _u(w, v=SG.confidence(F.when(F.col("idx") % 3 == 0, F.lit(None)).otherwise(F.col("confidence") * 2 - 0.9))), _us("greatest(0.0::double, least(1.0::double, coalesce(case when idx%3=0 then null else confidence*2-0.9::double end, 1.0::double))) v"))
_add("sn_17_arrays", lambda w: w.utterances.where("speaker is not null").groupBy("meeting_id").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("speaker", "speaker_role"))))), ",").alias("v")), "select meeting_id, array_to_string(list_sort(list_distinct(flatten(list([speaker,speaker_role])))),',') v from utterances where speaker is not null group by 1")

# --- gates -------------------------------------------------------------------------------------
_quoted = lambda w: w.utterances.select(F.concat("meeting_id", F.lit("-"), "idx").alias("id"), "meeting_id", F.when(F.col("idx") % 3 == 0, F.substring("text", 1, 40)).when(F.col("idx") % 3 == 1, F.lit("qqqq zzzz never said")).alias("quote"), F.when(F.col("idx") % 2 == 0, F.col("offset_s") + 500.0).alias("offset_s"))
_add("gt_1_grounded_in", lambda w: Q.grounded(_quoted(w), w.utterances).select("id", F.col("gate_reason").isNull().alias("passed")), "select meeting_id||'-'||cast(idx as varchar) id, idx%3=0 and trim(regexp_replace(regexp_replace(lower(left(text,40)),'[^a-z0-9\\s]',' ','g'),'\\s+',' ','g'))<>'' passed from utterances")
_add("gt_2_canonical_gate", lambda w: E.canonical_reason(E.best_lexical(_CAND(w), w.entities).select("surface", F.lit("topic").alias("kind"), "entity_id", F.lit("lexical").alias("matcher"), "score", "runner_up", (F.length("surface") % 2 == 0).alias("has_proof"))).select("surface", F.col("gate_reason").isNull().alias("passed")))
#: The dozen longest chunks stand for what one question retrieved; all chunks are points.
_snips = lambda w: w.chunks.orderBy(F.desc(F.length("text")), "id").limit(12).select(F.col("id").alias("chunk_id"), "text")
_points = lambda w: w.chunks.select(F.col("id").alias("chunk_id"), F.lit("said so").alias("text"), F.when(F.col("id") % 2 == 0, F.substring("text", 1, 80)).otherwise(F.lit("")).alias("quote"))
_add("gt_3_answer_gate", lambda w: Q.answer_gate(_points(w), _snips(w)).select("chunk_id", F.col("reason").isNull().alias("passed")), "select id chunk_id, id%2=0 and id in (select id from chunks order by length(text) desc, id limit 12) passed from chunks")
_add("gt_4_no_new_facts", lambda w: w.utterances.select("meeting_id", "idx", Q.new_facts(F.concat("text", F.lit(" Zanzibar")), T.normalize(F.col("text"))).isNotNull().alias("v")))
_add("gt_5_sources", lambda w: Q.source_failures(_cites(w).select("meeting_id", F.col("key").cast("string").alias("path"), F.when(F.col("key") % 4 == 0, F.array().cast("array<string>")).otherwise(F.col("source")).alias("source")), SG.segments(w.utterances)).groupBy("rule").agg(F.count("*").alias("n")),
     f"with {_SEG}, {_CITE}, e as (select key, meeting_id, unnest([s1,s2]) id from cites where key%4<>0) select 'source-exists' as rule, count(*) n from e where not exists (select 1 from segs where segs.meeting_id=e.meeting_id and segs.id=e.id) union all select 'leaf-sourced', count(*) from cites where key%4=0")
_add("gt_6_verbatim", lambda w: Q.verbatim_failures(_money(w).select(F.col("o_orderkey").cast("string").alias("path"), "text", _cited().alias("cited"))),
     f"with m as (select o_orderkey k, cast(o_orderkey as varchar) path, '$'||format('{{:,}}', cast(floor(o_totalprice) as bigint))||',' as total, {_PHRASE} as words from orders) select path, 'verbatim-number' as rule, total as detail from m union all select path, 'verbatim-number', words from m where k%3<>1 union all select path, 'verbatim-number', 'March' from m where k%3<>0")
_add("gt_7_exact_quote", lambda w: Q.quote_failures(w.utterances.select(F.concat("meeting_id", F.lit("-"), "idx").alias("path"), F.when(F.col("idx") % 2 == 0, F.concat(F.lit('"'), F.regexp_replace(F.substring("text", 2, 20), '["“”]', ""), F.lit('"'))).otherwise(F.lit('“never said”')).alias("text"), F.array("text").alias("texts"))).select("path"), "select meeting_id||'-'||cast(idx as varchar) path from utterances where idx%2=1")
_add("gt_8_title_bullet", lambda w: Q.title_failures(_money(w).select(F.col("o_orderkey").cast("string").alias("path"), F.when(F.col("o_orderkey") % 2 == 0, "Costs").otherwise("Costs were raised several times during discussion").alias("text"), F.col("text").alias("cited"))).select("path"), "select cast(o_orderkey as varchar) path from orders where o_orderkey%2=0")
_add("gt_9_stated_verdict", lambda w: w.claims.select("id", Q.verdict_reason(F.lit("strong yes, hire"), F.when(F.col("id") % 2 == 0, "I am a strong yes, hire").otherwise("good chat"), F.lit("i am a strong yes, hire")).isNull().alias("v")), "select id, id%2=0 v from claims")
_add("gt_10_owner_whitelist", lambda w: w.claims.select("id", Q.owner_reason(F.get_json_object("body", "$.owner"), F.array(F.lit("person 1"), F.lit("person 2"))).isNull().alias("v")), "select id, coalesce(json_extract_string(body,'$.owner') in ('Person 1','Person 2'), false) v from claims")
_add("gt_11_owner_named", lambda w: w.claims.select("id", Q.unnamed_owner(F.when(F.col("id") % 3 == 0, "Unassigned: fix it").when(F.col("id") % 3 == 1, "Person 1 to fix it").otherwise("fix it"), F.array(F.lit("Person 1"))).alias("v")), "select id, id%3=2 v from claims")
_add("gt_12_theme_header", lambda w: Q.header_failures(w.claims.select(F.col("id").cast("string").alias("path"), F.when(F.col("id") % 2 == 0, "Decided on pricing for Person 1").otherwise("Pricing").alias("text"), F.lit("they talked about pricing").alias("leaf_text"), F.array(F.lit("Person 1")).alias("names"))).select("path", "detail"), "select cast(id as varchar) path, unnest(['1','decided','Person 1']) detail from claims where id%2=0")
_leaves = lambda w: _cites(w).select("meeting_id", F.col("key").cast("string").alias("path"), F.lit("It cost $12 for a thing that was said").alias("text"), "source", F.lit("Action items").alias("section"))
_names = lambda w: w.utterances.where("speaker is not null").groupBy("meeting_id").agg(F.collect_set("speaker").alias("names"))
_add("gt_13_validate_notes", lambda w: Q.validate_leaves(_leaves(w), SG.segments(w.utterances), _names(w)).select("meeting_id", "path", "rule"))
_duties = lambda w: w.claims.select(F.col("id").cast("string").alias("doc_id"), "meeting_id", F.to_json(F.struct(F.array(F.struct(F.lit("send it").alias("task"), F.when(F.col("id") % 2 == 0, "Person 1").when(F.col("id") % 5 == 0, "Stranger").alias("owner"), F.when(F.col("id") % 3 == 0, "Friday").alias("due"), F.array(F.lit("S001")).alias("source"))).alias("nextSteps"))).alias("json"))
_own = lambda w: w.meetings.select(F.col("id").alias("meeting_id"), F.array(F.lit("Person 1")).alias("names"))
_duty = H.Handoff("next", "Next", (H.Section("nextSteps", "actions", "Next"),))
_add("gt_14_action_items", lambda w: (lambda r: H.validate(r, SG.segments(w.utterances), _own(w)).select("doc_id", "rule").distinct())(H.items(_duties(w), _duty)),
     f"with {_SEG}, f as (select meeting_id, text from segs where id='S001') select cast(id as varchar) doc_id, 'verbatim-number' as rule from claims c join f using (meeting_id) where id%3=0 and not contains(lower(f.text),'fri') union all select cast(id as varchar), 'owner-whitelist' from claims where id%2<>0 and id%5=0 union all select cast(id as varchar), 'source-exists' from claims where meeting_id not in (select meeting_id from f)")
_add("gt_15_low_confidence", lambda w: SG.rests_on_low_confidence(_cites(w), SG.segments(w.utterances)), f"with {_SEG}, {_CITE}, e as (select key, meeting_id, unnest([s1,s2]) id from cites), l as (select key, bool_and(confidence<0.6) low from e join segs using(meeting_id,id) group by 1) select c.key, coalesce(low,false) low from cites c left join l using(key)")
_raw_statements = lambda w: _cites(w).select("meeting_id", F.col("key").alias("pos"), F.when(F.col("key") % 5 == 0, "").when(F.col("key") % 5 == 1, "it cost $77").otherwise("they spoke").alias("text"), F.lit("decision").alias("kind"), F.when(F.col("key") % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("S001"))).alias("source"), F.lit("Person 1").alias("speaker"))
_add("gt_16_sanitize_statements", lambda w: Q.sanitize_statements(_raw_statements(w), SG.segments(w.utterances), _names(w)).select("pos", F.split("reason", ":")[0].alias("reason")), "select id pos, case when id%5=0 then 'no text' when id%7=0 then 'no source segment ids' when id%5=1 then 'figure/date not in cited text' end reason from claims")
_add("gt_17_entailment", lambda w: Q.entailment_failures(w.claims.select(F.col("id").alias("ordinal"), F.col("id").cast("string").alias("path")), w.claims.where("done = 1").select(F.col("id").alias("i"), F.lit(False).alias("supported"), F.lit("no").alias("why"))).select("path"), "select cast(id as varchar) path from claims where done=1")
_notes = lambda w: w.meetings.select(F.col("id").alias("doc_id"), F.to_json(F.struct(F.array(F.struct(F.lit("Decisions").alias("text"), F.array(F.struct(F.concat(F.lit("Ship "), "title").alias("text"), F.array(F.lit("S001")).alias("source"), F.lit(False).alias("lowConfidence")), F.struct(F.concat(F.lit("ship "), "title", F.lit("!")).alias("text"), F.array(F.lit("S002")).alias("source"), F.lit(True).alias("lowConfidence"))).alias("children")), F.struct(F.col("mode").alias("text"), F.array(F.struct(F.lit("A point").alias("text"), F.array(F.lit("S003")).alias("source"), F.lit(False).alias("lowConfidence"))).alias("children"))).alias("themes"))).alias("json"))
_BAD = ['{"themes":[{"text":"A","children":[{"text":"b"}]},{"text":""}]}', '{"themes":[{"text":"A","source":["S001"],"children":[{"text":"b","source":["S001"]}]}]}', '{"themes":[{"text":"A","children":[{"text":"b","source":["S001"]}]}]}', '{"themes":[{"text":"A","children":[{"text":"b","children":[{"text":"c","source":["S001"],"children":[{"text":"d","source":["S001"]}]}]}]}]}']
_conv = lambda: F.substring("id", 2, 20).cast("long")
_add("gt_19_shape", lambda w: O.shape_errors(w.meetings.select(F.col("id").alias("doc_id"), _pick(_BAD, _conv()).alias("json"))),
     "select id doc_id, unnest(case k when 0 then ['0.0','1','1'] when 1 then ['0'] when 3 then [''] else [] end) path, unnest(case k when 0 then ['a leaf bullet must carry source','text must be a non-empty string','a leaf bullet must carry source'] when 1 then ['a theme label must not carry source'] when 3 then ['exceeds the maximum outline depth of 3'] else [] end) error from (select id, cast(substr(id,2) as bigint)%4 k from meetings)")
_add("gt_20_bullet_grounding", lambda w: _u(w, v=Q.bullet_grounding(F.when(F.col("idx") % 3 == 0, None).when(F.col("idx") % 3 == 1, F.lit("qqqq zzzz")).otherwise(F.col("text")), T.normalize(F.col("text")))), f"select meeting_id, idx, case idx%3 when 0 then null when 1 then false else {_NORM.format('text')}<>'' end v from utterances")
_fails = lambda w: w.claims.select("meeting_id", F.col("kind").alias("path"), F.col("gate").alias("rule"), F.col("id").alias("seq"), F.concat(F.lit("d"), "id").alias("detail"))
_add("gt_21_format_failures", lambda w: Q.format_failures(_fails(w)), "with o as (select meeting_id, kind, gate, min(id) seq from claims group by all), l as (select *, row_number() over (partition by meeting_id order by seq) n from o), t as (select meeting_id, count(*) total from claims group by 1), s as (select meeting_id, string_agg('- ['||gate||'] d'||cast(seq as varchar), chr(10) order by n) x, count(*) c from l where n<=12 group by 1) select meeting_id, x||case when total-c>0 then chr(10)||'- (and '||cast(total-c as varchar)||' more of the same kinds)' else '' end as text from s join t using(meeting_id)")
_recap = lambda w: w.utterances.groupBy("meeting_id").agg(
    F.transform(F.array_sort(F.collect_list(F.when(F.col("idx") % 3 == 0, F.struct("idx", "offset_s")))), lambda s: F.struct((s["offset_s"] + F.when(s["idx"] % 2 == 0, 0.0).otherwise(5000.0)).alias("offset_s"), F.lit("a moment").alias("text"))).alias("moments"),
    F.transform(F.array_sort(F.collect_list(F.when(F.col("idx") % 4 == 1, F.struct("idx", "text")))), lambda s: F.struct(s["text"].alias("quote"), F.lit("a risk").alias("text"))).alias("risk_signals"),
    F.array(F.struct(F.lit("qqqq zzzz never said").alias("text"))).alias("objections"), F.transform(F.array_sort(F.collect_list(F.when(F.col("idx") % 4 == 2, F.struct("idx", "text")))), lambda s: s["text"]).alias("key_decisions"),
    F.array(F.struct(F.lit("never said qqqq zzzz").alias("task"), F.lit("customer").alias("owner"), F.lit(None).cast("string").alias("due"))).alias("action_items"))
_add("gt_22_claim_assembly", lambda w: C.assembled(_recap(w), w.utterances).groupBy("meeting_id", "kind", "gate").agg(F.count("*").alias("n")),
     f"""with u as (select *, {_NORM.format('text')} nt from utterances), c as (select meeting_id, 'moment' kind, exists (select 1 from utterances v where v.meeting_id=u.meeting_id and abs(v.offset_s-(u.offset_s+case when u.idx%2=0 then 0 else 5000 end))<=15) ok from u where idx%3=0
 union all select meeting_id, 'risk', nt<>'' from u where idx%4=1 union all select meeting_id, 'decision', nt<>'' from u where idx%4=2 union all select distinct meeting_id, 'objection', false from u union all select distinct meeting_id, 'action_item', false from u)
 select meeting_id, kind, case when ok then 'passed' else 'blocked' end gate, count(*) n from c group by all""")  # fmt: skip
_add("gt_23_foreign_citation", lambda w: Q.foreign_citations(w.claims.select(F.col("id").cast("string").alias("path"), F.concat(F.lit("M"), F.col("id") % 3).alias("meeting"), F.array(F.concat(F.lit("M"), F.col("id") % 2, F.lit(":S001"))).alias("source"))).select("path"), "select cast(id as varchar) path from claims where id%3<>id%2")

# --- trees and handoffs ------------------------------------------------------------------------
_TREE = "tree as (select id doc_id, [0] path, 'Decisions' as text, false is_leaf from meetings union all select id, [0,0], 'Ship '||title, true from meetings union all select id, [0,1], 'ship '||title||'!', true from meetings union all select id, [1], mode, false from meetings union all select id, [1,0], 'A point', true from meetings)"
_add("tree_1_walk", lambda w: O.bullets(_notes(w)).select("doc_id", O.path_text(F.col("path")).alias("path"), "text", "is_leaf"), f"with {_TREE} select doc_id, array_to_string(path,'.') path, text, is_leaf from tree")
_cited_notes = lambda w: w.meetings.select(F.col("id").alias("doc_id"), F.to_json(F.struct(F.array(F.struct(F.lit("A").alias("text"), F.array(*(F.struct(F.lit(f"p{i}").alias("text"), F.array(SG.segment_id((_conv() * (i + 2) % 5).cast("int"))).alias("source")) for i in range(3))).alias("children"))).alias("themes"))).alias("json"))
_add("tree_2_implied_sources", lambda w: O.implied_sources(O.bullets(_cited_notes(w)), "0").select("doc_id", F.array_join("source", ",").alias("source")),
     "with c as (select id, i, 'S00'||cast(cast(substr(id,2) as bigint)*(i+2)%5+1 as varchar) s from meetings, (select unnest([0,1,2]) i)), f as (select id, s, min(i) i from c group by 1,2) select id doc_id, string_agg(s, ',' order by i) source from f group by 1")
_add("tree_3_rebuild", lambda w: O.rebuild(O.bullets(_notes(w)), O.bullets(_notes(w)).where("path = array(1, 0) or (path = array(0, 0) and doc_id = 'm1')")).select("doc_id", O.path_text(F.col("path")).alias("path"), "text"), f"with {_TREE} select doc_id, case when path=[0,1] and doc_id='m1' then '0.0' else array_to_string(path,'.') end path, text from tree where path[1]=0 and not (path=[0,0] and doc_id='m1')")
_add("tree_4_sections", lambda w: O.normalize_sections(O.bullets(_notes(w)), "team").select("doc_id", "section", "order", "text"), "select id doc_id, 'Decisions' section, cast(unnest([0,1]) as integer) \"order\", unnest(['Ship '||title,'ship '||title||'!']) as text from meetings union all select id, 'Discussion', 0, mode from meetings")
_add("tree_5_dedupe", lambda w: O.dedupe_leaves(O.bullets(_notes(w))).select("doc_id", O.path_text(F.col("path")).alias("path"), "text", F.array_join("source", ",").alias("source"), "low_confidence", "merged"), "select id doc_id, '0.0' path, 'Ship '||title as text, 'S001,S002' source, false low_confidence, 1::bigint merged from meetings union all select id, '1.0', 'A point', 'S003', false, 0 from meetings")
_add("tree_6_to_markdown", lambda w: O.to_markdown(O.bullets(_notes(w))), "select id doc_id, '- Decisions'||chr(10)||'  - Ship '||title||' [S001]'||chr(10)||'  - ship '||title||'! [S002 ?]'||chr(10)||'- '||mode||chr(10)||'  - A point [S003]' as markdown from meetings")
_add("tree_7_from_markdown", lambda w: O.from_markdown(O.to_markdown(O.bullets(_notes(w)))).select("doc_id", O.path_text(F.col("path")).alias("path"), "text", "is_leaf"), f"with {_TREE} select doc_id, array_to_string(path,'.') path, text, is_leaf from tree")
_add("tree_8_repair", lambda w: O.rebuild(O.bullets(_notes(w)), O.bullets(_notes(w)).where("low_confidence")).select("doc_id", O.path_text(F.col("path")).alias("path"), "text"), f"with {_TREE} select doc_id, array_to_string(path,'.') path, text from tree where path<>[0,1]")
_add("tree_9_attempts", lambda w: U.attempts(w.claims.select(F.col("meeting_id").alias("name"), (F.col("id") % 4 + 1).alias("attempt"), (F.col("done") == 1).alias("ok")).groupBy("name", "attempt").agg(F.bool_or("ok").alias("ok"))), "with t as (select meeting_id as name, id%4+1 attempt, bool_or(done=1) ok from claims group by 1,2), s as (select name, min(case when ok then attempt end) won, max(attempt) lst from t where attempt<=3 group by 1) select name, case when won=1 then 'ok' when won is not null then 'retried' else 'failed' end status, coalesce(won,lst) attempts from s")
_add("tree_10_summary_rows", lambda w: O.bullets(_notes(w)).where("is_leaf").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "text"))), lambda s: s["text"]), " ").alias("text")), "select id doc_id, 'Ship '||title||' ship '||title||'! A point' as text from meetings")
# Documents of all passed claims of a meeting, in the shape of their kind.
_XS = lambda: F.transform(F.array_sort(F.collect_list(F.struct("id", F.get_json_object("body", "$.task").alias("task"), F.get_json_object("body", "$.owner").alias("owner")))), lambda s: s)
_SOURCE = lambda: F.array(F.lit("S001")).alias("source")
_SHAPE = {
    "items": lambda: F.transform("xs", lambda s: F.struct(s["task"].alias("text"), _SOURCE())),
    "actions": lambda: F.transform("xs", lambda s: F.struct(s["task"].alias("task"), s["owner"].alias("owner"), F.lit("").alias("due"), _SOURCE())),
    "quotes": lambda: F.transform("xs", lambda s: F.struct(F.when(s["id"] % 2 == 0, s["task"]).alias("item"), F.when(s["id"] % 3 > 0, F.concat(F.lit("$"), s["id"].cast("string"))).otherwise("").alias("price"), F.lit("seat").alias("unit"), _SOURCE())),
    "groups": lambda: F.array(F.struct(F.lit("Person 1").alias("owner"), F.filter(F.transform("xs", lambda s: F.struct(s["id"].alias("id"), s["task"].alias("text"), s["owner"].alias("owner"), _SOURCE())), lambda x: x["id"] % 2 == 0).alias("items")), F.struct(F.lit("").alias("owner"), F.filter(F.transform("xs", lambda s: F.struct(s["id"].alias("id"), s["task"].alias("text"), s["owner"].alias("owner"), _SOURCE())), lambda x: x["id"] % 2 > 0).alias("items"))),
    "lean": lambda: F.struct(F.lit("a strong yes").alias("text"), _SOURCE()),
    "prose": lambda: F.lit("  "),
    "lines": lambda: F.array_join(F.transform("xs", lambda s: F.concat(s["task"], F.lit(" [S001, S002]\n"))), "\n"),
    "themes": lambda: F.array(F.struct(F.lit("Pricing").alias("theme"), F.lit("praise").alias("kind"), F.transform("xs", lambda s: F.struct(F.when(s["id"] % 4 > 0, "M1").otherwise("").alias("meetingId"), F.array(F.lit("M1:S001")).alias("source"))).alias("examples"))),
    "notes": lambda: F.transform("xs", lambda s: F.struct(s["task"].alias("text"), F.array(F.struct(F.lit("a leaf").alias("text"), _SOURCE())).alias("children"))),
}
_doc = lambda w, h: w.claims.where("gate = 'passed'").groupBy("meeting_id").agg(_XS().alias("xs")).select(F.col("meeting_id").alias("doc_id"), "meeting_id", F.to_json(F.struct(*(_SHAPE[s.kind]().alias(s.key) for s in h.sections))).alias("json"))
_IT = "it as (select meeting_id, id, json_extract_string(body,'$.task') task, coalesce(json_extract_string(body,'$.owner'),'Unassigned') as own, row_number() over (partition by meeting_id order by id)-1 pos from claims where gate='passed')"
_at = lambda k, p="pos": f"'{k}['||cast({p} as varchar)||']'"
_ROWS = {
    "items": lambda k: f"select meeting_id doc_id, {_at(k)} path, task as text, null::varchar as owner from it",
    "actions": lambda k: f"select meeting_id doc_id, {_at(k)} path, task as text, own as owner from it",
    "quotes": lambda k: f"select meeting_id, {_at(k, 'p')}, case when id%2=0 then task else 'Unnamed item' end||' $'||cast(id as varchar)||' seat', null::varchar from (select *, row_number() over (partition by meeting_id order by id)-1 p from it where id%3>0)",
    "groups": lambda k: f"select meeting_id, '{k}['||cast(g-1 as varchar)||'].items['||cast(row_number() over (partition by meeting_id, own order by place)-1 as varchar)||']', task, own from (select *, dense_rank() over (partition by meeting_id order by own='Unassigned', f) g from (select *, min(place) over (partition by meeting_id, own) f from (select meeting_id, task, case when own='Unassigned' and id%2=0 then 'Person 1' else own end own, (id%2)*10000000000+id place from it)))",
    "lean": lambda k: f"select distinct meeting_id, '{k}', 'a strong yes', null::varchar from it",
    "prose": lambda k: f"select distinct meeting_id, '{k}', '@', null::varchar from it",
    "lines": lambda k: f"select meeting_id, {_at(k, '2*pos')}, task, null::varchar from it",
    "themes": lambda k: f"select meeting_id, '{k}[0].examples['||cast(row_number() over (partition by meeting_id order by id)-1 as varchar)||']', 'Pricing', 'M1' from it where id%4>0",
    "notes": lambda k: "select meeting_id, cast(pos as varchar), task, 'label' from it union all select meeting_id, cast(pos as varchar)||'.0', 'a leaf', 'leaf' from it",
}
for _i, _h in enumerate(H.CATALOG, 1):
    _add(f"ho_{_i}_{_h.id}", lambda w, h=_h: H.items(_doc(w, h), h).select("doc_id", "path", "text", "owner"), f"with {_IT}, r(doc_id, path, text, owner) as (" + " union all ".join(f"({_ROWS[s.kind](s.key).replace('@', s.fallback.replace(chr(39), chr(39) * 2))})" for s in _h.sections) + ") select * from r")
_TA = H.BY_ID["team_actions"]
_GROUPS = f"with {_IT}, r(doc_id, path, text, owner) as ({_ROWS['groups']('perOwner')})"
_add("ho_12_regroup_by_owner", lambda w: H.regroup(H.items(_doc(w, _TA), _TA)).select("doc_id", "owner", "n", "last"), f"{_GROUPS} select doc_id, owner, count(*) n, cast(owner='Unassigned' as integer) as \"last\" from r group by 1,2")
_add("ho_13_prune", lambda w: (lambda r: H.prune(r, r.where(H.path_index(F.col("path"), "perOwner") == 0).select("doc_id", "path"), _TA))(H.items(_doc(w, _TA), _TA)).groupBy("doc_id").agg(F.count("*").alias("n")), f"{_GROUPS} select doc_id, count(*) n from r where not starts_with(path,'perOwner[0]') group by 1")
_add("ho_14_alias_segments", lambda w: H.alias_segments(SG.segments(w.utterances), ["m23", "m1"]).select("meeting_id", "id"), "select meeting_id, case meeting_id when 'm23' then 'M1:' else 'M2:' end||'S'||lpad(cast(idx+1 as varchar),3,'0') id from utterances where meeting_id in ('m23','m1')")
_add("ho_15_suggested", lambda w: H.suggested(w.meetings.select("id", SG.meeting_type(F.col("mode"), F.lit(None).cast("string")).alias("type"))).where("suggested").select("id", "handoff", "rank", "is_default"),
     "with t(type, hs) as (values " + ", ".join(f"('{k}', {v})" for k, v in H.SUGGESTED.items()) + "), m as (select id, case mode when 'investor' then 'investor' when 'discovery' then 'customer' when 'one_on_one' then 'one_on_one' else 'team' end as type from meetings) select id, unnest(hs) handoff, cast(unnest(range(len(hs))) as integer) as rank, unnest(range(len(hs)))=0 is_default from m join t using (type)")
_add("ho_16_cross_meeting_cache", lambda w: M.cached(_prints(w).where("meeting_id in ('m1','m2')").withColumn("json", F.lit("[]")), _prints(w).where("meeting_id in ('m1','m2','m23')")).select("meeting_id", F.col("json").isNotNull().alias("reused")), "select distinct meeting_id, meeting_id<>'m23' reused from utterances where meeting_id in ('m1','m2','m23')")

# --- composites --------------------------------------------------------------------------------
_add("cp_1_candidates", lambda w: E.candidates(w.utterances, _recaps(w)).groupBy("meeting_id").agg(F.count("*").alias("n")).where("n <= 12").select("meeting_id"))
_add("cp_2_curate", lambda w: E.curate(E.candidates(w.utterances, _recaps(w)), w.meetings.select(F.col("id").alias("meeting_id"), F.array(F.lit("Low Budget"), F.lit("urgent budget")).alias("keep"))).where("kind = 'topic'").select("meeting_id", "surface"))
_resolved = lambda w: RS.resolve_all(RS.with_proof(E.candidates(w.utterances, _recaps(w)), w.utterances), w.entities)
_add("cp_3_resolve", lambda w: _resolved(w).select("meeting_id", "kind", "surface", "entity_id", "matcher", F.round("score", 6).alias("score"), F.round("runner_up", 6).alias("runner_up"), "blocked"))
_add("cp_4_store", lambda w: E.store(E.canonical_reason(_resolved(w)))[2].drop("score"))
_add("cp_5_project_graph", lambda w: w.edges, "select src, dst, kind, meeting_id from edges")
_add("cp_6_relate", lambda w: G.related_edges(_live(w)).select("src", "dst"), "with " + _REL + " select src, dst from relboth")
_add("cp_7_index_meeting", lambda w: K.every_chunk(w.utterances, w.claims, w.meetings).select("meeting_id", "kind", "src_id", "start_offset_s", "end_offset_s", "speakers", "text"),
     "select meeting_id, 'window' kind, src_id, start_offset_s, end_offset_s, speakers, text from chunks union all select meeting_id, 'claim', id, coalesce(offset_s,0), coalesce(offset_s,0), null, concat_ws(' — ', kind, coalesce(json_extract_string(body,'$.task'),quote,''), quote) from claims where gate='passed' union all select id, 'summary', 0, 0, 0, null, title from meetings")
_add("cp_8_retrieve_hybrid", lambda w: A.snippets(w, "red rod the person", graph=True).select("chunk_id", "meeting_id", "score"))
_add("cp_9_ask_extractive", lambda w: A.ask_extractive(w).select("chunk_id", "meeting_id", "quote"))
_add("cp_10_enumerate", lambda w: V.enumerated("list the open action items", w.claims, w.meetings)[1].select("id", "text", "meeting_id", "offset_s"),
     "select id, coalesce(json_extract_string(body,'$.task'),quote,'')||coalesce(' — '||json_extract_string(body,'$.owner'),'') as text, meeting_id, coalesce(offset_s,0) offset_s from claims where kind='action_item' and gate='passed' and done=0")
_seen = lambda w: w.chunks.where("src_id = 0").select(F.col("id").alias("chunk_id"), "meeting_id", "text")
_now = lambda w: w.chunks.orderBy(F.desc(F.length("text")), "id").limit(12).select(F.col("id").alias("chunk_id"), "meeting_id", "text", F.length("text").cast("double").alias("score"))
_add("cp_10_converse", lambda w: V.turn("who?", _now(w), _seen(w), w.topics.select("label"), _seen(w).select(F.lit("they spoke").alias("text"), "chunk_id", F.when(F.col("chunk_id") % 2 == 0, F.substring("text", 1, 40)).otherwise(F.lit("qqqq zzzz")).alias("quote"))).select("mode", "chunk_id", "meeting_id"),
     "select 'synthesized' as mode, id chunk_id, meeting_id from chunks where src_id=0 and id%2=0")
_team = lambda w: w.people.select(F.col("id").alias("k"), "name", "team").select((F.col("k") % 25).cast("int").alias("project_id"), "name", "team")
_papers = lambda w: w.raw("part").select((F.col("p_partkey") % 25).cast("int").alias("project_id"), F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.when(F.col("p_partkey") % 3 > 0, F.concat(F.lit("All about "), "p_brand")).alias("content"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("On "), "p_type")).alias("summary"), (F.col("p_partkey") * 37 % 101).alias("updated_at"))
_PAPERS = "papers as (select cast(p_partkey%25 as int) project_id, p_partkey id, p_name title, case when p_partkey%3>0 then 'All about '||p_brand end as content, case when p_partkey%2=0 then 'On '||p_type end summary, p_partkey*37%101 updated_at from part), team as (select cast(id%25 as int) project_id, name, team from people)"
_add("cp_12_project_context", lambda w: A.project_context(w.meetings, w.claims, w.meeting_projects, _team(w), _papers(w), w.projects.where("id in (3, 7)")),
     f"""with {_PAPERS}, p as (select unnest([3,7])::int project_id), m as (select project_id, m.id meeting_id, title, started_at from p join meeting_projects using (project_id) join meetings m on m.id=meeting_id),
 a as (select project_id, 'meeting' part, row_number() over (partition by project_id order by started_at desc, meeting_id) as rank, title||' ('||strftime(make_timestamp(started_at*1000),'%Y-%m-%d')||')' as text from m),
 c as (select project_id, 'claim' part, row_number() over (partition by project_id order by c.id, meeting_id) as rank, case when kind='decision' then 'Decision: '||coalesce(json_extract_string(b,'$.text'),'') else 'Action item'||case when done<>0 then ' (done)' else '' end||': '||coalesce(json_extract_string(b,'$.task'),'')||coalesce(' — owner '||json_extract_string(b,'$.owner'),'') end||' ['||title||']' as text from (select *, coalesce(edited_body, body) b from claims where gate='passed' and kind in ('decision','action_item')) c join m using (meeting_id)),
 e as (select project_id, 'person' part, row_number() over (partition by project_id order by name) as rank, name||coalesce(' ('||team||')','') as text from p join team using (project_id)),
 d as (select project_id, 'document' part, row_number() over (partition by project_id order by updated_at desc, id) as rank, title||chr(10)||coalesce('Summary: '||summary||chr(10),'')||left(coalesce(content,'(no extractable text)'),9000) as text from p join papers using (project_id))
 select project_id, part, cast(rank as integer) as rank, text from a where rank<=12 union all select project_id, part, cast(rank as integer), text from c union all select project_id, part, cast(rank as integer), text from e union all select project_id, part, cast(rank as integer), text from d where rank<=8""")  # fmt: skip
_add("cp_11_match_projects", lambda w: A.matching_context(w.meetings, w.claims, w.meeting_projects, _team(w), _papers(w)),
     f"""with {_PAPERS}, d as (select project_id, row_number() over (partition by project_id order by started_at desc, c.id) as rank, coalesce(json_extract_string(b,'$.text'),b) as text from (select *, coalesce(edited_body, body) b from claims where gate='passed' and kind='decision') c join meeting_projects using (meeting_id) join meetings m on m.id=meeting_id),
 e as (select project_id, row_number() over (partition by project_id order by name) as rank, name as text from team), f as (select project_id, row_number() over (partition by project_id order by updated_at desc, id) as rank, concat_ws(': ', title, coalesce(summary, left(content,300))) as text from papers)
 select project_id, 'person' part, cast(rank as integer) as rank, text from e where rank<=10 union all select project_id, 'document', cast(rank as integer), text from f where rank<=5 union all select project_id, 'decision', cast(rank as integer), text from d where rank<=5""")  # fmt: skip
_add("cp_11_suggestions", lambda w: A.matched(w.claims.select("meeting_id", (F.col("id") % 30).cast("int").alias("project_id"), (F.col("id") % 100 / 100).alias("confidence")), w.meeting_projects), "select meeting_id, project_id, confidence from (select meeting_id, cast(id%30 as int) project_id, id%100/100.0::double confidence from claims) c where confidence>=0.5 and exists (select 1 from meeting_projects p where p.meeting_id=c.meeting_id and p.project_id=c.project_id)")
_add("cp_13_meeting_meta", lambda w: A.meeting_meta(w.meetings, w.utterances, w.people, lambda names: F.array_join(names, ",")),
     "with n as (select string_agg(distinct name, ',' order by name) names from people) select m.id meeting_id, coalesce((select string_agg(distinct speaker, ',' order by speaker) from utterances u where u.meeting_id=m.id and speaker is not null),'') participants, array_to_string(list_sort(list_distinct(list_concat(coalesce((select list(distinct speaker) from utterances u where u.meeting_id=m.id and speaker is not null),[]), string_split(names,',')))),',') owners from meetings m, n")
_update = H.BY_ID["investor_update"]
_add("cp_15_run_handoff", lambda w: Y.run_handoff(_doc(w, _update).unionByName(w.spark.createDataFrame([("gone", "gone", "{}")], "doc_id string, meeting_id string, json string")), _update, w.meetings, w.utterances.where("meeting_id <> 'm3'"), w.claims.where("meeting_id <> 'm4'").select("meeting_id"), _own(w)).select("doc_id", "code", F.col("markdown").isNotNull().alias("shipped")),
     "select distinct meeting_id doc_id, case meeting_id when 'm3' then 'no-transcript' when 'm4' then 'no-statements' end code, meeting_id not in ('m3','m4') shipped from claims where gate='passed' union all select 'gone', 'not-found', false")
_CROSS = '{"themes":[{"theme":"the calls","kind":"praise","examples":[{"meetingId":"M1","source":["M1:S001"]},{"meetingId":"M2","source":["M2:S002"]},{"meetingId":"M2","source":["M1:S001"]},{"meetingId":"M2","source":["M2:S999"]}]}]}'
_add("cp_15_cross_handoff", lambda w: Y.run_cross_handoff(_CROSS, H.BY_ID["collated_feedback"], ["m5", "none", "m7"], w.meetings, w.utterances, "2024-01-09"),
     "select 'cross' doc_id, null::varchar code, '**Collated customer feedback** (2024-01-09)'||chr(10)||chr(10)||'- **the calls** — 2 mentions · praise'||chr(10)||'  _heard in:_ Meeting 5, Meeting 7' as markdown, 2::bigint dropped")
_add("gt_18_unsourced_prose", lambda w: Q.unsourced_failures(w.claims.select(F.col("id").cast("string").alias("path"), F.when(F.col("id") % 3 == 0, "send 40 of them").when(F.col("id") % 3 == 1, 'they said "not this year"').otherwise("Thanks for the time").alias("text"))).select("path", "rule"),
     "select cast(id as varchar) path, case id%3 when 0 then 'verbatim-number' else 'exact-quote' end as rule from claims where id%3<2")
_add("cp_17_rederive", lambda w: B.rederive(w, "m5")[2].select("entity_id", "surface", "gate"))
_add("api_1_brain_info", lambda w: B.Tools(w).brain_info(), "select (select count(*) from meetings) meetings, (select max(started_at) from meetings) newest_meeting, (select count(*) from entities where merged_into is null) entities, (select count(*) from claims where gate='passed') claims, (select count(*) from chunks) chunks")
_add("api_2_search_brain", lambda w: B.Tools(w).search_brain("red rod the person").select("chunk_id", "meeting_id", "score"))
_add("api_3_list_claims", lambda w: B.Tools(w).list_claims("decision", True, "2024-01-01", 200).select("id", "owner", "meeting_id"),
     "select c.id, json_extract_string(body,'$.owner') as owner, meeting_id from claims c join meetings m on m.id=meeting_id where c.kind='decision' and gate='passed' and done=0 and started_at>=1704067200000 order by started_at desc, c.id limit 200")
_add("api_4_get_entity", lambda w: B.Tools(w).get_entity("red gear").mentions.drop("title"),
     "select surface, quote, offset_s, meeting_id, started_at from entity_mentions em join meetings m on m.id=meeting_id where gate='passed' and entity_id=(select id from entities where merged_into is null and (norm='red gear' or contains(norm,'red gear')) order by norm<>'red gear', length(norm), id limit 1)")
_add("api_5_get_meeting", lambda w: B.Tools(w).get_meeting("m7").claims.drop("label"),
     "select id, kind, json_extract_string(body,'$.owner') as owner, quote, offset_s, done<>0 done from claims where meeting_id='m7' and gate='passed'")
_add("api_6_list_meetings", lambda w: B.Tools(w).list_meetings(100, "2024-01-01T05:00:00").select("id", "title", "started_at", "decisions", "action_items"),
     "select id, title, started_at, (select count(*) from claims c where c.meeting_id=m.id and gate='passed' and c.kind='decision') decisions, (select count(*) from claims c where c.meeting_id=m.id and gate='passed' and c.kind='action_item') action_items from meetings m where started_at>=1704067200000+5*3600000 order by started_at desc, id limit 100")
_add("api_7_get_evidence", lambda w: B.Tools(w).get_evidence("m3", ["S002", "S001", "S999"]),
     f"with {_SEG}, a as (select 0 pos, 'S002' id union all select 1, 'S001' union all select 2, 'S999') select pos, a.id, coalesce(s.text,'(unknown segment id)') as text from a left join segs s on s.id=a.id and s.meeting_id='m3'")
_tapes = lambda w: w.meetings.select(F.col("id").alias("meeting_id"), _conv().alias("k"), F.explode(F.array(F.lit(0), F.lit(1))).alias("channel")).select("meeting_id", "channel", F.when(F.col("k") % 5 == 0, 0).when(F.col("k") % 5 == 1, 900000).when((F.col("k") % 5 == 2) & (F.col("channel") == 1), 10).otherwise(2000000).alias("bytes"), (F.col("k") % 7 == 6).alias("resumed"))
_lines = lambda w: w.utterances.withColumn("speaker", F.when(F.col("speaker_role") == "agent", "You").otherwise("Them"))
_add("cp_16_plan", lambda w: L.diarize_plan(_tapes(w), _lines(w), w.meetings.where("started_at % 11 = 0").select(F.col("id").alias("meeting_id"), F.lit("shipped").alias("status"))),
     """with t as (select id meeting_id, cast(substr(id,2) as bigint) k, unnest([0,1])::int channel, started_at from meetings), b as (select *, case when k%5=0 then 0 when k%5=1 then 900000 when k%5=2 and channel=1 then 10 else 2000000 end bytes from t), m as (select *, max(bytes) over (partition by meeting_id) most from b),
 u as (select meeting_id, case when speaker_role='agent' then 1 else 0 end channel, count(*) n, sum(duration_s) s from utterances group by 1,2)
 select meeting_id, channel, case when started_at%11=0 then 'done' when k%7=6 then 'skip: resumed' when most=0 then 'skip: no tapes' when most<960000 then 'skip: too short' when bytes<960000 then 'channel too short' when coalesce(n,0)<2 or coalesce(s,0)<20 then 'nothing to split' else 'run' end as action from m left join u using (meeting_id, channel)""")  # fmt: skip
_turns = lambda w: w.utterances.where("idx % 2 = 0").select("meeting_id", F.when(F.col("speaker_role") == "agent", 1).otherwise(0).alias("channel"), F.concat(F.lit("speaker_"), (F.col("idx") % 3 + 1).cast("string")).alias("speaker"), F.col("offset_s").alias("start"), (F.col("offset_s") + F.col("idx") % 4 / 10).alias("end"), "text")
_add("cp_16_diarize", lambda w: L.substituted(_lines(w), _turns(w)).select("meeting_id", "speaker", "speaker_role", "offset_s", F.round("duration_s", 6).alias("duration_s"), "idx"),
     f"""with u as (select *, {_W3.format('text')} ws, case when speaker_role='agent' then 'You' else 'Them' end nm from utterances), s as (select meeting_id, case when nm='You' then 'Room ' else 'Speaker ' end||cast(idx%3+1 as varchar) speaker, speaker_role, nm, text, ws, offset_s, greatest(0.3::double, (offset_s+idx%4/10.0::double)-offset_s) duration_s from u where idx%2=0),
 k as (select * from s a where nm='Them' or not exists (select 1 from s b where b.nm='Them' and b.meeting_id=a.meeting_id and abs(a.offset_s-b.offset_s)<4 and {_OV.format('a.ws','b.ws')}>=0.5)),
 l as (select meeting_id, nm speaker, speaker_role, text, offset_s, duration_s from u where not exists (select 1 from s where s.meeting_id=u.meeting_id and s.nm=u.nm) union all select meeting_id, speaker, speaker_role, text, offset_s, duration_s from k)
 select meeting_id, speaker, speaker_role, offset_s, round(duration_s,6) duration_s, cast(row_number() over (partition by meeting_id order by offset_s, speaker, text)-1 as integer) idx from l""")  # fmt: skip
_ERRORS = [(None, "fetch failed: ECONNREFUSED"), (None, "schema: text must be a string"), (None, "the model did not return JSON"), (None, "boom"), (429, "slow down"), (503, "bad gateway"), (400, "bad request"), (0, "the call timed out"), (0, "API_KEY is not set"), (0, "no route to host")]
_CODES = ["network-failed", "schema-invalid", "model-bad-json", "crash", "model-rate-limited", "model-http", "model-http", "model-timeout", "model-unconfigured", "model-unreachable"]
_error = lambda w: w.runs.select("id", F.get(F.array(*(F.struct(F.lit(s).cast("int").alias("status"), F.lit(m).alias("message")) for s, m in _ERRORS)), (F.col("id") % len(_ERRORS)).cast("int")).alias("e"))
_add("cp_19_failure_codes", lambda w: _error(w).select("id", U.failure_code(F.col("e.message"), F.col("e.status")).alias("code")).select("*", U.label_of(F.col("code")).alias("label")),
     f"select id, ({_CODES})[id%10+1] code, (" + str([U.LABELS[c] for c in _CODES]).replace('"the model\'s JSON did not match the schema"', "'the model''s JSON did not match the schema'") + ")[id%10+1] as label from runs")
_tries = lambda w: w.runs.select(F.concat(F.lit("s"), (F.col("id") % 500).cast("string")).alias("name"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("attempt"), (F.col("id") % 500).alias("k")).distinct().select("name", "attempt", (F.col("attempt") > F.col("k") % 5).alias("ok"), F.concat(F.lit("fetch failed "), "attempt").alias("message"), F.lit(None).cast("int").alias("http_status"), F.when((F.col("k") % 7 == 0) & (F.col("attempt") == 3), "deadline-exceeded").alias("stop"))
_add("cp_18_aimed_retry", lambda w: U.step_records(_tries(w)).select("name", "status", "attempts", "code", F.array_join("aimed_with", "|").alias("aimed_with")),
     "with k as (select distinct id%500 k from runs) select 's'||cast(k as varchar) as name, case when k%5=0 then 'ok' when k%5=1 then 'retried' when k%7=0 then 'skipped' when k%5=2 then 'retried' else 'failed' end status, cast(case when k%5=0 then 1 when k%5=1 then 2 when k%7=0 then 2 else 3 end as integer) attempts, case when k%5<2 then null when k%7=0 then 'deadline-exceeded' when k%5=2 then null else 'network-failed' end code, case when k%5=0 then '' when k%5=1 then 'fetch failed 1' else 'fetch failed 1|fetch failed 2' end aimed_with from k")
_add("cp_20_first_failure", lambda w: _steps(w).select("id", U.first_failure(F.col("steps"))["name"].alias("step")), "select id, case when outcome='failed' then case when id%2=0 then 'core:recap' else 'notes' end when id%11=0 then 'index' when outcome='partial' then case when id%2=0 then 'core:recap' else 'notes' end end step from runs")
_summaries = lambda w: w.meetings.select(F.col("id").alias("doc_id"), _conv().alias("k"), F.explode(F.array(F.lit(1), F.lit(2))).alias("attempt")).select("doc_id", "attempt", F.when((F.col("k") % 3 == 0) | (F.col("k") % 3 == 1) & (F.col("attempt") == 2), _BAD_OR[0]).otherwise(_BAD_OR[1]).alias("json"))
_BAD_OR = ['{"themes":[{"text":"A","children":[{"text":"b","source":["S001"]}]}]}', '{"themes":[{"text":"A","children":[{"text":"b","children":[{"text":"c","source":["S001"]}]}]}]}']
_add("cp_23_structured_summary", lambda w: P.structured_summaries(_summaries(w)),
     "select id doc_id, case k when 0 then 1 else 2 end::integer attempt, case when k<2 then 'shipped' else 'failed' end status, case when k=2 then 'schema validation failed: : exceeds the maximum outline depth of 2' end feedback from (select id, cast(substr(id,2) as bigint)%3 k from meetings)")
_NODE = "person:person-1"
_add("cp_26_node_context", lambda w: A.node_context(w, _NODE).select("part", "rank", "text", "n"),
     f"""with own as (select distinct m.id meeting_id, title, started_at from edges join meetings m on m.id=meeting_id where src='{_NODE}' or dst='{_NODE}'),
 c as (select '['||title||'] Person 1 owns: '||json_extract_string(body,'$.task')||coalesce(' (due '||json_extract_string(body,'$.due')||')','') line, min(lpad(cast(started_at as varchar),20,'0')||lpad(meeting_id,20,' ')||lpad(cast(id as varchar),20,'0')) mark, arg_min(started_at, (started_at, meeting_id, id)) s, arg_min(meeting_id, (started_at, meeting_id, id)) mi, arg_min(id, (started_at, meeting_id, id)) i from claims join own using (meeting_id) where gate='passed' and kind='action_item' and lower(json_extract_string(body,'$.owner'))='person 1' group by 1),
 b as (select distinct e.meeting_id, x id from (select meeting_id, unnest([src,dst]) x from edges) e join own using (meeting_id) where x<>'{_NODE}'), k as (select n.id, n.label, n.kind, count(*) n from b join nodes n on n.id=b.id and n.kind<>'meeting' group by 1,2,3)
 select 'meeting' part, cast(row_number() over (order by started_at, meeting_id) as integer) as rank, strftime(make_timestamp(started_at*1000),'%Y-%m-%d')||' — '||title as text, 1::bigint n from own
 union all select * from (select 'claim', cast(row_number() over (order by s, mi, i) as integer) r, line, 1 from c) where r<=12
 union all select * from (select kind, cast(row_number() over (partition by kind order by n desc, id) as integer) r, label, n from k) where (kind='person' and r<=6) or (kind='topic' and r<=8)""")  # fmt: skip
# --- sources and streams -----------------------------------------------------------------------
_add("src_4_bundles", lambda w: files.bundles(w.meetings, w.utterances, w.claims).select("meeting_id", "version", F.size("utterances").alias("u"), F.size("claims").alias("c")), "select m.id meeting_id, 1 as version, cast((select count(*) from utterances u where u.meeting_id=m.id) as integer) u, cast((select count(*) from claims c where c.meeting_id=m.id) as integer) c from meetings m")
#: Bundles of all meetings over a store that knows all but every fifth: every seventh file is cut off, every eleventh of another
#: version, every thirteenth has two lines of one index.
def _imported(w: World) -> DataFrame:
    of = F.substring("meeting_id", 2, 20).cast("long")
    store = BS.BundleStore(w.spark, f"{shared_dir(w.spark)}/bundles-{uuid.uuid4().hex}")
    every = files.bundles(w.meetings, w.utterances, w.claims)
    known = every.where(of % 5 != 0).withColumns({"meeting": F.col("meeting").withField("title", F.lit("before")), "claims": F.slice("claims", 1, 0)})
    text = lambda df: df.select("meeting_id", F.to_json(F.struct("version", "meeting", "utterances", "claims")).alias("value"))
    store.import_texts(text(known).withColumnRenamed("meeting_id", "file"))
    new = every.withColumn("version", F.when(of % 11 == 0, 2).otherwise(1)).withColumn("utterances", F.when(of % 13 == 0, F.concat("utterances", F.slice("utterances", 1, 1))).otherwise(F.col("utterances")))
    cut = F.when(of % 7 == 0, F.substring("value", 1, 40)).otherwise(F.col("value"))
    report = store.import_texts(text(new).select(F.col("meeting_id").alias("file"), cut.alias("value")))
    n = lambda df, c: df.groupBy("meeting_id").agg(F.count("*").alias(c))
    state = store.meetings().select(F.col("id").alias("meeting_id"), "title").join(n(store.utterances(), "lines"), "meeting_id", "left").join(n(store.claims(), "n_claims"), "meeting_id", "left")
    return report.select(F.col("file").alias("meeting_id"), "status").join(state, "meeting_id", "left").na.fill(0, ["lines", "n_claims"])


_add("src_5_import", _imported,
     """with k as (select id meeting_id, cast(substr(id,2) as bigint) c from meetings), s as (select meeting_id, c, case when c%7=0 then 'failed' when c%11=0 then 'skipped' when c%13=0 then 'failed' else 'imported' end status from k)
  select meeting_id, status, case when status='imported' then (select title from meetings m where m.id=meeting_id) when c%5<>0 then 'before' end title,
    case when status='imported' or c%5<>0 then (select count(*) from utterances u where u.meeting_id=s.meeting_id) else 0 end lines,
    case when status='imported' then (select count(*) from claims l where l.meeting_id=s.meeting_id) else 0 end n_claims from s""")  # fmt: skip
_add("src_9_payload_shapes", lambda w: SG.from_payloads(w.utterances.groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct("idx", "speaker", "text", "offset_s"))).alias("x")).select("meeting_id", F.when(F.col("meeting_id") < "m5", F.to_json("x")).otherwise(F.to_json(F.struct(F.col("x").alias("segments")))).alias("payload"))).select("meeting_id", F.col("idx").cast("long").alias("idx"), "speaker", "text", "offset_s"), "select meeting_id, idx, speaker, text, offset_s from utterances")
_add("str_1_channel_routing", lambda w: L.routed(_frames(w)).select("utterance_id", "speaker", "speaker_role"), "select meeting_id||'-'||cast(idx as varchar) utterance_id, case when speaker_role='agent' then 'You' else 'Them' end speaker, speaker_role from utterances")
_add("str_2_finals", lambda w: L.finals(_frames(w).withColumn("utterance_id", F.concat("meeting_id", F.lit("-"), F.floor(F.col("seq") / 2).cast("string"))).withColumn("final", F.col("seq") % 3 != 0)).select("utterance_id", "seq"), "select meeting_id||'-'||cast(idx//2 as varchar) utterance_id, max(idx) seq from utterances where idx%3<>0 group by 1")
_add("str_3_event_offset", lambda w: _u(w, v=L.event_offset(F.lit(10.0), F.col("offset_s") * 1000, F.lit(12000.0))), _us("10.0::double+greatest(0.0::double,(offset_s*1000-12000)/1000) v"))
_add("str_5_late_finals", lambda w: L.reindexed(w.utterances).select("meeting_id", "idx", "text"), "select meeting_id, cast(row_number() over (partition by meeting_id order by offset_s, speaker, text)-1 as integer) idx, text from utterances")
_add("str_6_resume", lambda w: L.resumed(w.utterances, w.utterances.where("idx < 2")).groupBy("meeting_id").agg(F.max("offset_s").alias("last")), "select meeting_id, max(offset_s+duration_s)+2+max(case when idx<2 then offset_s end) as last from utterances group by 1")
_add("str_7_ring_buffer", lambda w: U.ring_buffer(w.runs.select("meeting_id", F.col("id").alias("seq")), "meeting_id", 20), "select meeting_id, id seq from (select *, row_number() over (partition by meeting_id order by id desc) n from runs) where n<=20")
_add("str_8_single_flight", lambda w: w.runs.dropDuplicates(["meeting_id", "kind"]).select("meeting_id", "kind"), "select distinct meeting_id, kind from runs")
_add("str_9_empty_cause", lambda w: w.runs.select("id", L.empty_cause(F.col("id") % 2, F.when(F.col("id") % 5 == 0, "x")).alias("v")), "select id, case when id%5=0 then 'recogniser-error' when id%2=0 then 'no-audio' else 'silence' end v from runs")
_add("str_10_sessions", lambda w: L.sessions(w.raw("events"), "2 hours"), "with e as (select user_id, epoch_us(ts) t, case when epoch_us(ts)-lag(epoch_us(ts)) over (partition by user_id order by ts) < 7200000000 then 0 else 1 end n from events), s as (select *, sum(n) over (partition by user_id order by t rows unbounded preceding) g from e) select user_id, min(t)//1000 start_ms, max(t)//1000 end_ms, count(*) n from s group by user_id, g having max(t)//1000-min(t)//1000>=15000")
_add("str_11_run_pairing", lambda w: M.ledger(w.runs.select("id", "kind", "started_at"), w.runs.where("outcome <> 'failed'").select("id", "outcome", F.col("started_at").alias("ended_at"))).groupBy("failure").agg(F.count("*").alias("n")), "select case when outcome='failed' then 'crash' end failure, count(*) n from runs group by 1")
_BARE = "list_filter(string_split(trim(regexp_replace(regexp_replace(lower(text),'[^a-z0-9\\s]','','g'),'\\s+',' ','g')),' '), lambda x: length(x)>2)"
#: Every fourth line says the one before it again.
_again = lambda w: _frames(w).withColumn("text", F.when(F.col("seq") % 4 == 1, F.coalesce(F.lag("text").over(Window.partitionBy("meeting_id").orderBy("seq")), "text")).otherwise(F.col("text")))
_add("str_4_echo_gate", lambda w: ST.gate_echoes(_again(w)),
     f"with s as (select meeting_id, idx, speaker_role, offset_s, case when idx%4=1 then coalesce(lag(text) over (partition by meeting_id order by idx), text) else text end as text from utterances), u as (select *, {_BARE} ws from s), e as (select distinct a.meeting_id, a.idx from u a join u b on a.meeting_id=b.meeting_id and a.speaker_role='agent' and b.speaker_role='customer' and len(a.ws)>=4 and b.offset_s<=a.offset_s and a.offset_s-b.offset_s<=20 and len(list_filter(a.ws, lambda x: list_contains(b.ws, x)))>=0.6*len(a.ws)) select meeting_id, meeting_id||'-'||cast(idx as varchar) utterance_id, exists (select 1 from e where e.meeting_id=s.meeting_id and e.idx=s.idx) echo from s where speaker_role='agent'")
_two = lambda w: _frames(w).withColumn("utterance_id", F.concat("meeting_id", F.lit("-"), F.floor(F.col("seq") / 2).cast("string"))).withColumn("final", F.col("seq") % 3 != 0)
_add("str_2_persisted_finals", lambda w: ST.persist_finals(_two(w).withColumn("speaker", F.lit("S"))).select("meeting_id", "utterance_id", "seq", F.col("idx").cast("int").alias("idx")),
     "select meeting_id, utterance_id, seq, cast(row_number() over (partition by meeting_id order by seq)-1 as integer) idx from (select meeting_id, meeting_id||'-'||cast(idx//2 as varchar) utterance_id, max(idx) seq from utterances where idx%3<>0 group by 1, 2)")
#: Runs that fail write no finish; the others end some seconds after they began.
_begins = lambda w: w.runs.select("id", "kind", F.timestamp_millis("started_at").alias("started_at"))
_ends = lambda w: w.runs.where("outcome <> 'failed'").select("id", "outcome", F.timestamp_millis(F.col("started_at") + F.col("id") % 900 * 1000).alias("ended_at"))
_add("str_11_paired_streams", lambda w: ST.pair_runs(_begins(w), _ends(w)).select("id", "kind", "outcome", "failure", F.unix_millis("ended_at").alias("ended_ms")),
     "select id, kind, outcome, case when outcome='failed' then 'crash' end failure, case when outcome<>'failed' then started_at+id%900*1000 end ended_ms from runs")
_add("seg_segments", lambda w: SG.segments(w.utterances).select("meeting_id", "id", "speaker", "start_ms"), f"with {_SEG} select meeting_id, id, speaker, start_ms from segs")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, path, f=f: f(World(spark, path))) for name, (f, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: oracle(sql) for name, (_, sql) in _FOUND.items() if sql}
