"""Composite plans: ask, primer document, node context, project context (CP-9..12, CP-26, SRC-12)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.operators import claims as C
from parley.operators import graph as G
from parley.operators import retrieve as R
from parley.sources.adapters import AS_OF_MS, World

QUESTION = "what was said about the onhe thedou and the are"


def snippets(w: World, question: str = QUESTION, graph: bool = False) -> DataFrame:
    arms = (w.entities, G.related_edges(w.entities.where("kind = 'topic' and merged_into is null")), w.entity_mentions) if graph else None
    return R.retrieve(w.index.chunks(), w.meetings, question, AS_OF_MS, arms, ix=w.index)


def ask_extractive(w: World, question: str = QUESTION) -> DataFrame:
    return R.extractive_answer(snippets(w, question))


#: How much of a project a model is shown, and the confidence that a suggestion needs.
MEETINGS, PEOPLE, DOCS, MATCH_DOCS, DECISIONS, EXCERPT, PAGE, CONFIDENT = 12, 10, 8, 5, 5, 300, 9000, 0.5
#: Claims, people and topics of a node's context.
NODE_CLAIMS, NODE_PEOPLE, NODE_TOPICS = 12, 6, 8
#: Characters of lists of owners, in all, that are made beforehand and broadcast.
LISTS_CHARS = 1 << 26


def _top(df: DataFrame, part: str, by: list[str], order: list, most: int | None, text) -> DataFrame:
    """(keys, part, rank, text) of the first rows of each key."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    rows = df.select(*by, F.lit(part).alias("part"), rank.alias("rank"), text.alias("text"))
    return rows if most is None else rows.where(F.col("rank") <= most)


def project_context(meetings: DataFrame, claims: DataFrame, meeting_projects: DataFrame, project_people: DataFrame, documents: DataFrame, projects: DataFrame) -> DataFrame:
    """(project_id, part, rank, text): what a question about a project is answered from (CP-12): its newest meetings,
    the passed decisions and action items of all its meetings with these meetings' titles, its people with their
    teams, its latest documents. project_people: project_id, name, team; documents: project_id, id, title, content,
    summary, updated_at. projects restricts the result to the ids it holds."""
    of = lambda df: df.join(projects.select(F.col("id").alias("project_id")), "project_id", "left_semi")
    in_scope = of(meeting_projects)
    m = in_scope.join(meetings.select(F.col("id").alias("meeting_id"), "title", "started_at"), "meeting_id")
    newest = _top(m, "meeting", ["project_id"], [F.desc("started_at"), "meeting_id"], MEETINGS, F.concat("title", F.lit(" ("), C.iso_day(F.col("started_at")), F.lit(")")))
    field = lambda k: F.get_json_object(F.coalesce("edited_body", "body"), f"$.{k}")
    decided = F.concat(F.lit("Decision: "), F.coalesce(field("text"), F.lit("")))
    owner = F.when(F.coalesce(field("owner"), F.lit("")) != "", F.concat(F.lit(" — owner "), field("owner"))).otherwise("")
    acted = F.concat(F.lit("Action item"), F.when(F.col("done") != 0, " (done)").otherwise(""), F.lit(": "), F.coalesce(field("task"), F.lit("")), owner)
    c = claims.where("gate = 'passed' and kind in ('decision', 'action_item')").join(m, "meeting_id")
    line = F.concat(F.when(F.col("kind") == "decision", decided).otherwise(acted), F.lit(" ["), "title", F.lit("]"))
    told = _top(c, "claim", ["project_id"], ["id", "meeting_id"], None, line)
    people = _top(of(project_people), "person", ["project_id"], ["name"], None, F.concat("name", F.when(F.col("team").isNotNull(), F.concat(F.lit(" ("), "team", F.lit(")"))).otherwise("")))
    docs = _top(of(documents), "document", ["project_id"], [F.desc("updated_at"), "id"], DOCS, F.concat("title", F.lit("\n"), F.coalesce(F.concat(F.lit("Summary: "), "summary", F.lit("\n")), F.lit("")), F.substring(F.coalesce("content", F.lit("(no extractable text)")), 1, PAGE)))
    return newest.unionByName(told).unionByName(people).unionByName(docs)


def matching_context(meetings: DataFrame, claims: DataFrame, meeting_projects: DataFrame, project_people: DataFrame, documents: DataFrame) -> DataFrame:
    """(project_id, part, rank, text): what projects are matched by (CP-11): people, excerpts of the latest
    documents, and the decisions of their newest meetings."""
    people = _top(project_people, "person", ["project_id"], ["name"], PEOPLE, F.col("name"))
    docs = _top(documents, "document", ["project_id"], [F.desc("updated_at"), "id"], MATCH_DOCS, F.concat_ws(": ", "title", F.coalesce("summary", F.substring("content", 1, EXCERPT))))
    m = meeting_projects.join(meetings.select(F.col("id").alias("meeting_id"), "started_at"), "meeting_id")
    body = F.coalesce("edited_body", "body")
    d = C.passed(claims, "decision").join(m, "meeting_id")
    decided = _top(d, "decision", ["project_id"], [F.desc("started_at"), "id"], DECISIONS, F.coalesce(F.get_json_object(body, "$.text"), body))
    return people.unionByName(docs).unionByName(decided)


def matched(suggestions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Suggestions (meeting_id, project_id, confidence) of projects that were offered to the meeting, sure enough (CP-11)."""
    return suggestions.where(F.col("confidence") >= CONFIDENT).join(candidates.select("meeting_id", "project_id"), ["meeting_id", "project_id"], "left_semi")


def meeting_meta(meetings: DataFrame, utterances: DataFrame, people: DataFrame, shown: Callable[[Column], Column] = lambda names: names) -> DataFrame:
    """(meeting_id, participants, owners): who spoke, and who may own an action: they and the directory. Two sets on
    purpose, as nobody is present for being listed (CP-13). `shown` says in which form both lists are given."""
    each = utterances.where("speaker is not null").select("meeting_id", "speaker").distinct()
    known = people.where("name is not null").select(F.col("name").alias("speaker"), F.lit(True).alias("known")).distinct()
    # The directory is sorted once. A meeting adds the few speakers that it lacks; sorting a sorted list with a few more takes one
    # pass, where a union of sets would hash all names for each meeting.
    spoken = each.join(known, "speaker", "left").groupBy("meeting_id").agg(F.array_sort(F.collect_list("speaker")).alias("participants"), F.array_sort(F.collect_list(F.when(F.col("known").isNull(), F.col("speaker")))).alias("more"))
    none = F.array().cast("array<string>")
    rows = meetings.select(F.col("id").alias("meeting_id")).join(spoken, "meeting_id", "left").select("meeting_id", F.coalesce("participants", none).alias("participants"), F.coalesce("more", none).alias("more"))
    listed = people.agg(F.sort_array(F.collect_set("name")).alias("names"))  # one row: the people of a team's own directory
    owners = shown(F.sort_array(F.concat("names", "more"))).alias("owners")
    # Few short rows become long ones: dealt out by number, they are not put back into one task for being short.
    tasks = int(meetings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(tasks)
    # Meetings that lack the same speakers have the same list. Where few lists do for all, each is made once, not for every meeting.
    size = people.agg(F.sum(F.length("name") + 1)).first()[0] or 0
    most = LISTS_CHARS // (size + 1)
    lists = rows.select("more").distinct()
    if lists.limit(most + 1).count() <= most:
        dealt = dealt.join(F.broadcast(lists.join(F.broadcast(listed)).select("more", owners)), "more").select("meeting_id", "participants", "owners")
    else:
        dealt = dealt.join(F.broadcast(listed)).select("meeting_id", "participants", owners)
    return dealt.withColumn("participants", shown(F.col("participants")))


def node_context(w: World, node: str) -> DataFrame:
    """(part, rank, id, text, n) of a person or topic (CP-26): its meetings in time, what it owns or what was claimed
    about it there (the first dozen), and the people and topics beside it by number of shared meetings."""
    own = w.edges.where((F.col("src") == node) | (F.col("dst") == node)).select("meeting_id").distinct().join(w.meetings.select(F.col("id").alias("meeting_id"), "title", "started_at"), "meeting_id")
    timeline = F.concat(C.iso_day(F.col("started_at")), F.lit(" — "), "title")
    place = lambda *order: F.row_number().over(Window.orderBy(*order))
    part = lambda df, name, order, key, text, n: df.select(F.lit(name).alias("part"), place(*order).alias("rank"), key.alias("id"), text.alias("text"), n.cast("long").alias("n"))
    one = F.lit(1)
    meetings = part(own, "meeting", ["started_at", "meeting_id"], F.col("meeting_id"), timeline, one)
    label = w.nodes.where(F.col("id") == node).select(F.col("label").alias("node_label"), F.col("kind").alias("node_kind")).limit(1)
    field = lambda k: F.get_json_object("body", f"$.{k}")
    c = w.claims.where("gate = 'passed'").join(own, "meeting_id").join(F.broadcast(label))
    owns = (F.col("node_kind") == "person") & (F.col("kind") == "action_item") & (F.lower(field("owner")) == F.lower("node_label"))
    about = (F.col("node_kind") == "topic") & F.contains(F.lower(F.concat_ws(" ", F.coalesce(field("text"), F.lit("")), F.coalesce(field("task"), F.lit("")), F.coalesce("quote", F.lit("")))), F.lower("node_label"))
    due = F.when(field("due").isNotNull(), F.concat(F.lit(" (due "), field("due"), F.lit(")"))).otherwise("")
    held = F.concat(F.lit("["), "title", F.lit("] "), "node_label", F.lit(" owns: "), field("task"), due)
    said = F.concat(F.lit("["), "title", F.lit("] "), "kind", F.lit(": "), F.coalesce(field("text"), field("task")), F.coalesce(F.concat(F.lit(' — evidence: "'), "quote", F.lit('"')), F.lit("")))
    lines = c.where(owns | about).select("started_at", "meeting_id", "id", F.when(F.col("node_kind") == "person", held).otherwise(said).alias("line"))
    once = lines.groupBy("line").agg(F.min(F.struct("started_at", "meeting_id", "id")).alias("at"))
    claims = part(once, "claim", ["at"], F.col("at.id").cast("string"), F.col("line"), one).where(F.col("rank") <= NODE_CLAIMS)
    ends = w.edges.join(own.select("meeting_id"), "meeting_id", "left_semi")
    beside = ends.select("meeting_id", F.explode(F.array("src", "dst")).alias("id")).distinct().where(F.col("id") != node)
    counted = beside.groupBy("id").agg(F.count("*").alias("n")).join(w.nodes.where("kind <> 'meeting'"), "id")
    near = [part(counted.where(F.col("kind") == k), k, [F.desc("n"), "id"], F.col("id"), F.col("label"), F.col("n")).where(F.col("rank") <= most) for k, most in (("person", NODE_PEOPLE), ("topic", NODE_TOPICS))]
    return meetings.unionByName(claims).unionByName(near[0]).unionByName(near[1])


def primer(w: World, lines: int = 5) -> str:
    """The primer document: counts, top topics and people, open actions (SRC-12). Rendered on the driver from
    frames that are limited to a few rows each."""
    c = C.brain_counts(w.meetings, w.entities, w.claims, w.chunks).first()
    out = ["# Brain", "", f"{c['meetings']} meetings, {c['entities']} entities, {c['claims']} claims", "", "## Topics"]
    out += [f"- {r['label']} ({r['meetings']} meetings)" for r in C.top_topics(w.entity_mentions, w.entities, w.meetings, "topic", lines).collect()]
    out += ["", "## Open actions"]
    out += [f"- {r['label']}" for r in C.list_claims(w.claims, w.meetings, "action_item", True, limit=lines).collect()]
    return "\n".join(out) + "\n"
