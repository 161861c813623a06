"""Claims, meetings, people and projects: filters, joins, roll-ups, top-k (FLT-*, JN-1..8, AG-*, TK-*)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import text as T
from parley.operators.chunks import claim_label
from parley.operators.gates import grounded

CLAIM_KINDS = ["decision", "action_item", "risk", "moment", "objection"]
#: Fixed value: questions that ask for a list.
ENUMERATIVE = (
    r"(?i)\b(list|all|every|open|pending|outstanding)\b.*\b(action items?|next steps?|decisions?|to-?dos?|tasks?|risks?|commitments?)\b"
    r"|\b(action items?|next steps?|decisions?|to-?dos?|tasks?)\b.*\b(so far|till now|until now|currently|open|pending)\b"
    r"|what (are|were) the (last |latest )?(agreed( upon)? )?(next steps|action items|decisions)"
)
#: Fixed value: questions about done items, too.
EVERYTHING = r"(?i)all|every|done|completed"
#: Titles that nobody chose.
DEFAULT_TITLE = r"^Untitled meeting$|^Meeting [0-9]|^Quick capture "


def claim_kind(kind: str | None) -> str:
    """A known kind, else action_item (FLT-3)."""
    return kind if kind in CLAIM_KINDS else "action_item"


def passed(claims: DataFrame, kind: str | None, open_only: bool = False) -> DataFrame:
    """Passed claims of a kind, optional conditions assembled on the way (FLT-1, FLT-2)."""
    tests = [F.col("gate") == "passed", F.col("kind") == claim_kind(kind)]
    if open_only:
        tests.append(F.col("done") == 0)
    return claims.where(reduce(lambda a, b: a & b, tests))


def list_claims(claims: DataFrame, meetings: DataFrame, kind: str | None = None, open_only: bool = False, since_ms: int | None = None, limit: int | None = 50, edited: bool = False) -> DataFrame:
    """Newest first; without a limit all, in no order. The body is the stored one; only with edited does a human edit override it (FLT-9)."""
    m = meetings.select(F.col("id").alias("meeting_id"), "title", "started_at")
    if since_ms is not None:
        m = m.where(F.col("started_at") >= since_ms)
    rows = passed(claims, kind, open_only).join(m, "meeting_id")
    rows = rows.withColumn("b", F.coalesce("edited_body", "body") if edited else F.col("body"))
    out = rows.select("id", "kind", claim_label("b", "quote").alias("label"), F.get_json_object("b", "$.owner").alias("owner"), F.get_json_object("b", "$.due").alias("due"), (F.col("done") != 0).alias("done"), "quote", "offset_s", "meeting_id", "title", iso_day(F.col("started_at")).alias("meeting_date"), "started_at")
    return (out if limit is None else out.orderBy(F.desc("started_at"), "id").limit(limit)).drop("started_at")


def iso_day(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd")


def todo(claims: DataFrame, meetings: DataFrame, limit: int) -> DataFrame:
    """Action items, open ones first, then newest (TK-2)."""
    rows = passed(claims, "action_item").join(meetings.select(F.col("id").alias("meeting_id"), "started_at"), "meeting_id")
    return rows.select("id", "meeting_id", "done", "started_at").orderBy("done", F.desc("started_at"), "id").limit(limit)


def brain_counts(meetings: DataFrame, entities: DataFrame, claims: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: four counts and the newest meeting (AG-1)."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    parts = [meetings.agg(F.count("*").alias("meetings"), F.max("started_at").alias("newest_meeting")), one(entities.where("merged_into is null"), "entities"), one(claims.where("gate = 'passed'"), "claims"), one(chunks, "chunks")]
    return reduce(lambda a, b: a.join(F.broadcast(b)), parts)


def list_meetings(meetings: DataFrame, claims: DataFrame, utterances: DataFrame, limit: int | None = 20, since_ms: int | None = None) -> DataFrame:
    """Meetings, newest first (without a limit all, in no order), with counts and participants (AG-2, AG-3, TK-1)."""
    recent = meetings if since_ms is None else meetings.where(F.col("started_at") >= since_ms)
    top = recent if limit is None else recent.orderBy(F.desc("started_at"), "id").limit(limit)
    chosen = top.select(F.col("id").alias("meeting_id"))
    claims, utterances = (df.join(chosen, "meeting_id", "left_semi") for df in (claims, utterances))
    c = claims.where("gate = 'passed'").groupBy(F.col("meeting_id").alias("id")).agg(F.count_if(F.col("kind") == "decision").alias("decisions"), F.count_if(F.col("kind") == "action_item").alias("action_items"))
    s = utterances.where("speaker is not null").groupBy(F.col("meeting_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("speaker")), ",").alias("participants"))
    zero = lambda x: F.coalesce(x, F.lit(0).cast("long")).alias(x)
    return top.join(c, "id", "left").join(s, "id", "left").select("id", "title", "mode", "started_at", "duration_s", zero("decisions"), zero("action_items"), "participants")


def claim_owners(claims: DataFrame, people: DataFrame) -> DataFrame:
    """(id, owner, person_id): the person whose name is the owner in any case, if any (JN-2)."""
    c = passed(claims, "action_item").select("id", F.get_json_object("body", "$.owner").alias("owner"))
    p = people.select(F.lower("name").alias("key"), F.col("id").alias("person_id"))
    return c.join(p, F.lower("owner") == F.col("key"), "left").select("id", "owner", "person_id")


def unknown_speakers(utterances: DataFrame, people: DataFrame) -> DataFrame:
    """Speakers that are not in the directory (JN-6)."""
    s = utterances.where("speaker is not null").select("speaker").distinct()
    return s.join(people.select(F.lower("name").alias("key")), F.lower("speaker") == F.col("key"), "left_anti")


def per_project(claims: DataFrame, meeting_projects: DataFrame, projects: DataFrame, kind: str) -> DataFrame:
    """(id, name, n) of passed claims of a kind in a project's meetings, 0 where none (AG-5)."""
    n = passed(claims, kind).join(meeting_projects, "meeting_id").groupBy(F.col("project_id").alias("id")).agg(F.count("*").alias("n"))
    return projects.select("id", "name").join(n, "id", "left").select("id", "name", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def top_topics(mentions: DataFrame, entities: DataFrame, meetings: DataFrame, kind: str, limit: int) -> DataFrame:
    """Entities of a kind by distinct meetings, with mentions, last seen and the best-scored quote of any
    gate (AG-6, AG-7)."""
    e = entities.where((F.col("kind") == kind) & F.col("merged_into").isNull()).select(F.col("id").alias("entity_id"), "label")
    ok = mentions.where("gate = 'passed'").join(meetings.select(F.col("id").alias("meeting_id"), "started_at"), "meeting_id")
    stats = ok.groupBy("entity_id").agg(F.count_distinct("meeting_id").alias("meetings"), F.count("*").alias("mentions"), F.max("started_at").alias("last_seen"))
    quote = mentions.where("quote is not null").groupBy("entity_id").agg(F.min_by("quote", F.struct(-F.col("score"), "meeting_id", "quote")).alias("quote"))
    rows = stats.join(e, "entity_id").join(quote, "entity_id", "left")
    return rows.orderBy(F.desc("meetings"), F.desc("mentions"), "entity_id").limit(limit).select("entity_id", "label", "meetings", "mentions", "last_seen", "quote")


def strongest_topic(mentions: DataFrame) -> DataFrame:
    """(meeting_id, entity_id): by number of passed mentions, then by their scores (AG-13)."""
    g = mentions.where("gate = 'passed'").groupBy("meeting_id", "entity_id").agg(F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("s"))
    return g.groupBy("meeting_id").agg(F.min_by("entity_id", F.struct(-F.col("n"), -F.col("s"), "entity_id")).alias("entity_id"))


def speaker_stats(utterances: DataFrame) -> DataFrame:
    """(meeting_id, speaker, lines, first_at, sample): the sample is the speaker's first line (AG-12)."""
    return utterances.where("speaker is not null").groupBy("meeting_id", "speaker").agg(F.count("*").alias("lines"), F.min("offset_s").alias("first_at"), F.min_by("text", "idx").alias("sample"))


def minutes(utterances: DataFrame, meetings: DataFrame) -> DataFrame:
    """(id, minutes): the integer part of (last offset + 59) / 60, else of the duration's; 0 is null (SN-5)."""
    last = utterances.groupBy(F.col("meeting_id").alias("id")).agg(F.max("offset_s").alias("last"))
    whole = lambda c: (c + 59) / 60
    value = F.coalesce(whole(F.col("last")), whole(F.col("duration_s"))).cast("int")
    return meetings.join(last, "id", "left").select("id", F.when(value != 0, value).alias("minutes"))


def lookup(entities: DataFrame, name: str) -> DataFrame:
    """At most one live entity: by id, else by exact normalised alias, else by the shortest alias that
    holds the name (TK-5, TK-6)."""
    e = entities.where("merged_into is null")
    norm = T.normalize(F.lit(name))
    rung = F.when(F.col("id") == name, 1).when(F.col("norm") == norm, 2).when(F.contains("norm", norm), 3)
    return e.withColumn("rung", rung).where("rung is not null").orderBy("rung", F.length("norm"), "id").limit(1).select("id", "kind", "label", "rung")


def is_enumerative(question: Column) -> Column:
    """Whether a question is answered from the claims, completely (FLT-14)."""
    return question.rlike(ENUMERATIVE)


def asked_kind(question: Column) -> Column:
    """The kind of claim a question asks for: decisions, risks, else action items."""
    return F.when(question.rlike("(?i)decision"), "decision").when(question.rlike("(?i)risk"), "risk").otherwise("action_item")


def asked_open(question: Column) -> Column:
    """Only open action items are meant unless the question says otherwise; other kinds have no state."""
    return (asked_kind(question) == "action_item") & ~question.rlike(EVERYTHING)


def enumerate_claims(claims: DataFrame, meetings: DataFrame, kind: str, open_only: bool, scope: DataFrame | None = None) -> DataFrame:
    """Every passed claim of a kind, with its label, and as a line with owner and due date; scope: meeting ids
    of a project (CP-10, JN-27)."""
    rows = passed(claims, kind, open_only)
    if scope is not None:
        rows = rows.join(scope.select("meeting_id").distinct(), "meeting_id", "left_semi")
    field = lambda k, before, after: F.when(F.coalesce(F.get_json_object("body", f"$.{k}"), F.lit("")) != "", F.concat(F.lit(before), F.get_json_object("body", f"$.{k}"), F.lit(after))).otherwise("")
    label = claim_label("body", "quote")
    text = F.concat(label, field("owner", " — ", ""), field("due", " (due ", ")"))
    return rows.join(meetings.select(F.col("id").alias("meeting_id"), "title", "started_at"), "meeting_id").select("id", "meeting_id", "title", "started_at", label.alias("label"), text.alias("text"), F.coalesce("quote", F.lit("")).alias("quote"), F.coalesce("offset_s", F.lit(0.0)).alias("offset_s"))


def enumeration_summary(rows: DataFrame, noun: str, in_project: bool = False) -> DataFrame:
    """One sentence: how many, in how many meetings, or that there are none (AG-23)."""
    counts = rows.agg(F.count("*").alias("n"), F.count_distinct("meeting_id").alias("m"))
    many = lambda c, one: F.concat(c.cast("string"), F.lit(f" {one}"), F.when(c == 1, "").otherwise("s"))
    found = F.concat(many(F.col("n"), noun), F.lit(" across "), many(F.col("m"), "meeting"), F.lit(", newest first."))
    return counts.select("n", "m", F.when(F.col("n") > 0, found).otherwise(f"No {noun}s found{' in this project' if in_project else ''}.").alias("summary"))


def default_title(title: Column) -> Column:
    """A title that nobody chose (FLT-12)."""
    return title.rlike(DEFAULT_TITLE)


def titled(meetings: DataFrame, mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, title) of meetings (id, title, headline, started_at): one that nobody chose gives way to the headline,
    else to the strongest topic and the day; a title is at most 60 characters (SC-23)."""
    topics = entities.where("kind = 'topic'").select(F.col("id").alias("entity_id"), "label")
    best = strongest_topic(mentions.join(topics.select("entity_id"), "entity_id", "left_semi")).join(topics, "entity_id").select(F.col("meeting_id").alias("id"), "label")
    day = F.date_format(F.timestamp_millis("started_at"), "MMM d")
    rows = meetings.join(best, "id", "left")
    new = F.coalesce(F.nullif(F.trim("headline"), F.lit("")), F.concat("label", F.lit(" — "), day))
    return rows.select("id", F.when(default_title(F.col("title")), F.coalesce(T.clipped(new), "title")).otherwise(F.col("title")).alias("title"))


def resolve_owners(actions: DataFrame, utterances: DataFrame) -> DataFrame:
    """actions (meeting_id, id, owner, task) -> (meeting_id, id, owner): a role gives way to the speaker of that
    role whose line holds most of the task's words of four letters or more, the earliest of equals; without any
    to the role's only speaker; else it stays. Names stay as they are (SC-22)."""
    role = F.lower("owner")
    asked = actions.where(role.isin("agent", "customer")).select("meeting_id", "id", role.alias("speaker_role"), F.filter(F.split(F.lower("task"), r"\s+"), lambda w: F.length(w) > 3).alias("words"))
    spoken = utterances.where("coalesce(speaker, '') <> ''").select("meeting_id", "speaker_role", "speaker", "idx", F.lower("text").alias("said"))
    hits = F.size(F.filter("words", lambda w: F.contains("said", w)))
    met = asked.join(spoken, ["meeting_id", "speaker_role"]).withColumn("hits", hits).where("hits > 0")
    best = met.groupBy("meeting_id", "id").agg(F.min_by("speaker", F.struct(-F.col("hits"), "idx")).alias("best"))
    only = spoken.groupBy("meeting_id", "speaker_role").agg(F.min("speaker").alias("a"), F.max("speaker").alias("b")).where("a = b").select("meeting_id", "speaker_role", F.col("a").alias("only"))
    found = asked.join(best, ["meeting_id", "id"], "left").join(only, ["meeting_id", "speaker_role"], "left").select("meeting_id", "id", F.coalesce("best", "only").alias("name"))
    return actions.join(found, ["meeting_id", "id"], "left").select("meeting_id", "id", F.coalesce("name", "owner").alias("owner"))


def assembled(recaps: DataFrame, utterances: DataFrame) -> DataFrame:
    """recaps -> (meeting_id, kind, pos, body, offset_s, quote, gate, gate_reason): the claims of a recap, each
    with the quote or offset that grounds it, passed or blocked (GT-22).

    recaps: meeting_id, moments array<struct<offset_s,text>>, risk_signals array<struct<quote,text>>, objections
    array<struct<text>>, key_decisions array<string>, action_items array<struct<task,owner,due>>."""
    none, text = F.lit(None).cast("double"), F.lit(None).cast("string")
    each = lambda c: recaps.select("meeting_id", F.posexplode(c).alias("pos", "x"))
    row = lambda df, kind, body, offset, quote: df.select("meeting_id", F.lit(kind).alias("kind"), "pos", body.alias("body"), offset.cast("double").alias("offset_s"), quote.alias("quote"))
    acts = each("action_items").select("meeting_id", F.col("pos").alias("id"), "x.owner", "x.task", "x.due")
    owned = acts.drop("owner").join(resolve_owners(acts, utterances), ["meeting_id", "id"]).withColumnRenamed("id", "pos")
    x = F.col("x")
    parts = [
        row(each("moments"), "moment", F.to_json("x"), x["offset_s"], text),
        row(each("risk_signals"), "risk", F.to_json("x"), none, x["quote"]),
        row(each("objections"), "objection", F.to_json("x"), none, x["text"]),
        row(each("key_decisions"), "decision", F.to_json(F.struct(x.alias("text"))), none, x),
        row(owned, "action_item", F.to_json(F.struct("task", "owner", "due")), none, F.col("task")),
    ]
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    found = grounded(rows.withColumn("id", F.concat_ws("|", "meeting_id", "kind", "pos")), utterances)
    return found.select("meeting_id", "kind", "pos", "body", "offset_s", "quote", F.when(F.col("gate_reason").isNull(), "passed").otherwise("blocked").alias("gate"), "gate_reason")


def upcoming(entries: DataFrame, as_of_ms: int, limit: int | None = 6) -> DataFrame:
    """The next entries from an hour ago on (without a limit all, in no order), manual ones before fetched ones of the same title and time
    (FLT-18, WN-10)."""
    rows = entries.where((F.col("at_ms") > as_of_ms - 3_600_000) & ((F.col("source") == "manual") | F.col("at_ms").between(as_of_ms - 300_000, as_of_ms + 48 * 3_600_000)))
    by = Window.partitionBy("title", "at_ms").orderBy(F.when(F.col("source") == "manual", 0).otherwise(1), "id")
    once = rows.withColumn("n", F.row_number().over(by)).where("n = 1")
    return (once if limit is None else once.orderBy("at_ms", "id").limit(limit)).select("id", "title", "at_ms", "source")


def newest_then_kept(meetings: DataFrame, keep: Column, scanned: int, kept: int) -> DataFrame:
    """A limit before a filter and one after it (FLT-15)."""
    return meetings.orderBy(F.desc("started_at"), "id").limit(scanned).where(keep).orderBy(F.desc("started_at"), "id").limit(kept)


def latest_run(runs: DataFrame, kind: str, scanned: int) -> DataFrame:
    """Per meeting, of its newest runs of any kind, the latest of one kind (WN-5)."""
    by = Window.partitionBy("meeting_id").orderBy(F.desc("started_at"), F.desc("id"))
    recent = runs.withColumn("n", F.row_number().over(by)).where(F.col("n") <= scanned).where(F.col("kind") == kind)
    return recent.groupBy("meeting_id").agg(F.min_by("id", "n").alias("id"), F.min_by("outcome", "n").alias("outcome"))
