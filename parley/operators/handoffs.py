"""Handoff documents: catalogue, routing, parsing, validation, pruning, rendering (HO-*, SC-24, SC-29, AG-20).

A document is JSON in the shape of its kind. Parsing turns it into rows, one for each thing it states, with
the path by which failures address it; the other steps work on rows whatever the kind."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import text as T
from parley.operators import gates as Q
from parley.operators import outline as O
from parley.operators.gates import UNASSIGNED


@dataclass(frozen=True)
class Section:
    """A part of a document: its JSON key, what it holds, its heading, and what replaces prose that fails.

    items: sourced lines. actions: lines with owner and due date. quotes: rows of a price table. groups:
    actions by owner. lean: one sourced line that must be a stated verdict. prose: one line without sources.
    lines: a text whose lines carry inline sources. themes: labels with examples from meetings. notes: an outline."""

    key: str
    kind: str
    heading: str = ""
    fallback: str = ""


@dataclass(frozen=True)
class Handoff:
    id: str
    label: str
    sections: tuple[Section, ...]
    title: str = ""
    scope: str = "meeting"


_PROSE_HEADLINE = "Update from today's meeting"
#: The catalogue in its order, with the shape of each document and its headings.
CATALOG = [
    Handoff("team_actions", "Team action items", (Section("perOwner", "groups"),), "Action items"),
    Handoff("pricing_quote", "Pricing quote", (Section("quotes", "quotes"), Section("unclear", "items", "Not quoted / unclear")), "Pricing"),
    Handoff("followup_email", "Follow-up email", (Section("subject", "prose", fallback="Follow-up on our conversation"), Section("body", "lines"))),
    Handoff("summary_next_steps", "Summary & next steps", (Section("themes", "notes"), Section("nextSteps", "actions", "Next steps"), Section("openQuestions", "items", "Open questions"))),
    Handoff("candidate_feedback", "Candidate feedback", (Section("signals", "items", "Signals observed"), Section("strengths", "items", "Strengths"), Section("concerns", "items", "Concerns"), Section("statedLean", "lean", "Stated lean", "None stated on the call — left for you to decide.")), "Interview feedback"),
    Handoff("investor_update", "Investor update", (Section("highlights", "items", "Highlights"), Section("metrics", "items", "Metrics"), Section("commitments", "actions", "Commitments"), Section("asks", "items", "Asks"))),
    Handoff("crm_note", "CRM note", (Section("needs", "items", "Needs & pain points"), Section("objections", "items", "Objections"), Section("signals", "items", "Buying signals"), Section("nextSteps", "actions", "Next steps"))),
    Handoff("negotiation_brief", "Negotiation brief", (Section("agreed", "items", "Agreed"), Section("open", "items", "Still open"), Section("risks", "items", "Risks raised"), Section("nextSteps", "actions", "Next steps"))),
    Handoff("slack_update", "Slack update", (Section("headline", "prose", fallback=_PROSE_HEADLINE), Section("points", "items", "What moved"), Section("blockers", "items", "Blockers"))),
    Handoff("one_on_one_recap", "1:1 recap", (Section("discussed", "items", "Discussed"), Section("commitments", "actions", "Commitments"), Section("flags", "items", "Worth watching"))),
    Handoff("collated_feedback", "Collated customer feedback", (Section("themes", "themes"),), scope="cross-meeting"),
]
BY_ID = {h.id: h for h in CATALOG}
#: What each meeting type suggests, the default first.
SUGGESTED = {
    "investor": ["team_actions", "investor_update", "followup_email"],
    "vendor": ["pricing_quote", "negotiation_brief", "followup_email"],
    "customer": ["followup_email", "crm_note", "collated_feedback"],
    "team": ["summary_next_steps", "team_actions", "slack_update"],
    "one_on_one": ["candidate_feedback", "one_on_one_recap"],
}
#: Words that ask for a document, in the order in which they are tried.
REQUESTS = [
    ("followup_email", r"\b(follow[- ]?up|followup)\s+(email|note|mail|message)\b|\bdraft\b[^?]*\b(email|mail|note|message)\b|\b(email|mail)\b[^?]*\b(recap|follow[- ]?up)\b"),
    ("pricing_quote", r"\b(pricing|price|rate)[- ]?(quote|table|card|sheet|breakdown|extract)\b|\bquotes?\b|\bprices? (they|he|she|the vendor) (quoted|gave|said)\b"),
    ("team_actions", r"\b(action items?|to-?dos?|commitments?)\b|\bwho owes\b|\bwho is doing what\b"),
    ("investor_update", r"\binvestor update\b|\bupdate (for|to) (the |my )?investors?\b"),
    ("crm_note", r"\bcrm (note|notes|entry|update)\b|\b(log|put) (this|it|the call) in(to)? (the )?crm\b"),
    ("negotiation_brief", r"\b(negotiation|vendor) (brief|summary|notes)\b|\bbefore (we|i) sign\b"),
    ("slack_update", r"\bslack (update|post|message)\b|\bstandup update\b|\bpost (an? )?update\b"),
    ("one_on_one_recap", r"\b(1:1|1on1|one[- ]on[- ]one)\s+(recap|notes?|summary)\b|\brecap (of |for )?(the |our )?(1:1|one[- ]on[- ]one)\b"),
    ("summary_next_steps", r"\b(summar(y|ise|ize)|readout|recap|next steps)\b"),
    ("candidate_feedback", r"\b(candidate|interview|hiring)\s+(feedback|write[- ]?up|notes|debrief)\b|\bwrite up the interview\b|\bfeedback on the candidate\b"),
    ("collated_feedback", r"\b(collate|collated|recurring (themes?|feedback|asks?)|common (themes?|feedback))\b|\bacross (all )?(my |the )?(customer )?(calls|meetings)\b"),
]
#: Verbs of a request, and openings that ask for an explanation unless such a verb follows.
REQUEST_VERBS = r"\b(draft|write|make|generate|create|prepare|build|pull|extract|collate|compile|give me|send me|show me|put together|turn (this|that) into)\b"
EXPLAIN = r"^(why|how|when|where|which|who|whose|whom)\b"
#: Kinds of feedback; another one is a request.
FEEDBACK = ["request", "objection", "praise", "churn_risk"]

_LINE = "struct<text:string,source:array<string>>"
_ACTION = "struct<text:string,task:string,owner:string,due:string,source:array<string>>"
_SHAPES = {
    "items": f"array<{_LINE}>",
    "actions": f"array<{_ACTION}>",
    "quotes": "array<struct<item:string,price:string,unit:string,terms:string,validUntil:string,source:array<string>>>",
    "groups": f"array<struct<owner:string,items:array<{_ACTION}>>>",
    "lean": _LINE,
    "prose": "string",
    "lines": "string",
    "themes": "array<struct<theme:string,kind:string,examples:array<struct<meetingId:string,source:array<string>>>>>",
}
ROW = ["doc_id", "meeting_id", "section", "pos", "path", "kind", "text", "owner", "due", "source", "cells"]


def match_handoff(message: Column) -> Column:
    """The first document whose words a request has; an opening that asks to explain gets none unless a
    verb of request follows (SC-29)."""
    out = F.lit(None).cast("string")
    for name, words in reversed(REQUESTS):
        out = F.when(message.rlike(f"(?i){words}"), name).otherwise(out)
    explain = F.trim(message).rlike(f"(?i){EXPLAIN}") & ~message.rlike(f"(?i){REQUEST_VERBS}")
    return F.when(~explain, out)


def suggested(meetings: DataFrame) -> DataFrame:
    """meetings (id, type) x catalogue: (id, handoff, rank, suggested, is_default): the place in the type's
    list, -1 outside it (HO-15)."""
    lists = F.create_map(*(x for kind, ids in SUGGESTED.items() for x in (F.lit(kind), F.array(*map(F.lit, ids)))))
    each = meetings.select("id", lists[F.col("type")].alias("list"), F.explode(F.array(*(F.lit(h.id) for h in CATALOG))).alias("handoff"))
    rank = (F.coalesce(F.array_position("list", F.col("handoff")), F.lit(0)) - 1).cast("int")
    return each.select("id", "handoff", rank.alias("rank"), (rank >= 0).alias("suggested"), (rank == 0).alias("is_default"))


def _clean(x: Column) -> Column:
    return F.regexp_replace(F.coalesce(x, F.lit("")), r"^\s+|\s+$", "")


def _none() -> Column:
    return F.array().cast("array<string>")


def _row(section: str, kind: str, pos: Column, path: Column, text: Column, owner: Column | None = None, due: Column | None = None, source: Column | None = None, cells: Column | None = None) -> list[Column]:
    null = F.lit(None).cast("string")
    values = [F.col("doc_id"), F.col("meeting_id"), F.lit(section), pos.cast("int"), path, F.lit(kind), text, null if owner is None else owner, null if due is None else due, _none() if source is None else F.coalesce(F.filter(source, lambda s: s.isNotNull()), _none()), _none() if cells is None else cells]
    return [v.alias(n) for n, v in zip(ROW, values)]


def _action(x: Column) -> tuple[Column, Column, Column]:
    """Text, or else task; owner, or else Unassigned; due date or null."""
    text, owner, due = F.coalesce(F.nullif(_clean(x["text"]), F.lit("")), _clean(x["task"])), _clean(x["owner"]), _clean(x["due"])
    return text, F.when(owner == "", UNASSIGNED).otherwise(owner), F.when(due != "", due)


def _stated(s: Section) -> Column:
    """The rows of one section as an array; lines without text are no lines, and positions count those that are left."""
    at = lambda p: F.concat(F.lit(f"{s.key}["), p.cast("string"), F.lit("]"))
    row = lambda *values, **more: F.struct(*_row(s.key, s.kind, *values, **more)[2:])
    held = F.col(f"d.{s.key}")
    if s.kind == "prose":
        return F.array(row(F.lit(0), F.lit(s.key), F.coalesce(F.nullif(_clean(held), F.lit("")), F.lit(s.fallback))))
    if s.kind == "lean":
        return F.array_compact(F.array(F.when(_clean(held["text"]) != "", row(F.lit(0), F.lit(s.key), _clean(held["text"]), source=held["source"]))))
    if s.kind == "lines":
        lines = F.filter(F.transform(F.split(_clean(held), "\n"), lambda x, i: F.struct(i.alias("i"), _clean(x).alias("x"))), lambda y: y["x"] != "")
        return F.transform(lines, lambda y: row(y["i"], at(y["i"]), T.strip_markers(y["x"]), source=T.inline_sources(y["x"])))
    text = {"items": lambda x: _clean(x["text"]), "actions": lambda x: _action(x)[0], "quotes": lambda x: _clean(x["price"])}[s.kind]
    cells = lambda x: F.array(F.coalesce(F.nullif(_clean(x["item"]), F.lit("")), F.lit("Unnamed item")), *(_clean(x[c]) for c in ("price", "unit", "terms", "validUntil")))
    form = {
        "items": lambda x, i: row(i, at(i), text(x), source=x["source"]),
        "actions": lambda x, i: row(i, at(i), *_action(x), source=x["source"]),
        "quotes": lambda x, i: row(i, at(i), F.array_join(F.filter(cells(x), lambda c: c != ""), " "), source=x["source"], cells=cells(x)),
    }[s.kind]
    return F.transform(F.filter(held, lambda x: text(x) != ""), form)


def _by_owner(d: DataFrame, s: Section) -> DataFrame:
    """Actions regrouped by their own owner, else by that of their group; owners in the order of their first
    action, Unassigned last (HO-12)."""
    groups = d.select("doc_id", "meeting_id", F.posexplode(f"d.{s.key}").alias("g", "x"))
    each = groups.select("doc_id", "meeting_id", "g", F.col("x.owner").alias("of"), F.posexplode("x.items").alias("i", "x"))
    text, own, due = _action(F.col("x"))
    of = _clean(F.col("of"))
    owner = F.when(own != UNASSIGNED, own).otherwise(F.when(of == "", UNASSIGNED).otherwise(of))
    rows = each.select("doc_id", "meeting_id", F.struct("g", "i").alias("at"), text.alias("text"), owner.alias("owner"), due.alias("due"), F.col("x.source").alias("source")).where("text <> ''")
    rows = rows.withColumn("first", F.min("at").over(Window.partitionBy("doc_id", "owner")))
    group = F.dense_rank().over(Window.partitionBy("doc_id").orderBy(F.col("owner") == UNASSIGNED, "first")) - 1
    item = F.row_number().over(Window.partitionBy("doc_id", "owner").orderBy("at")) - 1
    rows = rows.withColumn("group", group).withColumn("item", item)
    path = F.concat(F.lit(f"{s.key}["), F.col("group").cast("string"), F.lit("].items["), F.col("item").cast("string"), F.lit("]"))
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("group", "item")) - 1
    return rows.withColumn("pos", order).select(*_row(s.key, s.kind, F.col("pos"), path, F.col("text"), F.col("owner"), F.col("due"), F.col("source")))


def _themes(d: DataFrame, s: Section) -> DataFrame:
    """One row for each example of a theme, with the meeting's alias as owner and the kind in cells."""
    cited = lambda e: (_clean(e["meetingId"]) != "") & (F.size(F.filter(e["source"], lambda x: x.isNotNull())) > 0)
    kept = F.filter(F.transform(F.col(f"d.{s.key}"), lambda t: F.struct(_clean(t["theme"]).alias("theme"), _clean(t["kind"]).alias("kind"), F.filter(t["examples"], cited).alias("examples"))), lambda t: (t["theme"] != "") & (F.size(t["examples"]) > 0))
    each = d.select("doc_id", "meeting_id", F.posexplode(kept).alias("t", "x")).select("doc_id", "meeting_id", "t", F.col("x.theme").alias("theme"), F.col("x.kind").alias("k"), F.posexplode("x.examples").alias("e", "x"))
    path = F.concat(F.lit(f"{s.key}["), F.col("t").cast("string"), F.lit("].examples["), F.col("e").cast("string"), F.lit("]"))
    kind = F.when(F.col("k").isin(*FEEDBACK), F.col("k")).otherwise(FEEDBACK[0])
    return each.select(*_row(s.key, s.kind, F.col("t") * 1000 + F.col("e"), path, F.col("theme"), _clean(F.col("x.meetingId")), source=F.col("x.source"), cells=F.array(kind)))


def items(documents: DataFrame, handoff: Handoff) -> DataFrame:
    """documents (doc_id, meeting_id, json) -> rows (HO-1..11, parse). A document that is no JSON, or whose
    sections hold nothing, has no rows but its prose."""
    shape = "struct<" + ",".join(f"{s.key}:{_SHAPES[s.kind]}" for s in handoff.sections if s.kind != "notes") + ">"
    d = documents.select("doc_id", "meeting_id", F.from_json("json", shape).alias("d"))
    # A document is made and read once for all the sections that arrays can hold, not once for each.
    told = [s for s in handoff.sections if s.kind not in ("notes", "groups", "themes")]
    parts = [{"notes": lambda s: _notes(documents, s), "groups": lambda s: _by_owner(d, s), "themes": lambda s: _themes(d, s)}[s.kind](s) for s in handoff.sections if s not in told]
    if told:
        each = d.select("doc_id", "meeting_id", F.explode(F.flatten(F.array_compact(F.array(*map(_stated, told))))).alias("row"))
        parts.append(each.select("doc_id", "meeting_id", "row.*"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def _notes(documents: DataFrame, s: Section) -> DataFrame:
    """The leaves and labels of an outline under dotted paths."""
    rows = O.bullets(documents).join(documents.select("doc_id", "meeting_id"), "doc_id")
    path = O.path_text(F.col("path"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("path")) - 1
    return rows.withColumn("pos", place).withColumn("at", path).select(*_row(s.key, s.kind, F.col("pos"), F.col("at"), F.coalesce("text", F.lit("")), owner=F.when(F.col("is_leaf"), "leaf").otherwise("label"), source=F.col("source")))


def empty_documents(documents: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc_id): documents of which nothing but prose was read; they are sent back, not shipped."""
    return documents.select("doc_id").join(rows.where("kind <> 'prose'").select("doc_id"), "doc_id", "left_anti")


def validate(rows: DataFrame, segs: DataFrame, owners: DataFrame, kinds: set[str] | None = None) -> DataFrame:
    """(doc_id, path, rule, detail) of rows that their sources do not carry. owners: meeting_id, names; kinds: those
    of the sections, by default all, of which only the rules are planned.

    Rows whose sources fail are not checked further. Prose, and lines without sources, may state no figure
    and quote nobody. A line's figures and quotations must stand in its cited segments, those of an action
    with its due date; an action's owner must be known, a lean must be stated, an example must be of the
    meeting it is filed under, and a theme's label must claim nothing its examples do not carry."""
    key = F.concat("doc_id", F.lit("|"), "path")
    r = rows.where("not (kind = 'notes' and owner = 'label')").withColumn("key", key)
    bare = (F.col("kind") == "prose") | (F.col("kind") == "lines") & (F.size("source") == 0)
    parts = [Q.unsourced_failures(r.where(bare).select(F.col("key").alias("path"), "text")).select("path", "rule", "detail")]
    sourced = r.where(~bare)
    unknown = Q.source_failures(sourced.select("meeting_id", F.col("key").alias("path"), "source"), segs).select("path", "rule", F.col("id").alias("detail"))
    has = lambda *some: kinds is None or bool(kinds & {*some})
    bad = unknown.select("path").distinct()
    # All rows, or nearly: never broadcast, whatever the files they come from let expect (also below, in render).
    good = sourced.join(bad, sourced["key"] == bad["path"], "left_anti").hint("merge")
    stated = F.when(F.col("due").isNotNull(), F.concat("text", F.lit(" "), "due")).otherwise(F.col("text"))
    # Lines that say the same from the same segments are judged once.
    alike = ["meeting_id", "source", "text", "stated"]
    good = good.withColumn("stated", stated)
    cites = Q.cited_texts(good, segs)
    said = good.select(*alike).distinct().join(cites, ["meeting_id", "source"]).withColumn("path", F.struct(*alike))
    amiss = Q.verbatim_failures(said.select("path", F.col("stated").alias("text"), "cited")).unionByName(Q.quote_failures(said.select("path", "text", "texts")))
    parts += [unknown, good.select(F.struct(*alike).alias("of"), F.col("key").alias("path")).join(amiss.withColumnRenamed("path", "of"), "of").select("path", "rule", "detail")]
    cited = good.where("kind in ('lean', 'themes')").join(cites, ["meeting_id", "source"]).select(F.col("key").alias("path"), "kind", "text", "cited")
    if has("actions", "groups"):
        who = sourced.where("kind in ('actions', 'groups')").join(owners.select("meeting_id", F.transform("names", lambda n: F.lower(n)).alias("names")), "meeting_id", "left")
        reason = Q.owner_reason(F.col("owner"), F.coalesce("names", _none()))
        parts.append(who.select(F.col("key").alias("path"), F.lit("owner-whitelist").alias("rule"), reason.alias("detail")).where("detail is not null"))
    if has("lean"):
        lean = Q.verdict_reason(F.col("text"), F.col("cited"), T.flat(F.col("cited")))
        parts.append(cited.where("kind = 'lean'").select("path", F.lit("stated-verdict").alias("rule"), lean.alias("detail")).where("detail is not null"))
    if has("themes"):
        parts.append(Q.foreign_citations(sourced.where("kind = 'themes'").select(F.col("key").alias("path"), F.col("owner").alias("meeting"), "source")))
        label = F.regexp_extract("path", r"^(.*\|themes\[\d+\])", 1)
        heads = cited.where("kind = 'themes'").groupBy(label.alias("path")).agg(F.first("text").alias("text"), F.array_join(F.array_sort(F.collect_set("cited")), " ").alias("leaf_text")).withColumn("names", _none())
        parts.append(Q.header_failures(heads))
    found = reduce(lambda a, b: a.unionByName(b), [p.select("path", "rule", "detail") for p in parts])
    at = F.split("path", r"\|", 2)
    return found.select(at[0].alias("doc_id"), at[1].alias("path"), "rule", "detail")


def path_index(path: Column, prefix: str) -> Column:
    """The i of `prefix[i]`, else null (HO-13)."""
    found = F.regexp_extract(path, rf"^\Q{prefix}\E\[(\d+)\]", 1)
    return F.when(found != "", found.cast("int"))


def prune(rows: DataFrame, failures: DataFrame, handoff: Handoff | None = None) -> DataFrame:
    """Rows without those whose path, or whose theme's or outline's label, failed (HO-13). Prose that failed
    is replaced by its fallback, never trimmed."""
    bad = failures.select("doc_id", F.col("path").alias("bad")).distinct()
    own = lambda df, path: (df["doc_id"] == bad["doc_id"]) & (path == bad["bad"])
    rest = rows.where("kind <> 'prose'")
    # Two equi-joins: one with OR would set each row of a document against all of its failures.
    rest = rest.join(bad, own(rest, rest["path"]), "left_anti")
    rest = rest.join(bad, own(rest, F.regexp_replace(rest["path"], r"\.examples\[\d+\]$", "")), "left_anti")
    prose = rows.where("kind = 'prose'")
    said = F.lit("")
    for s in handoff.sections if handoff else ():
        said = F.when(prose["section"] == s.key, s.fallback).otherwise(said)
    text = F.when(F.col("bad").isNotNull(), said).otherwise(prose["text"])
    prose = prose.join(bad, own(prose, prose["path"]), "left").select(*(text.alias(c) if c == "text" else prose[c] for c in rows.columns))
    return rest.unionByName(prose)


def regroup(rows: DataFrame) -> DataFrame:
    """(doc_id, owner, n, texts, last, first) of actions: owners in order of their first one, Unassigned last (HO-12)."""
    g = rows.groupBy("doc_id", "owner").agg(F.min("pos").alias("first"), F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]).alias("texts"))
    return g.select("doc_id", "owner", "n", "texts", F.when(F.col("owner") == UNASSIGNED, 1).otherwise(0).alias("last"), "first")


def _line(low: Column) -> Column:
    """A row as a line of markdown, by its kind."""
    poor = F.when(low, " _(heard poorly — verify)_").otherwise("")
    action = F.concat(F.lit("- [ ] **"), "owner", F.lit("** — "), "text", F.when(F.col("due").isNotNull(), F.concat(F.lit(" _("), "due", F.lit(")_"))).otherwise(""), poor)
    dashed = lambda i: F.when(F.col("cells")[i] == "", "—").otherwise(F.col("cells")[i])
    price = F.concat(F.lit("| "), F.array_join(F.array(F.col("cells")[0], F.col("cells")[1], dashed(2), dashed(3), dashed(4)), " | "), F.lit(" |"), F.when(low, " <!-- heard poorly -->").otherwise(""))
    bullet = F.concat(F.repeat(F.lit("  "), F.size(F.split("path", r"\.")) - 1), F.lit("- "), "text")
    kinds = {"actions": action, "groups": action, "quotes": price, "prose": F.col("text"), "lines": F.col("text"), "notes": bullet}
    out = F.concat(F.lit("- "), "text", poor)
    for kind, form in kinds.items():
        out = F.when(F.col("kind") == kind, form).otherwise(out)
    return out


def render(rows: DataFrame, handoff: Handoff, meta: DataFrame) -> DataFrame:
    """(doc_id, markdown) of documents (meta: doc_id, title, when), also of those that have no rows left.
    Sections without rows are left out but for a table of prices and a stated lean, which say so."""
    low = F.col("low_confidence") if "low_confidence" in rows.columns else F.lit(False)
    blocks = []
    for n, s in enumerate(handoff.sections):
        own = rows.where(F.col("section") == s.key)
        if s.kind == "themes":
            lines = _theme_lines(own)
        elif s.kind == "groups":
            per = own.groupBy("doc_id", "owner").agg(F.min("pos").alias("pos"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", _line(low).alias("l")))), lambda x: x["l"]), "\n").alias("l"))
            lines = per.select("doc_id", "pos", F.concat(F.lit("### "), "owner", F.lit("\n"), "l").alias("l"))
        else:
            lines = own.select("doc_id", "pos", _line(low).alias("l"))
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "l"))), lambda x: x["l"]), "\n")
        head = {"quotes": "| Item | Price | Unit | Terms | Valid until |\n| --- | --- | --- | --- | --- |\n"}.get(s.kind, f"**{s.heading}**\n" if s.heading else "")
        block = lines.groupBy("doc_id").agg(F.concat(F.lit(head), text).alias("b"))
        lacking = {"quotes": "_No price was quoted clearly enough to record._", "lean": f"**{s.heading}**\n_{s.fallback}_"}.get(s.kind)
        if lacking:
            block = meta.select("doc_id").join(block, "doc_id", "left").select("doc_id", F.coalesce("b", F.lit(lacking)).alias("b"))
        blocks.append(block.select("doc_id", F.lit(n).alias("n"), "b"))
    whole = reduce(lambda a, b: a.unionByName(b), blocks).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "b"))), lambda x: x["b"]), "\n\n").alias("b")).hint("merge")
    name = handoff.title or handoff.label
    head = {
        "followup_email": F.lit("Subject: "),
        "summary_next_steps": F.concat(F.lit("**"), "title", F.lit("** ("), "when", F.lit(")\n\n")),
        "collated_feedback": F.concat(F.lit(f"**{name}** ("), "when", F.lit(")\n\n")),
    }.get(handoff.id, F.concat(F.lit(f"**{name} — "), "title", F.lit("** ("), "when", F.lit(")\n\n")))
    return meta.join(whole, "doc_id", "left").select("doc_id", F.concat(head, F.coalesce("b", F.lit(""))).alias("markdown"))


def _theme_lines(rows: DataFrame) -> DataFrame:
    """A line for each theme, by the number of its examples that are left (AG-20)."""
    at = F.regexp_extract("path", r"\[(\d+)\]", 1).cast("int")
    per = rows.groupBy("doc_id", at.alias("t")).agg(F.first("text").alias("text"), F.first(F.col("cells")[0]).alias("kind"), F.count("*").alias("n"), F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "owner"))), lambda x: x["owner"])).alias("heard"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "t"))
    line = F.concat(F.lit("- **"), "text", F.lit("** — "), F.col("n").cast("string"), F.lit(" mention"), F.when(F.col("n") == 1, "").otherwise("s"), F.lit(" · "), F.replace("kind", F.lit("_"), F.lit(" ")), F.lit("\n  _heard in:_ "), F.array_join("heard", ", "))
    return per.select("doc_id", place.alias("pos"), line.alias("l"))


def alias_segments(segs: DataFrame, order: list[str]) -> DataFrame:
    """Segments of several meetings under ids M1:S004, by the order in which the meetings were asked for (HO-14)."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("meeting_id"))
    return segs.where(F.col("meeting_id").isin(order)).select("meeting_id", F.concat(F.lit("M"), rank, F.lit(":"), "id").alias("id"), "text")


def collated(themes: DataFrame, failures: DataFrame) -> DataFrame:
    """(theme, frequency): how many examples of a theme survive, most first, never what a model said (AG-20)."""
    return themes.join(failures.select("path").distinct(), "path", "left_anti").groupBy("theme").agg(F.count("*").alias("frequency"))
