"""Outlines as flat bullet tables and documents as text (TREE-*, HO-*, SRC-13).

A bullet row is (doc_id, path array<int>, text, source array<string>, low_confidence)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BULLET_JSON = "struct<text:string,source:array<string>,lowConfidence:boolean,edited:boolean,children:array<struct<text:string,source:array<string>,lowConfidence:boolean,edited:boolean,children:array<struct<text:string,source:array<string>,lowConfidence:boolean,edited:boolean>>>>>"
NOTES_JSON = f"struct<summary:struct<text:string,source:array<string>>,themes:array<{BULLET_JSON}>>"
MAX_DEPTH = 3
#: Sections of each meeting type in order, with the labels that mean them.
_DISCUSSION = ("Discussion", "discussion|topics?|what was discussed|notes")
_QUESTIONS = ("Open questions", "open questions?|questions?|unanswered|unknowns?")
_RISKS = ("Risks & concerns", "risks?( (&|and) concerns?)?|concerns?|blockers?|risks? raised")
SECTIONS = {
    "team": [_DISCUSSION, ("Decisions", "decisions?|what was decided|agreements?"), ("Action items", "action items?|actions?|next steps?|commitments?|to-?dos?|follow[- ]?ups?"), _RISKS, _QUESTIONS],
    "investor": [_DISCUSSION, ("Traction & metrics", "traction( (&|and) metrics)?|metrics|numbers|kpis?|figures"), ("Commitments & asks", "commitments?( (&|and) asks?)?|asks?|action items?|next steps?|follow[- ]?ups?"), ("Risks raised", "risks?( raised| (&|and) concerns?)?|concerns?"), _QUESTIONS],
    "vendor": [_DISCUSSION, ("Pricing & terms", "pricing( (&|and) terms)?|terms|prices?|quotes?|commercials?"), ("Scope & integration", "scope( (&|and) integration)?|integration|implementation|security( (&|and) compliance)?"), _RISKS, _QUESTIONS],
    "customer": [_DISCUSSION, ("Needs & pain points", "needs?( (&|and) pain points?)?|pain points?|requirements?|problems?"), ("Objections & blockers", "objections?( (&|and) blockers?)?|blockers?|pushback|concerns?"), ("Next steps", "next steps?|action items?|follow[- ]?ups?|commitments?"), _QUESTIONS],
    "one_on_one": [_DISCUSSION, ("Signals & examples", "signals?( (&|and) examples?)?|observations?|examples?"), ("Concerns & gaps", "concerns?( (&|and) gaps)?|gaps|worries|risks?"), ("Growth & next steps", "growth( (&|and) next steps?)?|next steps?|action items?|development|follow[- ]?ups?"), _QUESTIONS],
}


def bullets(notes: DataFrame, json_col: str = "json") -> DataFrame:
    """Every bullet of notes (doc_id, json) with its path, depth, and whether it is a leaf (TREE-1)."""
    n = notes.select("doc_id", F.from_json(json_col, NOTES_JSON).alias("n"))
    one = n.select("doc_id", F.posexplode("n.themes").alias("a", "x"))
    two = one.select("doc_id", "a", F.posexplode("x.children").alias("b", "x"))
    three = two.select("doc_id", "a", "b", F.posexplode("x.children").alias("c", "x"))
    row = lambda df, path, leaf: df.select("doc_id", F.array(*path).alias("path"), F.lit(len(path)).alias("depth"), leaf.alias("is_leaf"), F.col("x.text").alias("text"), F.col("x.source").alias("source"), F.coalesce("x.lowConfidence", F.lit(False)).alias("low_confidence"))
    no_kids = F.coalesce(F.size("x.children") <= 0, F.lit(True))
    return row(one, ["a"], no_kids).unionByName(row(two, ["a", "b"], no_kids)).unionByName(row(three, ["a", "b", "c"], F.lit(True)))


def path_text(path: Column) -> Column:
    return F.array_join(F.transform(path, lambda i: i.cast("string")), ".")


def under(rows: DataFrame, path: str) -> DataFrame:
    """Leaves at or below a path (TREE-2)."""
    p = path_text(F.col("path"))
    return rows.where("is_leaf").where((p == path) | p.startswith(path + "."))


def implied_sources(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, source): the distinct sources of the leaves under a path, in order."""
    each = under(rows, path).groupBy("doc_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("path", "source"))), lambda s: s["source"])).alias("source"))
    return each.select("doc_id", F.array_distinct("source").alias("source"))


def rebuild(rows: DataFrame, drop: DataFrame) -> DataFrame:
    """Bullets without the dropped leaves (doc_id, path) and without labels left empty, renumbered (TREE-3)."""
    alive = rows.where("is_leaf").join(drop.select("doc_id", "path"), ["doc_id", "path"], "left_anti")
    up = alive.select("doc_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda i: F.slice("path", F.lit(1), i))).alias("path")).distinct()
    kept = rows.join(up, ["doc_id", "path"], "left_semi")
    # The new place on each level: the rank among siblings that are left; shorter paths rank apart.
    places = []
    for level in range(1, MAX_DEPTH + 1):
        deep = F.size("path") >= level
        order = Window.partitionBy("doc_id", deep, F.slice("path", 1, level - 1)).orderBy(F.get("path", F.lit(level - 1)))
        places.append((F.dense_rank().over(order) - 1).cast("int"))
    return kept.withColumn("path", F.slice(F.array(*places), F.lit(1), F.size("path")))


def section_of(label: Column, kind: str) -> Column:
    """The section a label means for a meeting type, or null."""
    clean = F.regexp_replace(F.trim(label), "[:.]+$", "")
    out = F.lit(None).cast("string")
    for name, pattern in reversed(SECTIONS.get(kind, SECTIONS["team"])):
        out = F.when(clean.rlike(f"(?i)^({pattern})$"), name).otherwise(out)
    return out


def normalize_sections(rows: DataFrame, kind: str) -> DataFrame:
    """(doc_id, section_order, section, order, text, is_leaf): where each top bullet, or child of a
    section, lands (TREE-4). Unknown labels go to the first section, before what it had itself; a known
    section inside it is hoisted; empty sections do not appear."""
    names = [n for n, _ in SECTIONS.get(kind, SECTIONS["team"])]
    catch = names[0]
    top = rows.where("size(path) = 1").withColumn("own", section_of(F.col("text"), kind))
    kids = rows.where("size(path) = 2").join(top.select("doc_id", F.col("path")[0].alias("a"), F.col("own").alias("of")), (F.col("path")[0] == F.col("a")) & (rows.doc_id == top.doc_id)).select(rows["*"], "of")
    nested = F.when(~F.col("is_leaf"), section_of(F.col("text"), kind))
    hoist = nested.isNotNull() & (nested != catch)
    third = rows.where("size(path) = 3").alias("t").join(kids.where((F.col("of") == catch)).withColumn("nested", nested).where("nested is not null").where(F.col("nested") != catch).alias("k"), (F.col("t.doc_id") == F.col("k.doc_id")) & (F.slice("t.path", 1, 2) == F.col("k.path"))).select("t.*", "nested")
    part = lambda df, section, first: df.select("doc_id", section.alias("section"), F.struct(F.lit(first).alias("f"), F.col("path").alias("p")).alias("order"), "text", "is_leaf")
    stray = part(top.where("own is null"), F.lit(catch), 0)
    leaf = part(top.where("own is not null and is_leaf"), F.col("own"), 1)
    own = part(kids.where(F.col("of") != catch), F.col("of"), 1)
    topic = part(kids.where((F.col("of") == catch) & ~F.coalesce(hoist, F.lit(False))), F.lit(catch), 0)
    lifted = part(third, F.col("nested"), 1)
    every = stray.unionByName(leaf).unionByName(own).unionByName(topic).unionByName(lifted)
    number = F.array_position(F.array(*(F.lit(n) for n in names)), F.col("section")).cast("int")
    return every.select("doc_id", number.alias("section_order"), "section", (F.row_number().over(Window.partitionBy("doc_id", "section").orderBy("order")) - 1).alias("order"), "text", "is_leaf")


def dedupe_leaves(rows: DataFrame) -> DataFrame:
    """Leaves of one parent with the same words as one: the first, with the union of sources, heard poorly
    only if all were (TREE-5, SET-5)."""
    key = F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "))
    parent = F.slice("path", 1, F.size("path") - 1)
    g = rows.where("is_leaf").groupBy("doc_id", parent.alias("parent"), key.alias("key"))
    return g.agg(F.min("path").alias("path"), F.min_by("text", "path").alias("text"), F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("path", "source"))), lambda s: s["source"]))).alias("source"), F.bool_and("low_confidence").alias("low_confidence"), (F.count("*") - 1).alias("merged")).drop("parent", "key")


def to_markdown(rows: DataFrame) -> DataFrame:
    """(doc_id, markdown): a line for each bullet in path order, two spaces a level, sources behind leaves (TREE-6)."""
    src = F.when(F.col("is_leaf") & (F.size(F.coalesce("source", F.array().cast("array<string>"))) > 0), F.concat(F.lit(" ["), F.array_join("source", ", "), F.when(F.col("low_confidence"), " ?").otherwise(""), F.lit("]"))).otherwise("")
    line = F.concat(F.expr("repeat('  ', size(path) - 1)"), F.lit("- "), "text", src)
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", line.alias("line")))), lambda s: s["line"]), "\n").alias("markdown"))


_ITEM, _MARKS = re.compile(r"^(\s*)[-*]\s+(.*)$"), re.compile(r"\s*\[([A-Za-z]\d+(?:\s*,\s*[A-Za-z]\d+)*)(\s*\?)?\]\s*$")


def parse_markdown(markdown: str) -> list[tuple[list[int], str, list[str], bool]]:
    """(path, text, source, low_confidence) of each bullet of an outline; two spaces or a tab a level (TREE-7)."""
    out: list[tuple[list[int], str, list[str], bool]] = []
    open_: list[tuple[int, list[int]]] = []
    children: dict[tuple[int, ...], int] = {}
    for raw in (markdown or "").split("\n"):
        m = _ITEM.match(raw)
        if not m or not m[2].strip():
            continue
        depth, text = len(m[1].replace("\t", "  ")) // 2, m[2].strip()
        while open_ and open_[-1][0] >= depth:
            open_.pop()
        parent = open_[-1][1] if open_ else []
        n = children.get(tuple(parent), 0)
        children[tuple(parent)] = n + 1
        path = [*parent, n]
        marks = _MARKS.search(text)
        out.append((path, _MARKS.sub("", text).strip() if marks else text, [s.strip() for s in marks[1].split(",")] if marks else [], bool(marks and marks[2])))
        open_.append((depth, path))
    return out


def from_markdown(docs: DataFrame) -> DataFrame:
    """docs (doc_id, markdown) -> bullet rows; a document is parsed as a whole, as depth needs its lines in order."""

    def run(frames):
        for f in frames:
            rows = [(d, *b) for d, md in zip(f["doc_id"], f["markdown"]) for b in parse_markdown(md)]
            yield pd.DataFrame(rows, columns=["doc_id", "path", "text", "source", "low_confidence"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "markdown").mapInPandas(run, f"doc_id {kind}, path array<int>, text string, source array<string>, low_confidence boolean")
    parents = rows.where("size(path) > 1").select("doc_id", F.expr("slice(path, 1, size(path) - 1)").alias("path")).distinct().withColumn("_p", F.lit(True))
    return rows.join(parents, ["doc_id", "path"], "left").withColumn("is_leaf", F.col("_p").isNull()).drop("_p")


def shape_errors(notes: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """(doc_id, path, error) of notes JSON that breaks the shape: empty texts, labels with sources, leaves
    without, children below the deepest level, which is the third for notes and the second for a summary (GT-19)."""
    rows = bullets(notes)
    p = path_text(F.col("path"))
    below = ".".join(["children[0]"] * MAX_DEPTH)
    deep = notes.select("doc_id", F.explode(F.expr("try_variant_get(try_parse_json(json), '$.themes', 'array<variant>')")).alias("t")).where(F.expr(f"try_variant_get(t, '$.{below}', 'string') is not null"))
    too_deep = rows.where(F.col("depth") > depth).select("doc_id").union(deep.select("doc_id")).distinct()
    found = [
        rows.where(F.coalesce(F.trim("text") == "", F.lit(True))).select("doc_id", p.alias("path"), F.lit("text must be a non-empty string").alias("error")),
        rows.where(~F.col("is_leaf") & F.col("source").isNotNull()).select("doc_id", p.alias("path"), F.lit("a theme label must not carry source").alias("error")),
        rows.where(F.col("is_leaf") & F.coalesce(F.size("source") <= 0, F.lit(True))).select("doc_id", p.alias("path"), F.lit("a leaf bullet must carry source").alias("error")),
        too_deep.select("doc_id", F.lit("").alias("path"), F.lit(f"exceeds the maximum outline depth of {depth}").alias("error")),
    ]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
