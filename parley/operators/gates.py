"""Gates: predicates that keep blocked rows with a reason (GT-*, JN-15, JN-24, JN-25)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import numbers as N
from parley.functions import text as T

#: Offset tolerance in seconds, overlap of a stated verdict, failures listed, statement kinds, soft rules.
TOLERANCE, OVERLAP, LISTED = 15, 0.4, 12
KINDS = ["decision", "action", "number", "quote", "question", "opinion", "aside", "other"]
SOFT = ["bullet-is-a-title", "owner-unnamed"]
UNASSIGNED = "Unassigned"
#: Words that state a hiring lean, and headings of action sections.
VERDICT = r"(?i)\b(hire|no[- ]hire|yes from me|no from me|a yes|a no|strong yes|strong no|thumbs (up|down)|pass on|passing on|not a fit|make an offer|an offer|lean(ing)? (yes|no|towards|toward)|move forward|move ahead)\b"
ACTION_SECTION = r"(?i)\b(action items?|next steps?|commitments?|to-?dos?|follow[- ]?ups?)\b"
#: Verbs that make a theme header a claim, in their forms.
CLAIM_VERBS = [
    ["decide", "decided", "decides", "deciding", "decision"],
    ["agree", "agreed", "agrees"],
    ["approve", "approved", "approves"],
    ["reject", "rejected", "rejects"],
    ["commit", "committed", "commits"],
    ["sign", "signed", "signs"],
    ["delay", "delayed", "delays", "slip", "slipped"],
    ["moved", "moves", "moving"],
    ["launch", "launched", "launches"],
    ["cut", "cuts"],
    ["drop", "dropped", "drops"],
    ["raise", "raised", "raises"],
    ["choose", "chose", "chosen", "picked"],
    ["will", "shall"],
    ["won't", "wont"],
]


def first_reason(*reasons: Column) -> Column:
    """allOf: the first reason wins, null passes."""
    return F.coalesce(*reasons)


def grounded(claims: DataFrame, utterances: DataFrame) -> DataFrame:
    """claims (id, meeting_id, quote, offset_s) with gate_reason (GT-1): the quote must stand loosely in
    the meeting's transcript; without one, the offset must be within TOLERANCE seconds of a line."""
    hay = utterances.groupBy("meeting_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", T.normalize(F.col("text")).alias("t")))), lambda s: s["t"]), " ␟ ").alias("hay"))
    near = near_offsets(claims.where("offset_s is not null and (quote is null or quote = '')"), utterances).select("id", F.lit(True).alias("near"))
    rows = claims.join(hay, "meeting_id", "left").join(near, "id", "left")
    quoted = F.coalesce(F.col("quote") != "", F.lit(False))
    found = T.contains_loosely(F.coalesce("hay", F.lit("")), T.normalize(F.col("quote")))
    reason = (
        F.when(quoted & ~found, F.concat(F.lit('quote not found in transcript: "'), F.substring("quote", 1, 60), F.lit('"')))
        .when(quoted, None)
        .when(F.col("offset_s").isNotNull() & F.col("near").isNull(), F.concat(F.lit("offset "), F.regexp_replace(F.col("offset_s").cast("string"), r"\.0$", ""), F.lit("s matches no utterance")))
        .when(F.col("offset_s").isNotNull(), None)
        .otherwise("claim carries neither a quote nor an offset")
    )
    return rows.select(*claims.columns, reason.alias("gate_reason"))


def near_offsets(claims: DataFrame, utterances: DataFrame) -> DataFrame:
    """Claims with an utterance of their meeting within TOLERANCE seconds (JN-15). The time axis is cut
    into buckets of that width, so the join is an equi-join on meeting and bucket."""
    bucket = lambda c: F.floor(c / TOLERANCE)
    u = utterances.select("meeting_id", F.col("offset_s").alias("u_offset"), F.explode(F.array(bucket(F.col("offset_s")) - 1, bucket(F.col("offset_s")), bucket(F.col("offset_s")) + 1)).alias("bucket"))
    c = claims.withColumn("bucket", bucket(F.col("offset_s")))
    near = F.abs(F.col("c.offset_s") - F.col("u.u_offset")) <= TOLERANCE
    return c.alias("c").join(u.alias("u"), (F.col("c.meeting_id") == F.col("u.meeting_id")) & (F.col("c.bucket") == F.col("u.bucket")) & near, "left_semi").drop("bucket")


def source_failures(leaves: DataFrame, segs: DataFrame, memory: list[str] = ()) -> DataFrame:
    """leaves (meeting_id, path, source) -> (meeting_id, path, rule, id): GT-5. No source at all, an id of
    the memory context, or an id that is no segment of the meeting."""
    none = leaves.where(F.coalesce(F.size("source") <= 0, F.lit(True))).select("meeting_id", "path", F.lit("leaf-sourced").alias("rule"), F.lit("").alias("id"))
    each = leaves.select("meeting_id", "path", F.explode("source").alias("id"))
    of_memory = F.col("id").isin(*memory) if memory else F.lit(False)
    unknown = each.where(~of_memory).join(segs.select("meeting_id", "id"), ["meeting_id", "id"], "left_anti").select("meeting_id", "path", F.lit("source-exists").alias("rule"), "id")
    return none.unionByName(unknown).unionByName(each.where(of_memory).select("meeting_id", "path", F.lit("no-memory-source").alias("rule"), "id"))


def verbatim_failures(items: DataFrame) -> DataFrame:
    """items (path, text, cited) -> (path, rule, detail): figures that the cited text does not say (GT-6)."""
    rows = items.where("cited <> ''").select("path", F.explode(N.verbatim_misses("text", "cited")).alias("detail"))
    return rows.select("path", F.lit("verbatim-number").alias("rule"), "detail")


def unsourced_failures(lines: DataFrame) -> DataFrame:
    """lines (path, text) without a citation -> (path, rule, detail): the first figure a line states, and a
    quotation of four characters or more, neither of which it may carry (GT-18)."""
    figure = lines.select("path", F.try_element_at(N.numeric_tokens("text"), F.lit(1))["raw"].alias("detail")).where("detail is not null")
    quoted = lines.where(F.col("text").rlike('[“"][^“”"]{4,}[”"]')).select("path", F.lit("exact-quote").alias("rule"), F.lit("a quotation without a citation").alias("detail"))
    return figure.select("path", F.lit("verbatim-number").alias("rule"), "detail").unionByName(quoted)


def quote_failures(items: DataFrame) -> DataFrame:
    """items (path, text, texts array of the cited segments) -> quoted spans that no one segment holds (GT-7)."""
    rows = items.where("size(texts) > 0").select("path", "texts", F.explode(T.quoted_spans(F.col("text"))).alias("detail"))
    return rows.where(~F.exists("texts", lambda t: F.contains(T.flat(t), T.flat(F.col("detail"))))).select("path", F.lit("exact-quote").alias("rule"), "detail")


def title_failures(items: DataFrame) -> DataFrame:
    """Leaves of three content words or fewer and no figure, whose cited text has one (GT-8, soft)."""
    bare = (F.size(T.content_words(F.col("text"))) <= 3) & (F.size(N.numeric_tokens("text")) == 0)
    rows = items.where("cited <> ''").withColumn("figures", N.numeric_tokens("cited")).where(bare & (F.size("figures") > 0))
    return rows.select("path", F.lit("bullet-is-a-title").alias("rule"), F.element_at("figures", 1)["raw"].alias("detail"))


def verdict_reason(lean: Column, cited: Column, haystack: Column) -> Column:
    """Why a reported hiring lean is not stated by its source, or null (GT-9)."""
    return F.when(cited == "", None).when(~cited.rlike(VERDICT), "the cited segment does not state a lean").when(T.lexical_overlap(lean, haystack) < OVERLAP, "the lean does not track the cited segment")


def owner_reason(owner: Column, owners: Column) -> Column:
    """Why an owner is refused, or null (GT-10); owners is an array of lower-cased names."""
    name = F.trim(F.coalesce(owner, F.lit("")))
    return F.when(name == "", "owner is empty").when(~F.array_contains(owners, F.lower(name)) & (F.lower(name) != UNASSIGNED.lower()), F.concat(F.lit('owner is "'), name, F.lit('", who is not a participant')))


def unnamed_owner(text: Column, names: Column) -> Column:
    """True for an action item that names no owner and does not start with Unassigned (GT-11, soft)."""
    padded = F.concat(F.lit(" "), F.regexp_replace(T.flat(text), r"[^a-z0-9_à-ÿ]+", " "), F.lit(" "))
    named = F.exists(names, lambda n: (F.length(n) >= 3) & F.contains(padded, F.concat(F.lit(" "), F.lower(n), F.lit(" "))))
    return ~text.rlike(r"(?i)^\s*unassigned\b") & ~named


def header_failures(labels: DataFrame) -> DataFrame:
    """labels (path, text, leaf_text, names) -> claims in a theme header that no leaf carries (GT-12):
    figures, decision verbs in any of their forms, and names."""
    head, leaf = T.flat(F.col("text")), T.flat(F.col("leaf_text"))
    word = lambda x, w: x.rlike(rf"\b{w}\b")
    verbs = []
    for own in CLAIM_VERBS:
        used = reduce(lambda a, b: F.coalesce(a, b), [F.when(word(head, f), f) for f in own])
        backed = reduce(lambda a, b: a | b, [word(leaf, f) for f in own])
        verbs.append(F.when(~backed, used))
    figures = F.transform(F.filter(N.numeric_tokens("text"), lambda t: ~F.exists(t["forms"], lambda f: F.contains(leaf, f))), lambda t: t["raw"])
    spaced = lambda x: F.concat(F.lit(" "), F.regexp_replace(x, r"[^a-z0-9_]+", " "), F.lit(" "))
    names = F.filter("names", lambda n: (F.length(n) >= 3) & F.contains(spaced(head), F.concat(F.lit(" "), F.lower(n), F.lit(" "))) & ~F.contains(spaced(leaf), F.concat(F.lit(" "), F.lower(n), F.lit(" "))))
    return labels.select("path", F.lit("theme-claim-free").alias("rule"), F.explode(F.concat(figures, F.array_compact(F.array(*verbs)), names)).alias("detail"))


def cited_texts(rows: DataFrame, segs: DataFrame) -> DataFrame:
    """(meeting_id, source, texts, cited) of each list of sources that rows (meeting_id, source) have in a meeting: the texts of
    its known segments in citing order, and these joined by spaces. Lists without a known segment are left out."""
    each = rows.select("meeting_id", "source").distinct().select("meeting_id", "source", F.posexplode("source").alias("i", "id")).join(segs.select("meeting_id", "id", F.col("text").alias("t")), ["meeting_id", "id"])
    texts = each.groupBy("meeting_id", "source").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "t"))), lambda s: s["t"]).alias("texts"))
    return texts.withColumn("cited", F.array_join("texts", " "))


def validate_leaves(leaves: DataFrame, segs: DataFrame, owners: DataFrame) -> DataFrame:
    """leaves (meeting_id, path, text, source, section) -> (meeting_id, path, rule, detail): GT-13, GT-14.
    A leaf whose sources fail is not checked further. owners: meeting_id, names array."""
    bad = source_failures(leaves, segs)
    good = leaves.join(bad.select("meeting_id", "path").distinct(), ["meeting_id", "path"], "left_anti")
    # Leaves that say the same from the same segments are judged once.
    alike = ["meeting_id", "source", "text", "section"]
    items = good.select(*alike).distinct().join(cited_texts(good, segs), ["meeting_id", "source"]).withColumn("path", F.struct(*alike))
    named = items.join(owners, "meeting_id", "left").where(F.col("section").rlike(ACTION_SECTION) & unnamed_owner(F.col("text"), F.coalesce("names", F.array().cast("array<string>"))))
    parts = [verbatim_failures(items), quote_failures(items), title_failures(items), named.select("path", F.lit("owner-unnamed").alias("rule"), F.substring("text", 1, 60).alias("detail"))]
    found = reduce(lambda a, b: a.unionByName(b), parts)
    told = good.select(F.struct(*alike).alias("of"), "meeting_id", "path").join(found.withColumnRenamed("path", "of"), "of")
    return bad.select("meeting_id", "path", "rule", F.col("id").alias("detail")).unionByName(told.select("meeting_id", "path", "rule", "detail"))


def sanitize_statements(raw: DataFrame, segs: DataFrame, owners: DataFrame) -> DataFrame:
    """raw (meeting_id, pos, text, kind, source, speaker) with reason, null for kept ones, and for these a
    dense id ST1.., a known kind, a known speaker and heard_poorly (GT-16). Reasons come in fixed order."""
    each = raw.select("meeting_id", "pos", F.posexplode_outer("source").alias("i", "id")).join(segs.select("meeting_id", "id", F.col("text").alias("t"), "confidence"), ["meeting_id", "id"], "left")
    cited = each.groupBy("meeting_id", "pos").agg(
        F.transform(F.array_sort(F.filter(F.collect_list(F.struct("i", "t")), lambda s: s["t"].isNotNull())), lambda s: s["t"]).alias("texts"),
        F.array_sort(F.collect_list(F.when(F.col("t").isNull() & F.col("id").isNotNull(), F.struct("i", "id")))).alias("unknown"),
        F.bool_and(F.coalesce("confidence", F.lit(1.0)) < 0.6).alias("poor"))
    rows = raw.join(cited, ["meeting_id", "pos"]).join(owners, "meeting_id", "left").withColumn("text", F.trim(F.coalesce("text", F.lit(""))))
    rows = rows.withColumn("misses", N.verbatim_misses("text", F.array_join("texts", " ")))
    bad_quotes = F.filter(T.quoted_spans(F.col("text")), lambda q: ~F.exists("texts", lambda t: F.contains(T.flat(t), T.flat(q))))
    reason = (
        F.when(F.col("text") == "", "no text")
        .when(F.coalesce(F.size("source") <= 0, F.lit(True)), "no source segment ids")
        .when(F.size("unknown") > 0, F.concat(F.lit("cites segments that do not exist: "), F.array_join(F.transform("unknown", lambda u: u["id"]), ", ")))
        .when(F.size("misses") > 0, F.concat(F.lit("figure/date not in cited text: "), F.array_join("misses", ", ")))
        .when(F.size(bad_quotes) > 0, "quoted span is not verbatim in one cited segment")
    )
    rows = rows.withColumn("reason", reason)
    rank = F.row_number().over(Window.partitionBy("meeting_id", F.col("reason").isNull()).orderBy("pos"))
    kept = F.col("reason").isNull()
    speaker = F.trim("speaker")
    known = F.exists(F.coalesce("names", F.array().cast("array<string>")), lambda n: F.lower(n) == F.lower(speaker))
    return rows.select("meeting_id", "pos", "text", F.when(kept, F.concat(F.lit("ST"), rank)).alias("id"), F.when(F.col("kind").isin(*KINDS), F.col("kind")).otherwise("other").alias("kind"), "source", F.when(known, speaker).alias("speaker"), (kept & F.col("poor")).alias("heard_poorly"), "reason")


def entailment_failures(leaves: DataFrame, verdicts: DataFrame) -> DataFrame:
    """leaves (ordinal, path) with unsupported verdicts (i, supported) as failures (GT-17, JN-25). A leaf
    without a verdict stands: a checker that fails deletes nothing."""
    return leaves.join(verdicts.where(~F.col("supported")).select(F.col("i").alias("ordinal"), "why"), "ordinal").select("path", F.lit("entailment-unsupported").alias("rule"), F.col("why").alias("detail"))


def format_failures(failures: DataFrame, key: str = "meeting_id", listed: int = LISTED) -> DataFrame:
    """(key, text): one line for each path and rule, the first LISTED, and how many more there are (GT-21)."""
    once = failures.groupBy(key, "path", "rule").agg(F.min("seq").alias("seq"), F.min_by("detail", "seq").alias("detail"))
    order = Window.partitionBy(key).orderBy("seq")
    first = once.withColumn("n", F.row_number().over(order)).where(F.col("n") <= listed)
    line = F.concat(F.lit("- ["), "rule", F.lit("] "), "detail")
    lines = first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("l")))), lambda s: s["l"]).alias("lines"))
    total = failures.groupBy(key).agg(F.count("*").alias("total"))
    extra = F.col("total") - F.size("lines")
    return lines.join(total, key).select(key, F.concat(F.array_join("lines", "\n"), F.when(extra > 0, F.concat(F.lit("\n- (and "), extra, F.lit(" more of the same kinds)"))).otherwise("")).alias("text"))


def bullet_grounding(quote: Column, haystack: Column) -> Column:
    """A summary bullet's flag: null without a quote, false if the transcript lacks it, else true (GT-20)."""
    return F.when(F.coalesce(quote, F.lit("")) == "", None).otherwise(T.contains_loosely(haystack, T.normalize(quote)))


def new_facts(text: Column, corpus: Column) -> Column:
    """The first capitalised word or number of a text that its corpus lacks, or null (GT-3, GT-4)."""
    return F.try_element_at(F.filter(T.fact_tokens(text), lambda t: (T.normalize(t) != "") & ~F.contains(corpus, T.normalize(t))), F.lit(1))


#: Facts are looked up in words by their first so many characters; longer ones are then compared as a whole.
FACT_KEY = 12


def unsaid_facts(texts: DataFrame, snippets: DataFrame) -> DataFrame:
    """(text, fact): the first capitalised word or number of each text that no snippet has (GT-3, GT-4); texts without one
    are left out. What a snippet says it says by itself: where two of them meet, no number arises.

    Snippets are many and so are texts, so none is set against all others. A normalised fact has spaces between digits only: it
    stands in one of the pieces that a snippet falls into at its other spaces. Most facts are such a piece; the
    rest meet the pieces that hold their first FACT_KEY characters."""
    facts = texts.select("text").distinct().select("text", F.posexplode(T.fact_tokens(F.coalesce("text", F.lit("")))).alias("at", "raw")).withColumn("fact", T.normalize(F.col("raw"))).where("fact <> ''")
    pieces = snippets.select(F.explode(F.array_distinct(F.split(T.normalize(F.col("text")), r"(?<![0-9]) | (?![0-9])"))).alias("piece")).where("piece <> ''").distinct()
    rest = facts.select("fact").distinct().join(pieces, F.col("fact") == F.col("piece"), "left_anti")
    length = F.least(F.length("fact"), F.lit(FACT_KEY))
    lengths = rest.agg(F.collect_set(length).alias("lengths"))  # one row of FACT_KEY numbers at most
    parts = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("piece") - n + 1, F.lit(1))), lambda i: F.substring("piece", i, n))
    fitting = F.filter("lengths", lambda n: n <= F.length("piece"))
    held = pieces.join(F.broadcast(lengths)).select("piece", F.explode(F.array_distinct(F.flatten(F.transform(fitting, parts)))).alias("key"))
    within = rest.withColumn("key", F.substring("fact", F.lit(1), length)).join(held, "key").where(F.contains("piece", F.col("fact"))).select("fact").distinct()
    unsaid = rest.join(within, "fact", "left_anti")
    return facts.join(unsaid, "fact", "left_semi").groupBy("text").agg(F.min_by("raw", "at").alias("fact"))


def answer_gate(points: DataFrame, snippets: DataFrame) -> DataFrame:
    """points (text, chunk_id, quote) with reason: an unretrieved chunk, a quote the cited chunk lacks, or
    a fact no snippet has (GT-3)."""
    rows = points.join(snippets.select("chunk_id", F.col("text").alias("cited")), "chunk_id", "left").join(unsaid_facts(points, snippets), "text", "left")
    # Columns of their own: each is asked for several times, the first for every word of the other.
    rows = rows.withColumn("_hay", T.normalize(F.col("cited"))).withColumn("_needle", T.normalize(F.coalesce("quote", F.lit(""))))
    found = T.contains_loosely(F.col("_hay"), F.col("_needle"))
    reason = (
        F.when(F.col("cited").isNull(), F.concat(F.lit("cites chunk "), "chunk_id", F.lit(" which was not retrieved")))
        .when(F.coalesce(F.col("quote") == "", F.lit(True)), "claim carries neither a quote nor an offset")
        .when(~found, F.concat(F.lit('quote not found in transcript: "'), F.substring("quote", 1, 60), F.lit('"')))
        .when(F.col("fact").isNotNull(), F.concat(F.lit('asserts "'), "fact", F.lit('" which appears in no retrieved snippet')))
    )
    return rows.select(*points.columns, reason.alias("reason"))


def foreign_citations(examples: DataFrame) -> DataFrame:
    """examples (path, meeting, source) that cite a segment of another meeting than their own (GT-23)."""
    return examples.select("path", "meeting", F.explode("source").alias("id")).where(~F.startswith("id", F.concat("meeting", F.lit(":")))).select("path", F.lit("source-exists").alias("rule"), F.col("id").alias("detail"))
