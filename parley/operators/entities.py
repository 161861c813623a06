"""Candidates and entity resolution (CP-1, CP-2, CP-4, AG-15, AG-16, JN-17..19)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import text as T
from parley.operators.similar import contained_pairs, featured, two_best

#: Weights of candidate sources, candidates kept, bar and margin of a lexical merge.
WEIGHT = {"coverage_gap": 5, "decision": 4, "action": 3, "speaker": 5}
KEEP, MERGE, MARGIN = 12, 0.72, 0.05


def repeated_ngrams(utterances: DataFrame) -> DataFrame:
    """(meeting_id, key, surface, n, quote, offset_s, idx): word pairs and triples said twice or more in a
    meeting, with where they were first said (AG-15)."""
    words = F.filter(F.transform(F.split("text", r"\s+"), lambda w: F.regexp_replace(w, "[^A-Za-z0-9-]", "")), lambda w: w != "")
    # What a gram needs of its words is told once a word: whether it is long enough, a stop word, and its normalised form.
    told = F.transform(words, lambda w: F.struct(w.alias("w"), F.lower(w).alias("low"), (F.length(w) >= 3).alias("long"), F.array_contains(T._list(T.STOP_TOPIC), F.lower(w)).alias("stop"), T.normalize(w).alias("norm")))
    rows = utterances.select("meeting_id", "idx", "offset_s", "text", told.alias("w"), F.coalesce(F.col("idx").cast("int"), F.lit(-(1 << 31))).alias("line"))
    n = F.size("w")
    grams = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.struct((i - 1 + (F.lit(0) if k == 2 else n - 1)).alias("at"), F.slice("w", i, F.lit(k)).alias("g")))).otherwise(F.array().cast("array<struct<at:int,g:array<struct<w:string,low:string,long:boolean,stop:boolean,norm:string>>>>"))
    good = lambda x: F.forall(x["g"], lambda w: w["long"]) & ~F.element_at(x["g"], 1)["stop"] & ~F.element_at(x["g"], -1)["stop"] & (F.size(F.array_distinct(F.transform(x["g"], lambda w: w["low"]))) > 1)
    key = lambda x: F.array_join(F.filter(F.transform(x["g"], lambda w: w["norm"]), lambda w: w != ""), " ")
    marked = F.transform(F.filter(F.concat(grams(2), grams(3)), good), lambda x: F.struct(x["at"].alias("at"), key(x).alias("key")))
    # Only keys and places travel; texts come back to what is said twice. A place is one long, which sums by hash can keep.
    each = rows.select("meeting_id", "line", F.explode(marked).alias("x")).select("meeting_id", F.col("x.key").alias("key"), (F.shiftleft(F.col("line").cast("long"), 32) + F.col("x.at")).alias("place"))
    twice = each.groupBy("meeting_id", "key").agg(F.count("*").alias("n"), F.min("place").alias("place")).where("n >= 2")
    twice = twice.select(F.col("meeting_id").alias("of"), "key", F.col("n").alias("times"), F.shiftright("place", 32).cast("int").alias("at_line"), F.col("place").bitwiseAND(0xFFFFFFFF).cast("int").alias("at"))
    said = rows.join(twice, F.col("meeting_id").eqNullSafe(F.col("of")) & (F.col("line") == F.col("at_line")))
    at = F.col("at")
    gram = F.when(at < n - 1, F.slice("w", at + 1, F.lit(2))).otherwise(F.slice("w", F.greatest(F.lit(1), at - n + 2), F.lit(3)))
    said = said.withColumn("surface", F.array_join(F.transform(gram, lambda w: w["w"]), " ")).where(T.normalize(F.col("surface")) == F.col("key"))
    # Lines may share a number: one of them is taken.
    one = said.groupBy("meeting_id", "key").agg(F.min(F.struct("surface", "times", "text", "offset_s", "idx", "at")).alias("s"))
    return one.select("meeting_id", "key", "s.surface", F.col("s.times").alias("n"), F.col("s.text").alias("quote"), "s.offset_s", F.struct("s.idx", "s.at").alias("first"))


def candidates(utterances: DataFrame, recaps: DataFrame) -> DataFrame:
    """(meeting_id, kind, surface, source, quote, offset_s, weight), at most KEEP a meeting, best first.

    recaps: meeting_id, coverage_gaps array<struct<fact,type,transcript_quote>>, key_decisions
    array<string>, action_items array<struct<task,...>>. Candidates of one kind and normalised surface
    fold in order: a heavier one than the weight so far replaces it, and weights add up (AG-16)."""
    none = F.lit(None).cast("double")
    usable = lambda c: c.isNotNull() & (F.length(F.trim(c)) > 1) & (F.lower(F.trim(c)) != "none")

    def rows(df, kind, surface, source, quote, offset, weight, order):
        return df.select("meeting_id", kind.alias("kind"), surface.alias("surface"), F.lit(source).alias("source"), quote.alias("quote"), offset.cast("double").alias("offset_s"), weight.cast("long").alias("weight"), order.alias("order"))

    gap = recaps.select("meeting_id", F.posexplode("coverage_gaps").alias("i", "g")).where(usable(F.col("g.fact")))
    dec = recaps.select("meeting_id", F.posexplode("key_decisions").alias("i", "d")).where(usable(F.col("d"))).withColumn("np", T.noun_phrase(F.col("d"))).where("np is not null")
    act = recaps.select("meeting_id", F.posexplode("action_items").alias("i", "a")).where(usable(F.col("a.task"))).withColumn("np", T.noun_phrase(F.col("a.task"))).where("np is not null")
    spk = utterances.where(usable(F.col("speaker"))).groupBy("meeting_id", "speaker").agg(F.min("idx").alias("i"), F.min_by("text", "idx").alias("text"), F.min_by("offset_s", "idx").alias("offset_s"))
    order = lambda n, i, j=F.lit(0): F.struct(F.lit(n).alias("a"), i.cast("long").alias("b"), j.cast("long").alias("c"))
    topic, person = F.lit("topic"), F.lit("person")
    ng = repeated_ngrams(utterances)
    every = [
        rows(gap, F.when(F.col("g.type") == "name", "person").otherwise("topic"), F.trim("g.fact"), "coverage_gap", F.coalesce("g.transcript_quote", "g.fact"), none, F.lit(WEIGHT["coverage_gap"]), order(0, F.col("i"))),
        rows(dec, topic, F.col("np"), "decision", F.col("d"), none, F.lit(WEIGHT["decision"]), order(1, F.col("i"))),
        rows(act, topic, F.col("np"), "action", F.col("a.task"), none, F.lit(WEIGHT["action"]), order(2, F.col("i"))),
        rows(ng, topic, F.col("surface"), "ngram", F.col("quote"), F.col("offset_s"), F.col("n"), order(3, F.col("first.idx"), F.col("first.at"))),
        rows(spk, person, F.col("speaker"), "speaker", F.col("text"), F.col("offset_s"), F.lit(WEIGHT["speaker"]), order(4, F.col("i"))),
    ]
    out = every[0]
    for more in every[1:]:
        out = out.unionByName(more)
    items = out.groupBy("meeting_id", "kind", T.normalize(F.col("surface")).alias("norm")).agg(F.array_sort(F.collect_list(F.struct("order", "surface", "source", "quote", "offset_s", "weight"))).alias("xs"))
    head = F.element_at("xs", 1)
    state = F.struct(head["surface"].alias("surface"), head["source"].alias("source"), head["quote"].alias("quote"), head["offset_s"].alias("offset_s"), head["weight"].alias("weight"), head["order"].alias("order"))

    def fold(acc, x):
        take = x["weight"] > acc["weight"]
        pick = lambda k: F.when(take, x[k]).otherwise(acc[k]).alias(k)
        return F.struct(pick("surface"), pick("source"), pick("quote"), pick("offset_s"), (acc["weight"] + x["weight"]).alias("weight"), acc["order"].alias("order"))

    best = items.select("meeting_id", "kind", F.aggregate(F.slice("xs", F.lit(2), F.greatest(F.lit(0), F.size("xs") - 1)), state, fold).alias("c")).select("meeting_id", "kind", "c.*")
    best = best.where((F.col("kind") != "topic") | T.plausible_topic(F.col("surface")))
    by = Window.partitionBy("meeting_id").orderBy(F.desc("weight"), "order")
    return best.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= KEEP).drop("_n", "order")


def curate(cands: DataFrame, keep: DataFrame) -> DataFrame:
    """Topics of the supplied list only; a meeting without a list keeps all (CP-2)."""
    k = keep.select("meeting_id", F.transform("keep", lambda x: T.normalize(x)).alias("_keep"))
    rows = cands.join(k, "meeting_id", "left")
    return rows.where((F.col("kind") != "topic") | F.coalesce(F.size("_keep") == 0, F.lit(True)) | F.array_contains("_keep", T.normalize(F.col("surface")))).drop("_keep")


def exact_aliases(cands: DataFrame, entities: DataFrame) -> DataFrame:
    """(surface, kind, entity_id): live entities of the kind with the candidate's normalised alias (JN-17)."""
    e = entities.where("merged_into is null").select(F.col("id").alias("entity_id"), "kind", "norm")
    return cands.withColumn("norm", T.normalize(F.col("surface"))).join(e, ["kind", "norm"]).select("surface", "kind", "entity_id")


def _live(entities: DataFrame) -> DataFrame:
    return featured(entities.where("merged_into is null"), "id", "label", "kind")


def contained(cands: DataFrame, entities: DataFrame) -> DataFrame:
    """(surface, entity_id): entities whose tokens hold the candidate's, or the reverse (JN-18)."""
    own = featured(cands.select("surface", "kind").distinct().withColumn("name", F.struct("kind", "surface")), "name", "surface", "kind")
    return contained_pairs(own, _live(entities), ["kind"]).select("id.surface", F.col("other").alias("entity_id")).distinct()


def best_lexical(cands: DataFrame, entities: DataFrame) -> DataFrame:
    """(surface, entity_id, score, runner_up): the most similar entity of the kind and the second's
    score; similarity above zero needs a shared token or trigram (JN-19)."""
    own = featured(cands.select("surface", "kind").distinct().withColumn("name", F.struct("kind", "surface")), "name", "surface", "kind")
    top = two_best(own, _live(entities), ["kind"]).withColumn("surface", F.col("id.surface"))
    return top.groupBy("surface").agg(F.max_by("other", F.struct("score", -F.col("place"))).alias("entity_id"), F.max("score").alias("score"), F.coalesce(F.max(F.when(F.col("place") == 2, F.col("score"))), F.lit(0.0)).alias("runner_up"))


def canonical_reason(df: DataFrame) -> DataFrame:
    """df (kind, surface, entity_id, matcher, score, runner_up, has_proof) with gate_reason, null if it passes (GT-2)."""
    two = lambda c: F.format_string("%.2f", c)
    reason = (
        F.when((F.col("kind") == "person") & T.is_placeholder(F.col("surface")), F.concat(F.lit('speaker placeholder "'), "surface", F.lit('" is not a person — no canonical identity')))
        .when(F.trim("surface") == "", "empty surface")
        .when(~F.col("has_proof"), F.concat(F.lit('no transcript proof for "'), "surface", F.lit('" — a mention without a receipt cannot link meetings')))
        .when(F.col("entity_id").isNotNull() & (F.col("matcher") == "lexical") & (F.col("score") - F.col("runner_up") < MARGIN), F.concat(F.lit("ambiguous: "), two("score"), F.lit(" vs runner-up "), two("runner_up"), F.lit(f", margin < {MARGIN}")))
    )
    return df.withColumn("gate_reason", reason)


def store(resolved: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, aliases, mentions) of gated resolutions: kept ones map to their entity; blocked ones
    get an entity of their own and a blocked mention, but for placeholders (CP-4). The first of a meeting's
    candidates wins (seq, their order; meetings in the order of their ids); mentions keep offset, quote and source."""
    bare = {"seq": "int", "quote": "string", "offset_s": "double", "source": "string", "matched": "string"}
    resolved = resolved.withColumns({c: F.lit(None).cast(t) for c, t in bare.items() if c not in resolved.columns})
    own = T.slug(F.col("kind"), F.col("surface"))
    blocked = F.col("gate_reason").isNotNull()
    placed = resolved.where(~F.coalesce(F.col("gate_reason").contains("speaker placeholder"), F.lit(False)))
    placed = placed.withColumn("id", F.when(blocked, own).otherwise(F.coalesce("entity_id", own))).withColumn("at", F.struct("meeting_id", blocked.alias("blocked"), "seq", "surface"))
    pick = lambda c: F.min_by(c, "at").alias(c)
    entities = placed.groupBy("id").agg(pick("kind"), F.min_by("surface", "at").alias("label"))
    aliases = placed.where(~blocked).groupBy(F.col("id").alias("entity_id"), T.normalize(F.col("surface")).alias("norm")).agg(F.min_by("surface", "at").alias("alias"), pick("matcher"), pick("score"), F.min_by("matched", "at").alias("reason"))
    gate = F.when(blocked, "blocked").otherwise("passed")
    rows = placed.withColumn("gate", gate)
    mentions = rows.groupBy(F.col("id").alias("entity_id"), "meeting_id", "surface").agg(*(pick(c) for c in ("offset_s", "quote", "source", "matcher", "score", "gate", "gate_reason")))
    return entities, aliases, mentions
