"""Resolution of candidates against entities that grow from meeting to meeting (CP-3), for all meetings at once.

Taken one after the other, a candidate sees the entities known before its meeting, those that earlier candidates of its
meeting founded, and what earlier meetings left behind. What is left behind follows from how a name (kind and normalised
surface) fares when it first occurs: kept, it is an alias from then on; blocked, it has an entity of its own, which the next
occurrence hits by its slug. So first occurrences are the nodes of a graph, matches between them (containment, likeness
near the bar or above) its edges, and whether a name founds an entity hangs on its earlier neighbours only. Names whose
earlier neighbours are settled are settled together, round by round, each round checkpointed; the number of rounds is the
length of the longest chain of names that wait for each other, not the number of meetings. No task holds the entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import text as T
from parley.operators import gates as Q
from parley.operators.entities import MARGIN, MERGE
from parley.operators.similar import SLACK, candidate_pairs, contained_pairs, featured, two_best
from parley.shared import made

#: A place after all candidates of a meeting.
END = (1 << 31) - 1
#: What grounds a candidate, carried along.
CARRIED = ["has_proof", "quote", "offset_s", "source"]


def with_proof(cands: DataFrame, utterances: DataFrame) -> DataFrame:
    """cands with has_proof: whether their quote, else their offset, is found in the meeting's transcript."""
    cands = made(cands)  # read twice, and long in the making
    receipts = cands.select("meeting_id", "kind", "surface", "quote", "offset_s", F.concat_ws("|", "kind", "surface").alias("id"))
    proof = Q.grounded(receipts, utterances).groupBy("meeting_id", "kind", "surface").agg(F.bool_or(F.col("gate_reason").isNull()).alias("has_proof"))
    return cands.join(proof, ["meeting_id", "kind", "surface"], "left").withColumn("has_proof", F.coalesce("has_proof", F.lit(False)))


def _time(seq: Column | str) -> Column:
    return F.struct("at", "meeting_id", (F.col(seq) if isinstance(seq, str) else seq).cast("int").alias("seq"))


def _occurrences(cands: DataFrame, entities: DataFrame) -> DataFrame:
    """cands with norm, own (their slug), name (what tells a name apart; of a name that is never stored, also the meeting)
    and the number of the occurrence."""
    none = F.lit(None)
    for column, value in {"at": F.lit(0), "has_proof": F.lit(True), "quote": none.cast("string"), "offset_s": none.cast("double"), "source": none.cast("string")}.items():
        if column not in cands.columns:
            cands = cands.withColumn(column, value)
    if "seq" not in cands.columns:
        cands = cands.withColumn("seq", F.row_number().over(Window.partitionBy("meeting_id").orderBy(F.desc("weight"), "kind", "surface")))
    rows = cands.select("at", "meeting_id", "seq", "kind", "surface", *CARRIED, T.normalize(F.col("surface")).alias("norm"), T.slug(F.col("kind"), F.col("surface")).alias("own"))
    placeholder = (F.col("kind") == "person") & T.is_placeholder(F.col("surface"))
    gone = entities.where("merged_into is not null").select(F.col("id").alias("own"), F.lit(True).alias("gone")).distinct()
    rows = rows.join(gone, "own", "left").withColumn("placeholder", F.coalesce(placeholder, F.lit(False)))
    fleeting = F.col("placeholder") | F.col("gone").isNotNull()
    rows = rows.withColumn("name", F.to_json(F.struct("kind", "norm", F.when(fleeting, F.col("meeting_id")).alias("meeting_id")))).withColumn("fleeting", fleeting)
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("name").orderBy(_time("seq")))).drop("gone")


def _edges(nodes: DataFrame, entities: DataFrame) -> DataFrame:
    """(name, other, known, contains, score): earlier names, or entities (known), that a name may match."""
    live = entities.where("merged_into is null").select(F.concat(F.lit("e"), "id").alias("id"), "kind", "label")
    labels = live.unionByName(nodes.select(F.concat(F.lit("n"), "name").alias("id"), "kind", F.col("surface").alias("label")))
    own = featured(labels.where("id like 'n%'"), "id", "label", "kind")
    alike = candidate_pairs(labels, MERGE - MARGIN - SLACK).select("a", "b")
    inside = contained_pairs(own, featured(labels, "id", "label", "kind"), ["kind"]).where("id <> other").select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))
    side = lambda s: labels.select(F.col("id").alias(s), F.col("kind").alias(f"kind_{s}"), F.col("label").alias(f"l{s}"))
    met = alike.unionByName(inside).where("b like 'n%'").distinct().join(side("a"), "a").join(side("b"), "b").where("kind_a = kind_b")
    x, y = T.entity_tokens(F.col("la")), T.entity_tokens(F.col("lb"))
    contains = (F.size(x) > 0) & (F.size(y) > 0) & ((F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0))
    met = met.select("a", "b", contains.alias("contains"), F.round(T.similarity(F.col("la"), F.col("lb")), 12).alias("score")).where(F.col("contains") | (F.col("score") >= MERGE - MARGIN - SLACK))
    first = lambda s: nodes.select(F.concat(F.lit("n"), "name").alias(s), F.col("first").alias(f"first_{s}"))
    met = met.join(first("a"), "a", "left").join(first("b"), "b")
    later = F.col("first_a").isNull() | (F.col("first_a") < F.col("first_b"))
    name = lambda one, two: F.substring(F.when(later, F.col(one)).otherwise(F.col(two)), 2, 1 << 30)
    return met.select(name("b", "a").alias("name"), name("a", "b").alias("other"), F.col("first_a").isNull().alias("known"), "contains", "score")


def _order(known: Column, entered: Column, same: Column, blocked: Column, id_: Column) -> Column:
    """The order in which a candidate finds what is known: entities by id, earlier meetings' kept names before
    blocked ones, its own meeting's as they came."""
    late = F.when(same, 0).otherwise(blocked.cast("int"))
    return F.struct((~known).alias("new"), entered["at"].alias("at"), entered["meeting_id"].alias("meeting_id"), late.alias("late"), entered["seq"].alias("seq"), id_.alias("id"))


def _settled(ready: DataFrame, edges: DataFrame, done: DataFrame, aliases: DataFrame, ids: DataFrame) -> DataFrame:
    """Outcomes of names whose earlier neighbours have theirs."""
    pool = done.where("entered is not null").select(F.col("name").alias("other"), "entered", "fleeting", F.col("blocked").alias("was_blocked"), F.col("own").alias("id"))
    mine = edges.join(ready.select("name", F.col("first").alias("now")), "name")
    seen = mine.where("not known").join(pool, "other").where("entered < now and (not fleeting or entered.meeting_id <=> now.meeting_id)")
    seen = seen.select("name", "contains", "score", "id", _order(F.lit(False), F.col("entered"), F.col("entered.meeting_id").eqNullSafe(F.col("now.meeting_id")), F.col("was_blocked"), F.col("id")).alias("order"))
    none = F.lit(None).cast(done.schema["entered"].dataType)
    base = mine.where("known").select("name", "contains", "score", F.col("other").alias("id"), _order(F.lit(True), none, F.lit(False), F.lit(False), F.col("other")).alias("order"))
    met = seen.unionByName(base)
    inside = met.where("contains").groupBy("name").agg(F.min_by("id", "order").alias("inside"))
    place = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("score"), "order"))
    two = met.withColumn("place", place).where("place <= 2").groupBy("name").agg(F.max(F.when(F.col("place") == 1, F.col("id"))).alias("best"), F.max(F.when(F.col("place") == 1, F.col("score"))).alias("most"), F.max(F.when(F.col("place") == 2, F.col("score"))).alias("second"))
    rows = ready.join(aliases, ["kind", "norm"], "left").join(ids, "own", "left").join(inside, "name", "left").join(two, "name", "left")
    matcher = F.when(F.col("alias_id").isNotNull(), "alias").when(F.col("is_id").isNotNull(), "slug").when(F.col("inside").isNotNull(), "contains").when(F.col("most") >= MERGE, "lexical").otherwise("none")
    rows = rows.withColumn("matcher", matcher)
    by = {"alias": F.col("alias_id"), "slug": F.col("own"), "contains": F.col("inside"), "lexical": F.col("best")}
    entity = F.coalesce(*(F.when(F.col("matcher") == m, c) for m, c in by.items()))
    doubtful = (F.col("matcher") == "lexical") & (F.col("most") - F.coalesce("second", F.lit(0.0)) < MARGIN)
    blocked = F.col("placeholder") | ~F.col("has_proof") | doubtful
    founded = F.col("matcher") == "none"
    # Where an entity of that id is there already, nothing new is stored.
    stored = founded | F.col("is_id").isNull()
    end = lambda c: F.struct(F.col(f"{c}.at").alias("at"), F.col(f"{c}.meeting_id").alias("meeting_id"), F.lit(END).alias("seq"))
    entered = F.when(founded, F.col("first")).when(stored & ~F.col("fleeting") & blocked, end("first")).when(stored & ~F.col("fleeting") & F.col("unproved").isNotNull(), end("unproved"))
    return rows.select("name", "own", "fleeting", entity.alias("entity_id"), "matcher", blocked.alias("blocked"), entered.alias("entered"))


def resolve_all(cands: DataFrame, entities: DataFrame) -> DataFrame:
    """(meeting_id, kind, surface, seq, entity_id, matcher, score, runner_up, blocked, matched, has_proof, quote, offset_s,
    source) of all candidates; matched says how it came to its entity. Meetings stand in the
    order of `at` (where cands have it) and id, candidates of a meeting by seq, else by weight, kind and surface.

    cands: meeting_id, kind, surface, seq or weight, and has_proof, true where it is missing; of a meeting's candidates of
    one kind no two have the same normalised surface. entities: id, kind, label, norm, merged_into. A candidate that matches
    nothing has no entity_id: it founds the entity of its own slug."""
    rows = made(_occurrences(cands, entities))
    unproved = F.min(F.when(~F.col("has_proof") & (F.col("nth") > 1), _time("seq"))).alias("unproved")
    first = lambda c: F.max(F.when(F.col("nth") == 1, F.col(c))).alias(c)
    each = rows.groupBy("name").agg(*(first(c) for c in ("kind", "norm", "surface", "own", "has_proof", "placeholder", "fleeting")), F.min(_time("seq")).alias("first"), unproved)
    nodes = made(each)
    edges = made(_edges(nodes, entities))
    live = entities.where("merged_into is null")
    aliases = live.groupBy("kind", "norm").agg(F.min("id").alias("alias_id"))
    ids = live.select(F.col("id").alias("own"), F.lit(True).alias("is_id")).distinct()
    between = edges.where("not known").select("name", "other")
    known = nodes.limit(0).select("name", "own", "fleeting", F.lit("").alias("entity_id"), F.lit("").alias("matcher"), F.lit(False).alias("blocked"), F.col("first").alias("entered"))
    open_, done = nodes, None
    while not open_.isEmpty():
        waiting = between.join(open_.select(F.col("name").alias("other")), "other", "left_semi").select("name")
        ready = open_.join(waiting, "name", "left_anti")
        step = _settled(ready, edges, known if done is None else done, aliases, ids)
        done = made(step if done is None else done.unionByName(step))
        open_ = made(nodes.join(done.select("name"), "name", "left_anti"))
    if done is None:
        done = known
    scores = _scores(nodes, done, live)
    out = rows.join(done.select("name", "entity_id", "matcher", F.col("blocked").alias("first_blocked")), "name").join(scores, "name", "left").join(aliases, ["kind", "norm"], "left")
    # After a blocked first occurrence the name's own entity is hit by its slug up to the first proved one, then by alias.
    proved = F.min(F.when(F.col("has_proof") & (F.col("nth") > 1), F.col("nth"))).over(Window.partitionBy("name"))
    out = out.withColumn("proved", proved)
    again = F.when(F.col("alias_id").isNotNull() | ~F.col("first_blocked") | (F.col("nth") > F.col("proved")), "alias").otherwise("slug")
    matcher = F.when(F.col("nth") == 1, F.col("matcher")).otherwise(again)
    kept_id = F.coalesce("alias_id", F.when(F.col("first_blocked"), F.col("own")).otherwise(F.coalesce("entity_id", "own")))
    out = out.select("meeting_id", "kind", "surface", "seq", F.when(F.col("nth") == 1, F.col("entity_id")).otherwise(kept_id).alias("entity_id"), matcher.alias("matcher"), F.when(F.col("nth") == 1, F.col("first_blocked")).otherwise(~F.col("has_proof")).alias("blocked"), "best", "second", "own", *CARRIED)
    likeness = F.col("matcher").isin("lexical", "none")
    score = F.when(F.col("matcher") == "alias", 1.0).when(F.col("matcher") == "slug", 0.95).when(F.col("matcher") == "contains", 0.9).otherwise(F.coalesce("best", F.lit(0.0)))
    out = out.withColumns({"score": score, "runner_up": F.when(likeness, F.coalesce("second", F.lit(0.0))).otherwise(0.0)})
    # Labels of entities: of two that share an id the known one's.
    named = nodes.join(done.where("entered is not null").select("name"), "name").select(F.col("own").alias("entity_id"), F.struct(F.lit(1).alias("new"), F.col("first"), "surface").alias("l"))
    named = named.unionByName(live.select(F.col("id").alias("entity_id"), F.struct(F.lit(0).alias("new"), F.lit(None).cast(nodes.schema["first"].dataType).alias("first"), F.col("label").alias("surface")).alias("l")))
    out = out.join(named.groupBy("entity_id").agg(F.min("l")["surface"].alias("label")), "entity_id", "left")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    shared = T.anchors(F.col("surface"), F.col("label"))
    anchored = F.when(F.size(shared) > 0, F.concat(F.lit(', anchored on "'), F.array_join(shared, ", "), F.lit('"'))).otherwise("")
    told = {
        "alias": F.concat(F.lit("exact alias match on "), quoted(F.col("surface"))),
        "slug": F.concat(F.lit("slug match on "), F.col("own")),
        "contains": F.concat(quoted(F.col("surface")), F.lit(" and "), quoted(F.col("label")), F.lit(" contain one another's tokens")),
        "lexical": F.concat(F.format_string("lexical %.2f to ", "score"), quoted(F.col("label")), anchored),
        "none": F.lit(f"no match above {MERGE} — created new entity"),
    }
    reason = F.coalesce(*(F.when(F.col("matcher") == m, t) for m, t in told.items()))
    return out.select("meeting_id", "kind", "surface", "seq", "entity_id", "matcher", "score", "runner_up", "blocked", reason.alias("matched"), *CARRIED)


def _scores(nodes: DataFrame, done: DataFrame, live: DataFrame) -> DataFrame:
    """(name, best, second): the two highest likenesses to what was known, of names that were settled by them."""
    asked = nodes.join(done.where("matcher in ('lexical', 'none')").select("name"), "name").select("name", "kind", "surface", F.col("first").alias("now"))
    pool = nodes.join(done.where("entered is not null").select("name", "entered"), "name")
    kept = pool.where("not fleeting").select(F.struct(F.lit(1).alias("new"), F.col("name").alias("id")).alias("id"), "kind", F.col("surface").alias("label"), "entered")
    base = live.select(F.struct(F.lit(0).alias("new"), "id").alias("id"), "kind", "label", F.lit(None).cast(kept.schema["entered"].dataType).alias("entered"))
    top = two_best(featured(asked, "name", "surface", "kind", "now"), featured(kept.unionByName(base), "id", "label", "kind", "entered"), ["kind"], entered="entered", now="now").select("id", "score")
    # A fleeting name is seen by its own meeting's later candidates only, KEEP of them at most.
    near = pool.where("fleeting").select("kind", F.col("surface").alias("label"), "entered", F.col("entered.meeting_id").alias("of"))
    beside = asked.join(near, (asked["kind"] == near["kind"]) & asked["now.meeting_id"].eqNullSafe(F.col("of")) & (F.col("entered") < F.col("now")))
    top = top.unionByName(beside.select(F.col("name").alias("id"), F.round(T.similarity(F.col("surface"), F.col("label")), 9).alias("score")))
    top = top.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"))))
    pick = lambda n: F.max(F.when(F.col("place") == n, F.col("score")))
    return top.groupBy("id").agg(pick(1).alias("best"), pick(2).alias("second")).withColumnRenamed("id", "name")
