"""Similarity joins of labels on shared tokens and trigrams, with hot ones set apart (JN-16, JN-18, JN-19).

Labels that share a token or trigram of at most HOT labels are found by an equi-join: HOT partners a key, however many
labels there are. What labels with nothing but hot keys in common can score is bounded by how many hot keys they have, so only those
that can reach the bar meet on a hot key. No pair is lost, and none is made for sharing a token that most labels have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import text as T
from parley.shared import made

#: Labels that a token or trigram may have before it counts as hot.
HOT = 1000
SLACK = 1e-9


def featured(labels: DataFrame, id_col: str, label_col: str, *keep: str) -> DataFrame:
    """(id, label, kept columns, t, last, g): distinct tokens, the last one, distinct trigrams."""
    tokens = T.entity_tokens(F.col(label_col))
    return labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), *keep, F.array_distinct(tokens).alias("t"), F.try_element_at(tokens, F.lit(-1)).alias("last"), T.trigrams(F.col(label_col)).alias("g"))


def hot_keys(rows: DataFrame, column: str, by: list[str], hot: int) -> DataFrame:
    """(by, key) of the elements that more than `hot` rows have in an array column."""
    return rows.select(*by, F.explode(column).alias("key")).groupBy(*by, "key").agg(F.count("*").alias("n")).where(F.col("n") > hot).select(*by, "key")


def _hot_of(rows: DataFrame, hot: DataFrame, column: str, name: str, by: list[str]) -> DataFrame:
    """rows with the array of their hot elements."""
    own = rows.select("id", *by, F.explode(column).alias("key")).join(hot, [*by, "key"]).groupBy("id").agg(F.collect_list("key").alias(name))
    return rows.join(own, "id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))


def _pairs(one: DataFrame, two: DataFrame, key: Column, other: Column) -> DataFrame:
    """(a, la, b, lb), a < b, of rows whose keys, arrays, have an element in common."""
    side = lambda df, k, s: df.select(F.col("id").alias(f"id_{s}"), F.col("label").alias(f"label_{s}"), F.explode(k).alias("key"))
    met = side(one, key, "x").join(side(two, other, "y"), "key").where("id_x <> id_y")
    x, y = (F.struct(F.col(f"id_{s}").alias("id"), F.col(f"label_{s}").alias("label")) for s in "xy")
    ends = met.select(F.when(F.col("id_x") < F.col("id_y"), x).otherwise(y).alias("p"), F.when(F.col("id_x") < F.col("id_y"), y).otherwise(x).alias("q"))
    return ends.select(F.col("p.id").alias("a"), F.col("p.label").alias("la"), F.col("q.id").alias("b"), F.col("q.label").alias("lb"))


def candidate_pairs(labels: DataFrame, low: float, hot: int = HOT, id_col: str = "id", label_col: str = "label") -> DataFrame:
    """(a, la, b, lb): all pairs of labels that share a token and are similar by `low` or more, and some that aren't."""
    rows = featured(labels, id_col, label_col)
    tokens = hot_keys(rows, "t", [], hot)
    each = rows.select("id", "label", F.explode("t").alias("key"))
    if tokens.isEmpty():
        return _pairs(each, each, F.array("key"), F.array("key")).distinct()
    rare = each.join(tokens, "key", "left_anti")
    found = _pairs(rare, rare, F.array("key"), F.array("key"))
    grams = hot_keys(rows, "g", [], hot)
    marked = _hot_of(_hot_of(rows, tokens, "t", "ht", []), grams, "g", "hg", []).where(F.size("ht") > 0)
    # Of two labels that share hot keys only and not the last token, the one with fewer tokens bounds the Jaccard part by
    # its own h / (2 n - h), the one with fewer trigrams the Dice part by its own k / g: both small, and the bar is missed.
    h, k, g = F.size("ht"), F.size("hg"), F.size("g")
    most = 0.6 * h / (2 * F.size("t") - h)
    dense = (most >= low / 2) | (0.4 * k / g >= low / 2)
    # The Dice part adds 0.4 at most: where even that misses the bar, a label needs a partner with fewer tokens that doesn't.
    able = most + 0.4 + SLACK >= low
    found = found.unionByName(_pairs(marked.where(dense & able), marked, F.col("ht"), F.col("ht")))
    found = found.unionByName(_pairs(marked.where(dense & ~able), marked.where(able), F.col("ht"), F.col("ht")))
    last = F.when(F.array_contains("ht", F.col("last")), F.array("last"))
    found = found.unionByName(_pairs(marked, marked, last, last))
    # Two that are not dense need the Dice part for half the bar, so low / 1.6 of the trigrams of both in common, of which the
    # hot ones are k at most. Their rare trigrams meet, few labels a trigram, and are counted.
    loose = marked.where(~dense).withColumn("able", able).withColumn("label", F.struct("label", g.alias("g"), k.alias("k")))
    rest = F.array_except("g", "hg")
    one, two = loose.where("able"), loose.where("not able")
    met = _pairs(one, one, rest, rest).withColumn("n", F.lit(0.5)).unionByName(_pairs(one, two, rest, rest).withColumn("n", F.lit(1.0)))
    met = met.groupBy("a", "la", "b", "lb").agg(F.sum("n").alias("n"))
    enough = met.where(F.col("n") + F.least("la.k", "lb.k") + SLACK >= (F.col("la.g") + F.col("lb.g")) * (low / 1.6))
    return found.unionByName(enough.select("a", F.col("la.label").alias("la"), "b", F.col("lb.label").alias("lb"))).distinct()


def contained_pairs(one: DataFrame, two: DataFrame, by: list[str]) -> DataFrame:
    """(id, other): rows of the second frame whose tokens hold all of a row's of the first, or the reverse; both frames as
    featured() gives them. The smaller set lies in the larger, so its rarest token does: a row stands under that one only."""
    counts = two.select(*by, F.explode("t").alias("key")).unionByName(one.select(*by, F.explode("t").alias("key"))).groupBy(*by, "key").agg(F.count("*").alias("n"))
    every = lambda df, name: df.select(F.col("id").alias(name), *by, F.col("t").alias(f"t_{name}"), F.explode("t").alias("key"))

    def rarest(df: DataFrame, name: str) -> DataFrame:
        first = every(df, name).join(counts, [*by, "key"]).groupBy(name).agg(F.min_by("key", F.struct("n", "key")).alias("key"))
        return df.select(F.col("id").alias(name), *by, F.col("t").alias(f"t_{name}")).join(first, name)

    inside = rarest(one, "id").join(every(two, "other"), [*by, "key"]).where(F.size(F.array_except("t_id", "t_other")) == 0)
    around = every(one, "id").join(rarest(two, "other"), [*by, "key"]).where(F.size(F.array_except("t_other", "t_id")) == 0)
    return inside.select("id", "other").unionByName(around.select("id", "other")).distinct()


def two_best(one: DataFrame, two: DataFrame, by: list[str], hot: int = HOT, *, entered: str | None = None, now: str | None = None) -> DataFrame:
    """(id, other, label, score, place): for each row of the first frame the two most similar rows of the second with
    which it shares a token or trigram, ties to the smaller id; both as featured() gives them. `entered` and `now`, a column of
    the second and one of the first: a row may meet only those that entered before, or always (null); ties then stand open.

    Rows that share a key of few are scored first. What hot keys alone can add is bounded by the row's own: only where the
    bound reaches the second score found do rows meet on hot keys. Those that share hot keys only score by their shapes (hot
    keys and numbers of keys), so shapes meet in place of rows, and the first two rows of a shape stand for all."""
    keys = F.array_distinct(F.concat("t", "g"))
    left, right = (df.withColumn("keys", keys).withColumn("codes", _codes("g")) for df in (one, two))
    hot_ones = hot_keys(right, "keys", by, hot)
    time = lambda c: F.lit(0) if c is None else F.col(c)
    asked = left.select("id", time(now).alias("now"), F.struct("t", "last", F.col("codes").alias("g")).alias("x"), *by, F.explode("keys").alias("key"))
    known = right.select(F.col("id").alias("other"), "label", time(entered).alias("entered"), F.struct("t", "last", F.col("codes").alias("g")).alias("y"), *by, F.explode("keys").alias("key"))
    visible = F.lit(True) if entered is None else F.col("entered").isNull() | (F.col("entered") < F.col("now"))
    order = Window.partitionBy("id").orderBy(F.desc("score"), "other")
    best = lambda df: df.withColumn("place", F.row_number().over(order)).where("place <= 2")

    def scored(known: DataFrame) -> DataFrame:
        # A pair is scored at each key that it shares, which is less work than to make pairs distinct before.
        met = asked.join(known, [*by, "key"]).where(visible).select("id", "other", "label", _score(F.col("x"), F.col("y")).alias("score"))
        return best(met.withColumn("place", F.dense_rank().over(order)).where("place <= 2").drop("place").distinct())

    if hot_ones.isEmpty():
        return scored(known)
    found = made(scored(known.join(hot_ones, [*by, "key"], "left_anti")))
    least = found.where("place = 2").select("id", F.col("score").alias("second"))
    own = _hot_of(left, hot_ones, "keys", "hot", by)
    h, k = F.size(F.array_intersect("t", "hot")), F.size(F.array_intersect("g", "hot"))
    most = 0.6 * h / F.size("t") + 0.8 * k / F.greatest(F.lit(1), F.size("g") + k) + F.when(F.array_contains("hot", F.col("last")), 0.15).otherwise(0.0)
    open_ = own.where(F.size("t") > 0).join(least, "id", "left").where((F.size("hot") > 0) & (F.least(F.lit(1.0), most) >= F.coalesce("second", F.lit(0.0)) - SLACK))
    open_ = _shaped(open_, by).select("id", F.col("label").alias("surface"), time(now).alias("now"), "second", "shape", "s")
    others = _shaped(_hot_of(right, hot_ones, "keys", "hot", by).where(F.size("hot") > 0), by).select(F.col("id").alias("other"), "label", time(entered).alias("entered"), F.col("shape").alias("beside"), "s")
    first = F.row_number().over(Window.partitionBy("beside").orderBy("entered", "other"))
    members = others.drop("s").withColumn("at", first).where("at <= 2").drop("at")
    met = _met(open_.groupBy("shape").agg(F.first("s").alias("s")), others.groupBy("beside").agg(F.first("s").alias("s")).withColumnRenamed("beside", "shape"), by)
    rows = open_.drop("s").join(met, "shape").where(F.col("likely") + SLACK >= F.coalesce("second", F.lit(0.0)))
    rows = rows.join(members, "beside").where(visible).select("id", "surface", "other", "label", "likely")
    # A row with a rare key in common scores more than its shape, and was found: what stands behind two stays behind them.
    likely = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("likely"), "other"))
    more = rows.withColumn("at", likely).where("at <= 2").select("id", "other", "label", F.round(T.similarity(F.col("surface"), F.col("label")), 9).alias("score"))
    return best(found.drop("place").unionByName(more).distinct())


def _codes(grams: str) -> Column:
    """Trigrams as numbers: normalised labels have ASCII only, so each has its own, and numbers are compared faster."""
    at = lambda x, i: F.ascii(F.substring(x, i, 1))
    return F.transform(grams, lambda x: at(x, 1) * 16384 + at(x, 2) * 128 + at(x, 3))


def _score(x: Column, y: Column) -> Column:
    """T.similarity of two labels by their distinct tokens, last tokens and trigrams."""
    h, k = F.size(F.array_intersect(x["t"], y["t"])), F.size(F.array_intersect(x["g"], y["g"]))
    jaccard = h / F.greatest(F.lit(1), F.size(x["t"]) + F.size(y["t"]) - h)
    dice = 2 * k / F.greatest(F.lit(1), F.size(x["g"]) + F.size(y["g"]))
    total = 0.6 * jaccard + 0.4 * dice + F.when(x["last"] == y["last"], 0.15).otherwise(0.0)
    return F.round(F.when((F.size(x["t"]) == 0) | (F.size(y["t"]) == 0), 0.0).otherwise(F.least(F.lit(1.0), total)), 9)


def _shaped(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows (with hot, an array) with s, all that tells how they score on hot keys, and its digest, shape."""
    mine = lambda c: F.array_sort(F.array_intersect(c, "hot"))
    s = F.struct(*by, mine("t").alias("t"), mine("g").alias("g"), F.size("t").alias("n"), F.size("g").alias("m"), F.when(F.array_contains("hot", F.col("last")), F.col("last")).alias("last"))
    return rows.withColumn("s", s).withColumn("shape", F.md5(F.to_json("s")))


def _met(ours: DataFrame, theirs: DataFrame, by: list[str]) -> DataFrame:
    """(shape, beside, likely): shapes with a hot key in common, and the score of rows that have no other key in common."""
    keys = lambda c: F.transform(f"s.{c}", lambda x: F.struct(F.lit(c).alias("c"), x.alias("x")))
    key = lambda df, name: df.select(F.col("shape").alias(name), *(F.col(f"s.{c}").alias(c) for c in by), F.explode(F.concat(keys("t"), keys("g"))).alias("key"))
    shared = key(ours, "shape").join(key(theirs, "beside"), [*by, "key"]).groupBy("shape", "beside").agg(F.count(F.when(F.col("key.c") == "t", 1)).alias("h"), F.count(F.when(F.col("key.c") == "g", 1)).alias("k"))
    side = lambda df, name: df.select(F.col("shape").alias(name), *(F.col(f"s.{c}").alias(f"{c}_{name}") for c in ("n", "m", "last")))
    rows = shared.join(side(ours, "shape"), "shape").join(side(theirs, "beside"), "beside")
    jaccard = F.col("h") / F.greatest(F.lit(1), F.col("n_shape") + F.col("n_beside") - F.col("h"))
    dice = 2 * F.col("k") / F.greatest(F.lit(1), F.col("m_shape") + F.col("m_beside"))
    total = F.least(F.lit(1.0), 0.6 * jaccard + 0.4 * dice + F.when(F.col("last_shape") == F.col("last_beside"), 0.15).otherwise(0.0))
    return rows.select("shape", "beside", F.round(F.when((F.col("n_shape") == 0) | (F.col("n_beside") == 0), 0.0).otherwise(total), 9).alias("likely"))
