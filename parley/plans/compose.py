"""Grounded composition around scripted model outputs (CP-14, CP-15, CP-18, TREE-8, TREE-9).

The model is outside the engine: its answers come as a table of attempts. Each attempt is validated,
the first without failures wins; if only soft failures are left after the second attempt it is kept;
else, after the last, the failing leaves are pruned."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import text as T
from parley.operators import gates, outline

ATTEMPTS, SOFT_STOP = 3, 2


def leaves_of(attempts: DataFrame) -> DataFrame:
    """attempts (meeting_id, attempt, json) -> bullets with doc_id `meeting|attempt`."""
    return outline.bullets(attempts.select(F.concat_ws("|", "meeting_id", "attempt").alias("doc_id"), "json"))


def judged(attempts: DataFrame, segs: DataFrame, owners: DataFrame) -> DataFrame:
    """(meeting_id, attempt, path, rule, detail): the failures of every attempt."""
    b = leaves_of(attempts)
    top = b.where("size(path) = 1").select("doc_id", F.col("path")[0].alias("a"), F.col("text").alias("section"))
    rows = b.where("is_leaf").withColumn("a", F.col("path")[0]).join(top, ["doc_id", "a"])
    at = F.split("doc_id", r"\|")
    rows = rows.select(at[0].alias("meeting_id"), F.concat(at[1], F.lit("/"), outline.path_text(F.col("path"))).alias("path"), "text", F.coalesce("source", F.array().cast("array<string>")).alias("source"), "section")
    found = gates.validate_leaves(rows, segs, owners)
    p = F.split("path", "/")
    return found.select("meeting_id", p[0].cast("int").alias("attempt"), p[1].alias("path"), "rule", "detail")


def choose(attempts: DataFrame, failures: DataFrame) -> DataFrame:
    """(meeting_id, attempt, outcome): clean, soft or pruned."""
    hard = ~F.col("rule").isin(gates.SOFT)
    count = failures.groupBy("meeting_id", "attempt").agg(F.count_if(hard).alias("hard"), F.count("*").alias("all"))
    rows = attempts.where(F.col("attempt") <= ATTEMPTS).select("meeting_id", "attempt").join(count, ["meeting_id", "attempt"], "left").fillna(0, ["hard", "all"])
    last = F.max("attempt").over(Window.partitionBy("meeting_id"))
    rank = F.when(F.col("all") == 0, F.col("attempt")).when((F.col("hard") == 0) & (F.col("attempt") >= SOFT_STOP), F.col("attempt") + 0.5).when(F.col("attempt") == last, F.lit(99.0))
    outcome = F.when(F.col("all") == 0, "clean").when(F.col("hard") == 0, "soft").otherwise("pruned")
    ranked = rows.withColumn("rank", rank).withColumn("outcome", outcome).where("rank is not null")
    return ranked.groupBy("meeting_id").agg(F.min_by("attempt", "rank").alias("attempt"), F.min_by("outcome", "rank").alias("outcome"))


def compose(attempts: DataFrame, segs: DataFrame, owners: DataFrame) -> DataFrame:
    """(meeting_id, outcome, markdown): the chosen attempt, its hard failures pruned from the tree."""
    failures = judged(attempts, segs, owners).persist()  # read twice: to choose, and to prune
    chosen = choose(attempts, failures)
    doc = F.concat_ws("|", "meeting_id", "attempt").alias("doc_id")
    rows = leaves_of(attempts.join(chosen, ["meeting_id", "attempt"]).select("meeting_id", "attempt", "json"))
    hard = failures.where(~F.col("rule").isin(gates.SOFT)).select(doc, F.transform(F.split("path", r"\."), lambda x: x.cast("int")).alias("path")).distinct()
    text = outline.to_markdown(outline.rebuild(rows, hard))
    return chosen.select("meeting_id", "outcome", doc).join(text, "doc_id", "left").select("meeting_id", "outcome", F.coalesce("markdown", F.lit("")).alias("markdown"))


#: Levels of a summary, errors that are fed back, least overlap of a leaf and least share of words.
SUMMARY_DEPTH, FED_BACK, LEXICAL_MIN, COVERED = 2, 5, 0.4, 0.6


def structured_summaries(attempts: DataFrame) -> DataFrame:
    """(doc_id, attempt, status, feedback) of scripted summaries (doc_id, attempt, json): the first whose shape is
    right is shipped; feedback is what the attempt after the last one seen would be told, null once shipped (CP-23)."""
    key = F.concat_ws("|", "doc_id", "attempt")
    errors = outline.shape_errors(attempts.select(key.alias("doc_id"), "json"), SUMMARY_DEPTH)
    listed = errors.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("path", "error"))).alias("x"))
    text = F.concat(F.lit("schema validation failed: "), F.array_join(F.transform(F.slice("x", 1, FED_BACK), lambda e: F.concat(e["path"], F.lit(": "), e["error"])), "; "))
    rows = attempts.withColumn("key", key).join(listed.select(F.col("doc_id").alias("key"), text.alias("feedback")), "key", "left")
    ranked = rows.groupBy("doc_id").agg(F.min(F.when(F.col("feedback").isNull(), F.col("attempt"))).alias("good"), F.max("attempt").alias("last"), F.max_by("feedback", "attempt").alias("feedback"))
    return ranked.select("doc_id", F.coalesce("good", "last").alias("attempt"), F.when(F.col("good").isNotNull(), "shipped").otherwise("failed").alias("status"), F.when(F.col("good").isNull(), F.col("feedback")).alias("feedback"))


def scores(leaves: DataFrame, failures: DataFrame, labels: DataFrame, statements: DataFrame, themes: DataFrame) -> DataFrame:
    """(doc_id, leaves, strict, lexical, statement_recall, theme_recall) of notes against labelled fixtures (AG-19).

    leaves: doc_id, path, text, cited; failures: doc_id, path; labels, statements and themes: doc_id, text. strict is
    the share of leaves without a failure, lexical that of leaves that share LEXICAL_MIN of their words with their
    source; an expected statement is found if COVERED of its content words stand in the leaves, an expected theme if
    it stands in a label or leaf. A share of nothing is 1."""
    bad = failures.select("doc_id", "path").distinct().withColumn("bad", F.lit(True))
    near = T.lexical_overlap(F.col("text"), T.flat(F.col("cited"))) >= LEXICAL_MIN
    of = leaves.join(bad, ["doc_id", "path"], "left").groupBy("doc_id").agg(F.count("*").alias("leaves"), F.avg(F.when(F.col("bad").isNull(), 1.0).otherwise(0.0)).alias("strict"), F.avg(F.when(near, 1.0).otherwise(0.0)).alias("lexical"))
    blob = lambda df, name: df.groupBy("doc_id").agg(F.lower(F.array_join(F.array_sort(F.collect_list("text")), " | ")).alias(name))
    said = blob(leaves.select("doc_id", "text"), "said")
    named = blob(labels.select("doc_id", "text").unionByName(leaves.select("doc_id", "text")), "named")
    words = F.array_distinct(T.content_words(F.col("text")))
    hit = F.coalesce(F.size(F.filter(words, lambda x: F.contains("said", x))) / F.nullif(F.size(words), F.lit(0)), F.lit(1.0)) >= COVERED
    share = lambda df, ok, name: df.groupBy("doc_id").agg(F.avg(F.when(ok, 1.0).otherwise(0.0)).alias(name))
    found = share(statements.join(said, "doc_id"), hit, "statement_recall")
    seen = share(themes.join(named, "doc_id"), F.contains("named", F.lower("text")), "theme_recall")
    return of.join(found, "doc_id", "left").join(seen, "doc_id", "left").fillna(1.0, ["statement_recall", "theme_recall"])
