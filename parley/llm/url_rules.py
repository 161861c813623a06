"""URL filtering by rules that are given and rules that FP-growth mines from labels.

A given rule is a host and a path prefix; it fits the host and its subdomains, and the longest fitting
rule decides. Where none fits, mined rules do: a URL is a basket of tokens (host suffixes, path
segments with their digits folded, query keys, extension), each labelled URL adds its label, and
FP-growth finds the token combinations that imply a label with enough support and confidence. Rules
are pruned by both, and stand in an inverted index under their rarest token: a URL meets only the
rules whose rarest token it has, and each is verified against the whole token set. The most
confident rule decides, then the better supported, the longer, and the one that sorts last. Without
any match a URL is allowed. The index is an array of slots by the hash of that token, which goes to the
scan of the URLs, so that no URL is shuffled; only more rules than fit are joined. DataFrame functions only;
mining runs in Spark's own FP-growth.
"""

from __future__ import annotations

import json

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import materialize

MIN_SUPPORT, MIN_CONFIDENCE = 0.002, 0.6
#: Labelled URLs that a combination must occur in at least, whatever its share.
MIN_COUNT = 20
#: Mined rules go to the scan up to so many, and so many characters of tokens, else URLs are joined with them by
#: a shuffle; both give the same.
SCAN_RULES, SCAN_CHARS = 20_000, 4 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(.*)$"
LABEL = "label="


def host_of(url: Column) -> Column:
    """After the first :// up to /, ? or #, with A-Z lower-cased; empty for null or without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def _suffixes(host: Column) -> Column:
    """The host and every domain above it."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def tokens_of(url: Column) -> Column:
    """The distinct tokens of a URL; none where it is null or has no host."""
    host, path, rest = host_of(url), path_of(url), F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 3)
    fold = lambda x: F.regexp_replace(x, "[0-9]+", "0")
    hosts = F.transform(_suffixes(host), lambda s: F.concat(F.lit("host="), s))
    segments = F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), lambda s: F.concat(F.lit("path="), fold(s)))
    keys = F.transform(F.regexp_extract_all(rest, F.lit("[?&]([^=&#]+)"), F.lit(1)), lambda k: F.concat(F.lit("query="), fold(k)))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(hosts, segments, keys)))


def given_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of the rules (verdict, "host/path") that fits; null without one."""
    order = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    rule = verdict = None
    for decision, text in order:
        domain, slash, prefix = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + prefix)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, decision) if verdict is None else verdict.when(fits, decision)
    return (rule, verdict) if order else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def mine(labelled: DataFrame, url_col: str = "url", label_col: str = "label", min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(key, tokens, label, confidence, support): pruned rules, each under its rarest token.

    Rows with a null label or no tokens are no baskets; repeated rows count each, and a URL with two labels is
    a basket of either. Fewer than MIN_COUNT baskets, an empty table too, or no frequent rule give no rules."""
    baskets = labelled.select(tokens_of(F.col(url_col)).alias("tokens"), F.col(label_col).cast("string").alias("label")).where("label is not null and size(tokens) > 0")
    baskets = materialize(baskets, "url-baskets")
    n = baskets.count()
    if n < MIN_COUNT:
        return baskets.select(F.col("label").alias("key"), "tokens", "label", F.lit(0.0).alias("confidence"), F.lit(0.0).alias("support"))
    model = FPGrowth(itemsCol="items", minSupport=max(min_support, MIN_COUNT / n), minConfidence=min_confidence).fit(baskets.select(F.array_append("tokens", F.concat(F.lit(LABEL), "label")).alias("items")))
    rules = model.associationRules.where(F.element_at("consequent", 1).startswith(LABEL))
    rules = rules.where(~F.exists("antecedent", lambda t: t.startswith(LABEL)))
    # The model mines again whenever it is asked: once is enough.
    rules = materialize(rules.select(F.array_sort("antecedent").alias("tokens"), F.substring(F.element_at("consequent", 1), len(LABEL) + 1, 1 << 20).alias("label"), "confidence", "support"), "url-mined")
    often = baskets.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    placed = rules.select("*", F.explode("tokens").alias("token")).join(often, "token")
    rarest = placed.groupBy("tokens", "label", "confidence", "support").agg(F.min_by("token", F.struct("n", "token")).alias("key"))
    return rarest.select("key", "tokens", "label", "confidence", "support")


def _order(rule: Column) -> Column:
    """The rule that decides is the greatest."""
    return F.struct(rule["confidence"].alias("confidence"), rule["support"].alias("support"), F.size(rule["tokens"]).alias("length"), F.array_join(rule["tokens"], " ").alias("text"), rule["label"].alias("label"))


RULE = "struct<tokens:array<string>,label:string,confidence:double,support:double>"


def label_in_scan(own: Column, rules: DataFrame, count: int) -> Column:
    """The label of the best mined rule for a URL's tokens, by the index in the scan; null without one. The rules
    are few (see judge) and become a constant of the plan: an array of slots, each with its rules."""
    slots = 1 << max(4, (2 * count - 1).bit_length())
    slot = lambda token: F.pmod(F.xxhash64(token), F.lit(slots)).cast("int")
    index: list[list[dict]] = [[] for _ in range(slots)]
    for r in rules.select(slot(F.col("key")).alias("slot"), "tokens", "label", "confidence", "support").collect():
        index[r["slot"]].append({c: r[c] for c in ("tokens", "label", "confidence", "support")})
    held = F.from_json(F.lit(json.dumps(index)), f"array<array<{RULE}>>")
    met = F.flatten(F.transform(own, lambda t: F.get(held, slot(t))))
    fits = F.filter(met, lambda r: F.size(F.array_except(r["tokens"], own)) == 0)
    return F.array_max(F.transform(fits, _order))["label"]


def match(urls: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """(url, label): the label of the best mined rule for each distinct URL that has one, by a join on the
    rarest token; for more rules than a scan should hold."""
    asked = urls.select(url_col).distinct().select(url_col, tokens_of(F.col(url_col)).alias("own"))
    met = asked.select("*", F.explode("own").alias("key")).join(rules, "key").where(F.size(F.array_except("tokens", "own")) == 0)
    rule = {c: F.col(c) for c in ("confidence", "support", "tokens", "label")}
    return met.groupBy(url_col).agg(F.max(_order(rule))["label"].alias("label"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], mined: DataFrame, id_col: str = "page_id", url_col: str = "url", scan_rules: int = SCAN_RULES) -> DataFrame:
    """(id, url, host, path, rule, verdict) of every row.

    One row per input row, repeated rows included; a null id changes nothing. A null url, or one without
    ://, has empty host and path, fits no rule and is allowed; an empty url likewise. A long url is judged
    whole. An empty table gives an empty result; other columns are unread."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    rows = rows.select("*", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, given = given_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), given.alias("given"))
    mined = materialize(mined, "url-rules")
    chars = F.aggregate("tokens", F.lit(0), lambda n, t: n + F.length(t))
    count, chars = mined.agg(F.count("*"), F.coalesce(F.sum(chars), F.lit(0))).first()
    if count == 0:
        rows = rows.withColumn("label", F.lit(None).cast("string"))
    elif count <= scan_rules and chars <= SCAN_CHARS:
        # Tokens in a column of their own: they are made once a URL, not once a rule.
        rows = rows.withColumn("own", F.when(F.col("given").isNull() & (F.col("host") != ""), tokens_of(F.col("url"))))
        rows = rows.withColumn("label", label_in_scan(F.col("own"), mined, count)).drop("own")
    else:
        rows = rows.join(match(rows.where("given is null and host <> ''"), mined), "url", "left")
    return rows.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "host", "path", "rule", F.coalesce("given", "label", F.lit("allow")).alias("verdict"))
