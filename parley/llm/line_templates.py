"""Line dedup with a fixed-depth template tree, in DataFrame functions only.

A line's tokens that hold a digit become a wildcard. The tree routes a line by its number of tokens
and its first LEAD tokens to a leaf. In a leaf, the token that most of its distinct lines have at a
position is constant there if it holds at least MAJORITY of them; other positions are variable. Lines
that agree with every constant, where constants are at least SIMILARITY of the tokens and the line
has at least MIN_TOKENS tokens, follow the leaf's template. The other lines of a leaf are split into
groups, each line by the token that most lines of its group share with it among those that are not
constant there, and each group is treated like a leaf, again and again, until a group is too small for
a template or no two of its lines share such a token. So each template's majority is taken over its own
lines. A template found that way takes all lines of the leaf that agree with its constants. Any other
line is its own template. A template that occurs in MIN_DOCS documents or more is dropped from all of them but the one with the
smallest id, so that each text survives once.

What travels is a row of hashes for each distinct line of a document; the text of lines is only
needed again for leaves in which several lines might share a template. A line is known by two 64-bit hashes,
that of its leaf and its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import materialize, packed

LEAD, MAJORITY, SIMILARITY, MIN_TOKENS, MIN_DOCS = 3, 0.6, 0.8, 5, 6
WILD = "<*>"
#: White space between tokens, and a token with a digit (looked for at its first character only).
SPACE, VARIABLE = r"[ \t\x0B\f\r]{2,}|[\t\x0B\f\r]", r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*+"
#: Leaves in doubt are broadcast up to so many rows of 8 bytes, else joined by a shuffle.
BROADCAST_ROWS = 100_000


def masked(line: Column) -> Column:
    """The line with single spaces and wildcards for variable tokens; most lines need neither rewrite."""
    spaced = F.trim(F.when(line.rlike(SPACE), F.regexp_replace(line, SPACE, " ")).otherwise(line))
    return F.when(line.rlike("[0-9]"), F.regexp_replace(spaced, VARIABLE, WILD)).otherwise(spaced)


def _line_key(m: Column) -> Column:
    return F.xxhash64(m)


def _leaf_key(m: Column) -> Column:
    """The leaf by the number of tokens and the first ones."""
    tokens = F.length(m) - F.length(F.replace(m, F.lit(" "), F.lit(""))) + 1
    return F.xxhash64(tokens, F.substring_index(m, " ", LEAD))


def _exploded(docs: DataFrame) -> DataFrame:
    lines = docs.where("doc is not null").select("doc", F.explode(F.split("text", "\n")).alias("line"))
    lines = lines.select("doc", masked(F.col("line")).alias("m")).where("m <> ''")
    tokens = F.length("m") - F.length(F.replace(F.col("m"), F.lit(" "), F.lit(""))) + 1
    return lines.select("doc", "m", tokens.alias("tokens"), _leaf_key(F.col("m")).alias("leaf"), _line_key(F.col("m")).alias("line"))


def _bounded(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it is small enough; else the planner's shuffle join stands."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _constants(tokens: DataFrame, group: str, size: str) -> DataFrame:
    """(group, at, expected): the tokens that a majority of the lines of a group have."""
    counts = tokens.groupBy(group, size, "at", "token").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= MAJORITY * F.col(size)).select(group, "at", F.col("token").alias("expected"))


def _leaf_members(tokens: DataFrame, group: str, size: str) -> DataFrame:
    """(group, line): the lines that agree with every constant of their group, where these are enough."""
    agree = tokens.join(_constants(tokens, group, size), [group, "at"]).groupBy(group, "line", "tokens").agg(F.count("*").alias("constants"), F.sum(F.when(F.col("token") == F.col("expected"), 1).otherwise(0)).alias("equal"))
    return agree.where((F.col("equal") == F.col("constants")) & (F.col("constants") >= SIMILARITY * F.col("tokens"))).select(group, "line")


def _recur(members: DataFrame, pairs: DataFrame, min_docs: int, group: str = "leaf") -> DataFrame:
    """members (leaf, line, group) of the groups that stand in enough documents, with the smallest id."""
    spread = members.join(pairs.select("leaf", "line", "doc"), ["leaf", "line"]).select(group, "doc").distinct().groupBy(group).agg(F.count("*").alias("docs"), F.min("doc").alias("first"))
    return members.join(spread.where(F.col("docs") >= min_docs), group)


def _split_templates(rest: DataFrame, whole: DataFrame, pairs: DataFrame, each: DataFrame, min_docs: int) -> DataFrame:
    """(leaf, line, first): the recurring templates of lines that do not follow their leaf's template."""
    docs = each.select("leaf", "line", "docs")
    lines, found = rest.withColumn("group", F.col("leaf")), []
    while True:
        # A group that stands in fewer documents can hold no template.
        each_line = lines.select("group", "leaf", "line").distinct().join(docs, ["leaf", "line"])
        sizes = each_line.groupBy("group").agg(F.count("*").alias("size"), F.sum("docs").alias("docs")).where((F.col("size") > 1) & (F.col("docs") >= min_docs)).select("group", "size")
        lines = materialize(lines.join(sizes, "group").select("group", "size", "leaf", "line", "tokens", "at", "token"), "line-groups")
        if lines.isEmpty():
            break
        members = materialize(_leaf_members(lines, "group", "size"), "line-split")
        constants = _constants(lines, "group", "size").join(members.select("group").distinct(), "group", "left_semi")
        found.append(lines.select("group", "leaf").distinct().join(constants, "group"))
        # The others go by their most frequent token that is not constant; one that no other line has leads nowhere.
        counts = lines.groupBy("group", "size", "at", "token").agg(F.count("*").alias("n")).where((F.col("n") > 1) & (F.col("n") < MAJORITY * F.col("size")))
        others = lines.join(members, ["group", "line"], "left_anti")
        route = others.join(counts.drop("size"), ["group", "at", "token"]).groupBy("group", "line").agg(F.max(F.struct("n", -F.col("at"), "token")).alias("by"))
        routed = others.join(route, ["group", "line"]).withColumn("to", F.xxhash64("group", "by"))
        lines = routed.select(F.col("to").alias("group"), "leaf", "line", "tokens", "at", "token")
    if not found:
        return pairs.select("leaf", "line", F.col("doc").alias("first")).limit(0)
    constants = found[0]
    for f in found[1:]:
        constants = constants.unionByName(f)
    # Each line of the leaf is hashed at the positions of each set of constants.
    at_token = F.array_sort(F.collect_list(F.struct("at", "token")))
    shape = constants.withColumnRenamed("expected", "token").groupBy("group", "leaf").agg(at_token.alias("c"))
    shape = materialize(shape.select("leaf", F.col("c.at").alias("mask"), F.xxhash64("c.token").alias("shape")).distinct(), "line-shapes")
    own = whole.join(shape.select("leaf").distinct(), "leaf", "left_semi").select("leaf", "line", "all")
    seen = own.join(shape.select("leaf", "mask").distinct(), "leaf").withColumn("shape", F.xxhash64(F.transform("mask", lambda i: F.col("all")[i])))
    members = seen.join(shape, ["leaf", "mask", "shape"]).select("leaf", "line", F.xxhash64("leaf", "mask", "shape").alias("template"))
    return _recur(materialize(members, "line-members"), pairs, min_docs, "template").select("leaf", "line", "first")


def recurring(docs: DataFrame, id_col: str, text_col: str, min_docs: int, split: bool = True) -> tuple[DataFrame, DataFrame]:
    """(leaf, line, first), keys of lines whose template recurs and the smallest id that has the template; and
    (doc, leaf, line), the distinct lines of each document."""
    base = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    lines = _exploded(base)
    pairs = materialize(lines.groupBy("doc", "leaf", "line", "tokens").agg(F.count("*").alias("times")), "line-pairs")
    each = materialize(pairs.groupBy("leaf", "line", "tokens").agg(F.count("*").alias("docs"), F.min("doc").alias("first")), "line-each")
    exact = each.where(F.col("docs") >= min_docs).select("leaf", "line", "first")

    doubt = each.where(F.col("tokens") >= MIN_TOKENS).groupBy("leaf").agg(F.count("*").alias("variants"), F.sum("docs").alias("docs")).where((F.col("variants") > 1) & (F.col("docs") >= min_docs)).select("leaf", "variants")
    doubt = materialize(doubt, "line-doubt")
    if doubt.isEmpty():
        return exact, pairs
    near = _bounded(doubt)
    # The text of a line is taken from the first document that has it; other documents are not split again.
    holders = materialize(each.join(near, "leaf").select("first").distinct(), "line-holders")
    source = base.join(_bounded(holders.select(F.col("first").alias("doc"))), "doc", "left_semi")
    texts = _exploded(source).join(near, "leaf").select("leaf", "variants", "line", "tokens", "m").distinct()
    whole = materialize(texts.select("leaf", "variants", "line", "tokens", F.transform(F.split("m", " "), lambda t: F.xxhash64(t)).alias("all")), "line-tokens")
    tokens = whole.select("leaf", "variants", "line", "tokens", F.posexplode("all").alias("at", "token"))
    members = _leaf_members(tokens, "leaf", "variants")
    members = materialize(members, "line-members")
    templates = _recur(members, pairs, min_docs).select("leaf", "line", "first")
    if split:
        rest = whole.join(members, ["leaf", "line"], "left_anti").select("leaf", "line", "tokens", F.posexplode("all").alias("at", "token"))
        templates = templates.unionByName(_split_templates(rest, whole, pairs, each, min_docs))
    return exact.unionByName(templates).groupBy("leaf", "line").agg(F.min("first").alias("first")), pairs


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, split: bool = True) -> DataFrame:
    """(doc, lines array<struct<leaf,line>>): per id the keys of the lines to drop; ids that keep all are absent."""
    again, pairs = recurring(docs, id_col, text_col, min_docs, split)
    again = materialize(again, "line-recurring")
    found = pairs.select("doc", "leaf", "line").join(again, ["leaf", "line"]).where("doc > first")
    return found.groupBy("doc").agg(F.collect_set(F.struct("leaf", "line")).alias("lines"))


def _cut(docs: DataFrame, columns: list[str], id_col: str, text_col: str, min_docs: int, split: bool) -> DataFrame:
    """(row struct of some columns, text, n_lines, n_dropped) of every row."""
    gone = dropped_lines(docs, id_col, text_col, min_docs, split)
    rows = docs.select(packed(docs, columns).alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    lines = F.split("text", "\n")
    each = F.transform(lines, lambda x: F.struct(x.alias("x"), masked(x).alias("m")))
    left = F.filter(each, lambda e: ~F.array_contains("lines", F.struct(_leaf_key(e["m"]).alias("leaf"), _line_key(e["m"]).alias("line"))))
    joined = rows.join(gone, F.col("id") == F.col("doc"), "left").select("row", "text", F.when(F.col("lines").isNotNull(), left).alias("left"))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines))
    kept = F.when(F.col("left").isNull(), F.col("text")).otherwise(F.array_join(F.transform("left", lambda e: e["x"]), "\n"))
    return joined.select("row", kept.alias("text"), n.alias("n_lines"), F.when(F.col("left").isNull(), 0).otherwise(n - F.size("left")).alias("n_dropped"))


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, split: bool = True) -> DataFrame:
    """(id, text, n_lines, n_dropped) of every row, by the rules of drop_templates."""
    return _cut(docs, [id_col], id_col, text_col, min_docs, split).select(F.col("row")[id_col].alias(id_col), "text", "n_lines", "n_dropped")


def drop_templates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, split: bool = True) -> DataFrame:
    """The columns of docs, whatever their names, with the text cut to the lines that stay.

    One row per input row. Rows of one id are one document: they count once, and a line that is
    dropped from the id is dropped from each. A null text stays null and has no lines; an empty text
    has one empty line; lines without a token are kept and never counted. Rows with a null id are
    kept whole and not counted. A long text is cut like any other; a template never spans lines. An empty
    table gives an empty result. Without split a leaf holds one template at most."""
    cut = _cut(docs, docs.columns, id_col, text_col, min_docs, split)
    return cut.select(*(F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))
