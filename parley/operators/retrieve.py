"""Hybrid retrieval: postings, BM25, graph arm, rank fusion, recency, per-meeting cap (FLT-7, SN-6..8, WN-2, CP-8)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.functions import stem as S
from parley.functions import text as T
from parley.operators.graph import nearest_chunks

#: Weights of a chunk's columns and the smallest weight of a term.
WEIGHTS, LEAST_IDF = {"text": 10, "speakers": 2}, 1e-6
#: BM25 constants, fusion constant and arm weights, arm and mention limits, cap and length of the answer.
K1, B, RRF_K, W_LEX, W_GRAPH, ARM_LIMIT, MENTION_LIMIT, PER_MEETING, TOP = 1.2, 0.75, 60, 1.0, 0.6, 60, 80, 3, 12
RECENCY, HALF_DAYS, DAY_MS = 0.15, 180.0, 86_400_000.0


def terms_of(question: str) -> list[str]:
    """The question's terms in order, repeated ones too."""
    import re

    words = re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s]", " ", question.lower())).strip().split(" ")
    return [w for w in words if len(w) >= 2 and w not in T.STOP_QUERY]


class Lexicon(Protocol):
    """Whatever scores chunks for a question's terms: an index in frames, or one that is stored."""

    def scores(self, terms: list[str], k: int) -> DataFrame: ...


@dataclass(frozen=True)
class Index:
    """An inverted index of chunks: postings (chunk_id, term, tf, dl), where tf adds up the columns' weights,
    and one row of totals (n chunks, avgdl). stemmed tells how terms of a question are to be looked up."""

    postings: DataFrame
    totals: DataFrame
    stemmed: bool = True

    def save(self, path: str, files: int | None = None) -> None:
        """Write both as Parquet, postings in ranges of terms, so that a question reads the row groups of
        its terms only."""
        spread = self.postings.repartitionByRange(*([files] if files else []), "term").sortWithinPartitions("term", "chunk_id")
        spread.write.mode("overwrite").parquet(f"{path}/postings")
        self.totals.write.mode("overwrite").parquet(f"{path}/totals")

    def scores(self, terms: list[str], k: int) -> DataFrame:
        """(chunk_id, score) of a question, of the k best chunks at least."""
        return bm25(self, terms)

    @staticmethod
    def load(spark: SparkSession, path: str, stemmed: bool = True) -> Index:
        return Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/totals"), stemmed)


def index(chunks: DataFrame, stemmed: bool = True) -> Index:
    """The index of chunks (id, text, speakers): terms are folded and Porter-stemmed, or plain words."""
    words = (lambda c: S.index_terms(c)) if stemmed else (lambda c: F.filter(F.split(T.normalize(F.col(c)), " "), lambda w: w != ""))
    rows = chunks.select(F.col("id").alias("chunk_id"), *(F.coalesce(words(c), F.array().cast("array<string>")).alias(c) for c in WEIGHTS))
    rows = rows.withColumn("dl", sum((F.size(c) for c in WEIGHTS), F.lit(0)))
    weighed = lambda w: lambda t: F.struct(t.alias("term"), F.lit(w).alias("w"))
    each = F.concat(*(F.transform(c, weighed(w)) for c, w in WEIGHTS.items()))
    post = rows.select("chunk_id", "dl", F.explode(each).alias("t")).groupBy("chunk_id", "dl", F.col("t.term").alias("term")).agg(F.sum("t.w").alias("tf"))
    return Index(post.select("chunk_id", "term", "tf", "dl"), rows.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")), stemmed)


def matches(ix: Index, terms: list[str]) -> DataFrame:
    """(chunk_id, dl, q, tf) of chunks that match a question (FLT-7): all terms, the last as a prefix; if no
    chunk has, any term as a whole. q is the term's place; a term that stands twice counts twice. Both are
    one filtered scan of the postings, of which a flag chooses."""
    looked = [S.porter(t) for t in terms] if ix.stemmed else terms
    whole = [F.col("term") == t for t in looked]
    begun = [*whole[:-1], F.col("term").startswith(looked[-1])]
    some = ix.postings.where(reduce(lambda a, b: a | b, begun))
    hits = F.array_compact(F.array(*(F.when(b, F.struct(F.lit(i).alias("q"), w.alias("whole"))) for i, (b, w) in enumerate(zip(begun, whole)))))
    each = some.select("chunk_id", "dl", "tf", F.explode(hits).alias("h")).groupBy("chunk_id", "dl", "h.q").agg(F.sum("tf").alias("begun"), F.sum(F.when(F.col("h.whole"), F.col("tf"))).alias("whole"))
    full = each.groupBy("chunk_id").agg((F.count("*") == len(terms)).alias("strict"))
    found = full.agg(F.coalesce(F.bool_or("strict"), F.lit(False)).alias("any_strict"))
    rows = each.join(F.broadcast(found)).select("chunk_id", "dl", "q", "any_strict", F.when(F.col("any_strict"), F.col("begun")).otherwise(F.col("whole")).alias("tf")).where("tf is not null")
    return rows.join(full, "chunk_id").withColumn("kept", ~F.col("any_strict") | F.col("strict")).select("chunk_id", "dl", "q", "tf", "kept")


def bm25(ix: Index, terms: list[str]) -> DataFrame:
    """(chunk_id, score): BM25 over the matching chunks; document frequencies are those of the whole index,
    and a term of most chunks keeps a smallest weight (SN-6)."""
    m = matches(ix, terms)
    df = m.groupBy("q").agg(F.count("*").alias("df"))
    idf = F.greatest(F.lit(LEAST_IDF), F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return m.where("kept").join(F.broadcast(df), "q").join(F.broadcast(ix.totals)).groupBy("chunk_id").agg(F.round(F.sum(part), 12).alias("score"))


def ranked(scores: DataFrame, limit: int, *order: Column) -> DataFrame:
    """(chunk_id, rank from 0) of the first rows in order; ends in the chunk id, so ranks are unique."""
    first = scores.orderBy(*order, "chunk_id").limit(limit)
    return first.select("chunk_id", (F.row_number().over(Window.orderBy(*order, "chunk_id")) - 1).alias("rank"))


def lexical_arm(ix: Lexicon, terms: list[str]) -> DataFrame:
    return ranked(ix.scores(terms, ARM_LIMIT), ARM_LIMIT, F.desc("score"))


def seeds(entities: DataFrame, terms: list[str]) -> DataFrame:
    """Live entities whose normalised alias holds a term (FLT-5)."""
    return entities.where(F.col("merged_into").isNull() & reduce(lambda a, b: a | b, [F.contains("norm", F.lit(t)) for t in terms])).select("id").distinct()


def graph_mentions(entities: DataFrame, related: DataFrame, mentions: DataFrame, terms: list[str]) -> DataFrame:
    """Passed mentions of seeds and of entities one related hop away, seeds first (JN-20, SET-3, TK-4)."""
    s = seeds(entities, terms).withColumn("is_seed", F.lit(1))
    hop = related.join(s.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
    every = s.unionByName(hop.join(s, "id", "left_anti").withColumn("is_seed", F.lit(0)))
    rows = mentions.where("gate = 'passed'").join(every.withColumnRenamed("id", "entity_id"), "entity_id")
    return rows.select("entity_id", "meeting_id", "offset_s", "is_seed").distinct().orderBy(F.desc("is_seed"), "entity_id", "meeting_id", "offset_s").limit(MENTION_LIMIT)


def graph_arm(entities: DataFrame, related: DataFrame, mentions: DataFrame, chunks: DataFrame, terms: list[str]) -> DataFrame:
    m = graph_mentions(entities, related, mentions, terms)
    order = Window.orderBy(F.desc("is_seed"), "entity_id", "meeting_id", "offset_s")
    placed = m.withColumn("at", F.row_number().over(order))
    near = nearest_chunks(placed, chunks, ["entity_id", "meeting_id", "offset_s", "at"])
    return ranked(near.groupBy("chunk_id").agg(F.min("at").alias("at")), ARM_LIMIT, F.col("at"))


def fused(lexical: DataFrame, graph: DataFrame | None) -> DataFrame:
    """(chunk_id, score): sum of weight / (60 + rank + 1) over the arms (SN-7)."""
    arm = lambda df, w: df.select("chunk_id", (F.lit(w) / (RRF_K + F.col("rank") + 1)).alias("part"))
    both = arm(lexical, W_LEX)
    if graph is not None:
        both = both.unionByName(arm(graph, W_GRAPH))
    return both.groupBy("chunk_id").agg(F.sum("part").alias("fused"))


def recency(started_at: Column, as_of_ms: int) -> Column:
    """1 + 0.15 e^(-age in days / 180), the age at least 0 (SN-8)."""
    return 1 + RECENCY * F.exp(-F.greatest(F.lit(0.0), (F.lit(as_of_ms) - started_at) / DAY_MS) / HALF_DAYS)


def capped(scored: DataFrame, per_meeting: int, top: int) -> DataFrame:
    """The best rows with at most so many of one meeting (WN-2)."""
    by = Window.partitionBy("meeting_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= per_meeting).drop("_n").orderBy(F.desc("score"), "chunk_id").limit(top)


def retrieve(chunks: DataFrame, meetings: DataFrame, question: str, as_of_ms: int, graph: tuple[DataFrame, DataFrame, DataFrame] | None = None, top: int = TOP, ix: Lexicon | None = None) -> DataFrame:
    """(chunk_id, meeting_id, title, started_at, offset_s, speakers, text, score) of the best chunks. ix, an
    index that is kept, spares every question their tokenisation."""
    terms = terms_of(question)
    shape = chunks.join(meetings.select(F.col("id").alias("meeting_id"), "title", "started_at"), "meeting_id").select(F.col("id").alias("chunk_id"), "meeting_id", "title", "started_at", F.col("start_offset_s").alias("offset_s"), "speakers", "text")
    if not terms:
        return shape.withColumn("score", F.lit(0.0)).limit(0)
    arm = graph_arm(graph[0], graph[1], graph[2], chunks, terms) if graph else None
    scored = shape.join(F.broadcast(fused(lexical_arm(ix or index(chunks), terms), arm)), "chunk_id")
    return capped(scored.withColumn("score", F.round(F.col("fused") * recency(F.col("started_at"), as_of_ms), 12)).drop("fused"), PER_MEETING, top)


def extractive_answer(snippets: DataFrame, points: int = 3) -> DataFrame:
    """The first snippets as points that quote their own first 80 characters (CP-9, extractive branch)."""
    best = snippets.orderBy(F.desc("score"), "chunk_id").limit(points)
    return best.select("chunk_id", "meeting_id", F.col("title").alias("meeting_title"), "offset_s", "text", F.substring("text", 1, 80).alias("quote"), "score")
