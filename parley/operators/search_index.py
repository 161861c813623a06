"""A stored inverted index of chunks that is kept up to date instead of rebuilt (CP-7, SN-6).

Layout below one folder:

segment=<s>/chunks    the chunks as given, by meeting and id
segment=<s>/forward   one row a chunk: shard, chunk_id, meeting_id, dl, terms array<struct<term, tf>>
segment=<s>/blocks    one row a term and shard, in ranges of terms: most_tf, least_dl, entries by impact
segment=<s>/terms     one row a term, in order: df, less what the segment takes away from earlier ones
segment=<s>/dead      meetings whose chunks in earlier segments are void
manifest              one row a version: its segments, number of live chunks and sum of their lengths

Indexing meetings writes one more segment; a meeting indexed before is named in `dead` and its terms are taken off the
document frequencies. merge() puts all live chunks into one segment without tokenising them again. Segments are written
before the manifest's row that names them, so a version is there as a whole or not at all. One writer at a time.

A question reads the dictionary rows of its terms, then the heads of their blocks: the largest weight and the least length
bound what a block can add to a score, whatever the averages have become. The shards (SHARD chunks in a row)
with the highest bounds are scored first; the k-th score found rules out all shards whose bound is lower."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import stem as S
from parley.operators.retrieve import B, K1, LEAST_IDF, WEIGHTS, Index
from parley.shared import delete

#: Chunks of a shard as a power of two, and shards that a question scores before it bounds the others.
SHARD_BITS, FIRST_SHARDS = 12, 16
#: Up to so many replaced meetings are looked up by name, so that the rows of others are not read.
NAMED = 1000
#: Chunks that a worker counts at once.
COUNTED = 256
#: Scores are compared with this slack.
SLACK = 1e-9
MANIFEST = "version int, segments array<int>, n long, length long"
_TERMS = pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int32())]))


def _counted(chunks: DataFrame) -> DataFrame:
    """(chunk_id, meeting_id, dl, terms): the stemmed terms of each chunk with their column weights added up."""
    weights = list(WEIGHTS.items())

    def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
        lengths, ends, terms, counts = [], [0], [], []
        for texts in zip(*(batch.column(2 + i).to_pylist() for i in range(len(weights)))):
            tf, dl = Counter(), 0
            for text, (_, w) in zip(texts, weights):
                found = S.terms_in(text)
                dl += len(found)
                for t in found:
                    tf[t] += w
            lengths.append(dl)
            for t in sorted(tf):
                terms.append(t)
                counts.append(tf[t])
            ends.append(len(terms))
        entries = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(counts, pa.int32())], fields=list(_TERMS.value_type))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lengths, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries)], names=["chunk_id", "meeting_id", "dl", "terms"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # What a worker holds is that of COUNTED chunks, however many a batch has.
        for batch in batches:
            for at in range(0, batch.num_rows, COUNTED):
                yield counted(batch.slice(at, COUNTED))

    return chunks.select(F.col("id").cast("long"), F.col("meeting_id").cast("string"), *WEIGHTS).mapInArrow(run, "chunk_id long, meeting_id string, dl int, terms array<struct<term string, tf int>>")


@dataclass(frozen=True)
class StoredIndex:
    """One version of an index; a change gives the next version, and the old one stays readable until vacuum()."""

    spark: SparkSession
    path: str
    version: int = 0
    segments: tuple[int, ...] = ()
    n: int = 0
    length: int = 0

    @staticmethod
    def create(spark: SparkSession, path: str) -> StoredIndex:
        return StoredIndex(spark, path)._commit()

    @staticmethod
    def open(spark: SparkSession, path: str) -> StoredIndex:
        """The latest version."""
        r = spark.read.schema(MANIFEST).json(f"{path}/manifest").orderBy(F.desc("version")).first()
        return StoredIndex(spark, path, r["version"], tuple(r["segments"]), r["n"], r["length"])

    def _commit(self) -> StoredIndex:
        row = [(self.version, list(self.segments), self.n, self.length)]
        self.spark.createDataFrame(row, MANIFEST).coalesce(1).write.mode("append").json(f"{self.path}/manifest")
        return self

    def _read(self, what: str, segments: tuple[int, ...] | None = None) -> DataFrame:
        """A part of the segments with the number of each; other segments' files are not listed."""
        chosen = self.segments if segments is None else segments
        parts = [self.spark.read.parquet(f"{self.path}/segment={s}/{what}").withColumn("segment", F.lit(s)) for s in chosen]
        return reduce(DataFrame.unionByName, parts)

    def _write(self, rows: DataFrame, segment: int, what: str) -> DataFrame:
        path = f"{self.path}/segment={segment}/{what}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _live(self, rows: DataFrame) -> DataFrame:
        """Rows (segment, meeting_id, ...) that no later segment has made void."""
        later = self.segments[1:]
        if not later:
            return rows
        until = self._read("dead", later).groupBy("meeting_id").agg(F.max("segment").alias("until")).withColumnRenamed("meeting_id", "dead_id")
        return rows.join(until, (F.col("meeting_id") == F.col("dead_id")) & (F.col("segment") < F.col("until")), "left_anti")

    def forward(self) -> DataFrame:
        """(chunk_id, meeting_id, dl, terms) of all live chunks."""
        shape = "segment int, shard long, chunk_id long, meeting_id string, dl int, terms array<struct<term string, tf int>>"
        rows = self._live(self._read("forward")) if self.segments else self.spark.createDataFrame([], shape)
        return rows.select("chunk_id", "meeting_id", "dl", "terms")

    def chunks(self) -> DataFrame:
        """All live chunks as they were given."""
        return self._live(self._read("chunks")).drop("segment")

    def _named(self, rows: DataFrame, dead: DataFrame) -> DataFrame:
        """Rows of the meetings in dead."""
        few = [r[0] for r in dead.limit(NAMED + 1).collect()]
        return rows.where(F.col("meeting_id").isin(few)) if len(few) <= NAMED else rows.join(dead, "meeting_id", "left_semi")

    def update(self, chunks: DataFrame, meetings: DataFrame | None = None) -> StoredIndex:
        """The version in which chunks (id, meeting_id, text, speakers and more) take the place of all that was known of their
        meetings, and of those in `meetings` (meeting_id) that have no chunks any more. Ids are unique. Chunks without a
        meeting are never replaced; a null text or speaker list has no terms."""
        segment = max(self.segments, default=-1) + 1
        kept = self._write(chunks.repartitionByRange("meeting_id", "id").sortWithinPartitions("meeting_id", "id"), segment, "chunks")
        gone = kept.select("meeting_id")
        if meetings is not None:
            gone = gone.unionByName(meetings.select("meeting_id"))
        dead = self._write(gone.where("meeting_id is not null").distinct(), segment, "dead")
        return self._add(_counted(kept), segment, dead)

    def remove(self, meetings: DataFrame) -> StoredIndex:
        """The version without these meetings (meeting_id)."""
        return self.update(self._read("chunks").drop("segment").limit(0), meetings) if self.segments else self

    def _add(self, counted: DataFrame, segment: int, dead: DataFrame) -> StoredIndex:
        order = ["meeting_id", "chunk_id"]
        placed = counted.repartitionByRange(*order).sortWithinPartitions(*order)
        placed = placed.select(F.shiftright(F.monotonically_increasing_id(), SHARD_BITS).alias("shard"), "chunk_id", "meeting_id", "dl", "terms")
        forward = self._write(placed, segment, "forward")
        entry = F.struct((-F.col("t.tf")).alias("neg_tf"), "dl", "chunk_id", "meeting_id")
        each = forward.select("shard", "chunk_id", "meeting_id", "dl", F.explode("terms").alias("t"))
        # A shard holds 2^SHARD_BITS chunks, so a list is bounded however often a term occurs.
        blocks = each.groupBy(F.col("t.term").alias("term"), "shard").agg(F.max("t.tf").alias("most_tf"), F.min("dl").alias("least_dl"), F.array_sort(F.collect_list(entry)).alias("e"))
        entries = F.transform("e", lambda x: F.struct(x["chunk_id"].alias("chunk_id"), x["meeting_id"].alias("meeting_id"), (-x["neg_tf"]).alias("tf"), x["dl"].alias("dl")))
        blocks = blocks.select("term", "shard", "most_tf", "least_dl", entries.alias("entries"))
        kept = self._write(blocks.repartitionByRange("term", "shard").sortWithinPartitions("term", "shard"), segment, "blocks")
        df = kept.select("term", F.size("entries").cast("long").alias("df"))
        total = [F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))]
        added, lost = forward.agg(*total).first(), (0, 0)
        if self.segments:
            void = self._named(self._live(self._read("forward")), dead)
            df = df.unionByName(void.select(F.explode("terms").alias("t")).groupBy(F.col("t.term").alias("term")).agg((-F.count("*")).alias("df")))
            lost = void.agg(*total).first()
        df = df.groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0")
        self._write(df.repartitionByRange("term").sortWithinPartitions("term"), segment, "terms")
        return replace(self, version=self.version + 1, segments=(*self.segments, segment), n=self.n + added[0] - lost[0], length=self.length + added[1] - lost[1])._commit()

    def merge(self) -> StoredIndex:
        """The version that holds all live chunks in one segment; nothing is tokenised again."""
        if len(self.segments) < 2:
            return self
        segment = max(self.segments) + 1
        fresh = StoredIndex(self.spark, self.path, self.version)
        self._write(self.chunks().repartitionByRange("meeting_id", "id").sortWithinPartitions("meeting_id", "id"), segment, "chunks")
        return fresh._add(self.forward(), segment, self._write(self._read("dead").select("meeting_id").limit(0), segment, "dead"))

    def vacuum(self) -> None:
        """Delete the segments of earlier versions that this one does without."""
        for s in set(range(max(self.segments, default=0))) - set(self.segments):
            delete(self.spark, f"{self.path}/segment={s}")

    def flat(self) -> Index:
        """The same index as flat postings, for operators that scan it as a whole."""
        rows = self.forward().select("chunk_id", F.explode("terms").alias("t"), "dl").select("chunk_id", "t.term", F.col("t.tf").cast("long").alias("tf"), "dl")
        return Index(rows, self.forward().agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")))

    # --- questions ---------------------------------------------------------------------------------

    def _heads(self, wanted: Column) -> DataFrame:
        return self._read("blocks").where(wanted).select("segment", "shard", "term", "most_tf", "least_dl")

    def _entries(self, wanted: Column, shards: DataFrame | None = None) -> DataFrame:
        """(term, chunk_id, tf, dl) of live postings, of the shards given."""
        rows = self._read("blocks").where(wanted)
        if shards is not None:
            rows = rows.join(shards.select("segment", "shard"), ["segment", "shard"], "left_semi")
        return self._live(rows.select("segment", "term", F.explode("entries").alias("e")).select("segment", "term", "e.*")).select("term", "chunk_id", "tf", "dl")

    def _frequencies(self, looked: list[str], prefix: bool) -> list[int]:
        """In how many live chunks each term stands; the last one as a prefix where asked."""
        rows = self._read("terms").where(F.col("term").isin(looked)).groupBy("term").agg(F.sum("df").alias("df")).collect()
        known = {r["term"]: r["df"] for r in rows}
        out = [known.get(t, 0) for t in looked]
        if prefix:
            # Terms with the prefix, but no others, are counted by their chunks: one chunk may have several.
            out[-1] = self._entries(F.col("term").startswith(looked[-1])).select("chunk_id").distinct().count()
        return out

    def scores(self, terms: list[str], k: int) -> DataFrame:
        return self.search(terms, k)

    def search(self, terms: list[str], k: int) -> DataFrame:
        """(chunk_id, score): the k best chunks by BM25, ties to the smaller id: those with all terms, the last as a prefix; if
        there are none, those with any term as a whole. Terms are stemmed here; one that stands twice counts
        twice. No terms or an empty index give no rows."""
        none = self.spark.createDataFrame([], "chunk_id long, score double")
        if not terms or not self.n:
            return none
        looked = [S.porter(t) for t in terms]
        for strict in (True, False):
            found = self._search(looked, k, strict)
            if found is not None:
                return found
        return none

    def _search(self, looked: list[str], k: int, strict: bool) -> DataFrame | None:
        df = self._frequencies(looked, prefix=strict)
        if (min(df) if strict else max(df)) <= 0:
            return None
        n, avgdl, last = self.n, self.length / self.n, len(looked) - 1
        meets = [F.col("term").startswith(t) if strict and q == last else F.col("term") == t for q, t in enumerate(looked)]
        wanted = reduce(lambda a, b: a | b, meets)
        places = F.array_compact(F.array(*(F.when(m, F.lit(q)) for q, m in enumerate(meets))))
        idf = F.greatest(F.lit(LEAST_IDF), F.ln((F.lit(float(n)) - F.get(F.array(*(F.lit(float(d)) for d in df)), F.col("q")) + 0.5) / (F.get(F.array(*(F.lit(float(d)) for d in df)), F.col("q")) + 0.5)))
        part = lambda tf, dl: idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))
        # What a shard's chunks can score at most. Weights of several terms with the prefix add up.
        heads = self._heads(wanted).withColumn("q", F.explode(places)).groupBy("segment", "shard", "q").agg(F.sum("most_tf").alias("tf"), F.min("least_dl").alias("dl"))
        shards = heads.groupBy("segment", "shard").agg(F.sum(part(F.col("tf"), F.col("dl"))).alias("most"), F.count("*").alias("places"))
        if strict:
            shards = shards.where(F.col("places") == len(looked))

        def scored(some: DataFrame | None) -> DataFrame:
            rows = self._entries(wanted, some).withColumn("q", F.explode(places)).groupBy("chunk_id", "dl", "q").agg(F.sum("tf").alias("tf"))
            by = rows.groupBy("chunk_id").agg(F.round(F.sum(part(F.col("tf"), F.col("dl"))), 12).alias("score"), F.count("*").alias("places"))
            return (by.where(F.col("places") == len(looked)) if strict else by).select("chunk_id", "score")

        order = [F.desc("most"), "segment", "shard"]
        first = shards.orderBy(*order).limit(FIRST_SHARDS + 1).collect()
        if not first:
            return None
        best = [F.desc("score"), F.asc("chunk_id")]
        if len(first) <= FIRST_SHARDS:
            # All the shards there are.
            top = scored(None).orderBy(*best).limit(k).collect()
        else:
            chosen = self.spark.createDataFrame([(r["segment"], r["shard"]) for r in first[:FIRST_SHARDS]], "segment int, shard long")
            top = scored(F.broadcast(chosen)).orderBy(*best).limit(k).collect()
            least = top[-1]["score"] - SLACK if len(top) == k else float("-inf")
            if first[FIRST_SHARDS]["most"] >= least:
                rest = shards.where(F.col("most") >= least).join(F.broadcast(chosen), ["segment", "shard"], "left_anti")
                top += scored(rest).orderBy(*best).limit(k).collect()
        if not top and strict:
            return None
        top = sorted(((r["chunk_id"], r["score"]) for r in top), key=lambda r: (-r[1], r[0]))[:k]
        return self.spark.createDataFrame(top, "chunk_id long, score double")
