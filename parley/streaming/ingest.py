"""Live ingest as streams that survive a restart: replayed files, pairing of runs, the echo gate, a sink of final lines."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from parley.shared import delete, shared_dir
from parley.streaming.live import reindexed

#: How late an event may come, and how long after its begin a run's finish is waited for.
LATE, FINISH_WITHIN = "10 minutes", "2 hours"
#: Partitions of a table of final lines whose batches touch most meetings.
BUCKETS = 64
#: Rows of a replay's file, about, and the fewest.
ROWS_OF_FILE, LEAST_OF_FILE = 50_000, 1_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def paired(begins: DataFrame, finishes: DataFrame, late: str = LATE, within: str = FINISH_WITHIN) -> DataFrame:
    """(id, kind, started_at, ended_at, outcome, failure) of begun runs (id, kind, started_at) and finished ones (id, outcome,
    ended_at), both streams (STR-11): a finish belongs to the begin of its id if it comes `within` that time. A begin
    without one comes out as failed by a crash once the watermarks have passed its time; a finish without a begin is
    nothing. State holds the runs of that time only."""
    b = begins.withWatermark("started_at", late)
    f = finishes.select(F.col("id").alias("of"), "outcome", "ended_at").withWatermark("ended_at", late)
    same = (F.col("id") == F.col("of")) & (F.col("ended_at") >= F.col("started_at")) & (F.col("ended_at") <= F.col("started_at") + F.expr(f"interval {within}"))
    rows = b.join(f, same, "left_outer")
    return rows.select("id", "kind", "started_at", "ended_at", F.coalesce("outcome", F.lit("failed")).alias("outcome"), F.when(F.col("of").isNull(), "crash").alias("failure"))


class FinalLines:
    """A table of final lines (meeting_id, utterance_id, seq, offset_s, ... and their idx), one partition a meeting, that a
    stream's batches are merged into (STR-2, STR-5, STR-6): an instance is what foreachBatch calls.

    Of an utterance the line with the highest seq stays; a meeting's lines are numbered by offset anew, so late ones find
    their place. Meetings that a batch doesn't touch are not read. The new partitions are staged below the batch's
    number, then swapped in; a batch that runs again after a crash finds its own lines and changes nothing.

    A folder for each meeting suits batches that touch few of many meetings. Where batches touch most of them, files and
    renames outweigh the lines: with `buckets`, that many partitions share the meetings by hash, and a batch rewrites the
    partitions that its meetings lie in. A table keeps the number that it began with."""

    def __init__(self, path: str, buckets: int | None = None):
        self.path, self.buckets = path, buckets
        self.part = "bucket" if buckets else "meeting_id"

    def _parts(self, spark: SparkSession) -> DataFrame | None:
        try:
            return spark.read.parquet(f"{self.path}/lines")
        except AnalysisException:
            return None

    def read(self, spark: SparkSession) -> DataFrame | None:
        found = self._parts(spark)
        return found.drop("bucket") if self.buckets and found is not None else found

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.where("final and meeting_id is not null").drop("final")
        if fresh.isEmpty():
            return
        if self.buckets:
            fresh = fresh.withColumn("bucket", F.pmod(F.xxhash64("meeting_id"), F.lit(self.buckets)).cast("int"))
        old = self._parts(spark)
        if old is not None:
            touched = fresh.select(self.part).distinct()
            fresh = fresh.unionByName(old.drop("idx").join(F.broadcast(touched) if self.buckets else touched, self.part, "left_semi"))
        # Rows of one utterance and seq are equal but for a replay: any of them will do.
        last = F.row_number().over(Window.partitionBy("meeting_id", "utterance_id").orderBy(F.desc("seq"), "offset_s", "text"))
        rows = reindexed(fresh.withColumn("_n", last).where("_n = 1").drop("_n"))
        staged = f"{self.path}/staged/batch={number}"
        rows.write.mode("overwrite").parquet(staged)
        kept = spark.read.schema(rows.schema).parquet(staged)
        kept.repartition(self.part).write.partitionBy(self.part).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{self.path}/lines")


def run(stream: DataFrame, into: str, checkpoint: str, batch: Callable[[DataFrame, int], None] | None = None) -> None:
    """Work off all that a stream has now: append it to Parquet files, or hand its batches to `batch`."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = writer.foreachBatch(batch).start() if batch else writer.format("parquet").outputMode("append").start(into)
    query.awaitTermination()


def replayed(rows: DataFrame, by: str, batches: int = 3) -> tuple[DataFrame, str, int]:
    """(a stream of rows in that many batches by the order of a column, its folder, files of a batch): batches are written one
    after the other, each in so many files, and the stream takes as many at a time. Nulls come first, empty batches fall out.

    A batch has a file for ROWS_OF_FILE rows of the largest one. Files deal out the rows evenly, and none may stay empty, as
    Spark would not write it: a batch that is too small for that keeps all to one file."""
    spark = rows.sparkSession
    at = f"{shared_dir(spark)}/replay-{uuid.uuid4().hex}"
    # Written once: what rows are made of is not run anew for each batch.
    rows.write.parquet(f"{at}/all")
    rows = spark.read.schema(rows.schema).parquet(f"{at}/all")
    order = F.coalesce(F.col(by).cast("double"), F.lit(float("-inf")))
    cuts = rows.select(order.alias("x")).approxQuantile("x", [(i + 1) / batches for i in range(batches - 1)], 0.01) if batches > 1 else []
    ends = [float("-inf"), *cuts, float("inf")]
    parts = [(order >= low if low == float("-inf") else order > low) & (order <= high) for low, high in zip(ends, ends[1:])]
    counts = rows.select(*(F.count_if(p) for p in parts)).first()
    full = [n for n in counts if n] or [0]
    files = max(1, min(-(-max(full) // ROWS_OF_FILE), min(full) // LEAST_OF_FILE))
    for p, n in zip(parts, counts):
        if n or not any(counts):
            part = rows.where(p)
            (part.coalesce(1) if files == 1 else part.repartition(files)).write.mode("append").parquet(f"{at}/in")
    delete(spark, f"{at}/all")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{at}/in"), at, files


def after(rows: DataFrame, at: str, files: int = 1, **values: str) -> None:
    """Add a batch of one row a file to a replay, null but for some values, of which a time far behind all others moves the watermark past them."""
    last = rows.sparkSession.range(0, files, 1, files).select(*(F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in rows.schema))
    last.write.mode("append").parquet(f"{at}/in")


#: The id of rows that only move a watermark; no run has it. (A null id would be filtered before the watermark sees it.)
MARK = "-1"


def pair_runs(begins: DataFrame, finishes: DataFrame, batches: int = 3) -> DataFrame:
    """Begun and finished runs of two tables as replayed streams."""
    spark = begins.sparkSession
    sides = []
    for rows, column in ((begins, "started_at"), (finishes, "ended_at")):
        stream, at, files = replayed(rows, column, batches)
        for year in ("9998", "9999"):
            after(rows, at, files, id=MARK, **{column: f"{year}-01-01 00:00:00"})
        sides.append((stream, at))
    at = sides[0][1]
    run(paired(sides[0][0], sides[1][0]), f"{at}/out", f"{at}/checkpoint")
    return spark.read.parquet(f"{at}/out").where(F.col("id").cast("string") != MARK)


def gate_echoes(frames: DataFrame, batches: int = 3) -> DataFrame:
    """(meeting_id, utterance_id, echo) of the final microphone lines of a table of frames, replayed as a stream (STR-4)."""
    from parley.streaming.live import gated

    spark = frames.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    # A day after the epoch: what lies at a watermark's start, which is the epoch, would count as late.
    timed = frames.withColumn("ts", F.timestamp_micros(((F.col("offset_s") + 86_400) * 1_000_000).cast("long")))
    stream, at, _ = replayed(timed, "offset_s", batches)
    run(gated(stream), f"{at}/out", f"{at}/checkpoint")
    return spark.read.parquet(f"{at}/out")


def persist_finals(frames: DataFrame, batches: int = 3) -> DataFrame:
    """The table of final lines that a replay of frames by seq leaves behind."""
    stream, at, _ = replayed(frames, "seq", batches)
    # Every batch of a replay touches most meetings.
    sink = FinalLines(f"{at}/table", BUCKETS)
    run(stream, "", f"{at}/checkpoint", sink)
    found = sink.read(frames.sparkSession)
    return frames.limit(0).drop("final").withColumn("idx", F.lit(0)) if found is None else found
