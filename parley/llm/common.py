"""Shared helpers: table access, the shared scratch folder and checkpointed tables."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes handed to Python at once, about.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where it is unset, a local master gets a temporary folder of its own; a cluster without the
    setting is refused, since a machine-local folder would lose data there."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="parley-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet below the shared folder and read it back: lineage is cut, and a lost
    executor loses nothing, because every executor can read the files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    for made in _recorders:
        made.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths of the tables that materialize writes inside the block."""
    made: list[str] = []
    _recorders.append(made)
    try:
        yield made
    finally:
        _recorders.remove(made)


_recorders: list[list[str]] = []


def sources(df: DataFrame) -> set[str]:
    """The folders and files that df is read from."""
    leaves, found = df._jdf.queryExecution().analyzed().collectLeaves(), set()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            roots = leaf.relation().location().rootPaths()
            found |= {roots.apply(k).toString() for k in range(roots.size())}
    return found


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder in whatever store it lies."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def packed(df: DataFrame, columns: list[str] | None = None) -> Column:
    """Columns of df, by default all, as one struct: beside it, names of our own clash with none of them."""
    return F.struct(*(F.col(quoted(c)).alias(c) for c in (df.columns if columns is None else columns)))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Hand at most so many rows to Python at once, for tables of long texts: two workers share what an
    executor has beside its heap. A smaller setting of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, str(BATCH_BYTES + 1))) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def trim() -> None:
    """Give free memory of a Python worker back to the system at the end of a task: workers stay alive for
    the stages that follow, whose JVM needs it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint of a small frame that a loop goes through: unlike Parquet it opens no codec for each
    partition and round, whose native buffers an executor would gather."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def bounded(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """df with a broadcast hint if it has at most so many (short) rows; else the planner's shuffle join stands."""
    return F.broadcast(df) if df.count() <= rows else df


def blocks_for(rows: int, per_block: int, least: int = 1) -> int:
    """How many blocks of about per_block rows hold so many rows."""
    return max(least, -(-rows // per_block))
