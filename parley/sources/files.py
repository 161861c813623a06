"""Transcript files, bundles and documents (SRC-2..5, SRC-8, SRC-11, SRC-12)."""

from __future__ import annotations

import logging
import logging.handlers

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.functions import text as T

SAMPLE = "array<struct<id:string,title:string,mode:string,startedAt:bigint,utterances:array<struct<speaker:string,speaker_role:string,text:string,offset_s:double,duration_s:double>>>>"
ONE = "id string, title string, started_at string, duration_minutes int, participants array<struct<name:string,role:string>>, topics array<string>, summary string, decisions array<string>, action_items array<struct<owner:string,task:string,due:string>>, transcript array<struct<offset_seconds:double,speaker:string,text:string>>"
BUNDLE = ("version int, meeting struct<id:string,title:string,mode:string,started_at:bigint,duration_s:double>, "
          "utterances array<struct<idx:int,speaker:string,speaker_role:string,text:string,offset_s:double,duration_s:double>>, "
          "claims array<struct<id:bigint,kind:string,body:string,quote:string,offset_s:double,gate:string,done:int>>")  # fmt: skip
#: Fixed value: larger documents are not read.
MAX_DOCUMENT = 10 * 1024 * 1024


def sample_meetings(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(meetings, utterances) of files that hold an array of meetings with nested utterances (SRC-2)."""
    element = SAMPLE[len("array<") : -1]
    m = spark.read.schema(_ddl(element)).option("multiLine", True).json(path)
    utterances = m.select(F.col("id").alias("meeting_id"), F.posexplode("utterances").alias("idx", "u")).select("meeting_id", "idx", "u.*")
    return m.select("id", "title", "mode", F.col("startedAt").alias("started_at")), utterances


def _ddl(struct: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(f"x {struct}")["x"].dataType


def directory(spark: SparkSession, path: str, pattern: str = "meeting_*.json") -> tuple[DataFrame, DataFrame]:
    """(meetings, utterances) of a folder with one meeting a file; the manifest does not match the
    pattern. A line lasts 0.38 s a word, 1.5 s at least, at most until the next line (SRC-3, SC-20, WN-4)."""
    m = spark.read.schema(ONE).option("multiLine", True).option("pathGlobFilter", pattern).json(path)
    rows = m.select(F.col("id").alias("meeting_id"), F.posexplode("transcript").alias("idx", "t")).select("meeting_id", "idx", "t.speaker", "t.text", F.col("t.offset_seconds").alias("offset_s"))
    gap = F.lead("offset_s").over(Window.partitionBy("meeting_id").orderBy("idx")) - F.col("offset_s")
    return m.drop("transcript"), rows.withColumn("duration_s", T.duration_estimate(F.col("text"), gap))


def bundles(meetings: DataFrame, utterances: DataFrame, claims: DataFrame) -> DataFrame:
    """One row a meeting: version, meeting, its utterances in order and its claims by id (SRC-4)."""
    u = utterances.groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct("idx", "speaker", "speaker_role", "text", "offset_s", "duration_s"))).alias("utterances"))
    c = claims.groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct("id", "kind", "body", "quote", "offset_s", "gate", "done"))).alias("claims"))
    m = meetings.select(F.col("id").alias("meeting_id"), F.struct("id", "title", "mode", "started_at", "duration_s").alias("meeting"))
    empty = lambda k: F.coalesce(F.col(k), F.from_json(F.lit("[]"), dict((c.name, c.dataType) for c in _ddl_bundle())[k]))
    return m.join(u, "meeting_id", "left").join(c, "meeting_id", "left").select("meeting_id", F.lit(1).alias("version"), "meeting", empty("utterances").alias("utterances"), empty("claims").alias("claims"))


def _ddl_bundle():
    from pyspark.sql.types import StructType

    return StructType.fromDDL(BUNDLE)


def export(meetings: DataFrame, utterances: DataFrame, claims: DataFrame, path: str) -> None:
    """Write bundles as JSON, a folder for each meeting; only meetings that are written are replaced."""
    bundles(meetings, utterances, claims).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("meeting_id").json(path)


def read_bundles(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(meetings, utterances, claims) of bundles of version 1; others are skipped (SRC-5)."""
    b = spark.read.schema(BUNDLE).json(path, recursiveFileLookup=True).where("version = 1")
    each = lambda k: b.select(F.col("meeting.id").alias("meeting_id"), F.explode(k).alias("x")).select("meeting_id", "x.*")
    return b.select("meeting.*"), each("utterances"), each("claims")


def replace_meetings(old: DataFrame, new: DataFrame, key: str = "meeting_id") -> DataFrame:
    """Import replaces a meeting's rows, it never appends to them."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, text): the text of txt, md and csv files and of the text operators of plain PDF
    pages; null for other kinds and above MAX_DOCUMENT bytes, which are never loaded (SRC-8)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    small = F.col("length") <= MAX_DOCUMENT
    plain = F.when(kind.isin("txt", "md", "csv"), F.decode("content", "UTF-8"))
    raw = F.decode("content", "ISO-8859-1")
    pdf = F.when(kind == "pdf", F.array_join(F.transform(F.regexp_extract_all(raw, F.lit(r"\(((?:[^()\\]|\\.)*)\)\s*Tj"), F.lit(1)), lambda s: F.regexp_replace(s, r"\\(.)", "$1")), "\n"))
    return files.select("path", "length", F.when(small, F.coalesce(plain, F.when(pdf != "", pdf))).alias("text"))


def rotating_log(path: str, max_bytes: int = 5_242_880, backups: int = 5, level: int = logging.INFO) -> logging.Logger:
    """A driver-side JSON-lines log that never holds more than (backups + 1) * max_bytes (SRC-11, FLT-16)."""
    import json

    class Line(logging.Formatter):
        def format(self, record: logging.LogRecord) -> str:
            return json.dumps({"ts": int(record.created * 1000), "level": record.levelname.lower(), "msg": record.getMessage()})

    log = logging.Logger(f"parley:{path}", level)
    handler = logging.handlers.RotatingFileHandler(path, maxBytes=max_bytes, backupCount=backups, encoding="utf-8")
    handler.setFormatter(Line())
    log.addHandler(handler)
    return log
