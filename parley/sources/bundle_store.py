"""A store of meeting bundles, imported file by file with replacement and rollback (SRC-5).

A meeting is one row (its record, utterances and claims), so that it is replaced as a whole or not at all. Files are read as
texts and judged first; the good ones are written as one more import, in a folder of its own, whose row in the list of
imports makes it count. Of a meeting the last import counts, so nothing that was there is moved or written again, and an import
that breaks off leaves the store as it was. A file that is broken, or whose rows a table could not hold, leaves its
meeting as it was. There is one writer at a time; merge() puts all meetings into one import."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from parley.shared import delete
from parley.sources.files import BUNDLE

#: Fixed value: the version of bundles that can be read.
VERSION = 1
_BROKEN = "_broken"


def judged(texts: DataFrame) -> DataFrame:
    """(file, bundle, status, reason) of file contents (file, value): status is imported, skipped (of another version or
    without a meeting's id) or failed (no JSON, or rows that lack what a table needs). The last good file of a
    meeting, by name, is imported; those before it are replaced."""
    shape = StructType.fromDDL(BUNDLE).add(_BROKEN, "string")
    rows = texts.select("file", F.from_json("value", shape, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN}).alias("bundle"))
    b = F.col("bundle")
    lacks = lambda k, *fields: F.exists(b[k], lambda x: x.isNull() | (sum((x[f].isNull().cast("int") for f in fields), F.lit(0)) > 0))
    idx = F.transform(b["utterances"], lambda u: u["idx"])
    failed = (
        F.when(b.isNull() | b[_BROKEN].isNotNull(), "not JSON of a bundle")
        .when((b["version"] != VERSION) | b["version"].isNull() | (F.coalesce(b["meeting"]["id"], F.lit("")) == ""), "skipped")
        .when(b["meeting"]["title"].isNull() | b["meeting"]["started_at"].isNull(), "meeting without title or start")
        .when(b["utterances"].isNull() | b["claims"].isNull(), "no list of utterances or claims")
        .when(lacks("utterances", "idx", "speaker_role", "text", "offset_s", "duration_s"), "utterance without a needed field")
        .when(F.size(F.array_distinct(idx)) < F.size(idx), "two utterances with one index")
        .when(lacks("claims", "kind", "body", "gate"), "claim without a needed field")
    )
    rows = rows.withColumn("reason", failed).withColumn("id", F.when(F.col("reason").isNull(), b["meeting"]["id"]))
    last = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("file")))
    rows = rows.withColumn("_n", F.when(F.col("id").isNotNull(), last))
    status = F.when(F.col("reason") == "skipped", "skipped").when(F.col("reason").isNotNull(), "failed").when(F.col("_n") > 1, "replaced").otherwise("imported")
    return rows.select("file", "bundle", status.alias("status"), F.when(F.col("reason") == "skipped", f"not a v{VERSION} meeting bundle").otherwise(F.col("reason")).alias("reason"))


class BundleStore:
    """Bundles below a folder, by meeting."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def import_files(self, folder: str, pattern: str = "*.json") -> DataFrame:
        """Import all files of a folder; (file, meeting_id, status, reason, utterances, claims), one row a file."""
        texts = self.spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
        return self.import_texts(texts.select(F.col("_metadata.file_path").alias("file"), "value"))

    def import_texts(self, texts: DataFrame) -> DataFrame:
        """The same for contents (file, value) that are there already."""
        staged = f"{self.path}/staged-{uuid.uuid4().hex}"
        judged(texts).write.parquet(staged)
        rows = self.spark.read.parquet(staged)
        good = rows.where("status = 'imported'").select("bundle.meeting", "bundle.utterances", "bundle.claims", F.col("bundle.meeting.id").alias("meeting_id"))
        number = self._imports()[-1:] or [0]
        self._commit(good, number[0] + 1)
        size = lambda k: F.when(F.col("status") == "imported", F.size(f"bundle.{k}")).alias(k)
        report = rows.select("file", F.col("bundle.meeting.id").alias("meeting_id"), "status", "reason", size("utterances"), size("claims"))
        report.write.parquet(f"{staged}-report")
        delete(self.spark, staged)
        return self.spark.read.schema(report.schema).parquet(f"{staged}-report")

    def _imports(self) -> list[int]:
        """The numbers of the imports that count, in order."""
        try:
            rows = self.spark.read.schema("number int, since int").json(f"{self.path}/imports").collect()
        except AnalysisException:
            return []
        since = max((r["since"] for r in rows), default=0)
        return sorted(r["number"] for r in rows if r["number"] >= since)

    def _commit(self, rows: DataFrame, number: int, since: int = 0) -> None:
        """Write rows as an import; those before `since` count no more."""
        rows.write.mode("overwrite").parquet(f"{self.path}/bundles/import={number}")
        self.spark.createDataFrame([(number, since)], "number int, since int").coalesce(1).write.mode("append").json(f"{self.path}/imports")

    def _bundles(self) -> DataFrame:
        shape = StructType.fromDDL(BUNDLE)
        kept = StructType([f for f in shape if f.name != "version"]).add("meeting_id", "string")
        numbers = self._imports()
        if not numbers:
            return self.spark.createDataFrame([], kept)
        each = [self.spark.read.schema(kept).parquet(f"{self.path}/bundles/import={n}").withColumn("number", F.lit(n)) for n in numbers]
        rows = reduce(DataFrame.unionByName, each)
        if len(numbers) == 1:
            return rows.drop("number")
        # Only ids travel: a meeting's row is dropped where a later import has one.
        last = rows.groupBy("meeting_id").agg(F.max("number").alias("number"))
        return rows.join(last, ["meeting_id", "number"], "left_semi").drop("number")

    def merge(self) -> None:
        """Put all meetings into one import. Earlier ones stay on disk for those who read them."""
        numbers = self._imports()
        if len(numbers) > 1:
            self._commit(self._bundles(), numbers[-1] + 1, numbers[-1] + 1)

    def meetings(self) -> DataFrame:
        return self._bundles().select("meeting.*")

    def utterances(self) -> DataFrame:
        return self._bundles().select("meeting_id", F.explode("utterances").alias("x")).select("meeting_id", "x.*")

    def claims(self) -> DataFrame:
        return self._bundles().select("meeting_id", F.explode("claims").alias("x")).select("meeting_id", "x.*")
