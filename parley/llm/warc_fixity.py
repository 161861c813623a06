"""Fixity of WARC archives by Merkle trees over records and their offset ranges.

A leaf is the SHA-256 of a record's bytes together with the range of offsets it fills in its file.
FANOUT neighbours make a node, whose hash covers the ordered hashes and ranges of its children, up to
one root per file; files are then leaves of the same kind under the root of the archive. Replicas
with equal roots are equal. Otherwise the audit descends level by level, and at each level compares
only the children of branches that differ, so the work after hashing follows the damage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.common import materialize

FANOUT = 16
END = "\r\n\r\n"


def record_of(record_id: Column, uri: Column, payload: Column) -> Column:
    """A WARC 1.0 resource record as text; null parts count as empty."""
    body = F.coalesce(payload, F.lit(""))
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(record_id.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(uri, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"))
    return F.concat(head, F.lit(END), body, F.lit(END))


def write_warc(records: DataFrame, path: str) -> None:
    """Write records (columns file, ordinal, record) as WARC files, one folder per file, uncompressed."""
    body = F.substring("record", F.lit(1), F.length("record") - len(END))
    ordered = records.select("file", "ordinal", body.alias("value")).repartition("file").sortWithinPartitions("file", "ordinal")
    ordered.select("file", "value").write.partitionBy("file").option("lineSep", END).text(path)


def read_warc(spark, path: str) -> DataFrame:
    """(file, ordinal, record binary, payload binary) of WARC files below path, by Content-Length.

    A file is parsed in one task, as its records only follow from the lengths before them."""

    def run(frames):
        import pandas as pd

        for f in frames:
            for name, data in zip(f["path"], f["content"]):
                out, at = [], 0
                while (end := data.find(b"\r\n\r\n", at)) >= 0:
                    sizes = [x.split(b":", 1)[1] for x in data[at:end].split(b"\r\n") if x.lower().startswith(b"content-length:")]
                    stop = end + 4 + (int(sizes[0]) if sizes else 0)
                    out.append((name, len(out), data[at : stop + 4], data[end + 4 : stop]))
                    at = stop + 4
                yield pd.DataFrame(out, columns=["file", "ordinal", "record", "payload"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(run, "file string, ordinal long, record binary, payload binary")


def leaves(records: DataFrame) -> DataFrame:
    """(file, ordinal, start, stop, hash) of records (file, ordinal, record): offsets follow the order
    of ordinals in the file. Only lengths and hashes travel."""
    small = records.select("file", "ordinal", F.octet_length("record").cast("long").alias("size"), F.sha2(F.col("record").cast("binary"), 256).alias("digest"))
    place = Window.partitionBy("file").orderBy("ordinal", "digest")
    stop = F.sum("size").over(place.rowsBetween(Window.unboundedPreceding, 0))
    rows = small.select("file", (F.row_number().over(place) - 1).cast("long").alias("ordinal"), "size", "digest", stop.alias("stop"))
    rows = rows.withColumn("start", F.col("stop") - F.col("size"))
    return rows.select("file", "ordinal", "start", "stop", F.sha2(F.concat_ws(":", "start", "stop", "digest"), 256).alias("hash"))


def _above(nodes: DataFrame, key: list[str]) -> DataFrame:
    """One node for FANOUT neighbours; a group never holds more."""
    grouped = nodes.groupBy(*key, F.floor(F.col("ordinal") / FANOUT).cast("long").alias("ordinal"))
    own = F.struct("ordinal", "start", "stop", "hash")
    made = grouped.agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.array_sort(F.collect_list(own)).alias("children"))
    text = F.array_join(F.transform("children", lambda c: F.concat_ws(":", c["start"], c["stop"], c["hash"])), "|")
    return made.select(*key, "ordinal", "start", "stop", F.sha2(text, 256).alias("hash"))


def trees(leaf: DataFrame, key: list[str], depth: int) -> list[DataFrame]:
    """Levels of the trees over leaves, leaves first; after depth levels each tree has one root."""
    levels = [leaf]
    for _ in range(depth):
        levels.append(materialize(_above(levels[-1], key), "warc-level"))
    return levels


def depth_for(most: int) -> int:
    """Levels above places 0 to most - 1."""
    depth = 0
    while most > 1:
        most, depth = -(-most // FANOUT), depth + 1
    return depth


def _descend(a: list[DataFrame], b: list[DataFrame], key: list[str], within: DataFrame | None) -> DataFrame:
    """The leaves that differ: from the top, only children of nodes that differ are compared."""
    at = [*key, "ordinal"]
    suspects = None
    for x, y in zip(reversed(a), reversed(b)):
        if suspects is not None:
            inside = suspects.select(*key, F.col("ordinal").alias("parent"))
            x, y = (level.withColumn("parent", F.floor(F.col("ordinal") / FANOUT).cast("long")).join(inside, [*key, "parent"], "left_semi").drop("parent") for level in (x, y))
        elif within is not None:
            x, y = (level.join(within, key, "left_semi") for level in (x, y))
        met = x.alias("x").join(y.alias("y"), at, "full").where(~F.col("x.hash").eqNullSafe(F.col("y.hash")))
        status = F.when(F.col("y.hash").isNull(), "missing").when(F.col("x.hash").isNull(), "extra").otherwise("differs")
        found = met.select(*at, F.coalesce("x.start", "y.start").alias("start"), F.coalesce("x.stop", "y.stop").alias("stop"), status.alias("status"))
        suspects = materialize(found, "warc-suspects")
    return suspects


def audit(first: DataFrame, second: DataFrame) -> DataFrame:
    """(file, ordinal, start, stop, status) of damaged records between replicas (file long, ordinal, record).

    status: `differs` if the record or its place differs, `missing` or `extra` if only the first or the
    second replica has it; start and stop are the first replica's offsets, or the second's for extra
    ones. Records keep their order by ordinal, repeated ordinals that of their hashes; ordinals are
    then counted from 0 without gaps. Rows without a file number belong to no file and take no part.
    Equal or empty replicas give no rows; a null record counts as no bytes; other columns are unread."""
    prepared, most, files = [], 0, 0
    for replica in (first, second):
        rows = replica.where("file is not null").select(F.col("file").cast("long").alias("file"), "ordinal", F.coalesce(F.col("record").cast("binary"), F.lit(b"")).alias("record"))
        prepared.append(materialize(leaves(rows), "warc-leaves"))
        sizes = prepared[-1].agg(F.max("ordinal"), F.max("file")).first()
        most, files = max(most, (sizes[0] or 0) + 1), max(files, (sizes[1] or 0) + 1)
    per_file = [trees(df, ["file"], depth_for(most)) for df in prepared]
    # The archive's tree: a file's root is a leaf at the place of its number.
    roots = [levels[-1].select(F.col("file").alias("ordinal"), "start", "stop", "hash") for levels in per_file]
    archive = [trees(df, [], depth_for(files)) for df in roots]
    damaged = _descend(*archive, [], None).select(F.col("ordinal").alias("file"))
    return _descend(*per_file, ["file"], damaged)
