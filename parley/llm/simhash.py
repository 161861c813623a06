"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is mapped to the bit counts of its 16 segments of 4 bits. The Manhattan
distance of two such vectors never exceeds the Hamming distance of the fingerprints, so pairs within
a Hamming radius of 2 lie within a Manhattan radius of 2, and the range join on that grid loses
none. The range join is an equi-join on grid cells: a fingerprint stands in its own cell and in those
one step up or down in one coordinate (33 at most); two cells within Manhattan distance 2 share such
a cell (a step or the midpoint), and fingerprints that share one are within 2. A cell with two
fingerprints is verified at once from its minimum and maximum. Fingerprints of cells that hold more
are linked without pairs: each goes to the keys that differ from it in one bit at most, of which two
fingerprints share one exactly if they differ in two bits or fewer; at most 65 distinct fingerprints
share a key, and each is linked to the smallest. So no bucket is capped, no pairs within a group of
copies are made, and every link between different fingerprints is kept as a path.

Components come from alternating large-star and small-star steps over those links; each step is a
grouped minimum and a join, with a checkpoint in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import cut, materialize, small_batches, trim

SEGMENTS, SEGMENT_BITS = 16, 4
#: Room for a segment's count in the packed cell.
CELL_BITS = 3
#: Cells with more than two fingerprints are broadcast up to so many rows of 8 bytes, else joined by a shuffle.
BROADCAST_ROWS = 100_000
SHINGLES_AT_ONCE = 1 << 16


def _ones(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits."""
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _majority(ones: np.ndarray, n: int) -> np.ndarray:
    """The bits that over half of n hashes have, as one number."""
    return np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view(np.uint64)


def fingerprint_of(h: np.ndarray) -> int:
    """The signed SimHash of hashes that are there already; of none it is 0."""
    ones = sum((_ones(h[at : at + SHINGLES_AT_ONCE]) for at in range(0, len(h), SHINGLES_AT_ONCE)), np.zeros(64, np.int64))
    return int(_majority(ones, len(h)).view(np.int64)[0])


def fingerprint(text: str | None, words: int = 3) -> int:
    """The unsigned SimHash of a whole text: XXH64 (seed 42) of the word shingles, majority per bit."""
    from xxhash import xxh64_intdigest

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    ends = max(1, len(w) - words + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, ends, SHINGLES_AT_ONCE):
        part = w[at : at + SHINGLES_AT_ONCE + words - 1]
        shingles = zip(*(part[i:] for i in range(words))) if len(part) >= words else [part]
        ones += _ones(np.fromiter([xxh64_intdigest(b" ".join(s), 42) for s in shingles], np.uint64))
    return int(_majority(ones, ends)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=[batch.schema.names[0], "fp"])
        trim()

    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"{id_col} {kind}, fp long")


def _cells(fp: Column) -> Column:
    """The packed popcount vectors of a fingerprint's own cell and of those one step away."""
    counts = [F.bit_count(F.shiftright(fp, SEGMENT_BITS * i).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))).cast("long") for i in range(SEGMENTS)]
    own = sum((F.shiftleft(c, CELL_BITS * i) for i, c in enumerate(counts)), F.lit(0).cast("long"))
    steps = [own]
    for i, c in enumerate(counts):
        one = F.lit(1 << (CELL_BITS * i)).cast("long")
        steps += [F.when(c > 0, own - one), F.when(c < SEGMENT_BITS, own + one)]
    return F.array_compact(F.array(*steps))


def links(fps: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that span every pair within 2 bits."""
    placed = fps.select("fp", F.explode(_cells(F.col("fp"))).alias("cell"))
    full = materialize(placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"), "simhash-cells")
    twos = full.where("n = 2 and bit_count(a ^ b) <= 2").select("a", "b")
    crowded = full.where("n > 2").select("cell")
    if crowded.count() <= BROADCAST_ROWS:
        crowded = F.broadcast(crowded)
    members = placed.join(crowded, "cell", "left_semi").select("fp").distinct()
    near = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(v - (1 << 64) if (v := 1 << i) >> 63 else v).cast("long")) for i in range(64)))
    keyed = members.select("fp", F.explode(near).alias("key")).groupBy("key").agg(F.collect_list("fp").alias("fps")).where("size(fps) > 1")
    stars = keyed.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")
    return twos.unionByName(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of the edges (a, b) can reach; the smallest itself is
    left out."""
    edges = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = None
    while True:
        # Large star: the larger neighbours of each node move to the least of the neighbourhood.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: a node and its smaller neighbours move to the least of these.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = cut(small.where("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).groupBy("node").agg(F.min("root").alias("root"))
        state = now


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp long, component_id): the smallest id reachable over links of 2 bits or fewer.

    One row per input row; repeated rows share fingerprint and component. Null and empty texts have
    fingerprint 0 and link like any other. A null id never becomes a component's id unless all ids of
    the component are null. An empty table gives an empty result; other columns are unread."""
    prints = materialize(fingerprints(docs, id_col, text_col, words), "simhash-prints")
    distinct = materialize(prints.groupBy("fp").agg(F.min(id_col).alias("low")), "simhash-distinct")
    roots = components(links(distinct))
    placed = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    best = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    return prints.join(placed.join(best, "root").select("fp", "component_id"), "fp").select(id_col, "fp", "component_id")
