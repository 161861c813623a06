"""Approximate nearest neighbours by cross-polytope hashing.

A table of the index rotates each unit vector pseudo-randomly, by three rounds of random signs and a
fast Hadamard transform over a power-of-two dimension, and assigns it to the nearest signed axis. A
query is rotated the same way and probes the PROBES axes nearest to it in each of TABLES tables. Each
bucket is cut into blocks of about BLOCK_ROWS rows, so that a bucket which holds a third of all rows
is many task groups and none is capped; queries of a bucket are cut into parts of about QUERY_ROWS likewise. A block scores its queries exactly and passes on the best k.
The index needs no fitting: rotations follow from the seed, and every row is in every table.

Queries that the probes leave with fewer than k neighbours probe every axis of one table, which is
all rows: small tables and outliers get whole answers too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.common import blocks_for, materialize
from parley.llm.vectors import as_bytes, balanced, clean, from_bytes, stacked

TABLES, PROBES, BLOCK_ROWS, QUERIES_AT_ONCE, SEED = 8, 14, 2048, 512, 20_231
#: Queries of a bucket that meet a block of its rows in one task.
QUERY_ROWS = 1 << 15
#: Room for rounding when the matrix product picks whom to score exactly.
SLACK = 1e-9


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, scaled to keep lengths."""
    n, width, h = len(x), x.shape[1], 1
    while h < width:
        pair = x.reshape(n, -1, 2, h)
        x = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], axis=2).reshape(n, width)
        h *= 2
    return x / np.sqrt(width)


def rotations(units: np.ndarray, tables: int, seed: int) -> Iterator[np.ndarray]:
    """Each table's rotated rows."""
    width = 1 << max(0, int(units.shape[1] - 1).bit_length())
    padded = np.pad(units, ((0, 0), (0, width - units.shape[1])))
    for t in range(tables):
        signs = np.random.default_rng((seed, t)).choice([-1.0, 1.0], (3, width))
        x = padded
        for s in signs:
            x = hadamard(x * s)
        yield x


def axes(x: np.ndarray) -> np.ndarray:
    """The nearest signed axis of each row: the coordinate, plus the width if it is negative."""
    at = np.abs(x).argmax(axis=1)
    return at + np.where(x[np.arange(len(x)), at] < 0, x.shape[1], 0)


def probes(x: np.ndarray, count: int) -> np.ndarray:
    """The signed axes nearest to each row, nearest first."""
    return np.argsort(-np.concatenate([x, -x], axis=1), axis=1, kind="stable")[:, :count]


def score_block(rows: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest of a block for each query, by exact cosine."""
    if rows.empty or queries.empty:
        return pd.DataFrame({"query_id": np.array([], np.int64), "vec_id": np.array([], np.int64), "score": np.array([], float)})
    ids, m = rows["id"].to_numpy(), from_bytes(rows["vector"])
    norms, unique, parts = np.sqrt((m * m).sum(axis=1)), len(np.unique(ids)) == len(ids), []
    for at in range(0, len(queries), QUERIES_AT_ONCE):
        some = queries.iloc[at : at + QUERIES_AT_ONCE]
        q_ids, q = some["id"].to_numpy(), from_bytes(some["vector"])
        q_norms = np.sqrt((q * q).sum(axis=1))
        rough = (q / q_norms[:, None]) @ (m / norms[:, None]).T
        rough[q_ids[:, None] == ids[None, :]] = -np.inf
        least = np.partition(rough, -k, axis=1)[:, -k, None] - SLACK if unique and len(ids) > k else -np.inf
        i, j = np.nonzero((rough >= least) & (rough > -np.inf))
        # Row by row, so that equal vectors get equal scores wherever they stand.
        exact = (m[j] * q[i]).sum(axis=1) / (norms[j] * q_norms[i])
        parts.append(best_of(q_ids[i], ids[j], exact, k))
    return pd.DataFrame({c: np.concatenate([p[n] for p in parts]) for n, c in enumerate(("query_id", "vec_id", "score"))})


def best_of(query_ids: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query's rows, ties to the smaller id; of rows of one id the best counts."""
    order = np.lexsort((ids, -scores, query_ids))
    q, v, x = query_ids[order], ids[order], scores[order]
    pairs = np.lexsort((np.arange(len(q)), v, q))
    again = np.zeros(len(q), bool)
    again[pairs[1:]] = (q[pairs[1:]] == q[pairs[:-1]]) & (v[pairs[1:]] == v[pairs[:-1]])
    q, v, x = q[~again], v[~again], x[~again]
    first = np.r_[True, q[1:] != q[:-1]] if len(q) else np.zeros(0, bool)
    place = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0)) if len(q) else np.zeros(0, int)
    return q[place < k], v[place < k], x[place < k]


def nearest(table: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, tables: int = TABLES, probe: int = PROBES, seed: int = SEED) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found, by cosine, ties to the smaller id.

    is_query is a condition on the column `id`. A vector that is null, zero, holds a null or
    non-finite component or has a null id takes no part; vectors of another dimension than the
    query's are no candidates of it. Rows with the query's id are never candidates; repeated rows of
    one id count once. Fewer candidates than k give them all; an empty table gives an empty result;
    other columns are unread."""
    vectors = clean(table, id_col, vector_col).withColumn("dim", F.size("vector"))
    vectors = materialize(vectors.where(F.exists("vector", lambda x: x != 0)), "ann-vectors")
    dims = [r["dim"] for r in vectors.select("dim").distinct().collect()]
    found = [_one_dimension(vectors.where(F.col("dim") == d).select("id", "vector"), is_query, k, tables, probe, seed) for d in dims]
    if not found:
        return vectors.limit(0).select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))
    both = found[0]
    for more in found[1:]:
        both = both.unionByName(more)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _one_dimension(vectors: DataFrame, is_query: Column, k: int, tables: int, probe: int, seed: int) -> DataFrame:
    spark = vectors.sparkSession

    def places(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                m = balanced(stacked(f["vector"]))
                packed = as_bytes(m)
                for t, r in enumerate(rotations(m / np.sqrt((m * m).sum(axis=1))[:, None], tables, seed)):
                    yield pd.DataFrame({"tab": t, "bucket": axes(r), "id": f["id"], "vector": packed})

    index = vectors.mapInPandas(places, "tab int, bucket int, id long, vector binary")
    # Bounded: tables times signed axes.
    sizes = {(r["tab"], r["bucket"]): blocks_for(r["n"], BLOCK_ROWS) for r in index.groupBy("tab", "bucket").agg(F.count("*").alias("n")).collect()}
    shipped = spark.sparkContext.broadcast(sizes)

    def of_bucket(numbers: dict[tuple[int, int], int]) -> Column:
        """The number of a row's bucket, one where it isn't greater."""
        more = [x for (t, b), m in sorted(numbers.items()) if m > 1 for x in (F.lit(t * (1 << 20) + b), F.lit(m))]
        return F.coalesce(F.element_at(F.create_map(*more), F.col("tab") * (1 << 20) + F.col("bucket")), F.lit(1)) if more else F.lit(1)

    index = index.withColumn("block", F.pmod(F.xxhash64("id"), of_bucket(sizes)).cast("int"))

    def asks(count: int, in_tables: int):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            blocks = shipped.value
            for f in frames:
                if f.empty:
                    continue
                m = balanced(stacked(f["vector"]))
                packed = np.array(as_bytes(m), object)
                for t, r in enumerate(rotations(m / np.sqrt((m * m).sum(axis=1))[:, None], in_tables, seed)):
                    rows = [(t, int(b), j, i) for i, own in enumerate(probes(r, count)) for b in own for j in range(blocks.get((t, int(b)), 0))]
                    if rows:
                        tab, bucket, block, at = map(np.array, zip(*rows))
                        yield pd.DataFrame({"tab": tab, "bucket": bucket, "block": block, "id": f["id"].to_numpy()[at], "vector": packed[at]})

        return run

    key = ["tab", "bucket", "block", "part"]

    def scored(queries: DataFrame, count: int, in_tables: int) -> DataFrame:
        asked = queries.select("id", "vector").mapInPandas(asks(count, in_tables), "tab int, bucket int, block int, id long, vector binary")
        rows = index if in_tables == tables else index.where(F.col("tab") < in_tables)
        # The queries of a bucket are cut into parts, too, and its rows go to each part. Bounded as above.
        counts = asked.where("block = 0").groupBy("tab", "bucket").agg(F.count("*").alias("n")).collect()
        parts = {(r["tab"], r["bucket"]): blocks_for(r["n"], QUERY_ROWS) for r in counts}
        asked = asked.withColumn("part", F.pmod(F.xxhash64("id"), of_bucket(parts)).cast("int"))
        rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), (of_bucket(parts) - 1).cast("int"))))
        near = rows.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(lambda a, b: score_block(a, b, k), "query_id long, vec_id long, score double")
        return near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))

    queries = vectors.where(is_query)
    first = materialize(scored(queries, probe, tables), "ann-found")
    full = first.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k)
    short = queries.join(full, queries.id == full.query_id, "left_anti")
    if short.isEmpty():
        return first
    rest = scored(short, 1 << 30, 1)
    return first.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(rest)
