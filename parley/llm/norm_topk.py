"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped by length into buckets (quantiles of the norm, at most BUCKETS), and a bucket is
cut into blocks of about BLOCK_ROWS by a hash of the id. A first pass scores every query against the
longest vectors; its k-th score is a threshold theta that the answer cannot fall below. A bucket with
largest norm l can hold a better vector for query q only if theta <= |q| l, so other pairs of query
and bucket are dropped. Within a block the local cosine threshold t = theta / (|q| l) chooses the
pruning: below COORDINATE_FROM only vectors of norm >= theta / |q| are verified (length pruning);
from there on, a vector must also lie in the range that cosine t allows on the query's largest
coordinates (coordinate pruning). Survivors get their exact integer product, and a block passes on
its k best per query. Every pair that is not verified is proved to be below theta.

Queries are a stated set that meets all rows in blocks; a block pair is one task group of bounded size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.common import blocks_for, bounded, materialize
from parley.llm.vectors import clean, stacked

BUCKETS, BLOCK_ROWS, QUERY_ROWS, QUERIES_AT_ONCE = 64, 4096, 4096, 512
COORDINATE_FROM, FOCUS = 0.6, 3
#: Sums of products below this are exact in double precision.
EXACT = float(1 << 53)
#: Relative slack that keeps rounding in norms from pruning a tie.
SLACK = 1e-9
#: The threshold of a query with fewer than k rows to compare.
NONE = -(1 << 63)
QUERY_SET = "query_id long, vec_id long, score long"


def scaled(table: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, vector array<long> of floor(scale * x), norm, dim)."""
    v = F.transform("vector", lambda x: F.floor(x * F.lit(float(scale))).cast("long"))
    rows = clean(table, id_col, vector_col).select("id", v.alias("vector"))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return rows.select("id", "vector", norm.alias("norm"), F.size("vector").alias("dim"))


def _products(rows: np.ndarray, queries: np.ndarray, row_norms: np.ndarray, query_norms: np.ndarray) -> np.ndarray:
    """Exact integer products; beyond 2^53 in 64-bit integers instead of doubles."""
    if row_norms.max(initial=0) * query_norms.max(initial=0) < EXACT:
        return np.rint(rows.astype(np.float64) @ queries.astype(np.float64).T).astype(np.int64)
    return rows @ queries.T


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of distinct ids: highest score first, then smallest id."""
    if len(scores) > 4 * k:
        near = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
        if len(np.unique(ids[near])) < k:
            near = np.arange(len(scores))
    else:
        near = np.arange(len(scores))
    near = near[np.lexsort((ids[near], -scores[near]))]
    _, first = np.unique(ids[near], return_index=True)
    return near[np.sort(first)[:k]]


def search_block(rows: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best of a block for each query that the block cannot be ruled out for."""
    out = [np.zeros((3, 0), np.int64)]
    if len(rows) and len(queries):
        rows = rows.sort_values("norm", ascending=False, kind="stable")
        ids, norms = rows["id"].to_numpy(), rows["norm"].to_numpy()
        matrix = np.array(list(rows["vector"]), dtype=np.int64).reshape(len(rows), -1)
        for at in range(0, len(queries), QUERIES_AT_ONCE):
            out += _search(ids, norms, matrix, queries.iloc[at : at + QUERIES_AT_ONCE], k)
    return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), np.concatenate(out, axis=1))))


def _search(ids: np.ndarray, norms: np.ndarray, matrix: np.ndarray, queries: pd.DataFrame, k: int) -> list[np.ndarray]:
    """(query, id, score) columns of each query, for rows in descending order of norms."""
    q_ids, q_norms, theta = queries["id"].to_numpy(), queries["norm"].to_numpy(), queries["theta"].to_numpy()
    q_matrix = np.array(list(queries["vector"]), dtype=np.int64).reshape(len(queries), -1)
    least = np.where(theta == NONE, -np.inf, theta.astype(float))
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = np.where(q_norms * norms[0] > 0, least / (q_norms * norms[0]), np.where(least > 0, np.inf, -np.inf))
        reach = np.where(q_norms > 0, least / q_norms, np.where(least > 0, np.inf, -np.inf))
    live = np.flatnonzero(cosine <= 1 + SLACK)
    if not len(live):
        return []
    # Norms stand in descending order: how many are long enough for each query.
    length = np.searchsorted(-norms, -(reach * (1 - np.sign(reach) * SLACK)), side="right")
    products = _products(matrix[: length[live].max(initial=0)], q_matrix[live], norms, q_norms[live])
    unit, out = None, []
    for column, q in enumerate(live):
        at = np.arange(length[q])
        if cosine[q] >= COORDINATE_FROM and len(at) and matrix.shape[1]:
            if unit is None:
                unit = matrix / np.maximum(norms, 1e-300)[:, None]
            t, u = min(1.0, cosine[q] * (1 - SLACK)), q_matrix[q] / q_norms[q]
            for f in np.argsort(-np.abs(u), kind="stable")[:FOCUS]:
                middle, half = u[f] * t, np.sqrt(max(0.0, (1 - t * t) * (1 - u[f] * u[f])))
                # The range is that of cosine exactly t; beyond it lies whatever is closer to the query.
                low, high = middle - half - SLACK, middle + half + SLACK
                low, high = (-1 - SLACK if -u[f] >= t else low), (1 + SLACK if u[f] >= t else high)
                at = at[(unit[at, f] >= low) & (unit[at, f] <= high)]
        scores = products[at, column]
        keep = (scores >= theta[q]) & (ids[at] != q_ids[q])
        at, scores = at[keep], scores[keep]
        top = _best(ids[at], scores, k)
        out.append(np.stack([np.full(len(top), q_ids[q]), ids[at[top]], scores[top]]))
    return out


def top_k(table: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest integer products, ties to the smaller id.

    is_query is a condition on the column `id`. A vector that is null, holds a null or non-finite
    component, or has a null id takes no part; vectors of another dimension than the query's are no
    candidates of it. Rows with the query's id are never candidates; repeated rows of one id count
    once, by their best score. Fewer candidates than k give fewer rows; an empty table gives an
    empty result; other columns are unread. Sums beyond 64 bits are outside the definition."""
    vectors = materialize(scaled(table, id_col, vector_col, scale), "topk-vectors")
    stats = vectors.groupBy("dim").agg(F.count("*").alias("n"), F.percentile_approx("norm", [(i + 1) / BUCKETS for i in range(BUCKETS - 1)], 1000).alias("cuts")).collect()
    result = vectors.limit(0).select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("score"))
    # One search per dimension: an embedding table has one, a broken one a few.
    found = [_one_dimension(vectors.where(F.col("dim") == s["dim"]), is_query, k, s["n"], s["cuts"]) for s in stats]
    if not found:
        return result
    both = found[0]
    for more in found[1:]:
        both = both.unionByName(more)
    best = both.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _one_dimension(vectors: DataFrame, is_query: Column, k: int, n: int, cuts: list[float]) -> DataFrame:
    cuts = sorted(set(cuts)) if n > BLOCK_ROWS else []
    placed = vectors.withColumn("bucket", sum((F.when(F.col("norm") > c, 1).otherwise(0) for c in cuts), F.lit(0)))
    # At most BUCKETS rows.
    sizes = {r["bucket"]: (blocks_for(r["n"], BLOCK_ROWS), r["longest"]) for r in placed.groupBy("bucket").agg(F.count("*").alias("n"), F.max("norm").alias("longest")).collect()}
    buckets = F.array(*(F.struct(F.lit(b).alias("bucket"), F.lit(m).alias("blocks"), F.lit(float(x)).alias("longest")) for b, (m, x) in sorted(sizes.items())))

    # The longest vectors, a bounded number, give each query its threshold.
    seed = vectors.orderBy(F.desc("norm"), "id").limit(BLOCK_ROWS).toPandas()
    shipped = vectors.sparkSession.sparkContext.broadcast((seed["id"].to_numpy(), np.array(list(seed["vector"]), dtype=np.int64).reshape(len(seed), -1), seed["norm"].to_numpy()))

    def thresholds(frames):
        ids, matrix, norms = shipped.value
        for f in frames:
            if f.empty:
                continue
            q = np.array(list(f["vector"]), dtype=np.int64).reshape(len(f), -1)
            scores = _products(matrix, q, norms, f["norm"].to_numpy())
            theta = []
            for column, own in enumerate(f["id"]):
                rest = scores[ids != own, column]
                # Repeated ids would count twice towards the k-th score: only distinct ones do.
                top = _best(ids[ids != own], rest, k)
                theta.append(int(rest[top[-1]]) if len(top) == k else NONE)
            yield f.assign(theta=theta)

    queries = materialize(vectors.where(is_query).select("id", "vector", "norm").mapInPandas(thresholds, "id long, vector array<long>, norm double, theta long"), "topk-queries")
    groups = blocks_for(queries.count(), QUERY_ROWS)
    block = F.struct(F.col("bucket").alias("bucket"), F.pmod(F.xxhash64("id"), F.element_at(F.create_map(*(x for b, (m, _) in sorted(sizes.items()) for x in (F.lit(b), F.lit(m)))), F.col("bucket"))).cast("int").alias("block"))
    live = F.filter(buckets, lambda b: (F.col("theta") == NONE) | (F.col("theta").cast("double") <= F.col("norm") * b["longest"] * (1 + SLACK) + SLACK))
    asked = queries.select("id", "vector", "norm", "theta", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("part"), F.explode(live).alias("b"))
    # Rows are copied once for each part of the queries that has a live query in their bucket, and not for others.
    met = materialize(asked.select(F.col("b.bucket").alias("bucket"), "part").distinct(), "topk-parts")
    rows = placed.join(bounded(met), "bucket").select("bucket", block["block"].alias("block"), "part", "id", "vector", "norm")
    asked = asked.select(F.col("b.bucket").alias("bucket"), F.explode(F.sequence(F.lit(0), F.col("b.blocks") - 1)).alias("block"), "part", "id", "vector", "norm", "theta")
    key = ["bucket", "block", "part"]
    return rows.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(lambda a, b: search_block(a, b, k), QUERY_SET)
