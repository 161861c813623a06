"""Mixing to target weights with soft domain membership.

A softmax classifier over hashed words, fitted on a bounded sample of a labelled table, gives each
document a posterior over domains, in steps of 1 / GRID. Document rates r >= 0 then solve the least-squares
problem that the expected domain totals A r, with A[d, i] = P(d | i) * tokens(i), match the targets t:
f(r) = |A r - t|^2 / 2. Projected gradient steps r <- max(0, r - mu P g) in the metric of the token counts
start at r = 1. A step takes the gradient g = A r - t at the point that it reaches, which allows steps of
any length mu; the entries of g, one for each domain, are the root of a convex function of as many
variables, found by Newton's method with a line search of which one pass over the documents tries all
lengths. mu grows from step to step; the search ends when totals no longer change.

A document's rate follows from its posterior and the few vectors mu g of all steps, so no state is kept.
Passes do not read documents but the table of distinct posteriors with their tokens, of which the grid
bounds the size (525,825 rows for three domains) whatever the number of documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from parley.llm.common import materialize, packed, small_batches, trim

#: Labelled rows that the classifier is fitted on at most, and their words (hashed cells) altogether; rows are
#: taken in the order of a hash of the id, then of one of text and label.
SAMPLE_ROWS, SAMPLE_CELLS = 8_000, 1 << 23
#: Cells of a block of the sample, of which a pass holds a few numbers each at a time.
BLOCK = 1 << 18
#: Cells that words are hashed to.
CELLS = 1 << 15
#: Of the classifier: passes over the sample and weight of the ridge.
PASSES, RIDGE = 250, 1e-4
#: Posteriors are multiples of 1 / GRID.
GRID = 1 << 10
#: Of the rates: steps at most, lengths of the first and the longest step over that of an explicit one and their
#: growth, line search, and the change of a total, as a share of the largest one, at which the search ends.
STEPS, FIRST, LONGEST, GROWTH, LENGTHS, TOLERANCE = 60, 1e3, 1e7, 30.0, (1.0, 0.5, 0.25, 0.1, 0.03, 0.01, 0.001), 1e-9


def _cells(text: str) -> tuple[np.ndarray, int]:
    """The hashed cells of a text's distinct words, and its number of words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    return np.unique(np.fromiter((zlib.crc32(w.strip(b".,;:!?\"'()")) & (CELLS - 1) for w in set(words)), np.int64)), len(words)


def _marks(text: str) -> np.ndarray:
    """Shares of letters that are capitals, and of characters that are marks: what hashed words miss."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = max(1, len(data))
    upper = ((data >= 65) & (data <= 90)).sum() / n
    marks = (((data >= 33) & (data <= 47)) | ((data >= 58) & (data <= 64)) | ((data >= 91) & (data <= 96)) | ((data >= 123) & (data <= 126))).sum() / n
    return np.array([1.0, 4 * upper, 4 * marks, float(upper > 0.5), float(marks > 0.1)])


def _stored(cells: np.ndarray) -> bytes:
    """Cells as two bytes each, or, where that is no shorter, as one bit for each cell there is."""
    if 2 * len(cells) < CELLS // 8:
        return cells.astype(np.uint16).tobytes()
    bits = np.zeros(CELLS, np.uint8)
    bits[cells] = 1
    return np.packbits(bits).tobytes()


def _read(stored: bytes) -> np.ndarray:
    if len(stored) < CELLS // 8:
        return np.frombuffer(stored, np.uint16)
    return np.flatnonzero(np.unpackbits(np.frombuffer(stored, np.uint8))).astype(np.uint16)


def _blocks(starts: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of rows, whose cells begin at starts, of BLOCK cells at most, or one row."""
    out, i = [], 0
    while i < len(starts) - 1:
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + BLOCK, "right")) - 1)
        out.append((i, j))
        i = j
    return out


def on_grid(p: np.ndarray) -> np.ndarray:
    """Posteriors rounded to multiples of 1 / GRID; the largest entry takes what rounding leaves."""
    steps = np.rint(p * GRID)
    steps[np.arange(len(p)), p.argmax(axis=1)] += GRID - steps.sum(axis=1)
    return steps / GRID


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "label", order_col: str = "doc_id", rows: int = SAMPLE_ROWS, hash_col: str = "text_hash") -> tuple[list[str], np.ndarray, np.ndarray]:
    """Domains, word weights (cells by domains) and mark weights, by softmax regression.

    Fitted on at most `rows` labelled rows, those with the smallest hash of order_col, of equal ones those
    with the smallest hash of text and label; rows equal in all count each. Rows with a null text or label
    are left out; a null id has a hash like any other. The driver gets two bytes for each distinct cell of a row,
    CELLS bits a row at most, and uses the rows until their cells exceed SAMPLE_CELLS; what a pass needs beside them is
    bounded by BLOCK. Without labelled rows there are no domains. A table that brings a hash of the text (hash_col) spares the choice the texts: where it is a join, they need not be
    shuffled for it."""

    def features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            marks = [_marks(t).tobytes() for t in f["text"]]
            yield pd.DataFrame({"h": f["h"], "g": f["g"], "label": f["label"], "cells": [_stored(_cells(t)[0]) for t in f["text"]], "marks": marks})

    small_batches(labelled.sparkSession)
    content = F.col(hash_col) if hash_col in labelled.columns else F.xxhash64(F.col(text_col).cast("string"))
    given = F.col(hash_col).isNotNull() if hash_col in labelled.columns else F.col(text_col).isNotNull()
    known = labelled.where(given & F.col(label_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("label"), F.xxhash64(order_col).alias("h"), F.xxhash64(content, label_col).alias("g"))
    last = known.select("h", "g").orderBy("h", "g").limit(rows).groupBy().agg(F.max(F.struct("h", "g")).alias("last")).first()["last"]
    if last is None:
        return [], np.zeros((CELLS, 0)), np.zeros((5, 0))
    # The first test goes down to the scan, below a join with the labels.
    known = known.where(F.col("h") <= last["h"])
    before = (F.col("h") < last["h"]) | (F.col("h") == last["h"]) & (F.col("g") < last["g"])
    at = known.where((F.col("h") == last["h"]) & (F.col("g") == last["g"]))
    chosen = known.where(before).unionByName(at.limit(rows - known.where(before).count()))
    sample = chosen.mapInPandas(features, "h long, g long, label string, cells binary, marks binary").toPandas().sort_values(["h", "g"], kind="stable")
    sizes = sample["cells"].map(lambda c: len(_read(c))).to_numpy()
    fits = np.cumsum(sizes) <= SAMPLE_CELLS
    fits[0] = True
    sample, sizes = sample[fits], sizes[fits]
    domains = sorted(sample["label"].unique())
    k, n = len(domains), len(sample)
    # Cells lie row by row, two bytes each; a pass widens them block by block, blocks end where rows do.
    flat, starts = np.concatenate([_read(c) for c in sample["cells"]]), np.concatenate([[0], np.cumsum(sizes)])
    blocks = _blocks(starts)
    marks = np.array([np.frombuffer(m) for m in sample["marks"]])
    y = np.zeros((n, k))
    y[np.arange(n), [domains.index(x) for x in sample["label"]]] = 1
    del sample
    # Full-batch Adam: deterministic, and few enough rows.
    w, v = np.zeros((CELLS, k)), np.zeros((marks.shape[1], k))
    state = [np.zeros_like(x) for x in (w, w, v, v)]
    off = np.zeros((n, k))
    for step in range(1, PASSES + 1):
        z = marks @ v
        gw = RIDGE * w
        for i, j in blocks:
            cell, row = flat[starts[i] : starts[j]].astype(np.int64), np.repeat(np.arange(j - i), sizes[i:j])
            zs = z[i:j] + np.stack([np.bincount(row, w[cell, d], j - i) for d in range(k)], axis=1)
            zs = np.exp(zs - zs.max(axis=1, keepdims=True))
            off[i:j] = (zs / zs.sum(axis=1, keepdims=True) - y[i:j]) / n
            gw += np.stack([np.bincount(cell, off[i:j][row, d], CELLS) for d in range(k)], axis=1)
        gv = marks.T @ off + RIDGE * v
        for x, g, m1, m2 in ((w, gw, *state[:2]), (v, gv, *state[2:])):
            m1 += 0.1 * (g - m1)
            m2 += 0.001 * (g * g - m2)
            x -= 0.05 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    return domains, w, v


def posteriors(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], columns: list[str], text_col: str = "text") -> DataFrame:
    """(row struct of some columns, tokens, p array<double>): words and domain posterior, a multiple of
    1 / GRID, of every row; a null text is empty. Columns pass through, so no join has to bring them back."""
    small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, v = shipped.value
        for batch in batches:
            tokens, p = [], np.zeros((batch.num_rows, w.shape[1]))
            for i, t in enumerate(batch.column(1).to_pylist()):
                cells, n = _cells(t)
                z = _marks(t) @ v + w[cells].sum(axis=0)
                e = np.exp(z - z.max())
                tokens.append(n)
                p[i] = e / e.sum()
            ends = pa.array(np.arange(batch.num_rows + 1) * w.shape[1], pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.array(on_grid(p).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.int64()), lists], names=["row", "tokens", "p"])
        trim()

    rows = docs.select(packed(docs, columns).alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, StructType([rows.schema["row"], StructField("tokens", LongType()), StructField("p", ArrayType(DoubleType()))]))


def _rate(steps: list[np.ndarray]) -> Column:
    r = F.lit(1.0)
    for s in steps:
        r = F.greatest(F.lit(0.0), r + sum((F.element_at("p", d + 1) * float(x) for d, x in enumerate(s)), F.lit(0.0)))
    return r


class _Cells:
    """Passes over the distinct posteriors."""

    def __init__(self, weighed: DataFrame):
        self.table = materialize(weighed.where("tokens > 0").groupBy("p").agg(F.sum("tokens").cast("double").alias("tokens")), "mix-cells")

    def summed(self, each, width: int) -> np.ndarray:
        """The sum over all cells of what each(p, tokens) gives, `width` numbers a task."""

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(width)
            for f in frames:
                if len(f):
                    total += each(np.array(list(f["p"])), f["tokens"].to_numpy())
            yield pd.DataFrame({"at": np.arange(width), "x": total})

        rows = self.table.mapInPandas(run, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()
        out = np.zeros(width)
        for r in rows:
            out[r["at"]] = r["x"]
        return out


def replayed(p: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """The rates after some steps."""
    r = np.ones(len(p))
    for s in steps:
        r = np.maximum(0.0, r + p @ s)
    return r


def fit_rates(weighed: DataFrame, targets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The steps that give every document's rate, and the domain totals they reach."""
    k = len(targets)
    cells, steps = _Cells(weighed), []

    def totals(steps: list[np.ndarray]) -> np.ndarray:
        return cells.summed(lambda p, n: (n * replayed(p, steps)) @ p, k)

    start = cells.summed(lambda p, n: np.concatenate([[n.sum()], n @ p, [(n * (p * p).sum(axis=1)).sum()]]), k + 2)
    if start[0] == 0:
        return [], np.zeros(k)
    # All numbers are shares of the tokens from here on.
    unit, t = start[0], targets / start[0]
    explicit, scale = unit / start[-1], max(np.abs(t).max(), np.abs(start[1:-1] / unit).max())
    mu, now = FIRST * explicit, start[1:-1] / unit
    g = np.zeros(k)
    longest = LONGEST * explicit
    for _ in range(STEPS):
        g = _implicit_gradient(cells, steps, unit, t, mu, g, TOLERANCE * 1e-2 * scale)
        reached = totals([*steps, -mu * g]) / unit
        if ((reached - t) ** 2).sum() > ((now - t) ** 2).sum():
            # Rounding outweighs the step: shorter ones only.
            if mu <= explicit:
                break
            longest = mu = mu / GROWTH
            continue
        steps.append(-mu * g)
        change, now = np.abs(reached - now).max(), reached
        if min(change, np.abs(now - t).max()) <= TOLERANCE * scale:
            break
        longer = min(mu * GROWTH, longest)
        mu, g = longer, g * mu / longer
    return steps, now * unit


def _implicit_gradient(cells: _Cells, steps: list[np.ndarray], unit: float, t: np.ndarray, mu: float, g: np.ndarray, close: float) -> np.ndarray:
    """The g with g = A max(0, r - mu P g) - t for the rates r after some steps: the minimum of the convex
    function |g|^2 / 2 + t g + sum(tokens * max(0, r - mu P g)^2) / (2 mu)."""
    k = len(t)

    def tried(points: list[np.ndarray]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """Value, gradient and Hessian matrix at some points, from one pass."""

        def each(p: np.ndarray, n: np.ndarray) -> np.ndarray:
            r, parts = replayed(p, steps), []
            for x in points:
                y = np.maximum(0.0, r - mu * (p @ x))
                free = n * (y > 0)
                parts += [[(n * y * y).sum()], (n * y) @ p, ((p * free[:, None]).T @ p).ravel()]
            return np.concatenate(parts)

        sums = cells.summed(each, len(points) * (1 + k + k * k)).reshape(len(points), -1) / unit
        return [(x @ x / 2 + t @ x + s[0] / (2 * mu), x + t - s[1 : 1 + k], np.eye(k) + mu * s[1 + k :].reshape(k, k)) for x, s in zip(points, sums)]

    (value, slope, bend) = tried([g])[0]
    for _ in range(STEPS):
        if np.abs(slope).max() <= close:
            break
        way = np.linalg.lstsq(bend, -slope, rcond=None)[0]
        found = tried([g + x * way for x in LENGTHS])
        best = min(range(len(found)), key=lambda i: found[i][0])
        if found[best][0] >= value:
            best = min(range(len(found)), key=lambda i: np.abs(found[i][1]).max())
            if np.abs(found[best][1]).max() >= np.abs(slope).max():
                break
        g = g + LENGTHS[best] * way
        value, slope, bend = found[best]
    return g


def rated(docs: DataFrame, model, weights: dict[str, float], columns: list[str], anchor: str | None = None, text_col: str = "text") -> DataFrame:
    """(row struct of some columns, tokens, p, rate) of every row."""
    domains = model[0]
    if not domains:
        words = F.size(F.filter(F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), r"\s+"), lambda w: w != "")).cast("long")
        return docs.select(packed(docs, columns).alias("row"), words.alias("tokens"), F.array().cast("array<double>").alias("p"), F.lit(1.0).alias("rate"))
    weighed = materialize(posteriors(docs, model, columns, text_col), "mix-posteriors")
    p = [F.element_at("p", d + 1) for d in range(len(domains))]
    now = np.array([x or 0.0 for x in weighed.agg(*(F.sum(F.col("tokens") * q) for q in p)).first()])
    share = np.array([weights.get(d, 0.0) for d in domains])
    base = domains.index(anchor) if anchor else int(share.argmax())
    steps = []
    if share[base] > 0 and now[base] > 0:
        steps, _ = fit_rates(weighed, share * now[base] / share[base])
    return weighed.select("row", "tokens", "p", _rate(steps).alias("rate"))


def _copies(*draw: Column) -> Column:
    """A whole number with the rate as its mean: its floor, plus one where a hash falls below the rest."""
    drawn = F.pmod(F.xxhash64(F.lit("copies"), *draw), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor("rate") + F.when(drawn < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int")


def mix(docs: DataFrame, model, weights: dict[str, float], anchor: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tokens, p, rate, copies) of every row.

    Targets are weights (of the model's domains; others count as 0) times a token budget; the budget
    is what lets the anchor domain, by default the one with the largest weight, keep its tokens.
    copies is a whole number with the rate as its mean: the rate's floor, plus one where a hash of
    the id falls below the rest. Equal ids get equal draws, as do rows with a null id. Null and empty texts have
    no tokens and get the rate of their posterior. Without labelled rows, or without tokens, every rate is 1.
    An empty table gives an empty result; other columns are unread."""
    rows = rated(docs, model, weights, [id_col], anchor, text_col).withColumn("copies", _copies(F.col("row")[id_col]))
    return rows.select(F.col("row")[id_col].alias(id_col), "tokens", "p", "rate", "copies")


def repeated(docs: DataFrame, model, weights: dict[str, float], draw: list[str], text_col: str = "text") -> DataFrame:
    """The rows of docs, each as often as its copies say; rows that are equal in the columns `draw` are drawn
    alike. All columns are kept, whatever their names; a row with nulls counts like any other."""
    rows = rated(docs, model, weights, docs.columns, text_col=text_col).withColumn("copies", _copies(*(F.col("row")[c] for c in draw)))
    each = rows.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return each.select(*(F.col("row")[c].alias(c) for c in docs.columns))
