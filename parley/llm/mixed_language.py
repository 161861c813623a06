"""Language identification by multilingual mixture inference.

Training counts hashed letter trigrams per language over all labelled rows, so the model's size is
fixed: 2^15 trigram cells by the number of languages. A document is a bag of words, each drawn from
one language; a word's likelihood under a language is the product of its trigrams' smoothed
probabilities. Expectation-maximisation estimates the document's language proportions. The set of
languages grows from the best single one: a language enters if it raises the log-likelihood by more
than a penalty of PENALTY * ln(words) + MARGIN. Since the log-likelihood is concave in the
proportions, a language whose mean likelihood ratio against the current mixture is at most one
cannot raise it, and is not tried.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import small_batches, trim

CELLS = 1 << 15
PENALTY, MARGIN, ROUNDS, CLOSE = 0.5, 2.0, 50, 1e-4
#: Characters scored at once; a longer text is worked through in such slices, cut behind a non-letter.
SLICE = 1 << 17

_letters: np.ndarray | None = None


def _table() -> np.ndarray:
    """Lower-cased code point of every letter; 0 for whatever is no letter."""
    global _letters
    if _letters is None:
        t = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            if unicodedata.category(chr(c))[0] == "L":
                low = chr(c).lower()
                t[c] = ord(low) if len(low) == 1 else c
        _letters = t
    return _letters


def _trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The cell of the trigram around each letter, and where each word starts among them."""
    codes = _table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    around = np.concatenate([[0], codes, [0]]).astype(np.uint64)
    at = np.flatnonzero(codes)
    h = around[at] * np.uint64(0x9E3779B97F4A7C15) ^ around[at + 1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ around[at + 2] * np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(49)).astype(np.int64), np.flatnonzero(np.diff(at, prepend=-9) != 1)


def _slices(text: str) -> Iterator[str]:
    """The text in slices that end behind a non-letter, so that no word is cut but one longer than a slice."""
    at = 0
    while len(text) - at > SLICE:
        end = at + SLICE
        while end > at and text[end - 1].isalpha():
            end -= 1
        end = end if end > at else at + SLICE
        yield text[at:end]
        at = end
    yield text[at:]


def held_out(id_col: str, folds: int = 3, fold: int = 1) -> Column:
    """True for ids whose CRC-32, taken as text, leaves the remainder fold; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def train(rows: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and the log probability of each trigram cell by language, from all rows with both
    columns. The counts that reach the driver are bounded by CELLS times the languages."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, np.ndarray] = {}
        for f in frames:
            for text, lang in zip(f["text"], f["lang"]):
                for part in _slices(text):
                    cells, _ = _trigrams(part)
                    if len(cells):
                        counts.setdefault(lang, np.zeros(CELLS, np.int64))
                        counts[lang] += np.bincount(cells, minlength=CELLS)
        for lang, c in counts.items():
            at = np.flatnonzero(c)
            yield pd.DataFrame({"lang": lang, "cell": at, "n": c[at]})
        trim()

    small_batches(rows.sparkSession)
    known = rows.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    total = known.mapInPandas(run, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(total["lang"].unique())
    n = np.zeros((CELLS, len(langs)))
    for k, lang in enumerate(langs):
        own = total[total["lang"] == lang]
        n[own["cell"].to_numpy(), k] = own["n"].to_numpy()
    return langs, np.log((n + 0.1) / (n.sum(axis=0) + 0.1 * CELLS)).astype(np.float32) if langs else n.astype(np.float32)


def _em(p: np.ndarray, mix: np.ndarray) -> tuple[np.ndarray, float]:
    for _ in range(ROUNDS):
        joint = p * mix
        total = joint.sum(axis=1)
        new = (joint / total[:, None]).mean(axis=0)
        done = np.abs(new - mix).max() < CLOSE
        mix = new
        if done:
            break
    return mix, float(np.log(p @ mix).sum())


def infer(text: str, logp: np.ndarray) -> tuple[int, np.ndarray] | None:
    """The index of the main language and the proportions of all; None without a letter."""
    parts = []
    for part in _slices(text):
        cells, starts = _trigrams(part)
        if len(cells):
            parts.append(np.add.reduceat(logp[cells], starts, axis=0))
    if not parts:
        return None
    ll = np.concatenate(parts).astype(np.float64)
    p = np.exp(ll - ll.max(axis=1, keepdims=True)).clip(1e-30)
    n, k = p.shape
    single = np.log(p).sum(axis=0)
    chosen = [int(single.argmax())]
    mix, best = np.ones(1), float(single.max())
    while len(chosen) < k:
        gain = (p / (p[:, chosen] @ mix)[:, None]).mean(axis=0)
        tried = [(*_em(p[:, [*chosen, c]], np.append(mix * 0.9, 0.1)), c) for c in range(k) if c not in chosen and gain[c] > 1]
        if not tried:
            break
        new, value, c = max(tried, key=lambda x: x[1])
        if value - best <= PENALTY * np.log(n) + MARGIN:
            break
        chosen, mix, best = [*chosen, c], new, value
    out = np.zeros(k)
    out[chosen] = mix
    return int(out.argmax()), out


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, langs): main language, its proportion, and all languages found.

    One row per input row, repeated rows included. A null, empty or letterless text, or a model
    without languages, gives `und`, score 0 and no languages; ties go to the language that sorts first.
    An empty table gives an empty result; other columns are unread."""
    langs, logp = model
    small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(logp)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for text in f["text"]:
                found = infer(text, shipped.value) if langs and text else None
                if found is None:
                    out.append(("und", 0.0, []))
                else:
                    mix = found[1]
                    out.append((langs[found[0]], float(mix[found[0]]), [langs[i] for i in np.argsort(-mix, kind="stable") if mix[i] > 0]))
            pred, score, each = zip(*out) if out else ((), (), ())
            yield pd.DataFrame({id_col: f[id_col], "lang_pred": pred, "score": np.clip(np.array(score, float), 0, 1), "langs": list(each)})
        trim()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string").alias("text")).mapInPandas(run, f"{id_col} {kind}, lang_pred string, score double, langs array<string>")


def label(docs: DataFrame, model: tuple[list[str], np.ndarray], min_share: float, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs whose main language is known and holds min_share of the text, with lang_col set
    to it. All columns pass through the inference, so no join is needed."""
    langs, logp = model
    small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(logp)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            found = [infer(t, shipped.value) if langs and t else None for t in batch.column(names.index(text_col)).to_pylist()]
            keep = pa.array([f is not None and f[1][f[0]] >= min_share for f in found], pa.bool_())
            lang = pa.array([langs[f[0]] if f else None for f in found], pa.string())
            yield batch.set_column(names.index(lang_col), lang_col, lang).filter(keep)
        trim()

    return docs.mapInArrow(run, docs.schema)
