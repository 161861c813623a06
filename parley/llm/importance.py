"""Target-distribution importance resampling over hashed n-gram features.

A feature is a run of one to three words; its bucket is the CRC-32 of its bytes modulo BUCKETS. Raw and
target tables give two arrays of bucket counts, these one array of gains, and a document's weight is the sum
of the gains of its features, taken by array indexing. A score adds noise made from the document's id, so that
the highest scores are a draw without replacement.

The k-th largest (score, id) is found by radix selection: each round counts one digit of the key over the rows
that share the digits found so far, so a round moves at most 2^DIGIT_BITS counts. Only the rows from that key on
are range-sorted and ranked.

Words and features are made in bulk: a table walk gives the CRC of all words of a batch at once, and the CRC of a
run follows from those of its words, because appending n bytes is a linear map of the CRC for each n."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import materialize, small_batches, trim

BUCKETS, RUN = 10_000, 3
#: Documents with fewer words are not drawn.
LEAST_WORDS = 20
#: Bits of a digit of the selection.
DIGIT_BITS = 12
#: Bytes of text worked on at once.
WINDOW = 1 << 22
#: Longer words get their CRC one by one.
SHORT = 48
SIGN = -(1 << 63)

#: Byte classes of a word, lower-cased: digits, letters and every byte of a character beyond ASCII.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_WORD = np.zeros(256, dtype=bool)
IN_WORD[48:58] = IN_WORD[97:123] = IN_WORD[65:91] = IN_WORD[128:] = True
#: CRC-32 of single bytes without the conditioning, the usual table of the reflected polynomial.
STEP = np.array([zlib.crc32(bytes([b]), 0xFFFFFFFF) ^ 0xFFFFFFFF for b in range(256)], dtype=np.uint32)


def _append_tables() -> np.ndarray:
    """[n, i, b]: what byte i with value b of a CRC becomes when n bytes follow, for n up to SHORT + 1."""
    tables = np.zeros((SHORT + 2, 4, 256), dtype=np.uint32)
    for i in range(4):
        tables[0, i] = np.arange(256, dtype=np.uint32) << np.uint32(8 * i)
    for n in range(1, SHORT + 2):
        tables[n] = STEP[tables[n - 1] & 255] ^ (tables[n - 1] >> np.uint32(8))
    return tables


APPEND = _append_tables()


def _followed(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The CRC part that bytes before n further bytes leave; n is at most SHORT + 1."""
    return APPEND[n, 0, crc & 255] ^ APPEND[n, 1, crc >> 8 & 255] ^ APPEND[n, 2, crc >> 16 & 255] ^ APPEND[n, 3, crc >> 24]


def _word_crcs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """CRC-32 of each word, and of each word with a space before it."""
    order = np.argsort(-np.minimum(lengths, SHORT + 1), kind="stable")
    first, left = starts[order], lengths[order]
    plain = np.full(len(order), 0xFFFFFFFF, dtype=np.uint32)
    spaced = np.full(len(order), zlib.crc32(b" ") ^ 0xFFFFFFFF, dtype=np.uint32)
    long = int(np.searchsorted(-left, -SHORT, side="left"))
    for k in range(int(left[long]) if long < len(left) else 0):
        live = slice(long, int(np.searchsorted(-left, -k, side="left")))
        byte = data[first[live] + k]
        plain[live] = STEP[(plain[live] ^ byte) & 255] ^ (plain[live] >> np.uint32(8))
        spaced[live] = STEP[(spaced[live] ^ byte) & 255] ^ (spaced[live] >> np.uint32(8))
    plain ^= np.uint32(0xFFFFFFFF)
    spaced ^= np.uint32(0xFFFFFFFF)
    for at in range(long):
        word = data[first[at] : first[at] + left[at]].tobytes()
        plain[at], spaced[at] = zlib.crc32(word), zlib.crc32(b" " + word)
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return plain[back], spaced[back]


def _appended(before: np.ndarray, spaced: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC of (what `before` stands for, a space, a word)."""
    out = _followed(before, np.minimum(lengths, SHORT) + 1) ^ spaced
    for at in np.flatnonzero(lengths > SHORT):
        crc, n = np.uint32(before[at]), int(lengths[at]) + 1
        while n:
            step = min(n, SHORT + 1)
            crc = _followed(crc, np.int64(step))
            n -= step
        out[at] = crc ^ spaced[at]
    return out


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(documents, buckets, words): the place in `texts` and the bucket of every feature, and the places of the new
    words, window by window, so that memory follows WINDOW and the longest word, not the longest text."""
    texts = texts.cast(pa.large_string()).fill_null("")
    edges = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[: edges[-1]]
    # The last RUN - 1 words before a window, whose runs reach into it: document, then the CRC of each run that ends there.
    doc_before = np.full(RUN - 1, -1, dtype=np.int64)
    runs_before = np.zeros((RUN - 1, RUN - 1), dtype=np.uint32)
    low = int(edges[0])
    while low < len(raw):
        high = min(low + WINDOW, len(raw))
        while high < len(raw) and IN_WORD[raw[high - 1]] and IN_WORD[raw[high]]:
            ahead = np.flatnonzero(~IN_WORD[raw[high : high + WINDOW]])
            high = high + int(ahead[0]) if len(ahead) else min(high + WINDOW, len(raw))
        window = LOWER[raw[low:high]]
        inside = IN_WORD[window]
        begins = np.zeros(len(window) + 1, dtype=bool)
        begins[edges[(edges >= low) & (edges < high)] - low] = True
        starts = np.flatnonzero(inside & (begins[:-1] | ~np.concatenate([[False], inside[:-1]])))
        ends = np.flatnonzero(inside & (begins[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
        doc = np.searchsorted(edges, starts + low, side="right") - 1
        plain, spaced = _word_crcs(window, starts, ends - starts)
        docs, crcs = [doc], [plain]
        all_docs = np.concatenate([doc_before, doc])
        # runs[n]: CRCs of the runs of n + 1 words, by last word; words before the window stand first.
        runs = [np.concatenate([runs_before[:, 0], plain])]
        for n in range(1, RUN):
            ending = np.concatenate([np.zeros(RUN - 1, dtype=np.uint32), _appended(runs[-1][RUN - 2 : -1], spaced, ends - starts)])
            together = all_docs[RUN - 1 - n : len(all_docs) - n] == doc
            docs.append(doc[together])
            crcs.append(ending[RUN - 1 :][together])
            if n < RUN - 1:
                ending[: RUN - 1] = runs_before[:, n]
                runs.append(ending)
        yield np.concatenate(docs), (np.concatenate(crcs) % np.uint32(BUCKETS)).astype(np.int64), doc
        doc_before = all_docs[-(RUN - 1) :]
        runs_before = np.stack([r[-(RUN - 1) :] for r in runs], axis=1)
        low = high


def bucket_counts(texts: DataFrame, text_col: str = "text") -> np.ndarray:
    """How often each bucket occurs in all texts: BUCKETS numbers, counted in the tasks and summed by bucket."""
    small_batches(texts.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for _, buckets, _ in features(batch.column(0)):
                total += np.bincount(buckets, minlength=BUCKETS)
        trim()
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    part = texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "bucket int, n long")
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for r in part.groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["bucket"]] = r["n"]
    return counts


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + BUCKETS) / ((s + 1)(T + BUCKETS)))) for each bucket."""
    s_all, t_all = float(raw.sum()) + BUCKETS, float(target.sum()) + BUCKETS
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(raw.tolist(), target.tolist())], dtype=np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row, by one lookup in the array of gains for each feature."""
    small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            words, count, weight = (np.zeros(n, dtype=np.int64) for _ in range(3))
            for doc, buckets, new in features(batch.column(1)):
                words += np.bincount(new, minlength=n)
                count += np.bincount(doc, minlength=n)
                # Sums of a window stay far below 2^53: exact in doubles.
                weight += np.bincount(doc, weights=shipped.value[buckets], minlength=n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (words, count, weight))], names=["doc_id", "n_words", "n_features", "weight"])
        trim()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def noise(seed: int, doc_id: Column) -> Column:
    """floor(-1000 ln(-ln u)), u in (0, 1) from the SHA-256 of seed and id; null for a null id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def kth(rows: DataFrame, column: str, k: int, largest: bool) -> tuple[int, int]:
    """(the k-th largest or smallest value of a long column, how many rows lie strictly before it), by radix selection.

    Each round counts the next DIGIT_BITS bits below the bits that all remaining rows share; its scan reads
    the remaining range only. k must be between 1 and the number of rows."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    before = 0
    while low != high:
        # Bits in unsigned order: the sign bit flipped.
        shift = max(0, ((low ^ SIGN) ^ (high ^ SIGN)).bit_length() - DIGIT_BITS)
        digit = F.shiftright(F.col(column), shift)
        found = rows.where(F.col(column).between(low, high)).groupBy(digit.alias("digit")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect()
        for r in sorted(found, key=lambda r: r["digit"], reverse=largest):
            if before + r["n"] >= k:
                low, high = r["low"], r["high"]
                break
            before += r["n"]
    return low, before


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with their rank from 1 in the given order: sorted by ranges, numbered in each, shifted by the sizes of the
    ranges before (one number for each partition)."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = materialize(placed, "resample-selected")
    sizes = placed.groupBy(F.shiftright("_at", 33).alias("part")).count().collect()
    starts, total = [], 0
    for r in sorted(sizes, key=lambda r: r["part"]):
        starts.append((r["part"], total))
        total += r["count"]
    begun = rows.sparkSession.createDataFrame(starts, "_part long, _begun long")
    joined = placed.join(F.broadcast(begun), F.shiftright("_at", 33) == F.col("_part"))
    return joined.withColumn("rank", F.col("_begun") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_at", "_part", "_begun")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank): every row of docs weighed towards the target texts; `rank` is
    set for the floor(percent N / 100) highest scores of the N rows with at least LEAST_WORDS words.

    Ties go to the smaller id; rows that share an id and a score are drawn one by one, those with more features first.
    Null and empty texts have no features and weight 0; long texts are read whole, window by window. A row with a null
    id counts in the statistics and has a weight, but no score, no part in N and no rank. An empty table gives an empty
    result; an empty target weighs all by rarity alone. Other columns are unread."""
    gain = gains(bucket_counts(docs, text_col), bucket_counts(target, target_col))
    scored = materialize(weighed(docs, gain, id_col, text_col).withColumn("score", F.col("weight") + noise(seed, F.col("doc_id"))), "resample-scored")
    able = scored.where((F.col("n_words") >= LEAST_WORDS) & F.col("score").isNotNull())
    k = percent * able.count() // 100
    unranked = F.lit(None).cast("long").alias("rank")
    if not k:
        return scored.select("*", unranked)
    score, above = kth(able, "score", k, largest=True)
    last, _ = kth(able.where(F.col("score") == score), "doc_id", k - above, largest=False)
    drawn = F.coalesce((F.col("n_words") >= LEAST_WORDS) & ((F.col("score") > score) | (F.col("score") == score) & (F.col("doc_id") <= last)), F.lit(False))
    chosen = ranked(scored.where(drawn), [F.desc("score"), F.asc("doc_id"), F.desc("n_features")])
    # Repeated rows of the last key may reach beyond k.
    chosen = chosen.withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))
    return scored.where(~drawn).select("*", unranked).unionByName(chosen.select(*scored.columns, "rank"))
