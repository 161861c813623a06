"""Best-fit packing of token pieces into sequences, with certified counts.

Texts become pieces of at most `capacity` tokens. Pieces are dealt at random into blocks of about BLOCK and each block is
packed by best-fit decreasing. Dual feasible functions (maps f with sum f(x) <= 1 over whatever fits one sequence)
bound from below how many sequences the block's lengths need: a block whose count meets its bound is certified and
final. In every other one the sequences with room are opened again; their pieces are dealt anew, together with those of
other blocks with gaps, and packed again. This ends when the gaps of all open blocks add up to less than one sequence,
when one block is left or when a round closes less than a tenth of the open sequences. What is moved shrinks from round to round, and no task sees more
than FAN_IN blocks."""

from __future__ import annotations

import hashlib
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.common import blocks_for, materialize, small_batches, trim

CAPACITY, BLOCK = 4096, 4096
#: A round deals the pieces of so many open blocks into one, unless they are more than as many full ones.
FAN_IN = 16
#: Steps of the staircase functions u^(k).
STAIRS = 24
#: A block or round of less gap than this has none; sums of a block are exact far below it.
EPSILON = 1e-6
#: Chunks that a worker's encoder remembers in each of two generations; longer chunks are not remembered.
CACHE_ENTRIES, CACHE_CHARS = 300_000, 64
#: Characters encoded at once.
SLICE = 1 << 20
_BREAK = re.compile("[ \n]")
#: Letters of Latin-1, then marks but no apostrophe: the vocabulary's splitting pattern parts the two wherever they stand.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)")
#: The characters that stand for the bytes of these letters in a byte-level vocabulary: a byte is the code point of its own
#: number where that is printable, else one from U+0100 on, counted in order.
_SILENT = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
_BYTES = [chr(256 + _SILENT.index(b)) if b in _SILENT else chr(b) for b in range(256)]
_SPELL = {c: "".join(_BYTES[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}


def _raw(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    """Ids of whole texts, by chunks between spaces and line ends: the vocabulary drops white space and splits at it, so a
    text's ids are those of its chunks in a row. One per worker process."""

    def __init__(self, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(model)
        self.model = self.tokenizer.model
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _fresh(self, chunks: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(chunks, add_special_tokens=False)] if chunks else []

    def _word(self, word: str) -> list[int]:
        """Ids of a lower-case word of plain letters: nothing to normalise or split, so the merges alone."""
        return [t.id for t in self.model.tokenize(word if word.isascii() else word.translate(_SPELL))]

    def _learn(self, chunks: set[str]) -> dict[str, bytes]:
        """Ids of the chunks that the young generation doesn't hold."""
        found, parts, words, rest = {}, {}, set(), set()
        for c in chunks:
            if (known := self.old.get(c)) is not None:
                found[c] = known
            elif m := _PLAIN.fullmatch(c):
                parts[c] = word, marks = m[1].lower(), m[2]
                words.add(word)
                if marks:
                    rest.add(marks)
            else:
                parts[c] = (c,)
                rest.add(c)
        known = {p: ids for p in words | rest if (ids := self.young.get(p, self.old.get(p))) is not None}
        known[""] = b""
        known |= {w: _raw(self._word(w)) for w in words if w not in known}
        new = [p for p in rest if p not in known]
        known |= {p: _raw(ids) for p, ids in zip(new, self._fresh(new))}
        found |= {c: b"".join([known[x] for x in p]) for c, p in parts.items()}
        self.young |= {c: ids for c, ids in (known | found).items() if len(c) <= CACHE_CHARS}
        return found

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        out, at = [], 0
        while at < len(text):
            end = len(text)
            if end - at > SLICE and (m := _BREAK.search(text, at + SLICE)):
                end = m.start()
            chunks = text[at:end].replace("\n", " ").split(" ")
            if len(self.young) >= CACHE_ENTRIES:
                self.young, self.old = {}, self.young
            parts = list(map(self.young.get, chunks))
            if None in parts:
                found = self._learn({c for c, p in zip(chunks, parts) if p is None})
                parts = [found[c] if p is None else p for c, p in zip(chunks, parts)]
            out += parts
            at = end
        return b"".join(out)


_encoders: dict[str, Encoder] = {}


def _encoder(shipped, digest: str) -> Encoder:
    if digest not in _encoders:
        _encoders.clear()
        _encoders[digest] = Encoder(shipped.value)
    return _encoders[digest]


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every text's ids and end_id, cut after each `capacity` of them.

    The vocabulary, fixed in size, goes to the executors as a broadcast. A null text counts as empty: one
    piece of one token. Long texts are encoded whole, slice by slice."""
    spark = docs.sparkSession
    with open(tokenizer_path, "rb") as f:
        model = f.read()
    shipped, digest = spark.sparkContext.broadcast(model), hashlib.sha256(model).hexdigest()
    small_batches(spark)
    end = _raw([end_id])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shipped, digest)
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encoder.ids(text or "") + end
                rows += [(i, n, at // 4, len(cut) // 4, zlib.crc32(cut)) for n, at in enumerate(range(0, len(ids), 4 * capacity)) if (cut := ids[at : at + 4 * capacity])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        trim()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """(bin and offset of each length, free space of each bin): each length goes to the bin with the least room
    that holds it. Lengths must come in descending order for best-fit decreasing."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    # Bit r: a bin with exactly r free.
    rooms, bins, offsets, free = 0, [], [], []
    for x in lengths:
        if fits := rooms >> x:
            room = x + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            b, room = len(free), capacity
            free.append(capacity)
        bins.append(b)
        offsets.append(capacity - room)
        free[b] = left = room - x
        if left:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins, offsets, free


def lower_bound(histogram: np.ndarray, capacity: int) -> float:
    """The largest value that a dual feasible function gives to the lengths: no packing has fewer bins.

    histogram[x] is the number of lengths x, up to capacity. Functions: the share x / capacity and the staircases
    u^(k), each alone and with the threshold U^(t), by which lengths below t count nothing and those above capacity - t
    one bin each."""
    x = np.arange(capacity + 1, dtype=np.int64)
    h = histogram.astype(np.float64)
    t = np.arange(0, capacity // 2 + 1)
    upto = np.cumsum(h)
    large = upto[-1] - upto[capacity - t]
    best = 0.0
    for k in range(STAIRS + 1):
        value = x / capacity if k == 0 else np.where((k + 1) * x % capacity == 0, x / capacity, (k + 1) * x // capacity / k)
        total = np.concatenate([[0.0], np.cumsum(h * value)])
        best = max(best, float((large + total[capacity - t + 1] - total[t]).max()))
    return best


def pack_block(block: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """A block's pieces with bin and offset, whether the bin is settled, and the block's gap."""
    block = block.sort_values(["length", "row"], ascending=[False, True], kind="stable", ignore_index=True)
    lengths = block["length"].to_numpy()
    bins, offsets, free = best_fit(lengths.tolist(), capacity)
    gap = len(free) - lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
    settled = np.array(free) == 0 if gap > EPSILON else np.ones(len(free), dtype=bool)
    return block.assign(bin=bins, offset=offsets, settled=settled[bins], gap=gap)


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): the pieces packed into as few sequences as found.

    Rows are told apart by a number of their own, so null and repeated ids do no harm; equal lengths are interchangeable.
    An empty table gives an empty result. `certificate` compares the outcome with the bound of all lengths."""
    keep = ["doc_id", "piece", "start", "length", "ids_crc32"]
    now = materialize(cut.select(*keep, F.monotonically_increasing_id().alias("row")), "packing-pieces")
    n, parts, around, bins_before = now.count(), [], 0, None
    blocks = blocks_for(n, BLOCK)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, row long, block long, bin long, offset long, settled boolean, gap double"
    while True:
        dealt = now.withColumn("block", F.pmod(F.xxhash64("row", F.lit(around)), F.lit(blocks)))
        packed = materialize(dealt.groupBy("block").applyInPandas(lambda b: pack_block(b, capacity), schema), "packing-round")
        packed = packed.withColumn("sequence_id", F.shiftleft(F.lit(around).cast("long"), 57) + F.shiftleft("block", 20) + F.col("bin"))
        # One row a block, then one row.
        each = packed.groupBy("block").agg(F.first("gap").alias("gap"), F.countDistinct(F.when(~F.col("settled"), F.col("bin"))).alias("bins"), F.count(F.when(~F.col("settled"), 1)).alias("pieces"))
        gap, bins, left, gaps = each.agg(F.sum("gap"), F.sum("bins"), F.sum("pieces"), F.count(F.when(F.col("pieces") > 0, 1))).first()
        more = bool(n) and gap >= 1 and gaps > 1 and (bins_before is None or bins < 0.9 * bins_before)
        parts.append(packed.where("settled") if more else packed)
        if not more:
            break
        now = packed.where("not settled").select(*keep, "row")
        blocks, bins_before, around = max(-(-gaps // FAN_IN), blocks_for(left, FAN_IN * BLOCK)), bins, around + 1
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*keep, "sequence_id", "offset")


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> dict[str, int]:
    """How many sequences there are, and how many any packing needs at least. Collects one count a length."""
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for r in packed.groupBy("length").count().collect():
        histogram[r["length"]] = r["count"]
    used = packed.select("sequence_id").distinct().count()
    return {"sequences": used, "bound": int(np.ceil(lower_bound(histogram, capacity) - EPSILON))}


def pack_documents(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    return pack(pieces(docs, tokenizer_path, end_id, capacity), capacity)
