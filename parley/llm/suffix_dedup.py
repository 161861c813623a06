"""Removal of repeated 50-byte strings with two-stage suffix sorting.

A byte goes if a string of LENGTH bytes covers it that also starts in a document with a smaller id.
The work is dealt out by anchors. The anchor of a string is the 16-byte gram in it with the smallest
hash, leftmost on ties, so equal strings have equal anchors at equal offsets. Consecutive strings of a
document that have the same anchor occurrence form a run; a run's context is the bytes it spans. Only
anchors travel, about one for 17 bytes of text:

1. Runs with equal contexts are equal as wholes: all but those of the smallest id are repeats. A map
   task settles this among its own documents first, so a passage that very many documents share
   reaches its bucket once a flush of each task.
2. Where an anchor has different contexts in different documents, strings may agree in part. The
   contexts of such anchors, a few per cent of the text, are fetched and their suffixes sorted in two
   stages: suffixes smaller than their successors are sorted directly (by LENGTH bytes, all that
   matters here), the others are induced from them by scanning the buckets of first bytes in order.
   Common prefixes of neighbours of LENGTH or more then group equal strings.
3. An anchor with more than CROWD contexts, or with more than CROWD_AT_ONCE runs in one flush of a map
   task (a frequent line before ever different text), would gather an unbounded group of bytes. Its
   strings are compared by two 64-bit hashes instead: within the documents at hand first, then what is
   left by packed groups of the hash, so a string that very many documents share reaches its group once
   for each set of documents at hand. The second kind is dealt out by context from the start: the
   bucket of the anchor learns of it by one mark for each flush.

The repeats found go back to their documents as packed ranges.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import blocks_for, materialize, small_batches

LENGTH, GRAM = 50, 16
REACH = LENGTH - GRAM + 1
#: Contexts of one anchor that a suffix sort takes; more go by hashes.
CROWD = 2048
#: Runs of one anchor in a flush from which on the anchor is crowded, whatever its number elsewhere.
CROWD_AT_ONCE = 256
#: Bytes hashed at once (a longer text is cut, with overlap) and runs kept before a flush.
CHUNK, FLUSH = 1 << 18, 250_000
#: Documents and context bytes of one task group, about.
GROUP_BYTES, CONTEXT_GROUP = 4 << 20, 1 << 20
#: Bits of the folded set of document ids that spares untouched documents the shuffle; false positives only cost time.
FOLD_BITS = 1 << 23
SLICE_BYTES = 4096  # of a bitmap in Spark
SEPARATOR = 0xFF  # never a byte of UTF-8

_M = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.random.default_rng(50).integers(0, 1 << 64, (2, 256), dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _grams(data: np.ndarray, variant: int) -> dict[int, np.ndarray]:
    """Unmixed hashes of the grams of 1, 2, 4, ... 32 bytes at each place."""
    h = {1: _BYTES[variant][data]}
    for size in (2, 4, 8, 16, 32):
        half = h[size // 2]
        by = _mix(np.array([size + 64 * variant], np.uint64))[0] | np.uint64(1)
        h[size] = half[: -(size // 2)] * by + half[size // 2 :]
    return h


def _strings(h: dict[int, np.ndarray], n: int) -> np.ndarray:
    """Hashes of the LENGTH = 32 + 16 + 2 byte strings at each of n places."""
    return _mix((h[32][:n] * _M + h[16][32 : 32 + n]) * _M + h[2][48 : 48 + n])


def runs(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, context hash, first place and number of strings of each run in a buffer of texts,
    of which ends holds the exclusive end for every place."""
    n = len(data) - LENGTH + 1
    if n <= 0:
        none = np.zeros(0, np.uint64)
        return none, none, np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = _grams(data, 0)
    gram = _mix(h[GRAM].copy())
    least = (gram >> np.uint64(32) << np.uint64(32)) | np.arange(len(gram), dtype=np.uint64)
    span = 1
    while 2 * span <= REACH:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if REACH > span:
        least = np.minimum(least[: -(REACH - span)], least[REACH - span :])
    anchor = np.where(np.arange(n) + LENGTH <= ends[:n], (least[:n] & np.uint64(0xFFFFFFFF)).astype(np.int64), -1)
    edge = anchor[1:] != anchor[:-1]
    first, last = np.flatnonzero(np.r_[True, edge]), np.flatnonzero(np.r_[edge, True])
    real = anchor[first] >= 0
    first, last = first[real], last[real]
    whole = _strings(h, n)
    count = last - first + 1
    return gram[anchor[first]], _mix((whole[first] * _M + whole[last]) * _M + count.astype(np.uint64)), first, count


def _pieces(ids, texts) -> Iterator[tuple[int, int, bytes]]:
    """(id, place in the text, bytes): texts whole, or cut with overlap where longer than CHUNK."""
    for doc, text in zip(ids, texts):
        data = text.encode("utf-8", "surrogatepass")
        for at in range(0, max(1, len(data) - LENGTH + 1), CHUNK):
            yield int(doc), at, data[at : at + CHUNK + LENGTH - 1]


def _batches(pieces: Iterator[tuple[int, int, bytes]]) -> Iterator[list[tuple[int, int, bytes]]]:
    part, size = [], 0
    for p in pieces:
        part.append(p)
        size += len(p[2])
        if size >= CHUNK:
            yield part
            part, size = [], 0
    if part:
        yield part


def _doc_bucket(docs: np.ndarray, buckets: int) -> np.ndarray:
    return (_mix(docs.astype(np.int64).view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


_PACKED = {"A": ("u8", "u8", "i8", "u4", "u1"), "H": ("u8", "u8", "i8", "u4", "u1"), "R": ("i8", "u4", "u1"), "C": ("i8", "u4", "u1", "u8"), "W": ("i8", "u4", "u1", "u8"), "S": ("u8", "u8", "i8", "u4")}
ROW = "kind string, key long, blob binary"


def _pack(kind: str, keys: np.ndarray, *columns: np.ndarray) -> Iterator[dict]:
    """A row of packed columns for each key."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    columns = [c[order].astype(t) for c, t in zip(columns, _PACKED[kind])]
    cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else []
    for a, b in zip(cuts, [*cuts[1:], len(keys)]):
        yield {"kind": kind, "key": int(keys[a]), "blob": b"".join(c[a:b].tobytes() for c in columns)}


def _unpack(kind: str, blobs) -> list[np.ndarray]:
    width = sum(np.dtype(t).itemsize for t in _PACKED[kind])
    parts = [[] for _ in _PACKED[kind]]
    for blob in blobs:
        n, at = len(blob) // width, 0
        for i, t in enumerate(_PACKED[kind]):
            parts[i].append(np.frombuffer(blob, t, n, at))
            at += n * np.dtype(t).itemsize
    return [np.concatenate(p) if p else np.zeros(0, t) for p, t in zip(parts, _PACKED[kind])]


def _frame(rows: Iterator[dict]) -> pd.DataFrame:
    return pd.DataFrame(list(rows), columns=["kind", "key", "blob"])


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted keys: the starts of groups of equal rows, and the group of each row."""
    new = np.zeros(len(keys[0]), bool)
    if len(new):
        new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


def anchored(frames: Iterator[pd.DataFrame], buckets: int, most: int = FLUSH, crowd: int = CROWD_AT_ONCE) -> Iterator[pd.DataFrame]:
    """Runs of all documents of a partition, packed by the bucket of their anchors; what repeats within
    a flush goes out as found ranges. Runs of an anchor that a flush has more than crowd of are packed by
    the bucket of their contexts, and a mark, a run without strings, tells the anchor's bucket."""
    kept: list[tuple[np.ndarray, ...]] = []
    held = 0

    def flush() -> pd.DataFrame:
        a, ctx, doc, s, n = (np.concatenate(c) for c in zip(*kept))
        both = a * _M + ctx
        order = np.lexsort((doc, both))
        a, ctx, doc, s, n, both = a[order], ctx[order], doc[order], s[order], n[order], both[order]
        starts, group = _groups(both)
        again = doc > doc[starts][group]
        rows = [*_pack("R", _doc_bucket(doc[again], buckets), doc[again], s[again], n[again])]
        a, ctx, doc, s, n, both = (c[~again] for c in (a, ctx, doc, s, n, both))
        coarse = (a >> np.uint64(44)).astype(np.int64)  # few anchors remain in doubt, and only they are counted one by one
        doubt = np.flatnonzero(np.bincount(coarse, minlength=1)[coarse] > crowd)
        names, name, times = np.unique(a[doubt], return_inverse=True, return_counts=True)
        hot = np.zeros(len(a), bool)
        hot[doubt] = (times > crowd)[name]
        marks = names[times > crowd]
        none = np.zeros(len(marks), np.int64)
        here = [np.r_[c[~hot], m] for c, m in ((a, marks), (ctx, none.astype(np.uint64)), (doc, none), (s, none), (n, none))]
        rows += _pack("A", (here[0] % np.uint64(buckets)).astype(np.int64), *here)
        rows += _pack("H", (both[hot] % np.uint64(buckets)).astype(np.int64), a[hot], ctx[hot], doc[hot], s[hot], n[hot])
        return _frame(rows)

    for part in _batches(p for f in frames for p in _pieces(f["doc"], f["text"])):
        data = np.frombuffer(b"".join([p[2] for p in part]), np.uint8)
        sizes = np.array([len(p[2]) for p in part])
        stops = np.cumsum(sizes)
        a, ctx, s, n = runs(data, np.repeat(stops, sizes))
        owner = np.searchsorted(stops, s, side="right")
        base = np.array([p[1] for p in part])[owner] - (stops - sizes)[owner]
        kept.append((a, ctx, np.array([p[0] for p in part], np.int64)[owner], s + base, n))
        held += len(a)
        if held >= most:
            yield flush()
            kept, held = [], 0
    if kept:
        yield flush()


def settle(group: pd.DataFrame, buckets: int, crowd: int = CROWD) -> pd.DataFrame:
    """Of a bucket of anchors: repeated runs as found ranges, and contexts that need their bytes. All that
    is left of a crowded anchor is compared by strings, wherever its runs were settled."""
    if group["kind"].iat[0] == "R":
        return group[["kind", "key", "blob"]]
    kind = group["kind"].iat[0]
    a, ctx, doc, s, n = _unpack(kind, group["blob"])
    marks = np.unique(a[n == 0])
    a, ctx, doc, s, n = (c[n > 0] for c in (a, ctx, doc, s, n))
    order = np.lexsort((doc, ctx, a))
    a, ctx, doc, s, n = a[order], ctx[order], doc[order], s[order], n[order]
    a_starts, a_group = _groups(a)
    c_starts, c_group = _groups(a, ctx)
    again = doc > doc[c_starts][c_group]
    contexts = np.bincount(a_group[c_starts], minlength=len(a_starts))[a_group]
    shared = (np.minimum.reduceat(doc, a_starts) < np.maximum.reduceat(doc, a_starts))[a_group] if len(a) else np.zeros(0, bool)
    hot = np.isin(a, marks) | (kind == "H")
    open_ = ~again & (hot | shared & (contexts > 1))
    many = open_ & (hot | (contexts > crowd))
    few = open_ & ~many
    rows = [*_pack("R", _doc_bucket(doc[again], buckets), doc[again], s[again], n[again])]
    for kind, which in (("C", few), ("W", many)):
        rows += _pack(kind, _doc_bucket(doc[which], buckets), doc[which], s[which], n[which], a[which])
    return _frame(rows)


def _texts(docs: pd.DataFrame) -> dict[int, bytes]:
    return {int(d): t.encode("utf-8", "surrogatepass") for d, t in zip(docs["doc"], docs["text"])}


def _compared(h: np.ndarray, g: np.ndarray, doc: np.ndarray, s: np.ndarray) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """Of strings with two hashes each: (document, place) where a smaller id has the string too, and
    (hash, hash, document, place) of the others."""
    order = np.lexsort((doc, g, h))
    h, g, doc, s = h[order], g[order], doc[order], s[order]
    starts, group = _groups(h, g)
    again = doc > doc[starts][group]
    return (doc[again], s[again]), (h[~again], g[~again], doc[~again], s[~again])


def _ranges(doc: np.ndarray, s: np.ndarray, buckets: int) -> Iterator[dict]:
    """Single strings as found ranges."""
    return _pack("R", _doc_bucket(doc, buckets), doc, s, np.ones(len(doc), np.int64))


def agreed(group: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """Strings of a group of hashes that also start in a document with a smaller id."""
    again, _left = _compared(*_unpack("S", group["text"]))
    return _frame(_ranges(*again, buckets))


def contexts(docs: pd.DataFrame, asked: pd.DataFrame, groups: int, string_groups: int, buckets: int) -> pd.DataFrame:
    """The bytes of asked contexts, by the group of their anchor. The strings of crowded anchors are
    compared within these documents first; each that is left goes out once, by the group of its hash."""
    texts = _texts(docs)
    rows = []
    for kind in ("C", "W"):
        doc, s, n, a = _unpack(kind, asked.loc[asked["kind"] == kind, "blob"])
        if not len(doc):
            continue
        parts = [texts.get(d, b"")[i : i + m + LENGTH - 1] for d, i, m in zip(doc.tolist(), s.tolist(), n.tolist())]
        if kind == "C":
            order = np.argsort(key := (a % np.uint64(groups)).astype(np.int64), kind="stable")
            cuts = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0])
            for i, j in zip(cuts, [*cuts[1:], len(order)]):
                at = order[i:j]
                rows.append({"kind": "C", "key": int(key[at[0]]), "doc": doc[at].tobytes(), "s": s[at].tobytes(), "n": n[at].tobytes(), "text": b"".join([parts[x] for x in at])})
        else:
            data = np.frombuffer(b"".join(parts), np.uint8)
            first = np.cumsum([len(p) for p in parts]) - np.array([len(p) for p in parts])
            places = np.repeat(first, n) + (within := np.arange(int(n.sum())) - np.repeat(np.cumsum(n.astype(np.int64)) - n, n))
            hashes = [_strings(_grams(data, v), len(data) - LENGTH + 1)[places] for v in (0, 1)]
            again, left = _compared(*hashes, np.repeat(doc, n), np.repeat(s, n) + within)
            empty = {"doc": b"", "s": b"", "n": b""}
            rows += [{"kind": r["kind"], "key": r["key"], "text": r["blob"], **empty} for r in (*_ranges(*again, buckets), *_pack("S", (left[0] % np.uint64(string_groups)).astype(np.int64), *left))]
    return pd.DataFrame(rows, columns=["kind", "key", "doc", "s", "n", "text"])


def _words(data: np.ndarray, depth: int) -> np.ndarray:
    """The eight bytes from each place on as one number that orders like them; zeros behind the end."""
    padded = np.concatenate([data, np.zeros(depth + 16, np.uint8)]).astype(np.uint64)
    out = padded[: len(data) + depth + 8]
    for i in range(1, 8):
        out = (out << np.uint64(8)) | padded[i : len(data) + depth + 8 + i]
    return out


def _sorted_directly(words: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes at some places in order of depth bytes: by eight bytes, then ties by the next eight."""
    at = at[np.argsort(words[at], kind="stable")]
    group = np.cumsum(np.r_[True, words[at[1:]] != words[at[:-1]]]) if len(at) else at
    for off in range(8, depth, 8):
        tied = np.r_[False, group[1:] == group[:-1]] if len(at) else np.zeros(0, bool)
        open_ = np.flatnonzero(tied | np.r_[tied[1:], False]) if len(at) else at
        if not len(open_):
            break
        sub, g = at[open_], group[open_]
        key = words[sub + off]
        order = np.lexsort((key, g))
        sub, g, key = sub[order], g[order], key[order]
        at[open_] = sub
        step = np.ones(len(at), bool)
        step[1:] = group[1:] != group[:-1]
        step[open_[1:]] |= (g[1:] == g[:-1]) & (key[1:] != key[:-1])
        group = np.cumsum(step)
    return at


def two_stage_order(data: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of data (uint8) in order of their first depth bytes at least.

    Suffixes smaller than their successors are sorted directly; scanning the buckets of first bytes in
    ascending order then places each other suffix when its successor comes by."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    step = np.sign(np.diff(data.astype(np.int16)))
    step = np.r_[step, -1]  # the last suffix is larger than the empty one
    nearest = np.where(step != 0, np.arange(n), n)
    nearest = np.minimum.accumulate(nearest[::-1])[::-1]
    small = step[nearest] > 0
    direct = _sorted_directly(_words(data, depth), np.flatnonzero(small), depth)
    tails = np.searchsorted(data[direct], np.arange(257))
    heads: list[list[np.ndarray]] = [[] for _ in range(256)]
    heads[data[-1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        queue, placed = heads[c], []
        while queue:  # a run of one byte leads back into its own bucket
            now = np.concatenate(queue)
            placed.append(now)
            before = now[now > 0] - 1
            queue = [own] if len(own := before[(data[before] == c) & ~small[before]]) else []
        here = np.concatenate([*placed, direct[tails[c] : tails[c + 1]]])
        out.append(here)
        before = here[here > 0] - 1
        before = before[~small[before] & (data[before] > c)]
        first = data[before]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        cuts = np.flatnonzero(np.r_[True, first[1:] != first[:-1]]) if len(first) else []
        for i, j in zip(cuts, [*cuts[1:], len(first)]):
            heads[first[i]].append(before[i:j])
    return np.concatenate(out)


def common_prefixes(data: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """The common prefix, up to depth bytes, of each suffix with the one before it in order."""
    words = _words(data, depth)
    lcp = np.zeros(len(order), np.int64)
    alive = np.arange(1, len(order))
    for off in range(0, depth, 8):
        differ = words[order[alive] + off] ^ words[order[alive - 1] + off]
        high, low = differ >> np.uint64(32), differ & np.uint64(0xFFFFFFFF)  # halves, since doubles hold 53 bits
        bits = np.where(high > 0, 32 + np.frexp(high.astype(np.float64))[1], np.frexp(low.astype(np.float64))[1])
        equal = 8 - (bits + 7) // 8
        lcp[alive] = off + equal
        alive = alive[differ == 0]
        if not len(alive):
            break
    room = len(data) - np.maximum(order, np.r_[order[:1], order[:-1]])
    return np.minimum(np.minimum(lcp, depth), np.where(np.arange(len(order)) > 0, room, 0))


def repeated(group: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """Strings of a group of contexts that also start in a document with a smaller id."""
    doc = np.concatenate([np.frombuffer(b, "i8") for b in group["doc"]])
    s = np.concatenate([np.frombuffer(b, "u4") for b in group["s"]]).astype(np.int64)
    n = np.concatenate([np.frombuffer(b, "u1") for b in group["n"]]).astype(np.int64)
    size = n + LENGTH - 1
    text = np.frombuffer(b"".join(group["text"]), np.uint8)
    # Each context gets a separator behind it.
    data = np.full(len(text) + len(n), SEPARATOR, np.uint8)
    owner = np.repeat(np.arange(len(n)), size)
    data[np.arange(len(text)) + owner] = text
    start = np.cumsum(size + 1) - size - 1
    order = two_stage_order(data, LENGTH)
    lcp = common_prefixes(data, order, LENGTH)
    context = np.searchsorted(start, order, side="right") - 1
    place = order - start[context]
    # Neighbours that share LENGTH bytes: a group of equal strings, of which only whole ones count.
    group_of = np.cumsum(lcp < LENGTH) - 1
    whole = place < n[context]
    group_of, context, place = group_of[whole], context[whole], place[whole]
    starts, at = _groups(group_of)
    least = np.minimum.reduceat(doc[context], starts) if len(starts) else np.zeros(0, np.int64)
    again = doc[context] > least[at]
    context, place = context[again], place[again]
    return _frame(_pack("R", _doc_bucket(doc[context], buckets), doc[context], s[context] + place, np.ones(len(context), np.int64)))


def cut(data: bytes, s: np.ndarray, n: np.ndarray) -> tuple[bytes, int, int]:
    """What is left of a text, the bytes removed, and the number of removed runs."""
    if not len(s):
        return data, 0, 0
    order = np.argsort(s, kind="stable")
    a = s[order].astype(np.int64)
    b = np.maximum.accumulate(a + n[order] + LENGTH - 1)
    new = np.r_[True, a[1:] > b[:-1]]
    first, last = a[new], b[np.r_[np.flatnonzero(new)[1:] - 1, len(b) - 1]]
    left = b"".join(data[i:j] for i, j in zip([0, *last], [*first, len(data)]))
    return left, len(data) - len(left), len(first)


def removed(docs: pd.DataFrame, found: pd.DataFrame, columns: list[str]) -> pd.DataFrame:
    doc, s, n = _unpack("R", found["blob"])
    order = np.argsort(doc, kind="stable")
    doc, s, n = doc[order], s[order], n[order]
    out = []
    for d, t in zip(docs["doc"], docs["text"]):
        i, j = np.searchsorted(doc, [d, d + 1])
        data = t.encode("utf-8", "surrogatepass")
        left, gone, spans = cut(data, s[i:j], n[i:j])
        out.append((d, len(data), gone, spans, hashlib.sha256(left).hexdigest(), left))
    return pd.DataFrame([row[: len(columns)] for row in out], columns=columns)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = True) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept binary) of every row; ids are integers.
    kept, the remaining bytes, is left out unless with_kept.

    A null or empty text has no bytes and loses none. Rows that repeat id and text each get the id's
    result (they are one document). Where rows of one id differ in text, the row with the smallest
    text hash is the document; the others, and rows with a null id, which has no order, are returned
    whole. An empty table gives an empty result; other columns are unread."""
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("hash", F.xxhash64("text"))
    ids = base.groupBy("doc").agg(F.min("hash").alias("low"), F.max("hash").alias("high"))
    clash = materialize(ids.where("low <> high and doc is not null").select(F.col("doc").alias("id"), "low"), "suffix-clash")
    total = base.agg(F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("bytes")).first()
    buckets = blocks_for(total["bytes"] or 0, GROUP_BYTES, 8)
    judged, aside = base.where("doc is not null"), base.where("doc is null")
    if not clash.isEmpty():
        marked = judged.join(clash, judged.doc == clash.id, "left")
        judged, aside = marked.where("id is null or hash = low").select(base.columns), aside.unionByName(marked.where("hash <> low").select(base.columns))
    long_ = judged.where(F.octet_length("text") >= LENGTH).select("doc", "text")

    settled = long_.mapInPandas(lambda frames: anchored(frames, buckets), ROW).groupBy("kind", "key").applyInPandas(lambda g: settle(g, buckets), ROW)
    settled = materialize(settled, "suffix-settled")

    asked = settled.where("kind <> 'R'")
    shape = "kind string, key long, doc binary, s binary, n binary, text binary"
    volume = dict(asked.groupBy("kind").agg(F.sum(F.octet_length("blob"))).collect())  # two kinds at most
    groups = blocks_for(volume.get("C", 0), CONTEXT_GROUP // 4)
    string_groups = blocks_for(volume.get("W", 0), GROUP_BYTES // REACH)
    fetched = _meet(long_, asked, buckets, lambda a, b: contexts(a, b, groups, string_groups, buckets), shape)
    fetched = materialize(fetched, "suffix-contexts")
    by_sort = fetched.where("kind = 'C'").groupBy("key").applyInPandas(lambda g: repeated(g, buckets), ROW)
    by_hash = fetched.where("kind = 'S'").groupBy("key").applyInPandas(lambda g: agreed(g, buckets), ROW)
    at_once = fetched.where("kind = 'R'").select("kind", "key", F.col("text").alias("blob"))
    found = materialize(settled.where("kind = 'R'").unionByName(at_once).unionByName(by_sort).unionByName(by_hash), "suffix-found")

    kind = docs.schema[id_col].dataType.simpleString()
    columns = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + with_kept]
    result = f"{id_col} long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept
    touched = _meet(long_, found, buckets, lambda a, b: removed(a, b, columns), result)
    raw = F.encode("text", "UTF-8")
    whole = lambda df: df.select(F.col("doc").alias(id_col), F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(raw, 256).alias("kept_sha256"), raw.alias("kept")).select(columns)
    short = judged.where(F.octet_length("text") < LENGTH).select("doc", "text")
    rest = whole(short.unionByName(aside.select("doc", "text"))).unionByName(whole(_apart(long_, found)))
    out = touched.unionByName(rest)
    return out.withColumn(id_col, F.col(id_col).cast(kind))


def _fold(packed: DataFrame) -> np.ndarray:
    """The documents of packed rows as a set folded into FOLD_BITS bits, whatever their number: at
    most 1 MB on the driver. A task makes one set of all its rows, in the slices that Spark joins."""

    def ids(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.zeros(FOLD_BITS, bool)
        for f in frames:
            for kind, blob in zip(f["kind"], f["blob"]):
                doc = _unpack(kind, [blob])[0]
                bits[(_mix(doc.view(np.uint64).copy()) % np.uint64(FOLD_BITS)).astype(np.int64)] = True
        slices = np.packbits(bits, bitorder="little").reshape(-1, SLICE_BYTES)
        at = np.flatnonzero(slices.any(1))
        yield pd.DataFrame({"at": at, "slice": [slices[i].tobytes() for i in at]})

    rows = packed.select("kind", "blob").mapInPandas(ids, "at long, slice binary").groupBy("at").agg(F.bitmap_or_agg("slice").alias("slice")).collect()
    slices = np.zeros((FOLD_BITS // 8 // SLICE_BYTES, SLICE_BYTES), np.uint8)
    for at, found in rows:
        slices[at] = np.frombuffer(found, np.uint8)
    return slices.reshape(-1).view(np.int64)


def _split(docs: DataFrame, packed: DataFrame):
    """Documents with a flag that is true for all that packed rows mention."""
    words = docs.sparkSession.sparkContext.broadcast(_fold(packed))

    def flag(keep: bool):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                bit = (_mix(f["doc"].to_numpy().view(np.uint64).copy()) % np.uint64(FOLD_BITS)).astype(np.int64)
                yield f[((words.value[bit // 64] >> (bit % 64)) & 1).astype(bool) == keep]

        return run

    return docs.mapInPandas(flag(True), "doc long, text string"), docs.mapInPandas(flag(False), "doc long, text string")


def _meet(docs: DataFrame, packed: DataFrame, buckets: int, each, schema: str) -> DataFrame:
    """Documents that packed rows may mention, brought to these rows by the bucket of their ids."""
    touched, _rest = _split(docs, packed)

    def keyed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(key=_doc_bucket(f["doc"].to_numpy(), buckets))

    left = touched.mapInPandas(keyed, "doc long, text string, key long")
    return left.groupBy("key").cogroup(packed.groupBy("key")).applyInPandas(lambda a, b: each(a, b), schema)


def _apart(docs: DataFrame, packed: DataFrame) -> DataFrame:
    return _split(docs, packed)[1]
