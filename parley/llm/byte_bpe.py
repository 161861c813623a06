"""Byte-level BPE through a sentencepiece model that is serialised straight from a rank file.

Each byte is mapped to one code point (U+0100 + byte), so that a vocabulary of byte strings becomes
a vocabulary of ordinary pieces; a piece's score is its negative rank, so that the library's
"highest score first, leftmost on ties" merge order is the rank order of byte-level BPE. The
normaliser is the identity. Texts are cut into pre-tokens by the vocabulary's pattern, every
pre-token is encoded by itself, and a whole pre-token that is in the vocabulary is one id.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.common import small_batches, trim

#: First code point of the byte alphabet: byte b is chr(BASE + b).
BASE = 0x100
#: Distinct pre-tokens an encoder remembers before it starts afresh; bounds a worker's memory.
CACHE_ENTRIES = 100_000
#: Longer pre-tokens are not remembered.
CACHE_BYTES = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a tiktoken file: base64 token and rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, payload: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def _number(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def mapped(data: bytes) -> str:
    return "".join(map(chr, (BASE + b for b in data)))


def serialise_model(ranks: dict[bytes, int]) -> tuple[bytes, list[int]]:
    """The sentencepiece ModelProto of a rank vocabulary, and the rank of each piece index.

    Field numbers are those of sentencepiece's public schema. Pieces stand in rank order; one
    UNKNOWN piece, which no byte string can produce, closes the list because the format asks for it."""
    order = sorted(ranks, key=ranks.__getitem__)
    pieces = [_field(1, _field(1, mapped(t).encode()) + _varint(2 << 3 | 5) + struct.pack("<f", -float(ranks[t]))) for t in order]
    unknown = _field(1, _field(1, "<unk>".encode()) + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _number(3, 2))
    trainer = _field(2, _number(3, 2) + _number(4, len(order) + 1) + _number(40, len(order)))
    normalizer = _field(3, _field(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0))
    return b"".join(pieces) + unknown + trainer + normalizer, [ranks[t] for t in order]


class Codec:
    """Encodes and decodes with a serialised model. One per worker process."""

    def __init__(self, model: bytes, rank_of: list[int], pattern: str):
        import regex
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.rank_of = rank_of
        self.pattern = regex.compile(pattern)
        self.alphabet = [chr(BASE + b) for b in range(256)]
        self.bytes_of: dict[int, bytes] = {}
        self.whole: dict[bytes, int] = {}
        for index, rank in enumerate(rank_of):
            token = bytes(ord(c) - BASE for c in self.sp.id_to_piece(index))
            self.bytes_of[rank] = token
            self.whole[token] = rank
        self.cache: dict[str, tuple[str, int, bytes]] = {}

    def ids(self, pre_token: str) -> list[int]:
        data = pre_token.encode()
        if (one := self.whole.get(data)) is not None:
            return [one]
        return [self.rank_of[i] for i in self.sp.encode("".join([self.alphabet[b] for b in data]))]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])

    def encode(self, text: str) -> list[int]:
        return [i for m in self.pattern.finditer(text) for i in self.ids(m[0])]

    def _known(self, pre_token: str) -> tuple[str, int, bytes]:
        ids = self.ids(pre_token)
        found = ",".join(map(str, ids)), len(ids), self.decode(ids)
        if len(pre_token) <= CACHE_BYTES:
            if len(self.cache) >= CACHE_ENTRIES:
                self.cache.clear()
            self.cache[pre_token] = found
        return found

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the comma-joined ids, SHA-256 of the bytes that the ids decode to.

        Works through the text in slices of pre-tokens, so that memory follows the slice."""
        n, ids, raw, first = 0, hashlib.sha256(), hashlib.sha256(), True
        get, part = self.cache.get, []

        def flush() -> None:
            nonlocal n, first
            got = [get(t) or self._known(t) for t in part]
            ids.update(("" if first else ",").encode() + ",".join([x[0] for x in got]).encode())
            raw.update(b"".join([x[2] for x in got]))
            n += sum([x[1] for x in got])
            first = False
            part.clear()

        if len(text) <= 1 << 20:
            part = self.pattern.findall(text)
        else:
            for m in self.pattern.finditer(text):
                part.append(m[0])
                if len(part) >= 1 << 16:
                    flush()
        if part:
            flush()
        return n, ids.hexdigest(), raw.hexdigest()


_codecs: dict[tuple[str, str], Codec] = {}


def _codec(shipped, digest: str, pattern: str) -> Codec:
    """The worker's codec of a model, told apart by the model's SHA-256; the latest one is kept."""
    key = (digest, pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(*shipped.value, pattern)
    return _codecs[key]


class Tokenizer:
    """A vocabulary on the driver: the serialised model, which is fixed in size, goes to the
    executors as a broadcast."""

    def __init__(self, spark: SparkSession, ranks_path: str, pattern: str):
        self.model, self.rank_of = serialise_model(read_ranks(ranks_path))
        self.pattern = pattern
        self.digest_of_model = hashlib.sha256(self.model).hexdigest()
        self.shipped = spark.sparkContext.broadcast((self.model, self.rank_of))

    def save(self, path: str) -> None:
        """Write the model as a .model file that sentencepiece opens."""
        with open(path, "wb") as f:
            f.write(self.model)

    def encode(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(id, ids array<int>): the ids of every whole text; a null text counts as empty."""
        return self._over(docs, id_col, text_col, f"{id_col} {_type(docs, id_col)}, ids array<int>", lambda codec, text: (codec.encode(text),))

    def digest(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(id, n_tokens, ids_sha256, decoded_sha256) of every whole text.

        One row per input row, repeated rows included; a null text counts as empty (no ids, both
        hashes those of no bytes); an empty table gives an empty result; other columns are unread."""
        return self._over(docs, id_col, text_col, f"{id_col} {_type(docs, id_col)}, n_tokens long, ids_sha256 string, decoded_sha256 string", lambda codec, text: codec.digest(text))

    def _over(self, docs: DataFrame, id_col: str, text_col: str, schema: str, each) -> DataFrame:
        shipped, digest, pattern = self.shipped, self.digest_of_model, self.pattern
        small_batches(docs.sparkSession)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codec, out = _codec(shipped, digest, pattern), None
            for batch in batches:
                names = batch.schema.names
                rows = [each(codec, t or "") for t in batch.column(1).to_pylist()]
                columns = list(zip(*rows)) if rows else []
                if rows:
                    out = [batch.column(0), *(pa.array(c, type=_ARROW[len(columns)][i]) for i, c in enumerate(columns))]
                    yield pa.RecordBatch.from_arrays(out, names=[names[0], *_NAMES[len(columns)]])
            trim()

        return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)

    def decode(self, encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
        """(id, bytes binary): the inverse of encode."""
        shipped, digest, pattern = self.shipped, self.digest_of_model, self.pattern

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codec = _codec(shipped, digest, pattern)
            for batch in batches:
                data = [codec.decode(x or []) for x in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=[batch.schema.names[0], "bytes"])

        return encoded.select(F.col(id_col), F.col(ids_col)).mapInArrow(run, f"{id_col} {_type(encoded, id_col)}, bytes binary")


_NAMES = {1: ["ids"], 3: ["n_tokens", "ids_sha256", "decoded_sha256"]}
_ARROW = {1: [pa.list_(pa.int32())], 3: [pa.int64(), pa.string(), pa.string()]}


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()
