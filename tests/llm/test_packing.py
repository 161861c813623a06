"""Packing: pieces as the tokenizer makes them, sequences without overlap, counts against bounds and exact optima."""

import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from parley.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def optimum(lengths, capacity):
    """Fewest bins, by trying all placements in descending order."""
    order, best = sorted(lengths, reverse=True), [len(lengths)]

    def place(at, bins):
        if len(bins) >= best[0]:
            return
        if at == len(order):
            best[0] = len(bins)
            return
        for room in sorted({b for b in bins if b >= order[at]}):
            i = bins.index(room)
            place(at + 1, bins[:i] + [room - order[at]] + bins[i + 1 :])
        place(at + 1, bins + [capacity - order[at]])

    place(0, [])
    return best[0]


def check_places(rows, capacity):
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_bound_is_below_every_optimum():
    r = random.Random(1)
    for _ in range(150):
        lengths = [r.randint(1, 20) for _ in range(r.randint(1, 9))]
        bound = packing.lower_bound(np.bincount(lengths, minlength=21), 20)
        least = optimum(lengths, 20)
        assert bound <= least + 1e-9
        assert len(packing.best_fit(sorted(lengths, reverse=True), 20)[2]) >= least
    # Where the share of the room says little: three lengths above half need three bins.
    assert packing.lower_bound(np.bincount([11, 11, 11], minlength=21), 20) == pytest.approx(3)
    assert packing.lower_bound(np.bincount([7] * 5, minlength=21), 20) == pytest.approx(2.5)


def test_encoder_equals_the_tokenizer(monkeypatch):
    plain, encoder = Tokenizer.from_file(PATH), packing.Encoder(open(PATH, "rb").read())
    texts = ["", " ", "Hello, World!", "don't'. x'S we'll", "a\tb\x1cc\x85d  e\r\n f", "é é ́x ΑΣ. ΣΑΣ İ ǅ", "<|endoftext|> <|ENDOFTEXT|>x<|startoftext|>", "12.5% foo;:! ?!bar...", "日本語 テキスト", "x" * 3000 + " " + "y." * 50, "퟿ \U0001f600.", "Straße; ÀÉÎ÷Ö× naïve?! año&&& éé'é (ß) foo.### bar'. Ÿ ÿ", "A$$$ b`c` {d} [e]~ f\\"]
    r = random.Random(2)
    texts += ["".join(r.choice(["A", "b", "'", "s", " ", "\n", ".", "!", "7", "é", "<|", "́", "Σ", "ll", "\t"]) for _ in range(60)) for _ in range(300)]
    monkeypatch.setattr(packing, "CACHE_ENTRIES", 50)
    for size in (1 << 20, 16):
        monkeypatch.setattr(packing, "SLICE", size)
        for t in texts:
            assert np.frombuffer(encoder.ids(t), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids


def test_pieces_and_sequences_of_documents(spark):
    r = random.Random(4)
    words = ["river", "Bridge", "light.", "7", "ñandú", "towards,", "x"]
    texts = [" ".join(r.choice(words) for _ in range(r.choice([0, 3, 40, 200, 900]))) for _ in range(120)] + [None, "", "river " * 9000, "x " * 4095, "x " * 4096]
    docs = spark.createDataFrame([(i % 100 if i % 7 else None, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, piece int, offset int")
    packed = packing.pack_documents(spark, docs, PATH)
    rows, plain, want = packed.collect(), Tokenizer.from_file(PATH), []
    for i, t in enumerate(texts):
        ids = plain.encode(t or "", add_special_tokens=False).ids + [1]
        for n, at in enumerate(range(0, len(ids), 4096)):
            want.append((i % 100 if i % 7 else None, n, at, len(ids[at : at + 4096]), zlib.crc32(np.array(ids[at : at + 4096], "<u4").tobytes())))
    assert sorted(map(str, want)) == sorted(str(tuple(x)[:5]) for x in rows)
    used = check_places(rows, 4096)
    found = packing.certificate(packed)
    assert found["sequences"] == used == found["bound"]


def test_blocks_with_gaps_exchange_pieces(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 40)
    monkeypatch.setattr(packing, "FAN_IN", 4)
    r = random.Random(6)
    for lengths in ([r.randint(1, 60) for _ in range(900)], [r.choice([51, 34, 26, 50, 9]) for _ in range(400)], [60] * 90 + [100] * 9, [1] * 250):
        cut = spark.createDataFrame([(i, 0, 0, x, 0) for i, x in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(3)
        packed = packing.pack(cut, 100)
        rows = packed.collect()
        assert sorted(x["length"] for x in rows) == sorted(lengths) and len({x["doc_id"] for x in rows}) == len(lengths)
        found = packing.certificate(packed, 100)
        alone = len(packing.best_fit(sorted(lengths, reverse=True), 100)[2])
        assert found["bound"] <= check_places(rows, 100) == found["sequences"] <= alone + 2, (found, alone)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    packed = packing.pack_documents(spark, docs, PATH)
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and packed.count() == 0
    assert list(itertools.chain(packing.certificate(packed).values())) == [0, 0]
