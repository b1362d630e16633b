"""Packing: ids against the library, plans against the histogram and the plain best fit, results on odd rows."""

import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from platelens.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


ODD = [
    "İstanbul Σίσυφος ΟΔΟΣ", "a\u0301b e\u0301 \u00e9", "<|endoftext|>x <|startoftext|> y<|endoftext|>", "I'll they've 'S x's don't e'll''re", "\u00a0a\u2003b\x85c\x1cd",
    "日本語テキスト", "x" * 5000, "ab" * 3000, "12345 a1b2 ²³½", "\u01c5 ŉ µ ß ẞ Ⱥ", "", "   ", "🙂🙂 a🙂b", "ﬁ Ⅷ ①", "\x00 \x01a\x7f", "ё Ёлка й и\u0306",
]


def test_ids_equal_the_library(library, monkeypatch):
    monkeypatch.setattr(packing, "KNOWN", 50)
    monkeypatch.setattr(packing, "TEXT_BYTES", 300)  # texts are read in parts, words are forgotten
    rng = random.Random(2)
    texts = ODD + [" ".join(rng.choice([*ODD[:6], "the", "House,", "walks.", "42"]) for _ in range(200)) for _ in range(20)]
    with open(PATH, encoding="utf-8") as f:
        encode = packing.Encoder(f.read()).encode
    got = [np.frombuffer(x, dtype="<u4").tolist() for x in encode([t.encode() for t in texts])]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_pair_table():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 5000, 3000)) << 20
    table = packing.PairTable(keys)
    asked = np.r_[keys, rng.integers(0, 5000, 3000) << 20, [-2, 7]]
    assert table.find(asked).tolist() == [int(np.flatnonzero(keys == k)[0]) if k in keys else -1 for k in asked]


def lay(plan, histogram):
    """Every piece at its place: sequences as lists of (offset, length)."""
    out = defaultdict(list)
    for length in np.flatnonzero(histogram):
        sequence, offset = packing.place(plan, np.full(histogram[length], length), np.arange(histogram[length]))
        for s, o in zip(sequence.tolist(), offset.tolist(), strict=True):
            out[s].append((o, int(length)))
    return out


def check_plan(histogram):
    sequences = lay(packing.make_plan(histogram), histogram)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= len(histogram) - 1
    return len(sequences)


def best_fit_one_by_one(histogram):
    capacity = len(histogram) - 1
    rooms = Counter()
    n = 0
    for length in range(capacity, 0, -1):
        for _ in range(histogram[length]):
            fits = [r for r in rooms if r >= length and rooms[r]]
            room = min(fits, default=None)
            if room is None:
                n, room = n + 1, capacity
            else:
                rooms[room] -= 1
            rooms[room - length] += 1
    return n


@pytest.mark.parametrize("seed", range(12))
def test_plans(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.choice([7, 20, 64, 200]))
    lengths = rng.integers(1, rng.integers(2, capacity + 2), rng.integers(0, 3000))
    histogram = np.bincount(lengths[rng.random(len(lengths)) < 0.9], minlength=capacity + 1)
    n, least = check_plan(histogram), -(-int((histogram * np.arange(capacity + 1)).sum()) // capacity)
    plain = best_fit_one_by_one(histogram)
    assert least <= n <= max(plain + 2 + plain // 400, least + 2)


def test_best_fit_equals_one_by_one():
    rng = np.random.default_rng(9)
    for _ in range(30):
        histogram = np.bincount(rng.integers(1, 41, rng.integers(1, 400)), minlength=41)
        assert sum(n for _, n in packing.best_fit(histogram.copy())) == best_fit_one_by_one(histogram)


def test_patterns_are_all_that_fill_a_sequence():
    present = np.zeros(13, dtype=bool)
    present[[1, 3, 4, 5, 8, 12]] = True
    want = {(a, b, c) for a in range(13) for b in range(a + 1) for c in range(b + 1) if a + b + c == 12 and all(x == 0 or present[x] for x in (a, b, c))}
    assert set(map(tuple, packing.full_patterns(present).tolist())) == want


def test_fit_is_a_least_squares_optimum():
    """Kuhn-Tucker conditions of the chosen columns: no pull on repeats above zero, none upwards on those at zero."""
    rng = np.random.default_rng(4)
    histogram = np.bincount(rng.integers(1, 31, 2000), minlength=31)
    cols, x = packing.fitted(histogram, packing.full_patterns(histogram > 0), rounds=40, steps=4000)
    used = np.bincount(cols.ravel(), np.repeat(x, 3), 31) * (np.arange(31) > 0)
    pull = (np.arange(31) / 30 * (histogram - used))[cols].sum(axis=1)
    assert (x >= 0).all() and np.abs(pull[x > 1e-6]).max() < 0.05 and pull.max() < 0.05


def check_rows(rows, docs, library, capacity):
    ids = {}
    for doc, text in docs:
        ids.setdefault(doc, []).append(np.array(library.encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4"))
    want = Counter()
    for doc, lists in ids.items():
        for own in lists:
            want.update((doc, lo // capacity, lo, len(own[lo : lo + capacity]), zlib.crc32(own[lo : lo + capacity].tobytes())) for lo in range(0, len(own), capacity))
    assert Counter(tuple(r)[:5] for r in rows) == want
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1].tolist()] and ends[-1] <= capacity
    return len(held)


@pytest.mark.parametrize("bucket", [packing.BUCKET, 3])
def test_packing_on_odd_rows(spark, library, bucket, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET", bucket)
    monkeypatch.setattr(packing.numbered, "__defaults__", (bucket,))
    docs = [(i, t) for i, t in enumerate(ODD)] + [(None, None), (None, "a b"), (3, None), (3, None)] + [(50 + i % 7, "the house walks") for i in range(60)] + [(99, "word " * 9000)]
    clash = [F.lit("clash").alias(c) for c in ("piece", "length", "number", "offset", "ids", "_b")]
    table = spark.createDataFrame(docs, DOCS).select("*", *clash).repartition(4)
    packed = packing.pack(table, PATH, capacity=64, ids=True)
    rows = packed.collect()
    check_rows(rows, docs, library, 64)
    whole = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    for s, r in whole.items():
        parts = sorted((x.offset, bytes(x.ids)) for x in rows if x.sequence_id == s)
        assert bytes(r.ids) == b"".join(p for _, p in parts) and r.length * 4 == len(r.ids)


def test_packing_of_an_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], DOCS), PATH).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_packing_of_the_documents(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = packing.pack(docs, PATH).collect()
    n = check_rows(rows, [(r.doc_id, r.text) for r in docs.collect()], library, packing.CAPACITY)
    assert n <= -(-sum(r.length for r in rows) // packing.CAPACITY) + 1
