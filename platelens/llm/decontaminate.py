"""Benchmark decontamination: CGK embeddings of item-sized windows, bit-sampling LSH, exact edit verification.

Words are compared: lower case in A-Z, ASCII punctuation counting as white space; each character of a script without spaces
(Chinese, Japanese, Thai, Lao, Khmer, Burmese) is a word of its own. An item of m words is found in a text
where some stretch of it is at most k = floor((1 - similarity) m) word edits away.

* The CGK walk copies the word under its pointer and moves on or stays by a random bit of (step, word), for 3 m steps.
  Equal walks stay together across edits, so edit distance becomes Hamming distance, and windows are compared by samples
  of ``SAMPLED`` places, ``TABLES`` times for each of ``WALKS`` walks. A pair agreeing in any sample goes on to an exact
  alignment of the item with the window's surroundings, so nothing is reported that is too far.
* Embedded are the windows of item size that can reach the similarity: with k edits, m - k words stay in at most k + 1
  runs, so one run has ceil((m - k) / (k + 1)) words or more. Windows that share no such run with an item of their size
  (at its place, give or take k) cannot match and are passed over; no window that can match is.

The recall of the samples at the edge of the similarity is tested (tests/llm); exact copies are always found.

Items are broadcast in shards of at most ``SHARD_BYTES`` of text, and the documents are read once for each shard. Items
of fewer than five words have no edit to spare: they match where they stand as a whole. Null and empty items match nothing.
Documents that are null, empty or without words match nothing. Repeated rows, items and ids are compared each. An empty
table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platelens.llm.common import byte_column, hash_words, mix, pieces, ranges, split_words, utf8

SIMILARITY = 0.8
WALKS = 4
TABLES = 16
SAMPLED = 2
WALK_WORDS = 150
SHARD_BYTES = 32 << 20
SEED = 42
PLAIN = np.arange(256, dtype=np.uint8)
PLAIN[0x41:0x5B] += 0x20
PLAIN[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = 0x20
PAD = np.uint64(0)
#: Ranges of characters written without spaces between words, all of three bytes in UTF-8.
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF))


def word_ids(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in a row, and the number of each text's first word."""
    plain = PLAIN[data]
    starts, ends, first = split_words(plain, offsets)
    lead = np.flatnonzero((plain[:-2] & 0xF0) == 0xE0) if len(plain) > 2 else np.zeros(0, dtype=np.int64)
    if len(lead):
        a, b, c = (plain[lead + k].astype(np.int32) for k in range(3))
        point = ((a & 0x0F) << 12) | ((b & 0x3F) << 6) | (c & 0x3F)
        alone = lead[np.any([(point >= lo) & (point <= hi) for lo, hi in UNSPACED], axis=0)]
        if len(alone):  # a border before and after each such character
            cuts = np.union1d(alone, alone + 3)
            word = np.searchsorted(starts, cuts, side="right") - 1
            cuts = cuts[(word >= 0) & (cuts < ends[np.maximum(word, 0)])]
            every = np.union1d(starts, cuts)
            ends = np.minimum(np.append(every[1:], len(plain)), ends[np.searchsorted(starts, every, side="right") - 1])
            starts, first = every, np.searchsorted(every, offsets)
    return hash_words(plain, starts, ends), first


def walks_of(size: np.ndarray) -> np.ndarray:
    """Walks that windows of so many words are compared by."""
    return WALKS * -(-size // WALK_WORDS)


def run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` consecutive words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        out += words[k : k + n] * np.uint64(2 * k + 1)
        out = (out << np.uint64(17)) | (out >> np.uint64(47))
    return mix(out)


def walk(words: np.ndarray, start: np.ndarray, end: np.ndarray, steps: int, seed: int) -> np.ndarray:
    """CGK outputs (windows x steps) of words[start:end]; beyond its end a window gives ``PAD``."""
    rng = np.random.default_rng([SEED, seed])
    odd = rng.integers(0, 1 << 63, steps, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((len(start), steps), dtype=np.uint64)
    at = start.copy()
    for j in range(steps):
        inside = at < end
        symbol = np.where(inside, words[np.minimum(at, len(words) - 1)], PAD)
        out[:, j] = symbol
        at += ((symbol * odd[j]) >> np.uint64(63)).astype(np.int64) & inside
    return out


def sample_keys(words: np.ndarray, start: np.ndarray, size: np.ndarray, end: np.ndarray, walks: int) -> np.ndarray:
    """LSH keys (windows x (walks x tables)) of windows of ``size`` words; a window may be cut short by its text's end.

    The places sampled depend on the size alone, and so does the key: only windows and items of one size can agree."""
    out = np.empty((len(start), walks * TABLES), dtype=np.uint64)
    step = max(1, 2_000_000 // (3 * int(size.max(initial=1))))
    share = np.random.default_rng([SEED, 1 << 20]).random((walks, TABLES, SAMPLED))
    for lo in range(0, len(start), step):
        part = slice(lo, lo + step)
        m, rows = size[part], np.arange(len(size[part]))[:, None]
        stop = np.minimum(start[part] + m, end[part])
        for w in range(walks):
            walked = walk(words, start[part], stop, 3 * int(m.max()), w)
            key = np.broadcast_to(mix(m.astype(np.uint64))[:, None] + np.arange(w * TABLES, (w + 1) * TABLES, dtype=np.uint64), (len(m), TABLES))
            for k in range(SAMPLED):
                place = (share[w, :, k][None, :] * (2 * m)[:, None]).astype(np.int64)  # a walk of m words ends after about 2 m steps
                key = mix(key ^ walked[rows, place])
            out[part, w * TABLES : (w + 1) * TABLES] = key
    return out


def edit_distances(item: np.ndarray, item_at: np.ndarray, m: np.ndarray, text: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least number of word edits from each item (item[item_at:item_at + m]) to any stretch inside text[lo:hi]."""
    out = np.empty(len(m), dtype=np.int64)
    if not len(m):
        return out
    width = int((hi - lo).max())
    step = max(1, 500_000 // (width + 1))
    for a in range(0, len(m), step):
        own = slice(a, a + step)
        n = len(m[own])
        col = np.arange(width)
        inside = col[None, :] < (hi - lo)[own][:, None]
        words = np.where(inside, text[np.minimum(lo[own][:, None] + col, len(text) - 1)], PAD)
        row = np.zeros((n, width + 1), dtype=np.int32)
        ramp = np.arange(width + 1, dtype=np.int32)
        for i in range(int(m[own].max())):
            live = i < m[own]
            want = item[np.minimum(item_at[own] + i, len(item) - 1)]
            new = np.empty_like(row)
            new[:, 0] = i + 1
            new[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + ((words != want[:, None]) | ~inside))
            new = np.minimum.accumulate(new - ramp, axis=1) + ramp  # insertions, from left to right
            row[live] = new[live]
        row[:, 1:][~inside] = 1 << 30
        out[own] = row.min(axis=1)
    return out


@dataclass
class Items:
    """One shard of items, ready to be looked up."""

    words: np.ndarray
    first: np.ndarray
    size: np.ndarray
    edits: np.ndarray
    runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    keys: np.ndarray
    key_items: np.ndarray


def index_items(texts: list[str | None], similarity: float) -> Items:
    raw = [(t or "").encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    words, first = word_ids(np.frombuffer(b"".join(raw), dtype=np.uint8), offsets)
    size = np.diff(first)
    edits = np.floor((1 - similarity) * size + 1e-9).astype(np.int64)
    shared = np.minimum(4, -(-(size - edits) // (edits + 1)))
    runs = {}
    for q in np.unique(shared[shared > 0]).tolist():
        own = np.flatnonzero(shared == q)
        n = size[own] - q + 1
        item, place = np.repeat(own, n), ranges(n)
        value = run_hashes(words, q)[first[:-1][item] + place]
        order = np.argsort(value, kind="stable")
        bits = min(26, 5 + int(len(value)).bit_length())
        seen = np.zeros(1 << bits, dtype=bool)
        seen[value >> np.uint64(64 - bits)] = True
        runs[q] = (value[order], item[order], place[order], seen)
    keys, of = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    many = walks_of(size)
    for walks in np.unique(many[shared > 0]).tolist():
        own = np.flatnonzero((many == walks) & (shared > 0))
        keys = np.concatenate([keys, sample_keys(words, first[:-1][own], size[own], first[1:][own], walks).reshape(-1)])
        of = np.concatenate([of, np.repeat(own, walks * TABLES)])
    order = np.argsort(keys, kind="stable")
    return Items(words, first, size, edits, runs, keys[order], of[order])


def find_items(items: Items, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, item, edit distance and place (word of the window's start) of all matches, one for each text and item."""
    window: list[np.ndarray] = []
    for q, (value, item, place, seen) in items.runs.items():
        h = run_hashes(words, q)
        at = np.flatnonzero(seen[h >> np.uint64(64 - int(len(seen)).bit_length() + 1)])
        lo = np.searchsorted(value, h[at])
        n = np.searchsorted(value, h[at], side="right") - lo
        hit = np.repeat(lo, n) + ranges(n)
        at = np.repeat(at, n)
        doc = np.searchsorted(first, at, side="right") - 1
        good = at + q <= first[doc + 1]
        window.append(np.unique(np.column_stack([doc[good], at[good] - place[hit][good], items.size[item[hit][good]]]), axis=0))
    found = np.concatenate(window) if window else np.zeros((0, 3), dtype=np.int64)
    none = np.zeros(0, dtype=np.int64)
    if not len(found):
        return none, none, none, none
    k = np.floor((1 - SIMILARITY) * found[:, 2] + 1e-9).astype(np.int64)
    around = 2 * k + 1
    wide = np.repeat(found, around, axis=0)
    wide[:, 1] += ranges(around) - np.repeat(k, around)
    doc, start, size = np.unique(wide, axis=0).T
    start = np.maximum(start, first[doc])
    good = start < first[doc + 1]
    doc, start, size = np.unique(np.column_stack([doc, start, size])[good], axis=0).T
    out = []
    many = walks_of(size)
    turns = [(own[a : a + step], walks) for walks in np.unique(many).tolist() for own in [np.flatnonzero(many == walks)]
             for step in [max(1, 20_000 * WALKS // walks)] for a in range(0, len(own), step)]
    for at, walks in turns:
        d, s, m = doc[at], start[at], size[at]
        keys = sample_keys(words, s, m, first[d + 1], walks)
        lo = np.searchsorted(items.keys, keys.reshape(-1))
        n = np.searchsorted(items.keys, keys.reshape(-1), side="right") - lo
        item = items.key_items[np.repeat(lo, n) + ranges(n)]
        row = np.repeat(np.repeat(np.arange(len(d)), keys.shape[1]), n)
        same = items.size[item] == m[row]
        pair = np.unique(np.column_stack([d[row], item, s[row]])[same], axis=0)
        if not len(pair):
            continue
        # windows of one item a few words apart are aligned once, over what they cover together
        new = np.r_[True, (pair[1:, 0] != pair[:-1, 0]) | (pair[1:, 1] != pair[:-1, 1]) | (pair[1:, 2] - pair[:-1, 2] > 2 * items.edits[pair[1:, 1]] + 2)]
        head = np.flatnonzero(new)
        tail = np.r_[head[1:], len(pair)] - 1
        pd_, pi, k = pair[head, 0], pair[head, 1], items.edits[pair[head, 1]]
        lo = np.maximum(first[pd_], pair[head, 2] - k)
        hi = np.minimum(first[pd_ + 1], pair[tail, 2] + items.size[pi] + k)
        dist = edit_distances(items.words, items.first[pi], items.size[pi], words, lo, hi)
        ok = dist <= k
        out.append(np.column_stack([pd_[ok], pi[ok], dist[ok], pair[head, 2][ok] - first[pd_[ok]]]))
    all_ = np.concatenate(out) if out else np.zeros((0, 4), dtype=np.int64)
    all_ = all_[np.lexsort((all_[:, 3], all_[:, 2], all_[:, 1], all_[:, 0]))]
    best = np.r_[True, (all_[1:, :2] != all_[:-1, :2]).any(axis=1)] if len(all_) else np.zeros(0, dtype=bool)
    return tuple(all_[best].T)


FOUND = "array<struct<item: int, distance: int, first_word: long>>"


def _search(docs: DataFrame, items: Items, columns: list[str]) -> DataFrame:
    """``_c0`` ... (the named columns) and ``_found``, the matches of each row. Only texts travel to Python."""
    shared = docs.sparkSession.sparkContext.broadcast(items)
    kind = pa.list_(pa.struct([("item", pa.int32()), ("distance", pa.int32()), ("first_word", pa.int64())]))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for whole in batches:
            found: list[list[dict]] = []
            for part in pieces([pa.RecordBatch.from_arrays([whole], ["text"])], "text"):
                base = len(found)
                found += [[] for _ in range(part.num_rows)]
                words, first = word_ids(*byte_column(part.column(0)))
                for d, i, dist, at in zip(*(x.tolist() for x in find_items(shared.value, words, first)), strict=True):
                    found[base + d].append({"item": i, "distance": dist, "first_word": at})
            yield pa.array(found, kind)

    search = F.arrow_udf(run, FOUND).asNondeterministic()
    return docs.select(*(F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(columns)), search(utf8(F.col("text"))).alias("_found"))


def _shards(benchmark: DataFrame, similarity: float) -> Iterator[tuple[list, Items]]:
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = -(-total // SHARD_BYTES)
    for k in range(shards):
        own = benchmark.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == k).select("item_id", "text").orderBy("item_id", "text").collect()
        yield [r[0] for r in own], index_items([r[1] for r in own], similarity)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id``, ``item_id``, ``distance`` (word edits), ``similarity`` and ``first_word`` of every item found in a
    document: the best place for each pair of row and item."""
    out = None
    id_type = benchmark.schema["item_id"].dataType.simpleString()
    for ids, items in _shards(benchmark, SIMILARITY):
        rows = _search(docs, items, ["doc_id"]).select(F.col("_c0").alias("doc_id"), F.inline("_found"))
        known = docs.sparkSession.createDataFrame([(i, x, int(m)) for i, (x, m) in enumerate(zip(ids, items.size, strict=True))], f"item int, item_id {id_type}, m int")
        rows = rows.join(F.broadcast(known), "item")  # as many rows as the shard has items
        part = rows.select("doc_id", "item_id", "distance", (1 - F.col("distance") / F.col("m")).alias("similarity"), "first_word")
        out = part if out is None else out.unionByName(part)
    if out is None:
        kind = docs.schema["doc_id"].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"doc_id {kind}, item_id {id_type}, distance int, similarity double, first_word long")
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold an item."""
    for _, items in _shards(benchmark, SIMILARITY):
        found = _search(docs, items, docs.columns).filter(F.size("_found") == 0)
        docs = found.select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)))
    return docs
