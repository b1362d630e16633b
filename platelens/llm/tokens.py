"""Token counts of a byte-level BPE vocabulary by rank-synchronous array merging.

Texts are cut into pre-tokens; the distinct ones that a task has not met yet become one ragged array of symbols. In each
round every sequence takes its pair of lowest rank and merges all places of it at once (left to right where they
overlap), all sequences in step, until no pair is in the vocabulary; the symbols that survive are the tokens. A token
comes from one merge only, so a pair that a merge creates never ranks below it, and merging all places at once gives what
merging them one by one gives (the vocabulary is checked for this). A pre-token of more than ``LONG_WORD`` bytes (a long text
without a break) would need thousands of rounds over all its symbols; it is merged alone, lowest rank first through a heap.

Strings of added tokens inside a text are one token each, as the vocabulary's own library counts by default. Null counts
as empty: no bytes, no tokens. Long texts are cut between a word and the white space after it, where no pre-token runs
across. Repeated rows are counted each; an empty table gives an empty result; extra columns are not read. The vocabulary
is read by the driver and broadcast; its size is that of the file.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platelens.llm.common import byte_column, pieces, utf8

#: Fixed value: the pre-token pattern of byte-level BPE; white space is the Unicode property.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
CUT = r"(?<=\P{White_Space})(?=\p{White_Space})"
PART = 1 << 20
#: Bytes of a pre-token above which it is merged alone, through a heap.
LONG_WORD = 2048
#: A task forgets the pre-tokens it has met when there are more.
KNOWN = 400_000
NO_RANK = np.iinfo(np.int32).max


@dataclass
class Vocabulary:
    """Symbol of each byte, pairs (left * size + right) in order with their rank and merged symbol, added strings."""

    of_byte: np.ndarray
    size: int
    pairs: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray
    added: list[str]


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level files: itself, or the next free one from 256 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def read_vocabulary(path: str) -> Vocabulary:
    """A byte-level BPE file (.json). Settings that this operator doesn't follow are refused."""
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    model, before = whole["model"], whole["pre_tokenizer"]
    plain = model["type"] == "BPE" and before["type"] == "ByteLevel" and not before["add_prefix_space"] and before.get("use_regex", True)
    odd = whole["normalizer"] or model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges") or model.get("end_of_word_suffix") or model.get("continuing_subword_prefix")
    if not plain or odd or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in whole["added_tokens"]):
        raise ValueError(f"{path}: only plain byte-level BPE is counted")
    vocab, size = model["vocab"], max(model["vocab"].values()) + 1
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    if len({a + b for a, b in merges}) != len(merges):
        raise ValueError(f"{path}: two merges give the same token")
    key = np.array([vocab[a] * size + vocab[b] for a, b in merges], dtype=np.int64)
    order = np.argsort(key)
    of_byte = np.zeros(256, dtype=np.int64)
    for letter, b in byte_letters().items():
        of_byte[b] = vocab[letter]
    merged = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
    return Vocabulary(of_byte, size, key[order], order.astype(np.int32), merged[order], [t["content"] for t in whole["added_tokens"]])


def count_symbols(words: list[bytes], vocab: Vocabulary) -> np.ndarray:
    """Symbols that survive all merges, for each byte sequence."""
    out = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    symbol = vocab.of_byte[np.frombuffer(b"".join(words), dtype=np.uint8)]
    seq = np.repeat(np.arange(len(words)), out)
    while len(symbol) > 1:
        key = symbol[:-1] * vocab.size + symbol[1:]
        at = np.minimum(np.searchsorted(vocab.pairs, key), len(vocab.pairs) - 1)
        rank = np.where((vocab.pairs[at] == key) & (seq[:-1] == seq[1:]), vocab.ranks[at], NO_RANK)
        rank = np.append(rank, NO_RANK)
        starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
        least = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(seq)]))
        take = np.flatnonzero((rank == least) & (rank != NO_RANK))
        if not len(take):
            break
        run = np.flatnonzero(np.r_[True, np.diff(take) != 1])  # neighbours overlap: every second one merges
        place = np.arange(len(take)) - np.repeat(run, np.diff(np.r_[run, len(take)]))
        take = take[place % 2 == 0]
        symbol[take] = vocab.merged[at[take]]
        keep = least != NO_RANK  # sequences without a pair are done
        keep[take + 1] = False
        np.subtract.at(out, seq[take], 1)
        symbol, seq = symbol[keep], seq[keep]
    return out


def count_long(word: bytes, vocab: Vocabulary, ranks: dict[int, tuple[int, int]]) -> int:
    """The same for one long sequence: the lowest pair from a heap, neighbours by links, so that the cost grows with n log n
    and not with the rounds that a long sequence would take. ``ranks``: pair to (rank, merged symbol)."""
    symbol = vocab.of_byte[np.frombuffer(word, dtype=np.uint8)].tolist()
    n, size, get = len(symbol), vocab.size, ranks.get
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(found[0], i) for i in range(n - 1) if (found := get(symbol[i] * size + symbol[i + 1]))]
    heapq.heapify(heap)
    left = n
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i]
        if symbol[i] < 0 or j >= n or (found := get(symbol[i] * size + symbol[j])) is None or found[0] != rank:
            continue  # the pair is gone
        symbol[i], symbol[j] = found[1], -1
        left -= 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if found := get(symbol[i] * size + symbol[k]):
                heapq.heappush(heap, (found[0], i))
        if (h := before[i]) >= 0 and (found := get(symbol[h] * size + symbol[i])):
            heapq.heappush(heap, (found[0], h))
    return left


def parts(text: str, cut: regex.Pattern, size: int = PART) -> Iterator[str]:
    lo = 0
    while len(text) - lo > size and (m := cut.search(text, lo + size)):
        yield text[lo : m.start()]
        lo = m.start()
    yield text[lo:]


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        find, cut = regex.compile(PATTERN).findall, regex.compile(CUT)
        added = regex.compile("|".join(map(regex.escape, sorted(vocab.added, key=len, reverse=True))) or r"(?!)")
        known: dict[str, int] = {}
        ranks: dict[int, tuple[int, int]] = {}
        for batch in pieces(batches, "text"):
            data, at = byte_column(batch.column("text"))
            total = np.zeros(batch.num_rows, dtype=np.int64)
            found: list[tuple[int, list[str]]] = []
            for i in range(batch.num_rows):
                text = data[at[i] : at[i + 1]].tobytes().decode()
                special = added.findall(text)
                total[i] = len(special)
                for segment in added.split(text) if special else [text]:
                    found += ((i, find(part)) for part in parts(segment, cut))
            if len(known) > KNOWN:
                known.clear()
            new = [(w, w.encode()) for w in {w for _, words in found for w in words if w not in known}]
            short = [(w, b) for w, b in new if len(b) <= LONG_WORD]
            if short:
                known.update(zip((w for w, _ in short), count_symbols([b for _, b in short], vocab).tolist(), strict=True))
            if len(short) < len(new):
                if not ranks:
                    ranks.update(zip(vocab.pairs.tolist(), zip(vocab.ranks.tolist(), vocab.merged.tolist(), strict=True), strict=True))
                known.update((w, count_long(b, vocab, ranks)) for w, b in new if len(b) > LONG_WORD)
            for i, words in found:
                total[i] += sum(map(known.__getitem__, words))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(at)), pa.array(total)], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select("doc_id", utf8(F.col("text")).alias("text"))
    found = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
