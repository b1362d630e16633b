"""Packing documents into sequences of bounded length by patterns of lengths, fitted by non-negative least squares.

A document is its token ids and one end id; longer than a sequence, it is cut into whole sequences and a rest. How many
pieces there are of each length is all that packing has to know, so it works on that histogram:

1. Patterns: up to three lengths that fill a sequence exactly, all of them.
2. Repeats of each pattern, not negative, so that the lengths used come near the histogram; misses of long pieces weigh
   more, since short ones are easily placed later. The problem has at most ``capacity`` rows; columns are taken in rounds,
   the best one for each longest length by the gradient, and the chosen ones fitted by accelerated projected gradients.
3. Rounding: whole repeats as far as pieces last, then one more each by fraction.
4. What is left is packed best fit, longest first, many equal sequences at once. Full patterns can use up the short
   pieces that the rest would need, so 3 and 4 are done for all of the repeats and for parts of them (``PARTS``), and the
   fewest sequences win.

The result is a plan of runs: "pieces number f and on of length L: t in each sequence from s on, at offset o". Its size
depends on the capacity, not on the documents. On Spark: one pass makes ids, lengths and checksums of pieces; the histogram
is an aggregate; pieces of a length are numbered in buckets of ``BUCKET`` rows or so, a common length in as many as it
needs; the plan is broadcast and looked up. Documents never move with their texts.

Ids are those of the tokenizer file's own library. Texts of plain letters are cut into units (a word, a digit, signs), each
encoded once and remembered, by merging symbol arrays rank by rank; words of other letters, and long units, by the library. Strings of added
tokens are one id each, as by default.

Null counts as empty: one piece that is the end id. Long texts are read in parts. Rows that repeat are packed each. An
empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platelens.functions.sizing import join_bounded
from platelens.llm.common import byte_column, pieces, ranges, stored, utf8
from platelens.llm.tokens import NO_RANK, byte_letters

CAPACITY = 4096
END_ID = 1
#: Pieces of one length that are numbered in one task, or so.
BUCKET = 100_000
#: Units of text that a worker remembers.
KNOWN = 300_000
#: Bytes of text that a task works on at once, and the longest word that is merged by arrays.
TEXT_BYTES, LONG_WORD = 1 << 20, 200
#: Fixed value: how the word-level file cuts normalised text.
CUTS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
#: Characters that normalisation leaves alone but for their case, which is the same everywhere and stays among them.
PLAIN = r"[\x09-\x0D\x20-\x7E¡-įı-ſЀ-џ]+"
WORD_END = "</w>"
ROUNDS, STEPS = 8, 300
PARTS = (1.0, 0.9, 0.7, 0.5)


# --- token ids


def plain_cuts() -> str:
    """``CUTS`` for texts of plain characters: the same classes spelt out, which is found faster."""
    plain = regex.compile(PLAIN)
    known = [c for c in map(chr, range(0x500)) if plain.fullmatch(c)]
    letters, numbers, spaces = ("".join(re.escape(c) for c in known if regex.fullmatch(kind, c)) for kind in (r"\p{L}", r"\p{N}", r"\s"))
    return rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{spaces}{letters}{numbers}]+"


class PairTable:
    """Numbers of distinct keys by open addressing: a look-up is a few reads, for all keys at once."""

    def __init__(self, keys: np.ndarray) -> None:
        bits = max(8, 2 + len(keys).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.numbers = np.full(1 << bits, -1, dtype=np.int64), np.full(1 << bits, -1, dtype=np.int32)
        left, slot = np.arange(len(keys)), self._slots(keys)
        while len(left):
            free = self.keys[slot] == -1
            at, first = np.unique(slot[free], return_index=True)
            chosen = left[free][first]
            self.keys[at], self.numbers[at] = keys[chosen], chosen
            stays = np.ones(len(left), dtype=bool)
            stays[np.flatnonzero(free)[first]] = False
            left, slot = left[stays], (slot[stays] + 1) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for one not known."""
        slot = self._slots(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.numbers[slot], -1)
        on = np.flatnonzero((held != keys) & (held != -1))
        slot = slot[on]
        while len(on):
            slot = (slot + 1) & self.mask
            held = self.keys[slot]
            hit = held == keys[on]
            out[on[hit]] = self.numbers[slot[hit]]
            more = ~hit & (held != -1)
            on, slot = on[more], slot[more]
        return out


class Encoder:
    """Ids (as little-endian 32-bit words) of whole texts for a word-level BPE file."""

    def __init__(self, content: str) -> None:
        from tokenizers import Tokenizer

        whole = json.loads(content)
        model, vocab = whole["model"], whole["model"]["vocab"]
        self.library = Tokenizer.from_str(content)
        self.added = [t["content"] for t in whole["added_tokens"]]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        parts = whole["pre_tokenizer"].get("pretokenizers", [])
        self.arrays = (
            model["type"] == "BPE" and model.get("end_of_word_suffix") == WORD_END and len({a + b for a, b in merges}) == len(merges)
            and not any(model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "byte_fallback"))
            and [n["type"] for n in (whole["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
            and [p["type"] for p in parts] == ["Split", "ByteLevel"] and parts[0]["pattern"].get("Regex", "").replace("[\\p{L}]", "\\p{L}").replace("[\\p{N}]", "\\p{N}") == CUTS
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or any(map(str.isspace, t["content"])) for t in whole["added_tokens"])
        )
        if not self.arrays and any(any(map(str.isspace, t)) for t in self.added):
            raise ValueError("added tokens with white space are not followed")
        if self.arrays:
            self.size = max(vocab.values()) + 1
            key = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], dtype=np.int64)
            self.pairs = PairTable(key)
            self.ranks = np.append(np.arange(len(key), dtype=np.int32), NO_RANK)  # the last one stands for no pair
            self.merged = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
            self.inner, self.last = (np.zeros(256, dtype=np.int64) for _ in range(2))
            for letter, b in byte_letters().items():
                self.inner[b], self.last[b] = vocab[letter], vocab[letter + WORD_END]
        special = "|".join(map(re.escape, self.added)) or r"(?!)"
        self.special, self.plain, self.cut = re.compile(special), re.compile(PLAIN), re.compile(plain_cuts())
        self.known: dict[str, bytes] = {}

    def keys(self, text: str, odd: set[str]) -> list[str]:
        """What ``text`` is made of: units of plain letters, and words (added to ``odd``) that the library has to read."""
        if self.arrays and self.plain.fullmatch(text) and not self.special.search(text):
            return self.cut.findall(text.lower())
        out = []
        for word in WORDS.findall(text):
            if self.arrays and self.plain.fullmatch(word) and not self.special.search(word):
                out += self.cut.findall(word.lower())
            else:
                odd.add(word)
                out.append(word)
        return out

    def learn(self, new: list[str], odd: set[str]) -> None:
        """Remembers the ids of ``new`` units and words."""
        units = [(k, k.encode()) for k in new if k not in odd]
        short = [(k, b) for k, b in units if len(b) <= LONG_WORD]
        if short:
            self.known.update(zip((k for k, _ in short), self.merge([b for _, b in short]), strict=True))
        rest = [k for k in new if k in odd] + [k for k, b in units if len(b) > LONG_WORD]
        if rest:
            for k, e in zip(rest, self.library.encode_batch_fast(rest, add_special_tokens=False), strict=True):
                self.known[k] = np.array(e.ids, dtype="<u4").tobytes()

    def merge(self, units: list[bytes]) -> list[bytes]:
        """Ids of byte sequences: the pair of lowest rank at all its places, in all sequences at once."""
        size = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        raw = np.frombuffer(b"".join(units), dtype=np.uint8)
        symbol, seq = self.inner[raw], np.repeat(np.arange(len(units)), size)
        ends = np.cumsum(size) - 1
        symbol[ends] = self.last[raw[ends]]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            key = symbol[:-1] * self.size + symbol[1:]
            key[seq[:-1] != seq[1:]] = -2
            at = self.pairs.find(key)
            rank = np.append(self.ranks[at], NO_RANK)
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            least = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(seq)]))
            open_ = least != NO_RANK
            done.append((seq[~open_], symbol[~open_]))
            take = np.flatnonzero((rank == least) & open_)
            run = np.flatnonzero(np.r_[True, np.diff(take) != 1]) if len(take) else take
            place = ranges(np.diff(np.r_[run, len(take)]))  # neighbours overlap: every second one merges
            take = take[place % 2 == 0]
            symbol[take] = self.merged[at[take]]
            open_[take + 1] = False
            symbol, seq = symbol[open_], seq[open_]
        of, ids = (np.concatenate([d[k] for d in done]) for k in (0, 1))
        order = np.argsort(of, kind="stable")
        data = ids[order].astype("<u4").tobytes()
        edge = 4 * np.r_[0, np.cumsum(np.bincount(of, minlength=len(units)))]
        return [data[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text; long ones are read in parts, cut at white space."""
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, list[str]]] = []
        odd: set[str] = set()
        size = 0

        def flush() -> None:
            if len(self.known) > KNOWN:
                self.known.clear()
            if new := set(chain.from_iterable(keys for _, keys in held)).difference(self.known):
                self.learn(list(new), odd)
            for i, keys in held:
                out[i].append(b"".join(map(self.known.__getitem__, keys)))
            held.clear()
            odd.clear()

        for i, text in enumerate(texts):
            lo = 0
            while lo < len(text):
                m = SPACE_BYTE.search(text, lo + TEXT_BYTES) if len(text) - lo > TEXT_BYTES else None
                hi = m.start() if m else len(text)
                held.append((i, self.keys(text[lo:hi].decode(), odd)))
                size += hi - lo
                if size >= TEXT_BYTES:
                    flush()
                    size = 0
                lo = hi
        flush()
        return [b"".join(x) for x in out]


SPACE_BYTE = re.compile(rb"[\x20\x09-\x0D]")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_ENCODERS: dict[int, Encoder] = {}


def encoder(content: str) -> Encoder:
    """One for each worker, so that words stay known from task to task."""
    name = hash(content)
    if name not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[name] = Encoder(content)
    return _ENCODERS[name]


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length`` and ``ids_crc32`` of the pieces of every row; with ``ids``, their
    ids too (binary, little-endian 32-bit)."""
    with open(path, encoding="utf-8") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(content.value).encode
        for batch in pieces(batches, "text", TEXT_BYTES):
            data, at = byte_column(batch.column("text"))
            rows, starts, cuts = [], [], []
            whole = data.tobytes()
            for i, body in enumerate(encode([whole[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])):
                raw = body + end
                for lo in range(0, len(raw), 4 * capacity):
                    rows.append(i)
                    starts.append(lo // 4)
                    cuts.append(raw[lo : lo + 4 * capacity])
            start = np.array(starts, dtype=np.int64)
            arrays = [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array((start // capacity).astype(np.int32)), pa.array(start),
                      pa.array([len(c) // 4 for c in cuts], pa.int64()), pa.array(list(map(zlib.crc32, cuts)), pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(cuts, pa.binary())] if ids else arrays, [*names, "ids"] if ids else names)

    rows = docs.select("doc_id", utf8(F.col("text")).alias("text"))
    kind = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"
    return rows.mapInArrow(run, kind + (", ids binary" if ids else ""))


# --- the plan


Pattern = tuple[tuple[int, int], ...]  # (length, times), in the order in which they lie


def full_patterns(present: np.ndarray) -> np.ndarray:
    """Rows (a, b, c), a >= b >= c, of present lengths that sum to the capacity; zeros stand for fewer."""
    capacity = len(present) - 1
    fits = present.copy()
    fits[0] = True
    out = []
    for a in np.flatnonzero(present).tolist():
        rest = capacity - a
        b = np.arange((rest + 1) // 2, min(a, rest) + 1)
        if a < capacity:
            b = b[present[b] & fits[rest - b]]
        out.append(np.column_stack([np.full(len(b), a), b, rest - b]))
    return np.concatenate(out) if out else np.zeros((0, 3), dtype=np.int64)


def fitted(histogram: np.ndarray, patterns: np.ndarray, rounds: int = ROUNDS, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Patterns chosen and their repeats: least squares between the lengths they use and the histogram, none negative."""
    if not len(patterns):
        return patterns, np.zeros(0)
    capacity = len(histogram) - 1
    weight = np.arange(capacity + 1) / capacity
    goal = histogram.astype(np.float64)
    group = np.flatnonzero(np.r_[True, patterns[1:, 0] != patterns[:-1, 0]])
    chosen = np.zeros(0, dtype=np.int64)
    x = np.zeros(0)

    def used(cols: np.ndarray, amount: np.ndarray) -> np.ndarray:
        return np.bincount(cols.ravel(), np.repeat(amount, 3), capacity + 1) * (np.arange(capacity + 1) > 0)

    for _ in range(rounds):
        pull = weight * (goal - used(patterns[chosen], x))
        gain = pull[patterns].sum(axis=1)
        best = np.maximum.reduceat(gain, group)
        top = np.flatnonzero(gain == np.repeat(best, np.diff(np.r_[group, len(gain)])))
        top = top[np.r_[True, patterns[top[1:], 0] != patterns[top[:-1], 0]]]
        fresh = np.setdiff1d(top[gain[top] > 0], chosen)
        if not len(fresh):
            break
        chosen, x = np.r_[chosen, fresh], np.r_[x, np.zeros(len(fresh))]
        cols = patterns[chosen]
        v = np.ones(len(cols))
        for _ in range(12):  # the largest eigenvalue bounds the step
            v /= np.linalg.norm(v)
            v = (weight * used(cols, v))[cols].sum(axis=1)
        step, y, t = 0.95 / np.linalg.norm(v), x.copy(), 1.0
        for _ in range(steps):
            new = np.maximum(0.0, y + step * (weight * (goal - used(cols, y)))[cols].sum(axis=1))
            s = (1 + (1 + 4 * t * t) ** 0.5) / 2
            y, x, t = new + (t - 1) / s * (new - x), new, s
    return patterns[chosen], x


def rounded(histogram: np.ndarray, patterns: np.ndarray, repeats: np.ndarray) -> tuple[list[tuple[Pattern, int]], np.ndarray]:
    """Whole repeats of patterns, as far as pieces last, and the pieces left by length."""
    left = histogram.copy()
    counts: dict[Pattern, int] = {}

    def take(row: np.ndarray, most: int) -> None:
        lengths, times = np.unique(row[row > 0], return_counts=True)
        n = min(most, int((left[lengths] // times).min()))
        if n > 0:
            left[lengths] -= n * times
            own = tuple(zip(lengths[::-1].tolist(), times[::-1].tolist(), strict=True))
            counts[own] = counts.get(own, 0) + n

    whole = np.floor(repeats + 1e-9).astype(np.int64)
    for j in np.argsort(-whole, kind="stable").tolist():
        if whole[j] == 0:
            break
        take(patterns[j], int(whole[j]))
    for j in np.argsort(-(repeats - whole), kind="stable").tolist():
        take(patterns[j], 1)
    return list(counts.items()), left


def best_fit(left: np.ndarray) -> list[tuple[Pattern, int]]:
    """Best fit of the remaining pieces, longest first: each goes where least room is left, equal sequences together."""
    capacity = len(left) - 1
    room: dict[int, list[tuple[Pattern, int]]] = {}
    is_room = np.zeros(capacity + 1, dtype=bool)
    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            fit = np.flatnonzero(is_room[length:])
            space = int(fit[0]) + length if len(fit) else capacity
            pattern, many = room[space].pop() if len(fit) else ((), n)
            if len(fit) and not room[space]:
                is_room[space] = False
            times = min(space // length, n)
            use = min(many, n // times)
            if many > use and pattern:
                room.setdefault(space, []).append((pattern, many - use))
                is_room[space] = True
            rest = space - times * length
            room.setdefault(rest, []).append(((*pattern, (length, times)), use))
            is_room[rest] = rest > 0
            n -= use * times
    return [x for group in room.values() for x in group]


def make_plan(histogram: np.ndarray) -> np.ndarray:
    """Runs (length, first number, pieces in each sequence, first sequence, offset), by length and number."""
    patterns, repeats = fitted(histogram, full_patterns(histogram > 0))
    tried = []
    for part in PARTS if len(patterns) else PARTS[:1]:
        chosen, left = rounded(histogram, patterns, part * repeats)
        tried.append([*chosen, *best_fit(left)])
    packed = min(tried, key=lambda t: sum(n for _, n in t))
    taken = np.zeros(len(histogram), dtype=np.int64)
    runs, sequence = [], 0
    for pattern, n in packed:
        offset = 0
        for length, times in pattern:
            runs.append((length, int(taken[length]), times, sequence, offset))
            taken[length] += n * times
            offset += length * times
        sequence += n
    assert np.array_equal(taken, histogram)
    return np.array(sorted(runs), dtype=np.int64).reshape(-1, 5)


def place(plan: np.ndarray, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of pieces by their length and number."""
    at = np.searchsorted((plan[:, 0] << 44) + plan[:, 1], (length << 44) + number, side="right") - 1
    _, first, times, sequence, offset = plan[at].T
    return sequence + (number - first) // times, offset + length * ((number - first) % times)


# --- on Spark


def numbered(rows: DataFrame, histogram: Sequence[tuple[int, int]], bucket: int = BUCKET) -> DataFrame:
    """``rows`` (stored) with ``number``: gapless from 0 among the pieces of each length."""
    spark = rows.sparkSession
    many = spark.createDataFrame([(n, 1 + c // bucket) for n, c in histogram], "length long, _b long")
    cut = rows.withColumn("_row", F.monotonically_increasing_id()).join(F.broadcast(many), "length")  # a row a length
    cut = cut.withColumn("_bucket", F.pmod(F.xxhash64("_row"), "_b")).drop("_b")
    sizes = cut.groupBy("length", "_bucket").count()
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("length", "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    inside = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("_row"))
    return join_bounded(cut.withColumn("_n", inside), first, ["length", "_bucket"]).withColumn("number", F.col("_first") + F.col("_n") - 1).drop("_bucket", "_first", "_n", "_row")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """The pieces of every row (see ``token_pieces``) with ``sequence_id`` and ``offset``."""
    rows = stored(token_pieces(docs, path, capacity, end_id, ids))
    counts = [(r["length"], r["count"]) for r in rows.groupBy("length").count().collect()]  # ``capacity`` rows at most
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts:
        histogram[length] = n
    plan = rows.sparkSession.sparkContext.broadcast(make_plan(histogram))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = place(plan.value, *(batch.column(c).to_numpy() for c in ("length", "number")))
            kept = [c for c in batch.schema.names if c != "number"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), *map(pa.array, where)], [*kept, "sequence_id", "offset"])

    given = numbered(rows, counts).select(*rows.columns, "number")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return given.mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from ``pack`` with ``ids``: ``sequence_id``, ``ids`` (binary) and ``length``."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))  # ``capacity`` ids at most
    whole = packed.groupBy("sequence_id").agg(F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
    return whole.withColumn("length", (F.octet_length("ids") / 4).cast("long"))
