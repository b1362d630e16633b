"""Helpers shared by the text operators: tables, checkpoints, Arrow columns as byte buffers, vectorised words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task works on at once; a single longer text is taken alone.
PIECE_BYTES = 4 << 20
#: ASCII white space: what separates words everywhere in this package.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Without that setting a local master gets one of its own; on a
    cluster it is an error, since executors would not find each other's files."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "/tmp/platelens-checkpoints"
    return folder


def stored(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder: computed once, and it survives lost executors."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def utf8(text: Column) -> Column:
    """Text as bytes for Python tasks; null becomes empty."""
    return F.coalesce(text, F.lit("")).cast("binary")


def words_of(text: Column) -> Column:
    """Array of words, white space being ASCII only."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"))


def byte_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values in a row and the offsets at which each begins, without copying."""
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` holds at most ``limit`` bytes in each part, or one value."""
    for batch in batches:
        _, at = byte_column(batch.column(column))
        lo, n = 0, batch.num_rows
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, side="right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi


def _zobrist() -> np.ndarray:
    """A 64-bit number for each byte at each of 64 places; white space counts nothing."""
    x = np.arange(1, 64 * 256 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    table = mix(x).reshape(64, 256)
    table[:, SPACE] = 0
    return table.reshape(-1)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


_TABLE: list[np.ndarray] = []


def split_words(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word in ``data``, and for each text of ``offsets`` the number of its first word
    (one entry more than there are texts). ``between``: which bytes separate words."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(offsets), dtype=np.int64)
    solid = ~between[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:n]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:n]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a sum of random numbers by byte and place, finished with its length."""
    return hash_prefixes(data, starts, ends, [None])[0]


def hash_prefixes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, sizes: list[int | None]) -> list[np.ndarray]:
    """The hash of each word's first bytes, for each number of bytes (None: the whole word)."""
    out = [np.empty(len(starts), dtype=np.uint64) for _ in sizes]
    if len(starts) == 0:
        return out
    if not _TABLE:
        _TABLE.append(_zobrist())
    table = _TABLE[0]
    step = 200_000
    for lo in range(0, len(starts), step):
        hi = min(len(starts), lo + step)
        a, b = int(starts[lo]), int(ends[hi - 1])
        own = starts[lo:hi] - a
        place = np.arange(b - a, dtype=np.int64) - np.repeat(own, np.diff(np.append(own, b - a)))
        value = table[((place & 63) << 8) | data[a:b]]
        if (far := place > 63).any():
            value[far] *= (2 * (place[far] >> 6) + 1).astype(np.uint64)
        total = np.zeros(b - a + 1, dtype=np.uint64)
        np.cumsum(value, out=total[1:])
        for x, n in zip(out, sizes, strict=True):
            stop = ends[lo:hi] - a if n is None else np.minimum(own + n, ends[lo:hi] - a)
            x[lo:hi] = total[stop] - total[own] + (stop - own).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return [mix(x) for x in out]


class Known:
    """A set of hashes to look others up in: a table of bits settles most of them."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = np.unique(hashes)
        self.shift = np.uint64(64 - min(26, 8 + len(self.hashes).bit_length()))
        self.bits = np.zeros(1 << (64 - int(self.shift)), dtype=bool)
        self.bits[self.hashes >> self.shift] = True

    def holds(self, h: np.ndarray) -> np.ndarray:
        out = self.bits[h >> self.shift]
        at = np.flatnonzero(out)
        if len(at):
            place = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
            out[at] = self.hashes[place] == h[at]
        return out


def ranges(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, one after another."""
    total = int(counts.sum())
    return np.arange(total, dtype=np.int64) - np.repeat(np.cumsum(counts) - counts, counts)


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index that each of n nodes reaches over the links a-b."""
    root = np.arange(n, dtype=np.int64)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while not np.array_equal(root, jumped := root[root]):
            root = jumped
        if np.array_equal(before, root):
            break
        keep = root[a] != root[b]
        a, b = a[keep], b[keep]
    return root
