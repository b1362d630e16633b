"""Near copies by SimHash: fingerprints of word shingles, linked through BK-trees over shards of fingerprints.

Two fingerprints are linked when at most ``radius`` bits differ. A tree over all fingerprints would have to be searched
by all of them, so trees are built per shard: a shard holds the fingerprints that agree on a set of bits.

The bits still free are cut into ``radius + 1`` blocks; two fingerprints within the radius agree on one block at least
(pigeonhole), so no link is lost. A shard above ``SHARD`` fingerprints is cut again in the same way, down to a single
fingerprint, so no task holds an unbounded shard and no pair is skipped.

Distinct fingerprints only take part, so exact copies cost one. A shard gives back a spanning forest of its links, never
all pairs; components come from ``graph.components``. The trees are not broadcast: all trees together grow with the
input, so each goes to the one task that holds its shard's queries.

Fingerprint: a bit is 1 when it is set in over half of the hashes of the shingles, repeats included. Texts are
lower-cased in A-Z. Fewer words than a shingle: the whole sequence is one; none (null, empty or white space): zero, and
linked like any other. Rows that repeat, ties and null ids keep their row; a null id is nobody's smallest id, so
``component_id`` is null only where all ids reachable are null. An empty table gives an empty result. Extra columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platelens.functions.sizing import join_bounded
from platelens.llm.common import byte_column, local_roots, pieces, ranges, stored, utf8
from platelens.llm.graph import components

SEED = 42
#: Most fingerprints in one BK-tree.
SHARD = 4096
#: Words taken at once from a text; longer texts are hashed part by part.
PART = 1 << 18
LOW_BITS = np.uint64(0x0101010101010101)
FULL = (1 << 64) - 1


def shingle_hashes(words: list[bytes], size: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of every shingle, in parts of bounded size."""
    if 0 < len(words) <= size:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], dtype=np.uint64)
        return
    for lo in range(0, max(0, len(words) - size + 1), PART):
        part = words[lo : lo + PART + size - 1]
        joined = map(b" ".join, zip(*(part[k:] for k in range(size)), strict=False))
        raw = b"".join(map(xxhash.xxh64_digest, joined, repeat(seed)))
        yield np.frombuffer(raw, dtype=">u8").astype(np.uint64)


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per group of ``counts`` consecutive hashes: the bits set in over half of them; zero for an empty group.

    Bits are counted eight lanes at a time inside blocks of at most 255 hashes, which a byte lane can hold."""
    out = np.zeros(len(counts), dtype=np.uint64)
    full = np.flatnonzero(counts)
    if len(full) == 0:
        return out
    size = counts[full]
    blocks = -(-size // 255)
    begin = np.cumsum(size) - size
    at = np.repeat(begin, blocks) + 255 * ranges(blocks)
    of_group = np.cumsum(blocks) - blocks
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & LOW_BITS, at).view(np.uint8).reshape(-1, 8).astype(np.int64)
        total = np.add.reduceat(lanes, of_group, axis=0)
        for byte in range(8):
            out[full] |= (2 * total[:, byte] > size).astype(np.uint64) << np.uint64(8 * byte + bit)
    return out


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 4, lanes: int = 1,
                 carry: Sequence[str] = ()) -> DataFrame:
    """``id``, the columns named in ``carry``, and ``c0`` ... (one long for each 64 bits; lane k is seeded with 42 + k)
    for every row."""
    kept = ["id", *carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            data, at = byte_column(batch.column("text"))
            raw = data.tobytes().lower()
            hashes: list[list[np.ndarray]] = [[] for _ in range(lanes)]
            counts = np.zeros(batch.num_rows, dtype=np.int64)
            for i in range(batch.num_rows):
                split = raw[at[i] : at[i + 1]].split()
                counts[i] = max(len(split) - words + 1, 1) if split else 0
                for k in range(lanes):
                    hashes[k] += shingle_hashes(split, words, SEED + k)
            none = [np.zeros(0, dtype=np.uint64)]
            codes = [majority(np.concatenate(h or none), counts).view(np.int64) for h in hashes]
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), *map(pa.array, codes)], [*kept, *(f"c{k}" for k in range(lanes))])

    rows = docs.select(F.col(id_column).alias("id"), *carry, utf8(F.col(text_column)).alias("text"))
    return rows.mapInArrow(run, ", ".join([*(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept), *(f"c{k} long" for k in range(lanes))]))


def build_trees(codes: np.ndarray, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """BK-trees of all shards at once (codes sorted by shard, distinct in each): the root of each code's shard, and the
    children as (parent * 512 + distance to the parent) in order, with the child itself.

    Level by level, the first code at each distance from a node becomes its child and the others move below it."""
    root = np.repeat(starts := np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]), np.diff(np.r_[starts, len(shard)]))
    left = np.flatnonzero(root != np.arange(len(codes)))
    above = root[left]
    keys, nodes = [], []
    while len(left):
        key = above * 512 + distance(codes[left], codes[above])
        order = np.argsort(key, kind="stable")
        left, key = left[order], key[order]
        new = np.r_[True, key[1:] != key[:-1]]
        keys.append(key[new])
        nodes.append(left[new])
        above = np.repeat(left[new], np.diff(np.r_[np.flatnonzero(new), len(left)]))[~new]
        left = left[~new]
    key = np.concatenate(keys) if keys else np.zeros(0, dtype=np.int64)
    node = np.concatenate(nodes) if nodes else key
    order = np.argsort(key, kind="stable")
    return root, key[order], node[order]


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


def search_trees(codes: np.ndarray, root: np.ndarray, key: np.ndarray, node: np.ndarray, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (query, code) within the radius; from a node at distance d only edges d - radius ... d + radius are followed."""
    q, at = queries, root[queries]
    found_q, found_c = [], []
    while len(q):
        d = distance(codes[q], codes[at])
        hit = (d <= radius) & (q != at)
        found_q.append(q[hit])
        found_c.append(at[hit])
        lo = np.searchsorted(key, at * 512 + np.maximum(d - radius, 0))
        n = np.searchsorted(key, at * 512 + np.minimum(d + radius, 511), side="right") - lo
        at = node[np.repeat(lo, n) + ranges(n)]
        q = np.repeat(q, n)
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate(found_q or [none]), np.concatenate(found_c or [none])


def shard_links(codes: np.ndarray, shard: np.ndarray, radius: int) -> np.ndarray:
    """For each code the smallest index of those it reaches in its shard."""
    root, key, node = build_trees(codes, shard)
    sizes = np.bincount(root, minlength=len(codes))[root]
    label = np.arange(len(codes))
    cost, lo = np.cumsum(sizes), 0
    while lo < len(codes):  # as many queries at once as keep the frontier below a million or so
        hi = max(lo + 1, int(np.searchsorted(cost, (cost[lo - 1] if lo else 0) + 1_000_000, side="right")))
        a, b = search_trees(codes, root, key, node, np.arange(lo, hi), radius)
        label = local_roots(len(codes), np.r_[np.arange(len(codes)), a], np.r_[label, b])
        lo = hi
    return label


def block_masks(free: int, blocks: int) -> list[int]:
    """The set bits of ``free`` cut into so many blocks of nearly equal size."""
    places = [b for b in range(64) if free >> b & 1]
    return [sum(1 << b for b in part) for k in range(blocks) if (part := places[len(places) * k // blocks : len(places) * (k + 1) // blocks])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _shard_key(path: Column, masks: list[int]) -> Column:
    return F.xxhash64(path, *(F.col(f"c{k}").bitwiseAND(F.lit(_signed(m))) for k, m in enumerate(masks)))


def near_links(codes: DataFrame, radius: int, lanes: int = 1, shard: int = SHARD) -> DataFrame:
    """Links ``a``, ``b`` between rows of ``codes`` (``node`` long, unique; ``c0`` ... distinct) that connect all rows
    within ``radius`` bits of each other; shards are cut by the bits of ``c0``."""
    names = [f"c{k}" for k in range(lanes)]
    out = None
    masks: dict[int, int] = {0: 0}  # bits fixed so far, by table
    work = codes.select("node", *names, F.lit(0).alias("t"), F.lit(0).cast("long").alias("shard"))
    while True:
        new: dict[int, int] = {}
        cuts = []
        for t, m in masks.items():
            for block in block_masks(FULL & ~m, radius + 1):
                new[len(new)] = m | block
                cuts.append((t, F.struct(F.lit(len(new) - 1).alias("t"), _shard_key(F.lit(len(new) - 1), [m | block]).alias("shard"))))
        masks = new
        if not cuts:
            break
        by_table = [F.when(F.col("t") == t, F.array(*(s for u, s in cuts if u == t))) for t in dict.fromkeys(t for t, _ in cuts)]
        parts = F.coalesce(*by_table)
        cut = stored(work.select("node", *names, F.explode(parts).alias("p")).select("node", *names, "p.t", "p.shard"))
        sizes = cut.groupBy("shard").count()
        large = stored(sizes.filter(F.col("count") > shard).select("shard"))
        more = not large.isEmpty()
        small = cut.join(large, "shard", "left_anti") if more else cut
        found = _tree_links(small, names, radius)
        out = found if out is None else out.union(found)
        if not more:
            break
        work = cut.join(large, "shard", "left_semi")
    return out


def _tree_links(cut: DataFrame, names: list[str], radius: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rows = 0

        def links(block: np.ndarray) -> pa.RecordBatch:
            label = shard_links(block[:, 2:].view(np.uint64), block[:, 0], radius)
            own = np.flatnonzero(label != np.arange(len(block)))
            return pa.RecordBatch.from_arrays([pa.array(block[own, 1]), pa.array(block[label[own], 1])], ["a", "b"])

        for batch in batches:
            held.append(np.column_stack([batch.column(n).to_numpy(zero_copy_only=False) for n in ("shard", "node", *names)]))
            rows += batch.num_rows
            if rows < 50_000:
                continue
            block = np.concatenate(held)
            whole = int(np.searchsorted(block[:, 0], block[-1, 0]))  # the last shard may go on
            if whole:
                yield links(np.ascontiguousarray(block[:whole]))
            held, rows = [block[whole:]], len(block) - whole
        if rows:
            yield links(np.ascontiguousarray(np.concatenate(held)))

    alone = cut.select("shard", "node", *names).repartition("shard").sortWithinPartitions("shard", "node")
    return alone.mapInArrow(run, "a long, b long")


def near_components(prints: DataFrame, radius: int, lanes: int = 1) -> DataFrame:
    """The columns of ``fingerprints`` and ``component_id`` for every row of it."""
    names = [f"c{k}" for k in range(lanes)]
    node = F.col("c0") if lanes == 1 else F.xxhash64(*names)
    rows = stored(prints.withColumn("node", node))
    distinct = stored(rows.groupBy("node").agg(F.min("id").alias("least"), *(F.first(c).alias(c) for c in names)))
    roots = components(stored(near_links(distinct.select("node", *names), radius, lanes)))
    of_node = distinct.select("node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    linked = of_node.join(of_node.groupBy("root").agg(F.min("least").alias("component_id")), "root")
    return rows.join(linked.select("node", "component_id"), "node").select(*prints.columns, "component_id")


def simhash_components(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hexadecimal digits) and ``component_id`` for every row of ``docs``."""
    found = near_components(fingerprints(docs, words=words), radius)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("c0"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """``docs`` with the document of smallest id from each component; a row without id stays.

    A document is its id and its text: rows that repeat the kept one all stay, and one with the same id but another text
    is judged by its own text. Only ids and hashes of the rows that go are joined, broadcast when they are few."""
    hashed = F.xxhash64(F.coalesce("text", F.lit("")))
    found = near_components(fingerprints(docs.select("doc_id", "text", hashed.alias("of")), words=words, carry=["of"]), radius)
    gone = stored(found.filter("id <> component_id").select(F.col("id").alias("_gone_id"), F.col("of").alias("_gone_text")).distinct())
    return join_bounded(docs, gone, (docs["doc_id"] == F.col("_gone_id")) & (hashed == F.col("_gone_text")), "left_anti")
