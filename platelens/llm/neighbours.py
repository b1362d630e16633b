"""Approximate nearest neighbours through a hierarchical k-means tree, searched best bin first.

The tree is fitted on the driver on at most ``SAMPLE_VALUES`` numbers of sampled vectors (by hash); every vector then
descends to a leaf. A query walks the tree through a priority queue of nodes by the distance to their centres and takes
leaves in that order. How many leaves it visits is calibrated: for ``PROBES`` sampled queries the true neighbours are
found by brute force over all rows, and the visits are widened until the share of true neighbours inside the visited
leaves reaches ``RECALL``. A query also goes on until its leaves hold enough vectors for all ranks.

Leaves are searched in blocks: a leaf of more than ``BLOCK`` vectors is cut by hash, and so are its queries, so a leaf
that holds a third of all vectors becomes many tasks. Distances are exact, in double precision on the vectors as given.

Vectors that are null, empty, all zero, or hold null or non-finite components take no part, nor do rows without id and
vectors whose length is not the most common one (ties: the shorter). Rows that repeat an id are candidates each; as a
query the least of them counts. Ties go to the smaller id. Fewer candidates than ranks: all of them. An empty table gives
an empty result; extra columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platelens.llm.common import stored

K = 10
SAMPLE_VALUES = 4_000_000
#: Vectors in a leaf for each square root of their number: as many leaves as weigh the walk against the scans.
LEAF = 8
BRANCH = 16
PROBES = 200
RECALL = 0.98
BLOCK = 4096
SEED = 42


@dataclass
class Tree:
    """Nodes with their centre, first child and number of children (0 for a leaf) and number of the leaf."""

    centre: np.ndarray
    child: np.ndarray
    children: np.ndarray
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        """Leaf of each vector: down to the nearest centre at every level."""
        node = np.zeros(len(vectors), dtype=np.int64)
        while len(inner := np.flatnonzero(self.children[node])):
            for at in np.unique(node[inner]).tolist():
                own = inner[node[inner] == at]
                below = slice(self.child[at], self.child[at] + self.children[at])
                node[own] = self.child[at] + nearest(vectors[own], self.centre[below])
        return self.leaf[node]

    def visit(self, query: np.ndarray, leaves: int, sizes: np.ndarray, enough: int) -> list[int]:
        """Leaves best bin first: at least so many, and on until they hold ``enough`` vectors."""
        heap, out, held = [(0.0, 0)], [], 0
        while heap and (len(out) < leaves or held < enough):
            _, at = heapq.heappop(heap)
            if not self.children[at]:
                out.append(int(self.leaf[at]))
                held += int(sizes[self.leaf[at]])
                continue
            below = range(self.child[at], self.child[at] + self.children[at])
            for d, c in zip(((self.centre[below.start : below.stop] - query) ** 2).sum(axis=1).tolist(), below, strict=True):
                heapq.heappush(heap, (d, c))
        return out


def nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * vectors @ centres.T).argmin(axis=1)


def fit_tree(vectors: np.ndarray, leaf: int, branch: int = BRANCH, seed: int = SEED) -> Tree:
    """k-means at every node until a node has at most ``leaf`` vectors or its vectors don't separate."""
    rng = np.random.default_rng(seed)
    centre, child, children, leaves = [vectors.mean(axis=0)], [0], [0], [-1]
    work, count = [(0, np.arange(len(vectors)))], 0
    while work:
        at, own = work.pop(0)
        k = min(branch, -(-len(own) // leaf))
        groups = []
        if k > 1:
            x = vectors[own]
            c = x[rng.choice(len(own), k, replace=False)]
            for _ in range(10):
                label = nearest(x, c)
                c = np.stack([x[label == j].mean(axis=0) if (label == j).any() else x[rng.integers(len(x))] for j in range(k)])
            label = nearest(x, c)
            groups = [(c[j], own[label == j]) for j in range(k) if (label == j).any()]
        if len(groups) < 2:
            leaves[at], count = count, count + 1
            continue
        child[at], children[at] = len(centre), len(groups)
        for c, rows in groups:
            work.append((len(centre), rows))
            centre.append(c)
            child.append(0)
            children.append(0)
            leaves.append(-1)
    return Tree(np.array(centre), np.array(child), np.array(children), np.array(leaves))


def closest(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query the places and distances of its k nearest among ``vectors``, its own id left out."""
    step = max(1, 2_000_000 // max(1, vectors.size))
    for lo in range(0, len(queries), step):
        d = np.sqrt(((vectors[None, :, :] - queries[lo : lo + step, None, :]) ** 2).sum(axis=2))
        d[query_ids[lo : lo + step, None] == ids[None, :]] = np.inf
        for j, row in enumerate(d):
            if len(row) > 4 * k:
                edge = np.partition(row, k - 1)[k - 1]
                near = np.flatnonzero(row <= edge)
            else:
                near = np.arange(len(row))
            near = near[np.isfinite(row[near])]
            near = near[np.lexsort((ids[near], row[near]))][:k]
            yield lo + j, near, row[near]


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def valid_vectors(table: DataFrame) -> tuple[DataFrame, int]:
    """``vec_id`` and ``v`` of the rows that take part, and their length."""
    v = F.col("embedding")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = table.filter(F.col("vec_id").isNotNull() & v.isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    width = common["n"] if common else 0
    return rows.filter(F.size("v") == width), width


def search(table: DataFrame, every: int = 100, k: int = K, recall: float = RECALL) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of the k nearest rows of each row whose id ``every`` divides."""
    spark = table.sparkSession
    rows, width = valid_vectors(table)
    kind = "query_id long, rank int, vec_id long, score double"
    if not width:
        return spark.createDataFrame([], kind)
    total = rows.count()
    sample = max(1, SAMPLE_VALUES // width)
    share = min(1.0, sample / total)
    draw = F.pmod(F.xxhash64("vec_id", "v", F.lit(SEED)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
    fitted = rows.filter(draw).select("v").limit(2 * sample).toArrow()["v"].combine_chunks()  # about ``sample``, never above twice
    if not len(fitted):
        fitted = rows.select("v").limit(1).toArrow()["v"].combine_chunks()
    tree = fit_tree(matrix(fitted, width), max(8, int(LEAF * total**0.5 * len(fitted) / total)))
    shared = spark.sparkContext.broadcast(tree)

    def leaf_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = shared.value.assign(matrix(batch.column("v"), width))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(leaf.astype(np.int32))], ["vec_id", "v", "leaf"])

    v_type = rows.schema["v"].dataType.simpleString()
    placed = stored(rows.mapInArrow(leaf_of, f"vec_id long, v {v_type}, leaf int"))
    sizes = np.zeros(tree.leaves, dtype=np.int64)
    for leaf, n in placed.groupBy("leaf").count().collect():  # one row for each leaf of the tree
        sizes[leaf] = n
    queries = placed.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    visits = calibrate(placed, queries, shared, sizes, width, k, recall)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = matrix(batch.column("v"), width)
            leaves = [shared.value.visit(x, visits, sizes, k + 1) for x in q]
            at = np.repeat(np.arange(len(q)), [len(x) for x in leaves])
            flat = np.concatenate(leaves) if leaves else np.zeros(0)
            part = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("v"), pa.array(flat.astype(np.int32))], ["query_id", "q", "leaf"])

    asked = stored(queries.mapInArrow(walk, f"query_id long, q {v_type}, leaf int"))
    cuts = asked.groupBy("leaf").agg(F.ceil(F.count("leaf") / BLOCK).cast("int").alias("qs"))
    cuts = spark.createDataFrame([(i, int(-(-n // BLOCK))) for i, n in enumerate(sizes.tolist()) if n], "leaf int, vs int").join(cuts, "leaf")
    cuts = F.broadcast(cuts)  # one row for each leaf of the tree
    left = asked.join(cuts, "leaf").withColumn("qb", F.pmod(F.xxhash64("query_id"), F.col("qs")).cast("int")).withColumn("vb", F.explode(F.sequence(F.lit(0), F.col("vs") - 1)))
    right = placed.join(cuts, "leaf").withColumn("vb", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.col("vs")).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("qs") - 1)))

    def block(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(a) and len(b):
            ids = b["vec_id"].to_numpy()
            own = a["query_id"].to_numpy()
            for j, near, d in closest(np.stack(a["q"]).astype(np.float64), own, np.stack(b["v"]).astype(np.float64), ids, k):
                out.append((np.full(len(near), own[j]), ids[near], d))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0)] * 3
        return pd.DataFrame({"query_id": cols[0].astype(np.int64), "vec_id": cols[1].astype(np.int64), "score": cols[2]})

    keys = ["leaf", "vb", "qb"]
    found = left.select(*keys, "query_id", "q").groupBy(*keys).cogroup(right.select(*keys, "vec_id", "v").groupBy(*keys)).applyInPandas(block, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def calibrate(placed: DataFrame, queries: DataFrame, shared, sizes: np.ndarray, width: int, k: int, recall: float) -> int:
    """Leaves to visit so that the probes' true neighbours lie in them to the share ``recall``."""
    probes = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PROBES).toArrow()
    if not probes.num_rows:
        return 1
    own = probes["vec_id"].combine_chunks().to_numpy()
    q = matrix(probes["v"].combine_chunks(), width)

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("vec_id").to_numpy()
            leaf = batch.column("leaf").to_numpy()
            for lo in range(0, len(ids), BLOCK):
                part = slice(lo, lo + BLOCK)
                for j, near, d in closest(q, own, matrix(batch.column("v").slice(lo, BLOCK), width), ids[part], k):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near), j, dtype=np.int32)), pa.array(ids[part][near]), pa.array(d), pa.array(leaf[part][near])], ["probe", "vec_id", "score", "leaf"])

    near = placed.mapInArrow(brute, "probe int, vec_id long, score double, leaf int")
    rank = F.row_number().over(Window.partitionBy("probe").orderBy("score", "vec_id"))
    true = near.withColumn("r", rank).filter(F.col("r") <= k).select("probe", "leaf").collect()  # at most PROBES x k rows
    place = [{leaf: n for n, leaf in enumerate(shared.value.visit(x, len(sizes), sizes, 0))} for x in q]
    needed = sorted(place[p][leaf] + 1 for p, leaf in true)
    return needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))] if needed else 1
