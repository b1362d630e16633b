"""Random forests of many folds: one tree per task, grown level by level on a bounded training sample.

The sample is the balanced training cells of all folds, at most ``max_rows`` of each class and fold (the first in the seeded
order; a documented option), with every feature as the rank of its value: exact splits up to 65,536 distinct values, else
so many quantiles. It is sent to all tasks once, checked in bytes. A task grows trees of any fold: the open nodes of a
level are split together, by one sort of the rows for each feature tried. There is no depth limit unless one is set;
a node ends when it is pure or its rows cannot be told apart.

Settings are those usual for forests: ``n_estimators``, ``criterion`` (gini, entropy), ``max_depth``, ``min_samples_split``,
``min_samples_leaf``, ``max_features`` (sqrt, log2, a number, a share, None: all), ``bootstrap``; others are an error. A node
tries features in random order until it has tried enough of them and one splits it. Scores are mean class shares of the
leaves; a tree is arrays of nodes in level order, the right child behind the left.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platelens.functions.sizing import join_bounded
from platelens.plans.manyfits import class_cuts, class_sizes, member_table, pack, read_blocks, scan_folds

TREES, MAX_ROWS = 100, 100_000
CODES = 1 << 16
SAMPLE_BYTES, FOREST_BYTES = 1 << 30, 256 << 20
KNOWN = {"n_estimators", "criterion", "max_depth", "min_samples_split", "min_samples_leaf", "max_features", "bootstrap", "balance", "max_rows", "random_state", "n_jobs", "verbose"}


@dataclass
class Tree:
    """Nodes in level order: a split has a feature, a threshold (rows at or below it go left) and its left child; a leaf
    has feature -1. ``counts``: rows of each class (node x class), weighted by draws."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    counts: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row."""
        node = np.zeros(len(x), dtype=np.int64)
        open_ = np.arange(len(x))
        while True:
            own = node[open_]
            f = self.feature[own]
            open_, own, f = open_[f >= 0], own[f >= 0], f[f >= 0]
            if not len(open_):
                return node
            node[open_] = self.left[own] + (x[open_, f] > self.threshold[own])

    def shares(self) -> np.ndarray:
        return self.counts / self.counts.sum(axis=1, keepdims=True)


@dataclass
class Forest:
    """The fitted forest of one fold. ``wrong``: draws that a tree puts in another class than their own, by tree."""

    features: list[str]
    classes: list
    trees: list[Tree]
    importances: np.ndarray
    wrong: list[int]

    def shares(self, x: np.ndarray) -> np.ndarray:
        """Mean class shares (row x class)."""
        total = np.zeros((len(x), len(self.classes)))
        for t in self.trees:
            total += t.shares()[t.leaves(x)]
        return total / len(self.trees)

    def bytes(self) -> int:
        return sum(t.feature.nbytes + t.threshold.nbytes + t.left.nbytes + t.counts.nbytes for t in self.trees)


def features_tried(setting, d: int) -> int:
    """How many features a node tries."""
    if setting is None:
        return d
    if setting == "sqrt":
        return max(1, int(d**0.5))
    if setting == "log2":
        return max(1, int(np.log2(d)))
    return max(1, min(d, int(setting * d) if isinstance(setting, float) else int(setting)))


def impurity(counts: np.ndarray, criterion: str) -> np.ndarray:
    """Impurity times weight of rows of class counts."""
    n = counts.sum(axis=-1)
    if criterion == "entropy":
        with np.errstate(divide="ignore", invalid="ignore"):
            return -np.where(counts > 0, counts * np.log2(counts / n[..., None]), 0.0).sum(axis=-1)
    return n - (counts**2).sum(axis=-1) / np.maximum(n, 1e-300)


def best_splits(node: np.ndarray, code: np.ndarray, y: np.ndarray, w: np.ndarray, nodes: int, k: int, criterion: str, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each node the best split of its rows by one value per row: the fall of impurity (-inf where none splits), and the
    codes on both sides of the cut."""
    order = np.argsort(node * CODES + code, kind="stable")
    node, code, y, w = node[order], code[order], y[order], w[order]
    share = np.zeros((len(node), k))
    share[np.arange(len(node)), y] = w
    left = share.cumsum(axis=0)
    start = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    end = np.r_[start[1:], len(node)] - 1
    own = np.repeat(np.arange(len(start)), end - start + 1)
    before = np.where(start[:, None] > 0, left[start - 1], 0.0)
    left = left - before[own]
    whole = left[end]
    right = whole[own] - left
    ok = np.r_[(node[1:] == node[:-1]) & (code[1:] != code[:-1]), False] & (left.sum(axis=1) >= least) & (right.sum(axis=1) >= least)
    gain = np.where(ok, impurity(whole, criterion)[own] - impurity(left, criterion) - impurity(right, criterion), -np.inf)
    top = np.maximum.reduceat(gain, start)
    at = np.flatnonzero((gain == top[own]) & ok)
    first = np.unique(own[at], return_index=True)[1]
    at = at[first]
    best, below, above = np.full(nodes, -np.inf), np.zeros(nodes, dtype=np.int64), np.zeros(nodes, dtype=np.int64)
    best[node[at]], below[node[at]], above[node[at]] = gain[at], code[at], code[at + 1]
    return best, below, above


def grow(code: np.ndarray, values: Sequence[np.ndarray], y: np.ndarray, k: int, rng: np.random.Generator, options: Mapping) -> tuple[Tree, np.ndarray, int]:
    """A tree on rows of codes, the fall of impurity by feature (in parts of all), and the draws it gets wrong."""
    n, d = code.shape
    criterion, least = options.get("criterion", "gini"), int(options.get("min_samples_leaf", 1))
    deepest, fewest = options.get("max_depth"), int(options.get("min_samples_split", 2))
    tried = features_tried(options.get("max_features", "sqrt"), d)
    w = np.bincount(rng.integers(0, n, n), minlength=n) if options.get("bootstrap", True) else np.ones(n, dtype=np.int64)
    row = np.flatnonzero(w)
    node = np.zeros(len(row), dtype=np.int64)
    feature, threshold, child, counts = [], [], [], []
    falls = np.zeros(d)
    made, depth = 1, 0
    while len(row):
        nodes = int(node.max()) + 1
        own = np.bincount(node * k + y[row], w[row], nodes * k).reshape(nodes, k)
        counts.append(own)
        size = own.sum(axis=1)
        splits = (own.max(axis=1) < size) & (size >= fewest) & (deepest is None or depth < deepest)
        gain, below, above = np.full(nodes, -np.inf), np.zeros(nodes, dtype=np.int64), np.zeros(nodes, dtype=np.int64)
        by = np.full(nodes, -1)
        turn = np.argsort(rng.random((nodes, d)), axis=1)
        for j in range(d):
            want = splits & ((j < tried) | ~np.isfinite(gain))
            at = np.flatnonzero(want[node])
            if not len(at):
                break
            f = turn[node[at], j]
            r = row[at]
            g, b, a = best_splits(node[at], code[r, f].astype(np.int64), y[r], w[r].astype(np.float64), nodes, k, criterion, least)
            better = want & (g > gain)
            gain[better], below[better], above[better], by[better] = g[better], b[better], a[better], turn[better, j]
        split = by >= 0
        rank = np.cumsum(split) - 1
        feature.append(by)
        cut = np.zeros(nodes)
        for f in range(d):
            mine = by == f
            cut[mine] = between(values[f], below[mine], above[mine])
            falls[f] += gain[mine].sum()
        threshold.append(cut)
        child.append(np.where(split, made + 2 * rank, -1))
        made += 2 * int(split.sum())
        go = split[node]
        row, node = row[go], node[go]
        node = 2 * rank[node] + (code[row, by[node]] > below[node])
        depth += 1
    tree = Tree(np.concatenate(feature).astype(np.int32), np.concatenate(threshold), np.concatenate(child).astype(np.int32), np.concatenate(counts))
    leaf = tree.counts[tree.feature < 0]
    return tree, falls / falls.sum() if falls.sum() > 0 else falls, int((leaf.sum(axis=1) - leaf.max(axis=1)).sum())


def between(values: np.ndarray, below: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Thresholds: half-way between two values, or the lower one where a rank stands for a range of values."""
    low, high = values[below], values[above]
    middle = low + (high - low) / 2
    return np.where((middle >= high) | (len(values) == CODES), low, middle)


def ranked(x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Every value as the rank of it (or of the quantile not below it) in its column, and the values of the ranks."""
    code, values = np.empty(x.shape, dtype=np.uint16), []
    for j in range(x.shape[1]):
        known = np.unique(x[:, j])
        if len(known) > CODES:
            known = known[np.linspace(0, len(known) - 1, CODES).astype(np.int64)]
        code[:, j] = np.minimum(np.searchsorted(known, x[:, j]), len(known) - 1)
        values.append(known)
    return code, values


def fit_forests(rows: DataFrame, features: Sequence[str], folds: Sequence[Sequence[str]] | None, options: Mapping | None = None, seed: int = 47) -> list[Forest | str]:
    """The forest of every fold (given by its training lines), or why there is none; see ``manyfits.fit_folds``."""
    options = dict(options or {})
    if unknown := set(options) - KNOWN:
        raise ValueError(f"unknown forest settings {sorted(unknown)}")
    if options.get("max_depth") is not None and int(options["max_depth"]) < 1:
        raise ValueError("max_depth must be at least 1, or unset")
    spark, features = rows.sparkSession, list(features)
    d, m = len(features), 1 if folds is None else len(folds)
    if folds is None:
        rows = rows.withColumn("member", F.lit(bytearray(b"\x80")))
    else:
        table, bound = member_table(spark, folds)
        rows = join_bounded(rows, table, "CellLines", rows=bound)
    labels = rows.agg(F.array_sort(F.collect_set("label"))).first()[0]
    if not labels:
        return ["training rows hold 0 class(es)"] * m
    if "cell_key" not in rows.columns:
        raise ValueError("a forest draws cells by their cell_key; add one")
    packed = pack(rows, features, labels, seed, [0.0] * d, [1.0] * d, m)
    try:
        sizes = class_sizes(packed, len(labels))
        most = int(options.get("max_rows", MAX_ROWS))
        cut = class_cuts(packed, sizes, most) if options.get("balance", "down") == "down" else _own_cuts(packed, sizes, most)
        present = sizes > 0
        farthest = np.where(present, cut, -1).max(axis=0)

        def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for r in (r for batch in batches for r in read_blocks(batch, m)):
                at = np.flatnonzero(r.o <= farthest[r.y])
                if len(at):
                    parts = (r.y[at], r.o[at], r.x[at], np.packbits(r.times[r.pattern[at]] > 0, axis=1))
                    yield pa.RecordBatch.from_arrays([pa.array([len(at)]), *(pa.array([np.ascontiguousarray(p).tobytes()], pa.binary()) for p in parts)], ["n", "y", "o", "x", "bits"])

        chosen = packed.blocks.mapInArrow(sample, "n long, y binary, o binary, x binary, bits binary")
        n = chosen.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if n * d * 10 > SAMPLE_BYTES:
            raise ValueError(f"{n} training cells of {d} features are too many for one task; lower max_rows or set data_loader.training_cells")
        held = chosen.toArrow()  # bounded by max_rows, classes and folds, and checked
    finally:
        packed.blocks.unpersist()
    y, o, x, bits = (np.frombuffer(b"".join(held.column(c).to_pylist()), dtype=t) for c, t in (("y", "<i4"), ("o", "<i8"), ("x", "<f8"), ("bits", np.uint8)))
    x, bits = x.reshape(len(y), d), bits.reshape(len(y), -1)
    order = np.lexsort((*x.T, y, o))  # the same trees however the cells were dealt
    code, values = ranked(x[order])
    shared = spark.sparkContext.broadcast((code, values, y[order].astype(np.int64), o[order], bits[order], present, cut))
    kept = np.flatnonzero(present.sum(axis=1) > 1).tolist()
    trees = int(options.get("n_estimators", TREES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, values, y, o, bits, present, cut = shared.value
        for batch in batches:
            for number in batch.column("id").to_pylist():
                f, t = kept[number // trees], number % trees
                mine = np.flatnonzero((bits[:, f >> 3] >> (7 - (f & 7)) & 1).astype(bool) & (o <= cut[f][y]))
                known = np.cumsum(present[f]) - 1
                tree, falls, wrong = grow(code[mine], values, known[y[mine]], int(present[f].sum()), np.random.default_rng([seed, f, t]), options)
                raw = [pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for v in (tree.feature, tree.threshold, tree.left, tree.counts, falls)]
                yield pa.RecordBatch.from_arrays([pa.array([f], pa.int32()), pa.array([t], pa.int32()), *raw, pa.array([wrong], pa.int64())], ["fold", "tree", *NODES, "falls", "wrong"])

    total = len(kept) * trees
    tasks = max(1, min(total, 4 * spark.sparkContext.defaultParallelism))
    grown = spark.range(0, total, 1, tasks).mapInArrow(run, f"fold int, tree int, {', '.join(f'{c} binary' for c in (*NODES, 'falls'))}, wrong long")
    found: dict[int, list] = {f: [] for f in kept}
    for r in sorted(grown.collect(), key=lambda r: (r["fold"], r["tree"])):  # n_estimators trees of a bounded sample each
        k = int(present[r["fold"]].sum())
        feature, threshold, left, counts, falls = (np.frombuffer(r[c], dtype=t) for c, t in zip((*NODES, "falls"), ("<i4", "<f8", "<i4", "<f8", "<f8"), strict=True))
        found[r["fold"]].append((Tree(feature, threshold, left, counts.reshape(-1, k)), falls, r["wrong"]))
    out: list[Forest | str] = [f"training rows hold {n} class(es)" for n in present.sum(axis=1)]
    for f, own in found.items():
        falls = np.mean([x for _, x, _ in own], axis=0)
        out[f] = Forest(features, [labels[c] for c in np.flatnonzero(present[f])], [t for t, _, _ in own], falls / falls.sum() if falls.sum() > 0 else falls, [w for _, _, w in own])
    return out


ARROW = {"long": pa.int64(), "integer": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}  # of labels
NODES = ("feature", "threshold", "left", "counts")


def _own_cuts(packed, sizes: np.ndarray, most: int) -> np.ndarray:
    """Without balancing: all cells of a class, or its first ``most``."""
    cuts = [class_cuts(packed, np.where(np.arange(sizes.shape[1]) == c, sizes, 0), most)[:, c] for c in range(sizes.shape[1])]
    return np.column_stack(cuts)


def score_forests(rows: DataFrame, models: Sequence[Forest | str], member: str | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """Every row with the class shares ``_p`` of the folds that score it (``manyfits.scan_folds``), null without a model, and
    ``_class``, the label of the largest share (the first of equal ones). Folds whose trees do not fit together
    (``FOREST_BYTES``) are scored in turns."""
    names = list(keep if keep is not None else [c for c in rows.columns if c != member])
    features = next(m.features for m in models if isinstance(m, Forest))
    label = rows.schema["label"].dataType if "label" in rows.columns else T.LongType()
    fields = [T.StructField("_p", T.ArrayType(T.DoubleType())), T.StructField("_class", label)]
    turns: list[list[int]] = [[]]
    size = 0
    for f, m in enumerate(models):
        more = m.bytes() if isinstance(m, Forest) else 0
        if turns[-1] and size + more > FOREST_BYTES:
            turns.append([])
            size = 0
        turns[-1].append(f)
        size += more
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() < cores:  # a small table in few files: walking trees costs more than moving it
        rows = rows.repartition(cores)
    out = None
    for turn in turns:
        shared = rows.sparkSession.sparkContext.broadcast({f: models[f] for f in turn if isinstance(models[f], Forest)})
        part = scan_folds(rows, features, len(models), member, names, fields, _scorer(shared, ARROW[label.typeName()]))
        if len(turns) > 1:
            part = part.filter(F.col("_fold").isin(turn))
        out = part if out is None else out.union(part)
    return out


def _scorer(shared, kind: pa.DataType):
    def make():
        forests = shared.value

        def scorer(x: np.ndarray):
            def score(f: int, at: np.ndarray) -> list[pa.Array]:
                if f not in forests:
                    return [pa.nulls(len(at), pa.list_(pa.float64())), pa.nulls(len(at), kind)]
                p = forests[f].shares(x[at])
                labels = forests[f].classes
                edges = pa.array(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32))
                return [pa.ListArray.from_arrays(edges, pa.array(p.ravel())), pa.array([labels[c] for c in p.argmax(axis=1).tolist()], kind)]

            return score

        return scorer

    return make
