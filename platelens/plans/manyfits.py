"""Logistic models of many folds at once: every pass over the cells serves all folds.

Training cells are packed and kept once, each with the bits of the folds that train on its line (a fold membership
joined as a table of lines). Then each of these is one pass over the packed cells, whatever the number of folds:

* balancing: the cut of each fold and class in the seeded order of cells, by counting digits of the order from the left
  until the cut is exact (two or three passes; the digest has four digits of ``DIGIT`` bits);
* scaling: counts, sums and squares per fold and class;
* one Newton step of all folds that have not converged: loss, gradient and Hessian of each.

A task adds up its cells with matrix products and hands on one array per fold. Arrays are added while they stream past in
order, some tasks at a time first, so no task holds more than a few of them; the Newton step of a fold is solved where its
array ends, and only coefficients come to the driver. Folds that do not fit together (``NUMBERS`` of one task) take turns.

The objective of a fold is the summed loss plus |coefficients|^2 / 2C (intercepts are free), classes weighted equally by
cells (``down``: as many cells of each class as the smallest has; else weights), features centred and scaled by
equally weighted classes. A step that does not lower the objective is halved.

Cells must have all features: null or NaN is an error, as it is for a vector assembler.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platelens.functions.hashing import hash_number, hash_order
from platelens.functions.sizing import join_bounded
from platelens.operators.features import quoted

#: Numbers that a task adds up at once over all folds; more folds take turns.
NUMBERS = 8_000_000
DIGIT, DIGITS = 13, 4  # the order of cells is a 52-bit number
TREE = 32  # arrays that are added first
CONSTANT = 1e-7  # a feature whose deviation in a fold is below this part of its whole deviation does not vary there
COEFFICIENT_BYTES = 256 << 20


class TooFewClasses(ValueError):
    """A training set without two classes; fold runners report the lines of such folds without scores."""


@dataclass
class FoldModel:
    """One fitted fold: ``coef`` (class x feature) and ``intercept`` on scaled features."""

    features: list[str]
    classes: list[int]
    centre: list[float]
    spread: list[float]
    coef: np.ndarray
    intercept: np.ndarray
    gradient: float
    steps: int

    def plain(self) -> tuple[np.ndarray, np.ndarray]:
        """Coefficients and intercepts in the units of the features."""
        raw = self.coef / np.array(self.spread)
        return raw, self.intercept - raw @ np.array(self.centre)


@dataclass
class _State:
    """What a pass has to know of the folds, by number."""

    labels: list
    present: np.ndarray  # fold x label
    cut: np.ndarray | None = None  # fold x label: cells up to this place in the order take part
    weight: np.ndarray | None = None
    centre: np.ndarray | None = None
    spread: np.ndarray | None = None
    theta: list[np.ndarray] = field(default_factory=list)  # per fold: class x (features, intercept)

    def classes(self, f: int) -> np.ndarray:
        return np.flatnonzero(self.present[f])


# --- passes


@dataclass
class Rows:
    """A block of training cells: number of the label, place in the seeded order, features, copies; and the folds of the line
    of each, by number of a pattern (pattern x fold: how often the fold names the line)."""

    y: np.ndarray
    o: np.ndarray
    x: np.ndarray
    copies: np.ndarray
    pattern: np.ndarray
    times: np.ndarray

    def of(self, f: int) -> np.ndarray:
        """How often a fold names the line of each cell."""
        return self.times[self.pattern, f]


BLOCK = "n int, y binary, o binary, x binary, copies binary, pattern binary, known binary"


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of cells as blocks of arrays, so that later passes read a few long values."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        x = batch.column("x").flatten().to_numpy(zero_copy_only=False)
        if not np.isfinite(x).all():
            raise ValueError("a training cell lacks a feature")
        patterns = batch.column("member").dictionary_encode()
        parts = [batch.column("y").to_numpy(zero_copy_only=False).astype("<i4"), batch.column("o").to_numpy(), x, batch.column("copies").to_numpy(),
                 patterns.indices.to_numpy().astype("<i4")]
        known = patterns.dictionary.to_pylist()
        raw = [np.ascontiguousarray(p).tobytes() for p in parts] + [b"".join(known)]
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), *(pa.array([r], pa.binary()) for r in raw)], [c.split()[0] for c in BLOCK.split(", ")])


def read_blocks(batch: pa.RecordBatch, folds: int) -> Iterator[Rows]:
    for i in range(batch.num_rows):
        n = batch.column("n")[i].as_py()
        y, o, x, copies, pattern, known = (np.frombuffer(batch.column(c)[i].as_buffer(), dtype=t)
                                           for c, t in (("y", "<i4"), ("o", "<i8"), ("x", "<f8"), ("copies", "<f8"), ("pattern", "<i4"), ("known", np.uint8)))
        raw = known.reshape(int(pattern.max()) + 1, -1)
        times = raw.view("<u2") if raw.shape[1] > (folds + 7) // 8 else np.unpackbits(raw, axis=1, count=folds)
        yield Rows(y, o, x.reshape(n, -1), copies, pattern, times)


@dataclass
class Packed:
    """Blocks of training cells, kept, with the number of folds that have bits in them and of their partitions."""

    blocks: DataFrame
    folds: int
    parts: int


def fold_sums(packed: Packed, folds: Sequence[int], width: int, part: Callable[[Rows, int], np.ndarray | None],
              finish: Callable[[int, np.ndarray], np.ndarray] = lambda f, v: v) -> dict[int, np.ndarray]:
    """``part`` of every batch and fold added up, and ``finish`` of each sum, made where it ends, for the folds wanted now.
    ``width``: numbers in one part."""
    out: dict[int, np.ndarray] = {}
    many = max(1, NUMBERS // max(1, width))
    for lo in range(0, len(folds), many):
        out |= _one_turn(packed, list(folds[lo : lo + many]), part, finish)
    return out


def _one_turn(packed, folds, part, finish) -> dict[int, np.ndarray]:
    total = packed.folds

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for rows in (r for batch in batches for r in read_blocks(batch, total)):
            for f in folds:
                if rows.times[:, f].any() and (v := part(rows, f)) is not None:
                    sums[f] = sums[f] + v if f in sums else v
        if sums:
            yield _arrays(sums)

    def added(batches: Iterator[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch]:
        current, sum_ = None, np.zeros(0)
        for batch in batches:
            for f, raw in zip(batch.column("fold").to_pylist(), batch.column("v"), strict=True):
                v = np.frombuffer(raw.as_buffer(), dtype=np.float64)
                if f == current:
                    sum_ += v
                    continue
                if current is not None:
                    yield _arrays({current: finish(current, sum_) if last else sum_})
                current, sum_ = f, v.copy()
        if current is not None:
            yield _arrays({current: finish(current, sum_) if last else sum_})

    schema = "fold int, v binary"
    sums = packed.blocks.mapInArrow(task, schema)
    if packed.parts > TREE:
        sums = sums.withColumn("g", F.pmod(F.spark_partition_id(), F.lit(TREE))).repartition("fold", "g").sortWithinPartitions("fold")
        sums = sums.drop("g").mapInArrow(lambda b: added(b, False), schema)
    sums = sums.repartition("fold").sortWithinPartitions("fold").mapInArrow(lambda b: added(b, True), schema)
    return {r["fold"]: np.frombuffer(r["v"], dtype=np.float64) for r in sums.collect()}  # ``finish`` keeps them small


def _arrays(sums: Mapping[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(sums), pa.int32()), pa.array([np.ascontiguousarray(v, dtype=np.float64).tobytes() for v in sums.values()], pa.binary())], ["fold", "v"])


def _chosen(rows: Rows, f: int, s: _State) -> np.ndarray:
    """Cells of a fold's training set."""
    keep = rows.of(f) > 0
    if s.cut is not None:
        keep = keep & (rows.o <= s.cut[f][rows.y])
    return np.flatnonzero(keep)


# --- balancing and scaling


def class_sizes(packed: Packed, labels: int) -> np.ndarray:
    def part(rows: Rows, f: int) -> np.ndarray:
        return np.bincount(rows.y, rows.of(f) * rows.copies, labels)

    m = packed.folds
    found = fold_sums(packed, range(m), labels, part)
    return np.array([found.get(f, np.zeros(labels)) for f in range(m)]).reshape(m, labels).round().astype(np.int64)


def class_cuts(packed: Packed, sizes: np.ndarray, most: int | None = None) -> np.ndarray:
    """For each fold and class the place in the order up to which as many cells lie as the fold's smallest class has, or
    ``most`` if that is less."""
    m, labels = sizes.shape
    base = 1 << DIGIT
    wanted = np.where(sizes > 0, np.array([row[row > 0].min() if (row > 0).any() else 0 for row in sizes])[:, None], 0)
    if most is not None:
        wanted = np.minimum(wanted, most)
    cut = np.full((m, labels), np.int64(1) << (DIGIT * DIGITS))
    prefix = np.zeros((m, labels), dtype=np.int64)
    left = wanted.copy()
    open_ = wanted < sizes
    for level in range(DIGITS):
        shift = DIGIT * (DIGITS - 1 - level)
        now, goal, done = open_.copy(), left.copy(), prefix.copy()

        def part(rows: Rows, f: int, now=now, done=done, shift=shift) -> np.ndarray | None:
            y, o = rows.y, rows.o
            keep = (rows.of(f) > 0) & now[f][y]
            keep[keep] = (o[keep] >> (shift + DIGIT)) == done[f][y[keep]]
            at = np.flatnonzero(keep)
            return np.bincount(y[at] * base + ((o[at] >> shift) & (base - 1)), minlength=labels * base).astype(np.float64) if len(at) else None

        def finish(f: int, v: np.ndarray, now=now, goal=goal) -> np.ndarray:
            """By class: the digit in which the cut lies, the cells before it, and those in it."""
            counts = v.reshape(labels, base)
            ends = counts.cumsum(axis=1)
            digit = np.minimum((ends < goal[f][:, None]).sum(axis=1), base - 1)
            own = counts[np.arange(labels), digit]
            return np.concatenate([digit, ends[np.arange(labels), digit] - own, own])

        found = fold_sums(packed, np.flatnonzero(now.any(axis=1)).tolist(), labels * base, part, finish)
        for f, v in found.items():
            digit, before, own = (x.astype(np.int64) for x in v.reshape(3, labels))
            for c in np.flatnonzero(now[f]):
                prefix[f, c] = (prefix[f, c] << DIGIT) + digit[c]
                left[f, c] -= before[c]
                if left[f, c] == own[c] or level == DIGITS - 1:  # all cells of this digit are in
                    cut[f, c] = ((prefix[f, c] + 1) << shift) - 1
                    open_[f, c] = False
        if not open_.any():
            break
    return cut


def _scaling(packed: Packed, s: _State, folds: Sequence[int], d: int) -> None:
    """Sets weights, centres and spreads."""
    m, labels = s.present.shape

    def part(rows: Rows, f: int) -> np.ndarray | None:
        at = _chosen(rows, f, s)
        if not len(at):
            return None
        y, x = rows.y[at], rows.x[at]
        hot = np.zeros((labels, len(at)))
        hot[y, np.arange(len(at))] = rows.of(f)[at] * rows.copies[at]
        return np.concatenate([hot.sum(axis=1), (hot @ x).ravel(), (hot @ (x * x)).ravel()])

    found = fold_sums(packed, folds, labels * (1 + 2 * d), part)
    s.weight, s.centre, s.spread = np.zeros((m, labels)), np.zeros((m, d)), np.ones((m, d))
    for f, v in found.items():
        c = s.classes(f)
        n, sums, squares = v[:labels][c], v[labels : labels * (1 + d)].reshape(labels, d)[c], v[labels * (1 + d) :].reshape(labels, d)[c]
        means = sums / n[:, None]
        s.weight[f, c] = n.max() / n
        s.centre[f] = means.mean(axis=0)
        spread = np.sqrt(np.maximum(0.0, (squares / n[:, None] - means**2 + (means - s.centre[f]) ** 2).mean(axis=0)))
        s.spread[f] = np.where(spread > CONSTANT, spread, 1.0)


# --- Newton steps


def softmax(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities by row, and the logarithm of each row's sum."""
    top = z.max(axis=1, keepdims=True)
    e = np.exp(z - top)
    total = e.sum(axis=1, keepdims=True)
    return e / total, (top + np.log(total))[:, 0]


def _blocks(k: int) -> list[tuple[int, int]]:
    """Pairs of classes whose Hessian blocks are needed; with two classes all four are one up to the sign."""
    return [(0, 0)] if k == 2 else [(i, j) for i in range(k) for j in range(i, k)]


def loss_parts(x: np.ndarray, y: np.ndarray, w: np.ndarray, coef: np.ndarray, intercept: np.ndarray) -> np.ndarray:
    """Summed loss, gradient (class x (features, 1)) and upper Hessian blocks of weighted rows; ``y`` counts the classes."""
    k = len(coef)
    z = x @ coef.T + intercept
    p, log_sum = softmax(z)
    one = np.column_stack([x, np.ones(len(x))])
    gap = p * w[:, None]
    gap[np.arange(len(y)), y] -= w
    upper = np.triu_indices(one.shape[1])
    out = [np.array([(w * (log_sum - z[np.arange(len(y)), y])).sum()]), (gap.T @ one).ravel()]
    for i, j in _blocks(k):
        h = w * p[:, i] * ((1.0 - p[:, i]) if i == j else -p[:, j])
        out.append(((one * h[:, None]).T @ one)[upper])
    return np.concatenate(out)


def newton_step(v: np.ndarray, theta: np.ndarray, centre: np.ndarray, spread: np.ndarray, penalty: float) -> tuple[float, float, np.ndarray]:
    """Objective, largest entry of its gradient, and the Newton direction at ``theta``, from ``loss_parts`` of rows that
    were not yet centred and scaled."""
    k, width = theta.shape
    d = width - 1
    scale = np.zeros((width, width))  # scaled (features, 1) = scale @ (features, 1)
    scale[np.arange(d), np.arange(d)] = 1.0 / spread
    scale[:d, d], scale[d, d] = -centre / spread, 1.0
    ridge = np.r_[np.full(d, penalty), 0.0]
    gradient = v[1 : 1 + k * width].reshape(k, width) @ scale.T + ridge * theta
    upper, at, square = np.triu_indices(width), 1 + k * width, {}
    for pair in _blocks(k):
        h = np.zeros((width, width))
        h[upper] = v[at : at + len(upper[0])]
        at += len(upper[0])
        h = h + np.triu(h, 1).T
        square[pair] = scale @ h @ scale.T
    if k == 2:  # the difference of the two classes is all that matters
        half = 0.5 * (gradient[1] - gradient[0])
        move = _solved(square[0, 0] + np.diag(ridge) / 2, half)
        step = np.vstack([move, -move]) / 2
    else:
        whole = np.zeros((k * width, k * width))
        for i in range(k):
            for j in range(k):
                h = square[(i, j) if i <= j else (j, i)]
                whole[i * width : (i + 1) * width, j * width : (j + 1) * width] = (h if i <= j else h.T) + (np.diag(ridge) if i == j else 0.0)
        step = -_solved(whole, gradient.ravel()).reshape(k, width)
    objective = v[0] + 0.5 * penalty * float((theta[:, :d] ** 2).sum())
    return objective, float(np.abs(gradient).max()), step


def _solved(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of least norm where classes can be shifted together."""
    return np.linalg.lstsq(a, b, rcond=1e-12)[0]


@dataclass
class Descent:
    """Damped Newton iterations of one fold, fed with what is known at ``theta``."""

    theta: np.ndarray
    rows: float
    tolerance: float
    best: np.ndarray | None = None
    objective: float = np.inf
    step: np.ndarray | None = None
    gradient: float = np.inf
    steps: int = 0
    halved: int = 0

    def feed(self, objective: float, gradient: float, step: np.ndarray) -> bool:
        """Whether the fold has converged; else ``theta`` is the next place to look at."""
        self.steps += 1
        if objective <= self.objective + 1e-12 * abs(objective):
            self.best, self.objective, self.step, self.gradient, self.halved = self.theta, objective, step, gradient / max(self.rows, 1.0), 0
            small = np.abs(step).max() <= 1e-10 * (1.0 + np.abs(self.best).max())
            if self.gradient <= self.tolerance or small:
                return True
            self.theta = self.best + self.step
            return False
        self.halved += 1
        self.theta = self.best + self.step * 0.5**self.halved
        return self.halved > 40


def fit_local(x: np.ndarray, y: np.ndarray, w: np.ndarray, k: int, penalty: float, most: int = 100, tolerance: float = 1e-9) -> tuple[np.ndarray, float]:
    """``theta`` of a few rows in memory, by the same steps."""
    d = x.shape[1]
    descent = Descent(np.zeros((k, d + 1)), float(w.sum()), tolerance)
    none, one = np.zeros(d), np.ones(d)
    while descent.steps < most:
        t = descent.theta
        if descent.feed(*newton_step(loss_parts(x, y, w, t[:, :d], t[:, d]), t, none, one, penalty)):
            break
    return descent.best, descent.gradient


def fit_rows(features: Sequence[str], x: np.ndarray, y: Sequence, w: np.ndarray, penalties: Sequence[float]) -> list[FoldModel] | str:
    """Models of a few rows in memory, one for each penalty (C): classes weigh equally, features are scaled as in
    ``fit_folds``. Why there is none, with fewer than two classes."""
    classes, code = np.unique(y, return_inverse=True)
    if len(classes) < 2:
        return f"training rows hold {len(classes)} class(es)"
    n = np.bincount(code, w)
    w = w * (n.max() / n)[code]
    means = np.array([np.average(x[code == c], axis=0, weights=w[code == c]) for c in range(len(classes))])
    centre = means.mean(axis=0)
    spread = np.sqrt(np.average((x - centre) ** 2, axis=0, weights=w))
    spread = np.where(spread > CONSTANT * np.maximum(1.0, np.abs(centre)), spread, 1.0)
    out = []
    for c in penalties:
        theta, gradient = fit_local((x - centre) / spread, code, w, len(classes), 1.0 / c)
        out.append(FoldModel(list(features), classes.tolist(), centre.tolist(), spread.tolist(), theta[:, :-1], theta[:, -1] - theta[:, -1].mean(), gradient, 0))
    return out


def line_sums(rows: DataFrame, models: Sequence[FoldModel | str]) -> DataFrame:
    """For every line (``CellLines``, ``label``) and fold with a model: the mean logits ``z`` and probabilities ``p`` of its
    cells, in class order. One scan for all folds; a task adds up lines and hands on one array for each."""
    fitted = [(f, *m.plain()) for f, m in enumerate(models) if isinstance(m, FoldModel)]
    features = next(m.features for m in models if isinstance(m, FoldModel))
    weights, base = np.concatenate([c for _, c, _ in fitted]), np.concatenate([b for _, _, b in fitted])
    if weights.nbytes > COEFFICIENT_BYTES:
        raise ValueError("the coefficients of all folds are too large to be sent to every task; use fewer folds at a time")
    edges = np.cumsum([0, *(len(b) for _, _, b in fitted)])
    shared = rows.sparkSession.sparkContext.broadcast((weights, base))
    label = rows.schema["label"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, base = shared.value
        sums: dict[tuple, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], kind), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["CellLines", "label", "v"])

        kind = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            kind = batch.column("label").type
            x = batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            if not np.isfinite(x).all():
                raise ValueError("a cell to score lacks a feature")
            z = x @ weights.T + base
            p = np.concatenate([softmax(z[:, a:b])[0] for a, b in zip(edges[:-1], edges[1:], strict=True)], axis=1)
            both = np.concatenate([z, p, np.ones((n, 1))], axis=1)
            lines, own = (batch.column(c).dictionary_encode(null_encoding="encode") for c in ("CellLines", "label"))
            known, of = np.unique(lines.indices.to_numpy().astype(np.int64) * len(own.dictionary) + own.indices.to_numpy(), return_inverse=True)
            line, tag = lines.dictionary.to_pylist(), own.dictionary.to_pylist()
            number = [(line[k // len(tag)], tag[k % len(tag)]) for k in known.tolist()]
            hot = np.zeros((len(number), n))
            hot[of, np.arange(n)] = 1.0
            for k, v in zip(number, hot @ both, strict=True):
                sums[k] = sums[k] + v if k in sums else v
            if len(sums) * both.shape[1] > NUMBERS:
                yield out()
                sums = {}
        if sums:
            yield out()

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, total, kind = None, np.zeros(0), None

        def out() -> pa.RecordBatch:
            z, p = (total[:-1] / total[-1]).reshape(2, -1)
            cut = lambda v: [v[a:b].tolist() for a, b in zip(edges[:-1], edges[1:], strict=True)]
            n = len(fitted)
            return pa.RecordBatch.from_arrays([pa.array([current[0]] * n, pa.string()), pa.array([current[1]] * n, kind), pa.array([f for f, _, _ in fitted], pa.int32()),
                                               pa.array(cut(z), pa.list_(pa.float64())), pa.array(cut(p), pa.list_(pa.float64()))], ["CellLines", "label", "_fold", "z", "p"])

        for batch in batches:
            kind = batch.column("label").type
            for line, own, raw in zip(batch.column("CellLines").to_pylist(), batch.column("label").to_pylist(), batch.column("v"), strict=True):
                v = np.frombuffer(raw.as_buffer(), dtype=np.float64)
                if (line, own) == current:
                    total += v
                    continue
                if current is not None:
                    yield out()
                current, total = (line, own), v.copy()
        if current is not None:
            yield out()

    given = rows.select("CellLines", "label", F.array(*[quoted(c).cast("double") for c in features]).alias("_x"))
    parts = given.mapInArrow(task, f"CellLines string, label {label}, v binary").repartition("CellLines", "label").sortWithinPartitions("CellLines", "label")
    return parts.mapInArrow(added, f"CellLines string, label {label}, _fold int, z array<double>, p array<double>")


# --- all together


def member_table(spark, folds: Sequence[Sequence[str]], times: bool = False) -> tuple[DataFrame, int]:
    """(CellLines, member): bit f is set where fold f trains on the line, or with ``times`` the number of times that it names
    the line (two bytes for each fold); and the rows to allow for in a broadcast, in units of ordinary rows."""
    of_line: dict[str, np.ndarray] = {}
    for f, lines in enumerate(folds):
        for line in lines:
            of_line.setdefault(line, np.zeros(max(len(folds), 2) if times else len(folds), dtype="<u2"))[f] += 1
    rows = [(line, bytearray(n.tobytes() if times else np.packbits(n > 0).tobytes())) for line, n in of_line.items()]
    return spark.createDataFrame(rows, "CellLines string, member binary"), len(rows) * (1 + len(folds) // (32 if times else 512))


def pack(rows: DataFrame, features: Sequence[str], labels: Sequence, seed, mean: Sequence[float], deviation: Sequence[float], folds: int) -> Packed:
    """Training cells as ``y`` (number of the label), ``member`` (the folds of the line), ``o`` (place in the seeded order),
    ``x`` and ``copies`` (1 without such a column), in blocks, kept."""
    code = F.create_map(*[z for i, c in enumerate(labels) for z in (F.lit(c), F.lit(i))])
    order = hash_number(hash_order(F.col("cell_key"), seed)).cast("long") if "cell_key" in rows.columns else F.lit(0).cast("long")
    copies = F.col("copies").cast("double") if "copies" in rows.columns else F.lit(1.0)
    x = F.array(*[(quoted(c).cast("double") - F.lit(float(m))) / F.lit(float(s)) for c, m, s in zip(features, mean, deviation, strict=True)])
    cells = rows.select(F.element_at(code, F.col("label")).alias("y"), "member", order.alias("o"), x.alias("x"), copies.alias("copies"))
    blocks = cells.mapInArrow(_blocks_of, BLOCK).persist(StorageLevel.MEMORY_AND_DISK)
    return Packed(blocks, folds, blocks.rdd.getNumPartitions())


def fit_folds(rows: DataFrame, features: Sequence[str], folds: Sequence[Sequence[str]] | None, options: Mapping | None = None, seed: int = 47) -> list[FoldModel | str]:
    """The model of every fold (given by its training lines), or why there is none. Without ``folds`` there is one, of all
    rows. ``rows``: cells with ``CellLines``, ``label`` and the features; with ``balance`` 'down' (as by default) also
    ``cell_key``. A column ``copies`` counts a cell so many times, and a line that a fold names more than once counts as
    often; neither goes with 'down'.

    Options: ``C``, ``balance``, ``max_iter``, ``tol``. The number of passes does not depend on the number of folds."""
    options = dict(options or {})
    down = options.get("balance", "down") == "down"
    times = any(len(set(lines)) < len(lines) for lines in folds or ())
    if down and (times or "copies" in rows.columns):
        raise ValueError("copies of cells and lines need balance 'weights'")
    if down and "cell_key" not in rows.columns:
        raise ValueError("balance 'down' draws cells by their cell_key; add one, or set balance to 'weights'")
    features = list(features)
    if folds is None:
        rows = rows.withColumn("member", F.lit(bytearray(b"\x80")))
    else:
        table, bound = member_table(rows.sparkSession, folds, times)
        rows = join_bounded(rows, table, "CellLines", rows=bound)
    moments = rows.agg(F.array_sort(F.collect_set("label")).alias("labels"), F.array(*[F.avg(quoted(c)) for c in features]).alias("m"),
                       F.array(*[F.stddev_pop(quoted(c)) for c in features]).alias("s")).first()
    mean = [v if v is not None else 0.0 for v in moments["m"]]
    deviation = [v if v else 1.0 for v in moments["s"]]
    if not moments["labels"]:
        return ["training rows hold 0 class(es)"] * (1 if folds is None else len(folds))
    packed = pack(rows, features, moments["labels"], seed, mean, deviation, 1 if folds is None else len(folds))
    try:
        return _fitted(packed, features, moments["labels"], mean, deviation, down, options)
    finally:
        packed.blocks.unpersist()


def _fitted(packed, features, labels, mean, deviation, down, options) -> list[FoldModel | str]:
    m, d = packed.folds, len(features)
    sizes = class_sizes(packed, len(labels))
    s = _State(labels, sizes > 0)
    out: list[FoldModel | str] = [f"training rows hold {n} class(es)" for n in s.present.sum(axis=1)]
    folds = np.flatnonzero(s.present.sum(axis=1) > 1).tolist()
    if not folds:
        return out
    s.cut = class_cuts(packed, sizes) if down else None
    _scaling(packed, s, folds, d)
    penalty = 1.0 / float(options.get("C", 1.0))
    used = {f: sizes[f][sizes[f] > 0] for f in folds}
    seen = {f: float((n.min() if down else n.max()) * len(n)) for f, n in used.items()}
    tolerance = float(options.get("tol", 1e-9))
    descents = {f: Descent(np.zeros((len(s.classes(f)), d + 1)), seen[f], tolerance) for f in folds}
    open_ = list(folds)
    most = int(options.get("max_iter", 100))
    while open_ and max(descents[f].steps for f in open_) < most:
        theta = {f: descents[f].theta for f in open_}

        def part(rows: Rows, f: int, theta=theta) -> np.ndarray | None:
            at = _chosen(rows, f, s)
            if not len(at):
                return None
            t = theta[f]
            coef = t[:, :-1] / s.spread[f]
            code = np.cumsum(s.present[f]) - 1
            y = rows.y[at]
            return loss_parts(rows.x[at], code[y], s.weight[f][y] * rows.of(f)[at] * rows.copies[at], coef, t[:, -1] - coef @ s.centre[f])

        def finish(f: int, v: np.ndarray, theta=theta) -> np.ndarray:
            objective, gradient, step = newton_step(v, theta[f], s.centre[f], s.spread[f], penalty)
            return np.concatenate([[objective, gradient], step.ravel()])

        k = max(len(t) for t in theta.values())
        width = 1 + k * (d + 1) + len(_blocks(k)) * (d + 1) * (d + 2) // 2
        found = fold_sums(packed, open_, width, part, finish)
        open_ = [f for f in open_ if not descents[f].feed(found[f][0], found[f][1], found[f][2:].reshape(theta[f].shape))]
    for f in folds:
        best = descents[f].best
        centre = np.array(mean) + np.array(deviation) * s.centre[f]
        out[f] = FoldModel(features, [labels[c] for c in s.classes(f)], centre.tolist(), (np.array(deviation) * s.spread[f]).tolist(),
                           best[:, :d], best[:, d] - best[:, d].mean(), descents[f].gradient, descents[f].steps)
    return out


def scan_folds(rows: DataFrame, features: Sequence[str], folds: int, member: str | None, keep: Sequence[str], fields: Sequence[T.StructField],
               make: Callable[[], Callable[[np.ndarray], Callable[[int, np.ndarray], list[pa.Array]]]]) -> DataFrame:
    """Every row once for each fold that scores it, in one scan: columns ``keep``, ``_fold`` and ``fields``. A row comes back
    from Python once, with the scores of all its folds, and is repeated for the folds by Spark, with the columns in use.

    ``make`` is called once a task; what it gives takes the features of a batch and gives a function of (fold, places of
    the rows it scores) that returns the values of ``fields``. ``member``: a column with the bits of the folds that trained
    on the row's line; the others score it. Without it all folds do."""
    names, fields = list(keep), list(fields)
    held = [f"_k{i}" for i in range(len(names))]  # names of any kind

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = make()
        for whole in batches:
            for lo in range(0, whole.num_rows, step):
                batch = whole.slice(lo, step)
                n = batch.num_rows
                x = batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
                if not np.isfinite(x).all():
                    raise ValueError("a cell to score lacks a feature")
                score = scorer(x)
                if member is None:
                    out = np.ones((n, folds), dtype=bool)
                else:
                    bits = np.frombuffer(b"".join(batch.column(member).to_pylist()), dtype=np.uint8).reshape(n, -1)
                    out = ~np.unpackbits(bits, axis=1, count=folds).astype(bool)
                parts = [(f, at) for f in range(folds) if len(at := np.flatnonzero(out[:, f]))]
                if not parts:
                    continue
                own = zip(*(score(f, at) for f, at in parts), strict=True)
                order = pa.array(np.argsort(np.concatenate([at for _, at in parts]), kind="stable"))
                fold = pa.array(np.concatenate([np.full(len(at), f, dtype=np.int32) for f, at in parts]))
                values = [v.take(order) for v in (fold, *(pa.concat_arrays(v) for v in own))]
                edges = pa.array(np.r_[0, out.sum(axis=1).cumsum()].astype(np.int32))
                scored = pa.ListArray.from_arrays(edges, pa.StructArray.from_arrays(values, ["_fold", *(f.name for f in fields)]))
                yield pa.RecordBatch.from_arrays([*batch.select(held).columns, scored], [*held, "_scored"])

    step = max(1, NUMBERS // (8 * max(1, folds)))  # rows whose scores are held at once
    given = rows.select(*[quoted(c).alias(h) for c, h in zip(names, held, strict=True)], *([F.col(member)] if member else []), F.array(*[quoted(c).cast("double") for c in features]).alias("_x"))
    inner = T.StructType([T.StructField("_fold", T.IntegerType()), *fields])
    schema = T.StructType([T.StructField(h, rows.schema[c].dataType) for c, h in zip(names, held, strict=True)] + [T.StructField("_scored", T.ArrayType(inner))])
    return given.mapInArrow(run, schema).select(*held, F.inline("_scored")).toDF(*names, "_fold", *(f.name for f in fields))


def score_folds(rows: DataFrame, models: Sequence[FoldModel | str], member: str | None = None, keep: Sequence[str] | None = None, logits: bool = False) -> DataFrame:
    """Every row with the probabilities of the folds that score it (``scan_folds``): the array ``_p`` in class order (null
    for a fold without a model); with ``logits`` also ``_z``. One matrix product per batch for all folds."""
    fitted = [(f, *m.plain(), len(m.classes)) for f, m in enumerate(models) if isinstance(m, FoldModel)]
    features = next(m.features for m in models if isinstance(m, FoldModel))
    if sum(8 * c.size for _, c, _, _ in fitted) > COEFFICIENT_BYTES:
        raise ValueError("the coefficients of all folds are too large to be sent to every task; score fewer folds at a time")
    weights, base = np.concatenate([c for _, c, _, _ in fitted]), np.concatenate([b for _, _, b, _ in fitted])
    place = {f: (int(a), k) for (f, _, _, k), a in zip(fitted, np.cumsum([0, *[k for _, _, _, k in fitted]]), strict=False)}
    shared = rows.sparkSession.sparkContext.broadcast((weights, base))
    lists = ["_p", "_z"] if logits else ["_p"]

    def make():
        weights, base = shared.value

        def scorer(x: np.ndarray):
            z = x @ weights.T + base

            def score(f: int, at: np.ndarray) -> list[pa.Array]:
                if f not in place:
                    return [pa.nulls(len(at), pa.list_(pa.float64()))] * len(lists)
                lo, k = place[f]
                own = z[at, lo : lo + k]
                edges = pa.array(np.arange(0, own.size + 1, k, dtype=np.int32))
                return [pa.ListArray.from_arrays(edges, pa.array(np.ascontiguousarray(v).ravel())) for v in [softmax(own)[0], own][: len(lists)]]

            return score

        return scorer

    names = list(keep if keep is not None else [c for c in rows.columns if c != member])
    return scan_folds(rows, features, len(models), member, names, [T.StructField(c, T.ArrayType(T.DoubleType())) for c in lists], make)
