"""Quality and toxicity by weak labels: overlapping heuristic labellers, expectation-maximisation, a hashed linear scorer.

Labellers vote good, bad or nothing on simple signals of a text. Their accuracies are unknown; expectation-maximisation
estimates, over all documents, how often each votes what on good and on bad texts. It needs only the number of documents
of each pattern of votes, which Spark counts (at most 3 ** labellers patterns, whatever the input). The posterior of its
pattern labels each document of a sample of about ``SAMPLE`` (never above twice; by hash), and these soft labels train a
logistic scorer on hashed features of words; the scorer rates every document.

Toxicity runs the same way with labellers of its own. Two know a half each of a list of insults and of the terms (words
and beginnings of words) that a sample of at most ``LABELLED`` rows of ``labels`` shows in toxic documents only; a third
counts what either finds. Rows whose
crc32(doc_id as text) mod 5 is 0 are held out from it, so accuracy can be measured on them.

Scores are between 0 and 1: ``quality`` that the text is good, ``toxicity`` that it is toxic; ``keep`` holds for quality
of at least one half in a text that is not toxic. Null, empty and blank texts have quality 0, are not toxic and are not kept. Repeated rows are
rated each; no labels leave the labellers of the list alone; an empty table gives an empty result; extra columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platelens.llm.common import Known, byte_column, hash_prefixes, hash_words, mix, pieces, split_words, stored, utf8

SAMPLE = 3000
LABELLED = 5000
CELLS = 1 << 16
TERMS = 2000
#: Insults that the labellers of toxicity know, in two halves.
INSULTS = [
    ["idiot", "moron", "scum", "trash", "worthless", "bastard", "freak", "dumb", "imbecile", "vermin"],
    ["stupid", "loser", "clown", "pathetic", "disgusting", "retard", "jerk", "filth", "bitch", "asshole"],
]
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#$%&*|<>{}~^=@_\\/+")] = True
EDGES = np.zeros(256, dtype=bool)
EDGES[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
SIGNALS = ["words", "symbol", "upper", "shout", "distinct", "stutter", "pipe", "short", "stop"]


def lower(data: np.ndarray) -> np.ndarray:
    """Bytes in lower case, ASCII punctuation as white space."""
    up = (data >= 0x41) & (data <= 0x5A)
    return np.where(EDGES[data], np.uint8(0x20), data + (up * 0x20).astype(np.uint8))


def _mean(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(x, dtype=np.float64)]
    return (total[first[1:]] - total[first[:-1]]) / np.maximum(np.diff(first), 1)


def signals(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of ``SIGNALS`` for each text: shares of its words but for their number."""
    starts, ends, first = split_words(data, at)
    h = hash_words(data, starts, ends)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(first))
    kind = np.r_[0, np.cumsum(SYMBOLS[data])]
    caps = np.r_[0, np.cumsum((data >= 0x41) & (data <= 0x5A))]
    size = ends - starts
    up = (caps[ends] - caps[starts]) * 2 > size
    last = data[ends - 1] if len(ends) else data[:0]
    same = np.r_[False, (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])] if len(h) else np.zeros(0, dtype=bool)
    key = np.sort((doc.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
    different = np.bincount((key[np.r_[True, key[1:] != key[:-1]]] >> np.uint64(40)).astype(np.int64), minlength=len(at) - 1) if len(key) else np.zeros(len(at) - 1)
    pipe = (size == 1) & (last == 0x7C)
    return np.column_stack([
        np.diff(first), _mean(kind[ends] > kind[starts], first), _mean(up & (size > 1), first), _mean(last == 0x21, first), different / np.maximum(np.diff(first), 1),
        _mean(same, first), _mean(pipe, first), _mean(size <= 3, first), _mean(last == 0x2E, first),
    ])


def _vote(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    return np.where(bad, 2, np.where(good, 1, 0))


def quality_votes(s: np.ndarray) -> np.ndarray:
    """Texts x labellers: 0 nothing, 1 good, 2 bad."""
    words, symbol, upper, shout, distinct, stutter, pipe, short, stop = s.T
    return np.column_stack([
        _vote(symbol < 0.05, symbol > 0.3), _vote(upper < 0.1, upper > 0.5), _vote(shout < 0.03, shout > 0.3),
        _vote((distinct > 0.35) | (words > 2000), (distinct < 0.25) & (words > 20) & (words < 2000)), _vote(stutter < 0.03, stutter > 0.15),
        _vote(pipe == 0, pipe > 0.15), _vote((short > 0.1) & (short < 0.7), (short < 0.05) & (words > 20)),
        _vote((stop > 0.01) & (stop < 0.4), (stop < 0.002) & (words > 100)),
    ])


def toxic_votes(data: np.ndarray, at: np.ndarray, lists: list[Known]) -> np.ndarray:
    """Texts x labellers: 1 harmless, 2 toxic. ``lists``: words and beginnings of words known to the first two labellers;
    a third counts what either finds."""
    plain = lower(data)
    starts, ends, first = split_words(plain, at)
    forms = hash_prefixes(plain, starts, ends, [None, 4, 5, 6, 7])
    hits = [np.logical_or.reduce([known.holds(h) for h in forms]) for known in lists]
    one, two = (np.diff(np.r_[0, np.cumsum(x)][first]) for x in hits)
    return np.column_stack([_vote(one == 0, one > 0), _vote(two == 0, two > 0), _vote(one + two < 2, one + two > 2)])


def estimate(patterns: np.ndarray, counts: np.ndarray, bad: float, rounds: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the kinds of texts, and P(vote | kind) as kinds x labellers x votes, by expectation-maximisation.

    Kind 0 is good; bad texts come in as many kinds as there are labellers, since a text that is bad in one way is
    mostly fine in the others. Kind j starts as what labeller j finds bad, at four times in five; the other votes start
    as they are cast overall."""
    n = patterns.shape[1]
    total = max(float(counts.sum()), 1.0)
    overall = np.array([[((patterns[:, j] == v) * counts).sum() + 0.5 for v in range(3)] for j in range(n)]) / (total + 1.5)
    table = np.tile(overall, (n + 1, 1, 1))
    table[0] = [[0.1, 0.88, 0.02]] * n
    for j in range(n):
        table[j + 1, j] = [0.05, 0.15, 0.8]
    share = np.r_[1 - bad, np.full(n, bad / n)]
    for _ in range(rounds):
        weight = _kinds(patterns, share, table) * counts[:, None]
        new = np.stack([[[weight[patterns[:, j] == v, k].sum() + 0.05 for v in range(3)] for j in range(n)] for k in range(n + 1)])
        new /= new.sum(axis=2, keepdims=True)
        share = (weight.sum(axis=0) + 0.05) / (total + 0.05 * (n + 1))
        moved = np.abs(new - table).max()
        table = new
        if moved < 1e-6:
            break
    return share, table


def _kinds(patterns: np.ndarray, share: np.ndarray, table: np.ndarray) -> np.ndarray:
    """P(kind) of each pattern of votes."""
    log = np.log(share)[None, :] + sum(np.log(table[:, j, :]).T[patterns[:, j]] for j in range(patterns.shape[1]))
    p = np.exp(log - log.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def posterior(patterns: np.ndarray, share: np.ndarray, table: np.ndarray) -> np.ndarray:
    """P(bad) of each pattern of votes."""
    return 1 - _kinds(patterns, share, table)[:, 0]


def features(data: np.ndarray, at: np.ndarray, lists: list[Known]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, cell and value of hashed features: words and beginnings of words that occur, shares of word shapes, bad votes."""
    plain = lower(data)
    starts, ends, first = split_words(plain, at)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(first))
    cells = [h ^ np.uint64(n) for n, h in zip((0, 4, 6), hash_prefixes(plain, starts, ends, [None, 4, 6]), strict=True)]
    key = np.unique(np.concatenate([(doc.astype(np.uint64) << np.uint64(32)) | (mix(c) % np.uint64(CELLS // 2)) for c in cells])) if len(doc) else np.zeros(0, dtype=np.uint64)
    s = signals(data, at)
    votes = np.column_stack([quality_votes(s), toxic_votes(data, at, lists)]) == 2
    shape = np.column_stack([s[:, 1:], np.minimum(s[:, 0], 50) / 50, votes]) * (s[:, :1] > 0)
    shape = np.column_stack([shape, s[:, 0] > 0])
    rows, cols = np.nonzero(shape)
    return (
        np.r_[(key >> np.uint64(32)).astype(np.int64), rows], np.r_[(key & np.uint64(0xFFFFFFFF)).astype(np.int64), CELLS // 2 + cols],
        np.r_[np.full(len(key), 0.1), 3 * shape[rows, cols]],
    )


def train(doc: np.ndarray, cell: np.ndarray, value: np.ndarray, target: np.ndarray, rounds: int = 120) -> np.ndarray:
    """Weights of a logistic scorer for soft targets, by gradient steps with a step size for each cell."""
    w, square = np.zeros(CELLS), np.full(CELLS, 1e-8)
    n = max(1, len(target))
    balance = np.where(target > 0.5, 0.5 / max((target > 0.5).mean(), 0.01), 0.5 / max((target <= 0.5).mean(), 0.01)) if len(target) else target
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(doc, value * w[cell], minlength=n), -30, 30)))
        grad = np.bincount(cell, value * ((p - target) * balance)[doc], minlength=CELLS) / n + 1e-6 * w
        square += grad**2
        w -= 0.3 * grad / np.sqrt(square)
    return w


def _term_hashes(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(w) + 1 for w in raw])
    return hash_words(np.frombuffer(b"".join(w + b" " for w in raw), dtype=np.uint8), np.r_[0, ends[:-1]], ends - 1) if raw else np.zeros(0, dtype=np.uint64)


def toxic_terms(docs: DataFrame, labels: DataFrame, sample: int = LABELLED) -> np.ndarray:
    """Hashes of words and beginnings of words found at least 20 times as often in toxic documents of the sample."""
    train_rows = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    chosen = train_rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]", " ").alias("t"))  # at most ``sample`` rows
    words = texts.select("doc_id", "toxic", F.explode(F.array_distinct(F.split("t", r"[\x20\x09-\x0D]+"))).alias("w")).filter(F.length("w") >= 4)
    terms = words.select("doc_id", "toxic", F.explode(F.array(*(F.substring("w", 1, n) for n in (4, 5, 6, 7)), "w")).alias("w")).filter(F.length("w") >= 4).distinct()
    sizes = texts.select("doc_id", "toxic").distinct().groupBy("toxic").count().collect()
    n1, n0 = (sum(r["count"] for r in sizes if r["toxic"] == t) for t in (1, 0))
    odds = (F.col("c1") + 0.5) / (n1 + 1) / ((F.col("c0") + 0.5) / (n0 + 1))
    counts = terms.groupBy("w").agg(F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("c1"), F.sum(F.when(F.col("toxic") == 0, 1).otherwise(0)).alias("c0"))
    best = counts.filter("c1 >= 6").filter(odds >= 20).orderBy(odds.desc(), "w").limit(TERMS)
    return np.unique(_term_hashes([r["w"] for r in best.collect()]))


def rate(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id``, ``quality``, ``toxicity``, ``toxic`` and ``keep`` of every row of ``docs``."""
    terms = toxic_terms(docs, labels)
    lists = [Known(np.r_[_term_hashes(half), terms[k::2]]) for k, half in enumerate(INSULTS)]  # each half with half of the terms
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("draw"), utf8(F.col("text")).alias("text"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            data, at = byte_column(batch.column("text"))
            q, t = quality_votes(signals(data, at)), toxic_votes(data, at, lists)
            code = [pa.array((v * 3 ** np.arange(v.shape[1])).sum(axis=1).astype(np.int32)) for v in (q, t)]
            yield pa.RecordBatch.from_arrays([batch.column("draw"), *code], ["draw", "q", "t"])

    voted = stored(rows.mapInArrow(vote, "draw long, q int, t int"))
    total = voted.count()
    prob = {}
    for name, n, prior in (("q", len(quality_votes(np.zeros((1, len(SIGNALS))))[0]), 0.1), ("t", len(INSULTS) + 1, 0.05)):
        table = voted.groupBy(name).count().toPandas()  # at most 3 ** n rows
        code = table[name].to_numpy(dtype=np.int64)
        patterns = code[:, None] // 3 ** np.arange(n) % 3
        share, accuracy = estimate(patterns, table["count"].to_numpy(dtype=float), prior)
        prob[name] = dict(zip(code.tolist(), posterior(patterns, share, accuracy).tolist(), strict=True))

    limit = min(1.0, sample / max(1, total))
    drawn = rows.filter(F.pmod("draw", F.lit(1 << 30)) < F.lit(int(limit * (1 << 30)))).orderBy("draw").limit(2 * sample).select("text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            data, at = byte_column(batch.column("text"))
            q, t = quality_votes(signals(data, at)), toxic_votes(data, at, lists)
            doc, cell, value = features(data, at, lists)
            order = np.argsort(doc, kind="stable")
            cut = np.r_[0, np.cumsum(np.bincount(doc, minlength=batch.num_rows))].astype(np.int32)
            code = [pa.array((v * 3 ** np.arange(v.shape[1])).sum(axis=1).astype(np.int32)) for v in (q, t)]
            listed = [pa.ListArray.from_arrays(pa.array(cut), pa.array(x[order])) for x in (cell, value)]
            yield pa.RecordBatch.from_arrays([*code, *listed], ["q", "t", "cell", "value"])

    seen = drawn.repartition(8).mapInArrow(hashed, "q int, t int, cell array<long>, value array<double>").toArrow()
    doc = np.repeat(np.arange(seen.num_rows), seen["cell"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)) if seen.num_rows else np.zeros(0, dtype=np.int64)
    cell, value = (seen[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) if seen.num_rows else np.zeros(0) for c in ("cell", "value"))
    weights = [train(doc, cell.astype(np.int64), value, np.array([prob[n].get(c, 0.0) for c in seen[n].to_pylist()])) for n in ("q", "t")]
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            data, at = byte_column(batch.column("text"))
            doc, cell, value = features(data, at, lists)
            bad, toxic = (1 / (1 + np.exp(-np.clip(np.bincount(doc, value * w[cell], minlength=batch.num_rows), -30, 30))) for w in shared.value)
            blank = np.bincount(doc, minlength=batch.num_rows) == 0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.where(blank, 0.0, 1 - bad)), pa.array(np.where(blank, 0.0, toxic))], ["doc_id", "quality", "toxicity"])

    rated = rows.select("doc_id", "text").mapInArrow(score, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, quality double, toxicity double")
    toxic = F.col("toxicity") >= 0.5
    return rated.select("doc_id", "quality", "toxicity", toxic.alias("toxic"), ((F.col("quality") >= 0.5) & ~toxic).alias("keep"))
