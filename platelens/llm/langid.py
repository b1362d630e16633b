"""Language identification: script ranges narrow the candidates of each word, Viterbi over word scores labels spans.

Every word is scored for every language by hashed character n-grams (1 to 4, with the word's ends); languages whose
training texts do not use the word's script drop out. A path of languages over the words of a text is the one of largest
score when each change costs ``SWITCH``; its runs are the spans. The text's language holds most letters of the path, and
the score is its share of the letters.

Training takes at most ``SAMPLE`` labelled documents of each language (by hash), whole; counts are summed on Spark, and
what reaches the driver is at most languages x ``CELLS`` numbers. Prediction reads nothing but the text.

Null text, no letter or no labelled document at all: ``und`` with score 0. Words of a script that no language uses score
alike for all. Ties go to the language first in code-point order. Repeated rows are predicted each; a null ``doc_id``
counts as the empty text in the hold-out rule. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platelens.llm.common import byte_column, hash_words, mix, pieces, ranges, split_words, utf8

SAMPLE = 1000
CELLS = 1 << 15
SWITCH = 12.0
#: A word decides at most so much, in log probability, against any language.
WORD_LIMIT = 5.0
#: Words whose scores a task remembers.
KNOWN = 300_000
#: First code points of script ranges (Unicode blocks), each up to the next; 0 is no script of its own.
SCRIPTS = [
    (0x0000, "none"), (0x0041, "latin"), (0x0250, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"),
    (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "none"), (0x0750, "arabic"), (0x0780, "none"), (0x0900, "devanagari"),
    (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "none"), (0x0B80, "tamil"), (0x0C00, "telugu"),
    (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "none"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "none"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1380, "none"), (0x1780, "khmer"), (0x1800, "none"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "none"), (0x3040, "kana"), (0x3100, "none"), (0x3400, "han"),
    (0xA000, "none"), (0xAC00, "hangul"), (0xD7B0, "none"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"),
    (0xFB50, "arabic"), (0xFE00, "none"), (0x20000, "han"), (0x30000, "none"),
]
SCRIPT_STARTS = np.array([s for s, _ in SCRIPTS])
SCRIPT_NAMES = sorted({n for _, n in SCRIPTS})
SCRIPT_IDS = np.array([SCRIPT_NAMES.index(n) for _, n in SCRIPTS])


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Letters-only forms of words as n-gram cells: the cells in a row, how many each word has, its main script and its
    number of letters."""
    clean = ["".join(filter(str.isalpha, w.lower())) for w in words]
    letters = np.fromiter(map(len, clean), dtype=np.int64, count=len(clean))
    text = np.frombuffer("".join(f" {w} " for w in clean).encode("utf-32-le", "replace"), dtype=np.uint32)
    of = np.repeat(np.arange(len(clean)), letters + 2)
    script = SCRIPT_IDS[np.searchsorted(SCRIPT_STARTS, text, side="right") - 1]
    votes = np.zeros((len(clean), len(SCRIPT_NAMES)), dtype=np.int32)
    body = text != 0x20
    np.add.at(votes, (of[body], script[body]), 1)
    cells, owner = [], []
    for n in range(1, 5):
        if len(text) < n:
            break
        h = np.full(len(text) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            h = (h ^ text[k : len(text) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        inside = of[: len(text) - n + 1] == of[n - 1 :]
        inside &= letters[of[: len(text) - n + 1]] > 0
        cells.append((mix(h[inside]) % np.uint64(CELLS)).astype(np.int64))
        owner.append(of[: len(text) - n + 1][inside])
    cell, own = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (cells, owner))
    order = np.argsort(own, kind="stable")
    return cell[order], np.bincount(own, minlength=len(clean)), votes.argmax(axis=1), letters


def _unique_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[str]]:
    h = hash_words(data, starts, ends)
    keys, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    raw = data.tobytes()
    return keys, inverse, [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]


def fit(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, scores of n-gram cells (languages x cells), and whether a language uses a script."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    labelled = labelled.select("lang", "text", "doc_id")
    sizes = labelled.groupBy("lang").count()
    chance = F.pmod(F.xxhash64("doc_id", "text", F.lit(1)), F.lit(1 << 30)) * F.col("count") < F.lit(float(1 << 30)) * 2 * sample
    near = labelled.join(F.broadcast(sizes), "lang").filter(chance)  # one row for each language
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", "text"), "doc_id"))
    taken = near.withColumn("r", rank).filter(F.col("r") <= sample).select("lang", utf8(F.col("text")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in pieces(batches, "text"):
            data, at = byte_column(batch.column("text"))
            starts, ends, first = split_words(data, at)
            if not len(starts):
                continue
            _, inverse, words = _unique_words(data, starts, ends)
            cell, n, script, letters = word_features(words)
            begin = np.cumsum(n) - n
            for i, lang in enumerate(batch.column("lang").to_pylist()):
                used, times = np.unique(inverse[first[i] : first[i + 1]], return_counts=True)
                if not len(used):
                    continue
                own = sums.setdefault(lang, np.zeros(CELLS + len(SCRIPT_NAMES)))
                where = np.repeat(begin[used], n[used]) + ranges(n[used])
                own[:CELLS] += np.bincount(cell[where], weights=np.repeat(times, n[used]), minlength=CELLS)
                own[CELLS:] += np.bincount(script[used], weights=times * letters[used], minlength=len(SCRIPT_NAMES))
        for lang, own in sums.items():
            full = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(full)), pa.array(full), pa.array(own[full])], ["lang", "cell", "n"])

    counts = taken.repartition("lang", F.pmod(F.xxhash64("text"), F.lit(16))).mapInArrow(run, "lang string, cell long, n double").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique())
    dense = np.zeros((len(langs), CELLS + len(SCRIPT_NAMES)))
    dense[counts["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(dtype=int), counts["cell"].to_numpy(dtype=int)] = counts["n"]
    grams, scripts = dense[:, :CELLS], dense[:, CELLS:]
    score = np.log((grams + 0.5) / (grams.sum(axis=1, keepdims=True) + 0.5 * CELLS))
    uses = scripts >= 0.01 * np.maximum(scripts.sum(axis=1, keepdims=True), 1)
    return langs, (score - score.max(axis=0, initial=-np.inf) if langs else score).astype(np.float32), uses


class Scorer:
    """Word scores with a memory of the words seen by this task."""

    def __init__(self, table: np.ndarray, uses: np.ndarray) -> None:
        self.table, self.uses = np.ascontiguousarray(table.T), uses
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)
        self.rows = np.zeros((0, self.table.shape[1]), dtype=np.float32)
        self.letters = np.zeros(0, dtype=np.int64)

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores and numbers of letters of all words."""
        h = hash_words(data, starts, ends)
        keys, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        old = (at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == keys) if len(self.keys) else np.zeros(len(keys), dtype=bool)
        score = np.empty((len(keys), self.table.shape[1]), dtype=np.float32)
        letters = np.empty(len(keys), dtype=np.int64)
        score[old], letters[old] = self.rows[at[old]], self.letters[at[old]]
        if not old.all():
            new = ~old
            raw = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)]
            score[new], letters[new] = self.fresh(raw)
            if len(self.keys) + int(new.sum()) > KNOWN:
                self.keys, self.rows, self.letters = keys, score, letters
            else:
                merged = np.concatenate([self.keys, keys[new]])
                order = np.argsort(merged)
                self.keys, self.rows = merged[order], np.concatenate([self.rows, score[new]])[order]
                self.letters = np.concatenate([self.letters, letters[new]])[order]
        return score[inverse], letters[inverse]

    def fresh(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        cell, n, script, letters = word_features(words)
        out = np.zeros((len(words), self.table.shape[1]), dtype=np.float32)
        full = np.flatnonzero(n)
        if len(full):
            out[full] = np.add.reduceat(self.table[cell], (np.cumsum(n) - n)[full], axis=0) * 0.5  # n-grams of a word overlap
        fits = self.uses.T[script]
        none = ~fits.any(axis=1)
        fits[none] = True
        out[none] = 0
        out[~fits] = -np.inf
        out -= out.max(axis=1, keepdims=True)
        out = np.maximum(out, -WORD_LIMIT)
        out[letters == 0] = 0
        return out, letters


def viterbi(score: np.ndarray, first: np.ndarray, switch: float) -> np.ndarray:
    """Best label of every word; text i has the words first[i] ... first[i + 1]. All texts go forward in step."""
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    begin, size = first[:-1][order], size[order]
    active = np.searchsorted(-size, -np.arange(1, size[0] + 1 if len(size) else 1), side="right")  # texts with more than t words
    label = np.zeros(len(score), dtype=np.int16)
    stays = np.ones(score.shape, dtype=bool)
    best = np.zeros(len(score), dtype=np.int16)
    v = np.zeros((len(size), score.shape[1]), dtype=np.float32)
    for t, n in enumerate(active.tolist()):
        at = begin[:n] + t
        now = v[:n]
        if t:
            top = now.argmax(axis=1)
            best[at] = top
            jump = now[np.arange(n), top] - np.float32(switch)
            stays[at] = now >= jump[:, None]
            np.maximum(now, jump[:, None], out=now)
        now += score[at]
        if t % 64 == 63:
            now -= now.max(axis=1, keepdims=True)
    current = v.argmax(axis=1).astype(np.int16)
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        at = begin[:n] + t
        own = current[:n]
        label[at] = own
        if t:
            current[:n] = np.where(stays[at, own], own, best[at])
    return label


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], columns: list[str] | None = None, spans: bool = False) -> DataFrame:
    """``columns`` of ``docs`` (default ``doc_id``) with ``lang_pred`` and ``score``; with ``spans``, an array of
    (lang, first word, end word) as well."""
    columns = ["doc_id"] if columns is None else columns
    found = _identified(docs, model, columns, spans)
    out = [F.col(f"_c{i}").alias(c) for i, c in enumerate(columns)] + [F.col("_lang").alias("lang_pred"), F.col("_score").alias("score")]
    return found.select(*out, *([F.col("_spans").alias("spans")] if spans else []))


def _identified(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], columns: list[str], spans: bool) -> DataFrame:
    langs, table, uses = model
    shared = docs.sparkSession.sparkContext.broadcast((table, uses)) if langs else None
    limit = max(1 << 19, (8 << 20) // max(4, len(langs)))

    def label_texts(scorer: Scorer, texts: pa.Array) -> list[pa.Array]:
        rows = len(texts)
        data, at = byte_column(texts)
        starts, ends, first = split_words(data, at)
        score, letters = scorer.words(data, starts, ends)
        label = viterbi(score, first, SWITCH)
        doc = np.repeat(np.arange(rows), np.diff(first))
        held = np.bincount(doc * len(langs) + label, weights=letters, minlength=rows * len(langs)).reshape(rows, len(langs))
        total, top = held.sum(axis=1), held.argmax(axis=1)
        pred = [langs[k] if n > 0 else "und" for k, n in zip(top.tolist(), total.tolist(), strict=True)]
        out = [pa.array(pred, pa.string()), pa.array(held[np.arange(rows), top] / np.maximum(total, 1))]
        if spans:
            runs: list[list[dict]] = [[] for _ in range(rows)]
            change = np.flatnonzero(np.r_[True, (label[1:] != label[:-1]) | (doc[1:] != doc[:-1])]) if len(label) else np.zeros(0, dtype=int)
            for a, b in zip(change.tolist(), [*change[1:].tolist(), len(label)] if len(label) else [], strict=True):
                runs[doc[a]].append({"lang": langs[label[a]], "first": int(a - first[doc[a]]), "end": int(b - first[doc[a]])})
            out.append(pa.array(runs, pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int32()), ("end", pa.int32())]))))
        return out

    fields = ["lang", "score", *["spans"] * spans]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(*shared.value)
        for whole in batches:
            parts = [pa.StructArray.from_arrays(label_texts(scorer, p.column(0)), fields) for p in pieces([pa.RecordBatch.from_arrays([whole], ["text"])], "text", limit)]
            yield pa.concat_arrays(parts)

    kind = "struct<lang: string, score: double" + ", spans: array<struct<lang: string, first: int, end: int>>" * spans + ">"
    if langs:  # only texts travel to Python; the other columns stay where they are
        found = F.arrow_udf(run, kind).asNondeterministic()(utf8(F.col("text")))
    else:
        found = F.struct(F.lit("und").alias("lang"), F.lit(0.0).alias("score"), *([F.array().cast("array<struct<lang: string, first: int, end: int>>").alias("spans")] if spans else []))
    rows = docs.select(*(F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(columns)), found.alias("_r"))
    return rows.select(*(f"_c{i}" for i in range(len(columns))), *(F.col(f"_r.{n}").alias(f"_{n}") for n in fields))


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """``docs`` without the texts that have no letter, or of whose letters no language holds the share ``least``."""
    found = _identified(docs, fit(docs), docs.columns, False).filter((F.col("_lang") != "und") & (F.col("_score") >= least))
    return found.select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)))


def digest(docs: DataFrame) -> DataFrame:
    """Columns of the registered query."""
    found = identify(docs, fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
