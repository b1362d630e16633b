"""Removal of repeated passages by suffix automata over shards of reference passages.

A window is ``SPAN`` consecutive words of one document. A word goes when a window that covers it also starts in a
document of smaller ``doc_id``; windows are judged on the input. The result is exact:

1. Every window has an anchor, the smallest hash among its runs of ``GRAM`` words (leftmost on ties), so equal windows
   have equal anchors. Consecutive windows with the same anchor form a run, a passage of ``SPAN`` words or more. Only
   hashes travel: of the anchor and of the passage.
2. A passage that occurs as a whole in a smaller document goes as a whole; that needs no words. Left are the first
   documents of passages whose anchor has other passages beside them.
3. These reference passages are sharded by anchor. Each shard gets a suffix automaton whose states carry the smallest
   document in which they end. The passages are streamed through it: the state of the match, cut back to ``SPAN`` words,
   tells whether the window ends in a smaller document. Maximal spans of such windows are removed.

An automaton holds at most ``SHARD`` passages. Shards are not broadcast, for together they grow with the input: each
goes to the one task that streams its passages. An anchor found more often (a common line in many surroundings) is split
further, into a shard for each single window, where the automaton is one path and the smallest document a minimum.

Words are unchanged, white space is ASCII. A null text has no words. Rows without ``doc_id`` are compared with nothing
and stay whole; rows that repeat an id and a text are one document. Fewer words than a window: nothing goes. An empty
table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platelens.llm.common import byte_column, hash_words, mix, pieces, split_words, stored, utf8

SPAN = 50
GRAM = 10
SHARD = 2000
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def range_hashes(words: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A hash of words[lo:hi] for each pair."""
    n = len(words)
    power = np.cumprod(np.r_[np.uint64(1), np.full(n, BASE, dtype=np.uint64)])
    back = np.cumprod(np.r_[np.uint64(1), np.full(n, INVERSE, dtype=np.uint64)])
    prefix = np.r_[np.uint64(0), np.cumsum(words * power[:n], dtype=np.uint64)]
    return mix((prefix[hi] - prefix[lo]) * back[lo] + (hi - lo).astype(np.uint64))


def sliding_argmin(value: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest of ``width`` consecutive values, leftmost on ties, for each start."""
    place, reach = np.arange(len(value)), 1
    while reach < width:
        step = min(reach, width - reach)
        a, b = place[:-step], place[step:]
        place = np.where(value[a] <= value[b], a, b)
        reach += step
    return place


def runs(words: np.ndarray, first: np.ndarray, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Text, first word (in ``words``), number of windows, anchor and passage hash of each run of windows."""
    none = np.zeros(0, dtype=np.int64)
    if len(words) < span:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    grams = range_hashes(words, at := np.arange(len(words) - gram + 1), at + gram)
    owner = sliding_argmin(grams, span - gram + 1)
    start = np.arange(len(owner))
    doc = np.searchsorted(first, start, side="right") - 1
    whole = np.flatnonzero(start + span <= first[doc + 1])
    if not len(whole):
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    new = np.flatnonzero(np.r_[True, (owner[whole[1:]] != owner[whole[:-1]]) | (doc[whole[1:]] != doc[whole[:-1]])])
    begin, count = whole[new], np.diff(np.r_[new, len(whole)])
    passage = range_hashes(words, begin, begin + count + span - 1)
    return doc[begin], begin, count, grams[owner[begin]], mix(passage ^ (owner[begin] - begin).astype(np.uint64))


def automaton(passages: list[list[int]], marks: list[int]) -> tuple[list[dict[int, int]], list[int], list[int], list[int]]:
    """Suffix automaton of all passages: moves, suffix links, longest lengths, and the smallest mark that ends in a state."""
    move: list[dict[int, int]] = [{}]
    link, longest, least = [-1], [0], [min(marks)]
    top = max(marks) + 1

    def state(length: int, moves: dict[int, int], up: int) -> int:
        move.append(moves)
        longest.append(length)
        link.append(up)
        least.append(top)
        return len(move) - 1

    for passage, mark in zip(passages, marks, strict=True):
        last = 0
        for word in passage:
            at = move[last].get(word)
            if at is not None and longest[at] == longest[last] + 1:
                last = at
            else:
                here = -1 if at is not None else state(longest[last] + 1, {}, 0)
                p = last
                while p >= 0 and word not in move[p]:
                    move[p][word] = here
                    p = link[p]
                if p >= 0:
                    q = move[p][word]
                    if longest[q] != longest[p] + 1:
                        split = state(longest[p] + 1, dict(move[q]), link[q])
                        link[q] = split
                        while p >= 0 and move[p].get(word) == q:
                            move[p][word] = split
                            p = link[p]
                        q = split
                    if here >= 0:
                        link[here] = q
                    else:
                        here = q
                last = here
            least[last] = min(least[last], mark)
    for s in sorted(range(1, len(move)), key=longest.__getitem__, reverse=True):
        least[link[s]] = min(least[link[s]], least[s])
    return move, link, longest, least


def covered(passages: list[list[int]], marks: list[int], span: int = SPAN) -> list[list[tuple[int, int]]]:
    """For each passage the runs (first window, number of windows) that also end in a passage of smaller mark."""
    move, link, longest, least = automaton(passages, marks)
    out = []
    for passage, mark in zip(passages, marks, strict=True):
        at, found = 0, []
        for i, word in enumerate(passage):
            at = move[at][word]
            while longest[link[at]] >= span:
                at = link[at]
            if i + 1 >= span and least[at] < mark:
                w = i + 1 - span
                if found and found[-1][0] + found[-1][1] == w:
                    found[-1] = (found[-1][0], found[-1][1] + 1)
                else:
                    found.append((w, 1))
        out.append(found)
    return out


def _words(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    data, at = byte_column(batch.column(column))
    starts, ends, first = split_words(data, at)
    return hash_words(data, starts, ends), first


def _find_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        words, first = _words(batch, "text")
        doc, begin, count, anchor, passage = runs(words, first)
        own = batch.select(["doc_id", "row"]).take(pa.array(doc))
        cols = [own.column("doc_id"), own.column("row"), pa.array((begin - first[doc]).astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(passage.view(np.int64))]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "row", "first", "n", "anchor", "passage"])


def _cut_passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of the wanted passages; of a split anchor, the hash of every window instead."""
    for batch in pieces(batches, "text"):
        words, first = _words(batch, "text")
        rows: list[tuple] = []
        for i, (doc_id, row, wanted) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), batch.column("wanted").to_pylist(), strict=True)):
            for w in wanted:
                lo = first[i] + w["first"]
                if not w["split"]:
                    rows.append((w["anchor"], doc_id, row, w["first"], words[lo : lo + w["n"] + SPAN - 1].tobytes()))
                    continue
                at = np.arange(w["n"])
                own = words[lo : lo + w["n"] + SPAN - 1]
                for k, h in enumerate(range_hashes(own, at, at + SPAN).view(np.int64).tolist()):
                    rows.append((h, doc_id, row, w["first"] + k, None))
        cols = list(zip(*rows, strict=True)) if rows else [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["shard", "doc_id", "row", "first", "words"])


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Covered windows of whole shards (rows come sorted by shard)."""
    held: list[tuple[int, int, int, int, bytes]] = []

    def flush() -> list[tuple[int, int, int]]:
        if len(held) < 2:
            return []
        local: dict[int, int] = {}
        texts = [[local.setdefault(w, len(local)) for w in np.frombuffer(x[4], dtype=np.int64).tolist()] for x in held]
        return [(x[2], x[3] + a, n) for x, spans in zip(held, covered(texts, [x[1] for x in held]), strict=True) for a, n in spans]

    out: list[tuple[int, int, int]] = []
    for batch in batches:
        for x in zip(*(batch.column(c).to_pylist() for c in ("shard", "doc_id", "row", "first", "words")), strict=True):
            if held and held[0][0] != x[0]:
                out += flush()
                held = []
            held.append(x)
        if len(out) > 20_000:
            yield _spans(out)
            out = []
    yield _spans(out + flush())


def _spans(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int32()), strict=True)], ["row", "first", "n"])


def repeated(docs: DataFrame) -> DataFrame:
    """Covered windows: ``row`` (hash of id and text), ``first`` (word) and ``n`` (windows in a row)."""
    own = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row"), utf8(F.col("text")).alias("text"))
    found = own.mapInArrow(_find_runs, "doc_id long, row long, first int, n int, anchor long, passage long")  # cheaper again than kept
    anchors = found.groupBy("anchor").agg(
        F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), (F.min("passage") != F.max("passage")).alias("mixed"), (F.count(F.lit(1)) > SHARD).alias("split"),
    )
    # stored, so that AQE can split the partition of a hot anchor or passage in the joins
    shared = stored(found.join(stored(anchors.filter("a < b").select("anchor", "mixed", "split")), "anchor"))
    passages = stored(shared.groupBy("anchor", "passage").agg(F.min("doc_id").alias("least")))
    known = shared.join(passages, ["anchor", "passage"])
    whole = known.filter("doc_id > least").select("row", "first", "n")
    wanted = known.filter("doc_id = least and mixed").dropDuplicates(["row", "anchor", "first"])
    by_row = wanted.groupBy("row").agg(F.collect_list(F.struct("anchor", "first", "n", "split")).alias("wanted"))
    cut = stored(own.join(by_row, "row").select("doc_id", "row", "text", "wanted").mapInArrow(_cut_passages, "shard long, doc_id long, row long, first int, words binary"))
    single = cut.filter("words is null").select("shard", "doc_id", "row", "first")
    least = single.groupBy("shard").agg(F.min("doc_id").alias("least"))
    alone = single.join(least, "shard").filter("doc_id > least").select("row", "first", F.lit(1).alias("n"))
    streamed = cut.filter("words is not null").repartition("shard").sortWithinPartitions("shard", "doc_id").mapInArrow(_stream, "row long, first int, n int")
    return whole.union(alone).union(streamed)


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        data, at = byte_column(batch.column("text"))
        kept, words, gone = [], [], []
        for i, spans in enumerate(batch.column("spans").to_pylist()):
            own = data[at[i] : at[i + 1]].tobytes().split()
            words.append(len(own))
            if spans:
                edge = np.zeros(len(own) + 1, dtype=np.int64)
                for s in spans:
                    edge[s["first"]] += 1
                    edge[s["first"] + s["n"] + SPAN - 1] -= 1
                own = [own[j] for j in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
            gone.append(words[-1] - len(own))
            kept.append(b" ".join(own).decode())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])


def remove_repeated(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed`` and ``kept`` (the words left, one space apart) of every row."""
    spans = repeated(docs).groupBy("row").agg(F.collect_set(F.struct("first", "n")).alias("spans"))
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), utf8(F.col("text")).alias("text"))
    put = rows.join(spans, "row", "left").select("doc_id", "text", F.when(F.col("doc_id").isNotNull(), F.col("spans")).alias("spans"))
    return put.mapInArrow(_keep, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept string")


def digest(docs: DataFrame) -> DataFrame:
    """Columns of the registered query."""
    return remove_repeated(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
w AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(words, i, i + {SPAN - 1}), ' ')) AS window_hash
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - {SPAN - 2})) AS i FROM d WHERE len(words) >= {SPAN})),
f AS (SELECT window_hash, min(doc_id) AS least FROM w GROUP BY window_hash HAVING count(*) > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + {SPAN})) AS i FROM w JOIN f USING (window_hash) WHERE doc_id > least),
g AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id),
k AS (
  SELECT d.doc_id, len(words) AS n_words, coalesce(len(gone), 0) AS n_removed,
         list_transform(list_filter(range(1, len(words) + 1), lambda i: gone IS NULL OR NOT list_contains(gone, i)), lambda i: words[i]) AS kept
  FROM d LEFT JOIN g USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k
"""
