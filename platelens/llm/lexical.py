"""Ranked lexical search: every document scored for every item, equal bags of words once.

Documents are restricted to the vocabulary of the items: a document is the vector of its counts of those terms, and a
length norm ``m``. Documents with equal vectors and norm are one class (named by a hash, told apart by the vectors
themselves); a class is scored once and stands for its members, of which the smallest ids are enough for a list of ``k``.

Terms are runs of letters and digits in ASCII and of all other characters, A-Z lower-cased. With N documents that hold
a term, L terms in all, n terms in a document and tf of one of them: the weight of a term is floor(1000 ln((2N + 2) /
(2df + 1))), m = 10 + 90 n N div L, and a score sums weight * (10^9 tf div (1000 tf + 8 m)) over the distinct terms of an item.
Sums stay below 2^53, so doubles hold them exactly (checked).

On Spark: one pass makes vectors; N and L, then the counts of documents by term, are aggregates over all documents. Classes
keep their ``k`` smallest ids by a ranked limit that works before the shuffle too, so a hot class costs k rows a task. A
task scores its classes in blocks against the items' posting lists and keeps the best ``k`` classes of each item; the lists
of all tasks meet at the end. The items are broadcast in shards of ``SHARD`` bytes, one round of the above each, so
documents are read again for each shard, and items have no limit.

Null and empty texts hold no term and are found by nothing. Long texts are documents like any other, read whole. Rows that
repeat are documents each; ties go by ascending ``doc_id``, null last. Rows with one ``item_id`` are one item with the
terms of all of them; null is an id. An item without a term, or an empty table, gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platelens.llm.common import byte_column, hash_words, pieces, ranges, split_words, stored, utf8

#: Bytes of item texts that are broadcast at once.
SHARD = 8 << 20
#: Bytes of text that a task works on at once.
TEXT_BYTES = 1 << 20
#: Scores that a task holds at once (classes x items).
SCORES = 1 << 20
BETWEEN = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
LOWER = np.array([b | 0x20 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)


@dataclass
class Vocabulary:
    """Terms of the items in order of their hashes, their bytes, and the items that hold each."""

    hashes: np.ndarray
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    items: pa.Array
    first: np.ndarray  # postings of a term: holders[first[t] : first[t + 1]]
    holders: np.ndarray
    weights: np.ndarray | None = None

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The term that each word is, -1 for none: found by hash, verified by its bytes."""
        out = np.full(len(starts), -1, dtype=np.int64)
        if not len(self.hashes) or not len(starts):
            return out
        h = hash_words(data, starts, ends)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        size = ends - starts
        hit = np.flatnonzero((self.hashes[at] == h) & (size == self.ends[at] - self.starts[at]))
        at, n = at[hit], size[hit]
        place = ranges(n)
        unlike = data[np.repeat(starts[hit], n) + place] != self.data[np.repeat(self.starts[at], n) + place]
        out[hit] = at
        out[np.repeat(hit, n)[unlike]] = -1
        return out


def vocabulary(items: pa.Array, texts: pa.Array) -> Vocabulary:
    """Of item ids and their texts (binary)."""
    ids = items.dictionary_encode(null_encoding="encode")
    owner = ids.indices.to_numpy(zero_copy_only=False)
    data, at = byte_column(texts)
    data = LOWER[data]
    starts, ends, first = split_words(data, at, BETWEEN)
    words = [data[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    holds: dict[bytes, set[int]] = {}
    for word, item in zip(words, np.repeat(owner, np.diff(first)).tolist(), strict=True):
        holds.setdefault(word, set()).add(item)
    terms = list(holds)
    raw = np.frombuffer(b"".join(terms), dtype=np.uint8)
    edge = np.r_[0, np.cumsum([len(t) for t in terms])].astype(np.int64)
    hashes = hash_words(raw, edge[:-1], edge[1:])
    order = np.argsort(hashes)
    if len(np.unique(hashes)) < len(hashes):
        raise ValueError("two terms of the items share a hash")
    holders = [sorted(holds[terms[i]]) for i in order]
    return Vocabulary(hashes[order], raw, edge[:-1][order], edge[1:][order], ids.dictionary, np.r_[0, np.cumsum([len(x) for x in holders])].astype(np.int64),
                      np.array([i for x in holders for i in x], dtype=np.int64))


def bags(docs: DataFrame, vocab) -> DataFrame:
    """``doc_id``, ``n`` (its terms), ``terms`` (those of the vocabulary, ascending) and ``tf`` of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocab.value
        for batch in pieces(batches, "text", TEXT_BYTES):
            data, at = byte_column(batch.column("text"))
            data = LOWER[data]
            starts, ends, first = split_words(data, at, BETWEEN)
            n = np.diff(first)
            term = v.find(data, starts, ends)
            known = np.flatnonzero(term >= 0)
            wide = max(1, len(v.hashes))
            pair, tf = np.unique(np.repeat(np.arange(batch.num_rows), n)[known] * wide + term[known], return_counts=True)
            offsets = pa.array(np.searchsorted(pair, np.arange(batch.num_rows + 1) * wide).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (pair % wide, tf)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n.astype(np.int64)), *lists], ["doc_id", "n", "terms", "tf"])

    rows = docs.select("doc_id", utf8(F.col("text")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n long, terms array<int>, tf array<int>")


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def classes(bag: DataFrame, documents: int, length: int, k: int) -> DataFrame:
    """Documents of equal vectors and norm: ``terms``, ``tf``, ``m`` and ``members``, their ``k`` smallest ids in order."""
    m = F.lit(10) + F.expr(f"(90L * n * {documents}L) div {max(length, 1)}L")
    rows = bag.filter(F.size("terms") > 0).withColumn("m", m.cast("long")).withColumn("_h", F.xxhash64("terms", "tf", "m"))
    own = ["_h", "m", "terms", "tf"]
    order = F.struct(F.col("doc_id").isNull(), "doc_id")
    few = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*own).orderBy(F.col("doc_id").asc_nulls_last()))).filter(F.col("_n") <= k)
    ids = F.transform(F.sort_array(F.collect_list(order.alias("_o"))), lambda x: x["doc_id"])
    return few.groupBy(*own).agg(ids.alias("members")).drop("_h")


def block_scores(v: Vocabulary, of_class: np.ndarray, term: np.ndarray, tf: np.ndarray, m: np.ndarray, count: int) -> np.ndarray:
    """Scores (classes x items) of one block: entries (class, term, count) and the norm of each class."""
    value = v.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[of_class]))
    n = v.first[term + 1] - v.first[term]
    items = len(v.items)
    at = np.repeat(of_class * items, n) + v.holders[np.repeat(v.first[term], n) + ranges(n)]
    return np.bincount(at, np.repeat(value, n).astype(np.float64), count * items).astype(np.int64).reshape(count, items)


def best_classes(found: DataFrame, vocab, k: int, id_type: str, doc_type: str) -> DataFrame:
    """``item_id``, ``score`` and ``members`` of the best ``k`` classes of every item in each task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocab.value
        items = len(v.items)
        step = max(1, SCORES // max(1, items))
        held = [np.zeros(0, dtype=np.int64)] * 3  # item, score, class of those kept
        floor = np.zeros(items, dtype=np.int64)  # a lower score has k better ones
        members: dict[int, list] = {}
        number, kind = 0, None

        def least(c: int) -> tuple:
            d = members[c][0]
            return (d is None, d if d is not None else 0)

        for batch in batches:
            kind = batch.schema.field("members").type
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                lists = part.column("terms")
                size = np.diff(np.asarray(lists.offsets))
                of_class = np.repeat(np.arange(part.num_rows), size)
                term, tf = (np.asarray(part.column(c).flatten()).astype(np.int64) for c in ("terms", "tf"))
                score = block_scores(v, of_class, term, tf, np.asarray(part.column("m")).astype(np.int64), part.num_rows)
                c, i = np.nonzero((score > 0) & (score >= floor))
                if not len(c):
                    number += part.num_rows
                    continue
                own = part.column("members")
                members |= {number + x: own[x].as_py() for x in np.unique(c).tolist()}
                item, value, of = (np.concatenate([a, b]) for a, b in zip(held, (i, score[c, i], number + c), strict=True))
                number += part.num_rows
                rank = {x: r for r, x in enumerate(sorted(np.unique(of).tolist(), key=least))}
                tie = np.array([rank[x] for x in of.tolist()], dtype=np.int64)
                order = np.lexsort((tie, -value, item))
                item, value, of = item[order], value[order], of[order]
                start = np.flatnonzero(np.r_[True, item[1:] != item[:-1]])
                place = ranges(np.diff(np.r_[start, len(item)]))
                floor[item[place == k - 1]] = value[place == k - 1]
                held = [x[place < k] for x in (item, value, of)]
                members = {x: members[x] for x in np.unique(held[2]).tolist()}
        if len(held[0]):
            yield pa.RecordBatch.from_arrays([v.items.take(pa.array(held[0])), pa.array(held[1]), pa.array([members[x] for x in held[2].tolist()], kind)], ["item_id", "score", "members"])

    return found.mapInArrow(run, f"item_id {id_type}, score long, members array<{doc_type}>")


def search(docs: DataFrame, items: DataFrame, k: int = 10, shard: int = SHARD) -> DataFrame:
    """``item_id``, ``rank`` (from 1), ``doc_id`` and ``score`` of the best ``k`` documents of every item."""
    spark = docs.sparkSession
    asked = items.select("item_id", utf8(F.col("text")).alias("text"))
    shards = 1 + (asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // shard
    id_type, doc_type = asked.schema["item_id"].dataType.simpleString(), docs.schema["doc_id"].dataType.simpleString()
    totals, lists = None, []
    for s in range(shards):
        own = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == s).toArrow()  # ``shard`` bytes or so
        v = vocabulary(own.column("item_id").combine_chunks(), own.column("text").combine_chunks())
        bag = stored(bags(docs, spark.sparkContext.broadcast(v)))
        if totals is None:
            totals = bag.agg(F.count(F.when(F.col("n") > 0, 1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
        df = np.zeros(len(v.hashes), dtype=np.int64)
        for term, n in bag.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # the vocabulary at most
            df[term] = n
        v.weights = np.array([weight(totals["documents"], int(x)) for x in df], dtype=np.int64)
        if len(v.holders) and int(np.bincount(v.holders, v.weights[np.repeat(np.arange(len(df)), np.diff(v.first))]).max()) * 1_000_000 >= 1 << 53:
            raise ValueError("an item has too many terms for exact sums")
        found = classes(bag, totals["documents"], totals["length"], k)
        lists.append(best_classes(found, spark.sparkContext.broadcast(v), k, id_type, doc_type))
    best = lists[0]
    for more in lists[1:]:
        best = best.union(more)
    rows = best.select("item_id", "score", F.explode("members").alias("doc_id"))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


_UPPER, _LOWER = (bytes(range(a, a + 26)).decode() for a in (0x41, 0x61))
_TERMS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
SQL = f"""
WITH q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark)),
d AS (SELECT doc_id, row_number() OVER () AS id, {_TERMS} AS terms FROM documents),
t AS (SELECT count(*) FILTER (len(terms) > 0) AS N, sum(len(terms))::BIGINT AS L FROM d),
w AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY id, term),
f AS (SELECT term, floor(1000 * ln((2 * N + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS weight FROM (SELECT term, count(*) AS df FROM w GROUP BY term), t),
m AS (SELECT id, doc_id, 10 + ((90 * len(terms) * N) // L) AS m FROM d, t WHERE len(terms) > 0),
s AS (
  SELECT item_id, doc_id, id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM w JOIN f USING (term) JOIN m USING (id) JOIN q USING (term) GROUP BY item_id, doc_id, id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= 10
"""
