"""Ranked lexical search against plain Python and SQL, in one and in several shards, on odd rows."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from platelens.llm import lexical

DOCS, ITEMS = "doc_id long, text string, lang string", "item_id long, text string"
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return re.findall("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+", (text or "").translate(LOWER))


def plain(docs, items, k=10):
    bags = [(d[0], Counter(terms(d[1]))) for d in docs]
    bags = [(d, b) for d, b in bags if b]
    count, length, df = len(bags), sum(sum(b.values()) for _, b in bags), Counter(t for _, b in bags for t in b)
    out = []
    for item in {i[0] for i in items}:
        asked = {t for i in items if i[0] == item for t in terms(i[1])}
        scored = []
        for d, b in bags:
            m = 10 + 90 * sum(b.values()) * count // length
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t in asked if t in b)
            scored += [(-score, d is None, d or 0, d)] if score > 0 else []
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return Counter(out)


def odd_rows():
    rng = random.Random(3)
    words = ["the", "The", "house", "Éa", "éa", "r2d2", "x_y", "дом", "a-b", "tree", "\u2028", "0", "z" * 300, "ſ", "İ"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(30))), "en") for i in range(150)]
    docs += [(1000 + i % 40, "the house and the tree", None) for i in range(300)]  # a class of many, ids that repeat
    docs += [(None, "the house and the tree", "en"), (5, None, None), (None, None, "en"), (6, "", "en"), (7, " .,;\x00 ", "en"), (8, "house " * 40_000, "en"), (9, "tree, " + "w1 w2 w3 " * 20_000, "en")]
    items = [(0, "The house of éa"), (1, "x y TREE?"), (2, None), (3, "..."), (4, "nowhere"), (None, "дом r2d2"), (5, "tree tree house"), (5, "z" * 300), (6, "ſ İ 0"), (7, "w3 house")]
    return docs, items


@pytest.mark.parametrize("shard", [lexical.SHARD, 20])
def test_lexical_on_odd_rows(spark, shard, monkeypatch):
    monkeypatch.setattr(lexical, "SCORES", 64)  # blocks of a few classes
    docs, items = odd_rows()
    clash = [F.lit("clash").alias(c) for c in ("n", "m", "terms", "tf", "score", "rank", "members", "item_id")]
    left = spark.createDataFrame(docs, DOCS).select("*", *clash).repartition(5)
    right = spark.createDataFrame(items, ITEMS).select("*", F.lit(1).alias("doc_id"))
    got = lexical.search(left, right, shard=shard)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == plain(docs, items)


def test_lexical_equals_sql_on_odd_rows(spark):
    docs, items = odd_rows()
    items = [i for i in items if i[0] is not None]
    con = duckdb.connect()
    con.register("documents", spark.createDataFrame(docs, DOCS).toArrow())
    con.register("benchmark", spark.createDataFrame(items, ITEMS).toArrow())
    rel = con.execute(lexical.SQL)
    names = [d[0] for d in rel.description]
    want = Counter(tuple(r[names.index(c)] for c in ("item_id", "rank", "doc_id", "score")) for r in rel.fetchall())
    assert want == plain(docs, items)


def test_lexical_of_empty_tables(spark):
    docs, items = odd_rows()
    assert lexical.search(spark.createDataFrame([], DOCS), spark.createDataFrame(items, ITEMS)).count() == 0
    assert lexical.search(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], ITEMS)).count() == 0


def test_words_with_a_known_hash_are_verified():
    v = lexical.Vocabulary(np.zeros(0, dtype=np.uint64), *(np.zeros(0, dtype=np.int64),) * 6)
    assert v.find(np.frombuffer(b"a", dtype=np.uint8), np.array([0]), np.array([1])).tolist() == [-1]
    import pyarrow as pa

    v = lexical.vocabulary(pa.array([1]), pa.array([b"house"]))
    data = np.frombuffer(b"house mouse", dtype=np.uint8)
    v.data = np.frombuffer(b"horse", dtype=np.uint8)  # another word under the same hash
    assert v.find(data, np.array([0, 6]), np.array([5, 11])).tolist() == [-1, -1]
