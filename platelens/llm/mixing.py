"""Mixing sources to target weights through a multivariate-hypergeometric splitting tree.

Every source is dealt by hash into ``BLOCKS`` blocks. Its target in words is met exactly: whole passes over all blocks,
then blocks in a seeded order, the last one document by document, and the last document in part. That fixes how many
block draws each source owes. The tree hands these quotas to the output shards: at each node the draws of the left half
are one multivariate-hypergeometric sample of the draws of all sources, so shards are exact random parts of one mix and
no shard needs to know another. Each shard then takes the next blocks of each source's seeded order, so no draw falls to
two shards, and orders its documents by a hash.

Only sums by source and block reach the driver: ``TABLE`` rows at most, so many sources have fewer blocks each (one at
least; more than ``TABLE`` sources are refused before anything is collected). Only the block in which a source's target falls is put in order by document.

Targets: the shared words (``SHARE`` of all) go by weight; a target stops at ``LIMIT`` times its source's size, and the
excess is shared again by weight until none is above. Sources are weighed in code-point order, null last. A null text
has no words; documents without words are in blocks like any other and take nothing. Rows that repeat are drawn each
for itself. An empty table gives an empty result. Extra columns are carried by ``mixed`` and not read otherwise.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platelens.llm.common import WORD, stored, words_of

WEIGHTS = (3, 1, 2)
SHARE = 1.5
LIMIT = 2.0
BLOCKS = 1024
SHARDS = 8
TABLE = 1 << 20
#: Words of a shard that are put in order in one task, or so.
PART_WORDS = 8 << 20
SEED = 42


def targets(sizes: Sequence[int], weights: Sequence[float], share: float = SHARE, limit: float = LIMIT) -> list[float]:
    """Words due from each source."""
    out, open_ = [0.0] * len(sizes), list(range(len(sizes)))
    left = share * sum(sizes)
    while open_:
        weight = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / weight > limit * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / weight
            break
        for i in over:
            out[i] = limit * sizes[i]
            left -= out[i]
        open_ = [i for i in open_ if i not in set(over)]
    return out


def split_quotas(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Draws of each source (columns) that fall to each shard (rows): halves of the shards, recursively."""
    if shards == 1:
        return quotas[None, :]
    left = shards // 2
    part = rng.multivariate_hypergeometric(quotas, int(quotas.sum()) * left // shards, method="marginals")
    return np.vstack([split_quotas(part, left, rng), split_quotas(quotas - part, shards - left, rng)])


def plan(docs: DataFrame, carry: bool = False, keep: bool = True, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
         limit: float = LIMIT, blocks: int = BLOCKS, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Every row of ``docs`` as ``doc_id``, ``size``, ``source_size``, ``target``, and ``draws``: an array of (shard,
    words), one for each time that the document is taken. ``carry``: with ``_row``, a struct of all columns of ``docs``.
    ``keep``: store the rows between passes."""
    carried = ["_row"] if carry else []
    named = F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit("+"), "source"))
    count = docs.select(named.alias("_s")).distinct().count()
    if count > TABLE:
        raise ValueError(f"{count} sources; at most {TABLE} can be mixed")
    blocks = max(1, min(blocks, TABLE // max(count, 1)))
    rows = docs.select(
        "doc_id", *([F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")] if carry else []), named.alias("_s"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit(""))), F.lit(str(seed)))).alias("_k"),
    ).withColumn("_b", F.pmod(F.conv(F.substring("_k", 1, 8), 16, 10).cast("long"), F.lit(blocks)).cast("int"))
    rows = stored(rows) if keep else rows
    spark = docs.sparkSession
    sums = rows.groupBy("_s", "_b").agg(F.sum("size").alias("size"))
    table: dict[str, np.ndarray] = {}
    for s, b, size in sums.toPandas().itertuples(index=False):
        table.setdefault(s, np.zeros(blocks, dtype=np.int64))[b] = size
    names = sorted((s for s in table if s != "-")) + (["-"] if "-" in table else [])
    sizes = [int(table[s].sum()) for s in names]
    due = targets(sizes, [weights[i % len(weights)] for i in range(len(names))], share, limit)

    rng = np.random.default_rng(seed)
    listed: list[list[tuple[int, int]]] = []  # by source: (block, words of the draw, -1 for all)
    for s, size, target in zip(names, sizes, due, strict=True):
        rest, own = math.floor(target + 0.5), []
        while size and rest >= size:
            own += [(int(b), -1) for b in rng.permutation(blocks)]
            rest -= size
        for b in sorted(range(blocks), key=lambda b: hashlib.md5(f"{s}|{b}|{seed}".encode()).hexdigest()) if rest else ():
            own.append((b, -1 if table[s][b] <= rest else rest))
            rest -= min(rest, int(table[s][b]))
            if rest == 0:
                break
        listed.append(own)
    out, at = [], [0] * len(names)
    if names:
        quota = split_quotas(np.array([len(x) for x in listed], dtype=np.int64), shards, rng)
        for shard in range(shards):
            for i, n in enumerate(quota[shard].tolist()):
                out += [(names[i], b, shard, w) for b, w in listed[i][at[i] : at[i] + n]]
                at[i] += n
    by_block: dict[tuple[str, int], tuple[list[int], list[tuple[int, int]]]] = {(s, b): ([], []) for s in names for b in np.flatnonzero(np.ones(blocks)).tolist()}
    for s, b, shard, w in out:
        by_block[s, b][w >= 0].append((shard, w) if w >= 0 else shard)
    info = dict(zip(names, zip(sizes, due, strict=True), strict=True))
    drawn = spark.createDataFrame(
        [(s, b, *info[s], sorted(whole), *(cut[0] if cut else (None, None))) for (s, b), (whole, cut) in by_block.items()],
        "_s string, _b int, source_size long, target double, _whole array<int>, _shard int, _words long",
    )
    put = rows.join(F.broadcast(drawn), ["_s", "_b"])  # ``TABLE`` rows at most
    whole = F.transform("_whole", lambda s: F.struct(s.alias("shard"), F.col("size").alias("words")))
    plain = put.filter("_shard is null").withColumn("draws", whole)
    last = put.filter("_shard is not null")  # one block of a source at most
    before = F.sum("size").over(Window.partitionBy("_s").orderBy("_k", "doc_id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_words") - before)).cast("long")
    last = last.withColumn("_part", part).withColumn("draws", F.when(F.col("_part") > 0, F.concat(whole, F.array(F.struct(F.col("_shard").alias("shard"), F.col("_part").alias("words"))))).otherwise(whole))
    parts = F.lit(max(64, math.ceil(sum(due) / shards / PART_WORDS))).alias("_parts")
    return plain.unionByName(last.drop("_part")).select("doc_id", *carried, "size", "source_size", "target", "draws", "_k", parts)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: columns of ``docs`` and ``mix_shard``, a row for each draw, in the order of the mix inside every
    shard. A draw of part of a document holds its first words, one space apart. A column of that name in ``docs`` gives way."""
    drawn = plan(docs, carry=True, keep=False, **options).select("_row", "size", "_k", "_parts", F.posexplode("draws").alias("_n", "_d"))
    cut = F.col("_d.words") < F.col("size")
    first = F.array_join(F.slice(words_of(F.col("_row.text")), F.lit(1), F.col("_d.words").cast("int")), " ")
    fresh = {"text": F.when(cut, first).otherwise(F.col("_row.text"))}
    if "n_chars" in docs.columns:
        fresh["n_chars"] = F.when(cut, F.length(first).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row.n_chars"))
    keep = [c for c in docs.columns if c != "mix_shard"]
    order = F.xxhash64("_k", "_n")
    rows = drawn.repartition(F.col("_d.shard"), F.pmod(order, F.col("_parts"))).sortWithinPartitions(F.col("_d.shard"), order)
    return rows.select(*(fresh.get(c, F.col(f"_row.`{c}`")).alias(c) for c in keep), F.col("_d.shard").alias("mix_shard"))


def digest(docs: DataFrame) -> DataFrame:
    """Columns of the registered query: ``taken`` sums the words of all draws of a document."""
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"])
    return plan(docs).select("doc_id", "size", "source_size", "target", taken.alias("taken"))


SQL = f"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '-' ELSE '+' || source END AS s,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         md5(coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, '')) || '|{SEED}') AS k
  FROM documents),
r AS (SELECT *, ('0x' || substr(k, 1, 8))::BIGINT % greatest(1, least({BLOCKS}, {TABLE} // (SELECT count(DISTINCT s) FROM d))) AS b FROM d),
w AS (
  SELECT s, sum(size)::BIGINT AS source_size, [3, 1, 2][1 + (row_number() OVER (ORDER BY s = '-', s) - 1) % 3] AS weight
  FROM r GROUP BY s),
o AS (
  SELECT *, 1.5 * sum(source_size) OVER ()
            - coalesce(sum(2.0 * source_size) OVER (ORDER BY 2.0 * source_size / weight, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS words,
         sum(weight) OVER (ORDER BY 2.0 * source_size / weight, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
  FROM w),
f AS (SELECT *, words * weight / weights > 2.0 * source_size AS over FROM o),
l AS (SELECT arg_min(words, source_size * 2.0 / weight) AS words, max(weights) AS weights FROM f WHERE NOT over),
t AS (SELECT s, source_size, CASE WHEN over THEN 2.0 * source_size ELSE (l.words * weight / l.weights) END::DOUBLE AS target FROM f LEFT JOIN l ON true),
e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS passes,
         CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT % source_size ELSE 0 END AS rest
  FROM t),
n AS (SELECT s, b, sum(size) AS size FROM r GROUP BY s, b),
c AS (SELECT s, b, coalesce(sum(size) OVER (PARTITION BY s ORDER BY md5(s || '|' || b || '|{SEED}') ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n),
q AS (
  SELECT r.*, c.before + coalesce(sum(r.size) OVER (PARTITION BY r.s, r.b ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM r JOIN c USING (s, b))
SELECT doc_id, size::BIGINT AS size, source_size, target, (passes * size + greatest(0, least(size, rest - before)))::BIGINT AS taken
FROM q JOIN e USING (s)
"""
