"""Sharding by longest processing time: groups that must stay together, largest first, each to the least loaded shard.

Law ``bytes``: shard sizes come out near equal. Groups are equal texts (by their 64-bit hash; null counts as empty), so
copies share a shard. Scheduling goes through a heap on the driver, over a number of items that does not grow: a group
of at least one part in ``ITEMS`` of all bytes is an item of its own (there are at most ``ITEMS`` such groups); smaller
ones are dealt by hash into ``ITEMS`` bins, each an item. A shard is then off by about one item at most, unless one
group alone is larger than a shard's share.

Slots are gapless from 0 in every shard: rows are numbered inside ``BUCKETS`` hash buckets of a shard, and each bucket
starts where the one before ended. Rows that repeat get slots of their own. An empty table gives an empty result; extra
columns are not read.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platelens.llm.common import stored

SHARDS = 8
ITEMS = 1 << 16
BUCKETS = 1024


def least_loaded(items: pd.DataFrame, shards: int) -> list[int]:
    """Shard of each item (columns ``size``, ``big``, ``item``): largest first, ties by key, to the smallest load."""
    order = items.sort_values(["size", "big", "item"], ascending=[False, True, True]).index
    heap = [(0, s) for s in range(shards)]
    out = [0] * len(items)
    for i, size in zip(order, items["size"].loc[order].tolist(), strict=True):
        load, s = heapq.heappop(heap)
        out[i] = s
        heapq.heappush(heap, (load + size, s))
    return out


def shard_documents(docs: DataFrame, shards: int = SHARDS, items: int = ITEMS, buckets: int = BUCKETS) -> DataFrame:
    """``doc_id``, ``size`` (UTF-8 bytes plus 1), ``text_crc32``, ``shard`` and ``slot`` of every row."""
    text = F.coalesce("text", F.lit(""))
    rows = stored(docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("group"),
    ))
    total = rows.agg(F.sum("size")).first()[0] or 0
    groups = rows.groupBy("group").agg(F.sum("size").alias("size"))
    big = F.col("size") * items >= total
    bins = groups.filter(~big).groupBy(F.pmod("group", F.lit(items)).alias("item")).agg(F.sum("size").alias("size"))
    found = groups.filter(big).select(F.lit(True).alias("big"), F.col("group").alias("item"), "size").union(bins.select(F.lit(False), "item", "size"))
    table = found.toPandas()  # at most 2 x items rows
    table["shard"] = least_loaded(table, shards)
    placed = rows.sparkSession.createDataFrame(
        list(zip(table["big"].tolist(), table["item"].tolist(), table["shard"].tolist(), strict=True)), "big boolean, item long, shard int"
    )
    own = placed.filter("big").select(F.col("item").alias("group"), F.col("shard").alias("own"))
    shared = placed.filter("not big").select("item", F.col("shard").alias("shared"))
    put = (
        rows.join(F.broadcast(own), "group", "left").withColumn("item", F.pmod("group", F.lit(items)))
        .join(F.broadcast(shared), "item", "left").withColumn("shard", F.coalesce("own", "shared"))
        .withColumn("bucket", F.pmod(F.xxhash64("doc_id", "group", "text_crc32"), F.lit(buckets)))
        .select("doc_id", "size", "text_crc32", "group", "shard", "bucket")
    )
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = put.groupBy("shard", "bucket").count().select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    inside = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "group"))
    return (  # ``first`` has shards x buckets rows
        put.withColumn("inside", inside).join(F.broadcast(first), ["shard", "bucket"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("inside") - 1).alias("slot"))
    )


def digest(docs: DataFrame) -> DataFrame:
    """Columns of the registered query."""
    return shard_documents(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
