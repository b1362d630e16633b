"""Arriving files: new plates into the curated table, and running cell counts per well."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from platelens.sources.plates import _fs, list_directory, parse_lines

COMPACT = 64  # triggers


def checkpoint_root(spark: SparkSession, fallback: str | None = None) -> str:
    """The cluster's shared checkpoint folder; the fallback is used only where the setting is absent."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or fallback
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    return folder.rstrip("/")


def stream_plate_text(spark: SparkSession, glob: str, header: Sequence[str], files_per_trigger: int = 1000) -> DataFrame:
    """Cells from arriving measurement files with one header; the same line parser as the batch reader."""
    lines = (spark.readStream.format("text").schema("value string").option("maxFilesPerTrigger", files_per_trigger)
             .load(glob).select("value", F.col("_metadata.file_path").alias("_path")))
    return parse_lines(lines, header, F.col("_path"))


def ingest_new_plates(cells: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append the cells of files not seen before to parquet partitioned by plate, then stop."""
    return (cells.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
            .partitionBy("PlateID").trigger(availableNow=True).outputMode("append").start())


def running_counts(cells: DataFrame, key: str = "ID") -> DataFrame:
    """Cells per well so far; combined on the map side, one state row per well."""
    return cells.groupBy(key).agg(F.count(F.lit(1)).alias("NCells"))


def save_changes(batch: DataFrame, number: int, target: str, key: str = "ID") -> None:
    """The changed counts of a trigger, in a folder of the trigger's own: a repeated trigger writes the same rows to the same
    folder and changes nothing. Every ``COMPACT`` triggers all counts are merged into a base, and what the base before it
    held is removed (a reader that began with that one is done by then)."""
    spark = batch.sparkSession
    batch.write.mode("overwrite").parquet(f"{target}/batch={number:012d}")
    if (number + 1) % COMPACT:
        return
    before = _whole(spark, target, "base")
    _merged(spark, target, key, number).write.mode("overwrite").parquet(f"{target}/base={number:012d}")
    for folder, n in _whole(spark, target, "batch") + before[:-1]:
        if before and n <= before[-1][1] and n < number:
            fs, path = _fs(spark, folder)
            fs.delete(path, True)


def counts_to_table(counts: DataFrame, target: str, checkpoint: str, key: str = "ID") -> StreamingQuery:
    """Counts kept up to date: a trigger writes the wells that changed, with their new totals. Files that come late count
    when they come (there is no watermark); a file that was counted is not counted again, however often the query is started.
    Read it with :func:`latest_counts`."""
    return (counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).foreachBatch(lambda batch, number: save_changes(batch, number, target, key)).start())


def _whole(spark: SparkSession, target: str, kind: str) -> list[tuple[str, int]]:
    """Folders of a kind that were written whole, by number."""
    found = [v for v in list_directory(spark, target) if v.rsplit("/", 1)[-1].startswith(f"{kind}=")]
    whole = [v for v in found if any(e.endswith("/_SUCCESS") for e in list_directory(spark, v))]
    return sorted(((f"{target}/{v.rsplit('/', 1)[-1]}", int(v.rsplit("=", 1)[-1])) for v in whole), key=lambda x: x[1])


def _merged(spark: SparkSession, target: str, key: str, upto: int | None = None) -> DataFrame:
    """The newest total of every well: the last base and the changes after it."""
    base = [x for x in _whole(spark, target, "base") if upto is None or x[1] <= upto][-1:]
    changes = [x for x in _whole(spark, target, "batch") if (not base or x[1] > base[-1][1]) and (upto is None or x[1] <= upto)]
    if not base + changes:
        raise FileNotFoundError(f"no counts in {target}")
    rows = None
    for kind, folders in (("base", base), ("batch", changes)):
        if folders:
            part = spark.read.option("basePath", target).parquet(*[f for f, _ in folders]).withColumnRenamed(kind, "_number")
            rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(key).agg(F.max_by("NCells", "_number").alias("NCells"))


def latest_counts(spark: SparkSession, target: str, key: str = "ID") -> DataFrame:
    """The newest counts that were written whole."""
    return _merged(spark, target, key)
