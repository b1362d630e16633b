"""Curated cells: parquet partitioned by plate, filled incrementally, read with partition pruning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platelens.sources import plates as files


class CuratedCells:
    """``<folder>/cells/PlateID=.../``. Each plate is parsed from text once."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    @property
    def path(self) -> str:
        return f"{self.folder}/cells"

    def stored_plates(self) -> set[str]:
        names = (e.rsplit("/", 1)[-1] for e in files.list_directory(self.spark, self.path))
        return {n.removeprefix("PlateID=") for n in names if n.startswith("PlateID=")}

    def ingest(self, plates: Sequence[str], params: dict) -> list[str]:
        """Parse plates that are not stored yet. Repeats after a failure replace the plate's partition as a whole."""
        stored = self.stored_plates()
        new = [p for p in plates if files.plate_id(p) not in stored]
        if new:
            cells = files.read_measurements(self.spark, new, params)
            (cells.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("PlateID").parquet(self.path))
        return new

    def read(self, plate_ids: Sequence[str] | None = None) -> DataFrame:
        """Cells of the named plates; plates differ in their columns, so schemas are merged."""
        cells = self.spark.read.option("mergeSchema", True).option("basePath", self.path)
        if plate_ids is None:
            return cells.parquet(self.path).withColumn("PlateID", F.col("PlateID").cast("string"))
        paths = [f"{self.path}/PlateID={p}" for p in plate_ids]
        return cells.parquet(*paths).withColumn("PlateID", F.col("PlateID").cast("string"))
