"""Loading screens: plate pruning by marker, union of plates, cell counts, removal of empty columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platelens.functions.sizing import join_bounded, kept
from platelens.operators.features import quoted
from platelens.sources import plates as files
from platelens.sources.curated import CuratedCells


def plates_with_marker(wells: DataFrame, antibody: str | Sequence[str]) -> DataFrame:
    """Plate ids with a well whose marker set matches the pattern (a list is joined by ``|``)."""
    if antibody is None:
        raise ValueError("no marker set named")
    pattern = antibody if isinstance(antibody, str) else "|".join(antibody)
    return wells.filter(F.col("Antibody").rlike(pattern)).select("PlateID").distinct()


def count_cells(wells: DataFrame, cells: DataFrame) -> DataFrame:
    """Wells that have cells, with ``NCells`` and ``Screen`` (the plate id up to its first dash)."""
    counts = cells.groupBy("ID").agg(F.count(F.lit(1)).alias("NCells"))
    return wells.join(counts, "ID").withColumn("Screen", F.split("ID", "-").getItem(0))


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Remove columns without any value; one pass counts all of them."""
    filled = df.agg(F.array(*[F.count(quoted(c)) for c in df.columns]).alias("n")).first()["n"]
    return df.select(*[quoted(c) for c, n in zip(df.columns, filled, strict=True) if n])


def well_profile(cells: DataFrame) -> DataFrame:
    """(ID, NCells, filled): cells of a well and how many of them have each column, from one pass over the cells; a row a
    well, kept."""
    return kept(cells.groupBy("ID").agg(F.count(F.lit(1)).alias("NCells"), F.array(*[F.count(quoted(c)) for c in cells.columns]).alias("filled")))


def filled_columns(cells: DataFrame, profile: DataFrame) -> DataFrame:
    """Columns that any cell has a value in, by the profile of the wells."""
    if not cells.columns:
        return cells
    filled = profile.agg(F.array(*[F.sum(F.col("filled")[i]) for i in range(len(cells.columns))]).alias("n")).first()["n"]
    return cells.select(*[quoted(c) for c, n in zip(cells.columns, filled, strict=True) if n])


class PlateLoader:
    """Plates of one or several screens, as named in the parameters.

    With ``curated`` set to a folder, cells come from the partitioned parquet there, and ``load`` first ingests plates
    that are not yet in it (``save_feather: false`` turns that off and reads the text).
    """

    def __init__(self, spark: SparkSession, params: dict):
        self.spark, self.params = spark, params
        self.plates = files.plate_directories(spark, params)

    def load_metadata(self, plates: Sequence[str] | None = None) -> DataFrame:
        return files.read_maps(self.spark, plates if plates is not None else self.plates)

    def list_antibodies(self, plate_ids: Sequence[str] | None = None) -> DataFrame:
        plates = self.plates
        if plate_ids is not None:
            plates = [p for p in plates if files.plate_id(p) in set(plate_ids)]
        return self.load_metadata(plates).select("Antibody").distinct()

    def marker_plates(self, wells: DataFrame, antibody) -> list[str]:
        """Directories of the plates that hold the marker; plate ids come from the plate maps, one per plate.

        Ids are compared as a whole, so that plate ``P1`` doesn't take ``P10`` along."""
        ids = {r[0] for r in plates_with_marker(wells, antibody).collect()}
        return [p for p in self.plates if files.plate_id(p) in ids]

    def load(self, antibody=None) -> tuple[DataFrame, DataFrame]:
        """(wells, cells). All wells of the matching plates are kept."""
        wells = self.load_metadata()
        plates = self.marker_plates(wells, antibody)
        if not plates:
            raise ValueError(f"no plate holds {antibody}")
        folder = self.params.get("curated")
        if folder and self.params.get("save_feather", True):
            store = CuratedCells(self.spark, folder)
            store.ingest(self.plates, self.params)
            cells = store.read([files.plate_id(p) for p in plates])
        else:
            cells = files.read_measurements(self.spark, plates, self.params)
        cells = cells.drop("PlateID")
        profile = well_profile(cells)
        wells = wells.join(profile.select("ID", "NCells"), "ID").withColumn("Screen", F.split("ID", "-").getItem(0))
        return drop_empty_columns(wells), filled_columns(cells, profile)


def wells_of_marker(wells: DataFrame, antibody: str) -> DataFrame:
    return wells.filter(F.col("Antibody") == antibody)


def cells_of_wells(cells: DataFrame, wells: DataFrame) -> DataFrame:
    return join_bounded(cells, wells.select("ID"), "ID", "left_semi")
