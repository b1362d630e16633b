"""Label encodings. Label lists (mutations, screens) are short, but every mapping is still a table join."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platelens.functions.sizing import join_bounded
from platelens.operators.features import quoted


def _numbered(df: DataFrame, column: str, *order: Column) -> DataFrame:
    """Distinct labels with indexes 0.. in the given order; the window runs over the label list only."""
    labels = df.select(column).distinct()
    return labels.withColumn("_code", (F.row_number().over(Window.orderBy(*order)) - 1).cast("bigint"))


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct labels and their index."""
    return _numbered(df, column, F.col(column)).withColumnRenamed("_code", "code")


def encode_labels(df: DataFrame, column: str, mapping: Mapping[str, int] | None = None, name: str = "label"):
    """Integer labels: by explicit map (an unmapped label is an error) or by sorted order."""
    if mapping is None:
        codes = label_codes(df, column).withColumnRenamed("code", name)
        return join_bounded(df, codes, column)
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    code = F.try_element_at(pairs, quoted(column)).cast("bigint")
    failed = F.raise_error(F.concat(F.lit(f"no code for {column}="), F.coalesce(quoted(column), F.lit("null"))))
    return df.withColumn(name, F.when(code.isNull(), failed.cast("bigint")).otherwise(code))


def encode_wild_type_first(df: DataFrame, column: str, wild_type: str = "WT") -> DataFrame:
    """Replace labels by their index, wild type first, the others sorted."""
    codes = _numbered(df, column, (F.col(column) != wild_type).cast("int"), F.col(column))
    return join_bounded(df, codes, column).withColumn(column, F.col("_code")).drop("_code").select(*df.columns)


def encode_domains(df: DataFrame, response: str = "CellLines", codes: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Screen index (``domain``) and response index (``label``). ``codes``: stored code tables of both (``sources.sinks``);
    new data then gets the stored codes, and a screen or label that they don't hold is an error."""
    for column, name, table in zip(("Screen", response), ("domain", "label"), codes or (None, None), strict=True):
        known = (label_codes(df, column) if table is None else table).select(column, F.col("code").alias(name))
        df = join_bounded(df, known, column, "left" if table is not None else "inner")
        if table is not None:
            failed = F.raise_error(F.concat(F.lit(f"no code for {column}="), F.coalesce(quoted(column).cast("string"), F.lit("null"))))
            df = df.withColumn(name, F.when(F.col(name).isNull(), failed.cast("bigint")).otherwise(F.col(name)))
    return df
