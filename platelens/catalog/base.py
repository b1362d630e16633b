"""The supplied tables seen as a screen, and the same views as SQL text for the independent checks.

A cell is a line item, a well is (return flag, line status, supplier), a marker set is a return flag, a drug is a line
status, a cell line is a nation and a mutation is a region (AFRICA is wild type, MIDDLE EAST is sporadic).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from platelens.screen import Screen

FEATURES = ["Nucleus_Area", "Nucleus_Intensity", "Cell_Spots", "Cell_Intensity_Sum"]
CLASS_NAMES = {0: "AMERICA", 1: "ASIA", 2: "EUROPE"}


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a query with its check; ``{cells}`` and other views named in the SQL are put in front of it."""
    def add(fn):
        QUERIES[name] = Query(fn, None if sql is None else with_views(sql))
        return fn
    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def lineitem(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem")


def cell_key() -> Column:
    return F.concat_ws(
        ":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.round(F.col("l_extendedprice") * 100).cast("bigint"), F.col("l_shipdate").cast("date").cast("string"),
    )


def cells(spark: SparkSession, sf: str, nulls: bool = False, key: bool = False, labels: bool = False) -> DataFrame:
    """Cells with four features; ``nulls`` blanks some values (two shares, on either side of a tenth)."""
    spots, total = F.col("l_discount"), F.col("l_tax")
    if nulls:
        spots = F.when(F.col("l_discount") != 0.1, spots)
        total = F.when(~F.col("l_tax").isin(0.04, 0.08), total)
    out = [F.concat_ws("-", "l_returnflag", "l_linestatus", "l_suppkey").alias("ID")]
    out += [cell_key().alias("cell_key")] if key else []
    out += [F.col("l_returnflag").alias("Antibody")] if labels else []
    out += [F.col("l_quantity").alias("Nucleus_Area"), F.col("l_extendedprice").alias("Nucleus_Intensity"),
            spots.alias("Cell_Spots"), total.alias("Cell_Intensity_Sum")]
    return lineitem(spark, sf).select(*out)


def mutation(name: str = "r_name") -> Column:
    return F.when(F.col(name) == "AFRICA", "WT").when(F.col(name) == "MIDDLE EAST", "sporadic").otherwise(F.col(name))


def suppliers(spark: SparkSession, sf: str) -> DataFrame:
    """Supplier with cell line and mutation; the planner sees the file sizes of nation and region."""
    nation = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    joined = table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.select("s_suppkey", F.col("n_name").alias("CellLines"), mutation().alias("Mutations"), "n_regionkey")


def wells(spark: SparkSession, sf: str) -> DataFrame:
    """Wells with labels and cell counts: cells are counted per well before anything is joined."""
    counts = lineitem(spark, sf).groupBy("l_returnflag", "l_linestatus", "l_suppkey").agg(
        F.count(F.lit(1)).alias("NCells")
    )
    joined = counts.join(suppliers(spark, sf), F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.select(
        F.concat_ws("-", "l_returnflag", "l_linestatus", "l_suppkey").alias("ID"),
        F.concat_ws("-", "l_returnflag", "l_linestatus").alias("PlateID"),
        (F.col("l_suppkey") % 8 + 1).cast("string").alias("Row"),
        (F.floor(F.col("l_suppkey") / 8) % 12 + 1).cast("string").alias("Column"),
        F.col("l_returnflag").alias("Antibody"), F.col("l_linestatus").alias("Drugs"), "CellLines", "Mutations",
        "NCells", F.col("l_returnflag").alias("Screen"),
    )


def screen(spark: SparkSession, sf: str, params: dict | None = None, nulls: bool = False, key: bool = False) -> Screen:
    return Screen(cells(spark, sf, nulls, key), wells(spark, sf), params or {})


def scores(spark: SparkSession, sf: str, by_drug: bool = False) -> DataFrame:
    """Score table per supplier: shares of the marker sets, raised to the 8th power and renormalised."""
    keys = ["l_suppkey"] + (["l_linestatus"] if by_drug else [])
    counts = lineitem(spark, sf).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("NCells"),
        *[F.count(F.when(F.col("l_returnflag") == f, 1)).alias(f"_n{i}") for i, f in enumerate("ANR")],
    )
    share = [F.col(f"_n{i}") / F.col("NCells") for i in range(3)]
    power = [x * x * x * x * x * x * x * x for x in share]
    total = power[0] + power[1] + power[2]
    out = counts.select(*keys, "NCells", *[(p / total).alias(f"Class_{i}") for i, p in enumerate(power)])
    top = (
        F.when((F.col("Class_0") >= F.col("Class_1")) & (F.col("Class_0") >= F.col("Class_2")), 0)
        .when(F.col("Class_1") >= F.col("Class_2"), 1).otherwise(2)
    )
    true = F.when(F.col("l_suppkey") % 4 == 0, F.col("n_regionkey") % 3).otherwise(top)
    joined = out.join(suppliers(spark, sf).drop("CellLines"), F.col("l_suppkey") == F.col("s_suppkey"))
    extra = [F.col("l_linestatus").alias("Drugs")] if by_drug else []
    return joined.select(F.col("l_suppkey").cast("string").alias("CellLines"), "Mutations", *extra,
                         true.cast("int").alias("True"), "Class_0", "Class_1", "Class_2", "NCells")


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Long predictions: one row per (line, drug as result index, model)."""
    from platelens.operators.figures import long_scores

    by = scores(spark, sf, by_drug=True)
    parts = [long_scores(by.filter(F.col("Drugs") == d), CLASS_NAMES).withColumn("ResultIndex", F.lit(d)) for d in "FO"]
    return parts[0].unionByName(parts[1])


def marker_probabilities(spark: SparkSession, sf: str) -> DataFrame:
    """Long (CellLines, True, Antibody, class, p): shares of three size bands per supplier and marker set."""
    band = F.when(F.col("l_quantity") < 10, 0).when(F.col("l_quantity") < 25, 1).otherwise(2)
    parts = lineitem(spark, sf).groupBy("l_suppkey", "l_returnflag").agg(
        *[F.avg((band == i).cast("double")).alias(f"_p{i}") for i in range(3)]
    )
    rows = F.array(*[F.struct(F.lit(i).alias("class"), F.col(f"_p{i}").alias("p")) for i in range(3)])
    return parts.select(
        F.col("l_suppkey").cast("string").alias("CellLines"), (F.col("l_suppkey") % 3).cast("int").alias("True"),
        F.col("l_returnflag").alias("Antibody"), F.inline(rows),
    )


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, for comparison across engines that sum in different orders.

    A small shift first, in Spark and in the SQL alike, keeps exact decimal ties from falling on either side.
    """
    return df.select(*[
        F.round(F.col(f"`{f.name}`") + F.lit(10.0 ** -(digits + 4)), digits).alias(f.name) if f.dataType.typeName() in ("double", "float")
        else F.col(f"`{f.name}`") for f in df.schema.fields
    ])


VIEWS = {
    "keyed_cells": """SELECT l_returnflag || '-' || l_linestatus || '-' || l_suppkey::VARCHAR AS ID,
  concat_ws(':', l_orderkey::VARCHAR, l_linenumber::VARCHAR, l_partkey::VARCHAR, l_suppkey::VARCHAR,
    round(l_extendedprice * 100)::BIGINT::VARCHAR, l_shipdate::DATE::VARCHAR) AS cell_key,
  l_returnflag AS Antibody, l_suppkey, l_quantity AS Nucleus_Area, l_extendedprice AS Nucleus_Intensity,
  l_discount AS Cell_Spots, l_tax AS Cell_Intensity_Sum FROM lineitem""",
    "cells": """SELECT l_returnflag || '-' || l_linestatus || '-' || l_suppkey::VARCHAR AS ID, l_returnflag AS Antibody,
  l_suppkey, l_quantity AS Nucleus_Area, l_extendedprice AS Nucleus_Intensity, l_discount AS Cell_Spots,
  l_tax AS Cell_Intensity_Sum FROM lineitem""",
    "supp": """SELECT s_suppkey, n_name AS CellLines, n_regionkey, CASE r_name WHEN 'AFRICA' THEN 'WT'
  WHEN 'MIDDLE EAST' THEN 'sporadic' ELSE r_name END AS Mutations
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "wells": """SELECT c.*, CellLines, Mutations FROM (
  SELECT l_returnflag || '-' || l_linestatus || '-' || l_suppkey::VARCHAR AS ID,
    l_returnflag || '-' || l_linestatus AS PlateID, (l_suppkey % 8 + 1)::VARCHAR AS "Row",
    ((l_suppkey // 8) % 12 + 1)::VARCHAR AS "Column", l_returnflag AS Antibody, l_linestatus AS Drugs,
    l_returnflag AS Screen, l_suppkey, count(*) AS NCells FROM lineitem
  GROUP BY l_returnflag, l_linestatus, l_suppkey) c JOIN supp ON l_suppkey = s_suppkey""",
    "scores": """SELECT l_suppkey::VARCHAR AS CellLines, Mutations, NCells, p0 / (p0 + p1 + p2) AS Class_0,
  p1 / (p0 + p1 + p2) AS Class_1, p2 / (p0 + p1 + p2) AS Class_2,
  CASE WHEN l_suppkey % 4 = 0 THEN n_regionkey % 3 WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS "True"
  FROM (SELECT *, x0*x0*x0*x0*x0*x0*x0*x0 AS p0, x1*x1*x1*x1*x1*x1*x1*x1 AS p1, x2*x2*x2*x2*x2*x2*x2*x2 AS p2
    FROM (SELECT l_suppkey, count(*) AS NCells,
    count(*) FILTER (l_returnflag = 'A') / count(*)::DOUBLE AS x0,
    count(*) FILTER (l_returnflag = 'N') / count(*)::DOUBLE AS x1,
    count(*) FILTER (l_returnflag = 'R') / count(*)::DOUBLE AS x2
    FROM lineitem GROUP BY l_suppkey)) JOIN supp ON l_suppkey = s_suppkey""",
    "drug_scores": """SELECT l_suppkey::VARCHAR AS CellLines, Mutations, Drugs, NCells, p0 / (p0 + p1 + p2) AS Class_0,
  p1 / (p0 + p1 + p2) AS Class_1, p2 / (p0 + p1 + p2) AS Class_2,
  CASE WHEN l_suppkey % 4 = 0 THEN n_regionkey % 3 WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS "True"
  FROM (SELECT *, x0*x0*x0*x0*x0*x0*x0*x0 AS p0, x1*x1*x1*x1*x1*x1*x1*x1 AS p1, x2*x2*x2*x2*x2*x2*x2*x2 AS p2
    FROM (SELECT l_suppkey, l_linestatus AS Drugs, count(*) AS NCells,
    count(*) FILTER (l_returnflag = 'A') / count(*)::DOUBLE AS x0,
    count(*) FILTER (l_returnflag = 'N') / count(*)::DOUBLE AS x1,
    count(*) FILTER (l_returnflag = 'R') / count(*)::DOUBLE AS x2
    FROM lineitem GROUP BY l_suppkey, l_linestatus)) JOIN supp ON l_suppkey = s_suppkey""",
    "preds": """SELECT CellLines, Mutations, "True", Drugs AS ResultIndex, 'AMERICA' AS ModelGenetics, Class_0 AS Class_1
  FROM drug_scores UNION ALL
  SELECT CellLines, Mutations, "True", Drugs, 'ASIA', Class_1 FROM drug_scores UNION ALL
  SELECT CellLines, Mutations, "True", Drugs, 'EUROPE', Class_2 FROM drug_scores""",
    "marker_probs": """SELECT CellLines, l_suppkey % 3 AS "True", Antibody, c AS class, p FROM (
  SELECT l_suppkey, l_suppkey::VARCHAR AS CellLines, l_returnflag AS Antibody, b.c,
    avg(CASE WHEN (CASE WHEN l_quantity < 10 THEN 0 WHEN l_quantity < 25 THEN 1 ELSE 2 END) = b.c THEN 1.0 ELSE 0.0 END) AS p
  FROM lineitem, (VALUES (0), (1), (2)) b(c) GROUP BY ALL)""",
    "lines": "SELECT DISTINCT CellLines, Mutations FROM wells",
    "nonconf": """SELECT *, 1 - CASE "True" WHEN 0 THEN Class_0 WHEN 1 THEN Class_1 ELSE Class_2 END AS nc FROM scores""",
}


def shift_before_rounding(sql: str) -> str:
    """Rewrite ``round(expr, d)`` to ``round((expr) + 1e-(d+4), d)`` for d = 4 and 6."""
    out, at = "", 0
    while (start := sql.find(" round(", at)) >= 0 or (start := sql.find("(round(", at)) >= 0:
        depth, i = 1, start + 7
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            i += 1
        inner = shift_before_rounding(" " + sql[start + 7:i - 1])[1:]
        head, _, digits = inner.rpartition(",")
        if digits.strip() in ("4", "6"):
            inner = f"({head}) + 1e-{int(digits) + 4},{digits}"
        out += sql[at:start + 7] + inner + ")"
        at = i
    return out + sql[at:]


def with_views(sql: str) -> str:
    """Put the definitions of the views that a statement names in front of it, dependencies first."""
    import re

    sql = shift_before_rounding(" ".join(sql.split()))
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in VIEWS.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(body)
                needed.append(name)

    visit(sql)
    if not needed:
        return sql
    head = ", ".join(f"{n} AS ({VIEWS[n]})" for n in needed)
    body = sql.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {head}, {body[15:]}"
    return f"WITH {head}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {head} {body}"
