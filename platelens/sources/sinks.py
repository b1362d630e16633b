"""Result sinks: score tables and fitted models."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Layout of stored models; a reader refuses layouts it does not know.
VERSION = 1
MODEL = "kind string, part string, version int, options string, seed long, features array<string>, classes string, centre array<double>, spread array<double>, " \
    "coef array<array<double>>, intercept array<double>, gradient double, steps int, importances array<double>, wrong array<long>"
NODES = "part string, tree int, node int, feature int, threshold double, left int, counts array<double>"


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", partition_by=()) -> None:
    """Write a table as parquet, CSV with header, ORC or JSON."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema=None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.format(fmt).load(path)


def _parts(scorer) -> dict:
    """The fitted models of a scorer by name; a two-level scorer has one of cells for each marker, and one of lines."""
    if hasattr(scorer, "cell_models"):
        return {f"cell:{m}": scorer.cell_models[m].model for m in scorer.markers} | {"line": scorer.line_model.model}
    return {"model": scorer.model}


def save_model(scorer, path: str, spark: SparkSession | None = None) -> None:
    """Store a fitted scorer as tables: ``models`` (class order, features in order, scaling, coefficients, settings and a
    version) and, for forests, ``nodes`` (every node of every tree)."""
    from platelens.plans.forest import Forest

    spark = spark or SparkSession.active()
    rows, nodes = [], []
    for name, m in _parts(scorer).items():
        about = (type(scorer).__name__, name, VERSION, json.dumps(scorer.options), scorer.seed, list(m.features), json.dumps(list(m.classes)))
        if isinstance(m, Forest):
            rows.append((*about, None, None, None, None, None, None, m.importances.tolist(), [int(w) for w in m.wrong]))
            nodes += [(name, i, n, int(t.feature[n]), float(t.threshold[n]), int(t.left[n]), t.counts[n].tolist()) for i, t in enumerate(m.trees) for n in range(len(t.feature))]
        else:
            rows.append((*about, list(m.centre), list(m.spread), m.coef.tolist(), m.intercept.tolist(), float(m.gradient), int(m.steps), None, None))
    spark.createDataFrame(rows, MODEL).coalesce(1).write.mode("overwrite").parquet(f"{path}/models")
    spark.createDataFrame(nodes, NODES).write.mode("overwrite").parquet(f"{path}/nodes")


def load_model(spark: SparkSession, path: str):
    """A stored scorer, ready to predict; it gives the rows that the stored one gave."""
    from platelens.plans.forest import Forest, Tree
    from platelens.plans.manyfits import FoldModel
    from platelens.plans.scorers import SCORERS

    rows = spark.read.parquet(f"{path}/models").collect()  # one for each marker, and one
    if any(r["version"] != VERSION for r in rows):
        raise ValueError(f"{path}: layout {rows[0]['version']} is not known; this reader knows {VERSION}")
    nodes = spark.read.parquet(f"{path}/nodes")
    kind = rows[0]["kind"]
    scorer = SCORERS[kind](json.loads(rows[0]["options"]), rows[0]["seed"])
    models = {}
    for r in rows:
        if r["coef"] is not None:
            models[r["part"]] = FoldModel(r["features"], json.loads(r["classes"]), r["centre"], r["spread"], np.array(r["coef"]), np.array(r["intercept"]), r["gradient"], r["steps"])
            continue
        own = nodes.filter(F.col("part") == r["part"]).orderBy("tree", "node").toPandas()  # the trees fit in every task
        trees = [Tree(t["feature"].to_numpy(dtype=np.int32), t["threshold"].to_numpy(), t["left"].to_numpy(dtype=np.int32), np.stack(t["counts"].to_list())) for _, t in own.groupby("tree")]
        models[r["part"]] = Forest(r["features"], json.loads(r["classes"]), trees, np.array(r["importances"]), list(r["wrong"]))
    if "line" in models:
        return scorer.take(({p.removeprefix("cell:"): m for p, m in models.items() if p != "line"}, models["line"]))
    return scorer.take(models["model"])


def save_codes(codes: DataFrame, path: str) -> None:
    """Store a code table (a label column and its index)."""
    codes.withColumn("version", F.lit(VERSION)).coalesce(1).write.mode("overwrite").parquet(path)


def load_codes(spark: SparkSession, path: str) -> DataFrame:
    codes = spark.read.parquet(path)
    if codes.filter(F.col("version") != VERSION).limit(1).count():
        raise ValueError(f"{path}: the layout is not known; this reader knows {VERSION}")
    return codes.drop("version")
