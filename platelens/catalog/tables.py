"""Queries: joins (C), aggregates (D), ordering and scaling (E), sorts and set operations (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from platelens.catalog.base import (
    CLASS_NAMES, FEATURES, cells, lineitem, predictions, query, rounded, scores, screen,
    suppliers, wells,
)
from platelens.catalog.loading import MEANS
from platelens.operators import aggregates as agg
from platelens.operators import joins, ordering
from platelens.operators.figures import bar_table, heatmap_cells, heatmap_table, long_scores, scatter_table
from platelens.plans.attribution import line_means_long
from platelens.plans.conformal import sets_split


@query("c01_cells_with_wells", f"""SELECT CellLines, Mutations, Drugs, count(*) AS n, {MEANS} FROM cells c JOIN wells w ON c.ID = w.ID
  GROUP BY 1, 2, 3""")
def c01(spark, sf):
    s = screen(spark, sf)
    out = joins.cells_with_wells(s.cells, s.wells, s.bounds().groups)
    return rounded(out.groupBy("CellLines", "Mutations", "Drugs").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in FEATURES]), 4)


@query("c02_checked_left_join", "SELECT CellLines, w.Screen, count(*) AS n FROM cells c LEFT JOIN wells w ON c.ID = w.ID GROUP BY 1, 2")
def c02(spark, sf):
    s = screen(spark, sf)
    labels = s.wells.select("ID", "CellLines", "Mutations", "Screen")
    out = joins.cells_with_wells_checked(s.cells, labels, s.bounds().groups)
    return out.groupBy("CellLines", "Screen").agg(F.count(F.lit(1)).alias("n"))


@query("c03_semi_join", "SELECT ID, count(*) AS n FROM cells WHERE ID IN (SELECT ID FROM wells WHERE Mutations = 'WT') GROUP BY ID")
def c03(spark, sf):
    s = screen(spark, sf)
    kept = joins.keep_ids(s.cells, s.wells.filter(F.col("Mutations") == "WT"), s.bounds().groups)
    return kept.groupBy("ID").agg(F.count(F.lit(1)).alias("n"))


@query("c04_anti_join", """SELECT ID, CellLines FROM wells WHERE CellLines NOT IN (SELECT CellLines FROM lines WHERE Mutations IN ('ASIA', 'sporadic'))""")
def c04(spark, sf):
    meta = wells(spark, sf)
    out = meta.filter(F.col("Mutations").isin("ASIA", "sporadic")).select("CellLines").distinct()
    return joins.without_lines(meta, out).select("ID", "CellLines")


@query("c05_wells_with_counts", "SELECT ID, CellLines, NCells FROM wells")
def c05(spark, sf):
    return joins.wells_with_counts(wells(spark, sf), cells(spark, sf)).select("ID", "CellLines", "NCells")


@query("c06_scores_with_counts", """SELECT s.CellLines, round(Class_1, 6) AS Class_1, round(c.n, 6) AS NCells FROM scores s
  LEFT JOIN (SELECT l_suppkey::VARCHAR AS CellLines, avg(NCells) AS n FROM wells GROUP BY 1) c ON s.CellLines = c.CellLines""")
def c06(spark, sf):
    per_line = wells(spark, sf).withColumn("CellLines", F.element_at(F.split("ID", "-"), 3))
    out = joins.scores_with_counts(scores(spark, sf).drop("NCells"), per_line)
    return rounded(out.select("CellLines", "Class_1", "NCells"))


@query("c06_profiles_with_counts", f"SELECT w.ID, NCells, {MEANS} FROM cells c JOIN wells w ON c.ID = w.ID GROUP BY 1, 2")
def c06b(spark, sf):
    """Well scores joined to well counts (inner, by well)."""
    s = screen(spark, sf)
    profiles = agg.well_profiles(s)
    return rounded(profiles.join(s.wells.select("ID", "NCells"), "ID"), 4)


@query("c07_scores_with_sets", """WITH n AS (SELECT count(*) AS n FROM nonconf), ranked AS (SELECT nc, row_number() OVER (ORDER BY nc) AS r FROM nonconf),
  h AS (SELECT (n - 1) * least(1.0::DOUBLE, 0.75::DOUBLE * (n + 1) / n) AS h FROM n),
  t AS (SELECT max(CASE WHEN r = floor(h) + 1 THEN nc END) + (max(h) - floor(max(h))) * (max(CASE WHEN r = ceil(h) + 1 THEN nc END)
    - max(CASE WHEN r = floor(h) + 1 THEN nc END)) AS t FROM ranked, h)
  SELECT CellLines, round(Class_0, 6) AS Class_0, CASE WHEN Mutations = 'sporadic' THEN NULL ELSE concat_ws(',',
    CASE WHEN Class_0 >= 1 - t THEN '0' END, CASE WHEN Class_1 >= 1 - t THEN '1' END, CASE WHEN Class_2 >= 1 - t THEN '2' END) END AS PredictionSet
  FROM scores, t""")
def c07(spark, sf):
    """Prediction sets of the non-sporadic lines joined to all scores; sporadic lines stay without one."""
    table = scores(spark, sf)
    sets = sets_split(table, table.filter(F.col("Mutations") != "sporadic"), 0.75)
    out = joins.scores_with_sets(table, sets)
    text = F.when(F.col("PredictionSet").isNotNull(), F.concat_ws(",", "PredictionSet"))
    return rounded(out.select("CellLines", "Class_0", text.alias("PredictionSet")))


@query("c08_line_lookup", """SELECT CellLines, Mutation, Age, count(*) AS wells FROM (SELECT w.CellLines, l.Mutations AS Mutation,
  CASE w.CellLines WHEN 'NATION_1' THEN 41 WHEN 'NATION_2' THEN 57 END AS Age FROM wells w LEFT JOIN lines l ON w.CellLines = l.CellLines) GROUP BY 1, 2, 3""")
def c08(spark, sf):
    """Line to mutation by a table, line to age by a short map."""
    meta = wells(spark, sf)
    lines = suppliers(spark, sf).select("CellLines", "Mutations").distinct()
    out = joins.look_up(meta.select("CellLines"), lines, "CellLines", "Mutation")
    out = joins.look_up(out, {"NATION_1": 41, "NATION_2": 57}, "CellLines", "Age")
    return out.groupBy("CellLines", "Mutation", "Age").agg(F.count(F.lit(1)).alias("wells"))


def _uneven(df, column):
    """Some lines were never measured under ``R``: their rows are relabelled."""
    return df.withColumn(column, F.when(F.col("CellLines").endswith("1") & (F.col(column) == "R"), "A").otherwise(F.col(column)))


@query("c09_shared_lines", """WITH u AS (SELECT CellLines, Mutations, CASE WHEN CellLines LIKE '%1' AND Antibody = 'R' THEN 'A' ELSE Antibody END AS Antibody FROM wells)
  SELECT CellLines, Mutations FROM u GROUP BY 1, 2 HAVING count(DISTINCT Antibody) = (SELECT count(DISTINCT Antibody) FROM u)""")
def c09(spark, sf):
    """Lines found in every marker set, among well-populated wells."""
    return joins.shared_lines(_uneven(wells(spark, sf), "Antibody"))


@query("c10_side_by_side", """SELECT ID, round(avg(Nucleus_Area), 4) AS Nucleus_Area, round(stddev_samp(Nucleus_Area), 4) AS Nucleus_Area_sd
  FROM cells GROUP BY ID""")
def c10(spark, sf):
    """Columns of two derived tables side by side: joined by key, never by row position."""
    c = cells(spark, sf)
    left = c.groupBy("ID").agg(F.avg("Nucleus_Area").alias("Nucleus_Area"))
    right = c.groupBy("ID").agg(F.stddev_samp("Nucleus_Area").alias("Nucleus_Area_sd"))
    return rounded(left.join(right, "ID"), 4)


@query("c11_merged_group_means", """SELECT a.CellLines, a.Mutations, round(score1, 6) AS score1, round(score2, 6) AS score2 FROM
  (SELECT CellLines, Mutations, avg(Class_1) AS score1 FROM drug_scores WHERE Drugs = 'F' AND Mutations <> 'sporadic' GROUP BY 1, 2) a JOIN
  (SELECT CellLines, Mutations, avg(Class_1) AS score2 FROM drug_scores WHERE Drugs = 'O' AND Mutations <> 'sporadic' GROUP BY 1, 2) b
  ON a.CellLines = b.CellLines AND a.Mutations = b.Mutations""")
def c11(spark, sf):
    by = scores(spark, sf, by_drug=True)
    second = by.filter(F.col("Drugs") == "O").withColumnRenamed("Class_1", "score2")
    return rounded(joins.merged_group_means(by.filter(F.col("Drugs") == "F"), second, "Class_1", "score2", "CellLines", "Mutations"))


@query("d01_cells_per_well", "SELECT ID, count(*) AS NCells FROM cells GROUP BY ID")
def d01(spark, sf):
    return agg.cells_per_well(cells(spark, sf))


@query("d02_well_profiles", f"SELECT ID, {MEANS} FROM cells GROUP BY ID")
def d02(spark, sf):
    return rounded(agg.well_profiles(screen(spark, sf)), 4)


@query("d03_profiles_by_label", f"SELECT Mutations, {MEANS} FROM cells c JOIN wells w ON c.ID = w.ID GROUP BY 1")
def d03(spark, sf):
    return rounded(agg.profiles_by(screen(spark, sf), "Mutations"), 4)


@query("d04_group_predicted", "SELECT Mutations, Drugs, round(avg(Class_1), 6) AS Class_1 FROM drug_scores GROUP BY 1, 2")
def d04(spark, sf):
    return rounded(agg.group_predicted(scores(spark, sf, by_drug=True), ["Mutations", "Drugs"]))


@query("d05_line_means", """SELECT CellLines, min("True") AS "True", min(Mutations) AS Mutations, round(avg(Class_0), 6) AS Class_0,
  round(avg(Class_1), 6) AS Class_1, round(avg(Class_2), 6) AS Class_2 FROM drug_scores GROUP BY 1""")
def d05(spark, sf):
    return rounded(agg.scores_by_line(scores(spark, sf, by_drug=True), "mean"))


@query("d05_line_medians", """SELECT n_name AS CellLines, round(median(Class_0), 6) AS Class_0, round(median(Class_1), 6) AS Class_1,
  round(median(Class_2), 6) AS Class_2 FROM drug_scores JOIN supplier ON CellLines = s_suppkey::VARCHAR JOIN nation ON s_nationkey = n_nationkey GROUP BY 1""")
def d05b(spark, sf):
    by = scores(spark, sf, by_drug=True).drop("True", "Mutations").withColumnRenamed("CellLines", "s")
    names = suppliers(spark, sf).select(F.col("s_suppkey").cast("string").alias("s"), "CellLines")
    return rounded(agg.scores_by_line(by.join(names, "s"), "median"))


@query("d05_line_deviation", """SELECT CellLines, min("True") AS "True", min(Mutations) AS Mutations, round(stddev_samp(Class_0), 6) AS Class_0,
  round(stddev_samp(Class_1), 6) AS Class_1, round(stddev_samp(Class_2), 6) AS Class_2 FROM drug_scores GROUP BY 1""")
def d05c(spark, sf):
    return rounded(agg.scores_by_line(scores(spark, sf, by_drug=True), "std"))


@query("d06_replicate_means", """SELECT "True", CellLines, round(avg(Class_0), 6) AS Class_0, round(avg(Class_1), 6) AS Class_1,
  round(avg(Class_2), 6) AS Class_2 FROM drug_scores GROUP BY 1, 2""")
def d06(spark, sf):
    return rounded(agg.replicate_means(scores(spark, sf, by_drug=True)))


@query("d07_replicate_ranges", """SELECT CellLines, ModelGenetics, round(avg(Class_1), 6) AS mean, round(min(Class_1), 6) AS min, round(max(Class_1), 6) AS max,
  round(avg(Class_1) - min(Class_1), 6) AS error_low, round(max(Class_1) - avg(Class_1), 6) AS error_high FROM preds GROUP BY 1, 2""")
def d07(spark, sf):
    return rounded(agg.replicate_ranges(predictions(spark, sf), ["CellLines", "ModelGenetics"], "Class_1"))


@query("d08_replicate_summary", """SELECT CellLines, round(avg(Class_1), 6) AS mean_pred, round(stddev_samp(Class_1), 6) AS std_pred,
  count(Class_1) AS count FROM preds WHERE ModelGenetics = 'ASIA' GROUP BY 1""")
def d08(spark, sf):
    one = predictions(spark, sf).filter(F.col("ModelGenetics") == "ASIA")
    return rounded(agg.replicate_summary(one, "Class_1"))


@query("d09_most_common_label", """SELECT CellLines, q AS "True", c AS n FROM (SELECT CellLines, q, count(*) AS c,
  row_number() OVER (PARTITION BY CellLines ORDER BY count(*) DESC, q) AS r FROM (SELECT c.l_suppkey::VARCHAR AS CellLines,
  c.Nucleus_Area::INT % 5 AS q FROM cells c) GROUP BY 1, 2) WHERE r = 1""")
def d09(spark, sf):
    labels = lineitem(spark, sf).select(
        F.col("l_suppkey").cast("string").alias("CellLines"), (F.col("l_quantity").cast("int") % 5).alias("True")
    )
    return agg.most_common(labels, ["CellLines"], "True")


@query("d10_cell_count_table", """WITH m AS (SELECT CellLines, Mutations, Drugs, avg(NCells) AS NCells FROM wells GROUP BY 1, 2, 3),
  t AS (SELECT Drugs, CellLines, sum(NCells) AS total FROM m GROUP BY 1, 2),
  p AS (SELECT *, row_number() OVER (PARTITION BY Drugs ORDER BY total DESC, CellLines) AS position FROM t)
  SELECT m.CellLines, m.Mutations, m.Drugs, round(m.NCells, 6) AS NCells, round(total, 6) AS total, position FROM m JOIN p ON m.Drugs = p.Drugs AND m.CellLines = p.CellLines""")
def d10(spark, sf):
    return rounded(agg.cell_count_table(wells(spark, sf), "Drugs"))


@query("d11_cell_count_boxes", """SELECT Mutations, round(quantile_cont(v, 0), 6) AS low, round(quantile_cont(v, 0.25), 6) AS q1, round(quantile_cont(v, 0.5), 6) AS median,
  round(quantile_cont(v, 0.75), 6) AS q3, round(quantile_cont(v, 1), 6) AS high, round(max(v) - min(v), 6) AS range
  FROM (SELECT CellLines, Mutations, avg(NCells) AS v FROM wells GROUP BY 1, 2) GROUP BY 1""")
def d11(spark, sf):
    return rounded(agg.cell_count_boxes(wells(spark, sf)))


@query("d12_plate_layout", """SELECT "Row"::INT AS "Row", """ + ", ".join(
    f"""round(avg(CASE WHEN "Column" = '{i}' THEN v END), 4) AS "{i}\"""" for i in range(1, 13)) + """ FROM
  (SELECT ID, avg(Nucleus_Area) AS v FROM cells GROUP BY ID) m JOIN wells w ON m.ID = w.ID GROUP BY 1""")
def d12(spark, sf):
    return rounded(agg.plate_layout(screen(spark, sf), "Nucleus_Area", range(1, 13)), 4)


@query("d12_plate_counts", """SELECT "Row"::INT AS "Row", """ + ", ".join(
    f"""round(avg(CASE WHEN "Column" = '{i}' THEN NCells END), 4) AS "{i}\"""" for i in range(1, 13)) + """ FROM wells GROUP BY 1""")
def d12b(spark, sf):
    return rounded(agg.plate_layout(screen(spark, sf), "NCells", range(1, 13)), 4)


@query("d13_lines_per_mutation", "SELECT Mutations, count(*) AS lines FROM lines GROUP BY 1")
def d13(spark, sf):
    return agg.label_counts(wells(spark, sf))


@query("d14_pooled_probabilities", """SELECT l_suppkey::VARCHAR AS CellLines, Antibody, round(avg(CASE WHEN Nucleus_Area < 10 THEN 1.0 ELSE 0.0 END), 6) AS Class_0,
  round(avg(CASE WHEN Nucleus_Area >= 10 THEN 1.0 ELSE 0.0 END), 6) AS Class_1 FROM cells GROUP BY 1, 2""")
def d14(spark, sf):
    small = (F.col("l_quantity") < 10).cast("double")
    rows = lineitem(spark, sf).select(F.col("l_suppkey").cast("string").alias("CellLines"), F.col("l_returnflag").alias("Antibody"),
                                      small.alias("Class_0"), (1 - small).alias("Class_1"))
    return rounded(agg.pooled_probabilities(rows))


@query("d15_lines_in_all_screens", """WITH u AS (SELECT CellLines, CASE WHEN CellLines LIKE '%1' AND Screen = 'R' THEN 'A' ELSE Screen END AS Screen FROM wells)
  SELECT CellLines FROM u GROUP BY 1 HAVING count(DISTINCT Screen) = (SELECT count(DISTINCT Screen) FROM u)""")
def d15(spark, sf):
    return agg.shared_by_all(_uneven(wells(spark, sf), "Screen"), ["CellLines"], "Screen")


NATIONS = [f"NATION_{i}" for i in range(25)]


@query("d16_heatmap", """WITH p AS (SELECT ModelGenetics, Class_1, n_name FROM preds JOIN supplier ON CellLines = s_suppkey::VARCHAR JOIN nation ON s_nationkey = n_nationkey),
  e AS (SELECT ModelGenetics, min(Class_1) AS lo, max(Class_1) AS hi FROM p GROUP BY 1)
  SELECT p.ModelGenetics, """ + ", ".join(
    f"round(avg(CASE WHEN n_name = '{n}' THEN CASE WHEN hi > lo THEN (Class_1 - lo) / (hi - lo) ELSE 0.5 END END), 6) AS {n}" for n in NATIONS)
    + " FROM p JOIN e ON p.ModelGenetics = e.ModelGenetics GROUP BY 1")
def d16(spark, sf):
    names = suppliers(spark, sf).select(F.col("s_suppkey").cast("string").alias("s"), F.col("CellLines").alias("nation"))
    long = predictions(spark, sf).join(names, F.col("CellLines") == F.col("s")).drop("CellLines", "s")
    return rounded(heatmap_table(long.withColumnRenamed("nation", "CellLines"), True, NATIONS))


@query("d16_heatmap_long", """WITH e AS (SELECT ModelGenetics, min(Class_1) AS lo, max(Class_1) AS hi FROM preds GROUP BY 1)
  SELECT p.ModelGenetics, CellLines, round(avg((Class_1 - lo) / (hi - lo)), 6) AS value FROM preds p JOIN e ON p.ModelGenetics = e.ModelGenetics GROUP BY 1, 2""")
def d16b(spark, sf):
    return rounded(heatmap_cells(predictions(spark, sf)))


@query("d17_wide_scores", """SELECT CellLines, Mutations, round(avg(CASE WHEN ModelGenetics = 'AMERICA' THEN Class_1 END), 6) AS AMERICA,
  round(avg(CASE WHEN ModelGenetics = 'ASIA' THEN Class_1 END), 6) AS ASIA, round(avg(CASE WHEN ModelGenetics = 'EUROPE' THEN Class_1 END), 6) AS EUROPE
  FROM preds GROUP BY 1, 2""")
def d17(spark, sf):
    return rounded(agg.pivot_mean(predictions(spark, sf), ["CellLines", "Mutations"], "ModelGenetics", "Class_1", list(CLASS_NAMES.values())))


@query("d18_distinct_lists", """SELECT 'Mutations' AS list, Mutations AS value FROM wells GROUP BY 2 UNION ALL
  SELECT 'CellLines', CellLines FROM wells GROUP BY 2 UNION ALL SELECT 'Antibody', Antibody FROM wells GROUP BY 2""")
def d18(spark, sf):
    meta = wells(spark, sf)
    return joins.union_all([
        agg.distinct_values(meta, F.lit(c).alias("list"), F.col(c).alias("value")) for c in ("Mutations", "CellLines", "Antibody")
    ])


@query("e02_row_scaling", """SELECT CellLines, ModelGenetics, ResultIndex, round(CASE WHEN hi > lo THEN (Class_1 - lo) / (hi - lo) ELSE 0.5 END, 6) AS scaled
  FROM (SELECT *, min(Class_1) OVER (PARTITION BY ModelGenetics) AS lo, max(Class_1) OVER (PARTITION BY ModelGenetics) AS hi FROM preds)""")
def e02(spark, sf):
    out = ordering.scale_rows(predictions(spark, sf), name="scaled")
    return rounded(out.select("CellLines", "ModelGenetics", "ResultIndex", "scaled"))


@query("e03_line_order", """SELECT Mutations, CellLines, round(score, 6) AS score, row_number() OVER (PARTITION BY Mutations ORDER BY score DESC NULLS LAST, CellLines) AS position_in_group
  FROM (SELECT Mutations, CellLines, avg(CASE WHEN ModelGenetics <> 'ASIA' AND (Mutations IN ('WT', 'sporadic') OR ModelGenetics = Mutations) THEN Class_1 END) AS score FROM preds GROUP BY 1, 2)""")
def e03(spark, sf):
    """One model without scores: lines of its mutation have no matching score and come last in their group."""
    rows = predictions(spark, sf).withColumn("Class_1", F.when(F.col("ModelGenetics") != "ASIA", F.col("Class_1")))
    return rounded(ordering.order_lines(rows))


@query("e04_centred_halves", """SELECT CellLines, ModelGenetics, ResultIndex, round(Class_1 - avg(Class_1) OVER (PARTITION BY ResultIndex) + 0.5, 6) AS Class_1 FROM preds""")
def e04(spark, sf):
    out = ordering.centre_at_half(predictions(spark, sf), ["ResultIndex"], "Class_1")
    return rounded(out.select("CellLines", "ModelGenetics", "ResultIndex", "Class_1"))


def _attribution_rows(spark, sf):
    rows = lineitem(spark, sf).select("l_suppkey", F.col("l_quantity").alias("Nucleus_Area"),
                                      (F.col("l_extendedprice") / 1000).alias("Nucleus_Intensity"),
                                      F.col("l_discount").alias("Cell_Spots"), F.col("l_tax").alias("Cell_Intensity_Sum"))
    return line_means_long(rows, FEATURES, ["l_suppkey"])


E06 = """WITH m AS (SELECT l_suppkey, feature, v FROM (UNPIVOT (SELECT l_suppkey, avg(Nucleus_Area) AS Nucleus_Area, avg(Nucleus_Intensity / 1000) AS Nucleus_Intensity,
  avg(Cell_Spots) AS Cell_Spots, avg(Cell_Intensity_Sum) AS Cell_Intensity_Sum FROM cells GROUP BY 1)
  ON Nucleus_Area, Nucleus_Intensity, Cell_Spots, Cell_Intensity_Sum INTO NAME feature VALUE v))
  SELECT l_suppkey, feature, """


@query("e06_row_max", E06 + "round(v / max(v) OVER (PARTITION BY l_suppkey), 6) AS mean FROM m")
def e06(spark, sf):
    return rounded(ordering.normalise_rows(_attribution_rows(spark, sf), ["l_suppkey"], "mean", "max"))


@query("e06_row_zscore", E06 + "round((v - avg(v) OVER (PARTITION BY l_suppkey)) / stddev_pop(v) OVER (PARTITION BY l_suppkey), 6) AS mean FROM m")
def e06b(spark, sf):
    return rounded(ordering.normalise_rows(_attribution_rows(spark, sf), ["l_suppkey"], "mean", "zscore"))


@query("e06_row_abs", E06 + "round(abs(v - 20), 6) AS mean FROM m")
def e06c(spark, sf):
    shifted = _attribution_rows(spark, sf).withColumn("mean", F.col("mean") - 20)
    return rounded(ordering.normalise_rows(shifted, ["l_suppkey"], "mean", "abs"))


@query("e07_first_per_line", """SELECT CellLines, Drugs, round(Class_0, 6) AS Class_0 FROM (SELECT *, row_number() OVER (PARTITION BY CellLines ORDER BY Class_0 DESC, Drugs) AS r FROM drug_scores) WHERE r = 1""")
def e07(spark, sf):
    rows = scores(spark, sf, by_drug=True).select("CellLines", "Drugs", "Class_0", (-F.col("Class_0")).alias("_o"))
    return rounded(ordering.first_per_key(rows, ["CellLines"], ["_o", "Drugs"]).drop("_o"))


@query("f01_top_features", """SELECT feature, round(abs(avg(v)), 6) AS importance FROM (SELECT feature, l_suppkey, v FROM
  (UNPIVOT (SELECT l_suppkey, avg(Nucleus_Area) AS Nucleus_Area, avg(Nucleus_Intensity / 1000) AS Nucleus_Intensity, avg(Cell_Spots) AS Cell_Spots,
  avg(Cell_Intensity_Sum) AS Cell_Intensity_Sum FROM cells GROUP BY 1) ON Nucleus_Area, Nucleus_Intensity, Cell_Spots, Cell_Intensity_Sum INTO NAME feature VALUE v))
  GROUP BY 1 ORDER BY 2 DESC LIMIT 3""")
def f01(spark, sf):
    table = _attribution_rows(spark, sf).select(F.col("l_suppkey").alias("fold"), "feature", F.col("mean").alias("value"))
    return rounded(agg.top_features(table, 3))


@query("f02_set_operations", """SELECT 'difference' AS op, CellLines FROM (SELECT CellLines FROM wells EXCEPT SELECT CellLines FROM wells WHERE NCells > 125)
  UNION ALL SELECT 'intersection', CellLines FROM (SELECT CellLines FROM wells WHERE NCells > 118 INTERSECT SELECT CellLines FROM wells WHERE NCells < 78)
  UNION ALL SELECT 'union', CellLines FROM (SELECT CellLines FROM wells WHERE NCells > 125 UNION SELECT CellLines FROM wells WHERE NCells < 75)""")
def f02(spark, sf):
    meta = wells(spark, sf)
    def lines(cond):
        return meta.filter(cond).select("CellLines")
    n = F.col("NCells")
    parts = {"difference": meta.select("CellLines").subtract(lines(n > 125)), "intersection": lines(n > 118).intersect(lines(n < 78)),
             "union": lines(n > 125).union(lines(n < 75)).distinct()}
    return joins.union_all([df.select(F.lit(k).alias("op"), "CellLines") for k, df in parts.items()])


@query("i18_long_scores", """SELECT CellLines, "True", Mutations, ModelGenetics, ClassIndex, round(v, 6) AS Class_1 FROM (
  SELECT *, 'AMERICA' AS ModelGenetics, 0 AS ClassIndex, Class_0 AS v FROM scores UNION ALL SELECT *, 'ASIA', 1, Class_1 FROM scores UNION ALL SELECT *, 'EUROPE', 2, Class_2 FROM scores)""")
def i18(spark, sf):
    return rounded(long_scores(scores(spark, sf), CLASS_NAMES))


@query("i19_bar_table", """SELECT CellLine, CASE t WHEN 0 THEN 'AMERICA' WHEN 1 THEN 'ASIA' ELSE 'Class_2' END AS TrueClass,
  CASE ClassIndex WHEN 0 THEN 'AMERICA' WHEN 1 THEN 'ASIA' ELSE 'Class_2' END AS PredictedClass, round(p, 6) AS Probability, round(tp, 6) AS TrueClassProb, ClassIndex FROM (
  SELECT CellLines AS CellLine, "True" AS t, i AS ClassIndex, CASE i WHEN 0 THEN Class_0 WHEN 1 THEN Class_1 ELSE Class_2 END AS p,
  CASE "True" WHEN 0 THEN Class_0 WHEN 1 THEN Class_1 ELSE Class_2 END AS tp FROM scores, (VALUES (0), (1), (2)) x(i))""")
def i19(spark, sf):
    return rounded(bar_table(scores(spark, sf), {0: "AMERICA", 1: "ASIA"}))


@query("i19_bar_table_inferred", """SELECT CellLine, t AS TrueClass, i AS ClassIndex, round(p, 6) AS Probability FROM (SELECT CellLines AS CellLine, i,
  'Class_' || CASE WHEN Class_0 >= Class_1 AND Class_0 >= Class_2 THEN 0 WHEN Class_1 >= Class_2 THEN 1 ELSE 2 END AS t,
  CASE i WHEN 0 THEN Class_0 WHEN 1 THEN Class_1 ELSE Class_2 END AS p FROM scores, (VALUES (0), (1), (2)) x(i))""")
def i19b(spark, sf):
    """Without a true class the largest probability stands in."""
    return rounded(bar_table(scores(spark, sf).drop("True"), {7: "unused"}).select("CellLine", "TrueClass", "ClassIndex", "Probability"))


@query("i20_scatter_positions", """SELECT CellLines, ModelGenetics, ResultIndex, round(CASE WHEN Mutations = 'WT' THEN 0 WHEN Mutations = ModelGenetics THEN 0.2
  WHEN Mutations = 'sporadic' THEN 0.4 ELSE 1 + 0.3 * (m.r - CASE WHEN g.r < m.r THEN 1 ELSE 0 END) END::DOUBLE, 6) AS mutation_position,
  CASE WHEN Mutations IN ('WT', 'sporadic') OR Mutations = ModelGenetics THEN 0.8 ELSE 0.3 END::DOUBLE AS alpha FROM preds
  LEFT JOIN (VALUES ('AMERICA', 0), ('ASIA', 1), ('EUROPE', 2)) m(name, r) ON Mutations = m.name LEFT JOIN (VALUES ('AMERICA', 0), ('ASIA', 1), ('EUROPE', 2)) g(name, r) ON ModelGenetics = g.name""")
def i20(spark, sf):
    out = scatter_table(predictions(spark, sf))
    return rounded(out.select("CellLines", "ModelGenetics", "ResultIndex", "mutation_position", "alpha"))
