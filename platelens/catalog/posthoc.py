"""Queries: fusion (H6, H7), attribution (H12-H14), post-hoc statistics (I) and conformal regions (F4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from platelens.catalog.base import (
    FEATURES, lineitem, marker_probabilities, predictions, query, rounded, scores, suppliers, table,
)
from platelens.functions import metrics
from platelens.functions.sizing import join_bounded
from platelens.operators.joins import union_all
from platelens.plans import attribution, conformal, correction, multiscreen
from platelens.plans.fusion import entropy_weighted, evaluation_table

RANKED = """n AS (SELECT count(*) AS n FROM nonconf), ranked AS (SELECT nc, row_number() OVER (ORDER BY nc) AS r FROM nonconf)"""


def _threshold(q: float, name: str) -> str:
    return f"""{name} AS (SELECT max(CASE WHEN r = floor(h) + 1 THEN nc END) + (max(h) - floor(max(h))) * (max(CASE WHEN r = ceil(h) + 1 THEN nc END)
    - max(CASE WHEN r = floor(h) + 1 THEN nc END)) AS t FROM ranked, (SELECT (n - 1) * least(1.0::DOUBLE, {q}::DOUBLE * (n + 1) / n) AS h FROM n))"""


@query("f04_conformal_regions", f"""WITH {RANKED}, {_threshold(0.75, 'ta')}, {_threshold(0.9, 'tb')},
  limits AS (SELECT 0.75::DOUBLE AS quantile, t FROM ta UNION ALL SELECT 0.9::DOUBLE, t FROM tb),
  grid AS (SELECT a.i AS i, b.i AS j, 20 - a.i - b.i AS k FROM range(0, 21) a(i), range(0, 21) b(i) WHERE a.i + b.i <= 20)
  SELECT quantile, c AS class, i / 20.0::DOUBLE AS Class_0, j / 20.0::DOUBLE AS Class_1, k / 20.0::DOUBLE AS Class_2 FROM limits, grid, (VALUES (0), (1), (2)) x(c)
  WHERE (CASE c WHEN 0 THEN i WHEN 1 THEN j ELSE k END) / 20.0::DOUBLE >= 1 - t - 1e-9""")
def f04(spark, sf):
    """grid vectors in which each class enters the set, at two levels."""
    return conformal.regions(conformal.thresholds(scores(spark, sf), [0.75, 0.9]), 3, 0.05)


ENTROPY = """h AS (SELECT CellLines, "True", Antibody, greatest(0, (ln(3) + sum(p * ln(p + 1e-8))) / ln(3)) AS w FROM marker_probs GROUP BY 1, 2, 3),
  fused AS (SELECT m.CellLines, m."True", m.class, CASE WHEN sum(w) > 0 THEN sum(w * p) / sum(w) ELSE avg(p) END AS p
  FROM marker_probs m JOIN h ON m.CellLines = h.CellLines AND m.Antibody = h.Antibody GROUP BY 1, 2, 3)"""


@query("h06_entropy_fusion", f"WITH {ENTROPY} SELECT CellLines, class, round(p, 6) AS p FROM fused")
def h06(spark, sf):
    return rounded(entropy_weighted(marker_probabilities(spark, sf), ["CellLines"], 3))


@query("h07_evaluation_table", f"""WITH {ENTROPY}, agg AS (SELECT CellLines, "True", class, avg(p) AS p FROM marker_probs GROUP BY 1, 2, 3)
  SELECT a.CellLines, a."True"::INT AS "True", """ + ", ".join(
    [f"round(max(CASE WHEN a.class = {i} THEN a.p END), 6) AS class_{i}_agg" for i in range(3)]
    + [f"round(max(CASE WHEN f.class = {i} AND a.class = {i} THEN f.p END), 6) AS class_{i}_entropy" for i in range(3)]
    + [f'round(max(CASE WHEN m.class = {i} AND m.Antibody = \'{ab}\' THEN m.p END), 6) AS "class_{i}_{ab}"' for ab in "ANR" for i in range(3)]
  ) + """ FROM agg a JOIN fused f ON a.CellLines = f.CellLines AND a.class = f.class JOIN marker_probs m ON a.CellLines = m.CellLines AND a.class = m.class GROUP BY 1, 2""")
def h07(spark, sf):
    """Line-level, entropy-weighted and per-marker probabilities side by side."""
    long = marker_probabilities(spark, sf)
    agg = long.groupBy("CellLines", "True", "class").agg(F.avg("p").alias("p")).withColumn("source", F.lit("agg"))
    fused = entropy_weighted(long, ["CellLines", "True"], 3).withColumn("source", F.lit("entropy"))
    per = long.withColumnRenamed("Antibody", "source")
    return rounded(evaluation_table([agg, fused, per], 3, ["agg", "entropy", "A", "N", "R"]))


LINE_MEANS = """line_means AS (SELECT CellLines, feature, v AS mean FROM (UNPIVOT (SELECT w.CellLines, avg(Nucleus_Area) AS Nucleus_Area,
  avg(Nucleus_Intensity / 1000) AS Nucleus_Intensity, avg(Cell_Spots) AS Cell_Spots, avg(Cell_Intensity_Sum) AS Cell_Intensity_Sum
  FROM cells c JOIN supp w ON c.l_suppkey = w.s_suppkey GROUP BY 1) ON Nucleus_Area, Nucleus_Intensity, Cell_Spots, Cell_Intensity_Sum INTO NAME feature VALUE v))"""
COEF = """long_cells AS (SELECT Mutations, feature, v FROM (UNPIVOT (SELECT Mutations, Nucleus_Area, Nucleus_Intensity / 1000 AS Nucleus_Intensity, Cell_Spots, Cell_Intensity_Sum
  FROM cells c JOIN supp w ON c.l_suppkey = w.s_suppkey) ON Nucleus_Area, Nucleus_Intensity, Cell_Spots, Cell_Intensity_Sum INTO NAME feature VALUE v)),
  coefs AS (SELECT Mutations AS class, feature, avg(v) / var_pop(v) AS coef FROM long_cells GROUP BY 1, 2)"""


def _labelled(spark, sf):
    li = lineitem(spark, sf).select(
        "l_suppkey", F.col("l_quantity").alias("Nucleus_Area"), (F.col("l_extendedprice") / 1000).alias("Nucleus_Intensity"),
        F.col("l_discount").alias("Cell_Spots"), F.col("l_tax").alias("Cell_Intensity_Sum"),
    )
    labels = suppliers(spark, sf).select(F.col("s_suppkey").alias("l_suppkey"), "CellLines", "Mutations")
    return li.join(labels, "l_suppkey")


def _coefficients(rows):
    """Diagonal linear scorer: class mean over class variance of each feature."""
    wide = rows.groupBy("Mutations").agg(*[(F.avg(c) / F.var_pop(c)).alias(c) for c in FEATURES])
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("coef")) for c in FEATURES])
    return wide.select(F.col("Mutations").alias("class"), F.inline(pairs))


@query("h12_integrated_gradients", f"""WITH {LINE_MEANS}, {COEF} SELECT CellLines AS CellLine, class AS "Class", """ + ", ".join(
    f"round(max(CASE WHEN m.feature = '{c}' THEN (mean - 0.5) * coef END), 6) AS Feature_{i}" for i, c in enumerate(FEATURES))
    + " FROM line_means m JOIN coefs c ON m.feature = c.feature GROUP BY 1, 2")
def h12(spark, sf):
    rows = _labelled(spark, sf)
    long = attribution.integrated_gradients(attribution.line_means_long(rows, FEATURES), _coefficients(rows), 0.5)
    return rounded(attribution.attribution_wide(long, FEATURES))


@query("h13_train_eval_attributions", f"""WITH {LINE_MEANS}, t AS (SELECT feature, sum(mean) AS s, count(*) AS n FROM line_means GROUP BY 1),
  folds AS (SELECT CellLines AS Holdout, m.feature, (s - mean) / (n - 1) AS coef FROM line_means m JOIN t ON m.feature = t.feature),
  full_table AS (SELECT Holdout, CellLines, m.feature, mean * coef AS v FROM folds f JOIN line_means m ON f.feature = m.feature)
  SELECT CellLines, feature, round(max(CASE WHEN Holdout = CellLines THEN v END), 4) AS eval,
  round(coalesce(avg(CASE WHEN Holdout <> CellLines THEN v END), 0), 4) AS train FROM full_table GROUP BY 1, 2""")
def h13(spark, sf):
    """Own-fold and other-fold attributions; fold coefficients are leave-one-out means, from totals, never all pairs."""
    means = attribution.line_means_long(_labelled(spark, sf), FEATURES)
    totals = means.groupBy("feature").agg(F.sum("mean").alias("s"), F.count(F.lit(1)).alias("n"))
    folds = join_bounded(means, totals, "feature").select(
        F.col("CellLines").alias("Holdout"), "feature", ((F.col("s") - F.col("mean")) / (F.col("n") - 1)).alias("coef")
    )
    return rounded(attribution.linear_train_eval(means, folds), 4)


@query("h13_marker_means", f"""WITH {LINE_MEANS} SELECT CellLines, CASE WHEN feature LIKE '%Intensity%' THEN 'stain' ELSE 'shape' END AS Antibody,
  round(avg(mean), 6) AS value FROM line_means GROUP BY 1, 2""")
def h13b(spark, sf):
    means = attribution.line_means_long(_labelled(spark, sf), FEATURES).withColumnRenamed("mean", "value")
    kind = F.when(F.col("feature").like("%Intensity%"), "stain").otherwise("shape")
    return rounded(attribution.marker_means(means, means.select("feature", kind.alias("Antibody")).distinct()))


@query("h14_group_importance", f"""WITH {LINE_MEANS}, m AS (SELECT feature, abs(avg(mean)) AS importance FROM line_means GROUP BY 1),
  top AS (SELECT * FROM m ORDER BY importance DESC, feature LIMIT 3),
  g AS (SELECT name, (SELECT coalesce(sum(importance), 0) FROM top WHERE regexp_matches(feature, name)) / (SELECT count(*) FROM m WHERE regexp_matches(feature, name)) AS v
    FROM (VALUES ('^Nucleus'), ('Intensity'), ('Spots$')) x(name))
  SELECT name AS "group", round(v / (SELECT sum(v) FROM g), 6) AS importance FROM g""")
def h14(spark, sf):
    means = attribution.line_means_long(_labelled(spark, sf), FEATURES)
    folds = means.select(F.col("CellLines").alias("fold"), "feature", F.col("mean").alias("value"))
    return rounded(attribution.group_importance(folds, ["^Nucleus", "Intensity", "Spots$"], 3))


def _slope(c: str, source: str = "scores") -> str:
    return f"""(SELECT sum((x - mx) * (y - my)) / sum((x - mx) * (x - mx)) FROM (SELECT NCells AS x, {c} AS y,
      avg(NCells) OVER (PARTITION BY Mutations) AS mx, avg({c}) OVER (PARTITION BY Mutations) AS my FROM {source}))"""


@query("i01_count_correction", f"SELECT CellLines, round(Class_1 + {_slope('Class_1')} * (1000 - NCells), 6) AS Score_corrected FROM scores")
def i01(spark, sf):
    return rounded(correction.correct_score(scores(spark, sf)).select("CellLines", "Score_corrected"))


@query("i02_multiclass_correction", f"""WITH z AS (SELECT CellLines, {', '.join(f"exp(Class_{i} + {_slope(f'Class_{i}')} * (1000 - NCells)) AS e{i}" for i in range(3))} FROM scores)
  SELECT CellLines, {', '.join(f'round(e{i} / (e0 + e1 + e2), 6) AS Class_{i}_corrected' for i in range(3))} FROM z""")
def i02(spark, sf):
    out = correction.correct_classes(scores(spark, sf))
    return rounded(out.select("CellLines", *[f"Class_{i}_corrected" for i in range(3)]))


@query("i03_adjustment_lines", f"""WITH kept AS (SELECT * FROM scores WHERE Mutations <> 'sporadic'), b AS (SELECT {_slope('Class_1', 'kept')} AS b)
  SELECT CellLines, Mutations, NCells, round(b, 6) AS slope, round(avg(Class_1) OVER (PARTITION BY Mutations) - b * avg(NCells) OVER (PARTITION BY Mutations), 6) AS intercept,
  round(avg(Class_1) OVER (PARTITION BY Mutations) + b * (NCells - avg(NCells) OVER (PARTITION BY Mutations)), 6) AS fitted FROM kept, b""")
def i03(spark, sf):
    return rounded(correction.fitted_lines(scores(spark, sf)))


@query("i04_nonconformity", "SELECT CellLines, round(nc, 6) AS nonconformity FROM nonconf")
def i04(spark, sf):
    return rounded(conformal.nonconformity(scores(spark, sf)).select("CellLines", "nonconformity"))


@query("i05_threshold_grid", f"""WITH {RANKED}, {_threshold(0.75, 'ta')}, {_threshold(0.9, 'tb')}, {_threshold(0.95, 'tc')}
  SELECT 0.75::DOUBLE AS quantile, round(t, 6) AS threshold FROM ta UNION ALL SELECT 0.9::DOUBLE, round(t, 6) FROM tb UNION ALL SELECT 0.95::DOUBLE, round(t, 6) FROM tc""")
def i05(spark, sf):
    return rounded(conformal.thresholds(scores(spark, sf), [0.75, 0.9, 0.95]))


def _set(t: str) -> str:
    return f"""concat_ws(',', CASE WHEN Class_0 >= 1 - {t} THEN '0' END, CASE WHEN Class_1 >= 1 - {t} THEN '1' END, CASE WHEN Class_2 >= 1 - {t} THEN '2' END)"""


@query("i06_prediction_sets", f"""WITH {RANKED}, {_threshold(0.75, 'ta')} SELECT CellLines, "True", {_set('t')} AS PredictionSet, nc <= t AS Covered FROM nonconf, ta""")
def i06(spark, sf):
    table = scores(spark, sf)
    return _joined(conformal.sets_split(table, table, 0.75))


def _joined(sets):
    return sets.withColumn("PredictionSet", F.concat_ws(",", "PredictionSet"))


CROSS = """halved AS (SELECT s.*, CASE WHEN pos <= floor(total / 2) THEN 0 ELSE 1 END AS half FROM nonconf s JOIN (SELECT CellLines, row_number() OVER (ORDER BY md5(CellLines || '|42')) AS pos,
    count(*) OVER () AS total FROM (SELECT DISTINCT CellLines FROM nonconf)) h ON s.CellLines = h.CellLines),
  sized AS (SELECT half, nc, row_number() OVER (PARTITION BY half ORDER BY nc) AS r, count(*) OVER (PARTITION BY half) AS n FROM halved),
  levelled AS (SELECT *, (n - 1) * least(1.0::DOUBLE, 0.75::DOUBLE * (n + 1) / n) AS h FROM sized),
  limits AS (SELECT half, max(CASE WHEN r = floor(h) + 1 THEN nc END) + (max(h) - floor(max(h))) * (max(CASE WHEN r = ceil(h) + 1 THEN nc END)
    - max(CASE WHEN r = floor(h) + 1 THEN nc END)) AS t FROM levelled GROUP BY half)"""


@query("i07_cross_conformal", f"""WITH {CROSS} SELECT CellLines, "True", {_set('t')} AS PredictionSet,
  CASE "True" WHEN 0 THEN Class_0 WHEN 1 THEN Class_1 ELSE Class_2 END >= 1 - t AS Covered FROM halved s JOIN limits l ON l.half = 1 - s.half""")
def i07(spark, sf):
    return _joined(conformal.sets_cross(scores(spark, sf), 0.75, 42))


@query("i08_coverage", f"""WITH {CROSS} SELECT round(avg(CASE WHEN CASE "True" WHEN 0 THEN Class_0 WHEN 1 THEN Class_1 ELSE Class_2 END >= 1 - t THEN 1.0 ELSE 0.0 END), 6) AS coverage,
  round(avg((Class_0 >= 1 - t)::INT + (Class_1 >= 1 - t)::INT + (Class_2 >= 1 - t)::INT), 6) AS mean_size FROM halved s JOIN limits l ON l.half = 1 - s.half""")
def i08(spark, sf):
    return rounded(conformal.coverage(conformal.sets_cross(scores(spark, sf), 0.75, 42)))


BINARY = """b AS (SELECT Drugs AS "group", Class_1 AS p, CASE WHEN Mutations = 'WT' THEN 0 ELSE 1 END AS y FROM drug_scores),
  rk AS (SELECT *, rank() OVER (PARTITION BY "group" ORDER BY p) + (count(*) OVER (PARTITION BY "group", p) - 1) / 2.0::DOUBLE AS r FROM b)"""


@query("i09_binary_metrics", f"""WITH {BINARY}, g AS (SELECT "group", avg(CASE WHEN (p > 0.5)::INT = y THEN 1.0 ELSE 0.0 END) AS accuracy,
  avg(-(y * ln(least(greatest(p, 1e-15), 1 - 1e-15)) + (1 - y) * ln(1 - least(greatest(p, 1e-15), 1 - 1e-15)))) AS cross_entropy,
  (sum(CASE WHEN y = 1 THEN r ELSE 0 END) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * sum(1 - y))::DOUBLE AS auc FROM rk GROUP BY 1)
  SELECT "group", 'accuracy' AS metric, round(accuracy, 6) AS value FROM g UNION ALL SELECT "group", 'cross_entropy', round(cross_entropy, 6) FROM g
  UNION ALL SELECT "group", 'auc', round(auc, 6) FROM g""")
def i09(spark, sf):
    by = scores(spark, sf, by_drug=True).select(
        F.col("Drugs").alias("group"), F.col("Class_1").alias("score"), (F.col("Mutations") != "WT").cast("int").alias("True")
    )
    return rounded(metrics.binary_metrics(by, ["group"]))


MEANED = """meaned AS (SELECT CellLines, ModelGenetics, ResultIndex, Mutations, avg(Class_1) AS p FROM preds GROUP BY ALL),
  contrast AS (SELECT ModelGenetics, ResultIndex, Mutations AS Mutation, p, 1 AS y FROM meaned WHERE Mutations <> 'WT' UNION ALL
    SELECT w.ModelGenetics, w.ResultIndex, m.Mutations, w.p, 0 FROM meaned w JOIN (SELECT DISTINCT ModelGenetics, ResultIndex, Mutations FROM meaned WHERE Mutations <> 'WT') m
    ON w.ModelGenetics = m.ModelGenetics AND w.ResultIndex = m.ResultIndex WHERE w.Mutations = 'WT')"""
AUROC = """ranks AS (SELECT *, rank() OVER (PARTITION BY ModelGenetics, ResultIndex, Mutation ORDER BY p)
  + (count(*) OVER (PARTITION BY ModelGenetics, ResultIndex, Mutation, p) - 1) / 2.0::DOUBLE AS r FROM contrast),
  aurocs AS (SELECT ModelGenetics, ResultIndex, Mutation, (sum(CASE WHEN y = 1 THEN r ELSE 0 END) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * sum(1 - y))::DOUBLE AS AUROC
  FROM ranks GROUP BY 1, 2, 3 HAVING sum(y) > 0 AND sum(1 - y) > 0)"""


@query("i10_mutation_auroc", f"WITH {MEANED}, {AUROC} SELECT ModelGenetics, ResultIndex, Mutation, round(AUROC, 6) AS AUROC FROM aurocs")
def i10(spark, sf):
    return rounded(metrics.mutation_auroc(predictions(spark, sf), ["ModelGenetics", "ResultIndex"]))


@query("i10_auroc_heatmap", f"""WITH {MEANED}, {AUROC} SELECT ModelGenetics, round(avg(CASE WHEN ResultIndex = 'F' THEN AUROC END), 6) AS F,
  round(avg(CASE WHEN ResultIndex = 'O' THEN AUROC END), 6) AS O FROM aurocs WHERE Mutation = ModelGenetics GROUP BY 1""")
def i10b(spark, sf):
    found = metrics.mutation_auroc(predictions(spark, sf), ["ModelGenetics", "ResultIndex"])
    return rounded(metrics.matching_heatmap(found, "AUROC", "ResultIndex", ["F", "O"]))


@query("i11_group_auroc", """WITH g AS (SELECT ModelGenetics, CellLines, Mutations, avg(Class_1) AS p FROM preds WHERE Mutations <> 'sporadic' GROUP BY 1, 2, 3),
  k AS (SELECT *, CASE WHEN Mutations = 'WT' THEN 0 ELSE 1 END AS y, rank() OVER (PARTITION BY ModelGenetics ORDER BY p) + (count(*) OVER (PARTITION BY ModelGenetics, p) - 1) / 2.0::DOUBLE AS r FROM g)
  SELECT ModelGenetics, round((sum(CASE WHEN y = 1 THEN r ELSE 0 END) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * sum(1 - y))::DOUBLE, 6) AS AUROC FROM k GROUP BY 1""")
def i11(spark, sf):
    rows = predictions(spark, sf)
    per_model = [metrics.group_auroc(rows.filter(F.col("ModelGenetics") == g), "CellLines", "Class_1").withColumn("ModelGenetics", F.lit(g))
                 for g in ("AMERICA", "ASIA", "EUROPE")]
    return rounded(union_all(per_model))


CONFUSION = """conf AS (SELECT ModelGenetics, ResultIndex, Mutation, sum(CASE WHEN p >= 0.5 AND y = 1 THEN 1 ELSE 0 END)::BIGINT AS TP, sum(CASE WHEN p >= 0.5 AND y = 0 THEN 1 ELSE 0 END)::BIGINT AS FP,
  sum(CASE WHEN p < 0.5 AND y = 1 THEN 1 ELSE 0 END)::BIGINT AS FN, sum(CASE WHEN p < 0.5 AND y = 0 THEN 1 ELSE 0 END)::BIGINT AS TN FROM contrast GROUP BY 1, 2, 3
  HAVING sum(y) > 0 AND sum(1 - y) > 0)"""


@query("i12_confusion", f"""WITH {MEANED}, {CONFUSION} SELECT ModelGenetics, ResultIndex, Mutation, TP, FP, FN, TN,
  round(CASE WHEN TP + FP > 0 THEN TP / (TP + FP)::DOUBLE ELSE 0 END, 6) AS PPV, round(CASE WHEN TP + FN > 0 THEN TP / (TP + FN)::DOUBLE ELSE 0 END, 6) AS Recall,
  TP + FP AS called, TP + FN AS actual FROM conf""")
def i12(spark, sf):
    return rounded(metrics.confusion(predictions(spark, sf), ["ModelGenetics", "ResultIndex"]))


@query("i12_recall_fractions", f"""WITH {MEANED}, {CONFUSION} SELECT ModelGenetics, max(CASE WHEN ResultIndex = 'F' THEN TP || '/' || (TP + FN) END) AS F,
  max(CASE WHEN ResultIndex = 'O' THEN TP || '/' || (TP + FN) END) AS O FROM conf WHERE Mutation = ModelGenetics GROUP BY 1""")
def i12b(spark, sf):
    found = metrics.confusion(predictions(spark, sf), ["ModelGenetics", "ResultIndex"])
    return metrics.matching_fractions(found, "TP", "actual", "ResultIndex", ["F", "O"])


@query("i13_class_accuracy", """SELECT "True", round(avg(CASE WHEN "True" = CASE WHEN Class_0 >= Class_1 AND Class_0 >= Class_2 THEN 0 WHEN Class_1 >= Class_2 THEN 1 ELSE 2 END
  THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n FROM scores GROUP BY 1""")
def i13(spark, sf):
    return rounded(metrics.class_accuracy(scores(spark, sf)))


@query("i14_marker_ablation_table", f"""WITH {MEANED}, {AUROC} SELECT ModelGenetics, Mutation, CASE ResultIndex WHEN 'F' THEN 'FUS' ELSE 'EEA1' END AS Marker,
  CASE ResultIndex WHEN 'F' THEN '647' ELSE '488' END AS Wavelength, round(AUROC, 6) AS AUROC FROM aurocs""")
def i14(spark, sf):
    """Result files named by markers and wavelength, parsed to the dropped marker and joined to the metric."""
    found = metrics.mutation_auroc(predictions(spark, sf), ["ModelGenetics", "ResultIndex"])
    name = F.concat(F.lit("binary-FUS-EEA1-"), F.when(F.col("ResultIndex") == "F", "647").otherwise("488"))
    files = metrics.marker_of_result(found.select("ResultIndex", name.alias("file")).distinct())
    out = found.join(files, "ResultIndex", "left")
    return rounded(out.select("ModelGenetics", "Mutation", "Marker", "Wavelength", "AUROC"))


def _embedded(spark, sf):
    return table(spark, sf, "embeddings").select(
        F.concat(F.lit("S"), (F.col("vec_id") % 3).cast("string")).alias("Screen"), F.when((F.col("vec_id") % 3 == 2) & (F.col("label") == 3), "3b").otherwise(F.col("label").cast("string")).alias("CellLines"), "embedding"
    )


EMBEDDED = """e AS (SELECT 'S' || (vec_id % 3) AS Screen, CASE WHEN vec_id % 3 = 2 AND label = 3 THEN '3b' ELSE label::VARCHAR END AS CellLines, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS dim FROM embeddings),
  means AS (SELECT Screen, CellLines, dim, avg(v) AS v FROM e GROUP BY 1, 2, 3),
  d AS (SELECT a.Screen AS screen1, b.Screen AS screen2, a.CellLines, 1 - sum(a.v * b.v) / (sqrt(sum(a.v * a.v)) * sqrt(sum(b.v * b.v))) AS d
    FROM means a JOIN means b ON a.CellLines = b.CellLines AND a.dim = b.dim AND a.Screen < b.Screen GROUP BY 1, 2, 3),
  dist AS (SELECT screen1, screen2, avg(d) AS distance, count(*) AS lines FROM d GROUP BY 1, 2)"""


@query("i15_screen_alignment", f"WITH {EMBEDDED} SELECT round(distance, 6) AS distance FROM dist WHERE screen1 = 'S0' AND screen2 = 'S2'")
def i15(spark, sf):
    return rounded(multiscreen.embedding_distance(multiscreen.line_means(_embedded(spark, sf), vector="embedding"), "S0", "S2"))


@query("i16_distance_matrix", f"""WITH {EMBEDDED}, best AS (SELECT screen1 AS b1, screen2 AS b2 FROM dist WHERE distance > 0 ORDER BY distance, screen1, screen2 LIMIT 1),
  both_ways AS (SELECT screen1, screen2, distance FROM dist UNION ALL SELECT screen2, screen1, distance FROM dist UNION ALL SELECT s, s, 0 FROM (VALUES ('S0'), ('S1'), ('S2')) x(s))
  SELECT screen1, screen2, round(distance, 6) AS distance, CASE WHEN screen1 = b1 THEN 0 WHEN screen1 = b2 THEN 1 ELSE 2 END AS place1,
  CASE WHEN screen2 = b1 THEN 0 WHEN screen2 = b2 THEN 1 ELSE 2 END AS place2 FROM both_ways, best""")
def i16(spark, sf):
    rows = _embedded(spark, sf)
    distances = multiscreen.screen_distances(multiscreen.line_means(rows, vector="embedding"))
    return rounded(multiscreen.distance_matrix(distances, rows.select("Screen").distinct()))


@query("i17_correlation_rmse", """SELECT round(corr(Class_0, Class_1), 6) AS cor, round(sqrt(avg((Class_0 - Class_1) * (Class_0 - Class_1))) / (var_pop(Class_0) + 1e-7), 4) AS rmse FROM scores""")
def i17(spark, sf):
    rows = scores(spark, sf)
    cor = metrics.correlation(rows, "Class_0", "Class_1").select(F.lit("cor").alias("k"), F.col("cor").alias("v"))
    rmse = metrics.relative_rmse(rows, "Class_0", "Class_1").select(F.lit("rmse").alias("k"), F.col("rmse").alias("v"))
    out = union_all([cor, rmse]).agg(F.max(F.when(F.col("k") == "cor", F.col("v"))).alias("cor"), F.max(F.when(F.col("k") == "rmse", F.col("v"))).alias("rmse"))
    return out.select(F.round(F.col("cor") + 1e-10, 6).alias("cor"), F.round(F.col("rmse") + 1e-8, 4).alias("rmse"))


