"""Queries: splits, folds and sampling (G), scoring models (H), components, alignment and arriving files (J)."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platelens.catalog.base import FEATURES, cells, query, rounded, scores, screen, wells
from platelens.catalog.loading import SPLIT
from platelens.functions.sizing import as_local, kept, shared_folder
from platelens.operators.joins import cells_with_wells, union_all
from platelens.plans import attribution, balance, folds, forest, labels, manyfits, multiscreen, sufficient
from platelens.plans.analysis import MAP, parameter_grid, stability
from platelens.plans.fitters import _Task
from platelens.plans.components import profile_components, score_components
from platelens.screen import MarkerScreens, Screen
from platelens.streaming import ingest

#: Cells of a line that a forest trains on at most.
TRAINING_CELLS = 1000
GENETICS = ["AMERICA", "ASIA", "EUROPE"]


@query("g01_stratified_split", f"WITH {SPLIT} SELECT CellLines, Mutations, split FROM split")
def g01(spark, sf):
    return folds.stratified_split(wells(spark, sf), 0.5, 47)


@query("g01_split_wells", f"WITH {SPLIT} SELECT ID, w.CellLines, w.Mutations, split FROM wells w JOIN split s ON w.CellLines = s.CellLines")
def g01b(spark, sf):
    return folds.split_wells(wells(spark, sf), 0.5, 47)


@query("g02_mutation_lines", "SELECT CellLines FROM lines WHERE Mutations IN ('ASIA', 'sporadic')")
def g02(spark, sf):
    return folds.mutation_lines(wells(spark, sf), ["ASIA", "sporadic"])


LINE_CELLS = "line_cells AS (SELECT CellLines, Mutations, sum(NCells)::BIGINT AS cells FROM wells GROUP BY 1, 2)"


def _line_cells(spark, sf):
    return wells(spark, sf).groupBy("CellLines").agg(F.sum("NCells").alias("cells"))


@query("g03_leave_one_out_folds", f"""WITH {LINE_CELLS}, pool AS (SELECT * FROM line_cells WHERE Mutations <> 'sporadic')
  SELECT 'all' AS ModelGenetics, f.CellLines AS Holdout, count(*) FILTER (l.Mutations <> 'sporadic' AND l.CellLines <> f.CellLines) AS train_lines,
  (sum(l.cells) FILTER (l.Mutations <> 'sporadic' AND l.CellLines <> f.CellLines))::BIGINT AS train_cells,
  count(*) FILTER (l.Mutations = 'sporadic' OR l.CellLines = f.CellLines) AS predict_lines,
  (sum(l.cells) FILTER (l.Mutations = 'sporadic' OR l.CellLines = f.CellLines))::BIGINT AS predict_cells FROM pool f, line_cells l GROUP BY 2""")
def g03(spark, sf):
    """Sizes of every leave-one-out fold; the check lists folds x lines, the job subtracts from totals."""
    return folds.fold_sizes(folds.eligibility(wells(spark, sf)), _line_cells(spark, sf))


@query("g03_fold_roles", """SELECT 'all' AS ModelGenetics, CellLines, Mutations, CASE WHEN Mutations <> 'sporadic' THEN CellLines END AS Holdout,
  CASE WHEN Mutations <> 'sporadic' THEN 'held_out' ELSE 'every_fold' END AS role FROM lines""")
def g03b(spark, sf):
    return folds.leave_one_out_folds(folds.eligibility(wells(spark, sf)))


@query("g04_per_mutation_folds", f"""WITH {LINE_CELLS}, m AS (SELECT g AS ModelGenetics, l.*, Mutations IN ('WT', g) AS e FROM line_cells l, (VALUES ('AMERICA'), ('ASIA'), ('EUROPE')) x(g))
  SELECT f.ModelGenetics, f.CellLines AS Holdout, count(*) FILTER (l.e AND l.CellLines <> f.CellLines) AS train_lines,
  coalesce((sum(l.cells) FILTER (l.e AND l.CellLines <> f.CellLines))::BIGINT, 0) AS train_cells, count(*) FILTER (NOT l.e OR l.CellLines = f.CellLines) AS predict_lines,
  (sum(l.cells) FILTER (NOT l.e OR l.CellLines = f.CellLines))::BIGINT AS predict_cells FROM m f JOIN m l ON f.ModelGenetics = l.ModelGenetics WHERE f.e GROUP BY 1, 2""")
def g04(spark, sf):
    meta = wells(spark, sf)
    return folds.fold_sizes(folds.eligibility(meta, folds.model_genetics(meta)), _line_cells(spark, sf))


@query("g05_reciprocal_halves", """WITH r AS (SELECT l.*, rep, row_number() OVER (PARTITION BY rep, Mutations ORDER BY md5(CellLines || '|' || rep || '|47')) AS pos,
  count(*) OVER (PARTITION BY rep, Mutations) AS n FROM lines l, range(0, 3) x(rep)),
  o AS (SELECT *, CASE WHEN pos <= round_even(0.5 * n, 0) THEN 0 ELSE 1 END AS own FROM r)
  SELECT rep::INT AS rep, half::INT AS half, CellLines, Mutations, CASE WHEN own = half AND Mutations <> 'sporadic' THEN 'train' ELSE 'predict' END AS role FROM o, (VALUES (0), (1)) h(half)""")
def g05(spark, sf):
    return folds.reciprocal_halves(wells(spark, sf), reps=3, seed=47)


def _line_rows(spark, sf):
    """Cells with their key and line."""
    meta = wells(spark, sf).select("ID", "CellLines", "Mutations")
    return cells_with_wells(cells(spark, sf, key=True), meta)


@query("g06_cells_per_line", """WITH s AS (SELECT ID, cell_key, md5(cell_key || '|47') AS h FROM keyed_cells),
  r AS (SELECT *, row_number() OVER (PARTITION BY ID ORDER BY h, cell_key) AS pos, least(count(*) OVER (PARTITION BY ID), 100) AS have FROM s),
  short AS (SELECT ID, draw, have, 1 + ('0x' || substr(md5(ID || '|' || draw || '|47'), 1, 13))::BIGINT % have AS pos
    FROM (SELECT DISTINCT ID, have FROM r WHERE have < 100), range(1, 101) x(draw)),
  picked AS (SELECT ID, cell_key FROM r WHERE pos <= 100 AND have >= 100 UNION ALL SELECT r.ID, cell_key FROM short d JOIN r ON r.ID = d.ID AND r.pos = d.pos)
  SELECT ID, count(*) AS n, count(DISTINCT cell_key) AS distinct_cells, min(cell_key) AS first_key FROM picked GROUP BY 1""")
def g06(spark, sf):
    """Exactly 100 cells per well, drawn with replacement where a well is short."""
    out = balance.cells_per_line(cells(spark, sf, key=True).select("ID", "cell_key"), ["ID"], 100, 47)
    return out.groupBy("ID").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("cell_key").alias("distinct_cells"), F.min("cell_key").alias("first_key"))


@query("g07_upsampled_lines", """WITH big AS (SELECT DISTINCT CellLines, CASE WHEN length(CellLines) > 8 THEN 'EUROPE' ELSE Mutations END AS Mutations FROM wells),
  r AS (SELECT *, row_number() OVER (PARTITION BY Mutations ORDER BY md5(CellLines || '|47')) AS pos, count(*) OVER (PARTITION BY Mutations) AS n FROM big),
  m AS (SELECT max(n) AS most FROM r), x AS (SELECT DISTINCT Mutations, n FROM r),
  d AS (SELECT Mutations, c AS copy, 1 + ('0x' || substr(md5(Mutations || '|' || c || '|47'), 1, 13))::BIGINT % n AS pos FROM x, m, range(1, 100) q(c) WHERE c <= most - n)
  SELECT CellLines, Mutations, 0::BIGINT AS copy FROM big UNION ALL SELECT CellLines, r.Mutations, copy FROM d JOIN r ON d.Mutations = r.Mutations AND d.pos = r.pos""")
def g07(spark, sf):
    meta = wells(spark, sf)
    uneven = meta.withColumn("Mutations", F.when(F.length("CellLines") > 8, "EUROPE").otherwise(F.col("Mutations")))
    lines = folds.lines_of(uneven)
    return balance.upsample_lines(lines, 47)


@query("g07_class_weights", """SELECT Mutations, count(*) AS n, round(max(count(*)) OVER () / count(*)::DOUBLE, 6) AS weight FROM wells GROUP BY 1""")
def g07b(spark, sf):
    return rounded(balance.class_weights(wells(spark, sf), "Mutations"))


@query("g08_balanced_cells", """WITH r AS (SELECT Antibody AS label, cell_key, row_number() OVER (PARTITION BY Antibody ORDER BY md5(cell_key || '|47')) AS pos FROM keyed_cells),
  k AS (SELECT min(n) AS least FROM (SELECT count(*) AS n FROM r GROUP BY label)) SELECT label, count(*) AS n, min(cell_key) AS first_key, max(cell_key) AS last_key FROM r, k WHERE pos <= least GROUP BY 1""")
def g08(spark, sf):
    rows = cells(spark, sf, key=True, labels=True).select("cell_key", F.col("Antibody").alias("label"))
    kept = balance.balanced_rows(rows, "label", "down", 47)
    return kept.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("cell_key").alias("first_key"), F.max("cell_key").alias("last_key"))


@query("g08_upsampled_cells", """WITH c AS (SELECT Antibody AS label, count(*) AS k FROM cells GROUP BY 1) SELECT label, (SELECT max(k) FROM c) AS n, k AS distinct_cells FROM c""")
def g08b(spark, sf):
    rows = cells(spark, sf, key=True, labels=True).select("cell_key", F.col("Antibody").alias("label"))
    up = balance.balanced_rows(rows, "label", "up", 47)
    per = up.groupBy("label", "cell_key").count().groupBy("label")
    return per.agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("distinct_cells"))


@query("g09_label_codes", """SELECT w.ID, dense_rank() OVER (ORDER BY CellLines) - 1 AS line_code, CASE Mutations WHEN 'WT' THEN 0 WHEN 'ASIA' THEN 1 WHEN 'EUROPE' THEN 2
  WHEN 'AMERICA' THEN 3 ELSE 4 END::BIGINT AS label FROM wells w""")
def g09(spark, sf):
    mapping = {"WT": 0, "ASIA": 1, "EUROPE": 2, "AMERICA": 3, "sporadic": 4}
    meta = labels.encode_labels(wells(spark, sf), "CellLines", None, "line_code")
    return labels.encode_labels(meta, "Mutations", mapping).select("ID", "line_code", "label")


@query("g10_wild_type_first", "SELECT ID, CASE Mutations WHEN 'WT' THEN 0 WHEN 'AMERICA' THEN 1 WHEN 'ASIA' THEN 2 WHEN 'EUROPE' THEN 3 ELSE 4 END::BIGINT AS Mutations FROM wells")
def g10(spark, sf):
    return labels.encode_wild_type_first(wells(spark, sf), "Mutations").select("ID", "Mutations")


@query("g11_response", """SELECT Antibody, CASE Mutations WHEN 'WT' THEN 0 WHEN 'AMERICA' THEN 1 WHEN 'ASIA' THEN 2 WHEN 'EUROPE' THEN 3 ELSE 4 END::BIGINT AS Mutations,
  sum(NCells)::BIGINT AS cells FROM wells GROUP BY 1, 2""")
def g11(spark, sf):
    """Responses aligned to cells, per marker; markers must share their labels."""
    params = {"analysis": {"MAP": {"response": "Mutations"}}}
    parts = MarkerScreens.split(cells(spark, sf), wells(spark, sf), params).response()
    return union_all([df.groupBy("Mutations").agg(F.count(F.lit(1)).alias("cells")).select(F.lit(m).alias("Antibody"), "Mutations", "cells")
                      for m, df in parts.items()])


@query("g12_repeated_draws", """WITH d AS (SELECT Antibody, Mutations, rep, Nucleus_Area, Cell_Spots, row_number() OVER (PARTITION BY Antibody, Mutations, rep
    ORDER BY md5(cell_key || '|' || rep || '|47'), cell_key) AS pos FROM keyed_cells JOIN supp ON l_suppkey = s_suppkey, range(0, 4) x(rep)),
  m AS (SELECT Antibody, Mutations, rep, avg(Nucleus_Area) AS a, avg(Cell_Spots) AS s FROM d WHERE pos <= 250 GROUP BY 1, 2, 3)
  SELECT Antibody, Mutations, round(avg(a), 6) AS Nucleus_Area, round(avg(s), 6) AS Cell_Spots, count(*) AS reps FROM m GROUP BY 1, 2""")
def g12(spark, sf):
    """Four draws of 250 cells per (marker, mutation), averaged."""
    rows = _line_rows(spark, sf).withColumn("Antibody", F.substring("ID", 1, 1))
    return rounded(balance.repeated_means(rows, ["Antibody", "Mutations"], ["Nucleus_Area", "Cell_Spots"], 250, 4, 47))


@query("g13_domain_codes", """SELECT ID, dense_rank() OVER (ORDER BY Screen) - 1 AS domain, dense_rank() OVER (ORDER BY CellLines) - 1 AS label FROM wells""")
def g13(spark, sf):
    return labels.encode_domains(wells(spark, sf)).select("ID", "domain", "label")


BINARY = {"WT": 0, "AMERICA": 1, "ASIA": 1, "EUROPE": 1, "sporadic": 1}


#: Draws of a line in the two-level scorers: cells an epoch, and epochs.
DRAWS, EPOCHS = 50, 4
SETTINGS = [0.02, 0.05, 0.1, 0.2, 0.5, 1.0, 2.0, 5.0]
REPLICATES = 50


def _two_level_params(mapping, model):
    loader = {"response_map": {"Mutations": mapping}, "n_cells": DRAWS}
    return {"analysis": {"MAP": {"model": {"MultiAntibody": {**model, "train": {"n_epochs": EPOCHS}}}, "seed": 47, "fitter": "sample_split", "response": "Mutations", "data_loader": loader}}}


@query("g14_stability_grid")
def g14(spark, sf):
    """Eight settings x 50 replicates of the two-level scorer over all groups, as one long metric table."""
    params = _two_level_params(BINARY, {})
    parts = MarkerScreens.split(cells(spark, sf, key=True), wells(spark, sf), params)
    grid = [r.asDict() for r in parameter_grid(spark, C=SETTINGS).collect()]
    return rounded(stability(parts, params, grid, replicates=REPLICATES), 4)


def _map_params(model, fitter, mapping=None, **extra):
    options = {"model": model, "seed": 47, "reps": 1, "fitter": fitter, "response": "Mutations", **extra}
    if mapping:
        options["data_loader"] = {"response_map": {"Mutations": mapping}}
    return {"analysis": {"MAP": options}}


HALVES = """r AS (SELECT CellLines, Mutations, row_number() OVER (PARTITION BY Mutations ORDER BY md5(CellLines || '|0|47')) AS pos, count(*) OVER (PARTITION BY Mutations) AS n FROM lines),
  o AS (SELECT CellLines, Mutations, CASE Mutations WHEN 'AMERICA' THEN 1 WHEN 'ASIA' THEN 2 WHEN 'EUROPE' THEN 3 ELSE 0 END::BIGINT AS label, half, CASE WHEN pos <= round_even(0.5 * n, 0) THEN 0 ELSE 1 END = half AND Mutations <> 'sporadic' AS train FROM r, (VALUES (0), (1)) h(half)),
  size AS (SELECT CellLines, sum(NCells)::BIGINT AS n FROM wells GROUP BY 1)"""
CODES = {"WT": 0, "AMERICA": 1, "ASIA": 2, "EUROPE": 3, "sporadic": 0}


def logistic_sql(folds: str, k: int, select: str, c: float = 1.0, steps: int = 60) -> str:
    """Logistic folds in SQL, by another way than the one they are fitted by: fixed-bound steps (half the Gram matrix bounds
    the curvature) of all folds in one recursive query, with elimination written out for the four features.

    ``folds``: tables that end in ``member`` (fit, CellLines, label from 0 to k - 1) of training lines. ``select`` sees
    ``x`` (CellLines, Mutations, features x0...), ``fit`` (fit, classes) and ``model`` (fit, coefficients b{class}{feature}
    on scaled features, intercepts b{class}{d}, centres u, spreads s, has{class})."""
    d, classes = range(len(FEATURES)), range(k)
    one = len(FEATURES)
    up = [(i, j) for i in d for j in d if i <= j]
    means = ", ".join(f"avg(x{i}) AS m{i}, var_pop(x{i}) AS v{i}" for i in d)
    centre = ", ".join(f"avg(m{i}) AS u{i}" for i in d)
    spread = ", ".join(f"CASE WHEN avg(v{i} + (m{i} - u{i}) * (m{i} - u{i})) > 0 THEN sqrt(avg(v{i} + (m{i} - u{i}) * (m{i} - u{i}))) ELSE 1 END AS s{i}" for i in d)
    gram = ", ".join(f"0.5 * sum(z{i} * z{j})" + (f" + {1 / c}" if i == j else "") + f" AS a{i}{j}" for i, j in up)
    unit = ", ".join(f"{float(i == j)} AS r{i}{j}" for i in d for j in d)
    elim = []
    for q in d[:-1]:
        less = [f"a{i}{j} - a{q}{i} * a{q}{j} / a{q}{q} AS a{i}{j}" for i, j in up if i > q] + [f"r{i}{j} - a{q}{i} * r{q}{j} / a{q}{q} AS r{i}{j}" for i in d if i > q for j in d]
        elim.append(f"g{q + 1} AS (SELECT * REPLACE ({', '.join(less)}) FROM g{q})")
    back = []
    for i in reversed(d):
        rows = ", ".join(f"({' - '.join([f'r{i}{j}', *(f'a{i}{n} * w{n}{j}' for n in d if n > i)])}) / a{i}{i} AS w{i}{j}" for j in d)
        back.append(f"h{i} AS (SELECT *, {rows} FROM {f'h{i + 1}' if i + 1 < len(FEATURES) else f'g{len(FEATURES) - 1}'})")
    names = [f"b{q}{i}" for q in classes for i in range(one + 1)]
    logit = ", ".join(f"CASE WHEN has{q} THEN exp({' + '.join([f'b{q}{one}', *(f'b{q}{i} * z{i}' for i in d)])}) ELSE 0 END AS e{q}" for q in classes)
    share = ", ".join(f"e{q} / ({' + '.join(f'e{r}' for r in classes)}) - (y = {q})::INT AS p{q}" for q in classes)
    slopes = ", ".join([f"sum(p{q} * z{i}) AS d{q}{i}" for q in classes for i in d] + [f"sum(p{q}) AS d{q}{one}" for q in classes])
    kept = ", ".join(f"any_value({n}) AS {n}" for n in names)
    inverse = ", ".join(f"any_value(w{i}{j}) AS w{i}{j}" for i in d for j in d)
    moved = ", ".join([f"b{q}{i} - ({' + '.join(f'w{i}{j} * (d{q}{j} + {1 / c} * b{q}{j})' for j in d)}) AS b{q}{i}" + (f", b{q}{one} - 2 * d{q}{one} / n AS b{q}{one}" if i == one - 1 else "") for q in classes for i in d])
    has = ", ".join(f"bool_or(label = {q}) AS has{q}" for q in classes)
    flags = ", ".join(f"any_value(has{q}) AS has{q}" for q in classes)
    return f"""WITH RECURSIVE {folds},
  x AS (SELECT CellLines, Mutations, c.ID, {', '.join(f'{f} AS x{i}' for i, f in enumerate(FEATURES))}, md5(cell_key || '|47') AS o FROM keyed_cells c JOIN wells w ON c.ID = w.ID),
  ranked AS (SELECT fit, label AS y, x.*, row_number() OVER (PARTITION BY fit, label ORDER BY o) AS place FROM member JOIN x USING (CellLines)),
  sized AS (SELECT fit, y, count(*) AS n FROM ranked GROUP BY 1, 2),
  fit AS (SELECT fit, min(n) AS least, count(*) AS classes FROM sized GROUP BY 1),
  kept AS (SELECT ranked.* EXCLUDE (place) FROM ranked JOIN fit USING (fit) WHERE place <= least AND classes > 1),
  per AS (SELECT fit, y, count(*) AS n, {means} FROM kept GROUP BY 1, 2),
  mid AS (SELECT fit, sum(n) AS n, {centre} FROM per GROUP BY 1),
  scale AS (SELECT fit, any_value(mid.n) AS n, {', '.join(f'any_value(u{i}) AS u{i}' for i in d)}, {spread} FROM per JOIN mid USING (fit) GROUP BY fit),
  z AS MATERIALIZED (SELECT fit, y, {', '.join(f'(x{i} - u{i}) / s{i} AS z{i}' for i in d)} FROM kept JOIN scale USING (fit)),
  g0 AS (SELECT fit, {gram}, {unit} FROM z GROUP BY fit), {', '.join(elim + back)},
  flag AS (SELECT fit, {has} FROM member GROUP BY 1),
  bound AS MATERIALIZED (SELECT fit, n, {', '.join(f'w{i}{j}' for i in d for j in d)}, {', '.join(f'has{q}' for q in classes)} FROM h0 JOIN scale USING (fit) JOIN flag USING (fit)),
  it AS (SELECT 0 AS step, fit, {', '.join(f'0.0::DOUBLE AS {n}' for n in names)} FROM bound
    UNION ALL SELECT step + 1, fit, {moved} FROM (
      SELECT step, fit, any_value(n) AS n, {kept}, {inverse}, {slopes} FROM (
        SELECT *, {share} FROM (SELECT *, {logit} FROM it JOIN bound USING (fit) JOIN z USING (fit) WHERE step < {steps})) GROUP BY step, fit)),
  model AS (SELECT it.* EXCLUDE (step), {', '.join(f'u{i}, s{i}' for i in d)}, {', '.join(f'has{q}' for q in classes)} FROM it JOIN scale USING (fit) JOIN flag USING (fit) WHERE step = {steps})
  {select}"""


def _logits(k: int) -> str:
    """Exponentials of every class of a model row joined with a cell."""
    one = len(FEATURES)
    return ", ".join(f"CASE WHEN has{q} THEN exp({' + '.join([f'b{q}{one}', *(f'b{q}{i} * (x{i} - u{i}) / s{i}' for i in range(one))])}) ELSE 0 END AS e{q}" for q in range(k))


HALF_MEMBERS = f"{HALVES}, member AS (SELECT half AS fit, CellLines, label FROM o WHERE train)"
H01 = logistic_sql(HALF_MEMBERS, 4, f""", sc AS (SELECT fit, CellLines, list_concat({', '.join(f'CASE WHEN has{q} THEN [e{q} / (e0 + e1 + e2 + e3)] ELSE [] END' for q in range(4))}) AS ps
    FROM (SELECT model.*, x.CellLines, {_logits(4)} FROM model JOIN o ON o.half = model.fit AND NOT train JOIN x ON x.CellLines = o.CellLines)),
  lm AS (SELECT fit, CellLines, avg(ps[1]) AS p0, avg(ps[2]) AS p1, avg(ps[3]) AS p2, avg(ps[4]) AS p3 FROM sc GROUP BY 1, 2)
  SELECT half::INT AS Half, o.CellLines, label, n, {', '.join(f'round(p{q}, 4) AS Ypred{q}' for q in range(4))}
  FROM o JOIN size USING (CellLines) LEFT JOIN lm ON lm.fit = o.half AND lm.CellLines = o.CellLines WHERE NOT train""")


@query("h01_logistic_split", H01)
def h01(spark, sf):
    """Multinomial logistic scorer of cells on reciprocal halves: mean probabilities of every held-out line."""
    params = _map_params({"Logistic": {"C": 1.0}}, "sample_split", CODES)
    result = MAP(_cells_screen(spark, sf, params)).fit().fitted
    scores_ = [F.round(F.avg(c) + F.lit(1e-8), 4).alias(c) if c in result.predicted.columns else F.lit(None).cast("double").alias(c) for c in (f"Ypred{q}" for q in range(4))]
    return _collected(spark, result.predicted.groupBy("Half", "CellLines", "label").agg(F.count(F.lit(1)).alias("n"), *scores_), [result])


_MUTATION_MEMBERS = f"""{HALVES}, xo AS (SELECT o.*, g, train AND Mutations IN ('WT', g) AS mine FROM o, (VALUES ('AMERICA'), ('ASIA'), ('EUROPE')) m(g)),
  member AS (SELECT g || half::VARCHAR AS fit, CellLines, (Mutations <> 'WT')::BIGINT AS label FROM xo WHERE mine)"""
H02 = logistic_sql(_MUTATION_MEMBERS, 2, f""", sc AS (SELECT fit, CellLines, e1 / (e0 + e1) AS p
    FROM (SELECT model.*, x.CellLines, {_logits(2)} FROM model JOIN xo ON xo.g || xo.half::VARCHAR = model.fit AND NOT mine JOIN x ON x.CellLines = xo.CellLines)),
  mm AS (SELECT fit, avg(p) AS m FROM sc GROUP BY 1), lm AS (SELECT fit, CellLines, avg(p) - any_value(m) + 0.5 AS p FROM sc JOIN mm USING (fit) GROUP BY 1, 2)
  SELECT g AS ModelGenetics, half::INT AS Half, xo.CellLines, n, round(p, 4) AS Ypred
  FROM xo JOIN size USING (CellLines) LEFT JOIN lm ON lm.fit = xo.g || xo.half::VARCHAR AND lm.CellLines = xo.CellLines WHERE NOT mine""")


@query("h02_binary_logistic_split_mut", H02)
def h02(spark, sf):
    """One binary model of cells per mutation against wild type, on halves; scores of each half centre at 0.5. The models of
    all mutations and halves are fitted together."""
    params = _map_params({"BinaryLogistic": {}}, "sample_split_mut")
    fit = MAP(_cells_screen(spark, sf, params)).fit()
    out = fit.make_table().groupBy("ModelGenetics", "Half", "CellLines").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("Ypred") + F.lit(1e-8), 4).alias("Ypred"))
    return _collected(spark, out, fit.fitted.values())


def _collected(spark, out, results):
    """A short table of a run, taken before the run's cached cells are released."""
    done = as_local(out) or kept(out)
    for r in results:
        r.release()
    return done


def _cells_screen(spark, sf, params):
    """All cells with their keys, and the wells of all groups."""
    return Screen(cells(spark, sf, key=True), screen(spark, sf).wells, params)


@query("h03_random_forest_split", f"""WITH {HALVES}, k AS (SELECT half, count(DISTINCT label) FILTER (train) AS classes FROM o GROUP BY 1)
  SELECT half::INT AS Half, o.CellLines, label, n, CASE WHEN classes > 1 THEN 100 * n END AS votes, CASE WHEN classes > 1 THEN 100 END AS trees, CASE WHEN classes > 1 THEN 0 END::BIGINT AS wrong
  FROM o JOIN size USING (CellLines) JOIN k USING (half) WHERE NOT train""")
def h03(spark, sf):
    """Forest of the scorer's own settings (100 trees, unlimited depth) on cells of all groups; every cell of a held-out
    line is scored. A cell has one vote of every tree (shares of pure leaves sum to whole votes), and trees that end at pure
    leaves put none of their own draws in another class."""
    params = _map_params({"RandomForest": {}}, "sample_split", CODES)
    params["analysis"]["MAP"]["data_loader"]["training_cells"] = TRAINING_CELLS
    s = _cells_screen(spark, sf, params)
    task, plan = _Task.of(s, params), folds.reciprocal_halves(s.wells, 1, 47).filter("role = 'train'")
    halves = [sorted(r["CellLines"] for r in rows) for rows in ([r for r in plan.collect() if r["half"] == h] for h in (0, 1))]
    rows = task.rows["_"].select("CellLines", "label", *FEATURES)
    models = forest.fit_forests(task.train["_"], FEATURES, halves, {}, 47)
    table_, bound = manyfits.member_table(spark, halves)
    told = rows.join(F.broadcast(table_) if bound < 10_000 else table_, "CellLines", "left").withColumn("member", F.coalesce("member", F.lit(bytearray(1))))
    fitted = [(h, len(m.trees), sum(m.wrong)) if not isinstance(m, str) else (h, None, None) for h, m in enumerate(models)]
    named = forest.score_forests(told, models, "member", ["CellLines", "label"]).join(F.broadcast(spark.createDataFrame(fitted, "_fold int, trees int, wrong long")), "_fold")
    votes = F.sum(F.round(F.aggregate("_p", F.lit(0.0), lambda a, p: a + p) * F.col("trees"))).cast("long")
    out = named.groupBy(F.col("_fold").alias("Half"), "CellLines", "label").agg(F.count(F.lit(1)).alias("n"), votes.alias("votes"), F.first("trees").alias("trees"), F.first("wrong").alias("wrong"))
    done = _collected(spark, out, [])
    for df in task.cached:
        df.unpersist()
    return done


H04 = logistic_sql(f"{HALVES}, member AS (SELECT half AS fit, CellLines, (Mutations <> 'WT')::BIGINT AS label FROM o WHERE train)", 2,
                   " UNION ALL ".join(f"SELECT '0-' || fit::VARCHAR AS fold, '{f}' AS feature, round(b1{i} - b0{i}, 4) AS value FROM model" for i, f in enumerate(FEATURES)))


@query("h04_importance", H04)
def h04(spark, sf):
    """Feature importances per fold of a binary model of cells, all mutations against wild type: the contrast of the
    coefficients on scaled features."""
    params = _map_params({"BinaryLogistic": {}}, "sample_split", BINARY)
    result = MAP(_cells_screen(spark, sf, params)).fit().fitted
    return _collected(spark, rounded(result.importance, 4), [result])


def weighted_logistic_sql(p: str, d: int, k: int, c: str, steps: int) -> str:
    """Tables ``{p}z``, ... and ``{p}model`` from ``{p}rows`` (fit, y, wt, x0...): the weighted form of ``logistic_sql``, all classes
    of a fit with equal total weight. ``c``: the setting, or a column of ``{p}rows`` that holds it."""
    feats, classes, one = range(d), range(k), d
    up = [(i, j) for i in feats for j in feats if i <= j]
    sums = ", ".join(f"sum(wt * x{i}) / sum(wt) AS m{i}, sum(wt * x{i} * x{i}) / sum(wt) AS q{i}" for i in feats)
    around = ", ".join(f"avg(q{i} - 2 * u{i} * m{i} + u{i} * u{i}) AS t{i}, any_value(u{i}) AS c{i}" for i in feats)
    spread = ", ".join(f"CASE WHEN t{i} > 1e-14 * greatest(1, c{i} * c{i}) THEN sqrt(t{i}) ELSE 1 END AS s{i}" for i in feats)
    gram = ", ".join(f"0.5 * sum(w * z{i} * z{j})" + (" + any_value(1.0 / c)" if i == j else "") + f" AS a{i}{j}" for i, j in up)
    unit = ", ".join(f"{float(i == j)} AS r{i}{j}" for i in feats for j in feats)
    tables = []
    for q in feats[:-1]:
        less = [f"a{i}{j} - a{q}{i} * a{q}{j} / a{q}{q} AS a{i}{j}" for i, j in up if i > q] + [f"r{i}{j} - a{q}{i} * r{q}{j} / a{q}{q} AS r{i}{j}" for i in feats if i > q for j in feats]
        tables.append(f"{p}g{q + 1} AS (SELECT * REPLACE ({', '.join(less)}) FROM {p}g{q})")
    for i in reversed(feats):
        rows = ", ".join(f"({' - '.join([f'r{i}{j}', *(f'a{i}{n} * w{n}{j}' for n in feats if n > i)])}) / a{i}{i} AS w{i}{j}" for j in feats)
        tables.append(f"{p}h{i} AS (SELECT *, {rows} FROM {p}{f'h{i + 1}' if i + 1 < d else f'g{d - 1}'})")
    names = [f"b{q}{i}" for q in classes for i in range(one + 1)]
    logit = ", ".join(f"CASE WHEN has{q} THEN exp({' + '.join([f'b{q}{one}', *(f'b{q}{i} * z{i}' for i in feats)])}) ELSE 0 END AS e{q}" for q in classes)
    share = ", ".join(f"w * (e{q} / ({' + '.join(f'e{r}' for r in classes)}) - (y = {q})::INT) AS p{q}" for q in classes)
    slopes = ", ".join([f"sum(p{q} * z{i}) AS d{q}{i}" for q in classes for i in feats] + [f"sum(p{q}) AS d{q}{one}" for q in classes])
    kept = ", ".join(f"any_value({n}) AS {n}" for n in [*names, *(f"w{i}{j}" for i in feats for j in feats), "n", "c"])
    moved = ", ".join(x for q in classes for x in [*(f"b{q}{i} - ({' + '.join(f'w{i}{j} * (d{q}{j} + b{q}{j} / c)' for j in feats)}) AS b{q}{i}" for i in feats), f"b{q}{one} - 2 * d{q}{one} / n AS b{q}{one}"])
    has = ", ".join(f"bool_or(y = {q}) AS has{q}" for q in classes)
    flags = ", ".join(f"has{q}" for q in classes)
    return f"""{p}sized AS (SELECT fit, y, sum(wt) AS n, {c} AS c, {sums} FROM {p}rows GROUP BY fit, y{'' if c[0].isdigit() else ', ' + c}),
  {p}fit AS (SELECT fit, max(n) AS most, count(*) AS classes, any_value(c) AS c, {has}, {', '.join(f'avg(m{i}) AS u{i}' for i in feats)} FROM {p}sized GROUP BY 1 HAVING count(*) > 1),
  {p}scale AS (SELECT fit, {spread} FROM (SELECT fit, {around} FROM {p}sized JOIN {p}fit USING (fit) GROUP BY fit)),
  {p}z AS MATERIALIZED (SELECT r.fit, r.y, wt * most / n AS w, f.c, {', '.join(f'(x{i} - u{i}) / s{i} AS z{i}' for i in feats)} FROM {p}rows r JOIN {p}sized s ON r.fit = s.fit AND r.y = s.y JOIN {p}fit f ON f.fit = r.fit JOIN {p}scale t ON t.fit = r.fit),
  {p}g0 AS (SELECT fit, any_value(c) AS c, sum(w) AS n, {gram}, {unit} FROM {p}z GROUP BY fit), {', '.join(tables)},
  {p}bound AS MATERIALIZED (SELECT h.fit, n, h.c, {', '.join(f'w{i}{j}' for i in feats for j in feats)}, {flags} FROM {p}h0 h JOIN {p}fit USING (fit)),
  {p}it AS (SELECT 0 AS step, fit, {', '.join(f'0.0::DOUBLE AS {n}' for n in names)} FROM {p}bound
    UNION ALL SELECT step + 1, fit, {moved} FROM (SELECT step, fit, {kept}, {slopes} FROM (
      SELECT *, {share} FROM (SELECT i.*, b.* EXCLUDE (fit), y, w, {', '.join(f'z{i}' for i in feats)}, {logit} FROM {p}it i JOIN {p}bound b ON i.fit = b.fit JOIN {p}z z ON z.fit = i.fit WHERE step < {steps})) GROUP BY step, fit)),
  {p}model AS (SELECT i.* EXCLUDE (step), {', '.join(f'u{i}, s{i}' for i in feats)}, {flags} FROM {p}it i JOIN {p}fit USING (fit) JOIN {p}scale USING (fit) WHERE step = {steps})"""


def two_level_sql(splits: str, fold: str, c: str, held: str, steps: int) -> str:
    """Two-level scores in SQL, tables up to ``scored`` (fit, CellLines, label, p0, p1). ``splits`` ends in ``train`` ({fold}, CellLines,
    Mutations); ``fold`` are its columns; ``held`` gives the lines and settings to score."""
    draws, feats = DRAWS * EPOCHS, range(len(FEATURES))
    key = fold.replace(", ", " || '-' || ")
    cell_z = [f"b{q}4 + " + " + ".join(f"b{q}{i} * (v{i} - u{i}) / s{i}" for i in feats) for q in range(2)]
    markers = ["A", "N", "R"]
    return f"""{splits},
  place AS (SELECT *, row_number() OVER (PARTITION BY {fold}, Mutations ORDER BY substr(md5(CellLines || '|47'), 1, 13), CellLines) - 1 AS pos, count(*) OVER (PARTITION BY {fold}, Mutations) AS n FROM train),
  most AS (SELECT {fold}, max(n) AS most FROM place GROUP BY ALL),
  extra AS (SELECT {fold}, Mutations, ('0x' || substr(md5(Mutations || '|' || i || '|47'), 1, 13))::BIGINT % n AS pos, count(*) AS more
    FROM (SELECT DISTINCT {fold}, Mutations, n, most FROM place JOIN most USING ({fold})), range(1, 1000) r(i) WHERE i <= most - n GROUP BY ALL),
  member AS (SELECT {key} AS fold, CellLines, (Mutations <> 'WT')::BIGINT AS y, 1 + coalesce(more, 0) AS times FROM place LEFT JOIN extra USING ({fold}, Mutations, pos)),
  x AS (SELECT CellLines, Mutations, w.Antibody, {', '.join(f'{f} AS x{i}' for i, f in enumerate(FEATURES))}, substr(md5(cell_key || '|47'), 1, 13) AS o FROM keyed_cells c JOIN wells w ON c.ID = w.ID),
  drawn AS (SELECT * EXCLUDE (pos, n), CASE WHEN n >= {draws} THEN (pos <= {draws})::INT ELSE {draws} // n + (pos <= {draws} % n)::INT END AS copies
    FROM (SELECT *, row_number() OVER (PARTITION BY Antibody, CellLines ORDER BY o) AS pos, count(*) OVER (PARTITION BY Antibody, CellLines) AS n FROM x)),
  crows AS MATERIALIZED (SELECT fold || ':' || Antibody AS fit, y, (copies * times)::DOUBLE AS wt, {', '.join(f'x{i}' for i in feats)} FROM member JOIN drawn USING (CellLines) WHERE copies > 0),
  {weighted_logistic_sql("c", len(FEATURES), 2, "1.0", 40)},
  means AS (SELECT Antibody, CellLines, any_value(Mutations) AS Mutations, {', '.join(f'avg(x{i}) AS v{i}' for i in feats)} FROM x GROUP BY 1, 2),
  logits AS (SELECT m.fit, split_part(m.fit, ':', 1) AS fold, Antibody, CellLines, Mutations, {cell_z[0]} AS y0, {cell_z[1]} AS y1 FROM cmodel m JOIN means ON Antibody = split_part(m.fit, ':', 2)),
  pooled AS MATERIALIZED (SELECT fold, CellLines, any_value((Mutations <> 'WT')::BIGINT) AS label, {', '.join(f"max(y{q}) FILTER (Antibody = '{m}') AS x{2 * j + q}" for j, m in enumerate(markers) for q in range(2))}
    FROM logits GROUP BY 1, 2 HAVING count(*) = {len(markers)}),
  lrows AS MATERIALIZED (SELECT {c} AS fit, y, times::DOUBLE AS wt, {', '.join(f'x{i}' for i in range(6))}{'' if c == 'fold' else ', c'} FROM member JOIN pooled USING (fold, CellLines){'' if c == 'fold' else ', settings'}),
  {weighted_logistic_sql("l", 6, 2, "1.0" if c == "fold" else "c", steps)},
  scored AS (SELECT h.*, e0 / (e0 + e1) AS p0, e1 / (e0 + e1) AS p1 FROM (
    SELECT h.*, {', '.join(f"exp(b{q}6 + {' + '.join(f'b{q}{i} * (x{i} - u{i}) / s{i}' for i in range(6))}) AS e{q}" for q in range(2))} FROM ({held}) h JOIN lmodel m ON m.fit = h.fit) h)"""


H05 = f"""WITH RECURSIVE {two_level_sql(f"{HALVES}, train AS (SELECT half, CellLines, Mutations FROM o WHERE train)", "half", "fold",
    "SELECT p.*, p.fold AS fit FROM pooled p WHERE NOT EXISTS (SELECT 1 FROM member m WHERE m.fold = p.fold AND m.CellLines = p.CellLines)", 1500).replace("half AS fold", "half::VARCHAR AS fold")}
  SELECT round(p0, 4) AS Class_0, round(p1, 4) AS Class_1, CellLines, label AS "True", fold::INT AS Half FROM scored
  UNION ALL SELECT NULL, NULL, CellLines, (Mutations <> 'WT')::BIGINT, half::INT FROM o WHERE NOT train AND half::VARCHAR NOT IN (SELECT fit FROM lmodel)"""


@query("h05_two_level_scorer", H05)
def h05(spark, sf):
    """Cell models per marker, pooled per line, line model on top, all mutations against wild type; held-out halves. As many
    draws of every line, as many lines of every mutation."""
    params = _two_level_params(BINARY, {})
    parts = MarkerScreens.split(cells(spark, sf, key=True), wells(spark, sf), params)
    fit = MAP(parts).fit()
    out = fit.make_table()
    return _collected(spark, rounded(out.select("Class_0", "Class_1", "CellLines", "True", "Half"), 4), [fit.fitted])


def _ridge_sql(select: str) -> str:
    """All folds of the leave-one-line-out ridge in SQL: moments per fold and class by joining every other line, then
    the normal equations by elimination written out for the four features."""
    d = range(len(FEATURES))
    up = [(i, j) for i in d for j in d if i <= j]
    x = ", ".join(f"{c} - (SELECT avg({c}) FROM cells) AS x{i}" for i, c in enumerate(FEATURES))
    sums = ", ".join([f"sum(x{i}) AS s{i}" for i in d] + [f"sum(x{i} * x{j}) AS q{i}{j}" for i, j in up])
    cols = ", ".join([f"s{i}" for i in d] + [f"q{i}{j}" for i, j in up])
    fold = ", ".join([f"sum(b.s{i}) / sum(b.n) AS m{i}" for i in d] + [f"sum(b.q{i}{j}) / sum(b.n) AS r{i}{j}" for i, j in up])
    both = ", ".join([f"avg(m{i}) OVER f AS u{i}" for i in d] + [f"avg(r{i}{j}) OVER f AS v{i}{j}" for i, j in up])
    sd = ", ".join(f"CASE WHEN v{i}{i} - u{i} * u{i} > 0 THEN sqrt(v{i}{i} - u{i} * u{i}) ELSE 1 END AS d{i}" for i in d)
    left = ", ".join([f"(v{i}{j} - u{i} * u{j}) / (d{i} * d{j})" + (" + 1.0::DOUBLE / whole" if i == j else "") + f" AS a{i}{j}" for i, j in up])
    right = ", ".join(f"(m{i} - u{i}) / k / d{i} AS b{i}" for i in d)
    steps = []
    for k in d[:-1]:
        less = [f"a{i}{j} - a{k}{i} * a{k}{j} / a{k}{k} AS a{i}{j}" for i, j in up if i > k] + [f"b{i} - a{k}{i} * b{k} / a{k}{k} AS b{i}" for i in d if i > k]
        steps.append(f"z{k + 1} AS (SELECT * REPLACE ({', '.join(less)}) FROM z{k})")
    last = len(FEATURES) - 1
    back = [f"w{last} AS (SELECT *, b{last} / a{last}{last} AS c{last} FROM z{last})"]
    for i in reversed(d[:-1]):
        rest = " - ".join([f"b{i}", *(f"a{i}{j} * c{j}" for j in d if j > i)])
        back.append(f"w{i} AS (SELECT *, ({rest}) / a{i}{i} AS c{i} FROM w{i + 1})")
    dot = " + ".join(f"c{i} / d{i} * u{i}" for i in d)
    own = " + ".join(f"(e.s{i} / e.n - u{i}) / d{i} * c{i}" for i in d)
    coef = ", ".join(f"c{i} / d{i} AS k{i}" for i in d)
    return f"""WITH x AS (SELECT w.CellLines, w.Mutations, {x} FROM cells c JOIN wells w ON c.ID = w.ID),
  st AS (SELECT CellLines, Mutations, count(*) AS n, {sums} FROM x GROUP BY 1, 2),
  el AS (SELECT g AS ModelGenetics, CellLines, Mutations IN ('WT', g) AS eligible, (Mutations <> 'WT')::BIGINT AS label, n, {cols} FROM st, (VALUES ('AMERICA'), ('ASIA'), ('EUROPE')) v(g)),
  fold AS (SELECT a.ModelGenetics, a.CellLines, b.label AS class, sum(b.n) AS fn, {fold} FROM el a JOIN el b ON a.ModelGenetics = b.ModelGenetics AND a.CellLines <> b.CellLines
    WHERE a.eligible AND b.eligible GROUP BY 1, 2, 3),
  mean AS (SELECT *, sum(fn) OVER f AS whole, count(*) OVER f AS k, {both} FROM fold WINDOW f AS (PARTITION BY ModelGenetics, CellLines)),
  scale AS (SELECT *, {sd} FROM mean), z0 AS (SELECT *, {left}, {right} FROM scale), {', '.join(steps + back)},
  ridge AS (SELECT w0.ModelGenetics, w0.CellLines, label, class, 1.0::DOUBLE / k - ({dot}) AS intercept, 1.0::DOUBLE / k + {own} AS score, {coef}
    FROM w0 JOIN el e ON w0.ModelGenetics = e.ModelGenetics AND w0.CellLines = e.CellLines)
  {select}"""


RIDGE_FOLDS = _ridge_sql("SELECT ModelGenetics, CellLines AS Holdout, label, class, round(score, 6) AS score, round(intercept, 6) AS intercept, 'ridge' AS estimator FROM ridge")
RIDGE_HELD = _ridge_sql(f""", m AS (SELECT ModelGenetics, class, avg(intercept) AS b, {', '.join(f'avg(k{i}) AS k{i}' for i in range(len(FEATURES)))} FROM ridge GROUP BY 1, 2)
  SELECT e.ModelGenetics, e.CellLines, class, round(b + {' + '.join(f'k{i} * s{i} / n' for i in range(len(FEATURES)))}, 6) AS score, 'ridge' AS estimator
  FROM el e JOIN m ON e.ModelGenetics = m.ModelGenetics WHERE NOT eligible""")


def _ridge(spark, sf):
    """Line statistics, computed once, and which lines train which model."""
    meta = wells(spark, sf)
    rows = cells_with_wells(cells(spark, sf), meta.select("ID", "CellLines"))
    table_ = folds.eligibility(meta, GENETICS).withColumn("label", (F.col("Mutations") != "WT").cast("bigint"))
    return kept(sufficient.line_statistics(rows, FEATURES)), table_


_COEF = " UNION ALL ".join(f"SELECT ModelGenetics, CellLines, '{c}' AS feature, k{i} AS coef FROM ridge WHERE class = 1" for i, c in enumerate(FEATURES))
_MEAN = " UNION ALL ".join(f"SELECT CellLines, '{c}' AS feature, avg({c}) AS mean FROM cells c JOIN wells w ON c.ID = w.ID GROUP BY 1" for c in FEATURES)
RIDGE_ATTRIBUTION = _ridge_sql(f""", fc AS ({_COEF}), lm AS ({_MEAN}), t AS (SELECT ModelGenetics, feature, sum(coef) AS t, count(*) AS k FROM fc GROUP BY 1, 2)
  SELECT fc.ModelGenetics, fc.CellLines, fc.feature, round(mean * coef, 4) AS eval, round(CASE WHEN t.k > 1 THEN mean * (t - coef) / (t.k - 1) ELSE 0 END, 4) AS train
  FROM fc JOIN t ON fc.ModelGenetics = t.ModelGenetics AND fc.feature = t.feature JOIN lm ON lm.CellLines = fc.CellLines AND lm.feature = fc.feature""")


@query("h13_ridge_attributions", RIDGE_ATTRIBUTION)
def h13_ridge(spark, sf):
    """Attributions of the fitted ridge folds: of a line in its own fold, and in the folds that trained on it."""
    meta = wells(spark, sf)
    rows = cells_with_wells(cells(spark, sf), meta.select("ID", "CellLines"))
    coef = attribution.ridge_coefficients(sufficient.leave_one_out_ridge(*_ridge(spark, sf), FEATURES), FEATURES).filter("class = 1")
    means, coef = attribution.line_means_long(rows, FEATURES), kept(coef)
    parts = [attribution.linear_train_eval(means, coef.filter(F.col("ModelGenetics") == g).select("Holdout", "feature", "coef")).withColumn("ModelGenetics", F.lit(g))
             for g in GENETICS]
    return rounded(union_all(parts), 4)


@query("h08_leave_one_out_ridge", RIDGE_FOLDS)
def h08(spark, sf):
    """All leave-one-line-out folds of all mutations from one pass over the cells."""
    out = sufficient.leave_one_out_ridge(*_ridge(spark, sf), FEATURES)
    return rounded(out.select("ModelGenetics", "Holdout", "label", "class", "score", "intercept", "estimator"))


@query("h08_holdout_scores", RIDGE_HELD)
def h08b(spark, sf):
    """Lines that never train, scored by the average of all fold models."""
    stats, table_ = _ridge(spark, sf)
    return rounded(sufficient.holdout_scores(stats, table_, sufficient.leave_one_out_ridge(stats, table_, FEATURES)))


RIDGE = """st AS (SELECT w.CellLines, w.Mutations, count(*) AS n, sum(x) AS sx, sum(x * x) AS sxx FROM (SELECT ID, Nucleus_Area - (SELECT avg(Nucleus_Area) FROM cells) AS x FROM cells) c
    JOIN wells w ON c.ID = w.ID GROUP BY 1, 2),
  el AS (SELECT g AS ModelGenetics, st.*, CASE WHEN Mutations = 'WT' THEN 0 ELSE 1 END AS y FROM st, (VALUES ('AMERICA'), ('ASIA'), ('EUROPE')) v(g) WHERE Mutations IN ('WT', g)),
  f AS (SELECT a.ModelGenetics, a.CellLines, a.y, a.n, a.sx, sum(b.n) FILTER (b.y = 0) AS n0, sum(b.n) FILTER (b.y = 1) AS n1, sum(b.sx) FILTER (b.y = 0) AS x0, sum(b.sx) FILTER (b.y = 1) AS x1,
    sum(b.sxx) FILTER (b.y = 0) AS q0, sum(b.sxx) FILTER (b.y = 1) AS q1 FROM el a JOIN el b ON a.ModelGenetics = b.ModelGenetics AND a.CellLines <> b.CellLines GROUP BY 1, 2, 3, 4, 5),
  m AS (SELECT *, (x0 / n0 + x1 / n1) / 2 AS mu, (q0 / n0 + q1 / n1) / 2 AS m2 FROM f)"""


@query("h08_ridge_one_feature", f"""WITH {RIDGE} SELECT ModelGenetics, CellLines AS Holdout, y::BIGINT AS label, c::BIGINT AS class,
  round(CASE WHEN n0 IS NULL OR n1 IS NULL THEN 1 ELSE 0.5 + ((sx / n - mu) / sqrt(m2 - mu * mu)) * ((CASE c WHEN 0 THEN x0 / n0 ELSE x1 / n1 END - mu) / 2 / sqrt(m2 - mu * mu)) / (1 + 1.0::DOUBLE / (n0 + n1)) END, 6) AS score
  FROM m, (VALUES (0), (1)) k(c) WHERE CASE c WHEN 0 THEN n0 ELSE n1 END IS NOT NULL""")
def h08d(spark, sf):
    """The same folds with one feature, where the ridge solution is a formula."""
    meta = wells(spark, sf)
    rows = cells_with_wells(cells(spark, sf), meta.select("ID", "CellLines"))
    stats = sufficient.line_statistics(rows, ["Nucleus_Area"])
    table_ = folds.eligibility(meta, GENETICS).withColumn("label", (F.col("Mutations") != "WT").cast("bigint"))
    out = sufficient.leave_one_out_ridge(stats, table_, ["Nucleus_Area"])
    return rounded(out.select("ModelGenetics", "Holdout", "label", "class", "score"))


@query("h08_line_statistics", """SELECT CellLines, count(*) AS n, round(sum(c.Nucleus_Area - (SELECT avg(Nucleus_Area) FROM cells)), 4) AS s0,
  round(sum((c.Nucleus_Area - (SELECT avg(Nucleus_Area) FROM cells)) * (c.Cell_Spots - (SELECT avg(Cell_Spots) FROM cells))), 4) AS q02
  FROM cells c JOIN wells w ON c.ID = w.ID GROUP BY 1""")
def h08c(spark, sf):
    """The sufficient statistics behind the fast folds."""
    rows = cells_with_wells(cells(spark, sf), wells(spark, sf).select("ID", "CellLines"))
    stats = sufficient.line_statistics(rows, FEATURES)
    return rounded(stats.select("CellLines", "n", F.col("sx")[0].alias("s0"), F.col("sxx")[2].alias("q02")), 4)


_OUT_MEMBERS = """pool AS (SELECT CellLines, Mutations, (Mutations <> 'WT')::BIGINT AS label FROM lines WHERE Mutations <> 'sporadic'),
  size AS (SELECT CellLines, sum(NCells)::BIGINT AS n FROM wells GROUP BY 1),
  member AS (SELECT a.CellLines AS fit, b.CellLines, b.label FROM pool a JOIN pool b ON a.CellLines <> b.CellLines),
  told AS (SELECT a.CellLines AS fit, l.CellLines FROM pool a JOIN lines l ON l.CellLines = a.CellLines OR l.Mutations = 'sporadic')"""
H09 = logistic_sql(_OUT_MEMBERS, 2, f""", sc AS (SELECT fit, CellLines, e1 / (e0 + e1) AS p
    FROM (SELECT model.*, x.CellLines, {_logits(2)} FROM model JOIN told USING (fit) JOIN x ON x.CellLines = told.CellLines)),
  lm AS (SELECT fit, CellLines, avg(p) AS p FROM sc GROUP BY 1, 2)
  SELECT told.fit AS Holdout, told.CellLines, n, round(p, 4) AS Ypred FROM told JOIN size USING (CellLines) LEFT JOIN lm USING (fit, CellLines)""", steps=30)


@query("h09_leave_one_out_map", H09)
def h09(spark, sf):
    """Facade: scorer and fitter named in the parameters, leave-one-line-out of the cells of all mutations against wild
    type; each fold scores all cells of its line and of the sporadic ones."""
    params = _map_params({"BinaryLogistic": {}}, "leave_one_out", BINARY)
    fit = MAP(_cells_screen(spark, sf, params)).fit()
    out = fit.make_table().groupBy("Holdout", "CellLines").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("Ypred") + F.lit(1e-8), 4).alias("Ypred"))
    return _collected(spark, out, [fit.fitted])


PROFILE_CORR = " + ".join(f"corr(f{i}, f{j}) * corr(f{i}, f{j})" for i in range(4) for j in range(i + 1, 4))


@query("h10_profile_components", f"""SELECT count(*) AS n, 4::DOUBLE AS total, round(4 + 2 * ({PROFILE_CORR}), 6) AS squares
  FROM (SELECT ID, {', '.join(f'avg({c}) AS f{i}' for i, c in enumerate(FEATURES))} FROM cells GROUP BY ID)""")
def h10(spark, sf):
    """All components of standardised well profiles: variances sum to the number of features, squares to the squared
    correlations."""
    s = screen(spark, sf)
    out = profile_components(s.cells, s.wells)
    parts = out.agg(F.count(F.lit(1)).alias("n"), *[F.var_pop(f"column_{i}").alias(f"v{i}") for i in range(len(FEATURES))])
    v = [F.col(f"v{i}") for i in range(len(FEATURES))]
    return rounded(parts.select("n", sum(v[1:], v[0]).alias("total"), sum((x * x for x in v[1:]), v[0] * v[0]).alias("squares")))


@query("h11_score_components", """WITH m AS (SELECT avg(Class_0) AS m0, avg(Class_1) AS m1, avg(Class_2) AS m2 FROM scores WHERE Mutations <> 'sporadic')
  SELECT Mutations <> 'sporadic' AS fitted, count(*) AS n, round(avg((Class_0 - m0) * (Class_0 - m0) + (Class_1 - m1) * (Class_1 - m1) + (Class_2 - m2) * (Class_2 - m2)), 6) AS length
  FROM scores, m GROUP BY 1""")
def h11(spark, sf):
    """Two components of three class scores, sporadic lines projected on the same basis; scores sum to 1, so the two
    components hold the whole squared distance from the centre."""
    rows = scores(spark, sf)
    main, other, _ = score_components(rows.filter(F.col("Mutations") != "sporadic"), rows.filter(F.col("Mutations") == "sporadic"))
    out = union_all([main.withColumn("fitted", F.lit(True)), other.withColumn("fitted", F.lit(False))])
    length = F.col("PCA1") * F.col("PCA1") + F.col("PCA2") * F.col("PCA2")
    return rounded(out.groupBy("fitted").agg(F.count(F.lit(1)).alias("n"), F.avg(length).alias("length")))


ALIGNED = ", ".join(
    f"round(avg((({c} - m{i}) / (d{i} + 1e-8) * (SELECT stddev_pop({c}) FROM cells)) / ((SELECT stddev_pop({c}) FROM cells) + 1e-8)), 6) AS aligned_feature_{i}"
    for i, c in enumerate(FEATURES))


@query("i21_per_screen_alignment", f"""WITH st AS (SELECT Antibody AS Screen, {', '.join(f'avg({c}) AS m{i}, stddev_pop({c}) AS d{i}' for i, c in enumerate(FEATURES))} FROM cells GROUP BY 1)
  SELECT CellLines, w.Screen, {ALIGNED} FROM cells c JOIN wells w ON c.ID = w.ID JOIN st ON st.Screen = w.Screen GROUP BY 1, 2""")
def i21(spark, sf):
    """Every screen brought to the pooled mean and deviation, then line means per screen."""
    out = multiscreen.ScreenAligner().fit_transform(cells(spark, sf), wells(spark, sf))
    names = [c for c in out.columns if c.startswith("aligned")]
    return rounded(out.groupBy("CellLines", "Screen").agg(*[F.avg(c).alias(c) for c in names]))


def _dot(a: str, b: str) -> str:
    return "(" + " + ".join(f"{a}.v{i} * {b}.v{i}" for i in range(len(FEATURES))) + ")"


@query("i21_alignment_effect", f"""WITH st AS (SELECT Antibody AS Screen, {', '.join(f'avg({c}) AS m{i}, stddev_pop({c}) AS d{i}' for i, c in enumerate(FEATURES))} FROM cells GROUP BY 1),
  pool AS (SELECT {', '.join(f'avg({c}) AS pm{i}, stddev_pop({c}) AS pd{i}' for i, c in enumerate(FEATURES))} FROM cells),
  means AS (SELECT aligned, w.Screen, CellLines, {', '.join(f"avg(CASE WHEN aligned THEN ({c} - m{i}) / (d{i} + 1e-8) * pd{i} / (pd{i} + 1e-8) ELSE ({c} - pm{i}) / (pd{i} + 1e-8) END) AS v{i}" for i, c in enumerate(FEATURES))}
    FROM cells c JOIN wells w ON c.ID = w.ID JOIN st ON st.Screen = w.Screen, pool, (VALUES (true), (false)) x(aligned) GROUP BY 1, 2, 3)
  SELECT a.aligned, a.Screen AS screen1, b.Screen AS screen2, round(avg(1 - {_dot('a', 'b')} / (sqrt({_dot('a', 'a')}) * sqrt({_dot('b', 'b')}))), 4) AS distance, count(*) AS lines
  FROM means a JOIN means b ON a.aligned = b.aligned AND a.CellLines = b.CellLines AND a.Screen < b.Screen GROUP BY 1, 2, 3""")
def i21b(spark, sf):
    """Screen distances before and after alignment; cells and wells are joined once for both."""
    out, labelled = [], multiscreen.with_labels(cells(spark, sf), wells(spark, sf)).persist(StorageLevel.MEMORY_AND_DISK)
    for per_screen in (False, True):
        rows = multiscreen.ScreenAligner(per_screen).fit_transform(labelled)
        means = multiscreen.line_means(rows, [c for c in rows.columns if c.startswith("aligned")])
        out.append(multiscreen.screen_distances(means).withColumn("aligned", F.lit(per_screen)))
    done = _collected(spark, rounded(union_all(out), 4), [])
    labelled.unpersist()
    return done


EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def _run_folder(spark) -> str:
    """A new folder per run in the shared folder."""
    return f"{shared_folder(spark)}/platelens-{uuid.uuid4().hex}"


def _arriving(spark, sf):
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf)


@query("j01_incremental_ingest", "SELECT event_type AS PlateID, count(*) AS n, round(avg(value), 4) AS value FROM events GROUP BY 1")
def j01(spark, sf):
    """Files not seen before go to parquet partitioned by plate; a second run finds nothing new."""
    folder = _run_folder(spark)
    for _ in range(2):
        rows = _arriving(spark, sf).withColumnRenamed("event_type", "PlateID")
        ingest.ingest_new_plates(rows, f"{folder}/cells", f"{folder}/checkpoint").awaitTermination()
    stored = spark.read.parquet(f"{folder}/cells")
    return rounded(stored.groupBy("PlateID").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("value")), 4)


@query("j02_running_counts", "SELECT user_id::VARCHAR AS ID, count(*) AS NCells FROM events GROUP BY 1")
def j02(spark, sf):
    """Counts per well kept up to date over arriving files."""
    folder = _run_folder(spark)
    rows = _arriving(spark, sf).select(F.col("user_id").cast("string").alias("ID"))
    ingest.counts_to_table(ingest.running_counts(rows), f"{folder}/counts", f"{folder}/checkpoint").awaitTermination()
    return ingest.latest_counts(spark, f"{folder}/counts")


@query("a12_result_sink", 'SELECT CellLines, Mutations, "True", round(Class_1, 6) AS Class_1 FROM scores')
def a12(spark, sf):
    """Score table written as CSV and read back with its schema."""
    from platelens.sources.sinks import read_table, write_table

    folder = _run_folder(spark)
    out = rounded(scores(spark, sf).select("CellLines", "Mutations", "True", "Class_1"))
    write_table(out, f"{folder}/scores", "csv")
    return read_table(spark, f"{folder}/scores", "csv", out.schema)


