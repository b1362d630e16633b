"""Queries: sources, plate maps and loading (A), feature and sample operators (B)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from platelens.catalog.base import (
    FEATURES, cells, lineitem, query, rounded, screen, suppliers, wells,
)
from platelens.functions.sizing import join_bounded, shared_folder
from platelens.operators import features as feat
from platelens.operators import samples
from platelens.operators.aggregates import distinct_values, well_profiles
from platelens.plans.compiler import run_preprocess
from platelens.plans.components import components_by_group
from platelens.plans.folds import split_wells
from platelens.plans.multiscreen import joint_scale
from platelens.screen import MarkerScreens, Screen, merge_screens
from platelens.sources import plates as files
from platelens.sources.loader import cells_of_wells, count_cells, drop_empty_columns, plates_with_marker
from platelens.sources.plates import parse_lines, standard_map

MEANS = ", ".join(f"round(avg({c}), 4) AS {c}" for c in FEATURES)


@query("a01_plate_text", """SELECT l_returnflag || l_linestatus || '-' || (l_suppkey % 8 + 1) || '-' || (l_suppkey % 12 + 1) AS ID,
  count(*) AS n, count(CASE WHEN l_discount <> 0.05 THEN 1 END) AS filled, round(avg(l_quantity), 4) AS area,
  round(avg(CASE WHEN l_discount <> 0.05 THEN l_discount END), 4) AS spots FROM lineitem GROUP BY 1""")
def a01(spark, sf):
    """A1-A3: measurement lines as text (with preamble lines), parsed and cleaned like plate files."""
    header = ["Row", "Column", "Bounding Box", "Object No", "Nuclei Selected - Object No in Nuclei",
              "Nuclei Selected - Nucleus Area [µm²]", "Nuclei Selected - Spots"]
    spots = F.when(F.col("l_discount") == 0.05, "NaN").otherwise(F.col("l_discount").cast("string"))
    text = F.concat_ws(
        "\t", (F.col("l_suppkey") % 8 + 1).cast("string"), (F.col("l_suppkey") % 12 + 1).cast("string"), F.lit("[0,1]"),
        F.col("l_linenumber").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("string"), spots,
    )
    path = F.concat(F.lit("/root/S/Data/"), "l_returnflag", "l_linestatus", F.lit("__run1/Evaluation1/cells.txt"))
    lines = lineitem(spark, sf).select(
        F.explode(F.array(F.lit("[Data]"), F.lit("\t".join(header)), text)).alias("value"), path.alias("_path")
    )
    parsed = parse_lines(lines, header, F.col("_path"))
    area, spot = feat.quoted("Nucleus_Area_[µm²]"), feat.quoted("Spots")
    return rounded(parsed.groupBy("ID").agg(
        F.count(F.lit(1)).alias("n"), F.count(spot).alias("filled"), F.avg(area).alias("area"), F.avg(spot).alias("spots")
    ), 4)


@query("a04_plate_map", """SELECT (s_suppkey % 8 + 1)::VARCHAR AS "Row", (s_suppkey % 12 + 1)::VARCHAR AS "Column",
  (s_suppkey % 10)::VARCHAR AS PlateID, n_name AS Drugs, n_regionkey::VARCHAR AS Channel,
  (s_suppkey % 10) || '-' || (s_suppkey % 8 + 1) || '-' || (s_suppkey % 12 + 1) AS ID
  FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def a04(spark, sf):
    raw = suppliers(spark, sf).select(
        F.char(F.col("s_suppkey") % 8 + 65).alias("Row"), (F.col("s_suppkey") % 12 + 1).alias("Column"),
        (F.col("s_suppkey") % 10).alias("PlateName"), F.col("CellLines").alias("Compound"),
        F.col("n_regionkey").alias("Channel"),
    )
    return standard_map(raw)


@query("a06_plates_with_marker", "SELECT DISTINCT PlateID FROM wells WHERE regexp_matches(Antibody, 'A|N')")
def a06(spark, sf):
    return plates_with_marker(wells(spark, sf), ["A", "N"])


@query("a07_list_markers", "SELECT DISTINCT Antibody FROM wells WHERE regexp_matches(PlateID, 'A-F|R-O')")
def a07(spark, sf):
    return distinct_values(wells(spark, sf).filter(F.col("PlateID").rlike("A-F|R-O")), "Antibody")


@query("a05_discover_plates", """SELECT l_returnflag AS Screen, l_returnflag || l_linestatus AS PlateID, count(*) AS lines FROM lineitem GROUP BY 1, 2""")
def a05(spark, sf):
    """Plate folders written as files, found again on the file system (one without an evaluation is left out), and the lines
    of each read by the folders found. All plates are written in one pass, and each folder is put in its place."""
    root = f"{shared_folder(spark)}/plates-{uuid.uuid4().hex}"
    lines = lineitem(spark, sf).select("l_returnflag", F.concat("l_returnflag", "l_linestatus").alias("plate"), F.concat_ws("\t", "l_orderkey", "l_linenumber", "l_quantity").alias("value"))
    found = lines.select("l_returnflag", "plate").distinct().collect()  # plates
    places = {(flag, plate): i for i, (flag, plate) in enumerate(found) if plate is not None}
    pair = lambda flag, plate: F.concat_ws("\t", flag, plate)
    place = F.create_map(*[z for (flag, plate), i in places.items() for z in (pair(F.lit(flag), F.lit(plate)), F.lit(i))])
    lines = lines.withColumn("place", F.try_element_at(place, pair(F.col("l_returnflag"), F.col("plate")))).filter("plate is not null")
    lines.select("place", "value").write.partitionBy("place").text(f"{root}-all")
    for (flag, plate), i in places.items():
        files.move_directory(spark, f"{root}-all/place={i}", f"{root}/{flag}/Data/{plate}__run1/Evaluation1")
    for flag, plate in found:
        spark.range(1).select(F.lit("no evaluation").alias("value")).write.text(f"{root}/{flag}/Data/{plate}x__run1/Other")
    plates = files.plate_directories(spark, {"root": root, "screen": sorted({flag for flag, _ in found})})
    table_ = spark.createDataFrame([(p.split("/Data/")[0].rsplit("/", 1)[-1], files.plate_id(p)) for p in plates], "Screen string, PlateID string")
    text = spark.read.text([f"{p}/Evaluation1" for p in plates]).groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("lines"))
    text = text.groupBy(files.plate_id_of(F.col("path")).alias("PlateID")).agg(F.sum("lines").alias("lines"))  # one name a file, not a line
    return table_.join(text, "PlateID").select("Screen", "PlateID", "lines")


@query("a08_load", """SELECT ID, PlateID, Antibody, CellLines, NCells, Screen, 4 AS cell_columns FROM wells""")
def a08(spark, sf):
    """Plates with different columns are united, cells counted, columns without any value dropped."""
    li = lineitem(spark, sf)
    plates = []
    for flag in "ANR":
        part = cells(spark, sf, labels=True).filter(F.col("Antibody") == flag).drop("Antibody")
        part = part.withColumn("Empty", F.lit(None).cast("float"))
        plates.append(part if flag == "A" else part.drop("Cell_Spots") if flag == "N" else part)
    united = plates[0].unionByName(plates[1], allowMissingColumns=True).unionByName(plates[2], allowMissingColumns=True)
    meta = wells(spark, sf).drop("NCells", "Screen").withColumn("Unused", F.lit(None).cast("string"))
    loaded = drop_empty_columns(count_cells(meta, united))
    kept = [c for c in drop_empty_columns(united).columns if c != "ID"]
    return loaded.select("ID", "PlateID", "Antibody", "CellLines", "NCells", "Screen", F.lit(len(kept)).alias("cell_columns"))


@query("a10_single_marker", f"SELECT ID, {MEANS} FROM cells WHERE Antibody = 'A' GROUP BY ID")
def a10(spark, sf):
    """One marker: cells of all wells on the plates that hold it."""
    meta = wells(spark, sf)
    plates = plates_with_marker(meta, "A")
    kept = join_bounded(meta, plates, "PlateID", "left_semi")
    return rounded(well_profiles(Screen(cells_of_wells(cells(spark, sf), kept), kept)), 4)


@query("a11_multi_marker", """SELECT c.Antibody, count(*) AS cells, count(DISTINCT c.ID) AS wells FROM cells c GROUP BY 1""")
def a11(spark, sf):
    """Several markers: one screen per exact marker set."""
    parts = MarkerScreens.split(cells(spark, sf), wells(spark, sf), {})
    out = [s.cells.groupBy("ID").count().agg(
        F.lit(m).alias("Antibody"), F.sum("count").alias("cells"), F.count(F.lit(1)).alias("wells")
    ) for m, s in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("a13_channel_names", """SELECT ID, round(avg(Nucleus_Area), 4) AS "Area_A", round(avg(Cell_Spots), 4) AS "Spots_R"
  FROM cells GROUP BY ID""")
def a13(spark, sf):
    """Channel ids in feature names are replaced by marker names, paired in order."""
    meta = lineitem(spark, sf).agg(
        F.concat_ws("/", F.concat(F.lit("ch"), F.min("l_linestatus")), F.concat(F.lit("ch"), F.max("l_linestatus"))).alias("Channel"),
        F.concat_ws("/", F.min("l_returnflag"), F.max("l_returnflag")).alias("Antibody"),
    )
    raw = cells(spark, sf).select("ID", F.col("Nucleus_Area").alias("Area_chF"), F.col("Cell_Spots").alias("Spots_chO"))
    named = feat.rename_channels(raw, meta)
    return rounded(named.groupBy("ID").agg(*[F.avg(c).alias(c) for c in named.columns if c != "ID"]), 4)


@query("a14_merged_screens", """SELECT Antibody, count(*) AS cells, CASE Antibody WHEN 'A' THEN 0.1 WHEN 'N' THEN 0.05 ELSE 0.2 END::DOUBLE AS na_prop
  FROM cells GROUP BY 1""")
def a14(spark, sf):
    """Single-marker screens merged; differing preprocessing is kept per marker."""
    whole = screen(spark, sf)
    single = {}
    for m, share in (("A", 0.1), ("N", 0.05), ("R", 0.2)):
        meta = whole.wells.filter(F.col("Antibody") == m)
        part = Screen(whole.cells, whole.wells, {"preprocess": {"drop_na_features": {"na_prop": share}}, "analysis": {}})
        single[m] = part.keep_wells(meta)
    merged = merge_screens(single)
    steps = merged.params["preprocess"]
    out = [s.cells.agg(F.lit(m).alias("Antibody"), F.count(F.lit(1)).alias("cells"),
                       F.lit(steps[m]["drop_na_features"]["na_prop"]).alias("na_prop")) for m, s in merged.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("a15_merged_wells", "SELECT Antibody, count(*) AS wells, sum(NCells)::BIGINT AS cells FROM wells GROUP BY 1")
def a15(spark, sf):
    parts = MarkerScreens.split(cells(spark, sf), wells(spark, sf), {})
    return parts.wells.groupBy("Antibody").agg(F.count(F.lit(1)).alias("wells"), F.sum("NCells").alias("cells"))


NULLED = """nulled AS (SELECT ID, Nucleus_Area, Nucleus_Intensity, CASE WHEN Cell_Spots <> 0.1 THEN Cell_Spots END AS Cell_Spots,
  CASE WHEN Cell_Intensity_Sum NOT IN (0.04, 0.08) THEN Cell_Intensity_Sum END AS Cell_Intensity_Sum FROM cells)"""


@query("b01_drop_na_features", f"""WITH {NULLED}, filled AS (SELECT ID, Nucleus_Area, Nucleus_Intensity,
  coalesce(Cell_Spots, (SELECT avg(Cell_Spots) FROM nulled)) AS Cell_Spots FROM nulled)
  SELECT ID, count(*) AS n, round(avg(Nucleus_Area), 4) AS Nucleus_Area, round(avg(Nucleus_Intensity), 4) AS Nucleus_Intensity,
  round(avg(Cell_Spots), 4) AS Cell_Spots FROM filled GROUP BY ID""")
def b01(spark, sf):
    """The blanked tax column exceeds a tenth of nulls and goes; the discount column is filled with its mean."""
    s = feat.drop_na_features(screen(spark, sf, nulls=True), na_prop=0.1)
    return rounded(s.cells.groupBy("ID").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in s.features]), 4)


@query("b02_drop_constant_features", """SELECT ID, round(avg(Nucleus_Area), 4) AS Nucleus_Area,
  count(CASE WHEN Cell_Spots <> 0.1 THEN 1 END) AS gaps FROM cells GROUP BY ID""")
def b02(spark, sf):
    """One constant column goes; a column with one value and nulls stays, null counting as a value."""
    base = screen(spark, sf)
    odd = base.with_cells(base.cells.select(
        "ID", "Nucleus_Area", F.when(F.col("Cell_Spots") != 0.1, 1.0).alias("Gaps"), (F.col("Cell_Spots") * 0).alias("Flat")
    ))
    kept = feat.drop_constant_features(odd)
    assert "Flat" not in kept.features
    return rounded(kept.cells.groupBy("ID").agg(F.avg("Nucleus_Area").alias("Nucleus_Area"), F.count("Gaps").alias("gaps")), 4)


@query("b03_select_feature_types", """SELECT ID, round(avg(Nucleus_Intensity), 4) AS Nucleus_Intensity, round(avg(Cell_Spots), 4) AS Cell_Spots,
  round(avg(Cell_Intensity_Sum), 4) AS Cell_Intensity_Sum FROM cells GROUP BY ID""")
def b03(spark, sf):
    return rounded(well_profiles(feat.select_feature_types(screen(spark, sf), "^.*Intensity.*$|^.*Spot.*$")), 4)


@query("b04_drop_feature_types", """SELECT ID, round(avg(Nucleus_Area), 4) AS Nucleus_Area, round(avg(Cell_Spots), 4) AS Cell_Spots
  FROM cells GROUP BY ID""")
def b04(spark, sf):
    return rounded(well_profiles(feat.drop_feature_types(screen(spark, sf), "^.*Sum.*$|^.*Intensity.*$")), 4)


@query("b05_select_samples", f"""SELECT ID, {MEANS} FROM cells WHERE ID IN (SELECT ID FROM wells WHERE Drugs = 'O'
  AND Mutations IN ('WT', 'ASIA')) GROUP BY ID""")
def b05(spark, sf):
    keys = [{"Drugs": ["O"]}, {"Mutations": ["WT", "ASIA"]}]
    return rounded(well_profiles(samples.select_sample_by_feature(screen(spark, sf), select_key=keys)), 4)


@query("b06_drop_samples", f"""SELECT ID, {MEANS} FROM cells WHERE ID IN (SELECT ID FROM wells
  WHERE CellLines NOT IN ('NATION_3', 'NATION_7') AND Mutations NOT IN ('EUROPE')) GROUP BY ID""")
def b06(spark, sf):
    keys = [{"CellLines": ["NATION_3", "NATION_7"]}, {"Mutations": ["EUROPE"]}]
    return rounded(well_profiles(samples.drop_sample_by_feature(screen(spark, sf), drop_key=keys)), 4)


@query("b07_drop_by_count", """SELECT c.ID, count(*) AS n FROM cells c JOIN wells w ON c.ID = w.ID WHERE CellLines IN (
  SELECT CellLines FROM wells GROUP BY 1 HAVING avg(NCells) >= 99 AND avg(NCells) <= 101) GROUP BY c.ID""")
def b07(spark, sf):
    kept = samples.drop_cells_by_count(screen(spark, sf), min_count=99, max_count=101)
    return kept.cells.groupBy("ID").agg(F.count(F.lit(1)).alias("n"))


TRIM = """ranked AS (SELECT *, row_number() OVER (PARTITION BY ID ORDER BY Nucleus_Area) AS ra,
  row_number() OVER (PARTITION BY ID ORDER BY Nucleus_Intensity) AS ri, count(*) OVER (PARTITION BY ID) AS n FROM {src}),
bounds AS (SELECT ID, max(CASE WHEN ra = floor((n - 1) * 0.05::DOUBLE + 0.5) + 1 THEN Nucleus_Area END) AS alo,
  max(CASE WHEN ra = floor((n - 1) * 0.95::DOUBLE + 0.5) + 1 THEN Nucleus_Area END) AS ahi,
  max(CASE WHEN ri = floor((n - 1) * 0.05::DOUBLE + 0.5) + 1 THEN Nucleus_Intensity END) AS ilo,
  max(CASE WHEN ri = floor((n - 1) * 0.95::DOUBLE + 0.5) + 1 THEN Nucleus_Intensity END) AS ihi FROM ranked GROUP BY ID),
trimmed AS (SELECT c.* FROM {src} c JOIN bounds b ON c.ID = b.ID WHERE Nucleus_Area BETWEEN alo AND ahi
  AND Nucleus_Intensity BETWEEN ilo AND ihi)"""
FILTERS = {"Nucleus_Area": 0.05, "Nucleus_Intensity": 0.05}


@query("b08_quantile_trim", f"""WITH {TRIM.format(src='cells')} SELECT ID, count(*) AS n, {MEANS} FROM trimmed GROUP BY ID""")
def b08(spark, sf):
    s = samples.drop_cells_by_feature_qt(screen(spark, sf), feature_filters=FILTERS)
    return rounded(s.cells.groupBy("ID").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in FEATURES]), 4)


@query("b08_trimmed_untreated_profiles", f"""WITH chosen AS (SELECT c.* FROM cells c WHERE ID IN (SELECT ID FROM wells WHERE Drugs = 'O')),
  {TRIM.format(src='chosen')} SELECT ID, {MEANS} FROM trimmed GROUP BY ID""")
def slice0(spark, sf):
    """Flagship: untreated wells, per-well trim, mean profile, run from ordered parameters."""
    steps = {"select_sample_by_feature": {"select_key": [{"Drugs": ["O"]}]},
             "drop_cells_by_feature_qt": {"feature_filters": FILTERS}}
    return rounded(well_profiles(run_preprocess(screen(spark, sf), steps)), 4)


@query("b09_subsample_cells", """SELECT ID, count(*) AS n, min(cell_key) AS first_key, max(cell_key) AS last_key FROM (
  SELECT ID, cell_key, row_number() OVER (PARTITION BY ID ORDER BY md5(cell_key || '|47')) AS r FROM keyed_cells)
  WHERE r <= 50 GROUP BY ID""")
def b09(spark, sf):
    s = samples.subsample_rows_by_id(screen(spark, sf, key=True), n=50, seed=47)
    return s.cells.groupBy("ID").agg(
        F.count(F.lit(1)).alias("n"), F.min("cell_key").alias("first_key"), F.max("cell_key").alias("last_key")
    )


def _z(c, dev, eps=""):
    return f"round(avg(({c} - (SELECT avg({c}) FROM cells)) / ((SELECT {dev}({c}) FROM cells){eps})), 6) AS {c}"


@query("b10_standardize", f"SELECT ID, {', '.join(_z(c, 'stddev_samp', ' + 1e-6') for c in FEATURES)} FROM cells GROUP BY ID")
def b10(spark, sf):
    return rounded(well_profiles(feat.standardize_features(screen(spark, sf))))


@query("b11_pca_by_group", """SELECT round(1 + abs(corr(Nucleus_Area, Nucleus_Intensity)), 6) AS "^Nucleus_PC0", round(1 - abs(corr(Nucleus_Area, Nucleus_Intensity)), 6) AS "^Nucleus_PC1",
  round(1 + abs(corr(Cell_Spots, Cell_Intensity_Sum)), 6) AS PC0, round(1 - abs(corr(Cell_Spots, Cell_Intensity_Sum)), 6) AS PC1 FROM cells""")
def b11(spark, sf):
    """Components per feature group reaching 90 % of the variance; two standardised features have variances 1 +- |r|."""
    out = components_by_group(cells(spark, sf), FEATURES, ["^Nucleus"], 0.9)
    names = [c for c in out.columns if c != "ID"]
    return rounded(out.agg(*[F.var_pop(feat.quoted(c)).alias(c) for c in names]))


@query("b12_group_markers", """SELECT ID, round(avg(Nucleus_Area), 4) AS "^Nucleus_Nucleus_Area",
  round(avg(Nucleus_Intensity), 4) AS "^Nucleus_Nucleus_Intensity", round(avg(Nucleus_Intensity), 4) AS "Intensity_Nucleus_Intensity",
  round(avg(Cell_Intensity_Sum), 4) AS "Intensity_Cell_Intensity_Sum" FROM cells GROUP BY ID""")
def b12(spark, sf):
    return rounded(well_profiles(feat.group_markers(screen(spark, sf), ["^Nucleus", "Intensity"])), 4)


SPLIT = """ranked_lines AS (SELECT *, row_number() OVER (PARTITION BY Mutations ORDER BY md5(CellLines || '|47')) AS pos,
  count(*) OVER (PARTITION BY Mutations) AS n FROM lines),
split AS (SELECT CellLines, Mutations, CASE WHEN pos <= round_even(0.5 * n, 0) THEN 'train' ELSE 'test' END AS split FROM ranked_lines)"""


@query("b13_train_fitted_scaling", f"""WITH {SPLIT}, both_sides AS (SELECT c.*, w.CellLines, s.split FROM cells c JOIN wells w ON c.ID = w.ID
  JOIN split s ON w.CellLines = s.CellLines),
  st AS (SELECT Antibody, {', '.join(f'avg({c}) AS m{i}, stddev_pop({c}) AS d{i}' for i, c in enumerate(FEATURES))}
    FROM both_sides WHERE split = 'train' GROUP BY Antibody)
  SELECT CellLines, b.Antibody, {', '.join(f'round(avg(({c} - m{i}) / d{i}), 6) AS {c}' for i, c in enumerate(FEATURES))}
  FROM both_sides b JOIN st ON b.Antibody = st.Antibody WHERE split = 'test' GROUP BY 1, 2""")
def b13(spark, sf):
    """Scaler of the training lines, per marker, applied to the held-out lines."""
    meta = wells(spark, sf)
    sides = split_wells(meta, 0.5, 47).select("ID", "split", "CellLines")
    rows = cells(spark, sf, labels=True).join(sides, "ID")
    scaled = feat.scale_columns_by(rows.filter(F.col("split") == "test"), FEATURES, "Antibody",
                                   fitted_on=rows.filter(F.col("split") == "train"))
    return rounded(scaled.groupBy("CellLines", "Antibody").agg(*[F.avg(c).alias(c) for c in FEATURES]))


@query("b14_joint_scaling", f"SELECT ID, {', '.join(_z(c, 'stddev_pop', ' + 1e-8') for c in FEATURES)} FROM cells GROUP BY ID")
def b14(spark, sf):
    s = screen(spark, sf)
    return rounded(well_profiles(s.with_cells(joint_scale(s.cells, FEATURES))))


@query("b15_l2_normalize", "SELECT ID, " + ", ".join(
    f"round(1000 * sum({c} / (SELECT sqrt(sum({c} * {c})) FROM cells)), 4) AS {c}" for c in FEATURES) + " FROM cells GROUP BY ID")
def b15(spark, sf):
    out = feat.l2_normalize(cells(spark, sf), FEATURES)
    return rounded(out.groupBy("ID").agg(*[(1000 * F.sum(c)).alias(c) for c in FEATURES]), 4)


@query("b16_feature_family", """SELECT split_part(feature, '_', 1) AS family, count(*) AS n, round(avg(v), 4) AS mean FROM (
  UNPIVOT (SELECT Nucleus_Area, Nucleus_Intensity, Cell_Spots, Cell_Intensity_Sum FROM cells)
  ON Nucleus_Area, Nucleus_Intensity, Cell_Spots, Cell_Intensity_Sum INTO NAME feature VALUE v) GROUP BY 1""")
def b16(spark, sf):
    long = cells(spark, sf).select(*FEATURES).unpivot([], FEATURES, "feature", "v")
    return rounded(long.groupBy(feat.feature_family(F.col("feature")).alias("family")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean")), 4)


@query("b17_marker_ablation", """SELECT ID, round(avg(Nucleus_Area), 4) AS Nucleus_Area, round(avg(Cell_Spots), 4) AS Cell_Spots
  FROM cells GROUP BY ID""")
def b17(spark, sf):
    """Parameters edited to drop one more marker's features, then run."""
    params = {"preprocess": {"drop_feature_types": {"feature_str": "^.*Sum.*$"}}}
    edited = feat.without_marker(params, "Intensity")
    return rounded(well_profiles(screen(spark, sf, edited).preprocess()), 4)


@query("b18_line_name_repair", """SELECT regexp_replace(regexp_replace(CellLines, '11', '#11'), '##11', '#11') AS CellLines, count(*) AS wells
  FROM wells GROUP BY 1""")
def b18(spark, sf):
    return feat.repair_line_names(wells(spark, sf)).groupBy("CellLines").agg(F.count(F.lit(1)).alias("wells"))


@query("b20_full_preprocess", f"""WITH {NULLED}, filled AS (SELECT ID, Nucleus_Area, Nucleus_Intensity,
  coalesce(Cell_Spots, (SELECT avg(Cell_Spots) FROM nulled)) AS Cell_Spots FROM nulled),
  chosen AS (SELECT * FROM filled WHERE ID IN (SELECT ID FROM wells WHERE Mutations NOT IN ('EUROPE') AND Drugs = 'O')),
  {TRIM.format(src='chosen')} SELECT ID, count(*) AS n, round(avg(Nucleus_Intensity), 4) AS Nucleus_Intensity,
  round(avg(Cell_Spots), 4) AS Cell_Spots FROM trimmed GROUP BY ID""")
def b20(spark, sf):
    """The whole ordered list of a workflow file: null handling, sample filters, trim, name filters, constants."""
    steps = {
        "drop_na_features": {"na_prop": 0.1},
        "drop_sample_by_feature": {"drop_key": [{"Mutations": ["EUROPE"]}]},
        "select_sample_by_feature": {"select_key": [{"Drugs": ["O"]}]},
        "drop_cells_by_feature_qt": {"feature_filters": FILTERS},
        "select_feature_types": {"feature_str": "^.*Intensity.*$|^.*Spot.*$"},
        "drop_feature_types": {"feature_str": "^.*Sum.*$"},
        "drop_constant_features": {},
    }
    s = screen(spark, sf, {"preprocess": steps}, nulls=True).preprocess()
    return rounded(s.cells.groupBy("ID").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in s.features]), 4)


