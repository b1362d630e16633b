"""Plate text files, plate maps, loading, curated parquet and arriving files."""

import os

import pytest
from pyspark.sql import functions as F

from platelens import MarkerScreens, Screen
from platelens.sources import plates
from platelens.sources.curated import CuratedCells
from platelens.sources.loader import PlateLoader
from platelens.sources.sinks import read_table, write_table
from platelens.streaming import ingest

HEADER = ["Row", "Column", "Bounding Box", "Object No", "Nuclei Selected - Object No in Nuclei",
          "Nuclei Selected - Nucleus Region Area [µm²]", "Nuclei Selected - Intensity A"]


def write_plate(root, screen, plate, header, rows, antibody, old_names):
    data = os.path.join(root, screen, "Data", plate, "Evaluation1")
    os.makedirs(data)
    with open(os.path.join(data, plates.DATA_FILE), "w", encoding="utf-8") as f:
        f.write("Database\tX\nEvaluation\t1\nRow\tColumn\n[Data]\n" + "\t".join(header) + "\n")
        f.writelines("\t".join(str(v) for v in r) + "\n" for r in rows)
    maps = os.path.join(root, screen, "PlateMap")
    os.makedirs(maps, exist_ok=True)
    pid = plates.plate_id(plate)
    drug, name = ("Compound", "PlateName") if old_names else ("Drugs", "PlateID")
    with open(os.path.join(maps, f"platemap_{pid}.csv"), "w", encoding="utf-8") as f:
        f.write(f"Row,Column,Well,{name},Channel,CellLines,Mutations,{drug},Antibody\n")
        f.write(f"A,1,A1,{pid},488/647,L1,WT,DMSO,{antibody}\nB,2,B2,{pid},488/647,L2,FUS,DMSO,{antibody}\n")
        f.write(f"C,3,C3,{pid},488/647,L3,FUS,DMSO,{antibody}\n")


@pytest.fixture
def params(tmp_path):
    rows = [(1, 1, "[1,2]", 1, 1, 10.5, 0.1), (1, 1, "[1,2]", 2, 2, "NaN", 0.2), (2, 2, "[0,0]", 3, 3, "", 0.3)]
    write_plate(tmp_path, "S1", "p1-x__2024", HEADER, rows, "FUS/EEA1", True)
    extra = [*HEADER, "Nuclei Selected - Extra"]
    write_plate(tmp_path, "S1", "p2-x__2024", extra, [(*r, 5.0) for r in rows], "FUS/EEA1", False)
    write_plate(tmp_path, "S2", "q1-x__2024", HEADER, rows[:1], "COX IV/atubulin", False)
    os.makedirs(tmp_path / "S1" / "Data" / "no-evaluation__1")
    return {"root": str(tmp_path), "screen": ["S1", "S2"]}


def test_plate_discovery_and_ids(spark, params):
    found = plates.plate_directories(spark, params)
    assert [plates.plate_id(p) for p in found] == ["p1-x", "p2-x", "q1-x"]
    with pytest.raises(FileNotFoundError):
        plates.plate_directories(spark, {**params, "screen": "missing"})
    with pytest.raises(ValueError):
        plates.map_file("/no/such/layout")


def test_load_single_marker(spark, params):
    s = Screen.load(spark, params, "FUS/EEA1")
    assert s.features == ["Nucleus_Region_Area_[µm²]", "Intensity_A", "Extra"]
    assert dict(s.cells.dtypes)["Intensity_A"] == "float"
    wells = {r["ID"]: (r["NCells"], r["Screen"], r["Drugs"]) for r in s.wells.collect()}
    assert wells == {f"{p}-x-{i}-{i}": (3 - i, p, "DMSO") for p in ("p1", "p2") for i in (1, 2)}
    area = s.cells.filter("ID = 'p1-x-1-1'").select(F.col("`Nucleus_Region_Area_[µm²]`").alias("a")).collect()
    assert sorted((r["a"] is None, r["a"]) for r in area) == [(False, 10.5), (True, None)]
    assert s.cells.filter("ID like 'p1%' and Extra is not null").count() == 0
    with pytest.raises(ValueError):
        Screen.load(spark, params, ["FUS/EEA1"])


def test_column_pruning_keeps_preamble_out(spark, params):
    cells = plates.read_measurements(spark, plates.plate_directories(spark, params), params)
    assert cells.count() == 7 and cells.select("Intensity_A").count() == 7
    assert cells.filter(F.col("Intensity_A").isNull()).count() == 0


def test_multi_marker_and_lists(spark, params):
    parts = MarkerScreens.load(spark, params, ["FUS/EEA1", "COX IV/atubulin"])
    assert sorted(parts) == ["COX IV/atubulin", "FUS/EEA1"]
    assert parts["COX IV/atubulin"].cells.count() == 1 and parts["FUS/EEA1"].cells.count() == 6
    loader = PlateLoader(spark, params)
    assert {r[0] for r in loader.list_antibodies(["q1-x"]).collect()} == {"COX IV/atubulin"}
    with pytest.raises(ValueError):
        loader.load("nothing like it")


def test_curated_store_ingests_each_plate_once(spark, params, tmp_path):
    folder = str(tmp_path / "curated")
    store = CuratedCells(spark, folder)
    found = plates.plate_directories(spark, params)
    assert store.ingest(found[:1], params) == found[:1]
    assert store.ingest(found, params) == found[1:]
    assert store.ingest(found, params) == []
    direct = Screen.load(spark, params, "FUS/EEA1")
    cached = Screen.load(spark, {**params, "curated": folder}, "FUS/EEA1")
    cols = direct.cells.columns
    assert sorted(map(str, direct.cells.collect())) == sorted(map(str, cached.cells.select(*[F.col(f"`{c}`") for c in cols]).collect()))
    plan = store.read()._jdf.queryExecution().toString() and store.read().filter("PlateID = 'p1-x'")
    assert "PartitionFilters" in plan._jdf.queryExecution().executedPlan().toString() and plan.count() == 3


def test_streams(spark, params, tmp_path):
    glob = f"{params['root']}/S1/Data/*/Evaluation1"
    single = f"{params['root']}/S1/Data/p1-x__2024/Evaluation1"
    target, check = str(tmp_path / "out"), str(tmp_path / "check")
    for _ in range(2):
        ingest.ingest_new_plates(ingest.stream_plate_text(spark, single, HEADER), target, check).awaitTermination()
    assert spark.read.parquet(target).count() == 3
    counts = ingest.running_counts(ingest.stream_plate_text(spark, glob, HEADER))
    ingest.counts_to_table(counts, str(tmp_path / "counts"), str(tmp_path / "check2")).awaitTermination()
    assert {r["ID"]: r["NCells"] for r in ingest.latest_counts(spark, str(tmp_path / "counts")).collect()} == {"p1-x-1-1": 2, "p1-x-2-2": 1}


def test_running_counts_carry_over_to_new_files(spark, tmp_path):
    folder, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    for start in (0, 10):
        spark.range(start, start + 10).selectExpr("cast(id % 3 as string) as ID").coalesce(1).write.mode("append").parquet(folder)
        rows = spark.readStream.schema("ID string").parquet(folder)
        ingest.counts_to_table(ingest.running_counts(rows), out, check).awaitTermination()
    got = {r["ID"]: r["NCells"] for r in ingest.latest_counts(spark, out).collect()}
    assert sum(got.values()) == 20


def test_changes_only_are_written_and_repeats_change_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "COMPACT", 3)
    out = str(tmp_path / "counts")
    rows = lambda *pairs: spark.createDataFrame(list(pairs), "ID string, NCells long")
    got = lambda: {r["ID"]: r["NCells"] for r in ingest.latest_counts(spark, out).collect()}
    steps = [(("a", 1), ("b", 1)), (("b", 2),), (("c", 5),), (("a", 9),), (("d", 1),), (("b", 7),), (("e", 3),)]
    want = {}
    for number, step in enumerate(steps):
        ingest.save_changes(rows(*step), number, out)
        want |= dict(step)
        assert got() == want
        ingest.save_changes(rows(*step), number, out)  # the trigger is repeated
        assert got() == want
        folder = tmp_path / "counts" / f"batch={number:012d}"
        assert not folder.exists() or spark.read.parquet(str(folder)).count() == len(step)
    left = sorted(os.listdir(out))
    assert "base=000000000005" in left and "batch=000000000000" not in left and "batch=000000000006" in left
    os.remove(os.path.join(out, "batch=000000000006", "_SUCCESS"))  # a trigger that broke off
    assert got() == {k: v for k, v in want.items() if k != "e"}


def test_stream_writes_changed_wells(spark, tmp_path):
    folder, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    for ids in (["a", "b", "c"], ["b"], ["b", "d"]):
        spark.createDataFrame([(i,) for i in ids], "ID string").coalesce(1).write.mode("append").parquet(folder)
        rows = spark.readStream.schema("ID string").parquet(folder)
        ingest.counts_to_table(ingest.running_counts(rows), out, check).awaitTermination()
    sizes = [spark.read.parquet(os.path.join(out, b)).count() for b in sorted(os.listdir(out)) if b.startswith("batch=")]
    assert [n for n in sizes if n] == [3, 1, 2]
    assert {r["ID"]: r["NCells"] for r in ingest.latest_counts(spark, out).collect()} == {"a": 1, "b": 3, "c": 1, "d": 1}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 0.5)], "CellLines string, `True` int, Class_0 double")
    for fmt in ("parquet", "csv", "orc", "json"):
        write_table(df, str(tmp_path / fmt), fmt)
        assert read_table(spark, str(tmp_path / fmt), fmt, df.schema).collect() == df.collect()
