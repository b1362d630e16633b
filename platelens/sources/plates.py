"""Plate files: measurement text, plate maps and the directory layout ``<root>/<screen>/Data/<plate>/<evaluation>``."""

from __future__ import annotations

import csv
import re
from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names and marks of the plate file format.
DATA_FILE = "Objects_Population - Nuclei Selected.txt"
EVALUATION = "Evaluation1"
DATA_MARK = "[Data]"
TEXT_COLUMNS = ("Bounding Box", "Row", "Column")
KEPT_COLUMNS = r"^Nuclei Selected.*$|^Row$|^Column$"
FEATURE_PREFIX = "Nuclei_Selected_-_"
DROPPED_COLUMNS = ("Object_No_in_Nuclei", "Row", "Column", "PlateID")


def plate_id(directory: str) -> str:
    """Directory name up to the first double underscore."""
    return re.sub(r"__.*$", "", directory.rstrip("/").rsplit("/", 1)[-1])


def plate_id_of(path: Column) -> Column:
    """The same for a column of measurement file paths: the plate directory is two levels above the file."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)/[^/]+/[^/]+$", 1), "__.*$", "")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def list_directory(spark: SparkSession, path: str) -> list[str]:
    """Entries of a directory on any file system Spark can reach."""
    fs, p = _fs(spark, path)
    return sorted(str(s.getPath().toUri().getPath()) for s in fs.listStatus(p)) if fs.exists(p) else []


def move_directory(spark: SparkSession, source: str, target: str) -> None:
    """A directory under another name on the same file system; folders above the new one are made."""
    fs, p = _fs(spark, target)
    fs.mkdirs(p.getParent())
    if not fs.rename(_fs(spark, source)[1], p):
        raise OSError(f"{source} could not be moved to {target}")


def plate_directories(spark: SparkSession, params: dict) -> list[str]:
    """Plate directories of all screens that hold the evaluation directory; a missing screen is an error."""
    screens = params.get("screen")
    found = []
    for s in [screens] if isinstance(screens, str) else screens:
        base = f"{params['root'].rstrip('/')}/{s}"
        fs, p = _fs(spark, base)
        if not fs.exists(p):
            raise FileNotFoundError(base)
        for plate in list_directory(spark, f"{base}/Data"):
            names = {e.rsplit("/", 1)[-1] for e in list_directory(spark, plate)}
            if params.get("eval_dir", EVALUATION) in names:
                found.append(plate)
    return found


def data_file(plate: str, params: dict) -> str:
    return f"{plate}/{params.get('eval_dir', EVALUATION)}/{params.get('data_file', DATA_FILE)}"


def map_file(plate: str) -> str:
    base = plate.rsplit("/Data/", 1)[0]
    if base == plate:
        raise ValueError(f"no Data directory in {plate}")
    return f"{base}/PlateMap/platemap_{plate_id(plate)}.csv"


def _head(spark: SparkSession, path: str, wanted) -> str | None:
    """First line from the top of a file for which ``wanted(previous line)`` holds."""
    fs, p = _fs(spark, path)
    java = spark.sparkContext._jvm.java.io
    stream = java.BufferedReader(java.InputStreamReader(fs.open(p), "UTF-8"))
    try:
        before, line = None, stream.readLine()
        while line is not None and not wanted(before):
            before, line = line, stream.readLine()
        return line
    finally:
        stream.close()


def header_of(spark: SparkSession, path: str) -> list[str]:
    """Column names: the line after the mark. Reads the head of one file."""
    header = _head(spark, path, lambda before: before is not None and before.startswith(DATA_MARK))
    if header is None:
        raise ValueError(f"no {DATA_MARK} section in {path}")
    return header.rstrip("\r").split("\t")


def _by_header(paths: Sequence[str], read) -> dict[tuple[str, ...], list[str]]:
    """Files grouped by header. Heads are read from a few threads: many plates, one short read each."""
    with ThreadPool(16) as readers:
        headers = readers.map(read, paths, chunksize=1)
    groups: dict[tuple[str, ...], list[str]] = {}
    for header, path in zip(headers, paths, strict=True):
        groups.setdefault(tuple(header), []).append(path)
    return groups


def clean_name(name: str) -> str:
    return name.replace(" ", "_").replace(FEATURE_PREFIX, "")


def parse_lines(lines: DataFrame, header: Sequence[str], path: Column) -> DataFrame:
    """Cells from text lines in column ``value``: works on a batch and on a stream, and on any split of the files.

    A data line has as many fields as the header and digits in Row and Column; the preamble and the header do not.
    """
    names = [c for c in header if re.match(KEPT_COLUMNS, c)]
    if not names:
        raise ValueError("no columns named 'Nuclei Selected', 'Row' or 'Column'")
    at = {c: i for i, c in enumerate(header)}
    fields = F.split(F.regexp_replace("value", "\r$", ""), "\t", -1)
    rows = lines.select(fields.alias("_p"), F.regexp_replace("value", "\r$", "").alias("_line"), plate_id_of(path).alias("PlateID"))
    digits = F.get("_p", F.lit(at["Row"])).rlike(r"^\d+$") & F.get("_p", F.lit(at["Column"])).rlike(r"^\d+$")
    rows = rows.filter((F.size("_p") == len(header)) & digits)

    def value(c: str) -> Column:
        text = F.get("_p", F.lit(at[c]))
        if c in TEXT_COLUMNS:
            return text
        return F.nullif(F.nullif(text, F.lit("NaN")), F.lit("")).try_cast("float")

    well = F.concat_ws("-", "PlateID", F.get("_p", F.lit(at["Row"])), F.get("_p", F.lit(at["Column"])))
    kept = [c for c in names if clean_name(c) not in DROPPED_COLUMNS]
    # the line is the measurement: it holds the object number, and only a repeated measurement has an equal key
    key = F.concat_ws(":", well, F.md5("_line"))
    return rows.select(well.alias("ID"), key.alias("cell_key"), *[value(c).alias(clean_name(c)) for c in kept], "PlateID")


def read_measurements(spark: SparkSession, plates: Sequence[str], params: dict) -> DataFrame:
    """Cells of many plates. Plates with the same header are read as one text scan; headers are united by name."""
    out = None
    files = [data_file(p, params) for p in plates]
    for header, paths in _by_header(files, lambda path: header_of(spark, path)).items():
        lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("_path"))
        cells = parse_lines(lines, header, F.col("_path"))
        out = cells if out is None else out.unionByName(cells, allowMissingColumns=True)
    return out


def standard_map(df: DataFrame) -> DataFrame:
    """Plate map with standard names: Compound is Drugs, PlateName is PlateID, row letter is a number, keys are text."""
    for old, new in (("Compound", "Drugs"), ("PlateName", "PlateID")):
        if old in df.columns:
            df = df.withColumnRenamed(old, new)
    df = df.withColumn("Row", (F.ascii("Row") - 64).cast("string"))
    for c in ("Column", "PlateID", "Channel"):
        df = df.withColumn(c, F.col(c).cast("string"))
    return df.withColumn("ID", F.concat_ws("-", "PlateID", "Row", "Column"))


def read_maps(spark: SparkSession, plates: Sequence[str]) -> DataFrame:
    """Plate maps of many plates; maps with the same header are one scan, columns are united by name."""
    def names(path: str) -> list[str]:
        return next(csv.reader([(_head(spark, path, lambda before: True) or "").lstrip("\ufeff").rstrip("\r")]))

    out = None
    for columns, paths in _by_header([map_file(p) for p in plates], names).items():
        schema = ", ".join(f"`{c}` string" for c in columns)
        wells = standard_map(spark.read.schema(schema).option("header", True).csv(paths))
        out = wells if out is None else out.unionByName(wells, allowMissingColumns=True)
    return out
