"""The screen: a table of cells, a table of wells, and the parameters that say how to treat them.

Both tables are lazy DataFrames. Every operator takes a screen and returns a new one; nothing is mutated.
"""

from __future__ import annotations

import copy
import json
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platelens.functions.sizing import GroupProfile, join_bounded

KEYS = ("ID", "cell_key", "Antibody", "Screen", "CellLines", "Mutations")


def load_params(path: str) -> dict:
    """Workflow parameters from a JSON file; the order of ``preprocess`` is the order of execution."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)


@dataclass(frozen=True)
class Screen:
    """``cells``: one row per cell with ``ID`` and features. ``wells``: one row per well with ``ID`` and labels."""

    cells: DataFrame
    wells: DataFrame
    params: dict = field(default_factory=dict)
    preprocessed: bool = False
    measured: GroupProfile | None = None
    split_of: tuple[Screen, DataFrame, DataFrame] | None = None

    @classmethod
    def load(cls, spark: SparkSession, params: dict, antibody: str | None = None, loader: type | None = None) -> Screen:
        """One marker set. Lists are refused: use :class:`MarkerScreens`.

        ``loader``: a class taking (spark, params) with ``load(antibody) -> (wells, cells)``; default: plate files.
        """
        from platelens.sources.loader import PlateLoader

        antibody = antibody if antibody is not None else params.get("antibody")
        if isinstance(antibody, (list, tuple)):
            raise ValueError("several marker sets: use MarkerScreens.load")
        wells, cells = (loader or PlateLoader)(spark, params).load(antibody)
        return cls(cells, wells, params)

    @property
    def features(self) -> list[str]:
        return [c for c in self.cells.columns if c not in KEYS]

    def bounds(self) -> GroupProfile:
        """Wells, and cells in the largest well. Measured once; operators only remove rows, so it stays a bound."""
        if self.measured is None:
            wells = self.wells
            if "NCells" not in wells.columns:
                counts = self.cells.groupBy("ID").agg(F.count(F.lit(1)).alias("NCells"))
                wells = wells.select("ID").join(counts, "ID", "full")
            row = wells.agg(F.count(F.lit(1)).alias("g"), F.max("NCells").alias("m")).first()
            object.__setattr__(self, "measured", GroupProfile(row["g"], row["m"] or 0))
        return self.measured

    def undivided(self) -> Screen | None:
        """The screen that ``MarkerScreens.split`` took this one from, if cells and wells are still what it gave."""
        if self.split_of is not None and self.split_of[1] is self.cells and self.split_of[2] is self.wells:
            return self.split_of[0]
        return None

    def with_cells(self, cells: DataFrame) -> Screen:
        return replace(self, cells=cells)

    def keep_wells(self, wells: DataFrame) -> Screen:
        """New well table; cells follow by a left-semi join on ``ID``."""
        rows = self.bounds().groups
        cells = join_bounded(self.cells, wells.select("ID"), "ID", "left_semi", rows=rows)
        return replace(self, wells=wells, cells=cells)

    def labelled(self, *columns: str) -> DataFrame:
        """Cells with well labels: inner join on ``ID``."""
        labels = self.wells.select("ID", *[c for c in columns if c != "ID"])
        return join_bounded(self.cells, labels, "ID", rows=self.bounds().groups)

    def preprocess(self) -> Screen:
        from platelens.plans.compiler import run_preprocess

        return replace(run_preprocess(self, self.params.get("preprocess") or {}), preprocessed=True)

    def response(self, encode: bool = True) -> DataFrame:
        """Response column(s) named by ``analysis.MAP.response``, one row per cell, keyed by ``ID``."""
        from platelens.plans.labels import encode_wild_type_first

        wanted = (self.params.get("analysis") or {}).get("MAP", {}).get("response")
        if wanted is None:
            raise ValueError("analysis.MAP.response is not set")
        wanted = [wanted] if isinstance(wanted, str) else list(wanted)
        wells = self.wells.select("ID", *wanted)
        if encode:
            for c in wanted:
                if wells.schema[c].dataType.typeName() == "string":
                    wells = encode_wild_type_first(wells, c)
        keys = [c for c in ("ID", "cell_key") if c in self.cells.columns]
        return join_bounded(self.cells.select(*keys), wells, "ID", rows=self.bounds().groups)


class MarkerScreens(Mapping):
    """Screens keyed by marker set, sharing one set of parameters."""

    def __init__(self, screens: Mapping[str, Screen], params: dict, preprocessed: bool = False):
        self.screens, self.params, self.preprocessed = dict(screens), params, preprocessed

    def __getitem__(self, antibody: str) -> Screen:
        return self.screens[antibody]

    def __iter__(self) -> Iterator[str]:
        return iter(self.screens)

    def __len__(self) -> int:
        return len(self.screens)

    @classmethod
    def load(cls, spark: SparkSession, params: dict, antibody=None, loader: type | None = None) -> MarkerScreens:
        from platelens.sources.loader import PlateLoader

        antibody = antibody or params.get("antibody") or params.get("antibodies")
        if antibody is None:
            raise ValueError("no marker set named")
        wells, cells = (loader or PlateLoader)(spark, params).load(antibody)
        return cls.split(cells, wells, params)

    @classmethod
    def split(cls, cells: DataFrame, wells: DataFrame, params: dict) -> MarkerScreens:
        """One screen per distinct marker set; markers are a short label list."""
        whole = Screen(cells, wells, params)
        markers = sorted(r[0] for r in wells.select("Antibody").distinct().collect() if r[0] is not None)
        parts = {m: whole.keep_wells(wells.filter(F.col("Antibody") == m)) for m in markers}
        return cls({m: replace(s, split_of=(whole, s.cells, s.wells)) for m, s in parts.items()}, params)

    @property
    def wells(self) -> DataFrame:
        """Well tables of all markers in one."""
        tables = [s.wells for s in self.screens.values()]
        out = tables[0]
        for t in tables[1:]:
            out = out.unionByName(t, allowMissingColumns=True)
        return out

    def preprocess(self) -> MarkerScreens:
        """The same steps for every marker, or one step list per marker when the keys are the markers."""
        steps = self.params.get("preprocess") or {}
        per_marker = bool(steps) and set(steps) == set(self.screens)
        done = {
            m: replace(s, params={**s.params, "preprocess": (steps[m] if per_marker else steps)}).preprocess()
            for m, s in self.screens.items()
        }
        return MarkerScreens(done, self.params, preprocessed=True)

    def response(self, encode: bool = True) -> dict[str, DataFrame]:
        """Responses per marker; every marker must hold the same set of labels."""
        out = {m: Screen(s.cells, s.wells, self.params).response(encode) for m, s in self.screens.items()}
        wanted = self.params["analysis"]["MAP"]["response"]
        for c in [wanted] if isinstance(wanted, str) else wanted:
            labels = self.wells.select("Antibody", c).distinct()
            per_label = labels.groupBy(c).agg(F.count(F.lit(1)).alias("n"))
            if per_label.filter(F.col("n") != len(self.screens)).limit(1).count():
                raise ValueError(f"marker sets hold different labels of {c}")
        return out


def merge_screens(screens: Mapping[str, Screen]) -> MarkerScreens:
    """Join screens of single marker sets: equal ``analysis`` needed, ``preprocess`` kept per marker if it differs."""
    if not screens:
        raise ValueError("no screens to merge")
    first = next(iter(screens.values()))
    if any((s.params.get("analysis") or {}) != (first.params.get("analysis") or {}) for s in screens.values()):
        raise ValueError("screens differ in their analysis parameters")
    params = copy.deepcopy(first.params)
    params["antibodies"] = list(screens)
    steps = {m: s.params.get("preprocess") or {} for m, s in screens.items()}
    same = all(v == steps[next(iter(steps))] for v in steps.values())
    params["preprocess"] = next(iter(steps.values())) if same else steps
    return MarkerScreens(screens, params, preprocessed=all(s.preprocessed for s in screens.values()))
