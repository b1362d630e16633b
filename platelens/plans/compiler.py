"""Runs the ordered ``preprocess`` parameters with two plan-time savings that cannot change the result.

* Consecutive well filters share one semi-join on cells.
* Statistics are computed only for columns that survive the later name filters or feed a later trim.
Row filters are never moved across steps whose statistics depend on the rows present.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from platelens.operators import features, samples  # noqa: F401  (registers the steps)
from platelens.operators.features import quoted
from platelens.operators.registry import STEPS, WELL_FILTERS
from platelens.screen import Screen

NAME_FILTERS = {"select_feature_types": True, "drop_feature_types": False}
COLUMNWISE = {"drop_na_features", "drop_constant_features", "standardize_features", "subsample_rows_by_id"}


def needed_columns(steps: list[tuple[str, Mapping]], names: list[str]) -> list[str]:
    """Features worth computing at the start of ``steps``: final survivors and those used by a trim on the way."""
    alive, used = set(names), set()
    for name, kwargs in steps:
        if name in NAME_FILTERS:
            hit = {c for c in alive if re.search(kwargs["feature_str"], c)}
            alive = hit if NAME_FILTERS[name] else alive - hit
        elif name == "drop_cells_by_feature_qt":
            used |= set(kwargs["feature_filters"])
        elif name not in WELL_FILTERS and name not in COLUMNWISE:
            break
    return [c for c in names if c in alive or c in used]


def run_preprocess(screen: Screen, steps: Mapping[str, Mapping]) -> Screen:
    """Apply the named steps in order. Unknown names are an error."""
    todo = [(name, kwargs or {}) for name, kwargs in steps.items()]
    unknown = [name for name, _ in todo if name not in STEPS]
    if unknown:
        raise KeyError(f"unknown preprocessing steps: {unknown}")
    safe_sampling = "cell_key" in screen.cells.columns or "subsample_rows_by_id" not in steps
    i = 0
    while i < len(todo):
        name, kwargs = todo[i]
        if name in WELL_FILTERS:
            wells = screen.wells
            while i < len(todo) and todo[i][0] in WELL_FILTERS:
                wells = WELL_FILTERS[todo[i][0]](wells, **todo[i][1])
                i += 1
            screen = screen.keep_wells(wells)
            continue
        if name in COLUMNWISE and safe_sampling:
            keep = set(needed_columns(todo[i:], screen.features))
            drop = [c for c in screen.features if c not in keep]
            if drop:
                cols = [quoted(c) for c in screen.cells.columns if c not in drop]
                screen = screen.with_cells(screen.cells.select(*cols))
        screen = STEPS[name](screen, **kwargs)
        i += 1
    return screen
