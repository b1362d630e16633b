"""Preprocessing steps by name. A step is a function ``Screen -> Screen``; users can register their own."""

from __future__ import annotations

from collections.abc import Callable

STEPS: dict[str, Callable] = {}
WELL_FILTERS: dict[str, Callable] = {}


def step(fn: Callable) -> Callable:
    STEPS[fn.__name__] = fn
    return fn


def well_filter(fn: Callable) -> Callable:
    """A step that only looks at wells: ``(wells, **kwargs) -> wells``. Runs of them share one semi-join on cells."""
    WELL_FILTERS[fn.__name__] = fn

    def as_step(screen, **kwargs):
        return screen.keep_wells(fn(screen.wells, **kwargs))

    STEPS[fn.__name__] = as_step
    as_step.__name__ = fn.__name__
    as_step.__doc__ = fn.__doc__
    return as_step
