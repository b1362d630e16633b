"""platelens: high-content screening analytics on Spark DataFrames."""

from platelens.screen import MarkerScreens, Screen, merge_screens

__all__ = ["Screen", "MarkerScreens", "merge_screens"]
