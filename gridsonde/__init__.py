"""Gridded-field analytics as PySpark DataFrame operators."""

from gridsonde.grid_spec import BASIN_GRID, GridSpec

__all__ = ["BASIN_GRID", "GridSpec"]
