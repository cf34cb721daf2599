"""All registered queries and oracle statements."""

from gridsonde.plans import (  # noqa: F401
    queries_climate,
    queries_grid,
    queries_jobs,
    queries_match,
    queries_skill,
    queries_spatial,
    queries_vertical,
)
from gridsonde.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
