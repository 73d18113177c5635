"""Registered queries over the test tables, each with the SQL it must agree with."""

from driftline.workload import (  # noqa: F401
    aggregates,
    functions,
    joins,
    projections,
    scans,
    sorts,
    streams,
    windows,
)
from driftline.workload.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
