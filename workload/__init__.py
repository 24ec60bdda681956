"""The registered queries, each next to the SQL that must give the same rows."""

from workload import analysis, cleaning, quality, tables
from workload.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "analysis", "cleaning", "quality", "tables"]
