"""All queries over layered tables."""

from . import reads, suites, upkeep, writes  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
