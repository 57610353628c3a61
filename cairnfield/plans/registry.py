"""All queries over the corpus operators, and the SQL that each must equal."""

from __future__ import annotations

from . import site_queries  # noqa: F401 - registers its queries
from .queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
