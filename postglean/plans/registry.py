"""All registered queries."""

from . import cases, cases_verdicts, planted, relations, wholes  # noqa: F401  (they register theirs)
from .queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
