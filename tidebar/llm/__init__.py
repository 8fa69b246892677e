"""Operators for training data, each a module, and their registered queries."""

from tidebar.llm import queries  # noqa: F401
from tidebar.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
