from tidebar.plans import (  # noqa: F401
    bar_queries,
    journal_queries,
    metric_queries,
    portfolio_queries,
    stream_queries,
)
from tidebar.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
