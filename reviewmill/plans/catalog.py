"""All registered queries: importing the query modules fills the registry."""

from reviewmill.plans import (  # noqa: F401
    queries_cleaning,
    queries_features,
    queries_models,
    queries_sources,
    queries_trends,
)
from reviewmill.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
