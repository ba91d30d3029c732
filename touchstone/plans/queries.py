"""All registered queries; importing a module below registers what it defines."""

from touchstone.plans import (  # noqa: F401
    query_access,
    query_catalog,
    query_contracts,
    query_models,
    query_quality,
    query_retrieval,
)
from touchstone.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
