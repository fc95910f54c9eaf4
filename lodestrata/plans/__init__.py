"""Every registered query of the engine's own operators."""

from lodestrata.plans import basics, cases, documents, lookup, parsing, records, retrieval  # noqa: F401
from lodestrata.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
