"""All registered queries; importing the modules fills the registry."""

from tidemark.queries import compare, live, models, preparation, quality  # noqa: F401
from tidemark.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
