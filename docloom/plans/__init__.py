"""The registered queries of the engine's own operators, and their SQL."""

from . import documents, entities, flows, graphs, registers, search, texts, volumes  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
