from registry.base import ORACLE, QUERIES
from registry import catalogue, cells, plans, profile, score, sources, structure, validation  # noqa: F401

__all__ = ["ORACLE", "QUERIES"]
