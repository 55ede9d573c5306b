"""All queries over the engine's own operators, with their SQL."""

from . import checks, graphs, insights, networks, operations, relational, scalars, states, temporal  # noqa: F401  each module registers its queries
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
