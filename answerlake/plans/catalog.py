"""Every registered query; importing a plan module registers its queries."""

from answerlake.plans import (  # noqa: F401
    accuracy,
    decoding,
    files,
    grading,
    index,
    reconcile,
    reviewing,
    ruling,
    scalars,
    streams,
)
from answerlake.plans.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
