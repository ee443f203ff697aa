"""Registered queries: each wires an operator to the driver's tables."""

from loomframe.plans import (  # noqa: F401  (registration happens on import)
    checks,
    evaluation,
    features,
    histories,
    learning,
    profiles,
    sources,
    streams,
)
from loomframe.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
