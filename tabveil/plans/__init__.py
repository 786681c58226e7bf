"""The registered queries, one module for each family of operators."""

from __future__ import annotations


def load() -> None:
    """Import the modules, which register their queries."""
    from tabveil.plans import aggregates, distances, encoders, prepare, privacy, ranking, sources, streams, utility  # noqa: F401
