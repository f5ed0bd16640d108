"""Registered queries, by section, with their oracle SQL."""
from . import history, ingest, learning, models, moments, policy, rings, vectors  # noqa: F401
from .policy import flagship
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]
