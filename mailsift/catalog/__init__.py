"""Named queries over the supplied tables, each with its SQL twin where SQL can say it."""

from mailsift.catalog.registry import ORACLES, QUERIES
from mailsift.catalog import cleaning, features, profiles, measures, clusters, learning, private, scans, invariants  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
