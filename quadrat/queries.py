"""All queries of the library."""

from quadrat.plans import composers, evaluation, features, graphs, inputs, labels, occurrences, policies, ranking, regressions, searches, spatial, splits  # noqa: F401
from quadrat.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
