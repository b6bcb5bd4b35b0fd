"""All queries of the engine, by name."""

from vistra.plans import queries_actions, queries_evaluation, queries_evidence, queries_relations, queries_tracking, queries_tracks  # noqa: F401
from vistra.plans.registry import ORACLES, QUERIES  # noqa: F401
