"""The query catalogue. Importing it registers every query."""

from pertmatrix.plans import q_aggregates, q_cell_scores, q_cells, q_graph, q_joins, q_metrics, q_models, q_ranking, q_sources, q_streaming  # noqa: F401
from pertmatrix.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
