"""All registered queries."""
from barloom.plans import data_queries, metric_queries, model_queries, score_queries, window_queries  # noqa: F401
from barloom.plans.registry import ORACLES, QUERIES  # noqa: F401
