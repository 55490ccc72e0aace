"""All registered queries."""

from . import boosted_q, evaluation_q, expressions_q, features_q, inference_q, models_q, resampled_q, shape_q, sources_q, standardized_q, summaries_q  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
