"""Import every report module so that the registry is complete."""

from kairos.plans import reports_datasets, reports_evaluation, reports_graph, reports_scoring, reports_temporal  # noqa: F401
from kairos.plans import reports_more  # noqa: F401
from kairos.plans.registry import REGISTRY

__all__ = ["REGISTRY"]
