"""All registered queries."""

import curbline.plans.road_queries  # noqa: F401  (registers part 2)
from curbline.plans.queries import CHECKS, QUERIES, forget_scenes

__all__ = ["CHECKS", "QUERIES", "forget_scenes"]
