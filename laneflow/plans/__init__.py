from laneflow.plans import continuous  # noqa: F401  registers its queries
from laneflow.plans.oracle import ORACLE_SQL
from laneflow.plans.registry import QUERIES, flagship

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]
