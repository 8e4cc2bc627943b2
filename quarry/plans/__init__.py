"""Named queries over the tables of a folder."""

from quarry.plans import dedup_queries, job_queries, metric_queries, other_queries, range_queries, tree_queries  # noqa: F401
from quarry.plans.catalog import QUERIES, SQL  # noqa: F401
