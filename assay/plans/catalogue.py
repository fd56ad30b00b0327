"""All registered queries of the validation engine and their SQL."""

from assay.plans import more  # noqa: F401  (registers its queries)
from assay.plans.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
