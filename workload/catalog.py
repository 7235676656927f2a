"""All registered queries."""

from workload import assembled, cleaning, diagnostics, eda, explain, exports, frames, growth, modelling, runs, transforms  # noqa: F401
from workload.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
