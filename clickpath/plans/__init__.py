"""Named queries (``QUERIES``) and their DuckDB oracle SQL (``ORACLE``)."""

from . import q_cohorts, q_core, q_fraud, q_maint, q_querylog, q_reports, q_scalars, q_series, q_services, q_streaming  # noqa: F401  (registers queries)
from .registry import AS_OF, ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE", "AS_OF"]
