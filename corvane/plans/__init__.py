"""The registered queries."""

from corvane.plans import array_queries, gate_queries, io_queries, join_queries, pool_queries, record_queries, stat_queries, stream_queries, text_queries  # noqa: F401
from corvane.plans.registry import ORACLES, QUERIES  # noqa: F401
