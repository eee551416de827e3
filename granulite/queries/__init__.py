"""The query register."""

from granulite.queries import frame_queries, plan_queries, series_queries, stream_queries  # noqa: F401
from granulite.queries.registry import ORACLES, QUERIES  # noqa: F401
