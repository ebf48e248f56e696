"""The engine's queries over the driver's tables."""

from . import file_queries, interval_queries, measure_queries, record_queries, region_queries, report_queries, rule_queries, spatial_queries, stateful_queries, summary_queries, track_queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "file_queries", "interval_queries", "measure_queries", "record_queries", "region_queries", "report_queries", "rule_queries", "spatial_queries", "stateful_queries", "summary_queries", "track_queries"]
