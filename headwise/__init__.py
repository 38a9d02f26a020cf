"""Vehicle bunching on Spark: detect, explain and report buses that run too close."""

from headwise.config import FixedConfig, ScheduledConfig
from headwise.plans.fixed import detect_fixed, fixed_tables
from headwise.plans.ingest import ingest
from headwise.plans.marts import chart_tables
from headwise.plans.report import report_tables
from headwise.plans.scheduled import TimetableIndex, detect_scheduled, index_timetable
from headwise.session import configure, saved_lookup
from headwise.sources.captures import PairCounts, capture_horizon, list_captures, read_captures, source_status
from headwise.sources.events import read_events, write_events, write_tables
from headwise.sources.static import Names, Timetable, read_names, read_static
from headwise.sources.tables import compact, ensure_tables, latest_rows, read_observations
from headwise.streaming.ingest import FeedOutcome, ingest_feeds, stream_ingest

__all__ = [
    "FeedOutcome",
    "FixedConfig",
    "Names",
    "PairCounts",
    "ScheduledConfig",
    "Timetable",
    "TimetableIndex",
    "capture_horizon",
    "chart_tables",
    "compact",
    "configure",
    "detect_fixed",
    "detect_scheduled",
    "ensure_tables",
    "fixed_tables",
    "index_timetable",
    "ingest",
    "ingest_feeds",
    "latest_rows",
    "list_captures",
    "read_captures",
    "read_events",
    "read_names",
    "read_observations",
    "read_static",
    "report_tables",
    "saved_lookup",
    "source_status",
    "stream_ingest",
    "write_events",
    "write_tables",
]
