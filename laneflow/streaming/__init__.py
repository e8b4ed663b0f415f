from laneflow.streaming.changes import changed_arrivals
from laneflow.streaming.ingest import (
    POLL_INTERVAL_S,
    ingest_measurements,
    new_measurements,
    rows_too_late,
    run_available,
    start_parquet,
    start_snapshots,
    without_repeats,
)
from laneflow.streaming.jams import crowded_sites, site_crowds, stream_traffic_jams
from laneflow.streaming.managed import current_table, ingest_counts, start_ingest, start_latest_table

__all__ = [
    "POLL_INTERVAL_S",
    "changed_arrivals",
    "crowded_sites",
    "current_table",
    "ingest_counts",
    "ingest_measurements",
    "new_measurements",
    "rows_too_late",
    "run_available",
    "site_crowds",
    "start_ingest",
    "start_latest_table",
    "start_parquet",
    "start_snapshots",
    "stream_traffic_jams",
    "without_repeats",
]
