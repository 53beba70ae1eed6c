"""Entities, states and table schemas of the workload model.

Time is whole epoch seconds, counters are BIGINT, and the only order of events is their
``sequence``.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Run states, terminal ones, and legal transitions.
STATES = ("Scheduled", "Ready", "Leased", "Running", "RetryWait", "Suspended", "Completed", "Failed", "Canceled")
TERMINAL = ("Completed", "Failed", "Canceled")
SUCCESSORS = {
    "Scheduled": ("Ready", "Canceled"),
    "Ready": ("Leased", "Canceled"),
    "Leased": ("Ready", "Running", "Canceled"),
    "Running": ("RetryWait", "Suspended", "Completed", "Failed", "Canceled"),
    "RetryWait": ("Ready", "Failed", "Canceled"),
    "Suspended": ("Ready", "Canceled"),
}
TRANSITIONS = tuple((a, b) for a, out in SUCCESSORS.items() for b in out)
#: States that reports of counts by state leave out of their columns (their total has them).
UNREPORTED = ("Suspended",)
LAG_STATES = ("Ready", "Leased", "Running", "RetryWait")
LAG_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)

EVENT_COLUMNS = """
    sequence BIGINT, event_type STRING, ts BIGINT, task_id STRING, run_id STRING, attempt_id STRING,
    prev_state STRING, new_state STRING, result STRING, error STRING, output BINARY, owner STRING, expiry BIGINT,
    depends_on ARRAY<STRING>, dimension STRING, amount BIGINT, subscription_id STRING,
    filter STRUCT<kind: STRING, task_id: STRING, state: STRING, dimension: STRING, threshold_pct: INT, key: STRING>,
    actor_id STRING, identity STRING, capabilities ARRAY<STRING>, department STRING, heartbeat_interval_secs BIGINT,
    tenant_id STRING, name STRING, role STRING, capability STRING, entry_id STRING, ledger_key STRING, payload BINARY,
    policy STRING, repeat_count BIGINT, interval_secs BIGINT, cron_expr STRING, max_occurrences BIGINT,
    max_attempts BIGINT, timeout_secs BIGINT, concurrency_key STRING, hold_policy STRING,
    required_capabilities ARRAY<STRING>, tags ARRAY<STRING>, priority INT, description STRING, parent_task_id STRING,
    scheduled_at BIGINT
"""


def event_schema():
    from pyspark.sql.types import StructType

    return StructType.fromDDL(" ".join(EVENT_COLUMNS.split()))


def events(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """A small event table from dicts; absent fields are null."""
    schema = event_schema()
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)


def lookup(pairs: dict[str, object], key: Column) -> Column:
    """The value of a small fixed mapping, null for other keys."""
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in pairs.items()))[key]


def epoch(ts: Column) -> Column:
    """Whole seconds since 1970 of a timestamp without zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts)
