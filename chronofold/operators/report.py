"""Counts and pages for people and monitors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.functions.lifecycle import block_reason, cancel_outcome, display_name, is_terminal, scheduling_lag, threshold_pct
from chronofold.model import LAG_BUCKETS, STATES, UNREPORTED

REPORTED = tuple(s for s in STATES if s not in UNREPORTED)


def snake(state: str) -> str:
    return "".join(f"_{c.lower()}" if c.isupper() else c for c in state).lstrip("_")


def stats(tasks: DataFrame, runs: DataFrame, latest_sequence: DataFrame) -> DataFrame:
    """One row of totals and counts by state; suspended runs are in the total alone."""
    counted = runs.agg(
        F.count(F.lit(1)).alias("total_runs"), F.coalesce(F.sum("attempt_count"), F.lit(0)).cast("long").alias("attempts_total"),
        *[F.count_if(F.col("state") == s).alias(snake(s)) for s in REPORTED],
    )
    # Each side is one row.
    return tasks.agg(F.count(F.lit(1)).alias("total_tasks")).join(F.broadcast(counted)).join(F.broadcast(latest_sequence.agg(F.max("sequence").alias("latest_sequence"))))


def counts_over(domain: tuple[str, ...], rows: DataFrame, column: str, name: str = "n") -> DataFrame:
    """Count per value of a fixed domain, with zeros."""
    values = rows.sparkSession.createDataFrame([(v,) for v in domain], f"{column} string")
    counts = rows.where(F.col(column).isin(*domain)).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    return values.join(F.broadcast(counts), column, "left").select(column, F.coalesce("_n", F.lit(0).cast("long")).alias(name))


def runs_by_state(runs: DataFrame) -> DataFrame:
    return counts_over(REPORTED, runs, "state", "runs_total")


def attempts_by_result(attempts: DataFrame) -> DataFrame:
    """Finished attempts; suspended and running ones are left out."""
    return counts_over(("Success", "Failure", "Timeout"), attempts, "result", "attempts_total")


def lag_histogram(runs: DataFrame, now: Column, buckets: tuple[float, ...] = LAG_BUCKETS) -> DataFrame:
    """Cumulative counts per upper bound, +Inf last, with the sum of lags."""
    lags = runs.select(scheduling_lag(F.col("state"), F.col("scheduled_at"), now).alias("lag")).where("lag is not null")
    wide = lags.agg(*[F.count_if(F.col("lag") <= b).alias(f"b{k}") for k, b in enumerate(buckets)], F.count(F.lit(1)).alias("all"), F.coalesce(F.sum("lag"), F.lit(0)).cast("long").alias("lag_sum"))
    rows = [F.struct(F.lit(str(b)).alias("le"), F.col(f"b{k}").alias("n")) for k, b in enumerate(buckets)]
    return wide.select(F.inline(F.array(*rows, F.struct(F.lit("+Inf").alias("le"), F.col("all").alias("n")))), "lag_sum")


def list_runs(runs: DataFrame, tasks: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of runs by scheduled_at, run_id with their task's concurrency key (null where the task is unknown)."""
    some = runs.orderBy("scheduled_at", "run_id").offset(offset).limit(limit)
    # A page has 1000 rows at most.
    wanted = tasks.select("task_id", "concurrency_key").join(F.broadcast(some.select("task_id").distinct()), "task_id", "left_semi")
    return some.join(wanted, "task_id", "left").orderBy("scheduled_at", "run_id")


def list_tasks(tasks: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    return tasks.orderBy(F.desc("priority"), F.asc("created_at"), F.asc("task_id")).offset(offset).limit(limit)


def page(params: list[tuple[str, str]]) -> tuple[int, int]:
    """(limit, offset) of query parameters: limit 1 to 1000, 100 by default, offset from 0; the last of repeats counts."""
    found = {k: v for k, v in params if k in ("limit", "offset")}
    try:
        limit, offset = int(found.get("limit", "100")), int(found.get("offset", "0"))
    except ValueError as e:
        raise ValueError("invalid_pagination") from e
    if not 1 <= limit <= 1000 or offset < 0:
        raise ValueError("invalid_pagination")
    return limit, offset


def run_detail(runs: DataFrame, history: DataFrame, attempts: DataFrame, leases: DataFrame) -> DataFrame:
    """Nested rows: a run with its history, attempts and lease, and what blocks it."""
    told = history.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("sequence", "from_state", "to_state", "ts"))).alias("history"))
    tried = attempts.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("sequence", "attempt_id", "started_at", "finished_at", "result"))).alias("attempts"))
    held = leases.select("run_id", F.struct("owner", "expiry", "acquired_at", "updated_at").alias("lease"))
    return runs.join(told, "run_id", "left").join(tried, "run_id", "left").join(held, "run_id", "left").withColumn("block_reason", block_reason(F.col("state")))


def task_detail(tasks: DataFrame, runs: DataFrame) -> DataFrame:
    """Nested rows: a task with its runs in order of their times."""
    own = runs.groupBy("task_id").agg(F.sort_array(F.collect_list(F.struct("scheduled_at", "run_id", "state", "attempt_count"))).alias("runs"))
    return tasks.join(own, "task_id", "left")


def found(rows: DataFrame, key: str, value: object) -> DataFrame:
    """The row with a key, or none; on stored tables the filter reaches the scan."""
    return rows.where(F.col(key) == F.lit(value))


def cooperation_counts(classes: DataFrame) -> DataFrame:
    """Timed-out attempts by how they ended: cooperative, threshold_breach, non_cooperative."""
    kinds = (("cooperative", "Cooperative"), ("threshold_breach", "ThresholdBreach"), ("non_cooperative", "NonCooperative"))
    return classes.agg(*[F.count_if(F.col("cooperation") == kind).alias(name) for name, kind in kinds])


def tick_totals(**parts: DataFrame) -> DataFrame:
    """One row: how many rows each part of a tick has (promotions, dispatches, expirations ...)."""
    (first, rows), *more = parts.items()
    out = rows.agg(F.count(F.lit(1)).alias(first))
    for name, rows in more:
        out = out.join(F.broadcast(rows.agg(F.count(F.lit(1)).alias(name))))  # one row each
    return out


def department_members(actors: DataFrame) -> DataFrame:
    """Active actors per department; an actor is in the department of its last registration."""
    return actors.where("deregistered_at is null and department is not null").groupBy("department").agg(F.count(F.lit(1)).alias("actors"))


def runs_of_task(runs: DataFrame) -> DataFrame:
    return runs.groupBy("task_id").agg(F.sort_array(F.collect_list("run_id")).alias("run_ids"))


def cancel_summary(runs: DataFrame) -> DataFrame:
    """Per task, what canceling it would do to its runs."""
    out = cancel_outcome(F.col("state"))
    return runs.groupBy("task_id").agg(
        F.count_if(out == "canceled").alias("runs_canceled"), F.count_if(out != "canceled").alias("runs_already_terminal"), F.count(F.lit(1)).alias("runs_total")
    )


def task_outcomes(runs: DataFrame) -> DataFrame:
    """Per task: are all runs over, and did one complete."""
    return runs.groupBy("task_id").agg(F.bool_and(is_terminal(F.col("state"))).alias("all_terminal"), F.bool_or(F.col("state") == "Completed").alias("any_completed"))


def cron_needs(runs: DataFrame) -> DataFrame:
    return runs.groupBy("task_id").agg(F.count_if(~is_terminal(F.col("state"))).alias("waiting"), F.count(F.lit(1)).alias("total"), F.max("scheduled_at").alias("last_scheduled_at"))


def budget_crossings(budgets: DataFrame, threshold: int) -> DataFrame:
    pct = threshold_pct(F.col("consumed"), F.col("limit"))
    return budgets.withColumn("pct", pct).where(F.col("pct") >= threshold)


def ledger_of(ledger: DataFrame, key: str | None = None, tenant: str | None = None) -> DataFrame:
    rows = ledger
    if key is not None:
        rows = rows.where(F.col("ledger_key") == key)
    if tenant is not None:
        rows = rows.where(F.col("tenant_id") == tenant)
    return rows.orderBy("sequence")


def run_summaries(runs: DataFrame) -> DataFrame:
    return runs.select("run_id", "task_id", display_name(F.col("state")).alias("state"), "attempt_count", "scheduled_at", block_reason(F.col("state")).alias("block_reason"))
