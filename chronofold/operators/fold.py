"""Entity state from the event log.

Each function folds one kind of events into a table. Within an entity events are ordered by
``sequence``; latest values are taken with max_by, resets start an epoch, so every fold is an
aggregation with partial results or a window per entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.functions.lifecycle import MOST, is_terminal, is_valid_transition


def _of(events: DataFrame, *kinds: str) -> DataFrame:
    return events.where(F.col("event_type").isin(*kinds))


def _last(value: str | Column) -> Column:
    return F.max_by(value, "sequence")


def out_of_sequence(events: DataFrame) -> DataFrame:
    """Events whose sequence repeats; gaps are allowed. In a table, where order is the sequence itself, only repeats can be wrong."""
    repeated = events.groupBy("sequence").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    return events.join(repeated, "sequence", "left_semi")


def tasks(events: DataFrame) -> DataFrame:
    """Created tasks; of repeated creations the first counts. canceled_at is the first cancellation's."""
    created = _of(events, "TaskCreated")
    fields = [c for c in (
        "payload", "policy", "repeat_count", "interval_secs", "cron_expr", "max_occurrences", "max_attempts", "timeout_secs", "concurrency_key",
        "hold_policy", "required_capabilities", "tags", "priority", "description", "parent_task_id", "tenant_id",
    ) if c in events.columns]
    first = created.groupBy("task_id").agg(F.min_by(F.struct(F.col("ts").alias("created_at"), *fields), "sequence").alias("t"))
    canceled = _of(events, "TaskCanceled").groupBy("task_id").agg(F.min_by("ts", "sequence").alias("canceled_at"))
    return first.select("task_id", "t.*").join(canceled, "task_id", "left")


def transitions(events: DataFrame) -> DataFrame:
    """Every change of a run's state: sequence, run_id, prev_state (as the event states it), new_state, ts, in_history.

    Creations, cancellations, suspensions and resumptions are changes too. A lease that ends
    returns a leased run to Ready without a history row.
    """
    kind = F.col("event_type")
    state = (
        F.when(kind == "RunCreated", "Scheduled").when(kind == "RunStateChanged", F.col("new_state")).when(kind == "RunCanceled", "Canceled")
        .when(kind == "RunSuspended", "Suspended").when(kind == "RunResumed", "Ready")
    )
    before = F.when(kind == "RunStateChanged", F.col("prev_state")).when(kind == "RunSuspended", "Running").when(kind == "RunResumed", "Suspended")
    plain = events.withColumn("to", state).where(F.col("to").isNotNull()).select(
        "sequence", "run_id", before.alias("prev_state"), F.col("to").alias("new_state"), "ts", F.lit(True).alias("in_history")
    )
    ended = _of(events, "LeaseExpired", "LeaseReleased").select("sequence", "run_id", F.lit(None).cast("string").alias("new_state"), "ts")
    w = Window.partitionBy("run_id").orderBy("sequence")
    returns = (
        plain.select("sequence", "run_id", "new_state", "ts").unionByName(ended)
        .withColumn("now", F.last("new_state", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .where(F.col("new_state").isNull() & (F.col("now") == "Leased"))
        .select("sequence", "run_id", F.lit("Leased").alias("prev_state"), F.lit("Ready").alias("new_state"), "ts", F.lit(False).alias("in_history"))
    )
    return plain.unionByName(returns)


def checked_transitions(changes: DataFrame) -> DataFrame:
    """Adds current_state (by the row before) and violation: null, stale_previous, illegal or duplicate_create.

    A row is compared with the row before it, which equals a sequential fold up to a run's first
    violation.
    """
    w = Window.partitionBy("run_id").orderBy("sequence")
    return changes.withColumn("current_state", F.lag("new_state").over(w)).withColumn(
        "violation",
        F.when(F.col("current_state").isNull(), F.when(F.col("new_state") != "Scheduled", "unknown_run"))
        .when(F.col("new_state") == "Scheduled", "duplicate_create")
        .when(F.col("prev_state").isNotNull() & (F.col("prev_state") != F.col("current_state")), "stale_previous")
        .when(~is_valid_transition(F.col("current_state"), F.col("new_state")), "illegal"),
    )


def strict_prefix(checked: DataFrame) -> DataFrame:
    """Rows before the first violation in the whole log: where a strict replay stops."""
    stop = checked.where(F.col("violation").isNotNull()).agg(F.min("sequence").alias("stop"))
    return checked.join(F.broadcast(stop)).where(F.col("stop").isNull() | (F.col("sequence") < F.col("stop"))).drop("stop")


def quarantine(checked: DataFrame) -> DataFrame:
    """Rows of each run before its own first violation; other runs go on."""
    stop = checked.where(F.col("violation").isNotNull()).groupBy("run_id").agg(F.min("sequence").alias("stop"))
    return checked.join(stop, "run_id", "left").where(F.col("stop").isNull() | (F.col("sequence") < F.col("stop"))).drop("stop")


def attempts(events: DataFrame) -> DataFrame:
    """run_id, attempt_id, started_at, finished_at, result, error, output; unfinished ones have nulls."""
    starts = _of(events, "AttemptStarted").groupBy("run_id", "attempt_id").agg(F.min("sequence").alias("sequence"), F.min_by("ts", "sequence").alias("started_at"))
    ends = _of(events, "AttemptFinished").groupBy("run_id", "attempt_id").agg(F.min_by(F.struct(F.col("ts").alias("finished_at"), "result", "error", "output"), "sequence").alias("end"))
    return starts.join(ends, ["run_id", "attempt_id"], "left").select("run_id", "attempt_id", "sequence", "started_at", "end.*")


def runs(events: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """Current state of each run: task, state, attempts, times."""
    changes = transitions(events) if changes is None else changes
    created = _of(events, "RunCreated").groupBy("run_id").agg(
        F.min_by(F.struct("task_id", F.col("ts").alias("created_at"), F.coalesce("scheduled_at", "ts").alias("scheduled_at")), "sequence").alias("r")
    )
    state = changes.groupBy("run_id").agg(_last("new_state").alias("state"), F.max_by("ts", F.when(F.col("in_history"), F.col("sequence"))).alias("last_state_change_at"))
    tried = attempts(events).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("attempt_count"), F.max_by(F.when(F.col("finished_at").isNull(), F.col("attempt_id")), "sequence").alias("current_attempt_id")
    )
    return (
        created.select("run_id", "r.*").join(state, "run_id", "left").join(tried, "run_id", "left")
        .withColumn("attempt_count", F.coalesce("attempt_count", F.lit(0).cast("long"))).withColumn("effective_priority", F.lit(0))
    )


def history(changes: DataFrame) -> DataFrame:
    """State history: run_id, sequence, from_state, to_state, ts."""
    w = Window.partitionBy("run_id").orderBy("sequence")
    told = changes.withColumn("from_state", F.lag("new_state").over(w)).where("in_history")
    return told.select("run_id", "sequence", "from_state", F.col("new_state").alias("to_state"), "ts")


def leases(events: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """Leases that are held: the last lease event neither ended it nor did the run end after it."""
    changes = transitions(events) if changes is None else changes
    grants = _of(events, "LeaseAcquired", "LeaseHeartbeat", "LeaseExpired", "LeaseReleased")
    got = F.when(F.col("event_type") == "LeaseAcquired", F.col("sequence"))
    last = grants.groupBy("run_id").agg(
        _last(F.struct("event_type", "owner", "expiry", F.col("ts").alias("updated_at"))).alias("l"), F.max("sequence").alias("at"), F.max_by("ts", got).alias("acquired_at")
    )
    ended = changes.where(is_terminal(F.col("new_state"))).groupBy("run_id").agg(F.max("sequence").alias("ended"))
    return (
        last.where(~F.col("l.event_type").isin("LeaseExpired", "LeaseReleased")).join(ended, "run_id", "left")
        .where(F.col("ended").isNull() | (F.col("ended") < F.col("at"))).select("run_id", "l.owner", "l.expiry", "acquired_at", "l.updated_at")
    )


def engine_control(events: DataFrame) -> DataFrame:
    """One row: paused, paused_at, resumed_at (null while paused)."""
    control = _of(events, "EnginePaused", "EngineResumed")
    paused = F.col("event_type") == "EnginePaused"
    return control.agg(
        F.coalesce(_last("event_type") == "EnginePaused", F.lit(False)).alias("paused"),
        F.max_by("ts", F.when(paused, F.col("sequence"))).alias("paused_at"),
        F.when(_last("event_type") == "EngineResumed", F.max_by("ts", F.when(~paused, F.col("sequence")))).alias("resumed_at"),
    )


def dependencies(events: DataFrame) -> DataFrame:
    """Edges task_id → prereq_id, without repeats."""
    return _of(events, "DependencyDeclared").select("task_id", F.explode("depends_on").alias("prereq_id")).distinct()


def budget_steps(events: DataFrame) -> DataFrame:
    """Budget events with their epoch (an allocation or replenishment starts one), running consumption and limit.

    Before the first allocation the epoch is 0 and nothing counts; a replenishment needs one.
    Consumption stays at 2^63 - 1 where it would go beyond.
    """
    w = Window.partitionBy("task_id", "dimension").orderBy("sequence").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kind = F.col("event_type")
    told = _of(events, "BudgetAllocated", "BudgetConsumed", "BudgetReplenished", "BudgetExhausted")
    known = told.withColumn("known", F.max((kind == "BudgetAllocated").cast("int")).over(w)).where("known = 1")
    reset = kind.isin("BudgetAllocated", "BudgetReplenished")
    epochs = known.withColumn("epoch", F.sum(reset.cast("long")).over(w))
    e = Window.partitionBy("task_id", "dimension", "epoch").orderBy("sequence").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    used = F.sum(F.when(kind == "BudgetConsumed", F.col("amount")).cast("decimal(38,0)")).over(e)
    return epochs.select(
        "sequence", "event_type", "ts", "task_id", "dimension", "epoch", F.first("amount").over(e).alias("limit"),
        F.least(F.coalesce(used, F.lit(0)), F.lit(MOST).cast("decimal(38,0)")).cast("long").alias("consumed"),
        F.max(kind == "BudgetExhausted").over(e).alias("flagged"),
    )


def budgets(events: DataFrame) -> DataFrame:
    """(task_id, dimension): limit, consumed, exhausted, allocated_at of the current epoch."""
    steps = budget_steps(events)
    last = steps.groupBy("task_id", "dimension").agg(
        _last(F.struct("limit", "consumed", "flagged")).alias("b"),
        F.max_by("ts", F.when(F.col("event_type") == "BudgetAllocated", F.col("sequence"))).alias("allocated_at"),
    )
    return last.select("task_id", "dimension", "b.limit", "b.consumed", (F.col("b.flagged") | (F.col("b.consumed") >= F.col("b.limit"))).alias("exhausted"), "allocated_at")


def subscriptions(events: DataFrame) -> DataFrame:
    """Subscriptions by their last creation; what was triggered or canceled before it does not count."""
    kind = F.col("event_type")
    w = Window.partitionBy("subscription_id").orderBy("sequence").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    told = _of(events, "SubscriptionCreated", "SubscriptionTriggered", "SubscriptionCanceled")
    own = told.withColumn("begin", F.max(F.when(kind == "SubscriptionCreated", F.col("sequence"))).over(w)).where("sequence >= begin")
    at = lambda name: F.max_by("ts", F.when(kind == name, F.col("sequence")))
    made = F.when(kind == "SubscriptionCreated", F.col("sequence"))
    return own.groupBy("subscription_id").agg(
        F.max_by("task_id", made).alias("task_id"), F.max_by("filter", made).alias("filter"), at("SubscriptionCreated").alias("created_at"),
        at("SubscriptionTriggered").alias("triggered_at"), at("SubscriptionCanceled").alias("canceled_at"),
    )


def active_subscriptions(subscriptions: DataFrame) -> DataFrame:
    return subscriptions.where("triggered_at is null and canceled_at is null")


def actors(events: DataFrame) -> DataFrame:
    """Actors by their last registration; heartbeats and deregistrations before it do not count."""
    own = _of(events, "ActorRegistered", "ActorDeregistered", "ActorHeartbeat")
    w = Window.partitionBy("actor_id").orderBy("sequence").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    kind = F.col("event_type")
    begun = own.withColumn("begin", F.max(F.when(kind == "ActorRegistered", F.col("sequence"))).over(w)).where("sequence >= begin")
    at = lambda name: F.max_by("ts", F.when(kind == name, F.col("sequence")))
    made = F.when(kind == "ActorRegistered", F.col("sequence"))
    return begun.groupBy("actor_id").agg(
        F.max_by(F.struct("identity", "capabilities", "department", "heartbeat_interval_secs", "tenant_id", F.col("ts").alias("registered_at")), made).alias("a"),
        F.coalesce(at("ActorHeartbeat"), at("ActorRegistered")).alias("last_heartbeat_at"), at("ActorDeregistered").alias("deregistered_at"),
    ).select("actor_id", "a.*", "last_heartbeat_at", "deregistered_at")


def tenants(events: DataFrame) -> DataFrame:
    """Tenants as last created: a later creation takes the place of the one before."""
    last = _of(events, "TenantCreated").groupBy("tenant_id").agg(_last(F.struct("name", F.col("ts").alias("created_at"))).alias("t"))
    return last.select("tenant_id", "t.*")


def roles(events: DataFrame) -> DataFrame:
    """Of an actor's roles in a tenant the last assigned."""
    return _of(events, "RoleAssigned").groupBy("actor_id", "tenant_id").agg(_last("role").alias("role"), _last("ts").alias("assigned_at"))


def grants(events: DataFrame) -> DataFrame:
    """Capability grants; a new grant undoes a revocation."""
    own = _of(events, "CapabilityGranted", "CapabilityRevoked")
    granted = F.col("event_type") == "CapabilityGranted"
    return own.groupBy("actor_id", "capability", "tenant_id").agg(
        F.max_by("ts", F.when(granted, F.col("sequence"))).alias("granted_at"), _last(F.when(~granted, F.col("ts"))).alias("revoked_at")
    )


def ledger(events: DataFrame) -> DataFrame:
    return _of(events, "LedgerEntryAppended").select("sequence", "entry_id", "tenant_id", "ledger_key", "actor_id", "payload", "ts")


def trim_terminal(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """History or attempts without those of runs that have ended."""
    return rows.join(runs.where(is_terminal(F.col("state"))).select("run_id"), "run_id", "left_anti")
