"""Which proposed commands, and which snapshots, would be rejected, and why."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronofold.functions.lifecycle import is_valid_transition
from chronofold.model import TRANSITIONS
from chronofold.sources.scratch import materialize


def transition_table(spark) -> DataFrame:
    """The legal transitions, from_state and to_state."""
    return spark.createDataFrame(list(TRANSITIONS), "from_state string, to_state string")


def sequence_gaps(commands: DataFrame, latest: int) -> DataFrame:
    """Commands (sequence, command_id) that are not latest+1, +2, ... in order of command_id.

    Ranges of command_id are numbered apart, each from the count of those before it.
    """
    dealt = materialize(commands.repartitionByRange("command_id").withColumn("_part", F.spark_partition_id()), "commands")
    # A row per partition.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    number = F.row_number().over(Window.partitionBy("_part").orderBy("command_id"))
    numbered = dealt.withColumn("_number", number).join(F.broadcast(counts), "_part")
    return numbered.withColumn("expected", F.col("_number") + F.col("_before") + F.lit(latest)).where("sequence <> expected").select(*commands.columns, "expected")


def rejected(commands: DataFrame, state: dict[str, DataFrame]) -> DataFrame:
    """Commands with ``reason``, null where one would be accepted.

    Commands have command_id, kind and the fields of its event. ``state`` has tasks, runs,
    attempts, leases, budgets, subscriptions and engine. Each is joined by its key; every
    command is judged against the state before the batch.
    """
    tasks = state["tasks"].select("task_id", F.lit(True).alias("s_task"), F.col("canceled_at").alias("s_canceled"))
    runs = state["runs"].select("run_id", F.col("state").alias("s_state"), F.col("current_attempt_id").alias("s_attempt"))
    leases = state["leases"].select("run_id", F.col("owner").alias("s_owner"), F.col("expiry").alias("s_expiry"))
    budgets = state["budgets"].select("task_id", "dimension", F.lit(True).alias("s_budget"))
    subs = state["subscriptions"].select("subscription_id", F.lit(True).alias("s_sub"), F.col("canceled_at").alias("s_sub_canceled"))
    engine = state["engine"].select(F.col("paused").alias("s_paused"))
    known = (
        commands.join(tasks, "task_id", "left").join(runs, "run_id", "left").join(leases, "run_id", "left")
        .join(budgets, ["task_id", "dimension"], "left").join(subs, "subscription_id", "left").join(F.broadcast(engine), how="left", on=F.lit(True))
    )
    missing = (
        commands.where("kind = 'DependencyDeclare'").select("command_id", F.explode("depends_on").alias("task_id"))
        .join(state["tasks"].select("task_id"), "task_id", "left_anti").select("command_id", F.lit(True).alias("s_missing")).distinct()
    )
    known = known.join(missing, "command_id", "left")
    kind = F.col("kind")
    task, run = F.col("s_task").isNotNull(), F.col("s_state").isNotNull()
    held = F.col("s_owner").isNotNull()
    open_states = F.col("s_state").isin("Ready", "Leased", "Running")

    def when(name: str, *rules: tuple) -> list[tuple]:
        return [(kind.isin(*name.split("|")) & F.coalesce(broken, F.lit(True)), reason) for broken, reason in rules]

    rules = [
        *when("TaskCreate", (task, "duplicate_task")),
        *when("RunCreate", (~task, "unknown_task"), (run, "duplicate_run"), (F.coalesce("new_state", F.lit("Scheduled")) != "Scheduled", "not_scheduled")),
        *when("RunStateTransition", (~run, "unknown_run"), (F.col("prev_state") != F.col("s_state"), "stale_previous"), (~is_valid_transition(F.col("prev_state"), F.col("new_state")), "illegal_transition")),
        *when("AttemptStart", (~run, "unknown_run"), (F.col("s_state") != "Running", "not_running"), (F.col("s_attempt").isNotNull(), "attempt_active")),
        *when("AttemptFinish", (~run, "unknown_run"), (F.col("s_state") != "Running", "not_running"), (F.col("s_attempt") != F.col("attempt_id"), "attempt_mismatch")),
        *when("LeaseAcquire", (~run, "unknown_run"), (~F.col("s_state").isin("Ready", "Leased"), "wrong_state"), (held, "already_leased")),
        *when("LeaseHeartbeat", (~run, "unknown_run"), (~F.col("s_state").isin("Leased", "Running"), "wrong_state"), (~held, "no_lease"), (F.col("owner") != F.col("s_owner"), "owner_mismatch"), (F.col("expiry") < F.col("s_expiry"), "expiry_goes_back")),
        *when("LeaseExpire|LeaseRelease", (~run, "unknown_run"), (~open_states, "wrong_state"), (~held, "no_lease"), (F.col("owner") != F.col("s_owner"), "owner_mismatch"), (F.col("expiry") != F.col("s_expiry"), "expiry_mismatch")),
        *when("TaskCancel", (~task, "unknown_task"), (F.col("s_canceled").isNotNull(), "already_canceled")),
        *when("DependencyDeclare", (~task, "unknown_task"), (F.coalesce(F.size("depends_on"), F.lit(0)) < 1, "no_prerequisites"), (F.coalesce("s_missing", F.lit(False)), "unknown_prerequisite")),
        *when("EnginePause", (F.coalesce("s_paused", F.lit(False)), "already_paused")),
        *when("EngineResume", (~F.coalesce("s_paused", F.lit(False)), "not_paused")),
        *when("RunSuspend", (~run, "unknown_run"), (F.col("s_state") != "Running", "not_running")),
        *when("RunResume", (~run, "unknown_run"), (F.col("s_state") != "Suspended", "not_suspended")),
        *when("BudgetAllocate|BudgetConsume|BudgetReplenish", (~task, "unknown_task")),
        *when("BudgetReplenish", (F.col("s_budget").isNull(), "no_budget")),
        *when("SubscriptionCreate", (~task, "unknown_task"), (F.col("s_sub").isNotNull(), "duplicate_subscription")),
        *when("SubscriptionCancel", (F.col("s_sub").isNull(), "unknown_subscription"), (F.col("s_sub_canceled").isNotNull(), "already_canceled")),
    ]
    reason = F.lit(None).cast("string")
    for broken, name in reversed(rules):
        reason = F.when(broken, name).otherwise(reason)
    return known.select(*commands.columns, reason.alias("reason"))


def engine_violations(engine: DataFrame) -> DataFrame:
    """Rows of an engine table that cannot be: paused without a time, resumed before or without a pause."""
    bad = (
        (F.col("paused") & (F.col("paused_at").isNull() | F.col("resumed_at").isNotNull()))
        | (F.col("resumed_at").isNotNull() & (F.col("paused_at").isNull() | (F.col("resumed_at") < F.col("paused_at"))))
    )
    return engine.where(bad)


def history_violations(runs: DataFrame, history: DataFrame, attempts: DataFrame, leases: DataFrame) -> DataFrame:
    """Runs of a snapshot whose history, attempts or lease do not fit: run_id, violation."""
    w = Window.partitionBy("run_id").orderBy("sequence")
    chain = history.withColumns({"before": F.lag("to_state").over(w), "n": F.row_number().over(w)}).join(runs.select("run_id", "created_at"), "run_id", "left")
    broken = chain.groupBy("run_id").agg(
        F.bool_or((F.col("n") == 1) & (F.col("from_state").isNotNull() | (F.col("to_state") != "Scheduled") | (F.col("ts") != F.col("created_at")))).alias("bad_start"),
        F.bool_or((F.col("n") > 1) & ~F.col("from_state").eqNullSafe(F.col("before"))).alias("gap"),
        F.bool_or((F.col("n") > 1) & ~is_valid_transition(F.col("from_state"), F.col("to_state"))).alias("illegal"),
        F.max_by("to_state", "sequence").alias("last"),
    )
    tried = attempts.groupBy("run_id").agg(F.count(F.lit(1)).alias("tried"))
    current = attempts.groupBy("run_id", F.col("attempt_id").alias("current_attempt_id")).agg(F.count(F.lit(1)).alias("found"), F.count_if(F.col("finished_at").isNull()).alias("unfinished"))
    out = runs.join(broken, "run_id", "left").join(tried, "run_id", "left").join(current, ["run_id", "current_attempt_id"], "left").join(leases.select("run_id", F.lit(True).alias("leased")), "run_id", "left")
    tried_n = F.coalesce("tried", F.lit(0))
    violation = (
        F.when(F.col("last").isNull(), "no_history").when(F.col("bad_start"), "bad_start").when(F.col("gap"), "gap").when(F.col("illegal"), "illegal")
        .when(F.col("last") != F.col("state"), "last_state").when(tried_n != F.col("attempt_count"), "attempt_count")
        .when(F.col("current_attempt_id").isNotNull() & ~F.coalesce((F.col("found") == 1) & (F.col("unfinished") == 1), F.lit(False)), "active_attempt")
        .when(F.col("leased") & ~F.col("state").isin("Ready", "Leased", "Running"), "lease_presence")
    )
    return out.select("run_id", violation.alias("violation")).where("violation is not null")


def run_violations(runs: DataFrame) -> DataFrame:
    """Runs of a snapshot that cannot be, with the first rule that each breaks: run_id, violation.

    A nil or missing id; Ready although scheduled after its creation; an attempt under way in a
    state other than Running or Canceled, or with an attempt count of 0.
    """
    nil = "00000000-0000-0000-0000-000000000000"
    none = lambda c: F.col(c).isNull() | (F.col(c).cast("string") == nil)
    active = F.col("current_attempt_id").isNotNull()
    violation = (
        F.when(none("run_id"), "run_id").when(none("task_id"), "task_id")
        .when((F.col("state") == "Ready") & (F.col("scheduled_at") > F.col("created_at")), "ready_schedule")
        .when(active & ~F.col("state").isin("Running", "Canceled"), "attempt_state")
        .when(active & (F.col("attempt_count") == 0), "attempt_count")
    )
    return runs.select("run_id", violation.alias("violation")).where("violation is not null")


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose parent does not exist."""
    return children.join(parents.select(key), key, "left_anti")


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
