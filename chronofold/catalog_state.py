"""More registered queries: folds of every event kind, every command kind, cascades and tick parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.catalog import _LEGAL, _TERMINAL, ORACLE_SQL, QUERIES, _log, _query, _with
from chronofold.functions import lifecycle as L
from chronofold.operators import fold, graph, report, schedule, validate
from chronofold.plans import views
from chronofold.plans.views import NOW

__all__ = ["ORACLE_SQL", "QUERIES"]


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return views.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))


# -- folds ---------------------------------------------------------------------------------------


@_query(
    "stated_transitions",
    f"{_with('e', 'c')}, s AS (SELECT c.sequence, c.run_id, c.new_state, CASE WHEN e.n > 1 AND c.sequence % 3 = 0 THEN 'Leased' END AS stated, "
    "lag(c.new_state) OVER (PARTITION BY c.run_id ORDER BY c.sequence) AS now FROM c JOIN e USING (sequence)), "
    f"v AS (SELECT *, CASE WHEN now IS NULL THEN NULL WHEN stated <> now THEN 'stale_previous' WHEN now || '>' || new_state NOT IN ({_LEGAL}) THEN 'illegal' END AS violation FROM s) "
    "SELECT sequence, run_id, violation FROM v WHERE violation IS NOT NULL",
)
def _(spark, sf):
    """Every third change states Leased as the state before it."""
    raw = views.state_events(_log(spark, sf))
    stated = raw.withColumn("prev_state", F.when((F.col("event_type") == "RunStateChanged") & (F.col("sequence") % 3 == 0), "Leased"))
    return fold.checked_transitions(fold.transitions(stated)).where("violation is not null").select("sequence", "run_id", "violation")


@_query(
    "released_runs",
    f"{_with('e', 'c')} SELECT 2 * sequence - 1 AS sequence, run_id, now AS prev_state FROM (SELECT c.sequence, c.run_id, event_type, lag(new_state) OVER (PARTITION BY c.run_id ORDER BY c.sequence) AS now FROM c JOIN e USING (sequence)) "
    "WHERE event_type = 'error' AND now = 'Leased'",
)
def _(spark, sf):
    """Leased runs that a release returns to Ready, without a row of history; a release comes just before the change of its event."""
    raw = _log(spark, sf)
    states = views.state_events(raw).withColumn("sequence", F.col("sequence") * 2)
    leases = views.lease_events(raw).withColumn("sequence", F.col("sequence") * 2 - 1)
    changes = fold.transitions(states.unionByName(leases, allowMissingColumns=True))
    return changes.where("not in_history").select("sequence", "run_id", "prev_state")


@_query(
    "signaled_runs",
    f"{_with('e')}, s AS (SELECT sequence, run_id, CASE WHEN n = 1 THEN 'Scheduled' WHEN event_type = 'view' THEN 'Ready' WHEN event_type = 'click' THEN 'Suspended' WHEN event_type = 'error' THEN 'Canceled' ELSE 'Running' END AS state, "
    "CASE WHEN n > 1 AND event_type = 'view' THEN 'Suspended' WHEN n > 1 AND event_type = 'click' THEN 'Running' END AS stated FROM e) "
    "SELECT run_id, arg_max(state, sequence) AS state, count(*) AS changes, count(stated) AS stated FROM s GROUP BY run_id",
)
def _(spark, sf):
    """Suspensions, resumptions and cancellations as events of their own."""
    raw, kind = _log(spark, sf), F.col("event_type")
    told = raw.select(
        "sequence", "ts", "run_id", F.lit(None).cast("string").alias("prev_state"), F.lit("Running").alias("new_state"),
        F.when(F.col("n") == 1, "RunCreated").when(kind == "view", "RunResumed").when(kind == "click", "RunSuspended").when(kind == "error", "RunCanceled").otherwise("RunStateChanged").alias("event_type"),
    )
    changes = fold.transitions(told)
    return changes.groupBy("run_id").agg(F.max_by("new_state", "sequence").alias("state"), F.count(F.lit(1)).alias("changes"), F.count("prev_state").alias("stated"))


@_query(
    "logged_tasks",
    "SELECT o_custkey AS task_id, arg_min(o_orderkey, o_orderkey) FILTER (o_orderkey % 3 <> 0) AS created_at, arg_min(5 - CAST(substr(o_orderpriority, 1, 1) AS INT), o_orderkey) FILTER (o_orderkey % 3 <> 0) AS priority, "
    "min(o_orderkey) FILTER (o_orderkey % 3 = 0) AS canceled_at FROM orders GROUP BY o_custkey HAVING count(*) FILTER (o_orderkey % 3 <> 0) > 0",
)
def _(spark, sf):
    """Customers as tasks: orders create them, again and again, and every third cancels them."""
    o, key = views.table(spark, sf, "orders"), F.col("o_orderkey")
    told = o.select(
        key.alias("sequence"), F.when(key % 3 == 0, "TaskCanceled").otherwise("TaskCreated").alias("event_type"), key.alias("ts"), F.col("o_custkey").alias("task_id"),
        (5 - F.substring("o_orderpriority", 1, 1).cast("int")).alias("priority"),
    )
    return fold.tasks(told).select("task_id", "created_at", "priority", "canceled_at")


@_query(
    "logged_subscriptions",
    f"{_with('e')}, b AS (SELECT *, max(CASE WHEN event_type = 'signup' THEN sequence END) OVER (PARTITION BY run_id) AS begin FROM e WHERE event_type IN ('signup', 'view', 'error')) "
    "SELECT run_id AS subscription_id, arg_max(ts, sequence) FILTER (event_type = 'signup') AS created_at, arg_max(ts, sequence) FILTER (event_type = 'view') AS triggered_at, "
    "arg_max(ts, sequence) FILTER (event_type = 'error') AS canceled_at FROM b WHERE sequence >= begin GROUP BY run_id",
)
def _(spark, sf):
    kind = F.col("event_type")
    name = F.when(kind == "signup", "SubscriptionCreated").when(kind == "view", "SubscriptionTriggered").when(kind == "error", "SubscriptionCanceled")
    told = _log(spark, sf).withColumn("event_type", name).where("event_type is not null")
    told = told.select("sequence", "event_type", "ts", F.col("run_id").alias("subscription_id"), F.col("run_id").alias("task_id"), F.lit(None).cast("string").alias("filter"))
    return fold.subscriptions(told).select("subscription_id", "created_at", "triggered_at", "canceled_at")


@_query("logged_tenants", f"{_with('t')} SELECT tenant_id, 'tenant-' || arg_max(task_id, task_id) AS name, arg_max(created_at, task_id) AS created_at FROM t WHERE tenant_id IS NOT NULL GROUP BY tenant_id")
def _(spark, sf):
    told = views.tasks(spark, sf).where("tenant_id is not null").select(
        F.col("task_id").alias("sequence"), F.lit("TenantCreated").alias("event_type"), F.col("created_at").alias("ts"), "tenant_id", F.concat(F.lit("tenant-"), F.col("task_id").cast("string")).alias("name")
    )
    return fold.tenants(told)


@_query("logged_dependencies", f"{_with('d')} SELECT task_id, prereq_id FROM d UNION SELECT task_id, prereq_id // 2 FROM d")
def _(spark, sf):
    edge = views.edges(spark, sf)
    told = edge.select(
        F.col("task_id").alias("sequence"), F.lit("DependencyDeclared").alias("event_type"), "task_id", F.array("prereq_id", F.floor(F.col("prereq_id") / 2).cast("long"), "prereq_id").alias("depends_on")
    )
    return fold.dependencies(told)


@_query(
    "saturated_budgets",
    f"{_with('b')}, s AS (SELECT *, CASE WHEN kind = 'C' AND task_id % 2 = 0 THEN 5000000000000000000::HUGEINT ELSE amount::HUGEINT END AS a FROM b), "
    "l AS (SELECT *, max(epoch) OVER (PARTITION BY task_id) AS latest FROM s) "
    "SELECT task_id, CAST(least(coalesce(sum(CASE WHEN kind = 'C' THEN a END), 0), 9223372036854775807) AS BIGINT) AS consumed FROM l WHERE epoch = latest GROUP BY task_id",
)
def _(spark, sf):
    """Even tasks consume so much at once that sums would overflow."""
    told = views.budget_events(_log(spark, sf))
    huge = (F.col("event_type") == "BudgetConsumed") & (F.col("task_id") % 2 == 0)
    return fold.budgets(told.withColumn("amount", F.when(huge, F.lit(5_000_000_000_000_000_000)).otherwise(F.col("amount")))).select("task_id", "consumed")


@_query(
    "exhausted_flags",
    f"{_with('e')}, x AS (SELECT sequence, run_id AS task_id, CASE event_type WHEN 'signup' THEN 'A' WHEN 'click' THEN 'C' WHEN 'error' THEN 'X' END AS kind FROM e WHERE event_type IN ('signup', 'click', 'error')), "
    "y AS (SELECT *, max(CASE WHEN kind = 'A' THEN sequence END) OVER (PARTITION BY task_id) AS begin FROM x) "
    "SELECT task_id, count(*) FILTER (kind = 'C') AS consumed, coalesce(bool_or(kind = 'X'), false) OR count(*) FILTER (kind = 'C') >= 1000 AS exhausted FROM y WHERE sequence >= begin GROUP BY task_id",
)
def _(spark, sf):
    """Budgets of 1000, a click consumes 1, an error tells that the budget is exhausted."""
    kind = F.col("event_type")
    name = F.when(kind == "signup", "BudgetAllocated").when(kind == "click", "BudgetConsumed").when(kind == "error", "BudgetExhausted")
    told = _log(spark, sf).withColumn("event_type", name).where("event_type is not null")
    told = told.select("sequence", "event_type", "ts", F.col("run_id").alias("task_id"), F.lit("Token").alias("dimension"), F.when(F.col("event_type") == "BudgetAllocated", 1000).otherwise(1).cast("long").alias("amount"))
    return fold.budgets(told).select("task_id", "consumed", "exhausted")


# -- validation -----------------------------------------------------------------------------------

_KINDS = (
    "TaskCreate", "RunCreate", "RunStateTransition", "AttemptStart", "AttemptFinish", "LeaseAcquire", "LeaseHeartbeat", "LeaseExpire", "LeaseRelease", "TaskCancel",
    "DependencyDeclare", "EnginePause", "EngineResume", "RunSuspend", "RunResume", "BudgetAllocate", "BudgetConsume", "BudgetReplenish", "SubscriptionCreate", "SubscriptionCancel",
)


def _state(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """State that commands meet: two thirds of the tasks, all runs, leases, budgets, subscriptions; the engine is paused."""
    task, run = views.tasks(spark, sf), views.runs(spark, sf)
    key = F.col("task_id")
    runs = run.withColumn("current_attempt_id", F.when((F.col("state") == "Running") & (key % 2 == 0), F.col("run_id") + 7))
    return {
        "tasks": task.where("task_id % 3 <> 0"), "runs": runs,
        "leases": run.where("state in ('Leased', 'Running', 'Suspended') and task_id % 4 <> 0").select("run_id", (key % 7).alias("owner"), (F.col("created_at") + 300).alias("expiry")),
        "budgets": task.where("task_id % 4 = 0").select("task_id", F.lit("Cost").alias("dimension")),
        "subscriptions": task.where("task_id % 3 = 1").select(key.alias("subscription_id"), F.when(key % 2 == 1, F.col("created_at")).alias("canceled_at")),
        "engine": spark.range(1).select(F.lit(True).alias("paused")),
    }


_COMMANDS = f"""{_with('t', 'r')}, q AS (SELECT t.task_id AS k, (t.task_id // 3) % 20 AS kind, t.task_id % 3 <> 0 AS has_task, t.task_id % 13 <> 1 AS has_run, r.state AS s, r.state = 'Running' AND t.task_id % 2 = 0 AS trying,
    r.state IN ('Leased', 'Running', 'Suspended') AND t.task_id % 4 <> 0 AS held, t.task_id % 5 = 0 AS other, t.task_id % 9 - 4 AS d, t.task_id % 50 = 0 AS gone
    FROM t JOIN r ON r.run_id = t.task_id * 10)"""


@_query(
    "rejected_commands",
    f"""{_COMMANDS} SELECT k AS command_id, CASE
        WHEN kind = 0 THEN CASE WHEN has_task THEN 'duplicate_task' END
        WHEN kind = 1 THEN CASE WHEN NOT has_task THEN 'unknown_task' WHEN has_run THEN 'duplicate_run' WHEN k % 2 = 0 THEN 'not_scheduled' END
        WHEN kind = 2 THEN CASE WHEN NOT has_run THEN 'unknown_run' WHEN s <> 'Leased' THEN 'stale_previous' WHEN k % 2 = 0 THEN 'illegal_transition' END
        WHEN kind = 3 THEN CASE WHEN NOT has_run THEN 'unknown_run' WHEN s <> 'Running' THEN 'not_running' WHEN trying THEN 'attempt_active' END
        WHEN kind = 4 THEN CASE WHEN NOT has_run THEN 'unknown_run' WHEN s <> 'Running' THEN 'not_running' WHEN NOT trying OR k % 5 = 0 THEN 'attempt_mismatch' END
        WHEN kind = 5 THEN CASE WHEN NOT has_run THEN 'unknown_run' WHEN s NOT IN ('Ready', 'Leased') THEN 'wrong_state' WHEN held THEN 'already_leased' END
        WHEN kind = 6 THEN CASE WHEN NOT has_run THEN 'unknown_run' WHEN s NOT IN ('Leased', 'Running') THEN 'wrong_state' WHEN NOT held THEN 'no_lease' WHEN other THEN 'owner_mismatch' WHEN d < 0 THEN 'expiry_goes_back' END
        WHEN kind IN (7, 8) THEN CASE WHEN NOT has_run THEN 'unknown_run' WHEN s NOT IN ('Ready', 'Leased', 'Running') THEN 'wrong_state' WHEN NOT held THEN 'no_lease' WHEN other THEN 'owner_mismatch' WHEN d <> 0 THEN 'expiry_mismatch' END
        WHEN kind = 9 THEN CASE WHEN NOT has_task THEN 'unknown_task' WHEN gone THEN 'already_canceled' END
        WHEN kind = 10 THEN CASE WHEN NOT has_task THEN 'unknown_task' WHEN k % 4 = 0 THEN 'no_prerequisites' WHEN (k + 1) % 3 = 0 OR k + 1 NOT IN (SELECT task_id FROM t) THEN 'unknown_prerequisite' END
        WHEN kind = 11 THEN 'already_paused'
        WHEN kind = 13 THEN CASE WHEN NOT has_run THEN 'unknown_run' WHEN s <> 'Running' THEN 'not_running' END
        WHEN kind = 14 THEN CASE WHEN NOT has_run THEN 'unknown_run' WHEN s <> 'Suspended' THEN 'not_suspended' END
        WHEN kind IN (15, 16) THEN CASE WHEN NOT has_task THEN 'unknown_task' END
        WHEN kind = 17 THEN CASE WHEN NOT has_task THEN 'unknown_task' WHEN k % 4 <> 0 THEN 'no_budget' END
        WHEN kind = 18 THEN CASE WHEN NOT has_task THEN 'unknown_task' WHEN k % 3 = 1 THEN 'duplicate_subscription' END
        WHEN kind = 19 THEN CASE WHEN k % 3 <> 1 THEN 'unknown_subscription' WHEN k % 2 = 1 THEN 'already_canceled' END
        END AS reason FROM q""",
)
def _(spark, sf):
    """A command for each order, of every kind, against state that has some of what it names."""
    key = F.col("task_id")
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.floor(key / 3) % 20 + 1).cast("int"))
    even = key % 2 == 0
    commands = views.tasks(spark, sf).select(
        key.alias("command_id"), kind.alias("kind"), "task_id", F.when(key % 13 == 1, -1).otherwise(key * 10).cast("long").alias("run_id"), F.lit("Leased").alias("prev_state"),
        F.when(kind == "RunCreate", F.when(even, "Ready").otherwise("Scheduled")).otherwise(F.when(even, "Completed").otherwise("Running")).alias("new_state"),
        (key * 10 + F.when(key % 5 == 0, 8).otherwise(7)).alias("attempt_id"), F.when(key % 5 == 0, -1).otherwise(key % 7).cast("long").alias("owner"),
        (F.col("created_at") + 300 + key % 9 - 4).alias("expiry"), F.lit("Cost").alias("dimension"), key.alias("subscription_id"), F.when(key % 4 != 0, F.array(key + 1)).alias("depends_on"),
    )
    return validate.rejected(commands, _state(spark, sf)).select("command_id", "reason")


@_query(
    "run_payload_violations",
    f"{_with('r')} SELECT run_id, CASE WHEN task_id % 17 = 0 THEN 'task_id' WHEN state = 'Ready' AND scheduled_at > created_at THEN 'ready_schedule' WHEN task_id % 2 = 0 AND state NOT IN ('Running', 'Canceled') THEN 'attempt_state' "
    "WHEN task_id % 2 = 0 AND attempt_count = 0 THEN 'attempt_count' END AS violation FROM r WHERE violation IS NOT NULL",
)
def _(spark, sf):
    """Runs of a snapshot: every seventeenth order's has no task, every second order's has an attempt under way."""
    key = F.col("task_id")
    runs = views.runs(spark, sf).withColumn("current_attempt_id", F.when(key % 2 == 0, F.col("run_id")))
    return validate.run_violations(runs.withColumn("task_id", F.when(key % 17 != 0, key)))


@_query("command_gaps", "SELECT o_orderkey AS command_id, o_orderkey + 100 AS sequence, 100 + row_number() OVER (ORDER BY o_orderkey) AS expected FROM orders QUALIFY sequence <> expected")
def _(spark, sf):
    commands = _orders(spark, sf).select(F.col("k").alias("command_id"), (F.col("k") + 100).alias("sequence"))
    return validate.sequence_gaps(commands, 100).select("command_id", "sequence", "expected")


# -- graphs, promotion, admission -------------------------------------------------------------------

_GATE = (
    f"{_with('o', 'd', 'r')}, f AS (SELECT task_id FROM o WHERE all_terminal AND NOT any_completed), "
    "z AS (SELECT k AS task_id FROM (SELECT o_orderkey AS k, f.task_id AS own, bool_or(f.task_id IS NOT NULL) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bad FROM orders LEFT JOIN f ON f.task_id = o_orderkey) WHERE bad AND own IS NULL), "
    "m AS (SELECT o_orderkey AS task_id FROM orders WHERE o_orderkey NOT IN (SELECT task_id FROM z) AND o_orderkey NOT IN (SELECT d.task_id FROM d WHERE d.prereq_id NOT IN (SELECT task_id FROM o WHERE all_terminal AND any_completed)))"
)


def _gates(spark: SparkSession, sf: str) -> DataFrame:
    return graph.eligibility(views.tasks(spark, sf, tenants=False), views.edges(spark, sf), report.task_outcomes(views.runs(spark, sf, tenants=False)))


@_query("dependency_cancels", f"{_GATE} SELECT run_id FROM r WHERE state NOT IN {_TERMINAL} AND task_id IN (SELECT task_id FROM z)")
def _(spark, sf):
    runs = views.runs(spark, sf)
    return graph.dependency_cancels(runs, _gates(spark, sf)).select("run_id")


@_query("eligible_runs", f"{_GATE} SELECT run_id FROM r WHERE state = 'Ready' AND task_id IN (SELECT task_id FROM m)")
def _(spark, sf):
    runs = views.runs(spark, sf)
    return graph.eligible_runs(runs.where("state = 'Ready'"), _gates(spark, sf)).select("run_id")


@_query("newly_eligible", "SELECT o_orderkey AS task_id FROM orders WHERE o_orderkey % 6 = 2")
def _(spark, sf):
    """Before, multiples of three were eligible; now all even tasks are, but for multiples of six, which both have, and those of 6n + 4."""
    task = _orders(spark, sf).select(F.col("k").alias("task_id"))
    gate = lambda ok: task.withColumn("gate", F.when(ok, "eligible").otherwise("waiting"))
    return graph.newly_eligible(gate(F.col("task_id") % 3 == 0), gate((F.col("task_id") % 2 == 0) & (F.col("task_id") % 6 != 4)))


@_query(
    "child_violations",
    f"{_with('t', 'o')}, h AS (SELECT task_id, 0 AS depth FROM t WHERE parent_task_id IS NULL UNION ALL SELECT t.task_id, h.depth + 1 FROM t JOIN h ON t.parent_task_id = h.task_id WHERE h.depth < 8) "
    "SELECT t.task_id, CASE WHEN coalesce(o.all_terminal, false) THEN 'OrphanPrevention' WHEN h.depth IS NULL OR h.depth >= 8 THEN 'DepthLimitExceeded' END AS violation FROM t LEFT JOIN o USING (task_id) LEFT JOIN h USING (task_id)",
)
def _(spark, sf):
    """A child is proposed below every task."""
    task = views.tasks(spark, sf)
    kids = task.select((-F.col("task_id")).alias("task_id"), F.col("task_id").alias("parent_task_id"))
    return graph.child_violations(kids, task, report.task_outcomes(views.runs(spark, sf))).select(F.col("parent_task_id").alias("task_id"), "violation")


@_query(
    "collectable_tasks",
    f"{_with('t', 'o')}, up AS (SELECT parent_task_id AS task_id FROM t WHERE task_id NOT IN (SELECT task_id FROM o WHERE all_terminal) UNION SELECT t.parent_task_id FROM t JOIN up ON t.task_id = up.task_id) "
    "SELECT task_id FROM o WHERE all_terminal AND task_id NOT IN (SELECT task_id FROM up WHERE task_id IS NOT NULL)",
)
def _(spark, sf):
    return graph.collectable(views.tasks(spark, sf, tenants=False), report.task_outcomes(views.runs(spark, sf, tenants=False)).where("all_terminal"))


@_query("triggered_promotions", f"{_with('r')} SELECT run_id FROM r WHERE state = 'Scheduled' AND task_id % 5 = 0 AND task_id % 7 <> 0 AND task_id % 2 = 0")
def _(spark, sf):
    """Every fifth task's subscription is triggered, every seventh's canceled; even tasks are eligible."""
    task, key = views.tasks(spark, sf), F.col("task_id")
    subs = task.select("task_id", F.when(key % 5 == 0, F.lit(NOW)).alias("triggered_at"), F.when(key % 7 == 0, F.lit(NOW)).alias("canceled_at"))
    return schedule.promote_triggered(views.runs(spark, sf), subs, task.where("task_id % 2 = 0")).select("run_id")


@_query("subscription_triggers", "SELECT c_custkey AS subscription_id, c_custkey % 5 = 0 AND c_custkey % 7 <> 0 AS is_triggered FROM customer")
def _(spark, sf):
    key = F.col("c_custkey")
    subs = views.table(spark, sf, "customer").select(key.alias("subscription_id"), F.when(key % 5 == 0, F.lit(NOW)).alias("triggered_at"), F.when(key % 7 == 0, F.lit(NOW)).alias("canceled_at"))
    return subs.select("subscription_id", (F.col("triggered_at").isNotNull() & F.col("canceled_at").isNull()).alias("is_triggered"))


@_query("lease_requests", f"{_with('r')} SELECT run_id, CASE WHEN state IN ('Leased', 'Running') AND task_id % 4 <> 0 THEN 'AlreadyLeased' WHEN state <> 'Ready' THEN 'WrongState' ELSE 'Acquired' END AS outcome FROM r")
def _(spark, sf):
    runs = views.runs(spark, sf)
    held = runs.where("state in ('Leased', 'Running') and task_id % 4 <> 0").select("run_id", F.lit("w").alias("owner"))
    return schedule.acquire_lease(runs.select("run_id", F.lit("v").alias("owner")), runs, held).select("run_id", "outcome")


@_query("tick_totals", f"{_with('r')} SELECT count(*) FILTER (state = 'Scheduled' AND scheduled_at <= {NOW}) AS promoted, count(*) FILTER (state = 'Ready') AS ready, 0 AS dispatched FROM r")
def _(spark, sf):
    """Parts of a tick while the engine is paused: nothing is dispatched."""
    runs = views.runs(spark, sf)
    ready = runs.where("state = 'Ready'")
    paused = fold.engine_control(_orders(spark, sf).select(F.col("k").alias("sequence"), F.lit("EnginePaused").alias("event_type"), F.col("k").alias("ts")))
    totals = report.tick_totals(promoted=schedule.promote_due(runs, F.lit(NOW)), ready=ready, dispatched=schedule.unless_paused(ready, paused))
    return totals.withColumn("dispatched", F.col("dispatched").cast("int"))


@_query("cooperation_counts", f"{_with('a')}, x AS (SELECT attempt_id FROM a WHERE finished_at - started_at > 7200) SELECT count(*) FILTER (attempt_id % 4 <> 0 AND attempt_id % 500 <= 250) AS cooperative, count(*) FILTER (attempt_id % 4 <> 0 AND attempt_id % 500 > 250) AS threshold_breach, count(*) FILTER (attempt_id % 4 = 0) AS non_cooperative FROM x")
def _(spark, sf):
    tried = fold.attempts(views.attempt_events(_log(spark, sf))).where("finished_at is not null")
    late = L.timeout_class(F.lit(7200), F.col("finished_at") - F.col("started_at")) == "TimedOut"
    return report.cooperation_counts(tried.select(L.timeout_cooperation(late, F.col("attempt_id") % 4 != 0, F.col("attempt_id") % 500).alias("cooperation")))


# -- lookups -----------------------------------------------------------------------------------------


@_query("run_by_id", f"{_with('r')} SELECT run_id, task_id, state, attempt_count FROM r WHERE run_id = 70")
def _(spark, sf):
    return report.found(views.runs(spark, sf), "run_id", 70).select("run_id", "task_id", "state", "attempt_count")


@_query("task_details", f"{_with('t', 'r')} SELECT t.task_id, t.priority, count(r.run_id) AS n_runs, min(r.run_id) AS first_run, sum(r.attempt_count)::BIGINT AS attempts FROM t LEFT JOIN r USING (task_id) GROUP BY ALL")
def _(spark, sf):
    told = report.task_detail(views.tasks(spark, sf), views.runs(spark, sf))
    total = F.aggregate(F.col("runs.attempt_count"), F.lit(0).cast("long"), lambda a, n: a + n)
    return told.select("task_id", "priority", F.size("runs").cast("long").alias("n_runs"), F.col("runs")[0]["run_id"].alias("first_run"), total.alias("attempts"))


@_query("runs_of_task", f"{_with('r')} SELECT task_id, count(*) AS n_runs, min(run_id) AS first_run, max(run_id) AS last_run FROM r GROUP BY task_id")
def _(spark, sf):
    own = report.runs_of_task(views.runs(spark, sf))
    return own.select("task_id", F.size("run_ids").cast("long").alias("n_runs"), F.col("run_ids")[0].alias("first_run"), F.element_at("run_ids", -1).alias("last_run"))


@_query("department_members", f"{_with('e')}, x AS (SELECT run_id, max(sequence) FILTER (event_type = 'signup') AS made, max(sequence) FILTER (event_type = 'error' AND sequence % 2 = 1) AS gone FROM e GROUP BY run_id) SELECT CAST(run_id % 5 AS VARCHAR) AS department, count(*) AS actors FROM x WHERE made IS NOT NULL AND (gone IS NULL OR gone < made) GROUP BY ALL")
def _(spark, sf):
    return report.department_members(fold.actors(views.actor_events(_log(spark, sf))))
