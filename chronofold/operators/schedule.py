"""Which runs are due, admissible or to be renewed, and what follows from an event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.functions.cron import WINDOW, with_occurrences
from chronofold.functions.lifecycle import capabilities_match, exponential_backoff_ms, heartbeat_timed_out, is_due, is_terminal, lease_expired, lease_renewal_due, retry_ready_at, saturating_add
from chronofold.sources.scratch import materialize

#: Actors of a block, at most, and those that are broadcast, at most; pairs that a partition gives, about.
BLOCK_ACTORS, BROADCAST_ACTORS, PART_PAIRS = 1000, 1_000_000, 20_000_000
#: Tasks of a block, at most, and rows of a table that are looked through for one block after the other.
BLOCK_TASKS, NEAR_ROWS = 256, 65_536
#: Dispatch order.
ORDER = (F.desc, "priority"), (F.asc, "created_at"), (F.asc, "run_id")


def dispatch_order() -> list[Column]:
    return [direction(name) for direction, name in ORDER]


# -- runs that a policy derives ------------------------------------------------------------------


def derive_once(tasks: DataFrame, now: Column) -> DataFrame:
    """A run at ``now`` for tasks without one (column ``already``)."""
    return tasks.where("policy = 'once' and already = 0").select("task_id", F.lit(0).cast("long").alias("run_index"), now.alias("scheduled_at"))


def derive_repeat(tasks: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Runs already..repeat_count-1 at origin + index * interval, with the task's columns ``keep``. Overflow raises, so no task is derived in part."""
    some = tasks.where((F.col("policy") == "repeat") & (F.col("already") < F.col("repeat_count")))
    return some.select("task_id", "origin", "interval_secs", *keep, F.explode(F.sequence(F.col("already"), F.col("repeat_count") - 1)).alias("run_index")).select(
        "task_id", "run_index", (F.col("origin") + F.col("run_index") * F.col("interval_secs")).alias("scheduled_at"), *keep
    )


def derive_cron(tasks: DataFrame) -> DataFrame:
    """Runs that keep WINDOW occurrences waiting, within max_occurrences, after the last scheduled one.

    Columns: waiting and total runs, last_scheduled_at (or null: from origin on) and canceled_at.
    """
    left = F.when(F.col("max_occurrences").isNull(), F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW).cast("long"), F.col("max_occurrences") - F.col("total") + F.col("waiting")))
    ready = tasks.where("policy = 'cron' and canceled_at is null").withColumns(
        {"n": (left - F.col("waiting")).cast("long"), "after": F.coalesce(F.col("last_scheduled_at"), F.col("origin") - 1)}
    )
    return with_occurrences(ready.where("n > 0")).select("task_id", "scheduled_at")


def derive_runs(tasks: DataFrame, now: Column) -> DataFrame:
    """All policies together."""
    cron = derive_cron(tasks).select("task_id", F.lit(None).cast("long").alias("run_index"), "scheduled_at")
    return derive_once(tasks, now).unionByName(derive_repeat(tasks)).unionByName(cron)


# -- promotion --------------------------------------------------------------------------------


def promote_due(runs: DataFrame, now: Column) -> DataFrame:
    """Scheduled runs that become Ready: all that are due, however late."""
    return runs.where((F.col("state") == "Scheduled") & is_due(F.col("scheduled_at"), now))


def promote_retries(runs: DataFrame, now: Column, base_ms: int, max_ms: int) -> DataFrame:
    """Waiting runs whose backoff is over, with ready_at."""
    delay = exponential_backoff_ms(F.greatest(F.col("attempt_count"), F.lit(1)), base_ms, max_ms)
    ready_at = retry_ready_at(F.col("last_state_change_at"), delay)
    return runs.where("state = 'RetryWait'").withColumn("ready_at", ready_at).where(F.col("ready_at") <= now)


def promote_triggered(runs: DataFrame, subscriptions: DataFrame, eligible: DataFrame) -> DataFrame:
    """Scheduled runs of tasks with a triggered subscription, due or not; dependencies still hold them back."""
    triggered = subscriptions.where("triggered_at is not null and canceled_at is null").select("task_id").distinct()
    return runs.where("state = 'Scheduled'").join(triggered, "task_id", "left_semi").join(eligible.select("task_id"), "task_id", "left_semi")


# -- admission ---------------------------------------------------------------------------------


def held_keys(changes: DataFrame, runs: DataFrame, tasks: DataFrame) -> DataFrame:
    """(concurrency_key, run_id) of keys that runs hold.

    A run takes its key on entering Running and gives it back on leaving, except into RetryWait
    or Suspended under HoldDuringRetry; a suspended run that ends gives it back.
    """
    keyed = runs.select("run_id", "task_id").join(tasks.where("concurrency_key is not null").select("task_id", "concurrency_key", "hold_policy"), "task_id")
    w = Window.partitionBy("run_id").orderBy("sequence")
    step = changes.withColumn("from", F.lag("new_state").over(w)).join(keyed, "run_id")
    hold = F.coalesce(F.col("hold_policy"), F.lit("HoldDuringRetry")) == "HoldDuringRetry"
    effect = (
        F.when(F.col("new_state") == "Running", True)
        .when((F.col("from") == "Running") & F.col("new_state").isin("RetryWait", "Suspended"), F.when(~hold, False))
        .when(F.col("from") == "Running", False)
        .when((F.col("from") == "Suspended") & is_terminal(F.col("new_state")), False)
    )
    return step.withColumn("held", effect).where("held is not null").groupBy("concurrency_key", "run_id").agg(F.max_by("held", "sequence").alias("held")).where("held").drop("held")


def admissible(candidates: DataFrame, exhausted: DataFrame, held: DataFrame, slots: int) -> DataFrame:
    """Runs to dispatch: budget gate, then one run per free key, then the first ``slots`` in dispatch order.

    Candidates have run_id, task_id, priority, created_at and concurrency_key. A run whose task
    has an exhausted budget takes no key. The holder of a key may have it again. Runs without a
    key do not limit each other.
    """
    funded = candidates.join(exhausted.select("task_id").distinct(), "task_id", "left_anti")
    other = held.select(F.col("concurrency_key").alias("_key"), F.col("run_id").alias("_holder"))
    blocked = funded.join(other, (F.col("concurrency_key") == F.col("_key")) & (F.col("run_id") != F.col("_holder")), "left_anti")
    w = Window.partitionBy("concurrency_key").orderBy(*dispatch_order())
    first = blocked.where("concurrency_key is not null").withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")
    return first.unionByName(blocked.where("concurrency_key is null")).orderBy(*dispatch_order()).limit(slots)


def acquire_lease(requests: DataFrame, runs: DataFrame, leases: DataFrame) -> DataFrame:
    """Outcome of each request (run_id, owner): WrongState, AlreadyLeased or Acquired."""
    known = requests.join(runs.select("run_id", "state"), "run_id", "left").join(leases.select("run_id", F.col("owner").alias("_owner")), "run_id", "left")
    return known.withColumn("outcome", F.when(F.col("_owner").isNotNull(), "AlreadyLeased").when(F.coalesce(F.col("state") != "Ready", F.lit(True)), "WrongState").otherwise("Acquired")).drop("_owner")


def expired_leases(leases: DataFrame, now: Column) -> DataFrame:
    return leases.where(lease_expired(F.col("expiry"), now))


def renewals(leases: DataFrame, now: Column, timeout: int = 300) -> DataFrame:
    """Leases to renew, with their new expiry."""
    return leases.where(lease_renewal_due(F.col("expiry"), now, timeout)).withColumn("new_expiry", saturating_add(now, F.lit(timeout).cast("long")))


def timed_out_actors(actors: DataFrame, now: Column, multiplier: int = 3) -> DataFrame:
    last = F.coalesce(F.col("last_heartbeat_at"), F.col("registered_at"))
    return actors.where("deregistered_at is null").where(heartbeat_timed_out(last, F.col("heartbeat_interval_secs"), now, multiplier))


def _in_blocks(rows: DataFrame, key: str, ids: str, most: int, name: str) -> DataFrame:
    """Rows of ``key``, ``block`` and ``members``: up to ``most`` ids of one key, from rows that are near each other, however many rows have it."""
    near = rows.withColumn("_near", F.floor(F.monotonically_increasing_id() / NEAR_ROWS))
    lists = near.groupBy(key, "_near").agg(F.collect_list(F.struct(ids)).alias("_all")).select(key, F.col("_all")[ids].alias("_ids"))
    first = F.sequence(F.lit(1), F.size("_ids"), F.lit(most))
    cut = lists.select(key, F.explode(F.transform(first, lambda i: F.slice("_ids", i, most))).alias("members"))
    return materialize(cut.withColumn("block", F.monotonically_increasing_id()), name)


def eligible_actors(requirements: DataFrame, actors: DataFrame) -> DataFrame:
    """(task_id, actor_id) of active actors that offer all that a task requires.

    Distinct sets of required capabilities are matched with distinct sets of offered ones, by an
    equi-join on the capability and a count. An empty requirement is met by every set. Tasks and
    actors of one set come in blocks: a block of tasks meets blocks of actors, and both are taken
    apart where they are joined, so only one row per two blocks is moved. These rows are dealt evenly
    over so many partitions that each gives some PART_PAIRS pairs, however many tasks share a set.

    All pairs are given, so the order in which they come decides how large they are as a file: an actor
    comes with all tasks of a block, then the next with the same ones. That is a run in one column and
    a short repeated sequence in the other, and blocks of the same tasks stay together.
    """
    none = F.array().cast("array<string>")
    as_set = lambda c: F.array_sort(F.array_distinct(F.coalesce(c, none)))
    active = materialize(actors.where("deregistered_at is null").select("actor_id", as_set("capabilities").alias("offered")), "actors")
    needs = materialize(requirements.select("task_id", as_set("required_capabilities").alias("needed")), "requirements")
    needed, offered = needs.groupBy("needed").agg(F.count(F.lit(1)).alias("tasks")), active.groupBy("offered").agg(F.count(F.lit(1)).alias("actors"))
    matched = (
        needed.select("needed", F.explode("needed").alias("capability")).join(offered.select("offered", F.explode("offered").alias("capability")), "capability")
        .groupBy("needed", "offered").agg(F.count(F.lit(1)).alias("met")).where(F.col("met") == F.size("needed")).select("needed", "offered")
    )
    free = offered.select(none.alias("needed"), "offered")
    sets = materialize(matched.unionByName(free).join(needed, "needed").join(offered, "offered"), "sets")
    pairs = sets.agg(F.sum(F.col("tasks").cast("decimal(38,0)") * F.col("actors"))).first()[0]
    parts = max(int(needs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(pairs or 0) // PART_PAIRS)
    groups = _in_blocks(needs, "needed", "task_id", BLOCK_TASKS, "task_blocks").withColumnsRenamed({"members": "_tasks", "block": "_group"})
    blocks = _in_blocks(active, "offered", "actor_id", BLOCK_ACTORS, "blocks")
    met = groups.join(F.broadcast(sets.select("needed", "offered")), "needed").join(F.broadcast(blocks.select("offered", "block")), "offered")
    dealt = lambda units: units.repartitionByRange(parts, "_group", "block")
    of, members = met.select("_tasks", "_group", "block"), blocks.select("block", "members")
    joined = dealt(of).join(F.broadcast(members), "block") if active.count() <= BROADCAST_ACTORS else dealt(of.join(members, "block"))
    # Each generated loop keeps what it makes of one row; cut in two by coalesce, that is a block's tasks, not two blocks' pairs.
    each = joined.select("_tasks", F.explode("members").alias("actor_id")).coalesce(2 * parts)
    return each.select(F.explode("_tasks").alias("task_id"), "actor_id")


def can_claim(pairs: DataFrame) -> DataFrame:
    """Pairs of a requirement and an actor (required_capabilities, capabilities) with ``matches``."""
    return pairs.withColumn("matches", capabilities_match(F.col("required_capabilities"), F.col("capabilities")))


# -- events and subscriptions ---------------------------------------------------------------------


def fired(subscriptions: DataFrame, events: DataFrame) -> DataFrame:
    """Active subscriptions that an event meets.

    Events have kind (TaskCompleted, RunStateChanged, BudgetThreshold, Custom), task_id, state,
    dimension, pct, key. Typed fields join by equality; the threshold is tested on what is left.
    """
    active = subscriptions.where("triggered_at is null and canceled_at is null")
    blank = lambda c: F.coalesce(c, F.lit(""))
    wanted = active.select(
        "subscription_id", F.col("filter.kind").alias("kind"), blank(F.col("filter.task_id")).alias("k_task"), blank(F.col("filter.state")).alias("k_state"),
        blank(F.col("filter.dimension")).alias("k_dimension"), blank(F.col("filter.key")).alias("k_key"), F.col("filter.threshold_pct").alias("least"),
    )
    told = events.select(
        "kind", blank(F.when(F.col("kind") != "Custom", F.col("task_id"))).alias("k_task"), blank(F.when(F.col("kind") == "RunStateChanged", F.col("state"))).alias("k_state"),
        blank(F.when(F.col("kind") == "BudgetThreshold", F.col("dimension"))).alias("k_dimension"), blank(F.when(F.col("kind") == "Custom", F.col("key"))).alias("k_key"), "pct",
    )
    met = wanted.join(told, ["kind", "k_task", "k_state", "k_dimension", "k_key"]).where((F.col("kind") != "BudgetThreshold") | (F.col("pct") >= F.col("least")))
    return met.select("subscription_id").distinct()


def fired_events(changes: DataFrame, runs: DataFrame, outcomes: DataFrame, crossings: DataFrame) -> DataFrame:
    """Events that changes of state, completed tasks and budgets give rise to."""
    none = F.lit(None).cast("string")
    state = changes.join(runs.select("run_id", "task_id"), "run_id").select(
        F.lit("RunStateChanged").alias("kind"), "task_id", F.col("new_state").alias("state"), none.alias("dimension"), F.lit(None).cast("long").alias("pct"), none.alias("key")
    )
    done = outcomes.where("all_terminal and any_completed").select(F.lit("TaskCompleted").alias("kind"), "task_id", none.alias("state"), none.alias("dimension"), F.lit(None).cast("long").alias("pct"), none.alias("key"))
    crossed = crossings.select(F.lit("BudgetThreshold").alias("kind"), "task_id", none.alias("state"), "dimension", F.col("pct").cast("long").alias("pct"), none.alias("key"))
    return state.unionByName(done).unionByName(crossed)


def budget_cancels(runs: DataFrame, budgets: DataFrame) -> DataFrame:
    """Runs in flight whose task has an exhausted budget."""
    return runs.where(F.col("state").isin("Leased", "Running")).join(budgets.where("exhausted").select("task_id").distinct(), "task_id", "left_semi")


def permissions(checks: DataFrame, roles: DataFrame, grants: DataFrame) -> DataFrame:
    """Checks (actor_id, tenant_id, capability) with outcome: NoRoleAssigned, MissingCapability or Allowed."""
    held = roles.select("actor_id", "tenant_id", F.lit(True).alias("_role"))
    given = grants.where("revoked_at is null").select("actor_id", "tenant_id", "capability", F.lit(True).alias("_grant"))
    out = checks.join(held, ["actor_id", "tenant_id"], "left").join(given, ["actor_id", "tenant_id", "capability"], "left")
    return out.withColumn("outcome", F.when(F.col("_role").isNull(), "NoRoleAssigned").when(F.col("_grant").isNull(), "MissingCapability").otherwise("Allowed")).drop("_role", "_grant")


def unless_paused(rows: DataFrame, control: DataFrame) -> DataFrame:
    """No rows while the engine is paused."""
    return rows.join(F.broadcast(control.where("paused")), how="left_anti", on=F.lit(True))
