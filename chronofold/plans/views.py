"""The workload's entities as views over the driver's tables.

Every derivation is integers and strings. Orders are tasks that repeat; each of their derived
runs is in a state that its number gives. Users of ``events`` are runs whose log is their
events; suppliers are actors, nations tenants.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronofold.model import STATES, epoch
from chronofold.operators import schedule

#: The instant of reports over orders, and of those over events.
NOW = 852_076_800
EVENT_NOW = 1_706_600_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _state(number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, STATES)), (number % len(STATES) + 1).cast("int"))


def tasks(spark: SparkSession, sf_dir: str, tenants: bool = True) -> DataFrame:
    """Orders as tasks; without ``tenants`` the customers are not read and tenant_id is left out."""
    orders = table(spark, sf_dir, "orders")
    if tenants:
        customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("tenant_id"))
        orders = orders.join(customers, "o_custkey", "left")
    key, created = F.col("o_orderkey"), epoch(F.col("o_orderdate"))
    return orders.select(
        key.alias("task_id"), created.alias("created_at"), created.alias("origin"), (5 - F.substring("o_orderpriority", 1, 1).cast("int")).alias("priority"),
        F.col("o_custkey").cast("string").alias("concurrency_key"), F.when(key % 2 == 0, "HoldDuringRetry").otherwise("ReleaseOnRetry").alias("hold_policy"),
        (1 + key % 4).alias("max_attempts"), F.lit("repeat").alias("policy"), (1 + key % 5).alias("repeat_count"), F.lit(3600).cast("long").alias("interval_secs"),
        (key % 2).alias("already"), F.when(key >= 2, (key - key % 2) / 2).cast("long").alias("parent_task_id"), *(["tenant_id"] if tenants else []),
        F.when(key % 50 == 0, created).alias("canceled_at"),
    )


def runs(spark: SparkSession, sf_dir: str, tenants: bool = True) -> DataFrame:
    """Derived runs of all tasks; ``tenants`` as for these."""
    task = tasks(spark, sf_dir, tenants)
    derived = schedule.derive_repeat(task.withColumn("already", F.lit(0).cast("long")), keep=("priority", "concurrency_key", "created_at", "max_attempts"))
    number = F.col("task_id") + F.col("run_index")
    return derived.select(
        (F.col("task_id") * 10 + F.col("run_index")).alias("run_id"), "task_id", _state(number).alias("state"), (number % 5).alias("attempt_count"), "created_at", "scheduled_at",
        "priority", "concurrency_key", "max_attempts", (F.col("scheduled_at") + 60 * (F.col("run_index") + 1)).alias("last_state_change_at"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order depends on the customer's order before."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    before = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"), F.lag("o_orderkey").over(w).alias("prereq_id"))
    return before.where("prereq_id is not null")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run events: a user's first event creates the run, others change its state; attempts, leases and budgets as well."""
    raw = table(spark, sf_dir, "events").select(
        (F.col("event_id") + 1).alias("sequence"), epoch(F.col("ts")).alias("ts"), F.col("user_id").alias("run_id"), "event_type", (F.round(F.col("value") * 100)).cast("long").alias("cents")
    )
    w = Window.partitionBy("run_id").orderBy("sequence")
    return raw.withColumns({"n": F.row_number().over(w), "next_type": F.lead("event_type").over(w), "next_sequence": F.lead("sequence").over(w), "next_ts": F.lead("ts").over(w)})


def state_events(raw: DataFrame) -> DataFrame:
    odd, kind = F.col("sequence") % 2 == 1, F.col("event_type")
    state = (
        F.when(kind == "view", "Ready").when(kind == "click", "Leased").when(kind == "purchase", F.when(odd, "Completed").otherwise("Running"))
        .when(kind == "signup", F.when(odd, "Suspended").otherwise("RetryWait")).otherwise(F.when(odd, "Canceled").otherwise("Failed"))
    )
    return raw.select(
        "sequence", F.when(F.col("n") == 1, "RunCreated").otherwise("RunStateChanged").alias("event_type"), "ts", "run_id", F.lit(None).cast("string").alias("prev_state"),
        F.when(F.col("n") > 1, state).alias("new_state"), F.col("run_id").alias("task_id"), F.lit(None).cast("long").alias("scheduled_at"),
    )


def attempt_events(raw: DataFrame) -> DataFrame:
    """A purchase starts an attempt; the user's next event, unless a purchase, finishes it."""
    bought = raw.where("event_type = 'purchase'")
    none = F.lit(None).cast("string")
    starts = bought.select("sequence", F.lit("AttemptStarted").alias("event_type"), "ts", "run_id", F.col("sequence").alias("attempt_id"), none.alias("result"), none.alias("error"), none.cast("binary").alias("output"))
    result = F.when(F.col("next_type") == "click", "Success").when(F.col("next_type") == "error", "Failure").when(F.col("next_type") == "view", "Timeout").otherwise("Suspended")
    ends = bought.where("next_type <> 'purchase'").select(
        F.col("next_sequence").alias("sequence"), F.lit("AttemptFinished").alias("event_type"), F.col("next_ts").alias("ts"), "run_id", F.col("sequence").alias("attempt_id"), result.alias("result"), none.alias("error"), none.cast("binary").alias("output")
    )
    return starts.unionByName(ends)


def budget_events(raw: DataFrame) -> DataFrame:
    """Signups allocate (odd) or replenish 5000 + 10 * user, purchases consume cents."""
    kind = F.when(F.col("event_type") == "purchase", "BudgetConsumed").otherwise(F.when(F.col("sequence") % 2 == 1, "BudgetAllocated").otherwise("BudgetReplenished"))
    amount = F.when(F.col("event_type") == "purchase", F.col("cents")).otherwise(5000 + 10 * F.col("run_id"))
    return raw.where(F.col("event_type").isin("purchase", "signup")).select("sequence", kind.alias("event_type"), "ts", F.col("run_id").alias("task_id"), F.lit("Cost").alias("dimension"), amount.alias("amount"))


def lease_events(raw: DataFrame) -> DataFrame:
    """Views acquire, clicks renew, errors release; an expiry is 300 seconds on."""
    kind = F.when(F.col("event_type") == "view", "LeaseAcquired").when(F.col("event_type") == "click", "LeaseHeartbeat").otherwise("LeaseReleased")
    return raw.where(F.col("event_type").isin("view", "click", "error")).select("sequence", kind.alias("event_type"), "ts", "run_id", (F.col("run_id") % 7).alias("owner"), (F.col("ts") + 300).alias("expiry"))


def actor_events(raw: DataFrame) -> DataFrame:
    """Signups register a user as an actor, views are heartbeats, odd errors deregister."""
    kind = F.when(F.col("event_type") == "signup", "ActorRegistered").when(F.col("event_type") == "view", "ActorHeartbeat").otherwise("ActorDeregistered")
    some = raw.where((F.col("event_type").isin("signup", "view")) | ((F.col("event_type") == "error") & (F.col("sequence") % 2 == 1)))
    return some.select(
        "sequence", kind.alias("event_type"), "ts", F.col("run_id").alias("actor_id"), F.concat(F.lit("user-"), "run_id").alias("identity"), F.array(F.lit("compute")).alias("capabilities"),
        (F.col("run_id") % 5).cast("string").alias("department"), F.lit(3600).cast("long").alias("heartbeat_interval_secs"), (F.col("run_id") % 25).alias("tenant_id"),
    )


CAPABILITIES = ("compute", "review", "storage", "network")


def actors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers; bit k of the key offers capability k, every tenth has left."""
    key = F.col("s_suppkey")
    offered = F.array_compact(F.array(*[F.when(F.floor(key / (1 << k)) % 2 == 1, c) for k, c in enumerate(CAPABILITIES)]))
    return table(spark, sf_dir, "supplier").select(
        key.alias("actor_id"), offered.alias("capabilities"), F.col("s_nationkey").cast("long").alias("tenant_id"), F.when(key % 10 == 0, F.lit(NOW)).cast("long").alias("deregistered_at")
    )


def requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts; bit k of the size requires capability k."""
    size = F.col("p_size").cast("long")
    needed = F.array_compact(F.array(*[F.when(F.floor(size / (1 << k)) % 2 == 1, c) for k, c in enumerate(CAPABILITIES)]))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("task_id"), needed.alias("required_capabilities"))


def platform_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Role assignments and capability grants of customers by their orders."""
    o = tasks(spark, sf_dir).select(F.col("task_id").alias("sequence"), F.col("created_at").alias("ts"), F.col("concurrency_key").alias("actor_id"), "tenant_id", F.col("task_id").alias("k"))
    k = F.col("k") % 5
    kind = F.when(k == 0, "RoleAssigned").when(k == 4, "CapabilityRevoked").otherwise("CapabilityGranted")
    return o.select(
        "sequence", kind.alias("event_type"), "ts", "actor_id", "tenant_id", F.concat(F.lit("role-"), (F.col("k") % 3).cast("string")).alias("role"),
        F.when(F.col("k") % 2 == 0, "CanSubmit").otherwise("CanCancel").alias("capability"),
    )
