"""Registered queries of the workload model, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.functions import lifecycle as L
from chronofold.operators import fold, graph, report, schedule, validate
from chronofold.plans import views
from chronofold.plans.views import EVENT_NOW, NOW
from chronofold.streaming import runs as streaming

QUERIES = {}
ORACLE_SQL = {}

# The SQL writes states, transitions and bounds out, so that it does not repeat what the library has.
_TEXT = "'Scheduled', 'Ready', 'Leased', 'Running', 'RetryWait', 'Suspended', 'Completed', 'Failed', 'Canceled'"
_REPORTED = ["Scheduled", "Ready", "Leased", "Running", "RetryWait", "Completed", "Failed", "Canceled"]
_TERMINAL = "('Completed', 'Failed', 'Canceled')"
_LEGAL = (
    "'Scheduled>Ready', 'Scheduled>Canceled', 'Ready>Leased', 'Ready>Canceled', 'Leased>Ready', 'Leased>Running', 'Leased>Canceled', "
    "'Running>RetryWait', 'Running>Suspended', 'Running>Completed', 'Running>Failed', 'Running>Canceled', "
    "'RetryWait>Ready', 'RetryWait>Failed', 'RetryWait>Canceled', 'Suspended>Ready', 'Suspended>Canceled'"
)

#: Common table expressions over the driver's tables, as the views in plans.views.
_CTES = {
    "t": """t AS (SELECT o_orderkey AS task_id, date_diff('second', TIMESTAMP '1970-01-01', o_orderdate) AS created_at,
        5 - CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority, CAST(o_custkey AS VARCHAR) AS concurrency_key,
        CASE WHEN o_orderkey % 2 = 0 THEN 'HoldDuringRetry' ELSE 'ReleaseOnRetry' END AS hold_policy, 1 + o_orderkey % 4 AS max_attempts,
        1 + o_orderkey % 5 AS repeat_count, o_orderkey % 2 AS already, CASE WHEN o_orderkey >= 2 THEN o_orderkey // 2 END AS parent_task_id,
        CAST(c_nationkey AS BIGINT) AS tenant_id FROM orders LEFT JOIN customer ON o_custkey = c_custkey)""",
    "r": f"""r AS (SELECT task_id * 10 + i AS run_id, task_id, list_extract([{_TEXT}], CAST((task_id + i) % 9 + 1 AS INT)) AS state, (task_id + i) % 5 AS attempt_count,
        created_at, created_at + i * 3600 AS scheduled_at, priority, concurrency_key, max_attempts, created_at + i * 3600 + 60 * (i + 1) AS last_state_change_at, i AS run_index
        FROM t, range(0, 5) x(i) WHERE i < repeat_count)""",
    "e": """e AS (SELECT event_id + 1 AS sequence, date_diff('second', TIMESTAMP '1970-01-01', ts) AS ts, user_id AS run_id, event_type, CAST(round(value * 100) AS BIGINT) AS cents,
        row_number() OVER w AS n, lead(event_type) OVER w AS next_type, lead(event_id + 1) OVER w AS next_sequence, lead(date_diff('second', TIMESTAMP '1970-01-01', ts)) OVER w AS next_ts
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))""",
    "c": """c AS (SELECT sequence, run_id, ts, CASE WHEN n = 1 THEN 'Scheduled' WHEN event_type = 'view' THEN 'Ready' WHEN event_type = 'click' THEN 'Leased'
        WHEN event_type = 'purchase' THEN CASE WHEN sequence % 2 = 1 THEN 'Completed' ELSE 'Running' END
        WHEN event_type = 'signup' THEN CASE WHEN sequence % 2 = 1 THEN 'Suspended' ELSE 'RetryWait' END
        ELSE CASE WHEN sequence % 2 = 1 THEN 'Canceled' ELSE 'Failed' END END AS new_state FROM e)""",
    "k": f"""k AS (SELECT *, CASE WHEN current_state IS NULL OR current_state || '>' || new_state IN ({_LEGAL}) THEN NULL ELSE 'illegal' END AS violation
        FROM (SELECT *, lag(new_state) OVER (PARTITION BY run_id ORDER BY sequence) AS current_state FROM c))""",
    "a": """a AS (SELECT run_id, sequence AS attempt_id, ts AS started_at, CASE WHEN next_type <> 'purchase' THEN next_ts END AS finished_at,
        CASE WHEN next_type = 'click' THEN 'Success' WHEN next_type = 'error' THEN 'Failure' WHEN next_type = 'view' THEN 'Timeout' WHEN next_type = 'signup' THEN 'Suspended' END AS result
        FROM e WHERE event_type = 'purchase')""",
    "b": """b AS (SELECT *, sum(reset) OVER (PARTITION BY task_id ORDER BY sequence) AS epoch FROM (SELECT *, max(CASE WHEN kind = 'A' THEN 1 ELSE 0 END) OVER (PARTITION BY task_id ORDER BY sequence) AS known FROM (
        SELECT sequence, ts, run_id AS task_id, CASE WHEN event_type = 'purchase' THEN 'C' WHEN sequence % 2 = 1 THEN 'A' ELSE 'R' END AS kind,
        CASE WHEN event_type = 'purchase' THEN cents ELSE 5000 + 10 * run_id END AS amount, CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END AS reset
        FROM e WHERE event_type IN ('purchase', 'signup'))) WHERE known = 1)""",
    "bud": """bud AS (SELECT task_id, arg_min(amount, sequence) AS lim, CAST(coalesce(sum(CASE WHEN kind = 'C' THEN amount END), 0) AS BIGINT) AS consumed FROM b
        WHERE epoch = (SELECT max(epoch) FROM b b2 WHERE b2.task_id = b.task_id) GROUP BY task_id)""",
    "held": f"""held AS (SELECT x.run_id, arg_max(x.run_id % 7, x.sequence) AS owner, arg_max(x.ts + 300, x.sequence) AS expiry,
        arg_max(x.ts, x.sequence) FILTER (event_type = 'view') AS acquired_at, arg_max(x.ts, x.sequence) AS updated_at
        FROM e x LEFT JOIN (SELECT run_id, max(sequence) AS ended FROM c WHERE new_state IN {_TERMINAL} GROUP BY run_id) z ON z.run_id = x.run_id
        WHERE event_type IN ('view', 'click', 'error') GROUP BY x.run_id
        HAVING arg_max(event_type, x.sequence) <> 'error' AND coalesce(max(ended) < max(x.sequence), true))""",
    "d": "d AS (SELECT * FROM (SELECT o_orderkey AS task_id, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prereq_id FROM orders) WHERE prereq_id IS NOT NULL)",
    "o": f"o AS (SELECT task_id, bool_and(state IN {_TERMINAL}) AS all_terminal, bool_or(state = 'Completed') AS any_completed FROM r GROUP BY task_id)",
}
_NEEDS = {"r": "t", "c": "e", "k": "c", "a": "e", "b": "e", "bud": "b", "o": "r", "held": "c"}


def _with(*names: str) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        if name in _NEEDS:
            add(_NEEDS[name])
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    return "WITH RECURSIVE " + ", ".join(_CTES[n] for n in order)


def _query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return keep


def _log(spark: SparkSession, sf: str) -> DataFrame:
    return views.log(spark, sf)


def _changes(spark: SparkSession, sf: str) -> DataFrame:
    return fold.transitions(views.state_events(_log(spark, sf)))


def _event_runs(spark: SparkSession, sf: str) -> DataFrame:
    raw = _log(spark, sf)
    states, tried = views.state_events(raw), views.attempt_events(raw)
    return fold.runs(states.unionByName(tried, allowMissingColumns=True))


def _budgets(spark: SparkSession, sf: str) -> DataFrame:
    return fold.budgets(views.budget_events(_log(spark, sf)))


# -- fold ----------------------------------------------------------------------------------------


@_query("runs_by_state", f"{_with('c')} SELECT s.state, count(l.run_id) AS runs_total FROM (SELECT unnest([{', '.join(map(repr, _REPORTED))}]) AS state) s LEFT JOIN (SELECT run_id, arg_max(new_state, sequence) AS state FROM c GROUP BY run_id) l USING (state) GROUP BY s.state")
def _(spark, sf):
    return report.runs_by_state(_event_runs(spark, sf))


@_query(
    "stats",
    f"{_with('c', 'a')}, l AS (SELECT run_id, arg_max(new_state, sequence) AS state FROM c GROUP BY run_id) "
    "SELECT (SELECT count(*) FROM orders) AS total_tasks, (SELECT count(*) FROM l) AS total_runs, (SELECT count(*) FROM a) AS attempts_total, "
    "(SELECT count(*) FROM l WHERE state = 'Scheduled') AS scheduled, (SELECT count(*) FROM l WHERE state = 'Ready') AS ready, (SELECT count(*) FROM l WHERE state = 'Leased') AS leased, "
    "(SELECT count(*) FROM l WHERE state = 'Running') AS running, (SELECT count(*) FROM l WHERE state = 'RetryWait') AS retry_wait, (SELECT count(*) FROM l WHERE state = 'Completed') AS completed, "
    "(SELECT count(*) FROM l WHERE state = 'Failed') AS failed, (SELECT count(*) FROM l WHERE state = 'Canceled') AS canceled"
    ", (SELECT max(event_id) + 1 FROM events) AS latest_sequence",
)
def _(spark, sf):
    return report.stats(views.tasks(spark, sf), _event_runs(spark, sf), _log(spark, sf))


@_query("run_table", f"{_with('c', 'a')} SELECT x.*, coalesce(y.attempt_count, 0) AS attempt_count, y.current_attempt_id FROM (SELECT run_id, run_id AS task_id, min(ts) AS created_at, min(ts) AS scheduled_at, arg_max(new_state, sequence) AS state, arg_max(ts, sequence) AS last_state_change_at, 0 AS effective_priority FROM c GROUP BY run_id) x LEFT JOIN (SELECT run_id, count(*) AS attempt_count, CASE WHEN arg_max(coalesce(finished_at, -1), attempt_id) = -1 THEN max(attempt_id) END AS current_attempt_id FROM a GROUP BY run_id) y USING (run_id)")
def _(spark, sf):
    runs = _event_runs(spark, sf)
    return runs


@_query("transition_violations", f"{_with('k')} SELECT sequence, run_id, current_state, new_state, violation FROM k WHERE violation IS NOT NULL")
def _(spark, sf):
    return fold.checked_transitions(_changes(spark, sf)).where("violation is not null").select("sequence", "run_id", "current_state", "new_state", "violation")


@_query("strict_replay", f"{_with('k')} SELECT sequence, run_id, new_state FROM k WHERE sequence < (SELECT coalesce(min(sequence), 1000000000000) FROM k WHERE violation IS NOT NULL)")
def _(spark, sf):
    return fold.strict_prefix(fold.checked_transitions(_changes(spark, sf))).select("sequence", "run_id", "new_state")


@_query("quarantined_states", f"{_with('k')} SELECT run_id, arg_max(new_state, sequence) AS state, count(*) AS n FROM k WHERE sequence < coalesce((SELECT min(k2.sequence) FROM k k2 WHERE k2.run_id = k.run_id AND k2.violation IS NOT NULL), 1000000000000) GROUP BY run_id")
def _(spark, sf):
    kept = fold.quarantine(fold.checked_transitions(_changes(spark, sf)))
    return kept.groupBy("run_id").agg(F.max_by("new_state", "sequence").alias("state"), F.count(F.lit(1)).alias("n"))


@_query("state_history", f"{_with('k')} SELECT run_id, sequence, current_state AS from_state, new_state AS to_state, ts FROM k")
def _(spark, sf):
    return fold.history(_changes(spark, sf))


@_query("duplicate_sequences", "SELECT event_id + 1 AS sequence, user_id AS run_id FROM events WHERE event_id IN (SELECT event_id FROM events GROUP BY event_id HAVING count(*) > 1)")
def _(spark, sf):
    return fold.out_of_sequence(_log(spark, sf)).select("sequence", "run_id")


@_query("attempts", f"{_with('a')} SELECT run_id, attempt_id, started_at, finished_at, result FROM a")
def _(spark, sf):
    return fold.attempts(views.attempt_events(_log(spark, sf))).select("run_id", "attempt_id", "started_at", "finished_at", "result")


@_query("attempts_by_result", f"{_with('a')} SELECT s.result, count(a.run_id) AS attempts_total FROM (SELECT unnest(['Success', 'Failure', 'Timeout']) AS result) s LEFT JOIN a USING (result) GROUP BY s.result")
def _(spark, sf):
    return report.attempts_by_result(fold.attempts(views.attempt_events(_log(spark, sf))))


@_query("trimmed_history", f"{_with('c')} SELECT run_id, count(*) AS n FROM c WHERE run_id NOT IN (SELECT run_id FROM (SELECT run_id, arg_max(new_state, sequence) AS s FROM c GROUP BY run_id) WHERE s IN {_TERMINAL}) GROUP BY run_id")
def _(spark, sf):
    return fold.trim_terminal(fold.history(_changes(spark, sf)), _event_runs(spark, sf)).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))


@_query("leases", f"{_with('held')} SELECT * FROM held")
def _(spark, sf):
    raw = _log(spark, sf)
    return fold.leases(views.lease_events(raw), _changes(spark, sf))


@_query("expired_and_renewable_leases", f"{_with('held')} SELECT run_id, expiry <= {EVENT_NOW} AS expired, {EVENT_NOW} + 100 >= expiry AS renew FROM held")
def _(spark, sf):
    raw, now = _log(spark, sf), F.lit(EVENT_NOW).cast("long")
    held = fold.leases(views.lease_events(raw), _changes(spark, sf))
    return held.select("run_id", L.lease_expired(F.col("expiry"), now).alias("expired"), L.lease_renewal_due(F.col("expiry"), now, 300).alias("renew"))


@_query("engine_control", "SELECT arg_max(event_type, event_id) = 'signup' AS paused, arg_max(epoch(ts)::BIGINT, event_id) FILTER (event_type = 'signup') AS paused_at, CASE WHEN arg_max(event_type, event_id) = 'error' THEN arg_max(epoch(ts)::BIGINT, event_id) FILTER (event_type = 'error') END AS resumed_at FROM (SELECT event_id, event_type, date_trunc('second', ts) AS ts FROM events WHERE event_type IN ('signup', 'error'))")
def _(spark, sf):
    raw = _log(spark, sf).where("event_type in ('signup', 'error')")
    return fold.engine_control(raw.withColumn("event_type", F.when(F.col("event_type") == "signup", "EnginePaused").otherwise("EngineResumed")))


# -- budgets, subscriptions, actors ------------------------------------------------------------------


@_query("budgets", f"{_with('bud')} SELECT task_id, 'Cost' AS dimension, lim AS \"limit\", consumed, consumed >= lim AS exhausted, (SELECT arg_max(b.ts, b.sequence) FROM b WHERE b.task_id = bud.task_id AND b.kind = 'A') AS allocated_at FROM bud")
def _(spark, sf):
    return _budgets(spark, sf)


@_query("budget_thresholds", f"{_with('bud')} SELECT task_id, greatest(lim - consumed, 0) AS remaining, least(consumed, lim) * 100 // lim AS pct, least(consumed, lim) * 100 // lim >= 80 AS crossed FROM bud")
def _(spark, sf):
    pct = L.threshold_pct(F.col("consumed"), F.col("limit"))
    return _budgets(spark, sf).select("task_id", L.budget_remaining(F.col("consumed"), F.col("limit")).alias("remaining"), pct.alias("pct"), (pct >= 80).alias("crossed"))


@_query("budget_crossings", f"{_with('bud')} SELECT task_id, 'Cost' AS dimension, least(consumed, lim) * 100 // lim AS pct FROM bud WHERE least(consumed, lim) * 100 // lim >= 50")
def _(spark, sf):
    return report.budget_crossings(_budgets(spark, sf), 50).select("task_id", "dimension", "pct")


@_query("budget_cancels", f"{_with('bud', 'c')} SELECT run_id FROM (SELECT run_id, arg_max(new_state, sequence) AS s FROM c GROUP BY run_id) WHERE s IN ('Leased', 'Running') AND run_id IN (SELECT task_id FROM bud WHERE consumed >= lim)")
def _(spark, sf):
    return schedule.budget_cancels(_event_runs(spark, sf), _budgets(spark, sf)).select("run_id")


_SUBS = """s AS (SELECT c_custkey AS subscription_id, c_custkey % 4 AS kind, c_custkey % 150 AS task_id, c_custkey % 101 AS pct, c_custkey % 7 = 0 AS gone FROM customer)"""


def _subscriptions(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as subscriptions of the four kinds; every seventh is canceled."""
    key = F.col("c_custkey")
    kind = F.element_at(F.array(*map(F.lit, ("TaskCompleted", "RunStateChanged", "BudgetThreshold", "Custom"))), (key % 4 + 1).cast("int"))
    wanted = F.struct(
        kind.alias("kind"), (key % 150).cast("string").alias("task_id"), F.lit("Failed").alias("state"), F.lit("Cost").alias("dimension"), (key % 101).cast("int").alias("threshold_pct"), (key % 3).cast("string").alias("key")
    )
    wanted = F.when(kind == "Custom", F.struct(kind.alias("kind"), F.lit(None).cast("string").alias("task_id"), F.lit(None).cast("string").alias("state"), F.lit(None).cast("string").alias("dimension"), F.lit(None).cast("int").alias("threshold_pct"), (key % 3).cast("string").alias("key"))).otherwise(
        F.struct(
            kind.alias("kind"), wanted["task_id"].alias("task_id"), F.when(kind == "RunStateChanged", "Failed").alias("state"), F.when(kind == "BudgetThreshold", "Cost").alias("dimension"),
            F.when(kind == "BudgetThreshold", wanted["threshold_pct"]).alias("threshold_pct"), F.lit(None).cast("string").alias("key"),
        )
    )
    made = F.lit(0).cast("long")
    return views.table(spark, sf, "customer").select(
        key.alias("subscription_id"), (key % 150).alias("task_id"), wanted.alias("filter"), made.alias("created_at"), F.lit(None).cast("long").alias("triggered_at"), F.when(key % 7 == 0, made).alias("canceled_at")
    )


@_query("fired_subscriptions", f"{_with('c', 'bud')}, {_SUBS}, l AS (SELECT run_id, arg_max(new_state, sequence) AS state FROM c GROUP BY run_id) SELECT subscription_id FROM s WHERE NOT gone AND ((kind = 0 AND task_id IN (SELECT run_id FROM l WHERE state = 'Completed')) OR (kind = 1 AND task_id IN (SELECT run_id FROM c WHERE new_state = 'Failed')) OR (kind = 2 AND EXISTS (SELECT 1 FROM bud WHERE bud.task_id = s.task_id AND least(consumed, lim) * 100 // lim >= greatest(s.pct, 10))) OR (kind = 3 AND subscription_id % 3 = 1))")
def _(spark, sf):
    runs, raw = _event_runs(spark, sf), _changes(spark, sf)
    crossings = report.budget_crossings(_budgets(spark, sf), 10)
    told = schedule.fired_events(raw, runs, report.task_outcomes(runs), crossings).withColumn("task_id", F.col("task_id").cast("string"))
    custom = spark.createDataFrame([("Custom", None, None, None, None, "1")], told.schema)
    return schedule.fired(_subscriptions(spark, sf), told.unionByName(custom))


@_query("actors", f"{_with('e')}, x AS (SELECT sequence, ts, run_id AS actor_id, CASE WHEN event_type = 'signup' THEN 'R' WHEN event_type = 'view' THEN 'H' ELSE 'D' END AS kind FROM e WHERE event_type IN ('signup', 'view') OR (event_type = 'error' AND sequence % 2 = 1)), y AS (SELECT *, max(CASE WHEN kind = 'R' THEN sequence END) OVER (PARTITION BY actor_id) AS begin FROM x) SELECT actor_id, arg_max(ts, sequence) FILTER (kind = 'R') AS registered_at, coalesce(arg_max(ts, sequence) FILTER (kind = 'H'), arg_max(ts, sequence) FILTER (kind = 'R')) AS last_heartbeat_at, arg_max(ts, sequence) FILTER (kind = 'D') AS deregistered_at FROM y WHERE sequence >= begin GROUP BY actor_id")
def _(spark, sf):
    return fold.actors(views.actor_events(_log(spark, sf))).select("actor_id", "registered_at", "last_heartbeat_at", "deregistered_at")


@_query("timed_out_actors", f"{_with('e')}, x AS (SELECT sequence, ts, run_id AS actor_id, CASE WHEN event_type = 'signup' THEN 'R' WHEN event_type = 'view' THEN 'H' ELSE 'D' END AS kind FROM e WHERE event_type IN ('signup', 'view') OR (event_type = 'error' AND sequence % 2 = 1)), y AS (SELECT *, max(CASE WHEN kind = 'R' THEN sequence END) OVER (PARTITION BY actor_id) AS begin FROM x) SELECT actor_id FROM (SELECT actor_id, coalesce(arg_max(ts, sequence) FILTER (kind = 'H'), arg_max(ts, sequence) FILTER (kind = 'R')) AS last, arg_max(ts, sequence) FILTER (kind = 'D') AS gone FROM y WHERE sequence >= begin GROUP BY actor_id) WHERE gone IS NULL AND {EVENT_NOW} >= last + 3 * 3600")
def _(spark, sf):
    return schedule.timed_out_actors(fold.actors(views.actor_events(_log(spark, sf))), F.lit(EVENT_NOW).cast("long")).select("actor_id")


@_query("eligible_actors", "SELECT p_partkey AS task_id, s_suppkey AS actor_id FROM part, supplier WHERE s_suppkey % 10 <> 0 AND ((p_size % 16) & s_suppkey) = p_size % 16")
def _(spark, sf):
    return schedule.eligible_actors(views.requirements(spark, sf), views.actors(spark, sf))


# -- policies, promotion, admission -------------------------------------------------------------------


@_query("derived_repeat_runs", f"{_with('t')} SELECT task_id, i AS run_index, created_at + i * 3600 AS scheduled_at FROM t, range(0, 5) x(i) WHERE i >= already AND i < repeat_count")
def _(spark, sf):
    return schedule.derive_repeat(views.tasks(spark, sf))


@_query("derived_once_runs", f"{_with('t')} SELECT task_id, CAST(0 AS BIGINT) AS run_index, CAST({NOW} AS BIGINT) AS scheduled_at FROM t WHERE task_id % 3 = 0 AND already = 0")
def _(spark, sf):
    once = views.tasks(spark, sf).withColumn("policy", F.when(F.col("task_id") % 3 == 0, "once").otherwise("repeat"))
    return schedule.derive_once(once, F.lit(NOW).cast("long"))


@_query("derived_cron_runs", f"{_with('t')}, w AS (SELECT task_id, created_at - 1 AS after, least(5, 1 + task_id % 7) AS n FROM t WHERE task_id % 50 <> 0) SELECT task_id, (after // 900 + 1 + i) * 900 AS scheduled_at FROM w, range(0, 5) x(i) WHERE i < n")
def _(spark, sf):
    cron = views.tasks(spark, sf).withColumns({
        "policy": F.lit("cron"), "cron_expr": F.lit("0 */15 * * * * *"), "max_occurrences": 1 + F.col("task_id") % 7, "waiting": F.lit(0).cast("long"), "total": F.lit(0).cast("long"), "last_scheduled_at": F.lit(None).cast("long"),
    })
    return schedule.derive_cron(cron)


@_query("due_runs", f"{_with('r')} SELECT run_id, scheduled_at FROM r WHERE state = 'Scheduled' AND scheduled_at <= {NOW}")
def _(spark, sf):
    return schedule.promote_due(views.runs(spark, sf), F.lit(NOW)).select("run_id", "scheduled_at")


@_query("retry_promotions", f"{_with('r')}, x AS (SELECT run_id, last_state_change_at + CAST(ceil(least(1500 * power(2, greatest(attempt_count, 1) - 1), 10000) / 1000.0) AS BIGINT) AS ready_at FROM r WHERE state = 'RetryWait') SELECT run_id, ready_at FROM x WHERE ready_at <= {NOW}")
def _(spark, sf):
    return schedule.promote_retries(views.runs(spark, sf), F.lit(NOW), 1500, 10_000).select("run_id", "ready_at")


@_query("dispatch_order_top", f"{_with('r')} SELECT run_id, priority, created_at FROM r WHERE state = 'Ready' ORDER BY priority DESC, created_at, run_id LIMIT 100")
def _(spark, sf):
    return views.runs(spark, sf).where("state = 'Ready'").orderBy(*schedule.dispatch_order()).limit(100).select("run_id", "priority", "created_at")


@_query("admissible_runs", f"{_with('r')}, f AS (SELECT * FROM r WHERE state = 'Ready' AND task_id % 11 <> 0), h AS (SELECT concurrency_key, min(run_id) AS run_id FROM r WHERE state = 'Running' AND task_id % 3 = 0 GROUP BY concurrency_key), g AS (SELECT f.* FROM f WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.concurrency_key = f.concurrency_key AND h.run_id <> f.run_id)) SELECT run_id, concurrency_key FROM (SELECT *, row_number() OVER (PARTITION BY concurrency_key ORDER BY priority DESC, created_at, run_id) AS n FROM g) WHERE n = 1 ORDER BY priority DESC, created_at, run_id LIMIT 200")
def _(spark, sf):
    runs = views.runs(spark, sf)
    held = runs.where("state = 'Running' and task_id % 3 = 0").groupBy("concurrency_key").agg(F.min("run_id").alias("run_id"))
    exhausted = views.tasks(spark, sf).where("task_id % 11 = 0").select("task_id")
    return schedule.admissible(runs.where("state = 'Ready'"), exhausted, held, 200).select("run_id", "concurrency_key")


@_query("held_keys", f"{_with('c')}, s AS (SELECT *, lag(new_state) OVER (PARTITION BY run_id ORDER BY sequence) AS prev FROM c), x AS (SELECT run_id, sequence, CASE WHEN new_state = 'Running' THEN true WHEN prev = 'Running' AND new_state IN ('RetryWait', 'Suspended') THEN CASE WHEN run_id % 2 = 1 THEN false END WHEN prev = 'Running' THEN false WHEN prev = 'Suspended' AND new_state IN {_TERMINAL} THEN false END AS held FROM s) SELECT CAST(run_id % 40 AS VARCHAR) AS concurrency_key, run_id FROM x WHERE held IS NOT NULL GROUP BY run_id HAVING arg_max(held, sequence)")
def _(spark, sf):
    runs = _event_runs(spark, sf)
    owners = runs.select("task_id", (F.col("task_id") % 40).cast("string").alias("concurrency_key"), F.when(F.col("task_id") % 2 == 1, "ReleaseOnRetry").otherwise("HoldDuringRetry").alias("hold_policy"))
    return schedule.held_keys(_changes(spark, sf), runs, owners)


@_query("retry_decisions", f"{_with('a')}, x AS (SELECT run_id, attempt_id, result, row_number() OVER w AS n, count(*) FILTER (result = 'Suspended') OVER (PARTITION BY run_id ORDER BY attempt_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s, 1 + run_id % 90 AS m FROM a WINDOW w AS (PARTITION BY run_id ORDER BY attempt_id)) SELECT run_id, attempt_id, CASE WHEN result = 'Suspended' THEN 'Suspend' WHEN n - s > m THEN 'attempt_exceeds_cap' WHEN result = 'Success' THEN 'Complete' WHEN result IN ('Failure', 'Timeout') THEN CASE WHEN n - s < m THEN 'Retry' ELSE 'Fail' END END AS decision FROM x WHERE result IS NOT NULL")
def _(spark, sf):
    from pyspark.sql import Window

    tried = fold.attempts(views.attempt_events(_log(spark, sf)))
    w = Window.partitionBy("run_id").orderBy("attempt_id")
    number = L.effective_attempt(F.row_number().over(w), F.coalesce(F.count_if(F.col("result") == "Suspended").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    response = F.when(F.col("result") == "Failure", "RetryableFailure").otherwise(F.col("result"))
    return tried.withColumn("n", number).where("result is not null").select("run_id", "attempt_id", L.retry_decision(response, F.col("n"), 1 + F.col("run_id") % 90).alias("decision"))


@_query("timeouts", f"{_with('a')} SELECT run_id, attempt_id, CASE WHEN run_id % 3 = 0 THEN 'NotConfigured' WHEN finished_at - started_at > 7200 THEN 'TimedOut' ELSE 'InTime' END AS timeout_class, CASE WHEN run_id % 3 = 0 OR finished_at - started_at <= 7200 THEN 'NotApplicable' WHEN attempt_id % 4 = 0 THEN 'NonCooperative' WHEN attempt_id % 500 > 250 THEN 'ThresholdBreach' ELSE 'Cooperative' END AS cooperation, CASE WHEN run_id % 3 <> 0 AND finished_at - started_at > 7200 AND result <> 'Suspended' THEN 'Timeout' ELSE result END AS response FROM a WHERE finished_at IS NOT NULL")
def _(spark, sf):
    tried = fold.attempts(views.attempt_events(_log(spark, sf))).where("finished_at is not null")
    limit = F.when(F.col("run_id") % 3 != 0, F.lit(7200))
    late = L.timeout_class(limit, F.col("finished_at") - F.col("started_at"))
    return tried.select(
        "run_id", "attempt_id", late.alias("timeout_class"), L.timeout_cooperation(late == "TimedOut", F.col("attempt_id") % 4 != 0, F.col("attempt_id") % 500).alias("cooperation"),
        L.response_class(F.col("result"), late == "TimedOut").alias("response"),
    )


# -- graphs ------------------------------------------------------------------------------------


@_query("dependency_gate", f"{_with('o', 'd')}, f AS (SELECT DISTINCT task_id FROM o WHERE all_terminal AND NOT any_completed), z AS (SELECT d2.task_id FROM (SELECT o_orderkey AS task_id, bool_or(f.task_id IS NOT NULL) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bad, f.task_id AS own FROM orders LEFT JOIN f ON f.task_id = o_orderkey) d2 WHERE bad AND own IS NULL), w AS (SELECT d.task_id, count(*) FILTER (NOT coalesce(o.all_terminal AND o.any_completed, false)) AS open FROM d LEFT JOIN o ON o.task_id = d.prereq_id GROUP BY d.task_id) SELECT o_orderkey AS task_id, CASE WHEN o_orderkey IN (SELECT task_id FROM z) THEN 'failed' WHEN coalesce((SELECT open FROM w WHERE w.task_id = o_orderkey), 0) = 0 THEN 'eligible' ELSE 'waiting' END AS gate FROM orders")
def _(spark, sf):
    return graph.eligibility(views.tasks(spark, sf, tenants=False), views.edges(spark, sf), report.task_outcomes(views.runs(spark, sf, tenants=False)))


@_query("hierarchy_depth", f"{_with('t')}, h AS (SELECT task_id, 0 AS depth FROM t WHERE parent_task_id IS NULL UNION ALL SELECT t.task_id, h.depth + 1 FROM t JOIN h ON t.parent_task_id = h.task_id WHERE h.depth < 8) SELECT t.task_id, h.depth, h.task_id IS NULL AS too_deep FROM t LEFT JOIN h ON t.task_id = h.task_id")
def _(spark, sf):
    """All tasks; those below the deepest level that is walked have no depth."""
    task = views.tasks(spark, sf)
    return task.select("task_id").join(graph.depths(task), "task_id", "left").withColumn("too_deep", F.col("depth").isNull())


@_query("cancel_cascade", f"{_with('t', 'o')}, h AS (SELECT task_id FROM t WHERE parent_task_id % 97 = 0 UNION SELECT t.task_id FROM t JOIN h ON t.parent_task_id = h.task_id) SELECT task_id FROM h WHERE task_id NOT IN (SELECT task_id FROM o WHERE all_terminal)")
def _(spark, sf):
    task = views.tasks(spark, sf, tenants=False)
    ended = report.task_outcomes(views.runs(spark, sf, tenants=False)).where("all_terminal")
    return graph.cascade(task, task.where("task_id % 97 = 0"), ended)


@_query("dependency_cycles", "SELECT * FROM (SELECT o_orderkey AS task_id, lead(o_orderkey, 3) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prereq_id FROM orders) WHERE prereq_id IS NOT NULL")
def _(spark, sf):
    """Proposed for every order: the customer's third order after it, which comes to depend on it, and the third before it, which it may have."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = views.table(spark, sf, "orders").select(F.col("o_orderkey").alias("task_id"), F.lead("o_orderkey", 3).over(w).alias("later"), F.lag("o_orderkey", 3).over(w).alias("earlier"))
    proposed = o.select("task_id", F.explode(F.array("later", "earlier")).alias("prereq_id")).where("prereq_id is not null")
    return graph.cycles(views.edges(spark, sf), proposed)


@_query("children_states", f"{_with('t', 'o', 'r')} SELECT parent_task_id, t.task_id, (SELECT count(*) FROM r WHERE r.task_id = t.task_id) AS n_runs, coalesce(o.all_terminal, false) AS all_terminal FROM t LEFT JOIN o USING (task_id) WHERE parent_task_id IS NOT NULL")
def _(spark, sf):
    kids = graph.children_states(views.tasks(spark, sf), views.runs(spark, sf))
    return kids.select("parent_task_id", "task_id", F.size("run_states").cast("long").alias("n_runs"), "all_terminal")


# -- read side --------------------------------------------------------------------------------------


@_query("runs_page", f"{_with('r')} SELECT run_id, task_id, state, scheduled_at, concurrency_key FROM r ORDER BY scheduled_at, run_id LIMIT 100 OFFSET 50")
def _(spark, sf):
    runs, task = views.runs(spark, sf).drop("concurrency_key"), views.tasks(spark, sf)
    return report.list_runs(runs, task, 100, 50).select("run_id", "task_id", "state", "scheduled_at", "concurrency_key")


@_query("tasks_page", f"{_with('t')} SELECT task_id, priority, created_at FROM t ORDER BY priority DESC, created_at, task_id LIMIT 100 OFFSET 20")
def _(spark, sf):
    return report.list_tasks(views.tasks(spark, sf), 100, 20).select("task_id", "priority", "created_at")


_SNAKE = (
    "CASE state WHEN 'Scheduled' THEN 'scheduled' WHEN 'Ready' THEN 'ready' WHEN 'Leased' THEN 'leased' WHEN 'Running' THEN 'running' WHEN 'RetryWait' THEN 'retry_wait' "
    "WHEN 'Suspended' THEN 'suspended' WHEN 'Completed' THEN 'completed' WHEN 'Failed' THEN 'failed' WHEN 'Canceled' THEN 'canceled' END"
)


@_query("run_summaries", f"{_with('r')} SELECT run_id, task_id, {_SNAKE} AS state, attempt_count, scheduled_at, CASE WHEN state = 'Ready' THEN NULL WHEN state IN {_TERMINAL} THEN 'terminal' ELSE {_SNAKE} END AS block_reason FROM r")
def _(spark, sf):
    return report.run_summaries(views.runs(spark, sf))


@_query("run_detail", f"{_with('c', 'a', 'held')}, x AS (SELECT run_id, arg_max(new_state, sequence) AS state, count(*) AS n_history FROM c GROUP BY run_id) SELECT run_id, x.state, n_history, coalesce((SELECT count(*) FROM a WHERE a.run_id = x.run_id), 0) AS n_attempts, (SELECT owner FROM held WHERE held.run_id = x.run_id) AS lease_owner, (SELECT sum(ts) FROM c WHERE c.run_id = x.run_id)::BIGINT AS history_time FROM x")
def _(spark, sf):
    raw = _log(spark, sf)
    changes = _changes(spark, sf)
    detail = report.run_detail(_event_runs(spark, sf), fold.history(changes), fold.attempts(views.attempt_events(raw)), fold.leases(views.lease_events(raw), changes))
    return detail.select(
        "run_id", "state", F.size("history").cast("long").alias("n_history"), F.coalesce(F.size("attempts"), F.lit(0)).cast("long").alias("n_attempts"),
        F.col("lease.owner").alias("lease_owner"), F.aggregate(F.col("history.ts"), F.lit(0).cast("long"), lambda a, t: a + t).alias("history_time"),
    )


@_query("lag_histogram", f"{_with('r')}, x AS (SELECT greatest({NOW} - scheduled_at, 0) AS lag FROM r WHERE state IN ('Ready', 'Leased', 'Running', 'RetryWait')), y AS (SELECT unnest(['0.005', '0.01', '0.025', '0.05', '0.1', '0.25', '0.5', '1.0', '2.5', '5.0', '10.0', '+Inf']) AS le) SELECT le, (SELECT count(*) FROM x WHERE le = '+Inf' OR lag <= TRY_CAST(le AS DOUBLE)) AS n, (SELECT CAST(sum(lag) AS BIGINT) FROM x) AS lag_sum FROM y")
def _(spark, sf):
    return report.lag_histogram(views.runs(spark, sf), F.lit(NOW).cast("long"))


@_query("cancel_summary", f"{_with('r')} SELECT task_id, count(*) FILTER (state NOT IN {_TERMINAL}) AS runs_canceled, count(*) FILTER (state IN {_TERMINAL}) AS runs_already_terminal, count(*) AS runs_total FROM r GROUP BY task_id")
def _(spark, sf):
    return report.cancel_summary(views.runs(spark, sf))


@_query("task_outcomes", f"{_with('o')} SELECT * FROM o")
def _(spark, sf):
    return report.task_outcomes(views.runs(spark, sf))


@_query("cron_needs", f"{_with('r')} SELECT task_id, count(*) FILTER (state NOT IN {_TERMINAL}) AS waiting, count(*) AS total, max(scheduled_at) AS last_scheduled_at FROM r GROUP BY task_id")
def _(spark, sf):
    return report.cron_needs(views.runs(spark, sf))


_PLATFORM = f"{_with('t')}, p AS (SELECT task_id AS sequence, created_at AS ts, concurrency_key AS actor_id, tenant_id, task_id % 5 AS k, 'role-' || task_id % 3 AS role, CASE WHEN task_id % 2 = 0 THEN 'CanSubmit' ELSE 'CanCancel' END AS capability FROM t), ro AS (SELECT actor_id, tenant_id, arg_max(role, sequence) AS role, arg_max(ts, sequence) AS assigned_at FROM p WHERE k = 0 GROUP BY ALL), gr AS (SELECT actor_id, capability, tenant_id, arg_max(ts, sequence) FILTER (k <> 4) AS granted_at, CASE WHEN arg_max(k, sequence) = 4 THEN arg_max(ts, sequence) END AS revoked_at FROM p WHERE k <> 0 GROUP BY ALL)"


@_query("roles", f"{_PLATFORM} SELECT * FROM ro")
def _(spark, sf):
    return fold.roles(views.platform_events(spark, sf))


@_query("capability_grants", f"{_PLATFORM} SELECT * FROM gr")
def _(spark, sf):
    return fold.grants(views.platform_events(spark, sf))


@_query("permissions", f"{_PLATFORM} SELECT CAST(c_custkey AS VARCHAR) AS actor_id, CAST(c_nationkey AS BIGINT) AS tenant_id, cap AS capability, CASE WHEN NOT EXISTS (SELECT 1 FROM ro WHERE ro.actor_id = CAST(c_custkey AS VARCHAR) AND ro.tenant_id = c_nationkey) THEN 'NoRoleAssigned' WHEN NOT EXISTS (SELECT 1 FROM gr WHERE gr.actor_id = CAST(c_custkey AS VARCHAR) AND gr.tenant_id = c_nationkey AND gr.capability = cap AND revoked_at IS NULL) THEN 'MissingCapability' ELSE 'Allowed' END AS outcome FROM customer, (SELECT unnest(['CanSubmit', 'CanCancel']) AS cap)")
def _(spark, sf):
    told = views.platform_events(spark, sf)
    who = views.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("actor_id"), F.col("c_nationkey").cast("long").alias("tenant_id"), F.explode(F.array(F.lit("CanSubmit"), F.lit("CanCancel"))).alias("capability"))
    return schedule.permissions(who, fold.roles(told), fold.grants(told))


@_query("ledger_by_key", "SELECT o_orderkey AS sequence, o_orderstatus AS ledger_key FROM orders WHERE o_orderstatus = 'F'")
def _(spark, sf):
    o = views.table(spark, sf, "orders")
    entries = o.select(
        F.col("o_orderkey").alias("sequence"), F.lit("LedgerEntryAppended").alias("event_type"), F.col("o_orderkey").cast("string").alias("entry_id"), F.lit("n").alias("tenant_id"), F.col("o_orderstatus").alias("ledger_key"),
        F.col("o_custkey").cast("string").alias("actor_id"), F.lit(None).cast("binary").alias("payload"), F.lit(0).alias("ts"),
    )
    return report.ledger_of(fold.ledger(entries), key="F").select("sequence", "ledger_key")


@_query("tenant_members", "SELECT CAST(s_nationkey AS BIGINT) AS tenant_id, count(*) AS actors FROM supplier WHERE s_suppkey % 10 <> 0 GROUP BY s_nationkey")
def _(spark, sf):
    return views.actors(spark, sf).where("deregistered_at is null").groupBy("tenant_id").agg(F.count(F.lit(1)).alias("actors"))


# -- validation ---------------------------------------------------------------------------------


@_query("legal_transitions", f"SELECT split_part(x, '>', 1) AS from_state, split_part(x, '>', 2) AS to_state FROM (SELECT unnest([{_LEGAL}]) AS x)")
def _(spark, sf):
    return validate.transition_table(spark)


@_query(
    "successor_counts",
    f"{_with('r')} SELECT state, count(*) AS n, CASE state WHEN 'Scheduled' THEN 'Ready,Canceled' WHEN 'Ready' THEN 'Leased,Canceled' WHEN 'Leased' THEN 'Ready,Running,Canceled' "
    "WHEN 'Running' THEN 'RetryWait,Suspended,Completed,Failed,Canceled' WHEN 'RetryWait' THEN 'Ready,Failed,Canceled' WHEN 'Suspended' THEN 'Ready,Canceled' ELSE '' END AS successors FROM r GROUP BY state",
)
def _(spark, sf):
    return views.runs(spark, sf).groupBy("state").agg(F.count(F.lit(1)).alias("n")).withColumn("successors", F.array_join(L.successors(F.col("state")), ","))


@_query(
    "history_violations",
    f"{_with('k', 'held')}, q AS (SELECT run_id, min(sequence) FILTER (violation IS NOT NULL) AS stop FROM k GROUP BY run_id), "
    "h AS (SELECT k.run_id, bool_or(violation IS NOT NULL) AS bad, arg_max(new_state, sequence) AS last FROM k LEFT JOIN q ON q.run_id = k.run_id "
    "WHERE k.run_id % 2 = 0 OR sequence < coalesce(stop, 1000000000000) GROUP BY k.run_id) "
    "SELECT run_id, CASE WHEN bad THEN 'illegal' ELSE 'lease_presence' END AS violation FROM h "
    "WHERE bad OR (last NOT IN ('Ready', 'Leased', 'Running') AND run_id IN (SELECT run_id FROM held))",
)
def _(spark, sf):
    """Of odd runs the history ends before its first violation, so that later rules come to bear."""
    raw, changes = _log(spark, sf), _changes(spark, sf)
    checked = fold.checked_transitions(changes)
    kept = fold.quarantine(checked.where("run_id % 2 = 1")).unionByName(checked.where("run_id % 2 = 0"))
    last = kept.groupBy("run_id").agg(F.max_by("new_state", "sequence").alias("state"))
    runs = _event_runs(spark, sf).drop("state").join(last, "run_id")
    return validate.history_violations(runs, fold.history(kept), fold.attempts(views.attempt_events(raw)), fold.leases(views.lease_events(raw), changes))


@_query("orphan_lines", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) GROUP BY ALL")
def _(spark, sf):
    lines = views.table(spark, sf, "lineitem")
    parents = views.table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    return validate.orphans(lines, parents, "l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))


@_query("duplicate_lines", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def _(spark, sf):
    return validate.duplicates(views.table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber")


@_query("rejected_transitions", f"{_with('r')} SELECT run_id AS command_id, CASE WHEN run_id % 10 = 1 THEN 'unknown_run' WHEN state <> 'Running' THEN 'stale_previous' END AS reason FROM r")
def _(spark, sf):
    runs = views.runs(spark, sf).withColumn("current_attempt_id", F.lit(None).cast("string"))
    none = F.lit(None)
    commands = runs.select(
        F.col("run_id").alias("command_id"), F.lit("RunStateTransition").alias("kind"), "task_id", F.when(F.col("run_id") % 10 == 1, -1).otherwise(F.col("run_id")).alias("run_id"),
        F.lit("Running").alias("prev_state"), F.lit("Completed").alias("new_state"), none.cast("string").alias("attempt_id"), none.cast("string").alias("owner"), none.cast("long").alias("expiry"),
        none.cast("string").alias("dimension"), none.cast("long").alias("subscription_id"), none.cast("array<bigint>").alias("depends_on"),
    )
    state = {
        "tasks": views.tasks(spark, sf), "runs": runs, "leases": spark.createDataFrame([], "run_id long, owner string, expiry long"), "budgets": spark.createDataFrame([], "task_id long, dimension string"),
        "subscriptions": spark.createDataFrame([], "subscription_id long, canceled_at long"), "engine": spark.createDataFrame([(False,)], "paused boolean"),
    }
    return validate.rejected(commands, state).select("command_id", "reason")


# -- snapshot and stream -----------------------------------------------------------------------------


@_query("snapshot_plus_tail", f"{_with('c')} SELECT run_id, arg_max(new_state, sequence) AS state FROM c GROUP BY run_id")
def _(spark, sf):
    """State from a snapshot at the middle of the log and the events after it: equal to a full replay."""
    from chronofold.sources.log import read_snapshot, write_snapshot
    from chronofold.sources.scratch import shared_dir

    changes = _changes(spark, sf)
    middle = changes.agg((F.max("sequence") / 2).cast("long")).first()[0] or 0
    path = f"{shared_dir(spark)}/chronofold/snapshot-{spark.sparkContext.applicationId}-{id(changes)}"
    latest = lambda rows: rows.groupBy("run_id").agg(F.max_by("new_state", "sequence").alias("new_state"), F.max("sequence").alias("sequence"))
    write_snapshot({"runs": latest(changes.where(F.col("sequence") <= middle))}, path, middle, EVENT_NOW)
    sequence, tables = read_snapshot(spark, path)
    tail = changes.where(F.col("sequence") > sequence).select("run_id", "new_state", "sequence")
    return latest(tables["runs"].unionByName(tail, allowMissingColumns=True)).select("run_id", F.col("new_state").alias("state"))


@_query(
    "streamed_run_states",
    f"{_with('c')}, g AS (SELECT run_id, list(new_state ORDER BY sequence) AS states, list(sequence ORDER BY sequence) AS sequences FROM c GROUP BY run_id), "
    "w AS (SELECT run_id, states, sequences, 1 AS i, CAST(NULL AS VARCHAR) AS now, CAST(-1 AS BIGINT) AS last, 0 AS rejected FROM g "
    f"UNION ALL SELECT run_id, states, sequences, i + 1, CASE WHEN ok THEN states[i] ELSE now END, CASE WHEN ok THEN sequences[i] ELSE last END, rejected + CASE WHEN ok THEN 0 ELSE 1 END "
    f"FROM (SELECT *, CASE WHEN now IS NULL THEN states[i] = 'Scheduled' ELSE now || '>' || states[i] IN ({_LEGAL}) END AS ok FROM w WHERE i <= len(states))) "
    "SELECT CAST(run_id AS VARCHAR) AS run_id, now AS state, last AS sequence, CAST(rejected AS BIGINT) AS rejected FROM w WHERE i = len(states) + 1",
)
def _(spark, sf):
    """Run states by a stream over the log's changes, in several batches; each run's last output row."""
    from chronofold.sources.scratch import materialize, shared_dir

    changes = _changes(spark, sf).select("sequence", "run_id", "ts", "new_state").withColumn("run_id", F.col("run_id").cast("string"))
    path = f"{shared_dir(spark)}/chronofold/stream-{spark.sparkContext.applicationId}-{id(changes)}"
    # Files in order of the log, written one quarter after the other, some a batch.
    stored = materialize(changes, "stream-changes")
    cuts = [r[0] for r in [stored.agg(F.expr(f"max(sequence) * {k} div 4")).first() for k in range(5)]]
    for k, (low, high) in enumerate(zip(cuts, cuts[1:], strict=False)):
        if high is not None:
            stored.where((F.col("sequence") > (low if k else -1)) & (F.col("sequence") <= high)).repartition(4, "run_id").write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 4).parquet(f"{path}/in") if cuts[0] is not None else None
    if stream is None:
        return spark.createDataFrame([], streaming.OUTPUT).select("run_id", "state", "sequence", "rejected")
    out: list[DataFrame] = []
    sink = streaming.run_states(stream).writeStream.outputMode("update").option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    sink.foreachBatch(lambda batch, _: out.append(materialize(batch, "stream"))).start().awaitTermination()
    told = out[0]
    for more in out[1:]:
        told = told.unionByName(more)
    # A batch's row has the latest legal change and the sum of rejections so far.
    return told.groupBy("run_id").agg(F.max_by("state", "sequence").alias("state"), F.max("sequence").alias("sequence"), F.max("rejected").alias("rejected"))
