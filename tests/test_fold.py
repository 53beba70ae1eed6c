import pytest
from pyspark.sql import functions as F

from chronofold.model import events
from chronofold.operators import fold, report, validate
from chronofold.sources import log


def change(seq, run, before, after, **more):
    return {"sequence": seq, "event_type": "RunStateChanged", "ts": seq * 10, "run_id": run, "prev_state": before, "new_state": after, **more}


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def small(spark):
    """Two tasks; run A completes after one attempt, run B waits in Ready."""
    return events(spark, [
        {"sequence": 1, "event_type": "TaskCreated", "ts": 1, "task_id": "a", "priority": 9, "concurrency_key": "alpha"},
        {"sequence": 2, "event_type": "TaskCreated", "ts": 2, "task_id": "b", "priority": 3, "concurrency_key": "beta"},
        {"sequence": 3, "event_type": "RunCreated", "ts": 3, "run_id": "A", "task_id": "a", "scheduled_at": 3},
        change(4, "A", "Scheduled", "Ready"), change(5, "A", "Ready", "Leased"), change(6, "A", "Leased", "Running"),
        {"sequence": 7, "event_type": "AttemptStarted", "ts": 70, "run_id": "A", "attempt_id": "x"},
        {"sequence": 8, "event_type": "AttemptFinished", "ts": 80, "run_id": "A", "attempt_id": "x", "result": "Success"},
        change(9, "A", "Running", "Completed"),
        {"sequence": 10, "event_type": "RunCreated", "ts": 4, "run_id": "B", "task_id": "b", "scheduled_at": 4},
        change(11, "B", "Scheduled", "Ready"),
    ])


def test_stats(spark, small):
    got = report.stats(fold.tasks(small), fold.runs(small), small).first().asDict()
    assert got == {"total_tasks": 2, "total_runs": 2, "attempts_total": 1, "latest_sequence": 11, "ready": 1, "completed": 1, "scheduled": 0, "leased": 0, "running": 0, "retry_wait": 0, "failed": 0, "canceled": 0}


def test_replay_is_deterministic_and_order_of_rows_is_free(small):
    assert rows(fold.runs(small), "*") == rows(fold.runs(small.orderBy(F.rand(1))), "*")


def test_checks(spark, small):
    assert fold.checked_transitions(fold.transitions(small)).where("violation is not null").count() == 0
    bad = small.unionByName(events(spark, [change(13, "B", "Ready", "Running"), change(14, "B", "Running", "Completed"), change(15, "A", "Running", "Failed")]))
    checked = fold.checked_transitions(fold.transitions(bad))
    assert rows(checked.where("violation is not null"), "sequence", "violation") == [(13, "illegal"), (15, "stale_previous")]
    assert fold.strict_prefix(checked).agg(F.max("sequence")).first()[0] == 11
    assert rows(fold.quarantine(checked).groupBy("run_id").agg(F.max("sequence").alias("s")), "run_id", "s") == [("A", 9), ("B", 11)]
    assert fold.out_of_sequence(bad).count() == 0
    assert fold.out_of_sequence(bad.unionByName(events(spark, [change(13, "B", "Ready", "Leased")]))).count() == 2


def test_leases(spark):
    lease = lambda s, kind, run, owner, expiry: {"sequence": s, "event_type": kind, "ts": s, "run_id": run, "owner": owner, "expiry": expiry}
    base = [{"sequence": 1, "event_type": "RunCreated", "ts": 1, "run_id": "A", "task_id": "a"}, change(2, "A", "Scheduled", "Ready"), change(3, "A", "Ready", "Leased"), lease(4, "LeaseAcquired", "A", "w", 100), lease(5, "LeaseHeartbeat", "A", "w", 150)]
    log1 = events(spark, base)
    assert rows(fold.leases(log1), "run_id", "owner", "expiry", "acquired_at", "updated_at") == [("A", "w", 150, 4, 5)]
    ended = events(spark, [*base, lease(6, "LeaseReleased", "A", "w", 150)])
    assert fold.leases(ended).count() == 0
    changes = fold.transitions(ended)
    # The run is Ready again, without a row of history.
    assert fold.runs(ended).first().state == "Ready"
    assert fold.history(changes).count() == 3
    running = events(spark, [*base, change(6, "A", "Leased", "Running"), lease(7, "LeaseExpired", "A", "w", 150)])
    assert fold.runs(running).first().state == "Running"
    over = events(spark, [*base, change(6, "A", "Leased", "Canceled")])
    assert fold.leases(over).count() == 0


def test_budgets(spark):
    b = lambda s, kind, amount, dim="Token": {"sequence": s, "event_type": kind, "ts": s, "task_id": "t", "dimension": dim, "amount": amount}
    steps = [b(1, "BudgetConsumed", 7), b(2, "BudgetAllocated", 100), b(3, "BudgetConsumed", 150)]
    assert rows(fold.budgets(events(spark, steps)), "limit", "consumed", "exhausted", "allocated_at") == [(100, 150, True, 2)]
    assert rows(fold.budgets(events(spark, [*steps, b(4, "BudgetReplenished", 200)])), "limit", "consumed", "exhausted") == [(200, 0, False)]
    assert fold.budgets(events(spark, [b(1, "BudgetConsumed", 7), b(2, "BudgetReplenished", 5)])).count() == 0
    assert rows(fold.budgets(events(spark, [b(1, "BudgetAllocated", 100), b(2, "BudgetExhausted", None)])), "exhausted") == [(True,)]
    huge = events(spark, [b(1, "BudgetAllocated", 100), b(2, "BudgetConsumed", 2**62), b(3, "BudgetConsumed", 2**62), b(4, "BudgetConsumed", 2**62)])
    assert rows(fold.budgets(huge), "consumed", "exhausted") == [(2**63 - 1, True)]
    three = spark.createDataFrame([("t", "Token", 90, 100), ("t", "Cost", 160, 200), ("t", "Time", 20, 50)], "task_id string, dimension string, consumed long, limit long")
    assert report.budget_crossings(three, 80).count() == 2


def test_upserts(spark):
    e = lambda s, kind, **kw: {"sequence": s, "event_type": kind, "ts": s * 10, **kw}
    told = events(spark, [
        e(1, "ActorRegistered", actor_id="p", capabilities=["compute"], heartbeat_interval_secs=10), e(2, "ActorHeartbeat", actor_id="p"), e(3, "ActorDeregistered", actor_id="p"),
        e(4, "ActorRegistered", actor_id="p", capabilities=["review"], heartbeat_interval_secs=10),
        e(5, "RoleAssigned", actor_id="p", tenant_id="n", role="r1"), e(6, "RoleAssigned", actor_id="p", tenant_id="n", role="r2"),
        e(7, "CapabilityGranted", actor_id="p", tenant_id="n", capability="c"), e(8, "CapabilityRevoked", actor_id="p", tenant_id="n", capability="c"), e(9, "CapabilityGranted", actor_id="p", tenant_id="n", capability="c"),
        e(10, "SubscriptionCreated", subscription_id="s", task_id="t"), e(11, "SubscriptionTriggered", subscription_id="s"), e(12, "EnginePaused"), e(13, "EngineResumed"), e(14, "DependencyDeclared", task_id="t", depends_on=["x", "y", "x"]),
    ])
    assert rows(fold.actors(told), "actor_id", "registered_at", "last_heartbeat_at", "deregistered_at") == [("p", 40, 40, None)]
    assert rows(fold.roles(told), "role") == [("r2",)]
    assert rows(fold.grants(told), "granted_at", "revoked_at") == [(90, None)]
    assert rows(fold.subscriptions(told), "created_at", "triggered_at", "canceled_at") == [(100, 110, None)]
    again = told.unionByName(events(spark, [e(15, "SubscriptionCreated", subscription_id="s", task_id="t"), e(16, "TenantCreated", tenant_id="n", name="a"), e(17, "TenantCreated", tenant_id="n", name="b")]))
    assert rows(fold.subscriptions(again), "created_at", "triggered_at", "canceled_at") == [(150, None, None)]
    assert rows(fold.tenants(again), "name", "created_at") == [("b", 170)]
    assert fold.active_subscriptions(fold.subscriptions(told)).count() == 0
    assert tuple(fold.engine_control(told).first()) == (False, 120, 130)
    assert rows(fold.dependencies(told), "prereq_id") == [("x",), ("y",)]
    assert tuple(fold.engine_control(told.where(F.lit(False))).first()) == (False, None, None)


def test_snapshot_and_tail_equal_full_replay(spark, small, tmp_path):
    path, snap = str(tmp_path / "log"), str(tmp_path / "snap")
    assert log.read_snapshot(spark, snap) is None
    log.append(small.where("sequence <= 6"), path, strict=True)
    log.append(small.where("sequence > 6"), path)
    for again in (small.where("sequence = 11"), small.where("sequence = 3")):
        with pytest.raises(log.SequenceError):
            log.append(again, path)
    with pytest.raises(log.SequenceError):
        log.append(small.where("sequence = 11").withColumn("sequence", F.lit(20).cast("long")), path, strict=True)
    full = fold.transitions(log.read_log(spark, path))
    latest = lambda c: c.groupBy("run_id").agg(F.max_by("new_state", "sequence").alias("new_state"), F.max("sequence").alias("sequence"))
    log.write_snapshot({"runs": latest(fold.transitions(log.read_log(spark, path).where("sequence <= 6")))}, snap, 6, 99)
    sequence, tables = log.read_snapshot(spark, snap)
    tail = fold.transitions(log.read_log(spark, path, after=sequence)).select("run_id", "new_state", "sequence")
    assert rows(latest(tables["runs"].unionByName(tail)), "*") == rows(latest(full), "*")
    assert log.snapshot_due(10_006, sequence) and not log.snapshot_due(10_005, sequence)


def test_framed_files(spark, tmp_path):
    good = b"".join(log.frame(s, {"event_type": "x"}) for s in (1, 2, 5))
    cases = {"ok": good, "cut": good[:-3], "head": good + b"\1\2", "crc": good[:-1] + b"?", "order": good + log.frame(5, {})}
    for name, data in cases.items():
        (tmp_path / name).write_bytes(data)
    scanned = log.scan_frames(spark, str(tmp_path))
    told = {r.file.rsplit("/", 1)[1]: (r.last_sequence, r.problem) for r in log.tail(scanned).collect()}
    assert told == {"ok": (5, None), "cut": (2, "partial_payload"), "head": (5, "partial_header"), "crc": (2, "crc"), "order": (5, "sequence")}
    assert log.repaired(scanned, strict=False).count() == 13
    with pytest.raises(Exception, match="damaged log"):
        log.repaired(scanned).collect()


def test_rejections(spark, small):
    none = {"attempt_id": None, "owner": None, "expiry": None, "dimension": None, "subscription_id": None, "depends_on": None, "prev_state": None, "new_state": None, "task_id": None, "run_id": None}
    cmds = [
        (1, "TaskCreate", {"task_id": "a"}, "duplicate_task"), (2, "TaskCreate", {"task_id": "z"}, None), (3, "RunCreate", {"task_id": "z", "run_id": "N"}, "unknown_task"),
        (4, "RunStateTransition", {"run_id": "B", "prev_state": "Ready", "new_state": "Leased"}, None), (5, "RunStateTransition", {"run_id": "B", "prev_state": "Ready", "new_state": "Running"}, "illegal_transition"),
        (6, "RunStateTransition", {"run_id": "B", "prev_state": "Leased", "new_state": "Running"}, "stale_previous"), (7, "AttemptStart", {"run_id": "B"}, "not_running"),
        (8, "LeaseAcquire", {"run_id": "B", "owner": "w"}, None), (9, "LeaseHeartbeat", {"run_id": "B", "owner": "w"}, "wrong_state"), (10, "EngineResume", {}, "not_paused"), (11, "EnginePause", {}, None),
        (12, "DependencyDeclare", {"task_id": "a", "depends_on": ["b"]}, None), (13, "DependencyDeclare", {"task_id": "a", "depends_on": ["q"]}, "unknown_prerequisite"), (14, "DependencyDeclare", {"task_id": "a", "depends_on": []}, "no_prerequisites"),
        (15, "BudgetReplenish", {"task_id": "a", "dimension": "Token"}, "no_budget"), (16, "SubscriptionCancel", {"subscription_id": "s"}, "unknown_subscription"), (17, "TaskCancel", {"task_id": "a"}, None), (18, "RunResume", {"run_id": "B"}, "not_suspended"),
    ]
    schema = "command_id int, kind string, attempt_id string, owner string, expiry long, dimension string, subscription_id string, depends_on array<string>, prev_state string, new_state string, task_id string, run_id string"
    commands = spark.createDataFrame([(i, k, *(none | f).values()) for i, k, f, _ in cmds], schema)
    state = {"tasks": fold.tasks(small), "runs": fold.runs(small), "leases": fold.leases(small), "budgets": fold.budgets(small), "subscriptions": fold.subscriptions(small), "engine": fold.engine_control(small)}
    assert dict(rows(validate.rejected(commands, state), "command_id", "reason")) == {i: r for i, _, _, r in cmds}
    assert rows(validate.sequence_gaps(spark.createDataFrame([(12, 1), (13, 2), (15, 3)], "sequence long, command_id int"), 11), "sequence") == [(15,)]


def test_snapshot_audit(spark, small):
    changes = fold.transitions(small)
    args = fold.runs(small), fold.history(changes), fold.attempts(small), fold.leases(small)
    assert validate.history_violations(*args).count() == 0
    gap = args[1].where("sequence <> 5")
    assert rows(validate.history_violations(args[0], gap, *args[2:]), "run_id", "violation") == [("A", "gap")]
    late = args[1].withColumn("ts", F.when(F.col("run_id") == "B", F.col("ts") + F.when(F.col("sequence") == 10, 1).otherwise(0)).otherwise(F.col("ts")))
    assert rows(validate.history_violations(args[0], late, *args[2:]), "run_id", "violation") == [("B", "bad_start")]
    held = spark.createDataFrame([("A",), ("B",)], "run_id string")
    assert rows(validate.history_violations(*args[:3], held), "run_id", "violation") == [("A", "lease_presence")]
    payload = spark.createDataFrame([("a", "t", "Ready", 5, 4, None, 0), ("b", None, "Ready", 4, 4, None, 0), ("c", "t", "Leased", 4, 4, "x", 1), ("d", "t", "Running", 4, 4, "x", 0), ("e", "t", "Canceled", 9, 4, "x", 2)], "run_id string, task_id string, state string, scheduled_at long, created_at long, current_attempt_id string, attempt_count long")
    assert rows(validate.run_violations(payload), "run_id", "violation") == [("a", "ready_schedule"), ("b", "task_id"), ("c", "attempt_state"), ("d", "attempt_count")]
    assert validate.engine_violations(spark.createDataFrame([(True, 5, None), (True, None, None), (False, 5, 4), (False, None, None)], "paused boolean, paused_at long, resumed_at long")).count() == 2
    assert fold.trim_terminal(args[1], args[0]).select("run_id").distinct().collect()[0][0] == "B"
