import pytest
from pyspark.sql import functions as F

from chronofold.operators import graph, report, schedule


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def long(x):
    return F.lit(x).cast("long")


TASK = "task_id long, policy string, repeat_count long, interval_secs long, origin long, already long, cron_expr string, max_occurrences long, waiting long, total long, last_scheduled_at long, canceled_at long"


def task(spark, **kw):
    base = {"task_id": 1, "policy": "repeat", "repeat_count": 5, "interval_secs": 60, "origin": 0, "already": 0, "cron_expr": None, "max_occurrences": None, "waiting": 0, "total": 0, "last_scheduled_at": None, "canceled_at": None}
    return spark.createDataFrame([tuple((base | kw).values())], TASK)


def test_repeat(spark):
    times = lambda **kw: [t for _, t in rows(schedule.derive_repeat(task(spark, **kw)), "run_index", "scheduled_at")]
    assert times() == [0, 60, 120, 180, 240]
    assert times(repeat_count=10, interval_secs=30, already=5) == [150, 180, 210, 240, 270]
    assert times(repeat_count=10, already=10) == []
    with pytest.raises(Exception, match="ARITHMETIC_OVERFLOW"):
        times(origin=(1 << 63) - 10, interval_secs=60)
    assert rows(schedule.derive_runs(task(spark, policy="once"), long(7)), "scheduled_at") == [(7,)]


def test_cron_window(spark):
    n = lambda **kw: len(rows(schedule.derive_cron(task(spark, policy="cron", cron_expr="0 0 * * * *", **kw)), "scheduled_at"))
    assert (n(), n(waiting=3, total=9), n(max_occurrences=2), n(max_occurrences=10, total=9, waiting=1), n(canceled_at=4), n(max_occurrences=7, total=6, waiting=0)) == (5, 2, 2, 1, 0, 1)
    assert rows(schedule.derive_cron(task(spark, policy="cron", cron_expr="no")), "scheduled_at") == []


RUN = "run_id long, task_id long, state string, priority int, created_at long, scheduled_at long, concurrency_key string, attempt_count long, last_state_change_at long"


def test_misfire_and_retry(spark):
    runs = spark.createDataFrame([(i, 1, "Scheduled", 0, 0, 1000 + i, None, 0, 0) for i in range(5)] + [(9, 1, "RetryWait", 0, 0, 0, None, 3, 1000)], RUN)
    assert schedule.promote_due(runs, long(1010)).count() == 5 and schedule.promote_due(runs, long(1002)).count() == 3
    assert rows(schedule.promote_retries(runs, long(1004), 1000, 60_000), "run_id", "ready_at") == [(9, 1004)]
    assert schedule.promote_retries(runs, long(1003), 1000, 60_000).count() == 0


def test_selection_and_admission(spark):
    data = [(1, 1, 1300, "a"), (2, 5, 1100, "b"), (3, 5, 1200, "b"), (4, 8, 1000, "c"), (5, 9, 1, "d"), (6, 0, 1, None), (7, 0, 2, None)]
    runs = spark.createDataFrame([(i, i, "Ready", p, c, 0, k, 0, 0) for i, p, c, k in data], RUN)
    assert [r.run_id for r in runs.where("run_id < 5").orderBy(*schedule.dispatch_order()).collect()] == [4, 2, 3, 1]
    spent = spark.createDataFrame([(2,)], "task_id long")
    held = spark.createDataFrame([("c", 99), ("d", 5)], "concurrency_key string, run_id long")
    # 2 has no budget, so 3 gets the key; another run holds 4's; 5 holds its own.
    assert [r.run_id for r in schedule.admissible(runs, spent, held, 10).collect()] == [5, 3, 1, 6, 7]
    assert [r.run_id for r in schedule.admissible(runs, spent, held, 2).collect()] == [5, 3]


def test_held_keys(spark):
    path = ["Scheduled", "Ready", "Leased", "Running"]
    ways = {1: ["RetryWait"], 2: ["RetryWait"], 3: ["Suspended", "Canceled"], 4: ["Completed"], 5: []}
    changes = spark.createDataFrame([(100 * r + i, r, s) for r, more in ways.items() for i, s in enumerate(path + more)], "sequence long, run_id long, new_state string")
    runs = spark.createDataFrame([(r, r) for r in ways], "run_id long, task_id long")
    tasks = spark.createDataFrame([(r, f"k{r}", "ReleaseOnRetry" if r == 2 else "HoldDuringRetry") for r in ways], "task_id long, concurrency_key string, hold_policy string")
    assert rows(schedule.held_keys(changes, runs, tasks), "run_id") == [(1,), (5,)]


def test_leases_and_actors(spark):
    leases = spark.createDataFrame([(1, "w", 100), (2, "w", 101)], "run_id long, owner string, expiry long")
    assert rows(schedule.expired_leases(leases, long(100)), "run_id") == [(1,)]
    assert rows(schedule.renewals(leases, long(1), 300), "run_id", "new_expiry") == [(1, 301), (2, 301)]
    runs = spark.createDataFrame([(1, "Ready"), (2, "Leased"), (3, "Ready")], "run_id long, state string")
    asked = spark.createDataFrame([(1, "v"), (2, "v"), (3, "v"), (4, "v")], "run_id long, owner string")
    assert rows(schedule.acquire_lease(asked, runs, leases.where("run_id = 1")), "run_id", "outcome") == [(1, "AlreadyLeased"), (2, "WrongState"), (3, "Acquired"), (4, "WrongState")]
    actors = spark.createDataFrame([("a", ["compute"], None), ("b", ["compute", "review"], None), ("c", ["review"], 5)], "actor_id string, capabilities array<string>, deregistered_at long")
    needs = spark.createDataFrame([(1, ["compute", "review"]), (2, []), (3, None), (4, ["gpu"])], "task_id long, required_capabilities array<string>")
    assert rows(schedule.eligible_actors(needs, actors), "task_id", "actor_id") == [(1, "b"), (2, "a"), (2, "b"), (3, "a"), (3, "b")]


def test_subscriptions_fire(spark):
    kind = "struct<kind: string, task_id: string, state: string, dimension: string, threshold_pct: int, key: string>"
    subs = spark.createDataFrame([
        (1, ("TaskCompleted", "t", None, None, None, None), None, None), (2, ("RunStateChanged", "t", "Failed", None, None, None), None, None), (3, ("BudgetThreshold", "t", None, "Cost", 80, None), None, None),
        (4, ("BudgetThreshold", "t", None, "Cost", 90, None), None, None), (5, ("Custom", None, None, None, None, "go"), None, None), (6, ("Custom", None, None, None, None, "go"), 3, None),
    ], f"subscription_id long, filter {kind}, triggered_at long, canceled_at long")
    told = spark.createDataFrame([("RunStateChanged", "t", "Failed", None, None, None), ("BudgetThreshold", "t", None, "Cost", 85, None), ("Custom", None, None, None, None, "go"), ("TaskCompleted", "u", None, None, None, None)], "kind string, task_id string, state string, dimension string, pct long, key string")
    assert rows(schedule.fired(subs, told), "subscription_id") == [(2,), (3,), (5,)]


def test_dag(spark):
    tasks = spark.createDataFrame([(i,) for i in range(1, 6)], "task_id long")
    edges = spark.createDataFrame([(2, 1), (3, 2), (5, 4)], "task_id long, prereq_id long")
    outcome = lambda *r: spark.createDataFrame(list(r), "task_id long, all_terminal boolean, any_completed boolean")
    failed = graph.eligibility(tasks, edges, outcome((1, True, False), (4, True, True)))
    assert rows(failed, "task_id", "gate") == [(1, "eligible"), (2, "failed"), (3, "failed"), (4, "eligible"), (5, "eligible")]
    before, after = graph.eligibility(tasks, edges, outcome((1, False, False))), graph.eligibility(tasks, edges, outcome((1, True, True)))
    assert rows(graph.newly_eligible(before, after), "task_id") == [(2,)]
    proposed = spark.createDataFrame([(1, 2), (1, 3), (3, 1), (4, 4), (1, 5)], "task_id long, prereq_id long")
    assert rows(graph.cycles(edges, proposed), "task_id", "prereq_id") == [(1, 2), (1, 3), (4, 4)]


def test_hierarchy(spark):
    tasks = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (9, None)], "task_id long, parent_task_id long")
    assert rows(graph.depths(tasks, 2), "task_id", "depth") == [(1, 0), (2, 1), (3, 2), (9, 0)]
    ended = spark.createDataFrame([(2, True, True)], "task_id long, all_terminal boolean, any_completed boolean")
    kids = spark.createDataFrame([(7, 2), (8, 3), (6, 1)], "task_id long, parent_task_id long")
    assert rows(graph.child_violations(kids, tasks, ended, 2), "task_id", "violation") == [(6, None), (7, "OrphanPrevention"), (8, "DepthLimitExceeded")]
    root = spark.createDataFrame([(1,)], "task_id long")
    assert rows(graph.cascade(tasks, root, ended), "task_id") == [(3,), (4,)]
    assert rows(graph.collectable(tasks, spark.createDataFrame([(2,), (9,)], "task_id long")), "task_id") == [(9,)]


def test_pages(spark):
    data = [(4, 6, 20), (5, 5, 9), (1, 5, 10), (2, 5, 10), (3, 4, 5)]
    tasks = spark.createDataFrame(data, "task_id long, priority int, created_at long")
    assert [r.task_id for r in report.list_tasks(tasks).collect()] == [4, 5, 1, 2, 3]
    assert [r.task_id for r in report.list_tasks(tasks, 2, 1).collect()] == [5, 1]
    assert report.page([]) == (100, 0) and report.page([("limit", "5"), ("x", "y"), ("limit", "7"), ("offset", "2")]) == (7, 2)
    for bad in ([("limit", "0")], [("offset", "-1")], [("limit", "1001")], [("limit", "x")]):
        with pytest.raises(ValueError, match="invalid_pagination"):
            report.page(bad)


def test_permissions_and_pause(spark):
    roles = spark.createDataFrame([("p", "n", "r")], "actor_id string, tenant_id string, role string")
    grants = spark.createDataFrame([("p", "n", "c", None), ("p", "n", "d", 4)], "actor_id string, tenant_id string, capability string, revoked_at long")
    asked = spark.createDataFrame([("p", "n", "c"), ("p", "n", "d"), ("q", "n", "c")], "actor_id string, tenant_id string, capability string")
    assert rows(schedule.permissions(asked, roles, grants), "actor_id", "capability", "outcome") == [("p", "c", "Allowed"), ("p", "d", "MissingCapability"), ("q", "c", "NoRoleAssigned")]
    for paused, n in ((True, 0), (False, 3)):
        assert schedule.unless_paused(asked, spark.createDataFrame([(paused,)], "paused boolean")).count() == n


def test_chains_rings_and_branches(spark):
    """Closures over contracted chains against a walk: chains, a ring, branches, diamonds, a circle through branches, a self-loop."""
    pairs = [(i, i + 1) for i in range(1, 20)] + [(30, 31), (31, 32), (32, 30)] + [(40, 41), (41, 42), (41, 43), (42, 44), (43, 44), (44, 45), (45, 46)]
    pairs += [(50, 51), (51, 52), (52, 50), (52, 53), (53, 54), (60, 60), (46, 70), (70, 71), (40, 41)]
    below: dict[int, set[int]] = {}
    for a in {x for p in pairs for x in p}:
        todo, seen = [a], set()
        while todo:
            x = todo.pop()
            new = {v for u, v in pairs if u == x} - seen
            seen |= new
            todo.extend(new)
        below[a] = seen
    edges = spark.createDataFrame(pairs, "prereq_id long, task_id long")
    for bad in ([5], [19, 31], [42], [40], [53], [51], [60, 99], []):
        failed = spark.createDataFrame([(b,) for b in bad], "task_id long")
        expected = sorted((x,) for x in set().union(*(below.get(b, set()) for b in bad)) - set(bad))
        assert rows(graph.failed_closure(edges, failed), "task_id") == expected, bad
    names = sorted(below)
    proposed = spark.createDataFrame([(a, b) for a in names for b in names] + [(99, 99), (99, 1)], "task_id long, prereq_id long")
    up = spark.createDataFrame([(b, a) for a, b in pairs], "prereq_id long, task_id long")
    expected = sorted((a, b) for a in names for b in names if a == b or a in below[b])
    assert rows(graph.cycles(up, proposed), "task_id", "prereq_id") == sorted([*expected, (99, 99)])


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    stored = []
    keep = graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, name: (stored.append(name), keep(df, name))[1])
    edges = spark.createDataFrame([(i, i - 1) for i in range(1, 200)], "task_id long, prereq_id long")
    assert graph.failed_closure(edges, spark.createDataFrame([(0,)], "task_id long")).count() == 199
    assert len(stored) < 15


def test_eligible_actors_in_blocks(spark, monkeypatch):
    """Few distinct sets, many blocks, both ways of joining blocks; repeated and null ids stay. The work is dealt by pairs, not by sets."""
    needs = spark.createDataFrame([(i, ["a"] if i % 2 else []) for i in range(40)] + [(1, ["a"])], "task_id long, required_capabilities array<string>")
    actors = spark.createDataFrame([(i if i else None, ["a", "b"] if i % 3 else ["b"], None) for i in range(60)] + [(1, ["a", "b"], None)], "actor_id long, capabilities array<string>, deregistered_at long")
    of = [(i if i else None, i % 3 != 0) for i in range(60)] + [(1, True)]
    expected = sorted(((t, a) for t in [*range(40), 1] for a, has in of if has or t % 2 == 0), key=repr)
    monkeypatch.setattr(schedule, "BLOCK_ACTORS", 7)
    monkeypatch.setattr(schedule, "PART_PAIRS", 100)
    for most in (1_000, 0):
        monkeypatch.setattr(schedule, "BROADCAST_ACTORS", most)
        made = schedule.eligible_actors(needs, actors)
        assert sorted(((r.task_id, r.actor_id) for r in made.collect()), key=repr) == expected
        assert most == 0 or made.rdd.getNumPartitions() >= 19


def test_eligible_actors_are_small_as_files(spark, tmp_path, monkeypatch):
    """All pairs are asked for; written, they take a small part of a byte each, where ids of actors, task by task, took two."""
    needs = spark.range(100).selectExpr("id AS task_id", "array('a') AS required_capabilities")
    actors = spark.range(20_000).selectExpr("id AS actor_id", "array('a', 'b') AS capabilities", "cast(null AS long) AS deregistered_at")
    for most in (1_000_000, 0):
        monkeypatch.setattr(schedule, "BROADCAST_ACTORS", most)
        out = tmp_path / f"pairs{most}"
        schedule.eligible_actors(needs, actors).write.parquet(str(out))
        assert spark.read.parquet(str(out)).distinct().count() == 2_000_000
        assert sum(p.stat().st_size for p in out.glob("*.parquet")) < 0.5 * 2_000_000


def test_eligible_actors_of_a_set_come_in_bounded_blocks(spark, monkeypatch):
    """No list grows with the rows of a set, nor with a repeated id; none is lost where lists are cut."""
    monkeypatch.setattr(schedule, "NEAR_ROWS", 10)
    ids = [*range(33), *[7] * 30, None]
    rows_ = spark.createDataFrame([(i, ["a"]) for i in ids], "id long, needed array<string>")
    lists = [r.members for r in schedule._in_blocks(rows_, "needed", "id", 4, "few").collect()]
    assert max(map(len, lists)) <= 4
    assert sorted((i for x in lists for i in x), key=repr) == sorted(ids, key=repr)


def test_what_a_closure_reaches_is_one_table(spark):
    """The anti-join after a closure of several rounds is one join, not one for each round."""
    tasks = spark.createDataFrame([(i, i - 1 if i else None) for i in range(12)], "task_id long, parent_task_id long")
    live = graph.cascade(tasks, tasks.where("task_id = 0"), spark.createDataFrame([(3,)], "task_id long"))
    assert rows(live, "task_id") == [(i,) for i in range(1, 12) if i != 3]
    assert live._jdf.queryExecution().optimizedPlan().toString().count("LeftAnti") == 1
