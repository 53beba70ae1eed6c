"""Dependency graphs and task hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.functions.lifecycle import is_terminal
from chronofold.sources.scratch import materialize

DEEPEST = 8
#: Joins of one round of a closure.
HOPS = 4
#: Rows of a frontier that is broadcast, at most.
FEW = 500_000


def _spread(start: DataFrame, step: DataFrame) -> DataFrame:
    """All rows (origin, node) that steps (node, next) reach from those of ``start``.

    Steps go on from new rows only, so diamonds cost no repeats and cycles end. Few rows are
    broadcast to the stored steps, one join a round; of more, a round takes HOPS joins before what it found
    is compared with what is known and written to the shared folder, and only rows of its last hop
    have not been followed yet.
    """
    step = materialize(step, "steps")
    frontier, seen = materialize(start, "reach"), None
    while n := frontier.count():
        hops = 1 if n <= FEW else HOPS
        level, levels = F.broadcast(frontier) if n <= FEW else frontier, []
        for hop in range(hops):
            level = step.join(level, "node").select("origin", F.col("next").alias("node")).distinct()
            levels.append(level.withColumn("hop", F.lit(hop)))
        found = levels[0]
        for more in levels[1:]:
            found = found.unionByName(more)
        found = found.groupBy("origin", "node").agg(F.max("hop").alias("hop")) if hops > 1 else found
        if seen is not None:
            found = found.join(seen, ["origin", "node"], "left_anti")
        found = materialize(found, "reach")
        seen = found if seen is None else seen.unionByName(found)
        frontier = found.where(F.col("hop") == hops - 1).select("origin", "node")
    # One table: an anti-join of a union would be pushed into each of its parts, with the other side sorted for each.
    return frontier if seen is None else materialize(seen.select("origin", "node"), "reached")


def reachable(edges: DataFrame, start: DataFrame, parent: str, child: str) -> DataFrame:
    """(origin, node) for every node that edges parent → child reach from each start, cycles or not."""
    first = F.col(start.columns[0])
    return _spread(start.select(first.alias("origin"), first.alias("node")).distinct(), edges.select(F.col(parent).alias("node"), F.col(child).alias("next")))


def _below(edges: DataFrame, start: DataFrame, parent: str, child: str) -> DataFrame:
    """task_id of every node that edges parent → child reach from any start; all starts are one origin, so a node is one row."""
    first = start.select(F.lit(0).alias("origin"), F.col("task_id").alias("node")).distinct()
    reached = _spread(first, edges.select(F.col(parent).alias("node"), F.col(child).alias("next")))
    return reached.select(F.col("node").alias("task_id"))


def _chains(steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph of steps (node, next) with its chains contracted: places (node, chain, place, ring) and links (node, next) between chains.

    A step is inside a chain if it is the only one from its node and the only one to the next. So
    steps between chains go from a last node to a first one, and a node reaches the later ones of
    its chain and all of the chains that links reach from its own. A ring is a circle of such
    steps: its nodes reach each other and no others. Places are found by pointer doubling, in as
    many rounds as the longest chain's length has bits.
    """
    steps = materialize(steps.where("node is not null and next is not null"), "steps")
    out = steps.groupBy("node").agg(F.min("next").alias("next"), F.max("next").alias("last"))
    into = steps.groupBy("next").agg(F.min("node").alias("node"), F.max("node").alias("last"))
    inside = into.where("node = last").join(out.where("next = last"), ["node", "next"]).select(F.col("next").alias("node"), F.col("node").alias("before"))
    nodes = out.select("node").unionByName(into.select(F.col("next").alias("node"))).distinct()
    state = materialize(
        nodes.join(inside, "node", "left").select(
            "node", F.coalesce("before", "node").alias("chain"), F.when(F.col("before").isNull(), 0).otherwise(1).cast("long").alias("place"), F.col("before").isNull().alias("ends")
        ), "chains"
    )
    links = materialize(steps.join(state.where("not ends").select(F.col("chain").alias("node"), F.col("node").alias("next")), ["node", "next"], "left_anti").distinct(), "links")
    done, left = None, None
    while True:
        ended = state.where("ends").select("node", "chain", "place")
        done = ended if done is None else done.unionByName(ended)
        going = state.where("not ends").select("node", "chain", "place")
        before, left = left, going.count()
        # A round ends the nearer half of each chain; where it ends none, what is left are rings.
        if left in (0, before):
            break
        ahead = done.withColumn("ends", F.lit(True)).unionByName(going.withColumn("ends", F.lit(False))).select(F.col("node").alias("chain"), F.col("chain").alias("_chain"), F.col("place").alias("_place"), "ends")
        state = materialize(going.join(ahead, "chain").select("node", F.col("_chain").alias("chain"), (F.col("place") + F.col("_place")).alias("place"), "ends"), "chains")
    places = done.withColumn("ring", F.lit(False))
    return (places.unionByName(_rings(going.select("node", "chain"))) if left else places), links


def _rings(ahead: DataFrame) -> DataFrame:
    """Places of nodes on rings, of which each has another one ahead: a ring's name is its smallest node."""
    now, known = ahead.withColumn("low", F.col("node")), None
    while True:
        told = now.agg(F.sum(F.xxhash64("node", "low").cast("decimal(38,0)"))).first()[0]
        # Twice the way showed no smaller node anywhere, so all ways together cover each ring.
        if told == known:
            return now.select("node", F.col("low").alias("chain"), F.lit(0).cast("long").alias("place"), F.lit(True).alias("ring"))
        known = told
        far = now.select(F.col("node").alias("chain"), F.col("chain").alias("_chain"), F.col("low").alias("_low"))
        now = materialize(now.join(far, "chain").select("node", F.col("_chain").alias("chain"), F.least("low", "_low").alias("low")), "rings")


def _links_of_chains(places: DataFrame, links: DataFrame) -> DataFrame | None:
    """The links as steps (node, next) from chain to chain, or None without any. A link leads to a chain's first node, whose name is the chain's."""
    if links.isEmpty():
        return None
    return materialize(links.join(places.select("node", "chain"), "node").select(F.col("chain").alias("node"), "next").distinct(), "chain-links")


def failed_closure(edges: DataFrame, failed: DataFrame) -> DataFrame:
    """Tasks that cannot run since a prerequisite, direct or not, has failed: task_id."""
    places, links = _chains(edges.select(F.col("prereq_id").alias("node"), F.col("task_id").alias("next")))
    first = materialize(places.join(failed.select(F.col("task_id").alias("node")), "node", "left_semi").groupBy("chain").agg(F.min("place").alias("first")), "failed-chains")
    if (steps := _links_of_chains(places, links)) is not None:
        whole = _spread(first.select(F.lit(0).alias("origin"), F.col("chain").alias("node")), steps)
        first = first.unionByName(whole.select(F.col("node").alias("chain"), F.lit(-1).cast("long").alias("first"))).groupBy("chain").agg(F.min("first").alias("first"))
    below = places.join(first, "chain").where("ring or place > first").select(F.col("node").alias("task_id"))
    return below.join(failed.select("task_id"), "task_id", "left_anti")


def eligibility(tasks: DataFrame, edges: DataFrame, outcomes: DataFrame) -> DataFrame:
    """task_id with gate: eligible, waiting or failed.

    A prerequisite is met when all its runs are over and one completed; it has failed when they
    are over and none did. Failure passes on to all dependents.
    """
    outcomes = materialize(outcomes.where("all_terminal").select("task_id", "all_terminal", "any_completed"), "outcomes")
    done = outcomes.where("all_terminal and any_completed").select("task_id")
    failed = outcomes.where("all_terminal and not any_completed").select("task_id")
    blocked = failed_closure(edges, failed).withColumn("_failed", F.lit(True))
    met = edges.join(done.select(F.col("task_id").alias("prereq_id"), F.lit(True).alias("met")), "prereq_id", "left")
    open_prereqs = met.groupBy("task_id").agg(F.count_if(F.col("met").isNull()).alias("open"))
    gate = F.when(F.col("_failed"), "failed").when(F.coalesce("open", F.lit(0)) == 0, "eligible").otherwise("waiting")
    return tasks.select("task_id").join(open_prereqs, "task_id", "left").join(blocked, "task_id", "left").select("task_id", gate.alias("gate"))


def dependency_cancels(runs: DataFrame, gates: DataFrame) -> DataFrame:
    """Live runs of tasks that cannot run any more since a prerequisite failed: what a start after a crash cancels."""
    return runs.where(~is_terminal(F.col("state"))).join(gates.where("gate = 'failed'").select("task_id"), "task_id", "left_semi")


def eligible_runs(runs: DataFrame, gates: DataFrame) -> DataFrame:
    """Runs whose task's prerequisites are all met."""
    return runs.join(gates.where("gate = 'eligible'").select("task_id"), "task_id", "left_semi")


def newly_eligible(before: DataFrame, after: DataFrame) -> DataFrame:
    return after.where("gate = 'eligible'").select("task_id").join(before.where("gate = 'eligible'").select("task_id"), "task_id", "left_anti")


def cycles(edges: DataFrame, proposed: DataFrame) -> DataFrame:
    """Proposed edges (task_id, prereq_id) that would close a cycle: the task is its prerequisite's prerequisite, or itself."""
    places, links = _chains(edges.select(F.col("task_id").alias("node"), F.col("prereq_id").alias("next")))
    end = lambda key, p: places.select(F.col("node").alias(key), F.col("chain").alias(f"{p}_chain"), F.col("place").alias(f"{p}_place"), F.col("ring").alias(f"{p}_ring"))
    placed = proposed.select("task_id", "prereq_id").distinct().join(end("prereq_id", "from"), "prereq_id").join(end("task_id", "to").drop("to_ring"), "task_id")
    ahead = (F.col("from_chain") == F.col("to_chain")) & (F.col("from_ring") | (F.col("to_place") > F.col("from_place")))
    steps = _links_of_chains(places, links)
    if steps is None:
        back = placed.where(ahead).select("task_id", "prereq_id")
    else:
        placed = materialize(placed, "placed")
        far = _spread(placed.where(~ahead).select(F.col("from_chain").alias("origin"), F.col("from_chain").alias("node")).distinct(), steps)
        back = placed.where(ahead).select("task_id", "prereq_id").unionByName(
            placed.where(~ahead).join(far.select(F.col("origin").alias("from_chain"), F.col("node").alias("to_chain")), ["from_chain", "to_chain"], "left_semi").select("task_id", "prereq_id")
        )
    return back.unionByName(proposed.where("task_id = prereq_id").select("task_id", "prereq_id")).distinct()


def depths(tasks: DataFrame, deepest: int = DEEPEST) -> DataFrame:
    """task_id, depth: 0 for roots, at most ``deepest`` levels are walked; deeper tasks are left out."""
    level = tasks.where("parent_task_id is null").select("task_id", F.lit(0).alias("depth"))
    out = level
    for d in range(1, deepest + 1):
        level = tasks.join(level.select(F.col("task_id").alias("parent_task_id")), "parent_task_id").select("task_id", F.lit(d).alias("depth"))
        out = out.unionByName(level)
    return out


def child_violations(children: DataFrame, tasks: DataFrame, outcomes: DataFrame, deepest: int = DEEPEST) -> DataFrame:
    """Proposed children (task_id, parent_task_id) with violation: OrphanPrevention, DepthLimitExceeded or null."""
    parents = depths(tasks, deepest).select(F.col("task_id").alias("parent_task_id"), F.col("depth").alias("_depth"))
    over = outcomes.where("all_terminal").select(F.col("task_id").alias("parent_task_id"), F.lit(True).alias("_over"))
    out = children.join(parents, "parent_task_id", "left").join(over, "parent_task_id", "left")
    return out.withColumn("violation", F.when(F.col("_over"), "OrphanPrevention").when(F.col("_depth").isNull() | (F.col("_depth") + 1 > deepest), "DepthLimitExceeded")).drop("_depth", "_over")


def cascade(tasks: DataFrame, canceled: DataFrame, terminal: DataFrame) -> DataFrame:
    """Tasks that a cancellation reaches: all live descendants, also below ended ones."""
    below = _below(tasks.where("parent_task_id is not null"), canceled, "parent_task_id", "task_id")
    return below.join(terminal.select("task_id"), "task_id", "left_anti")


def children_states(tasks: DataFrame, runs: DataFrame) -> DataFrame:
    """Per parent and child: the child's run states and whether all are over (not, without runs)."""
    states = runs.groupBy("task_id").agg(F.sort_array(F.collect_list("state")).alias("run_states"), F.bool_and(is_terminal(F.col("state"))).alias("over"))
    kids = tasks.where("parent_task_id is not null").select("parent_task_id", "task_id").join(states, "task_id", "left")
    return kids.select("parent_task_id", "task_id", F.coalesce("run_states", F.array().cast("array<string>")).alias("run_states"), F.coalesce("over", F.lit(False)).alias("all_terminal"))


def collectable(tasks: DataFrame, terminal: DataFrame) -> DataFrame:
    """Ended tasks without live descendants: their state may go."""
    live = tasks.join(terminal.select("task_id"), "task_id", "left_anti").select("task_id")
    above = _below(tasks.where("parent_task_id is not null"), live, "task_id", "parent_task_id")
    return terminal.select("task_id").join(above, "task_id", "left_anti")
