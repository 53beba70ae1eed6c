"""Scalar rules of the run lifecycle, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronofold.model import LAG_STATES, STATES, SUCCESSORS, TERMINAL, TRANSITIONS

MOST = (1 << 63) - 1


def saturating_add(a: Column, b: Column) -> Column:
    """a + b of nonnegative numbers, held at the largest BIGINT."""
    return F.when(a.isNotNull() & b.isNotNull(), F.coalesce(F.try_add(a, b), F.lit(MOST)))


def saturating_multiply(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.coalesce(F.try_multiply(a, b), F.lit(MOST)))


# -- states ------------------------------------------------------------------------------------


def is_terminal(state: Column) -> Column:
    return state.isin(*TERMINAL)


def is_valid_transition(before: Column, after: Column) -> Column:
    legal = [f"{a}>{b}" for a, b in TRANSITIONS]
    return F.coalesce(F.concat(before, F.lit(">"), after).isin(*legal), F.lit(False))


def successors(state: Column) -> Column:
    """States that may follow, in canonical order; empty for terminal ones."""
    ordered = {a: [s for s in STATES if s in out] for a, out in SUCCESSORS.items()}
    none = F.array().cast("array<string>")
    expr = none
    for a, out in ordered.items():
        expr = F.when(state == a, F.array(*map(F.lit, out))).otherwise(expr)
    return expr


def display_name(state: Column) -> Column:
    """snake_case name."""
    return F.lower(F.regexp_replace(state, "(?<=[a-z])([A-Z])", "_$1"))


def block_reason(state: Column) -> Column:
    """Why a run is not to be dispatched: null for Ready, 'terminal', or the state's name."""
    return F.when(state == "Ready", F.lit(None).cast("string")).when(is_terminal(state), "terminal").otherwise(display_name(state))


def cancel_outcome(state: Column, canceled_at: Column | None = None) -> Column:
    """What a cancel request does: already_canceled, already_terminal or canceled."""
    out = F.when(state == "Canceled", "already_canceled").when(is_terminal(state), "already_terminal").otherwise("canceled")
    return out if canceled_at is None else F.when(canceled_at.isNotNull(), "already_canceled").otherwise(out)


# -- due and expired ---------------------------------------------------------------------------


def is_due(scheduled_at: Column, now: Column) -> Column:
    return scheduled_at <= now


def lease_expired(expiry: Column, now: Column) -> Column:
    """The second of expiry counts as expired."""
    return now >= expiry


def lease_renewal_due(expiry: Column, now: Column, timeout: int) -> Column:
    """A lease is renewed from a third of its time (a second at least) before it ends."""
    return saturating_add(now, F.lit(max(timeout // 3, 1)).cast("long")) >= expiry


def heartbeat_deadline(last: Column, interval: Column, multiplier: int = 3) -> Column:
    return saturating_add(last, saturating_multiply(interval, F.lit(multiplier).cast("long")))


def heartbeat_timed_out(last: Column, interval: Column, now: Column, multiplier: int = 3) -> Column:
    return now >= heartbeat_deadline(last, interval, multiplier)


def scheduling_lag(state: Column, scheduled_at: Column, now: Column) -> Column:
    """Seconds past the schedule, for states that lag is reported of; else null."""
    return F.when(state.isin(*LAG_STATES), F.greatest(now - scheduled_at, F.lit(0)))


# -- retries and timeouts ----------------------------------------------------------------------


def fixed_backoff_ms(interval_ms: int) -> Column:
    return F.lit(interval_ms).cast("long")


def exponential_backoff_ms(attempt: Column, base_ms: int, max_ms: int) -> Column:
    """base * 2^(attempt - 1), at most max_ms; a shift too large for BIGINT saturates."""
    exponent = F.greatest(attempt - 1, F.lit(0))
    doubled = F.when(exponent < 63, F.call_function("shiftleft", F.lit(1).cast("long"), exponent.cast("int"))).otherwise(F.lit(MOST))
    return F.least(saturating_multiply(F.lit(base_ms).cast("long"), doubled), F.lit(max_ms).cast("long"))


def retry_ready_at(entered: Column, delay_ms: Column) -> Column:
    """Seconds are rounded up."""
    return saturating_add(entered, F.ceil(delay_ms.cast("decimal(20,0)") / 1000).cast("long"))


def effective_attempt(attempt: Column, suspensions: Column) -> Column:
    """Attempts that ended in suspension do not count against the cap."""
    return attempt - suspensions


def retry_decision(result: Column, attempt: Column, max_attempts: Column) -> Column:
    """Suspend, Complete, Fail, Retry, or an error word for numbers that cannot be."""
    return (
        F.when(result == "Suspended", "Suspend")
        .when(max_attempts < 1, "invalid_max_attempts")
        .when(attempt < 1, "invalid_attempt_number")
        .when(attempt > max_attempts, "attempt_exceeds_cap")
        .when(result == "Success", "Complete")
        .when(result == "TerminalFailure", "Fail")
        .when(result.isin("RetryableFailure", "Timeout"), F.when(attempt < max_attempts, "Retry").otherwise("Fail"))
    )


def timeout_class(timeout: Column, elapsed: Column) -> Column:
    """An attempt is late only beyond its limit."""
    return F.when(timeout.isNull(), "NotConfigured").when(elapsed > timeout, "TimedOut").otherwise("InTime")


def response_class(response: Column, timed_out: Column) -> Column:
    """A timeout overrides every response but a suspension."""
    return F.when(timed_out & (response != "Suspended"), "Timeout").otherwise(response)


def attempt_result(response: Column) -> Column:
    """What the log records: retryable and terminal failures are both Failure."""
    return F.when(response.isin("RetryableFailure", "TerminalFailure"), "Failure").otherwise(response)


def timeout_text(timeout: Column) -> Column:
    return F.format_string("attempt timed out after %ds", timeout)


def timeout_cooperation(timed_out: Column, observed: Column, latency_ms: Column, cadence_ms: int = 250) -> Column:
    return (
        F.when(~timed_out, "NotApplicable")
        .when(~observed | latency_ms.isNull(), "NonCooperative")
        .when(latency_ms > cadence_ms, "ThresholdBreach")
        .otherwise("Cooperative")
    )


# -- capabilities, budgets, policies -----------------------------------------------------------


def capabilities_match(required: Column, offered: Column) -> Column:
    """Every required capability is offered; nothing required matches all."""
    none = F.array().cast("array<string>")
    return F.size(F.array_except(F.coalesce(required, none), F.coalesce(offered, none))) == 0


def capability_key(kind: Column, custom: Column) -> Column:
    return F.when(kind == "Custom", F.concat(F.lit("Custom:"), custom)).otherwise(kind)


def threshold_pct(consumed: Column, limit: Column) -> Column:
    """Whole percents of the limit, at most 100; a limit of 0 is used up."""
    used = F.least(consumed, limit)
    return F.when(limit == 0, F.lit(100).cast("long")).otherwise(F.floor(saturating_multiply(used, F.lit(100).cast("long")).cast("decimal(38,0)") / limit).cast("long"))


def budget_remaining(consumed: Column, limit: Column) -> Column:
    return F.greatest(limit - consumed, F.lit(0))


def policy_kind(text: Column) -> Column:
    return F.lower(F.split_part(text, F.lit(":"), F.lit(1)))


def parse_policy(text: Column) -> Column:
    """once, repeat:COUNT:SECONDS or cron:EXPRESSION as a struct; a null struct where it is none of them."""
    kind = policy_kind(text)
    rest = F.when(F.instr(text, ":") > 0, F.substring(text, F.instr(text, ":") + 1, F.length(text)))
    count = F.regexp_extract(rest, r"^(\d+):(\d+)$", 1).try_cast("long")
    interval = F.regexp_extract(rest, r"^(\d+):(\d+)$", 2).try_cast("long")
    none = F.lit(None)

    def made(policy: str, n: Column, secs: Column, expr: Column) -> Column:
        return F.struct(
            F.lit(policy).alias("policy"), n.cast("long").alias("repeat_count"), secs.cast("long").alias("interval_secs"), expr.cast("string").alias("cron_expr")
        )

    return (
        F.when((kind == "once") & rest.isNull(), made("once", none, none, none))
        .when((kind == "repeat") & (count >= 1) & (interval >= 1), made("repeat", count, interval, none))
        .when((kind == "cron") & (F.length(F.trim(rest)) > 0), made("cron", none, none, F.trim(rest)))
    )


def format_policy(policy: Column, count: Column, interval: Column, expr: Column) -> Column:
    return F.when(policy == "once", "once").when(policy == "repeat", F.concat_ws(":", policy, count, interval)).when(policy == "cron", F.concat_ws(":", policy, expr))


def task_violation(max_attempts: Column, timeout: Column, key: Column, capabilities: Column, count: Column, interval: Column, policy: Column) -> Column:
    """The first rule that a task's constraints break, or null."""
    return (
        F.when(max_attempts < 1, "max_attempts")
        .when(timeout == 0, "timeout")
        .when(F.trim(key) == "", "concurrency_key")
        .when(F.size(capabilities) == 0, "required_capabilities")
        .when((policy == "repeat") & ((count < 1) | (interval < 1) | count.isNull() | interval.isNull()), "repeat_policy")
    )

