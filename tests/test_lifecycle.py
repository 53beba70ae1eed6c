import itertools

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronofold.functions import cron
from chronofold.functions import lifecycle as L
from chronofold.model import STATES, TERMINAL, TRANSITIONS


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def long(x):
    return F.lit(x).cast("long")


def test_transitions(spark):
    pairs = list(itertools.product(STATES, STATES))
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", L.is_valid_transition(F.col("a"), F.col("b")).alias("ok"), L.successors(F.col("a")).alias("s")).collect()
    legal = {(r.a, r.b) for r in rows if r.ok}
    assert legal == set(TRANSITIONS) and len(legal) == 17
    assert not any(a in TERMINAL or a == b for a, b in legal)
    assert {r.a: r.s for r in rows}["Running"] == ["RetryWait", "Suspended", "Completed", "Failed", "Canceled"]
    assert {r.a: r.s for r in rows}["Failed"] == []


def test_backoff(spark):
    delays = [L.exponential_backoff_ms(long(n), 1000, 10_000) for n in (1, 4, 5, 100)]
    assert one(spark, *delays) == (1000, 8000, 10_000, 10_000)
    assert one(spark, L.retry_ready_at(long(1000), L.fixed_backoff_ms(500)), L.retry_ready_at(long(1000), long(2000)), L.retry_ready_at(long(L.MOST), long(2000))) == (1001, 1002, L.MOST)


def test_retry_table(spark):
    got = one(spark, *[L.retry_decision(F.lit(r), F.lit(a), F.lit(m)) for r, a, m in (
        ("Success", 1, 3), ("TerminalFailure", 1, 3), ("RetryableFailure", 1, 3), ("Timeout", 2, 3), ("RetryableFailure", 3, 3), ("Timeout", 1, 1),
        ("Success", 4, 3), ("Suspended", 9, 3), ("Success", 1, 0), ("Success", 0, 1),
    )])
    assert got == ("Complete", "Fail", "Retry", "Retry", "Fail", "Fail", "attempt_exceeds_cap", "Suspend", "invalid_max_attempts", "invalid_attempt_number")


def test_boundaries(spark):
    assert one(spark, L.lease_expired(long(10), long(10)), L.lease_expired(long(10), long(9))) == (True, False)
    beat = lambda last, now: L.heartbeat_timed_out(long(last), long(10), long(now))
    assert one(spark, beat(1000, 1029), beat(1000, 1030), beat(1025, 1054)) == (False, True, False)
    assert one(spark, L.timeout_class(long(5), long(5)), L.timeout_class(long(5), long(6)), L.timeout_class(F.lit(None).cast("long"), long(9))) == ("InTime", "TimedOut", "NotConfigured")
    assert one(spark, L.response_class(F.lit("Success"), F.lit(True)), L.response_class(F.lit("Suspended"), F.lit(True))) == ("Timeout", "Suspended")
    assert one(spark, L.timeout_text(long(7)), L.attempt_result(F.lit("TerminalFailure"))) == ("attempt timed out after 7s", "Failure")


def test_capabilities_and_budgets(spark):
    have = F.array(F.lit("compute"))
    both = F.array(F.lit("compute"), F.lit("review"))
    none = F.array().cast("array<string>")
    assert one(spark, L.capabilities_match(both, have), L.capabilities_match(none, have), L.capabilities_match(have, both), L.capabilities_match(F.lit(None).cast("array<string>"), none)) == (False, True, True, True)
    pct = [L.threshold_pct(long(a), long(b)) for a, b in ((90, 100), (160, 200), (20, 50), (7, 0), (300, 200))]
    assert one(spark, *pct) == (90, 80, 40, 100, 100)
    assert one(spark, L.budget_remaining(long(150), long(100)), L.capability_key(F.lit("Custom"), F.lit("x")), L.capability_key(F.lit("CanSubmit"), F.lit(None).cast("string"))) == (0, "Custom:x", "CanSubmit")


def test_names_and_policies(spark):
    assert one(spark, L.display_name(F.lit("RetryWait")), L.block_reason(F.lit("Ready")), L.block_reason(F.lit("Failed")), L.block_reason(F.lit("Leased"))) == ("retry_wait", None, "terminal", "leased")
    assert one(spark, L.cancel_outcome(F.lit("Canceled")), L.cancel_outcome(F.lit("Failed")), L.cancel_outcome(F.lit("Ready"))) == ("already_canceled", "already_terminal", "canceled")
    got = one(spark, *[L.parse_policy(F.lit(t)) for t in ("once", "Repeat:3:60", "cron:0 0 * * * * *", "repeat:0:60", "weekly", "repeat:3")])
    assert got[0].policy == "once" and tuple(got[1]) == ("repeat", 3, 60, None) and got[2].cron_expr == "0 0 * * * * *" and got[3:] == (None, None, None)
    assert one(spark, L.format_policy(F.lit("repeat"), long(3), long(60), F.lit(None).cast("string"))) == ("repeat:3:60",)


def test_cron_fields():
    assert cron.next_occurrences("0 */15 * * * * *", 0, 3) == [900, 1800, 2700]
    assert cron.next_occurrences("0 0 0 1 jan ? 1971-1972", 0, 5) == [31_536_000, 63_072_000]
    assert cron.next_occurrences("30 0 12 * * mon", 0, 1) == [4 * 86_400 + 43_230]  # 1970-01-05 was a Monday
    for bad in ("* * * *", "61 * * * * *", "0 0 0 * foo *", "5-1 * * * * *"):
        try:
            cron.parse(bad)
        except ValueError:
            continue
        raise AssertionError(bad)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2_000_000_000), st.sampled_from(["*/7 * * * * *", "0 0 9-17/2 * * 2-6", "5,10 30 */6 1,15 * *"]))
def test_cron_is_strictly_after_and_rising(after, expression):
    times = cron.next_occurrences(expression, after, 6)
    assert len(times) == 6 and times[0] > after and times == sorted(set(times))
    assert cron.next_occurrences(expression, times[2], 3) == times[3:6]
