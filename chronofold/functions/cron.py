"""Cron occurrences, in UTC, as a table function.

An expression has seven fields: second, minute, hour, day of month, month, day of week (1 is
Sunday) and year; the year may be left out.
"""

from __future__ import annotations

import datetime as dt
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Field ranges and names.
_RANGES = ((0, 59), (0, 59), (0, 23), (1, 31), (1, 12), (1, 7), (1970, 2100))
_NAMES = {
    4: {n: i for i, n in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)},
    5: {n: i for i, n in enumerate("sun mon tue wed thu fri sat".split(), 1)},
}
#: Occurrences of a cron task that wait at any time.
WINDOW = 5


def _values(field: str, k: int) -> frozenset[int]:
    low, high = _RANGES[k]
    names = _NAMES.get(k, {})

    def number(text: str) -> int:
        value = names.get(text.lower()[:3]) if text.isalpha() else int(text)
        if value is None or not low <= value <= high:
            raise ValueError(f"cron field {field!r} is out of range")
        return value

    out: set[int] = set()
    for part in field.split(","):
        body, _, step = part.partition("/")
        if body in ("*", "?"):
            first, last = low, high
        elif "-" in body:
            first, last = map(number, body.split("-"))
        else:
            first = number(body)
            last = high if step else first
        if first > last or step == "0":
            raise ValueError(f"cron field {field!r} is empty")
        out |= set(range(first, last + 1, int(step) if step else 1))
    return frozenset(out)


@lru_cache(maxsize=10_000)
def parse(expression: str) -> tuple[frozenset[int], ...]:
    fields = expression.split()
    if len(fields) not in (6, 7):
        raise ValueError(f"a cron expression has 6 or 7 fields: {expression!r}")
    return tuple(_values(f, k) for k, f in enumerate([*fields, *["*"] * (7 - len(fields))]))


def next_occurrences(expression: str, after: int, n: int) -> list[int]:
    """The next n epoch seconds strictly after ``after``; fewer where the years end."""
    seconds, minutes, hours, days, months, weekdays, years = parse(expression)
    start = dt.datetime.fromtimestamp(after, dt.UTC)
    day, out = start.date(), []
    clock = sorted(h * 3600 + m * 60 + s for h in hours for m in minutes for s in seconds) if len(hours) * len(minutes) * len(seconds) <= 4000 else None
    while len(out) < n and day.year <= max(years):
        if day.year not in years or day.month not in months:
            day = (day.replace(day=1) + dt.timedelta(days=32)).replace(day=1)
            continue
        if day.day in days and day.isoweekday() % 7 + 1 in weekdays:
            midnight = int(dt.datetime(day.year, day.month, day.day, tzinfo=dt.UTC).timestamp())
            times = clock if clock is not None else (h * 3600 + m * 60 + s for h in sorted(hours) for m in sorted(minutes) for s in sorted(seconds))
            for t in times:
                if midnight + t > after:
                    out.append(midnight + t)
                    if len(out) == n:
                        break
        day += dt.timedelta(days=1)
    return out


def _occurrences(expression: str | None, after: float | None, n: float | None) -> list[int]:
    if not expression or pd.isna(after) or pd.isna(n) or n < 1:
        return []
    try:
        return next_occurrences(expression, int(after), int(n))
    except ValueError:
        return []


def with_occurrences(tasks: DataFrame, expression: str = "cron_expr", after: str = "after", n: str = "n") -> DataFrame:
    """A row of ``scheduled_at`` for each of the next n occurrences of each row; an expression that does not parse has none."""

    @F.pandas_udf("array<bigint>")
    def occurrences(texts: pd.Series, starts: pd.Series, counts: pd.Series) -> pd.Series:
        return pd.Series([_occurrences(*row) for row in zip(texts, starts, counts, strict=True)], dtype=object)

    return tasks.select("*", F.explode(occurrences(F.col(expression), F.col(after), F.col(n))).alias("scheduled_at"))
