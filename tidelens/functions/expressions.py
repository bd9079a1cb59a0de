"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def epoch_ms(column: str) -> Column:
    """Milliseconds since the epoch of a timestamp without time zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MILLISECOND, {EPOCH}, cast({column} as timestamp_ntz))")


def floor_to(value: Column | str, step: int) -> Column:
    """The largest multiple of ``step`` that is not above a bigint value, negative ones too."""
    value = F.col(value) if isinstance(value, str) else value
    return value - F.pmod(value, F.lit(step).cast("bigint"))


def overlaps(a0: str, a1: str, b0: str, b1: str) -> Column:
    """Closed intervals that have a point in common."""
    return (F.col(a0) <= F.col(b1)) & (F.col(b0) <= F.col(a1))


def applies_to(scope: str, channel: str) -> Column:
    """Whether an event's scope covers a channel; an empty scope is the whole fleet."""
    return (F.size(scope) == 0) | F.array_contains(F.col(scope), F.col(channel))


def grade(missing: str, duplicates: str, regressions: str, max_lag_ms: str, grade_lag: bool = True) -> Column:
    """Severity of a health window from its counts and, unless told otherwise, its lag. The limits are fixed values."""
    m, d, r, lag = (F.col(c) for c in (missing, duplicates, regressions, max_lag_ms))
    lag = lag if grade_lag else F.lit(0)
    return (
        F.when((m >= 100) | (d >= 100) | (lag >= 120_000), "critical")
        .when((m >= 1) | (d >= 1) | (r > 0) | (lag >= 30_000), "warning")
        .when(lag >= 5_000, "info")
        .otherwise("ok")
    )


def disturbed(detail: str, severity: str, least: str = "warning") -> Column:
    """Whether a pipeline event's detail shows missing, duplicate or reordered readings; without a count, its severity decides."""
    pairs = F.expr(f"str_to_map(coalesce({detail}, ''), ' ', '=')")
    counts = [F.expr(f"try_cast(element_at(str_to_map(coalesce({detail}, ''), ' ', '='), '{k}') AS BIGINT)") for k in ("missing", "duplicates", "reordered")]
    any_count = F.greatest(*[F.coalesce(c, F.lit(0)) for c in counts]) > 0
    rank = F.array_position(F.array(*[F.lit(x) for x in ("info", "warning", "critical")]), F.col(severity))
    floor = ("info", "warning", "critical").index(least) + 1
    return any_count | (~F.map_contains_key(pairs, F.lit("missing")) & (rank >= floor))


def nearest_rank(values: Column, share: float) -> Column:
    """The value at place min(int(n * share), n - 1) of an array in ascending order, null for an empty one."""
    n = F.size(values)
    place = F.least(F.floor(n * F.lit(share)).cast("int"), n - 1)
    return F.when(n > 0, F.element_at(F.array_sort(values), place + 1))
