"""Sources of context events, which may be unavailable: no events and no source are different things."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = ["event_id", "kind", "t_start_ms", "t_end_ms", "severity", "detail", "scope"]


@dataclass(frozen=True)
class Context:
    """Any DataFrame of context events (``FIELDS``, and ``ord`` for their order) is a source; ``available`` says whether it could be read."""

    events: DataFrame
    available: bool = True


def tail(events: DataFrame, retain_ms: int = 3_600_000, available: bool = True) -> Context:
    """The events of a topic that ended no more than ``retain_ms`` before the newest end."""
    top = events.agg(F.max("t_end_ms").alias("__top"))
    return Context(events.join(F.broadcast(top)).where(F.col("t_end_ms") >= F.col("__top") - retain_ms).drop("__top"), available)


def joint(*sources: Context) -> Context:
    """The events of all sources, in their order; unavailable if any of them is."""
    named = [s.events.withColumn("__source", F.lit(i)) for i, s in enumerate(sources)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)
    return Context(both.drop("__source"), all(s.available for s in sources))
