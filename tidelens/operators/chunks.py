"""Running totals, maxima and neighbours of long ordered series, chunk by chunk.

A window over a whole series puts it into one task. Here rows are dealt to chunks of the order, a chunk's summary (one
row) is carried to the chunks behind it, and the window runs inside each chunk. ``order`` is a bigint column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelens.functions.expressions import floor_to

#: Width of a chunk in units of the order, unless an operator says otherwise.
CHUNK = 1 << 20


def running(rows: DataFrame, order: str, values: dict[str, tuple[str, Column]], keys: tuple[str, ...] = (), chunk: int = CHUNK, current: bool = False, ties: tuple = ()) -> DataFrame:
    """``rows`` with columns of running aggregates over the rows before each (with ``current``: and itself).

    ``values`` names them: ``{name: ("max" | "min" | "sum", column)}``. A maximum or minimum of nothing is null, a sum 0.
    Rows of equal order go by the columns ``ties``.
    """
    of = {"max": F.max, "min": F.min, "sum": F.sum}
    both = {"max": F.greatest, "min": F.least, "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))}
    r = rows.withColumn("__c", floor_to(order, chunk))
    r = r.withColumns({f"__v_{n}": v for n, (_, v) in values.items()})
    own = r.groupBy(*keys, "__c").agg(*[of[how](f"__v_{n}").alias(f"__t_{n}") for n, (how, _) in values.items()])
    before = Window.partitionBy(*keys).orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    carried = own.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__c").alias("__of"), *[of[how](f"__t_{n}").over(before).alias(f"__b_{n}") for n, (how, _) in values.items()])
    same = F.col("__c") == F.col("__of")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    here = Window.partitionBy(*keys, "__c").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow if current else -1)
    r = r.join(carried, same)
    return r.select(*[F.col(f"`{c}`") for c in rows.columns], *[both[how](F.col(f"__b_{n}"), of[how](f"__v_{n}").over(here)).alias(n) for n, (how, _) in values.items()])


def previous(rows: DataFrame, order: str, value: str, name: str, keys: tuple[str, ...] = (), chunk: int = CHUNK) -> DataFrame:
    """``rows`` with the ``value`` of the row before each in a unique ``order``, null for the first."""
    last = running(rows, order, {"__p": ("max", F.struct(F.col(order), F.col(value)))}, keys, chunk)
    return last.withColumn(name, F.col(f"__p.{value}")).drop("__p")
