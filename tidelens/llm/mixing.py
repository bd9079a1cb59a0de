"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelens.llm._shared import WORD, materialise, need

#: Sub-ranges into which a level divides a source's ranks, levels, and rows of the source table that may be broadcast.
RANGES, LEVELS, BROADCAST_ROWS = 1024, 2, 100_000


def _name() -> Column:
    """What a row's random number hangs on: its doc_id, or without one its text."""
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("t"), F.md5(F.coalesce("text", F.lit("")))))


def _random_odds(seed: int, name: Column) -> Column:
    """U / (1 - U) with U in (0, 1), the same on every run: 48 bits of an MD5."""
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name)), 1, 12), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(2**48))
    return u / (F.lit(1.0) - u)


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3) -> DataFrame:
    """``source, size`` rows to one row a source: ``source_size``, ``docs`` (with words) and ``target``.

    Sources in code point order, null last, weigh ``weights`` in turn. Targets stop at ``most`` times the
    source's size; the excess goes to the others by weight until none is above. That is the level t with
    sum(min(cap, t * weight)) = total, found by filling sources in order of cap / weight.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.when(F.col("size") > 0, 1)).alias("docs"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    picks = F.array(*[F.lit(float(w)) for w in weights])
    s = s.withColumn("weight", F.element_at(picks, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * float(most))
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before, rest = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    s = s.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    s = s.withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(everything))
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return s.select("source", "source_size", "docs", target.alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3, seed: int = 7) -> DataFrame:
    """Columns of ``docs`` plus ``mix`` (size, source_size, target, copies): how often the mix takes each row.

    Size is the number of words. A source with target T and size S gives every document floor(T / S) whole
    copies for certain; what is left of T is a sample of fixed size in words. A document's inclusion odds are
    o = f / (1 - f) * sqrt(size / mean size) with f = T / S - floor(T / S), that is a target inclusion probability of
    o / (1 + o): f for a document of mean size, more for longer ones, never 1, so that few long documents do not
    decide a source alone. Documents are ranked by random odds over inclusion odds (Pareto order sampling) and taken
    in that order up to the rank whose running total of words comes nearest to what is left. Running totals come from counts in nested ranges of ranks, so no source is
    ever sorted as a whole.

    Needs ``doc_id``, ``text`` and ``source``. Null and empty texts have size 0 and take part with 0 words; a
    null source is a source of its own; rows with one doc_id (or without any, and one text) and size share a rank and
    stand or fall together; an empty table gives an empty one.
    """
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("bigint")
    d = materialise(need(docs, "doc_id", "text", "source").select(_name().alias("name"), "source", size.alias("size")), "sizes")
    s = source_targets(d, weights, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    s = s.withColumn("whole", whole).withColumn("left", F.col("target") - F.col("whole") * F.col("source_size"))
    part = F.when(F.col("source_size") > 0, F.col("left") / F.col("source_size")).otherwise(0.0)
    s = s.withColumn("odds", part / (F.lit(1.0) - part)).withColumn("mean", F.when(F.col("docs") > 0, F.col("source_size") / F.col("docs")))
    s = materialise(s, "sources")
    small = s.count() <= BROADCAST_ROWS

    def with_source(rows: DataFrame, of: DataFrame, names: list[str]) -> DataFrame:
        o = of.select(F.struct(*names).alias("__mix"), F.col("source").alias("__mix_source"))
        o = F.broadcast(o) if small else o
        return rows.join(o, rows["source"].eqNullSafe(o["__mix_source"]), "left").drop("__mix_source")

    def rank(name: Column, size: Column) -> Column:
        """Random odds over inclusion odds; null where nothing is left to sample or the text has no words."""
        at = _random_odds(seed, name) / (F.col("__mix.odds") * F.sqrt(size / F.col("__mix.mean")))
        return F.when((size > 0) & (F.col("__mix.left") > 0), at)

    # Nested ranges of rank / (1 + rank): words before the range and the range where the total is passed.
    place = F.col("rank") / (F.lit(1.0) + F.col("rank"))
    r = with_source(d, s, ["odds", "mean", "left"]).withColumn("rank", rank(F.col("name"), F.col("size"))).where("rank is not null")
    r = r.select("source", "size", "rank", place.alias("place"))
    cut = s.withColumns({"lo": F.lit(0.0), "words": F.lit(0).cast("bigint")})
    ordered = Window.partitionBy("source").orderBy("range")
    for level in range(1, LEVELS + 1):
        width = 1.0 / RANGES**level
        inside = with_source(r, cut, ["lo", "words", "left"]).where(F.col("place") >= F.col("__mix.lo"))
        inside = inside if level == 1 else inside.where(F.col("place") < F.col("__mix.lo") + width * RANGES)
        n = F.floor((F.col("place") - F.col("__mix.lo")) / width).cast("bigint")
        sums = inside.groupBy("source", n.alias("range"), F.col("__mix.lo").alias("lo"), F.col("__mix.words").alias("words"), F.col("__mix.left").alias("left")).agg(F.sum("size").alias("n"))
        sums = sums.withColumn("after", F.col("words") + F.sum("n").over(ordered)).where(F.col("after") - F.col("n") <= F.col("left"))
        last = sums.groupBy("source").agg(F.max_by(F.struct((F.col("lo") + F.col("range") * width).alias("lo"), (F.col("after") - F.col("n")).alias("words"), "left"), F.col("range")).alias("c"))
        cut = materialise(last.select("source", "c.*"), "ranges")
    inside = with_source(r, cut, ["lo", "words", "left"]).where((F.col("place") >= F.col("__mix.lo")) & (F.col("place") < F.col("__mix.lo") + 1.0 / RANGES**LEVELS))
    peers = Window.partitionBy("source").orderBy("rank").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.groupBy("source", "rank", F.col("__mix.words").alias("words"), F.col("__mix.left").alias("left")).agg(F.sum("size").alias("n"))
    taken = inside.withColumn("after", F.col("words") + F.sum("n").over(peers)).where(F.col("after") - F.col("n") / F.lit(2.0) <= F.col("left"))
    # All ranks below the range are in; from the range itself those up to the last that brings the total nearer.
    last = taken.groupBy("source").agg(F.max("rank").alias("cut"))
    cut = cut.select(F.col("source").alias("cut_source"), "lo").join(last, F.col("cut_source").eqNullSafe(F.col("source")), "left").select("cut_source", "lo", "cut")
    s = materialise(s.join(cut, F.col("source").eqNullSafe(F.col("cut_source")), "left").drop("cut_source"), "cuts")

    at = rank(_name(), F.col("__mix_size"))
    sampled = (at / (F.lit(1.0) + at) < F.col("__mix.lo")) | (at <= F.col("__mix.cut"))
    copies = F.col("__mix.whole") + F.coalesce(sampled.cast("bigint"), F.lit(0).cast("bigint"))
    out = with_source(docs.withColumn("__mix_size", size), s, ["whole", "odds", "mean", "left", "lo", "cut", "source_size", "target"])
    plan = F.struct(F.col("__mix_size").alias("size"), F.col("__mix.source_size").alias("source_size"), F.col("__mix.target").alias("target"), copies.alias("copies"))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c != "mix"], plan.alias("mix"))


def mixed_rows(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as :func:`mix` takes it."""
    out = mix(docs, **how).where("mix.copies > 0")
    return out.withColumn("mix", F.explode(F.array_repeat(F.lit(1), F.col("mix.copies").cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns if c != "mix"])
