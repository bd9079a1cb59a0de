"""Which episodes an operational event explains."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelens.functions.expressions import applies_to, disturbed
from tidelens.operators.intervals import overlap_join, siblings

#: How informative a rejection is, the most first.
REJECTIONS = ["fault_domain", "narrow_blast_radius", "isolated", "implausible", "out_of_scope"]


def overlapping(episodes: DataFrame, context: DataFrame, bucket_ms: int) -> DataFrame:
    """Episodes with each context event that they overlap, in scope or not (``in_scope``)."""
    c = context.select("event_id", "kind", F.col("t_start_ms").alias("c_start_ms"), F.col("t_end_ms").alias("c_end_ms"), "severity", "detail", "scope", "ord")
    j = overlap_join(episodes, c, ("t_start_ms", "t_end_ms"), ("c_start_ms", "c_end_ms"), bucket_ms)
    return j.withColumn("in_scope", applies_to("scope", "channel"))


def footprint(sets: DataFrame, channels: str, topology: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """Numbers of nodes and racks that an array of channels touches, and of channels without a place."""
    one = sets.select(*keys, F.explode(channels).alias("__channel"))
    t = topology.select(F.col("channel").alias("__channel"), "node", "rack")
    return one.join(t, "__channel", "left").groupBy(*keys).agg(
        F.count_distinct("node").alias(f"{prefix}_nodes"), F.count_distinct("rack").alias(f"{prefix}_racks"),
        F.sum(F.col("node").isNull().cast("int")).alias(f"{prefix}_unplaced"),
    )


def event_verdicts(episodes: DataFrame, context: DataFrame, topology: DataFrame, bucket_ms: int, synchrony_ms: int, least_share: float = 0.25) -> DataFrame:
    """The verdict of every overlapping event on an episode.

    Pipeline events explain it if they were disturbed. A deploy explains it if enough of its scope began with it, on
    as many nodes and racks as the deploy reached; otherwise the verdict says what is lacking.
    """
    j = overlapping(episodes, context, bucket_ms).join(siblings(episodes, synchrony_ms).select("channel", "t_start_ms", "siblings"), ["channel", "t_start_ms"])
    inside = F.when(F.size("scope") == 0, F.col("siblings")).otherwise(F.array_intersect("siblings", "scope"))
    j = j.withColumn("siblings", F.array_remove(inside, F.col("channel"))).withColumn("corroboration", F.size("siblings") + 1)
    j = j.withColumn("perturbed", F.array_union("siblings", F.array("channel"))).withColumn("scope_size", F.when(F.size("scope") == 0, F.col("corroboration")).otherwise(F.size("scope")))
    fleet_racks = topology.agg(F.count_distinct("rack").alias("fleet_racks"), F.count_distinct("node").alias("fleet_nodes"))
    key = ["channel", "t_start_ms", "event_id"]
    observed = footprint(j, "perturbed", topology, key, "observed")
    declared = footprint(j.where("size(scope) > 0").select("event_id", "scope").distinct(), "scope", topology, ["event_id"], "declared")
    j = j.join(observed, key).join(declared, "event_id", "left").join(F.broadcast(fleet_racks))
    j = j.withColumn("declared_nodes", F.coalesce("declared_nodes", "fleet_nodes")).withColumn("declared_racks", F.coalesce("declared_racks", "fleet_racks"))
    known = (F.col("fleet_nodes") > 0) & (F.col("observed_unplaced") == 0)
    enough = (F.col("corroboration") >= 2) & (F.col("corroboration") >= least_share * F.col("scope_size"))
    verdict = (
        F.when(~F.col("in_scope"), "out_of_scope")
        .when((F.col("kind") == "pipeline") & disturbed("detail", "severity"), "pipeline_disturbed")
        .when(F.col("kind") == "pipeline", "implausible")
        .when(~enough, "isolated")
        .when(known & (F.col("declared_nodes") < 2), "narrow_blast_radius")
        .when(known & (F.col("observed_nodes") < 2), "fault_domain")
        .when(known & (F.col("fleet_racks") > 1) & (F.col("observed_racks") == 1) & (F.col("declared_racks") != 1), "fault_domain")
        .otherwise("corroborated")
    )
    return j.withColumn("verdict", verdict).select(*key, "kind", "ord", "corroboration", "verdict")


def decide(episodes: DataFrame, verdicts: DataFrame, available: bool = True) -> DataFrame:
    """One verdict an episode: the first event that explains it (pipeline events last), else the most informative rejection."""
    attributed = F.col("verdict").isin("pipeline_disturbed", "corroborated")
    rank = F.when(attributed, 0).otherwise(F.array_position(F.array(*[F.lit(x) for x in REJECTIONS]), F.col("verdict")))
    order = F.struct(rank.cast("int").alias("rank"), (F.col("kind") == "pipeline").alias("p"), "ord", "event_id")
    best = verdicts.groupBy("channel", "t_start_ms").agg(F.min_by(F.struct("verdict", "event_id", attributed.alias("hit")), order).alias("v"))
    e = episodes.join(best, ["channel", "t_start_ms"], "left")
    missing = F.lit("no_context" if available else "fail_open")
    hit = F.coalesce(F.col("v.hit"), F.lit(False)) & F.lit(available)
    return e.withColumns({
        "verdict": F.coalesce("v.verdict", missing) if available else missing,
        "status": F.when(hit, "attributed").otherwise("real"),
        "attributed_to": F.when(hit, F.col("v.event_id")),
    }).drop("v")


def second_opinions(episodes: DataFrame, scores: DataFrame, agrees_at: float = 3.0, bucket_ms: int = 86_400_000) -> DataFrame:
    """What a second detector's scores (``channel, start_ms, end_ms, score``) say of each episode: agrees, dissents or abstains."""
    s = scores.select("channel", F.col("start_ms").alias("s0"), F.col("end_ms").alias("s1"), "score")
    progress = s.groupBy("channel").agg(F.max("s1").alias("progress"))
    j = overlap_join(episodes.select("channel", "t_start_ms", "t_end_ms"), s, ("t_start_ms", "t_end_ms"), ("s0", "s1"), bucket_ms, ["channel"])
    best = j.groupBy("channel", "t_start_ms").agg(F.max("score").alias("best"))
    e = episodes.select("channel", "t_start_ms", "t_end_ms").join(best, ["channel", "t_start_ms"], "left").join(progress, "channel", "left")
    opinion = F.when(F.col("best") >= agrees_at, "agrees").when(F.col("best").isNull() | (F.col("progress") < F.col("t_end_ms")), "abstains").otherwise("dissents")
    return e.select("channel", "t_start_ms", opinion.alias("opinion"), "best")


def shoulders(episodes: DataFrame, scores: DataFrame, threshold: float, fraction: float) -> DataFrame:
    """Windows that end by the episode's start, the newest first, up to the first below ``fraction`` of the threshold.

    Each window knows the length of the run of high windows that it ends; an episode takes that of the last window before it.
    """
    fails = (F.col("score") < threshold * fraction).cast("int")
    order = Window.partitionBy("channel").orderBy("start_ms")
    s = scores.select("channel", "start_ms", "end_ms", fails.alias("fails")).withColumn("part", F.sum("fails").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    run = F.sum(1 - F.col("fails")).over(Window.partitionBy("channel", "part").orderBy("start_ms").rowsBetween(Window.unboundedPreceding, 0))
    ends = s.select("channel", F.col("end_ms").alias("t"), run.alias("run"), F.lit(None).cast("bigint").alias("t_start_ms"))
    both = ends.unionByName(episodes.select("channel", F.col("t_start_ms").alias("t"), F.lit(None).cast("bigint").alias("run"), "t_start_ms"))
    before = Window.partitionBy("channel").orderBy("t", F.col("t_start_ms").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
    out = both.withColumn("shoulder", F.coalesce(F.last("run", ignorenulls=True).over(before), F.lit(0)))
    return out.where("t_start_ms IS NOT NULL").select("channel", "t_start_ms", "shoulder")


def finish(decided: DataFrame, opinions: DataFrame, persistence: DataFrame, protects: bool = True, persistence_protects: bool = False) -> DataFrame:
    """Second opinion, then persistence, on top of the context's verdict. Failing open is never overruled into silence."""
    d = decided.join(opinions.select("channel", "t_start_ms", "opinion"), ["channel", "t_start_ms"], "left").join(persistence, ["channel", "t_start_ms"], "left")
    open_ = F.col("verdict") == "fail_open"
    back = (F.col("opinion") == "agrees") & (F.col("status") == "attributed") & F.lit(protects)
    drop = (F.col("opinion") == "dissents") & (F.col("status") == "real") & ~open_
    d = d.withColumns({
        "verdict": F.when(back, "second_opinion_agrees").when(drop, "second_opinion_dissents").otherwise(F.col("verdict")),
        "status": F.when(back, "real").when(drop, "attributed").otherwise(F.col("status")),
        "attributed_to": F.when(back | drop, F.lit(None).cast("string")).otherwise(F.col("attributed_to")),
    })
    lasting = (F.col("window_count") >= 2) | (F.col("recurrences") > 0) | (F.col("shoulder") > 0)
    flicker = ~lasting & (F.col("status") == "real") & (F.col("verdict") != "fail_open")
    again = lasting & (F.col("status") == "attributed") & F.lit(persistence_protects)
    return d.withColumns({
        "attributed_to": F.when(flicker | again, F.lit(None).cast("string")).otherwise(F.col("attributed_to")),
        "status": F.when(flicker, "attributed").when(again, "real").otherwise(F.col("status")),
        "verdict": F.when(flicker, "no_persistence").when(again, "persistent").otherwise(F.col("verdict")),
    })


def release(episodes: DataFrame, evidence_ms: int, buffer_ms: int) -> DataFrame:
    """Episodes in order of onset, with whether the evidence has passed the onset by the buffer."""
    began = F.coalesce("onset_ms", "t_start_ms")
    e = episodes.select("channel", "t_start_ms", began.alias("began_ms"), (began + buffer_ms <= evidence_ms).alias("released"))
    return e.orderBy("began_ms", "channel", "t_start_ms")


def evidence_watermark(fleet: DataFrame, second: DataFrame) -> DataFrame:
    """Event time up to which all that a verdict needs has come: the lesser of two watermarks (``watermark_ms``), null if either is."""
    j = fleet.select(F.col("watermark_ms").alias("fleet_ms")).join(second.select(F.col("watermark_ms").alias("second_ms")))
    both = F.col("fleet_ms").isNotNull() & F.col("second_ms").isNotNull()
    return j.withColumn("watermark_ms", F.when(both, F.least("fleet_ms", "second_ms")))
