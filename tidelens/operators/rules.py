"""The rule dataflow on episodes: diagnosis, plan and safety gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Channels that are never acted on, and what is offered for each symptom, in order, after the two reads.
PROTECTED = ["safety", "interlock", "fire", "emergency"]
OFFERS = {
    "safety_channel": ["describe_channel", "escalate_to_human"],
    "isolated_spike": ["describe_channel", "fetch_recent_readings", "annotate_episode"],
    "variance_burst": ["describe_channel", "fetch_recent_readings", "silence_channel", "raise_ticket"],
    "level_shift": ["describe_channel", "fetch_recent_readings", "request_recalibration", "raise_ticket"],
}
READS = ["describe_channel", "fetch_recent_readings", "fetch_pipeline_health", "search_runbooks"]
#: Actions an episode may take, and reversible ones among them.
BUDGET, REVERSIBLE_BUDGET = 6, 2


def protected(channel: str):
    return F.exists(F.array(*[F.lit(x) for x in PROTECTED]), lambda x: F.contains(F.lower(F.col(channel)), x))


def diagnose(episodes: DataFrame) -> DataFrame:
    """``symptom`` of each episode (``window_count``, ``burst_windows``: those whose dispersion outweighs the mean)."""
    short = (F.col("window_count") <= 1) & (F.col("t_end_ms") - F.col("t_start_ms") <= 60_000)
    symptom = F.when(protected("channel"), "safety_channel").when(short, "isolated_spike").when(2 * F.col("burst_windows") > F.col("window_count"), "variance_burst").otherwise("level_shift")
    return episodes.withColumn("symptom", symptom)


def plan(diagnosed: DataFrame, licences: list[str] | str) -> DataFrame:
    """One row an action: what is offered for the symptom and licensed, in order; escalation if nothing is.

    ``licences`` are the same for all episodes, or the name of a column that holds an episode's own.
    """
    allowed = F.col(licences) if isinstance(licences, str) else F.array(*[F.lit(x) for x in licences]).cast("array<string>")
    offers = F.when(F.lit(False), F.array().cast("array<string>"))
    for symptom, actions in OFFERS.items():
        offers = offers.when(F.col("symptom") == symptom, F.array(*[F.lit(a) for a in actions]))
    d = diagnosed.withColumn("allowed", allowed).withColumn("offers", offers)
    kept = F.filter("offers", lambda x: F.array_contains("allowed", x))
    kept = F.when((F.size(kept) > 0), kept).otherwise(F.array(F.lit("escalate_to_human")))
    p = d.select("channel", "t_start_ms", "symptom", "status", F.posexplode(kept).alias("step", "action"))
    return p.withColumn("minutes", F.when(F.col("action") == "fetch_recent_readings", 60).when(F.col("action") == "silence_channel", 30))


def gate(actions: DataFrame) -> DataFrame:
    """``approved`` and ``reason`` of each action of an episode in order of ``step``.

    The first rule that fires decides. Budgets count what was approved before: escalations always are, reads and
    reversible actions up to their limits, so counts of earlier candidates by kind give the same as a fold.
    """
    order = Window.partitionBy("channel", "t_start_ms").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    escalate, read = F.col("action") == "escalate_to_human", F.col("action").isin(*READS)
    read_fails = F.when(read & F.col("minutes").isNotNull() & (F.col("minutes") <= 0), "missing_parameters").when(read & (F.col("minutes") > 240), "limit_exceeded")
    fails = (
        F.when(F.coalesce(F.col("status"), F.lit("")) != "real", "episode_not_actionable")
        .when(protected("channel"), "protected_channel")
        .when((F.col("action") == "silence_channel") & (F.coalesce("minutes", F.lit(0)) <= 0), "missing_parameters")
        .when((F.col("action") == "silence_channel") & (F.col("minutes") > 60), "limit_exceeded")
    )
    a = actions.withColumn("kind", F.when(escalate, "escalate_to_human").when(read, "read").otherwise("reversible"))
    a = a.withColumn("fails", F.when(F.col("kind") == "read", read_fails).when(F.col("kind") == "reversible", fails))
    fine = F.col("fails").isNull()
    own = F.sum(F.when((F.col("kind") == "reversible") & fine, 1).otherwise(0)).over(order)
    free = F.sum(F.when((F.col("kind") != "reversible") & fine, 1).otherwise(0)).over(order)
    a = a.withColumn("reversible", F.least(F.coalesce(own, F.lit(0)), F.lit(REVERSIBLE_BUDGET))).withColumn("taken", F.coalesce(free, F.lit(0)) + F.col("reversible"))
    reason = (
        F.when(F.col("kind") == "escalate_to_human", "escalation_always_allowed")
        .when(F.col("taken") >= BUDGET, "budget_exhausted")
        .when((F.col("kind") == "read") & fine, "read_only")
        .when(F.col("kind") == "read", F.col("fails"))
        .when(F.col("fails") == "episode_not_actionable", F.col("fails"))
        .when(F.col("reversible") >= REVERSIBLE_BUDGET, "budget_exhausted")
        .when(~fine, F.col("fails"))
        .otherwise("within_limits")
    )
    a = a.withColumn("reason", reason)
    return a.withColumn("approved", F.col("reason").isin("escalation_always_allowed", "read_only", "within_limits")).select("channel", "t_start_ms", "step", "action", "approved", "reason")


def dedup_cap(examples: DataFrame, cap: int = 400) -> DataFrame:
    """Of equal prompts the first (by ``ord``), then at most ``cap`` for each split and symptom, in order.

    The cap is the feature: a training set with that many examples of a kind.
    """
    e = examples.withColumn("digest", F.sha2("prompt", 256))
    e = e.withColumn("n", F.row_number().over(Window.partitionBy("digest").orderBy("ord"))).where("n = 1")
    return e.withColumn("n", F.row_number().over(Window.partitionBy("split", "symptom").orderBy("ord"))).where(F.col("n") <= cap)
