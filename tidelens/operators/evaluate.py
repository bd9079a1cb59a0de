"""Evaluation: precision-recall, alarm budgets, paired runs, parity and benchmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelens.functions.expressions import applies_to
from tidelens.operators.chunks import CHUNK, previous, running
from tidelens.operators.intervals import overlap_join

DAY = 86_400_000


def ranked(rows: DataFrame) -> DataFrame:
    """``pos, score, label`` with NaN scores last."""
    return rows.withColumn("score", F.when(F.isnan("score") | F.col("score").isNull(), float("-inf")).otherwise(F.col("score").cast("double")))


def pr_curve(rows: DataFrame) -> DataFrame:
    """``score, tp, fp, precision, recall`` at the end of each run of equal scores, highest first.

    Counts by distinct score come first, so the running totals see one row a score.
    """
    by = ranked(rows).groupBy("score").agg(F.sum("label").alias("p"), F.count("*").alias("n"))
    order = Window.orderBy(F.col("score").desc())
    by = by.withColumn("tp", F.sum("p").over(order)).withColumn("fp", F.sum(F.col("n") - F.col("p")).over(order)).withColumn("all", F.sum("p").over(Window.partitionBy()))
    recall = F.when(F.col("all") > 0, F.col("tp") / F.col("all")).otherwise(0.0)
    return by.select("score", "tp", "fp", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), recall.alias("recall"))


def auc_pr(rows: DataFrame) -> DataFrame:
    c = pr_curve(rows)
    gain = F.col("recall") - F.coalesce(F.lag("recall").over(Window.orderBy(F.col("score").desc())), F.lit(0.0))
    return c.withColumn("a", gain * F.col("precision")).agg(F.coalesce(F.sum("a"), F.lit(0.0)).alias("auc_pr"))


def roc_auc(rows: DataFrame) -> DataFrame:
    """Area under the ROC curve from mid-ranks; null without both labels."""
    by = ranked(rows).groupBy("score").agg(F.sum("label").alias("p"), F.count("*").alias("n"))
    before = Window.orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    by = by.withColumn("mid", F.coalesce(F.sum("n").over(before), F.lit(0)) + (F.col("n") + 1) / 2.0)
    t = by.agg(F.sum(F.col("mid") * F.col("p")).alias("r"), F.sum("p").alias("p"), F.sum(F.col("n") - F.col("p")).alias("q"))
    return t.select(F.when((F.col("p") > 0) & (F.col("q") > 0), (F.col("r") - F.col("p") * (F.col("p") + 1) / 2.0) / (F.col("p") * F.col("q"))).alias("roc_auc"))


def budget(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Precision, recall and F1 of the top rows, as many as there are positives (1 at least); ties by position.

    The cut is found among counts by score; only of the rows at the cut's score are positions looked at, chunk by chunk.
    """
    r = ranked(rows)
    by = r.groupBy("score").agg(F.sum("label").alias("p"), F.count("*").alias("n"))
    order = Window.orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)
    by = by.withColumn("all", F.sum("p").over(Window.partitionBy())).withColumn("budget", F.greatest(F.lit(1).cast("bigint"), F.col("all")))
    by = by.withColumn("n0", F.coalesce(F.sum("n").over(order), F.lit(0))).withColumn("p0", F.coalesce(F.sum("p").over(order), F.lit(0)))
    top = by.where("n0 < budget").groupBy("all", "budget").agg(F.max("n0").alias("n0"), F.max_by("p0", "n0").alias("p0"), F.max_by("score", "n0").alias("cut"), F.sum("n").alias("n"))
    tied = r.join(F.broadcast(top.select("cut", "n0", "budget")), F.col("score") == F.col("cut")).select("pos", F.col("label").cast("bigint").alias("label"), (F.col("budget") - F.col("n0")).alias("room"))
    tied = running(tied, "pos", {"i": ("sum", F.lit(1).cast("bigint"))}, (), chunk)
    hits = tied.where("i < room").agg(F.coalesce(F.sum("label"), F.lit(0)).alias("p1"))
    t = top.join(hits).withColumn("hits", F.col("p0") + F.col("p1"))
    p = F.col("hits") / F.least("budget", "n")
    q = F.when(F.col("all") > 0, F.col("hits") / F.col("all")).otherwise(0.0)
    return t.select("budget", "hits", p.alias("precision"), q.alias("recall"), F.when(p + q > 0, 2 * p * q / (p + q)).otherwise(0.0).alias("f1"))


def in_regions(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The rows of label 1 with the number of their run by position, from 1."""
    r = previous(rows, "pos", "label", "before", (), chunk)
    r = r.withColumn("new", ((F.col("label") == 1) & (F.coalesce("before", F.lit(0)) != 1)).cast("bigint"))
    return running(r, "pos", {"region": ("sum", F.col("new"))}, (), chunk, current=True).where("label = 1").drop("before", "new")


def regions(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Runs of label 1 by position: ``region, first_pos, last_pos, points``."""
    return in_regions(rows, chunk).groupBy("region").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count("*").alias("points"))


def delays(rows: DataFrame, threshold: float, chunk: int = CHUNK) -> DataFrame:
    """How far into each labelled region the first alarm comes; null if none does."""
    by = in_regions(rows, chunk).groupBy("region").agg(F.min("pos").alias("first_pos"), F.min(F.when(F.col("score") >= threshold, F.col("pos"))).alias("at"))
    return by.select("region", "first_pos", (F.col("at") - F.col("first_pos")).alias("delay"))


def touches(episodes: DataFrame, truth: DataFrame, slack_ms: int, name: str, bucket_ms: int = DAY) -> DataFrame:
    """``episodes`` with whether any truth interval of the channel, padded by the slack, meets theirs."""
    t = truth.select("channel", (F.col("t_start_ms") - slack_ms).alias("f0"), (F.col("t_end_ms") + slack_ms).alias("f1"))
    hit = overlap_join(episodes.select("channel", "t_start_ms", "t_end_ms"), t, ("t_start_ms", "t_end_ms"), ("f0", "f1"), bucket_ms, ["channel"])
    hit = hit.select("channel", "t_start_ms").distinct().withColumn(name, F.lit(True))
    return episodes.join(hit, ["channel", "t_start_ms"], "left").withColumn(name, F.coalesce(name, F.lit(False)))


def classified(episodes: DataFrame, faults: DataFrame, artifacts: DataFrame, slack_ms: int = 30_000) -> DataFrame:
    """Each episode's class: fault before artifact before unexplained."""
    e = touches(touches(episodes, faults, slack_ms, "on_fault"), artifacts, slack_ms, "on_artifact")
    return e.withColumn("class", F.when(F.col("on_fault"), "fault").when(F.col("on_artifact"), "artifact").otherwise("unexplained"))


def covering(truth: DataFrame, windows: DataFrame, bucket_ms: int = DAY) -> DataFrame:
    """``truth`` with ``window_id`` and ``window_perturbed`` of the first context window, in the plan's order (``ord``), that meets an
    interval and whose scope has its channel; null if none does."""
    w = windows.select("event_id", F.col("t_start_ms").alias("w0"), F.col("t_end_ms").alias("w1"), "scope", "perturbed", "ord")
    key = ["channel", "t_start_ms", "t_end_ms"]
    j = overlap_join(truth.select(*key).distinct(), w, ("t_start_ms", "t_end_ms"), ("w0", "w1"), bucket_ms).where(applies_to("scope", "channel"))
    first = j.groupBy(*key).agg(F.min_by(F.struct("event_id", "perturbed"), "ord").alias("__w"))
    out = truth.join(first, key, "left")
    return out.withColumn("window_id", F.col("__w.event_id")).withColumn("window_perturbed", F.col("__w.perturbed")).drop("__w")


def incidents(faults: DataFrame, pages: DataFrame, slack_ms: int = 30_000) -> DataFrame:
    """Per incident, in the domain of its first member, whether any of its channels' faults met a page, and the first context window of a
    member, if faults have one (see :func:`covering`)."""
    f = touches(faults, pages, slack_ms, "found")
    order = F.struct("t_start_ms", "channel")
    more = []
    if "window_id" in faults.columns:
        inside = F.when(F.col("window_id").isNotNull(), order)
        more = [F.min_by("window_id", inside).alias("window_id"), F.min_by("window_perturbed", inside).alias("window_perturbed")]
    return f.groupBy("incident").agg(F.min_by("domain", order).alias("domain"), F.max(F.col("found").cast("int")).alias("found"), F.count("*").alias("channels"), F.sum(F.col("found").cast("int")).alias("channels_found"), *more)


def _share(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)


def score_pass(observed: DataFrame, faults: DataFrame, artifacts: DataFrame, windows: DataFrame, slack_ms: int = 30_000) -> DataFrame:
    """One row on a run's episodes (``status``): pages, false ones, and recall of incidents, of those inside and outside context windows, of
    those inside windows that disturbed nothing, and of single channels.

    An attributed episode pages nobody and detects nothing. A page on an artifact is false even if it is on a fault too.
    """
    pages = observed.where("status = 'real'")
    e = touches(touches(pages, faults, slack_ms, "on_fault"), artifacts, slack_ms, "on_artifact")
    p = e.agg(F.count("*").alias("paged"), F.count_if("on_artifact").alias("artifact_pages"), F.count_if(~F.col("on_artifact") & ~F.col("on_fault")).alias("unexplained_pages"))
    i = incidents(covering(faults, windows), pages, slack_ms)
    inside, quiet = F.col("window_id").isNotNull(), F.col("window_id").isNotNull() & ~F.coalesce("window_perturbed", F.lit(False))
    found = F.col("found") == 1
    r = i.agg(
        F.count("*").alias("faults_total"), F.count_if(found).alias("faults_detected"), F.count_if(inside).alias("inside_total"), F.count_if(inside & found).alias("inside_detected"),
        F.count_if(~inside).alias("outside_total"), F.count_if(~inside & found).alias("outside_detected"), F.count_if(quiet).alias("quiet_total"), F.count_if(quiet & found).alias("quiet_detected"),
        F.coalesce(F.sum("channels"), F.lit(0)).alias("channels_total"), F.coalesce(F.sum("channels_found"), F.lit(0)).alias("channels_detected"),
    )
    t = observed.agg(F.count("*").alias("episodes")).join(p).join(r).withColumn("attributed", F.col("episodes") - F.col("paged")).withColumn("false_pages", F.col("artifact_pages") + F.col("unexplained_pages"))
    recalls = {"recall": ("faults_detected", "faults_total"), "recall_inside": ("inside_detected", "inside_total"), "recall_outside": ("outside_detected", "outside_total"), "recall_quiet": ("quiet_detected", "quiet_total"), "recall_channels": ("channels_detected", "channels_total")}
    t = t.withColumns({n: _share(a, b) for n, (a, b) in recalls.items()})
    return t.withColumn("precision", F.when(F.col("paged") > 0, (F.col("paged") - F.col("false_pages")) / F.col("paged")).otherwise(0.0))


def compare(shadow: DataFrame, conditioned: DataFrame, target: float = 0.40, tolerance: float = 0.05) -> DataFrame:
    """Two scored passes: by what share false pages fell, what recall was lost, and whether the fall reaches the target with no more loss than tolerated."""
    names = ["paged", "false_pages", "recall", "recall_inside"]
    j = shadow.select(*[F.col(c).alias(f"shadow_{c}") for c in names]).join(conditioned.select(*[F.col(c).alias(f"conditioned_{c}") for c in names]))
    j = j.withColumn("false_reduction", F.when(F.col("shadow_false_pages") > 0, (F.col("shadow_false_pages") - F.col("conditioned_false_pages")) / F.col("shadow_false_pages")).otherwise(0.0))
    j = j.withColumn("recall_loss", F.col("shadow_recall") - F.col("conditioned_recall")).withColumn("recall_loss_inside", F.col("shadow_recall_inside") - F.col("conditioned_recall_inside"))
    return j.withColumn("meets_target", (F.col("false_reduction") >= target) & (F.col("recall_loss") <= tolerance))


def compare_passes(shadow: DataFrame, other: DataFrame) -> DataFrame:
    """A pass without signals against the unconditioned one, by (channel, start, end, detector): it must change nothing (``held``)."""
    key = ["channel", "t_start_ms", "t_end_ms", "raised_by"]
    a = shadow.select(*key, F.col("status").alias("a"), F.lit(1).alias("in_a"))
    b = other.select(*key, F.col("status").alias("b"), (F.col("attributed_to").isNotNull()).cast("int").alias("named"), F.lit(1).alias("in_b"))
    j = a.join(b, key, "full_outer")
    both = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    t = j.agg(
        F.count("in_a").alias("shadow_episodes"), F.count("in_b").alias("fail_open_episodes"), F.count_if(both & (F.col("a") == F.col("b"))).alias("identical"), F.count_if(F.col("in_b").isNull()).alias("missing"),
        F.count_if(F.col("in_a").isNull()).alias("extra"), F.count_if(both & (F.col("a") == "real") & (F.col("b") != "real")).alias("suppressed"), F.coalesce(F.sum("named"), F.lit(0)).alias("attributed"),
    )
    return t.withColumn("held", (F.col("missing") == 0) & (F.col("extra") == 0) & (F.col("suppressed") == 0) & (F.col("attributed") == 0))


def breakdown(observed: DataFrame, faults: DataFrame, artifacts: DataFrame, slack_ms: int = 30_000, suppressed_only: bool = False) -> DataFrame:
    """Verdicts against what the episodes really were; no verdict is ``unconditioned``."""
    rows = observed.where("status != 'real'") if suppressed_only else observed
    c = classified(rows.withColumn("verdict", F.coalesce("verdict", F.lit("unconditioned"))), faults, artifacts, slack_ms)
    return c.groupBy("verdict").agg(*[F.count_if(F.col("class") == k).alias(k) for k in ("fault", "artifact", "unexplained")])


def ranks(values: DataFrame, column: str, bars: list[int]) -> DataFrame:
    """How many values reach each bar, and the values at places n // 2 and min(int(0.9 n), n - 1) of their order, and the largest.

    Counts by value come first, so the running total sees one row a value.
    """
    by = values.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("k"))
    by = by.withColumn("upto", F.sum("k").over(Window.orderBy("v"))).withColumn("n", F.sum("k").over(Window.partitionBy()))
    places = {"p50": F.floor(F.col("n") / 2), "p90": F.least(F.floor(F.col("n") * 0.9), F.col("n") - 1)}
    return by.agg(
        F.coalesce(F.max("n"), F.lit(0)).alias("n"), *[F.coalesce(F.sum(F.when(F.col("v") >= b, F.col("k"))), F.lit(0)).alias(f"at_{b}") for b in bars],
        *[F.min(F.when(F.col("upto") > p, F.col("v"))).alias(name) for name, p in places.items()], F.max("v").alias("largest"),
    )


def rescued(episodes: DataFrame, lasting: DataFrame) -> DataFrame:
    """Of the episodes of one window how many come again nearby (``recurrences``) and how many have high windows before them (``shoulder``)."""
    j = episodes.where("window_count = 1").join(lasting, ["channel", "t_start_ms"])
    return j.agg(F.count("*").alias("single"), F.count_if(F.col("recurrences") > 0).alias("recurring"), F.count_if(F.col("shoulder") > 0).alias("shouldered"))


def evidence(counts: DataFrame, *columns: str) -> DataFrame:
    """Of counts of corroborating channels a decision: the mean, and how many decisions had any."""
    return counts.agg(F.count("*").alias("n"), *[x for c in columns for x in (F.avg(c).alias(f"{c}_mean"), F.count_if(F.col(c) > 0).alias(f"{c}_any"))])


def parity(a: DataFrame, b: DataFrame, tolerance: float) -> DataFrame:
    """Two detectors' scores by (channel, start): shared and one-sided windows, disagreements and the largest."""
    j = a.select("channel", "start_ms", F.col("score").alias("x")).join(b.select("channel", "start_ms", F.col("score").alias("y")), ["channel", "start_ms"], "full_outer")
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    return j.agg(
        F.count(F.when(both, 1)).alias("shared"), F.count(F.when(F.col("y").isNull(), 1)).alias("only_left"), F.count(F.when(F.col("x").isNull(), 1)).alias("only_right"),
        F.count(F.when(both & (F.abs(F.col("x") - F.col("y")) > tolerance), 1)).alias("disagreements"), F.max(F.abs(F.col("x") - F.col("y"))).alias("largest"),
    )


def window_labels(windows: DataFrame, points: DataFrame, bucket_ms: int = DAY) -> DataFrame:
    """Whether a window [start, end) holds any labelled point of its channel."""
    p = points.where("label = 1").select("channel", F.col("event_ts_ms").alias("at"), F.col("event_ts_ms").alias("at_end")).distinct()
    w = windows.select("channel", "start_ms", (F.col("end_ms") - 1).alias("last_ms"))
    j = overlap_join(w, p, ("start_ms", "last_ms"), ("at", "at_end"), bucket_ms, ["channel"]).select("channel", "start_ms").distinct()
    return windows.join(j.withColumn("label", F.lit(1)), ["channel", "start_ms"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def sweep(values: DataFrame, column: str, bars: list[int]) -> DataFrame:
    """Counts at or above each bar."""
    v = values.agg(*[F.count_if(F.col(column) >= b).alias(str(b)) for b in bars])
    return v.select(F.explode(F.map_from_arrays(F.array(*[F.lit(b) for b in bars]), F.array(*[F.col(f"`{b}`") for b in bars]))).alias("bar", "n"))


def disagreements(a: DataFrame, b: DataFrame, n: int = 8) -> DataFrame:
    """The windows on which two detectors differ most."""
    j = a.select("channel", "start_ms", F.col("score").alias("x")).join(b.select("channel", "start_ms", F.col("score").alias("y")), ["channel", "start_ms"])
    return j.withColumn("off", F.abs(F.col("x") - F.col("y"))).orderBy(F.round("off", 9).desc(), "channel", "start_ms").limit(n)


def series_scores(rows: DataFrame, *keys: str) -> DataFrame:
    """``auc_pr``, and precision, recall and F1 at the budget, of each series (``keys``) of scored windows (``pos, score, label``)."""
    r = ranked(rows)
    by = r.groupBy(*keys, "score").agg(F.sum("label").alias("p"), F.count("*").alias("n"))
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc())
    by = by.withColumn("tp", F.sum("p").over(order)).withColumn("k", F.sum("n").over(order)).withColumn("all", F.sum("p").over(Window.partitionBy(*keys)))
    area = by.groupBy(*keys).agg(F.sum(F.when(F.col("all") > 0, F.col("p") / F.col("all") * F.col("tp") / F.col("k")).otherwise(0.0)).alias("auc_pr"), F.max("all").alias("all"), F.sum("n").alias("n"))
    i = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("score").desc(), "pos"))
    top = r.withColumn("i", i).join(area.select(*keys, F.greatest(F.lit(1).cast("bigint"), "all").alias("budget")), list(keys)).where("i <= budget").groupBy(*keys).agg(F.sum("label").alias("hits"), F.count("*").alias("taken"))
    j = area.join(top, list(keys)).withColumn("precision", F.col("hits") / F.col("taken")).withColumn("recall", F.when(F.col("all") > 0, F.col("hits") / F.col("all")).otherwise(0.0))
    both = F.col("precision") + F.col("recall")
    return j.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0)).select(*keys, "auc_pr", "precision", "recall", "f1", F.col("n").alias("windows"), F.col("all").alias("anomalies"))


def detector_report(scores: DataFrame) -> DataFrame:
    """Per detector over its series: median and mean area, mean F1, precision and recall."""
    return scores.groupBy("detector").agg(F.count("*").alias("series"), F.median("auc_pr").alias("auc_pr_median"), *[F.avg(c).alias(f"{c}_mean") for c in ("auc_pr", "f1", "precision", "recall")])


def margins(scores: DataFrame, a: str, b: str) -> DataFrame:
    """``series, winner, margin``: which of two detectors has the larger area on each series, ``tie`` if none."""
    x, y = (scores.where(F.col("detector") == d).select("series", F.col("auc_pr").alias(n)) for d, n in ((a, "x"), (b, "y")))
    j = x.join(y, "series")
    return j.select("series", F.when(F.col("x") > F.col("y"), a).when(F.col("y") > F.col("x"), b).otherwise("tie").alias("winner"), F.abs(F.col("x") - F.col("y")).alias("margin"))


def head_to_head(scores: DataFrame, a: str, b: str, worst: int = 5) -> tuple[DataFrame, DataFrame]:
    """Wins and ties of two detectors, and each winner's ``worst`` series for the other by margin."""
    m = margins(scores, a, b)
    top = m.where("winner != 'tie'").withColumn("rank", F.row_number().over(Window.partitionBy("winner").orderBy(F.col("margin").desc(), "series"))).where(F.col("rank") <= worst)
    return m.groupBy("winner").agg(F.count("*").alias("series")), top


def scaling(runs: DataFrame, partitions: int) -> DataFrame:
    """Throughput of runs (``consumers, readings, elapsed_s``), their speed-up against the one with the fewest consumers, and efficiency a consumer."""
    t = runs.where("readings > 0").withColumn("throughput", F.col("readings") / F.col("elapsed_s"))
    first = F.first("throughput").over(Window.orderBy("consumers"))  # a row a run
    t = t.withColumn("speedup", F.col("throughput") / first).withColumn("efficiency", F.col("throughput") / first / F.col("consumers"))
    return t.select(
        "consumers", F.lit(partitions).alias("partitions"), "readings", F.round("throughput", 1).alias("throughput_per_s"), F.round(F.col("throughput") / F.col("consumers"), 1).alias("per_consumer_per_s"),
        F.greatest(F.lit(0), F.col("consumers") - partitions).alias("idle_consumers"), F.round("speedup", 3).alias("speedup"), F.round("efficiency", 3).alias("efficiency"),
    )


def lake_audit(rows: DataFrame, snapshots: int) -> DataFrame:
    """Findings of a stored table: rows, readings, channels, gaps, repeats and numbers used again. Clean: no gaps and no repeats."""
    from tidelens.operators import rollup

    by = rollup.identities(rows).agg(F.coalesce(F.sum("readings"), F.lit(0)).alias("readings"), F.count("*").alias("channels"), F.coalesce(F.sum("drift"), F.lit(0)).alias("sequence_gaps"), F.coalesce(F.sum("reused_seq"), F.lit(0)).alias("reused_seq"))
    t = rows.agg(F.count("*").alias("rows")).join(by).withColumn("duplicate_rows", F.col("rows") - F.col("readings")).withColumn("snapshots", F.lit(snapshots))
    return t.withColumn("clean", (F.col("sequence_gaps") == 0) & (F.col("duplicate_rows") == 0))


def offset_audit(log: DataFrame, consumed: DataFrame) -> DataFrame:
    """What a topic's log holds (``partition, low, high``) against the rows that were read."""
    t = log.agg(F.sum("low").alias("low_watermark"), F.sum("high").alias("log_end")).join(consumed.agg(F.count("*").alias("consumed")))
    return t.withColumn("available", F.col("log_end") - F.col("low_watermark")).withColumn("drift", F.col("available") - F.col("consumed"))


def lengths(rows: DataFrame, column: str) -> DataFrame:
    """How long examples are: 50th and 95th percentile, and the largest."""
    return rows.agg(F.count("*").alias("n"), F.percentile(column, F.lit(0.5)).alias("p50"), F.percentile(column, F.lit(0.95)).alias("p95"), F.max(column).alias("largest"))
