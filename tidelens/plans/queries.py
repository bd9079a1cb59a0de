"""Named queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelens.operators import detect, episodes, evaluate, forecast, intervals, ledger, policy, retrieval, rollup, rules, windows
from tidelens.sources import readings as src
from tidelens.streaming.storage import written

H = src.HOUR
#: Windows of two days every half day; thresholds and gaps for channels by type and by node.
SPAN = windows.Sliding(48 * H, 12 * H, 8)
GAP, BY_TYPE, BY_NODE, SYNC = 24 * H, 1.5, 2.5, 6 * H
LICENCES = ["annotate_episode", "describe_channel", "fetch_recent_readings", "raise_ticket", "request_recalibration"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def r6(*names: str):
    """Rounded a hair above a tie, so that engines that break ties differently agree."""
    return [F.round(F.col(n) + 1e-9, 6).alias(n) for n in names]


def scored(spark: SparkSession, sf: str, by_node: bool = False) -> DataFrame:
    return detect.zscores(src.readings(spark, sf, by_node, False), SPAN)


def found(spark: SparkSession, sf: str, by_node: bool = False) -> DataFrame:
    """Episodes with the onset of their first window."""
    threshold = BY_NODE if by_node else BY_TYPE
    flagged = scored(spark, sf, by_node).where(F.col("score") >= threshold)
    return episodes.merge(detect.onsets(src.readings(spark, sf, by_node, False), flagged, SPAN), threshold, GAP)


@query
def decode_readings(spark, sf):
    return src.decode(src.wire_lines(spark, sf)).where("ok").select("arrival", "channel", "seq", "event_ts_ms", "value")


@query
def encoded_readings(spark, sf):
    r = src.decode(src.encode(src.readings(spark, sf)))
    return r.groupBy("ok", "channel", F.coalesce("injected", F.lit("")).alias("injected")).agg(F.count("*").alias("readings"), F.sum("seq").alias("seqs"), F.max("event_ts_ms").alias("last_ms"))


@query
def batched_scores(spark, sf):
    """Windows scored away from the path, at most 32 at a time, by a model that tells how many it saw."""
    def model(f):
        return f.assign(score=f["mean"] * 2, seen=len(f))[["channel", "start_ms", "score", "seen"]]

    w = windows.summaries(src.readings(spark, sf, False, False), SPAN).select("channel", "start_ms", "mean")
    s = forecast.scored_in_batches(w, model, "channel string, start_ms bigint, score double, seen int")
    return s.where("seen <= 32").select("channel", "start_ms", *r6("score"))


@query
def malformed_split(spark, sf):
    return src.decode(src.wire_lines(spark, sf)).groupBy("ok").agg(F.count("*").alias("n"))


@query
def payload_fanout(spark, sf):
    items = spark.read.parquet(f"{sf}/lineitem.parquet").withColumn("key", F.expr("l_orderkey * 10 + l_linenumber"))
    out = src.fan_out(items, "l_returnflag", "key", {"quantity": "l_quantity", "charge": "l_extendedprice * (1 - l_discount)", "high_tax": "CASE WHEN l_tax > 0.04 THEN l_tax END"})
    return out.groupBy("channel").agg(F.count("*").alias("readings"), F.round(F.sum("value"), 2).alias("total"), F.max("key").alias("last_key"))


@query
def sliding_windows(spark, sf):
    return windows.summaries(src.readings(spark, sf, False, False), SPAN).select("channel", "start_ms", "end_ms", "n", *r6("mean", "var"))


@query
def tumbling_windows(spark, sf):
    return windows.summaries(src.readings(spark, sf, False, False), windows.Sliding(24 * H, 24 * H, 1)).select("channel", "start_ms", "end_ms", "n", *r6("mean"))


@query
def late_filter(spark, sf):
    r = windows.mark_late(src.faulty_readings(spark, sf), H)
    return r.groupBy("channel").agg(F.count("*").alias("readings"), F.sum(F.col("is_late").cast("bigint")).alias("late"))


@query
def zscore_scores(spark, sf):
    return scored(spark, sf).select("channel", "start_ms", "end_ms", "n", *r6("window_mean", "reference_mean", "mean_z", "dispersion_z", "score"))


@query
def score_onset(spark, sf):
    return detect.onsets(src.readings(spark, sf, False, False), scored(spark, sf), SPAN).select("channel", "start_ms", "onset_ms")


@query
def detect_episodes(spark, sf):
    return found(spark, sf).select("channel", "t_start_ms", "t_end_ms", "window_count", "onset_ms", *r6("peak_score", "mean_score"))


@query
def detect_node_episodes(spark, sf):
    return found(spark, sf, True).select("channel", "t_start_ms", "t_end_ms", "window_count", "onset_ms", *r6("peak_score"))


@query
def episode_scores(spark, sf):
    s = scored(spark, sf)
    return episodes.episode_windows(episodes.merge(s, BY_TYPE, GAP), s, BY_TYPE).select("channel", "t_start_ms", "start_ms", *r6("score"))


@query
def detector_stats(spark, sf):
    e = episodes.merge(scored(spark, sf), BY_TYPE, GAP)
    return e.groupBy("raised_by").agg(F.count("*").alias("episodes"), F.round(F.avg("peak_score"), 2).alias("mean_peak"), F.round(F.max("peak_score"), 2).alias("max_peak"), F.sum("window_count").alias("windows"))


@query
def score_percentiles(spark, sf):
    s = scored(spark, sf).withColumn("score", F.round(F.col("score") + 1e-9, 6))
    p = [F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY score)").alias(n) for n, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))]
    return s.agg(*p, F.max("score").alias("max_score"), F.count("*").alias("n"))


@query
def nearest_rank_pct(spark, sf):
    from tidelens.functions.expressions import nearest_rank

    e = found(spark, sf, True).groupBy("raised_by").agg(F.collect_list(F.round(F.col("peak_score") + 1e-9, 6)).alias("v"))
    return e.select("raised_by", *[nearest_rank(F.col("v"), p).alias(n) for n, p in (("p50", 0.5), ("p90", 0.9), ("p100", 1.0))])


@query
def recent_episodes(spark, sf):
    e = rollup.newest(found(spark, sf, True), [F.col("t_start_ms").desc(), F.col("channel").desc()], 10)
    return e.select("channel", "t_start_ms", F.round((F.col("t_end_ms") - F.col("t_start_ms")) / 1000, 1).alias("duration_s"))


@query
def episodes_in_span(spark, sf):
    a, b = src.FIRST_DAY + 10 * src.DAY, src.FIRST_DAY + 15 * src.DAY
    return found(spark, sf, True).where(f"t_start_ms <= {b} AND t_end_ms >= {a}").select("channel", "t_start_ms", "t_end_ms")


@query
def interval_union(spark, sf):
    return intervals.union(found(spark, sf, True).select("t_start_ms", "t_end_ms"), "t_start_ms", "t_end_ms")


@query
def sequence_ledger(spark, sf):
    return ledger.label(src.faulty_readings(spark, sf)).where("missing > 0 OR duplicate > 0 OR regression > 0").select("channel", "arrival", "seq", "missing", "duplicate", "regression")


@query
def channel_drift(spark, sf):
    return ledger.by_channel(ledger.label(src.faulty_readings(spark, sf)))


@query
def drift_report(spark, sf):
    c = ledger.by_channel(ledger.label(src.faulty_readings(spark, sf)))
    return c.agg(*[F.sum(x).alias(x) for x in ("readings", "missing", "duplicates", "regressions", "drift")], F.count("*").alias("channels"), F.count_if(F.col("drift") != 0).alias("unhealthy"))


def daily_health(spark, sf):
    return ledger.health(ledger.label(src.faulty_readings(spark, sf)), 24 * H)


@query
def pipeline_health(spark, sf):
    return daily_health(spark, sf)


@query
def health_histogram(spark, sf):
    return daily_health(spark, sf).groupBy("severity").agg(F.count("*").alias("windows"), F.sum("missing").alias("missing"))


@query
def health_context_events(spark, sf):
    return ledger.context_events(daily_health(spark, sf)).select("event_id", "kind", "t_start_ms", "t_end_ms", "severity", "detail")


@query
def source_watermark(spark, sf):
    return ledger.source_progress(src.faulty_readings(spark, sf))


@query
def gap_watch(spark, sf):
    return ledger.gaps(src.readings(spark, sf, True, False))


@query
def dedup_exact(spark, sf):
    r = rollup.latest(src.faulty_readings(spark, sf), rollup.KEY, "arrival")
    return r.groupBy("channel").agg(F.count("*").alias("readings"), F.sum("arrival").alias("arrivals"))


@query
def duplicate_rows(spark, sf):
    return rollup.duplicates(src.faulty_readings(spark, sf))


@query
def lake_identities(spark, sf):
    return rollup.identities(src.faulty_readings(spark, sf))


@query
def ledger_vs_lake(spark, sf):
    r = src.faulty_readings(spark, sf)
    return rollup.ledger_vs_store(ledger.by_channel(ledger.label(r)), rollup.identities(r.where("channel != 'view'")))


@query
def rollup_minute(spark, sf):
    m = rollup.per_minute(src.faulty_readings(spark, sf), H)
    return m.select("channel", "minute_ms", "readings", "value_min", "value_max", "seq_min", "seq_max", F.round(F.col("value_sum") / F.col("value_count") + 1e-9, 4).alias("mean"))


@query
def rollup_merge(spark, sf):
    """Partial rows of two batches, apart by the parity of the numbers, put together."""
    r = rollup.latest(src.faulty_readings(spark, sf), rollup.KEY, "arrival")
    parts = [rollup.per_minute(r.where(F.col("seq") % 2 == i), H) for i in (0, 1)]
    m = rollup.merge_minutes(parts[0].unionByName(parts[1]))
    return m.select("channel", "minute_ms", "readings", "value_min", "value_max", "seq_min", "seq_max", F.round(F.col("value_sum") / F.col("value_count") + 1e-9, 4).alias("mean"))


@query
def channel_summary(spark, sf):
    return rollup.channel_summary(rollup.per_minute(src.faulty_readings(spark, sf))).withColumn("mean", F.round(F.col("mean") + 1e-9, 4))


@query
def channel_series(spark, sf):
    m = rollup.per_minute(src.readings(spark, sf)).where("channel = 'click'")
    return rollup.newest(m, [F.col("minute_ms").desc()], 60).select("minute_ms", "readings", F.round(F.col("value_sum") / F.col("value_count") + 1e-9, 4).alias("mean"))


@query
def recent_points(spark, sf):
    return rollup.recent_points(src.readings(spark, sf, False, False), 3600, 3).withColumn("value", F.round(F.col("value") + 1e-9, 6))


@query
def score_distribution(spark, sf):
    d = rollup.score_distribution(scored(spark, sf).withColumn("detector", F.lit("zscore")))
    return d.select("detector", "windows", "channels", *r6("mean_score", "max_score", "p95", "p99"))


@query
def context_overlap(spark, sf):
    return policy.overlapping(found(spark, sf, True), src.deploys(spark), src.DAY).select("channel", "t_start_ms", "event_id", "in_scope")


@query
def context_scope(spark, sf):
    return policy.overlapping(found(spark, sf, True), src.deploys(spark), src.DAY).groupBy("event_id").agg(F.count("*").alias("episodes"), F.count_if("in_scope").alias("in_scope"))


@query
def retention_filter(spark, sf):
    d = src.deploys(spark)
    top = d.agg(F.max("t_end_ms").alias("top"))
    return d.join(F.broadcast(top)).where(f"t_end_ms >= top - {5 * src.DAY}").select("event_id", "t_end_ms")


@query
def synchronous_siblings(spark, sf):
    s = intervals.siblings(found(spark, sf, True), SYNC)
    return s.select("channel", "t_start_ms", F.array_join("siblings", ",").alias("siblings"))


@query
def flagged_in_span(spark, sf):
    return intervals.flagged_in(found(spark, sf, True), src.DAY).select("channel", "t_start_ms", F.array_join("flagged", ",").alias("flagged"))


@query
def recurrences(spark, sf):
    return intervals.recurrences(found(spark, sf, True), 5 * src.DAY)


@query
def topology_derive(spark, sf):
    return src.topology(src.readings(spark, sf, True, False).select("channel").distinct())


@query
def topology_summary(spark, sf):
    t = src.topology(src.readings(spark, sf, True, False).select("channel").distinct())
    return t.groupBy("rack").agg(F.count("*").alias("channels"), F.count_distinct("node").alias("nodes"), F.array_join(F.array_sort(F.collect_set("node")), ",").alias("names"))


@query
def footprint(spark, sf):
    t = src.topology(src.readings(spark, sf, True, False).select("channel").distinct())
    return policy.footprint(src.deploys(spark).where("size(scope) > 0"), "scope", t, ["event_id"], "declared")


def second_scores(spark, sf):
    return detect.zscores(src.readings(spark, sf, True, False), windows.Sliding(72 * H, 24 * H, 8))


@query
def second_opinion(spark, sf):
    return policy.second_opinions(found(spark, sf, True), second_scores(spark, sf), 2.0).withColumn("best", F.round(F.col("best") + 1e-9, 6))


@query
def persistence_shoulder(spark, sf):
    return policy.shoulders(found(spark, sf, True), scored(spark, sf, True), BY_NODE, 0.5)


def context(spark, sf):
    events = ledger.context_events(daily_health(spark, sf)).withColumn("ord", F.lit(1000).cast("bigint"))
    return src.deploys(spark).unionByName(events)


def episodes_once(spark, sf):
    """The episodes by node, written once for queries that use them several times."""
    return written(found(spark, sf, True), "episodes")


def verdicts(spark, sf, e):
    t = src.topology(src.readings(spark, sf, True, False).select("channel").distinct())
    return policy.event_verdicts(e, context(spark, sf), t, src.DAY, SYNC)


def decided(spark, sf, e=None):
    e = e or episodes_once(spark, sf)
    return written(policy.decide(e, verdicts(spark, sf, e)), "decided")


def finished(spark, sf):
    """Verdicts after the second opinion and persistence."""
    e, scores = episodes_once(spark, sf), scored(spark, sf, True)
    lasting = intervals.recurrences(e, 5 * src.DAY).join(policy.shoulders(e, scores, BY_NODE, 0.5), ["channel", "t_start_ms"])
    return policy.finish(decided(spark, sf, e), policy.second_opinions(e, second_scores(spark, sf), 2.0), lasting)


@query
def context_verdicts(spark, sf):
    return decided(spark, sf).select("channel", "t_start_ms", "verdict", "status", "attributed_to")


@query
def final_verdicts(spark, sf):
    return finished(spark, sf).select("channel", "t_start_ms", "verdict", "status", "attributed_to")


@query
def verdict_histogram(spark, sf):
    d = decided(spark, sf)
    c = evaluate.classified(d, src.truth(spark), src.artifacts(spark))
    return c.groupBy("verdict").pivot("class", ["fault", "artifact", "unexplained"]).count().na.fill(0)


@query
def fleet_watermark(spark, sf):
    return windows.fleet_watermark(src.readings(spark, sf, True, False), H, 6 * H)


@query
def barrier_release(spark, sf):
    return policy.release(found(spark, sf, True), src.FIRST_DAY + 15 * src.DAY, 30_000)


@query
def nearest_point(spark, sf):
    marks = found(spark, sf).select("channel", F.coalesce("onset_ms", "t_start_ms").alias("onset_ms"), (F.col("t_start_ms") + 12_345).alias("at_ms"))
    return intervals.nearest(src.readings(spark, sf, False, False), marks.select("channel", "at_ms"))


def plan_windows(spark):
    """The deploys as the plan's context windows; those of even days disturbed something."""
    return src.deploys(spark).withColumn("perturbed", F.col("ord") % 2 == 0)


def passes(spark, sf):
    """The scored passes without and with conditioning."""
    d = decided(spark, sf)
    shadow = d.withColumn("status", F.lit("real"))
    return [written(evaluate.score_pass(x, src.truth(spark), src.artifacts(spark), plan_windows(spark)), "pass") for x in (shadow, d)]


@query
def paired_scores(spark, sf):
    c = evaluate.compare(*passes(spark, sf))
    return c.select("shadow_paged", "shadow_false_pages", "conditioned_paged", "conditioned_false_pages", *r6("shadow_recall", "conditioned_recall", "false_reduction", "recall_loss", "recall_loss_inside"), "meets_target")


@query
def paired_report(spark, sf):
    a, b = passes(spark, sf)
    rows = a.withColumn("label", F.lit("shadow")).unionByName(b.withColumn("label", F.lit("conditioned")))
    counts = ["episodes", "paged", "attributed", "artifact_pages", "unexplained_pages", "faults_total", "faults_detected", "inside_total", "inside_detected", "outside_total", "outside_detected", "quiet_total", "quiet_detected", "channels_total", "channels_detected"]
    return rows.select("label", *counts, *r6("recall", "recall_inside", "recall_outside", "recall_quiet", "recall_channels", "precision"))


@query
def fault_windows(spark, sf):
    return evaluate.covering(src.truth(spark), plan_windows(spark)).select("channel", "t_start_ms", "incident", "window_id", "window_perturbed")


@query
def verdict_breakdown(spark, sf):
    return evaluate.breakdown(finished(spark, sf), src.truth(spark), src.artifacts(spark))


@query
def fail_open_compare(spark, sf):
    e = episodes_once(spark, sf)
    shadow = e.withColumn("status", F.lit("real"))
    silent = policy.decide(e, verdicts(spark, sf, e).where("false"))
    rows = [evaluate.compare_passes(shadow, x).withColumn("pass", F.lit(n)) for n, x in (("no_events", silent), ("unavailable", policy.decide(e, verdicts(spark, sf, e), available=False)), ("conditioned", decided(spark, sf, e)))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query
def recall_by_domain(spark, sf):
    i = evaluate.incidents(src.truth(spark), episodes_once(spark, sf))
    return i.groupBy("domain").agg(F.count("*").alias("incidents"), F.sum("found").alias("found"))


@query
def fail_open_check(spark, sf):
    e = episodes_once(spark, sf)
    opened = policy.decide(e, policy.event_verdicts(e, context(spark, sf), src.topology(e.select("channel").distinct()), src.DAY, SYNC), available=False)
    return opened.groupBy("verdict", "status").agg(F.count("*").alias("episodes"))


def labelled(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "n_chars")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    return labels.join(docs, "doc_id").select(F.col("doc_id").alias("pos"), F.col("n_chars").cast("double").alias("score"), F.col("toxic").alias("label"))


@query
def pr_curve(spark, sf):
    return evaluate.pr_curve(labelled(spark, sf)).select("score", "tp", "fp", *r6("precision", "recall"))


@query
def auc_pr(spark, sf):
    return evaluate.auc_pr(labelled(spark, sf)).select(*r6("auc_pr"))


@query
def roc_auc(spark, sf):
    return evaluate.roc_auc(labelled(spark, sf)).select(*r6("roc_auc"))


@query
def budget_f1(spark, sf):
    return evaluate.budget(labelled(spark, sf)).select("budget", "hits", *r6("precision", "recall", "f1"))


@query
def labelled_regions(spark, sf):
    return evaluate.regions(labelled(spark, sf))


@query
def detection_delay(spark, sf):
    return evaluate.delays(labelled(spark, sf), 5000.0).select("region", "delay")


@query
def benchmark_fold(spark, sf):
    s = scored(spark, sf, True).withColumn("series", F.substring_index("channel", ".", 1))
    points = src.readings(spark, sf, True).select("channel", "event_ts_ms", F.col("injected").isNotNull().cast("int").alias("label"))
    w = evaluate.window_labels(s, points)
    return w.groupBy("series", "start_ms").agg(F.round(F.max("score") + 1e-9, 6).alias("score"), F.max("label").alias("label"))


@query
def parity_compare(spark, sf):
    a, b = scored(spark, sf), scored(spark, sf).where("channel != 'view'").withColumn("score", F.when(F.col("n") % 5 == 0, F.col("score") + 1).otherwise(F.col("score")))
    return evaluate.parity(a, b, 0.5).withColumn("largest", F.round(F.col("largest") + 1e-9, 6))


@query
def corroboration_sweep(spark, sf):
    s = intervals.siblings(found(spark, sf, True), 24 * H).select((F.size("siblings") + 1).alias("n"))
    return evaluate.sweep(s, "n", [1, 2, 3, 4, 6, 8])


@query
def bm25_search(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("title"), "text")
    asked = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return retrieval.search(docs, asked).select("query_id", "title", "rank", F.round(F.col("score") + 1e-9, 6).alias("score"))


@query
def diagnose(spark, sf):
    return rules.diagnose(found(spark, sf, True)).select("channel", "t_start_ms", "symptom")


def planned(spark, sf):
    return rules.plan(rules.diagnose(decided(spark, sf)), LICENCES)


@query
def plan_actions(spark, sf):
    return planned(spark, sf).select("channel", "t_start_ms", "step", "action")


@query
def gate_verdicts(spark, sf):
    return rules.gate(planned(spark, sf)).groupBy("action", "approved", "reason").agg(F.count("*").alias("n"))


def examples(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    split = F.when(F.pmod(F.conv(F.substring(F.md5("source"), 1, 4), 16, 10).cast("bigint"), F.lit(5)) == 0, "test").otherwise("train")
    return docs.select(F.col("doc_id").alias("ord"), F.col("text").alias("prompt"), F.col("lang").alias("symptom"), "source", split.alias("split"))


@query
def prompt_dedup_cap(spark, sf):
    return rules.dedup_cap(examples(spark, sf), 40).select("ord", "split", "symptom", "digest")


@query
def channel_split(spark, sf):
    return examples(spark, sf).groupBy("source", "split").agg(F.count("*").alias("n"))


@query
def dataset_summary(spark, sf):
    return examples(spark, sf).groupBy("split", "symptom").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"))


@query
def leakage_check(spark, sf):
    e = examples(spark, sf).select("source", "split").distinct()
    return e.where("split = 'train'").join(e.where("split = 'test'").select("source"), "source", "left_semi").agg(F.count("*").alias("shared_sources"))
