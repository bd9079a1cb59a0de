"""Queries on evaluation, serving, forecasts and the agent, with their SQL beside them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelens.operators import agent, detect, episodes, evaluate, forecast, intervals, ledger, policy, rules, serving, windows
from tidelens.plans import oracle
from tidelens.plans import queries as base
from tidelens.sources import readings as src
from tidelens.streaming.storage import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
M1, M2, M3, FIRST, DAY, H, E2 = oracle.M1, oracle.M2, oracle.M3, oracle.FIRST, oracle.DAY, oracle.H, oracle.E2


def query(sql: str = ""):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _ranks(rows: str, v: str, bars: list[int]) -> str:
    return f"""rk AS (SELECT {v} AS v, row_number() OVER (ORDER BY {v}) - 1 AS i, count(*) OVER () AS n FROM {rows})
  SELECT count(*) AS n, {', '.join(f'count(*) FILTER (WHERE v >= {b}) AS at_{b}' for b in bars)}, max(v) FILTER (WHERE i = n // 2) AS p50, max(v) FILTER (WHERE i = least(CAST(floor(n * 0.9) AS BIGINT), n - 1)) AS p90, max(v) AS largest FROM rk"""


@query(f"WITH {E2}, {oracle._SECOND}, pk AS (SELECT round(best + 1e-9, 6) AS best FROM op WHERE best > 0), {_ranks('pk', 'best', [1, 2, 3, 4, 6, 8])}")
def agreement_sensitivity(spark, sf):
    o = policy.second_opinions(base.episodes_once(spark, sf), base.second_scores(spark, sf), 2.0).where("best > 0")
    return evaluate.ranks(o.withColumn("best", F.round(F.col("best") + 1e-9, 6)), "best", [1, 2, 3, 4, 6, 8])


@query(f"WITH {E2}, {_ranks('e', 'window_count', [1, 2, 3, 4, 6])}")
def persistence_sensitivity(spark, sf):
    return evaluate.ranks(base.found(spark, sf, True), "window_count", [1, 2, 3, 4, 6])


@query(f"WITH {E2}, {oracle._SHOULDER}, rec AS ({oracle._RECUR}) SELECT count(*) AS single, count(*) FILTER (WHERE recurrences > 0) AS recurring, count(*) FILTER (WHERE shoulder > 0) AS shouldered FROM e JOIN rec USING (channel, t_start_ms) JOIN sh USING (channel, t_start_ms) WHERE window_count = 1")
def persistence_rescue(spark, sf):
    e = base.episodes_once(spark, sf)
    lasting = intervals.recurrences(e, 5 * src.DAY).join(policy.shoulders(e, base.scored(spark, sf, True), base.BY_NODE, 0.5), ["channel", "t_start_ms"])
    return evaluate.rescued(e, lasting)


@query(f"""WITH {E2}, sib AS ({oracle._NEAR.format(within=6 * H)}), a1 AS (SELECT e.channel, e.t_start_ms, count(sibling) AS n FROM e LEFT JOIN sib USING (channel, t_start_ms) GROUP BY ALL),
  b1 AS (SELECT x.channel, x.t_start_ms, count(DISTINCT y.channel) FILTER (WHERE y.channel <> x.channel) AS n FROM e x LEFT JOIN e y ON y.onset_ms BETWEEN x.t_start_ms AND x.t_end_ms GROUP BY ALL)
  SELECT count(*) AS n, round(avg(a1.n) + 1e-9, 6) AS synchronous_mean, count(*) FILTER (WHERE a1.n > 0) AS synchronous_any, round(avg(b1.n) + 1e-9, 6) AS in_span_mean, count(*) FILTER (WHERE b1.n > 0) AS in_span_any FROM a1 JOIN b1 USING (channel, t_start_ms)""")
def corroboration_evidence(spark, sf):
    e = base.episodes_once(spark, sf)
    s = intervals.siblings(e, base.SYNC).select("channel", "t_start_ms", F.size("siblings").alias("synchronous"))
    f = intervals.flagged_in(e, src.DAY).select("channel", "t_start_ms", F.size(F.array_remove("flagged", F.col("channel"))).alias("in_span"))
    t = evaluate.evidence(s.join(f, ["channel", "t_start_ms"], "left").fillna(0), "synchronous", "in_span")
    return t.select("n", *base.r6("synchronous_mean", "in_span_mean"), "synchronous_any", "in_span_any")


_SERIES = f"""{oracle.S2}, bb AS (SELECT split_part(s.channel, '.', 1) AS series, s.start_ms, s.score, s.mean_z, CASE WHEN EXISTS (SELECT 1 FROM m2 WHERE m2.channel = s.channel AND m2.injected IS NOT NULL AND m2.event_ts_ms >= s.start_ms AND m2.event_ts_ms < s.end_ms) THEN 1 ELSE 0 END AS lab FROM s),
  ff AS (SELECT 'zscore' AS detector, series, start_ms AS pos, round(max(score), 9) AS score, max(lab) AS label FROM bb GROUP BY ALL UNION ALL SELECT 'mean_shift', series, start_ms, round(max(mean_z), 9), max(lab) FROM bb GROUP BY ALL),
  d AS (SELECT detector, series, score, sum(label) AS p, count(*) AS n FROM ff GROUP BY ALL),
  cc AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS k, sum(p) OVER (PARTITION BY detector, series) AS pos FROM d WINDOW w AS (PARTITION BY detector, series ORDER BY score DESC)),
  ar AS (SELECT detector, series, sum(CASE WHEN pos > 0 THEN p / pos * tp / k ELSE 0 END) AS auc_pr, max(pos) AS pos FROM cc GROUP BY ALL),
  tp AS (SELECT detector, series, sum(label) AS hits, count(*) AS taken FROM (SELECT ff.*, row_number() OVER (PARTITION BY detector, series ORDER BY score DESC, ff.pos) AS i, greatest(1, ar.pos) AS budget FROM ff JOIN ar USING (detector, series)) WHERE i <= budget GROUP BY ALL),
  sc AS (SELECT detector, series, auc_pr, hits / taken AS precision, CASE WHEN pos > 0 THEN hits / pos ELSE 0 END AS recall, CASE WHEN hits > 0 THEN 2 * (hits / taken) * (hits / pos) / (hits / taken + hits / pos) ELSE 0 END AS f1 FROM ar JOIN tp USING (detector, series))"""


def by_series(spark, sf):
    s = base.scored(spark, sf, True)
    points = src.readings(spark, sf, True).select("channel", "event_ts_ms", F.col("injected").isNotNull().cast("int").alias("label"))
    w = evaluate.window_labels(s, points).withColumn("series", F.substring_index("channel", ".", 1))
    both = w.select("series", "start_ms", "label", F.explode(F.create_map(F.lit("zscore"), "score", F.lit("mean_shift"), "mean_z")).alias("detector", "score"))
    fold = both.groupBy("detector", "series", F.col("start_ms").alias("pos")).agg(F.round(F.max("score"), 9).alias("score"), F.max("label").alias("label"))
    return written(evaluate.series_scores(written(fold, "fold"), "detector", "series"), "series")


@query(f"WITH {_SERIES} SELECT detector, count(*) AS series, round(median(auc_pr) + 1e-9, 6) AS auc_pr_median, round(avg(auc_pr) + 1e-9, 6) AS auc_pr_mean, round(avg(f1) + 1e-9, 6) AS f1_mean, round(avg(precision) + 1e-9, 6) AS precision_mean, round(avg(recall) + 1e-9, 6) AS recall_mean FROM sc GROUP BY detector")
def benchmark_report(spark, sf):
    return evaluate.detector_report(by_series(spark, sf)).select("detector", "series", *base.r6("auc_pr_median", "auc_pr_mean", "f1_mean", "precision_mean", "recall_mean"))


@query(f"""WITH {_SERIES}, m AS (SELECT series, CASE WHEN x.auc_pr > y.auc_pr THEN 'zscore' WHEN y.auc_pr > x.auc_pr THEN 'mean_shift' ELSE 'tie' END AS winner, abs(x.auc_pr - y.auc_pr) AS margin FROM sc x JOIN sc y USING (series) WHERE x.detector = 'zscore' AND y.detector = 'mean_shift'),
  r AS (SELECT *, row_number() OVER (PARTITION BY winner ORDER BY margin DESC, series) AS rank, count(*) OVER (PARTITION BY winner) AS wins FROM m) SELECT winner, wins, series, round(margin + 1e-9, 6) AS margin, rank FROM r WHERE winner <> 'tie' AND rank <= 5""")
def head_to_head(spark, sf):
    wins, worst = evaluate.head_to_head(by_series(spark, sf), "zscore", "mean_shift")
    return worst.join(wins.select("winner", F.col("series").alias("wins")), "winner").select("winner", "wins", "series", F.round(F.col("margin") + 1e-9, 6).alias("margin"), F.col("rank").cast("bigint").alias("rank"))


@query("""WITH r AS (SELECT l_linenumber AS consumers, CAST(sum(l_quantity) AS BIGINT) AS readings, count(*) / 4.0::DOUBLE AS elapsed_s FROM lineitem GROUP BY 1), t AS (SELECT *, readings / elapsed_s AS th FROM r), u AS (SELECT *, first_value(th) OVER (ORDER BY consumers) AS one FROM t)
  SELECT consumers, 6 AS partitions, readings, round(th, 1) AS throughput_per_s, round(th / consumers, 1) AS per_consumer_per_s, CASE WHEN consumers > 6 THEN consumers - 6 ELSE 0 END AS idle_consumers, round(th / one, 3) AS speedup, round(th / one / consumers, 3) AS efficiency FROM u""")
def scaling_sweep(spark, sf):
    r = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy(F.col("l_linenumber").alias("consumers")).agg(F.sum("l_quantity").cast("bigint").alias("readings"), (F.count("*") / 4.0).alias("elapsed_s"))
    return evaluate.scaling(r, 6)


@query("WITH t AS (SELECT len(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS n FROM documents) SELECT count(*) AS n, round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.95), 6) AS p95, max(n) AS largest FROM t")
def token_lengths(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select(F.size(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9_]+)"))).cast("bigint").alias("n_tokens"))
    return evaluate.lengths(d, "n_tokens").withColumn("p50", F.round("p50", 6)).withColumn("p95", F.round("p95", 6))


@query(f"WITH {oracle.S1} SELECT channel, start_ms, round(score + 1e-9, 6) AS x, round(score + n % 5 + 1e-9, 6) AS y, CAST(n % 5 AS DOUBLE) AS off FROM s ORDER BY n % 5 DESC, channel, start_ms LIMIT 8")
def largest_disagreements(spark, sf):
    s = written(base.scored(spark, sf), "scores")
    d = evaluate.disagreements(s, s.withColumn("score", F.col("score") + F.col("n") % 5).withColumn("n", F.lit(0)))
    return d.select("channel", "start_ms", *base.r6("x", "y"), F.round("off", 6).alias("off"))


# ---- serving

_RUN = f"{oracle.HEALTH}, t AS (SELECT channel, count(*) AS readings, max(seq) - arg_min(seq, arrival) + 1 - count(*) AS drift FROM l GROUP BY channel), run AS (SELECT sum(drift) AS drift, 7 AS offset_drift FROM t)"


def runs(spark, sf):
    """Two reconciliation runs, the newer one over all readings."""
    d = base.drift_report(spark, sf)
    old = d.withColumn("drift", F.lit(-1).cast("bigint")).withColumn("created_at", F.lit(1)).withColumn("offset_drift", F.lit(0))
    return old.unionByName(d.withColumn("created_at", F.lit(2)).withColumn("offset_drift", F.lit(7)))


@query(f"WITH {E2}, {M3} SELECT (SELECT count(*) FROM e) AS episodes, (SELECT count(*) FROM m3) AS reading_rows")
def service_health(spark, sf):
    return serving.service_health(base.found(spark, sf, True), src.faulty_readings(spark, sf))


@query(f"WITH {E2} SELECT channel, t_start_ms, round((t_end_ms - t_start_ms) / 1000, 1) AS duration_s, round(peak_score, 2) AS peak_score, window_count FROM e ORDER BY t_start_ms DESC, channel DESC LIMIT 20")
def episode_list(spark, sf):
    return serving.episode_list(base.found(spark, sf, True), 20).select("channel", "t_start_ms", "duration_s", "peak_score", "window_count")


@query(f"""WITH {oracle.E1}, a1 AS (SELECT 'zscore' AS raised_by, count(*) AS episodes, round(avg(peak_score), 2) AS avg_peak, round(max(peak_score), 2) AS max_peak, CAST(sum(window_count) AS BIGINT) AS windows FROM e HAVING count(*) > 0)
  SELECT a1.*, count(s.n) AS n, CAST(quantile_disc(s.n % 17, 0.5) AS DOUBLE) AS p50, CAST(quantile_disc(s.n % 17, 0.95) AS DOUBLE) AS p95, CAST(quantile_disc(s.n % 17, 0.99) AS DOUBLE) AS p99, CAST(max(s.n % 17) AS DOUBLE) AS max_ms FROM a1, s GROUP BY ALL""")
def detector_latency_pct(spark, sf):
    s = written(base.scored(spark, sf), "scores")
    e = episodes.merge(s, base.BY_TYPE, base.GAP)
    return serving.detectors(e, s.select(F.lit("zscore").alias("raised_by"), (F.col("n") % 17).cast("double").alias("latency_ms")))


@query(f"WITH {_RUN} SELECT window_start_ms, readings, severity, (SELECT count(*) FROM health) AS windows, (SELECT count(*) FROM health WHERE severity <> 'ok') AS disturbed_windows, CAST(drift AS BIGINT) AS drift, offset_drift, true AS has_evidence FROM health, run ORDER BY window_start_ms DESC LIMIT 12")
def reconciliation_overview(spark, sf):
    return serving.reconciliation(runs(spark, sf), base.daily_health(spark, sf), 12).select("window_start_ms", "readings", "severity", "windows", "disturbed_windows", "drift", "offset_drift", "has_evidence")


@query(f"WITH {_RUN} SELECT CAST(drift AS BIGINT) AS drift, offset_drift, 2 AS created_at FROM run")
def latest_run(spark, sf):
    return serving.newest_row(runs(spark, sf), "created_at").select("drift", "offset_drift", "created_at")


@query(f"WITH {oracle.HEALTH} SELECT window_start_ms, severity, readings FROM health ORDER BY window_start_ms DESC LIMIT 7")
def recent_health(spark, sf):
    return serving.newest_windows(base.daily_health(spark, sf), 7).select("window_start_ms", "severity", "readings")


@query(f"WITH {oracle.HEALTH}, {oracle._PIPELINE}, {oracle.DEPLOYS}, c AS (SELECT event_id, kind, t_start_ms FROM pe UNION ALL SELECT event_id, 'deploy', c0 FROM dep) SELECT * FROM c ORDER BY t_start_ms DESC, event_id DESC LIMIT 9")
def recent_context(spark, sf):
    return serving.newest_events(base.context(spark, sf), 9).select("event_id", "kind", "t_start_ms")


@query(f"WITH {oracle.CHANNELS} SELECT channel, drift FROM drift WHERE drift <> 0 ORDER BY abs(drift) DESC, channel LIMIT 3")
def unhealthy_channels(spark, sf):
    return serving.unhealthy_channels(base.channel_drift(spark, sf), 3).select("channel", "drift")


@query(f"WITH {E2} SELECT channel, t_start_ms, round(peak_score + 1e-9, 6) AS peak_score FROM e ORDER BY e.peak_score DESC, channel, t_start_ms LIMIT 5")
def top_episodes(spark, sf):
    return serving.top_episodes(base.found(spark, sf, True), 5).select("channel", "t_start_ms", *base.r6("peak_score"))


@query(f"""WITH {oracle.E1}, x AS (SELECT channel, event_ts_ms // 1000 * 1000 AS second_ms, count(*) AS n FROM m1 WHERE event_ts_ms >= (SELECT max(event_ts_ms) FROM m1) - 3600000 GROUP BY 1, 2), top AS (SELECT channel FROM x GROUP BY channel ORDER BY count(*) DESC, channel LIMIT 4),
  ee AS (SELECT channel, count(*) AS k FROM e WHERE t_start_ms <= (SELECT max(event_ts_ms) FROM m1) AND t_end_ms >= (SELECT max(event_ts_ms) FROM m1) - 3600000 GROUP BY channel)
  SELECT channel, count(*) AS points, round(sum(n) * 1000 / 3600000, 6) AS readings_per_s, min(second_ms) AS first_ms, max(second_ms) AS last_ms, coalesce(any_value(k), 0) AS episodes FROM x LEFT JOIN ee USING (channel) WHERE channel IN (SELECT channel FROM top) GROUP BY channel""")
def stream_view(spark, sf):
    return serving.stream_view(src.readings(spark, sf), base.found(spark, sf), 3600, 4)


@query(f"""WITH {_RUN}, {E2}, idn AS (SELECT channel, count(*) AS n, max(seq) - min(seq) + 1 - count(*) AS gap FROM (SELECT DISTINCT channel, seq, event_ts_ms FROM m3) GROUP BY channel)
  SELECT 'episode_store_up' AS name, NULL::VARCHAR AS channel, 1.0::DOUBLE AS value UNION ALL SELECT 'serving_store_up', NULL, 1 UNION ALL SELECT 'episodes_total', NULL, (SELECT count(*) FROM e) UNION ALL SELECT 'pipeline_health_disturbed_windows', NULL, (SELECT count(*) FROM health WHERE severity <> 'ok')
  UNION ALL SELECT 'reconciliation_drift', NULL, drift FROM run UNION ALL SELECT 'reconciliation_offset_drift', NULL, 7 UNION ALL SELECT 'reading_rows_total', NULL, (SELECT count(*) FROM m3) UNION ALL SELECT 'readings_total', channel, n FROM idn UNION ALL SELECT 'channel_sequence_gap', channel, gap FROM idn""")
def gauges(spark, sf):
    return serving.gauges(base.found(spark, sf, True), runs(spark, sf), base.daily_health(spark, sf), src.faulty_readings(spark, sf))


@query(f"""WITH {E2}, vv AS (SELECT channel, greatest(t_start_ms, {FIRST + 8 * DAY}) AS t_start_ms, least(t_end_ms, {FIRST + 20 * DAY}) AS t_end_ms FROM e WHERE t_start_ms <= {FIRST + 20 * DAY} AND t_end_ms >= {FIRST + 8 * DAY}),
  b AS (SELECT *, max(t_end_ms) OVER (PARTITION BY channel ORDER BY t_start_ms, t_end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM vv), n AS (SELECT *, sum(CASE WHEN before IS NULL OR t_start_ms > before THEN 1 ELSE 0 END) OVER (PARTITION BY channel ORDER BY t_start_ms, t_end_ms ROWS UNBOUNDED PRECEDING) AS isl FROM b)
  SELECT channel, min(t_start_ms) AS t_start_ms, max(t_end_ms) AS t_end_ms, count(*) AS merged FROM n GROUP BY channel, isl""")
def chart_spans(spark, sf):
    return serving.chart_spans(base.found(spark, sf, True), src.FIRST_DAY + 8 * src.DAY, src.FIRST_DAY + 20 * src.DAY)


@query(f"WITH {M1}, d AS (SELECT channel, event_ts_ms // {DAY} * {DAY} AS day_ms, avg(value) AS value FROM m1 GROUP BY 1, 2), r AS (SELECT *, min(value) OVER w AS lo, max(value) OVER w AS hi FROM d WINDOW w AS (PARTITION BY channel)) SELECT channel, day_ms, round(CASE WHEN hi > lo THEN (value - lo) / (hi - lo) ELSE 0.5 END + 1e-9, 6) AS scaled FROM r")
def scaled_points(spark, sf):
    return serving.scaled(forecast.buckets(src.readings(spark, sf, False, False), src.DAY)).select("channel", F.col("bucket_ms").alias("day_ms"), *base.r6("scaled"))


@query(f"WITH {M2}, r AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY event_ts_ms DESC, arrival DESC) AS back FROM m2) SELECT channel, seq, back FROM r WHERE back <= 20")
def channel_tail(spark, sf):
    return serving.tails(src.readings(spark, sf, True), 20).select("channel", "seq", F.col("back").cast("bigint").alias("back"))


@query(f"WITH {M2}, r AS (SELECT channel, count(*) OVER w AS recent, avg(value) OVER w AS m FROM m2 WINDOW w AS (PARTITION BY channel ORDER BY event_ts_ms RANGE BETWEEN {6 * H} PRECEDING AND CURRENT ROW)) SELECT channel, CAST(sum(recent) AS BIGINT) AS total, max(recent) AS most, round(sum(m) + 1e-9, 5) AS means FROM r GROUP BY channel")
def channel_history(spark, sf):
    h = serving.history(src.readings(spark, sf, True), 6 * src.HOUR)
    return h.groupBy("channel").agg(F.sum("recent").alias("total"), F.max("recent").alias("most"), F.round(F.sum("recent_mean") + 1e-9, 5).alias("means"))


@query(f"""WITH {M1}, c AS (SELECT channel, event_ts_ms, max(seq) % 150 AS v FROM m1 GROUP BY 1, 2), u AS (SELECT *, lag(v) OVER (PARTITION BY channel ORDER BY event_ts_ms) AS before FROM c), w AS (SELECT channel, event_ts_ms, CASE WHEN before IS NULL THEN 0 WHEN v < before THEN v ELSE v - before END AS up FROM u),
  s AS (SELECT channel, up, unnest(range(event_ts_ms // {6 * H} * {6 * H} + {6 * H}, event_ts_ms // {6 * H} * {6 * H} + {24 * H} + 1, {6 * H})) AS at_ms FROM w) SELECT channel, at_ms, CAST(sum(up) AS DOUBLE) AS increase, round(sum(up) * 1000 / {24 * H} + 1e-9, 6) AS per_s FROM s GROUP BY ALL""")
def counter_rates(spark, sf):
    c = src.readings(spark, sf).groupBy("channel", "event_ts_ms").agg((F.max("seq") % 150).cast("double").alias("value"))
    return serving.increases(c, 24 * src.HOUR, 6 * src.HOUR).select("channel", "at_ms", "increase", *base.r6("per_s"))


# ---- watermarks

@query(f"""WITH {M2}, x AS (SELECT channel, max(event_ts_ms) - {H} AS mark FROM m2 GROUP BY channel), f AS (SELECT min(mark) AS w FROM x WHERE mark >= (SELECT max(mark) FROM x) - {6 * H}), y AS (SELECT min(m) AS w FROM (SELECT channel, max(event_ts_ms) - {2 * DAY} AS m FROM m2 GROUP BY channel))
  SELECT f.w AS fleet_ms, y.w AS second_ms, CASE WHEN f.w IS NOT NULL AND y.w IS NOT NULL THEN least(f.w, y.w) END AS watermark_ms FROM f, y""")
def evidence_watermark(spark, sf):
    r = src.readings(spark, sf, True)
    second = windows.fleet_watermark(r, 2 * src.DAY, 0)
    return policy.evidence_watermark(windows.fleet_watermark(r, src.HOUR, 6 * src.HOUR), second)


@query(f"""WITH {M3}, x AS (SELECT source, CASE WHEN source <> 'p3' THEN max(event_ts_ms) END AS high_ms, CASE source WHEN 'p3' THEN 10 WHEN 'p4' THEN 20 ELSE 100 END AS seen_s FROM m3 GROUP BY source)
  SELECT 30 AS idle_s, count(*) AS sources, CASE WHEN count(high_ms) = count(*) THEN min(high_ms) END AS watermark_ms FROM x WHERE 100 - seen_s <= 30 UNION ALL SELECT 1000, count(*), CASE WHEN count(high_ms) = count(*) THEN min(high_ms) END FROM x""")
def source_watermarks(spark, sf):
    """Of six sources one was never heard and one has been silent for long: with a short time-out neither counts, with a long one the first blocks."""
    h = src.faulty_readings(spark, sf).groupBy("source").agg(F.max("event_ts_ms").alias("high_ms"))
    s = h.withColumn("seen_s", F.when(F.col("source") == "p3", 10).when(F.col("source") == "p4", 20).otherwise(100)).withColumn("high_ms", F.when(F.col("source") != "p3", F.col("high_ms")))
    return ledger.source_watermark(s, 30).withColumn("idle_s", F.lit(30)).unionByName(ledger.source_watermark(s, 1000).withColumn("idle_s", F.lit(1000)))


def _seal() -> str:
    marks = ", ".join(f"max(CASE WHEN source = 'p{i}' THEN event_ts_ms END) OVER w AS h{i}" for i in range(6))
    heard, low = " AND ".join(f"h{i} IS NOT NULL" for i in range(6)), ", ".join(f"h{i}" for i in range(6))
    return f"""{oracle.LEDGER}, q AS (SELECT *, {marks} FROM l WINDOW w AS (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), sl AS (SELECT *, {heard} AND event_ts_ms // 600000 * 600000 < least({low}) // 600000 * 600000 - 600000 AS is_late FROM q)"""


@query(f"WITH {_seal()} SELECT channel, count(*) AS readings, count(*) FILTER (WHERE is_late) AS late, CAST(sum(missing) AS BIGINT) AS missing, count(DISTINCT CASE WHEN NOT is_late THEN event_ts_ms // 600000 END) AS windows FROM sl GROUP BY channel")
def sealed_windows(spark, sf):
    s = ledger.sealed(ledger.label(src.faulty_readings(spark, sf)), 600_000)
    return s.groupBy("channel").agg(F.count("*").alias("readings"), F.count_if("is_late").alias("late"), F.sum("missing").alias("missing"), F.count_distinct(F.when(~F.col("is_late"), F.floor(F.col("event_ts_ms") / 600_000))).alias("windows"))


@query(f"WITH {oracle.HEALTH} SELECT window_start_ms, readings FROM health WHERE window_start_ms < {FIRST + 12 * DAY}")
def due_windows(spark, sf):
    return ledger.due(base.daily_health(spark, sf), src.FIRST_DAY + 13 * src.DAY + 5, src.DAY).select("window_start_ms", "readings")


# ---- forecasts and episodes

@query(f"""WITH {M1}, b AS (SELECT channel, event_ts_ms // {H} * {H} AS bucket_ms, avg(value) AS value FROM m1 GROUP BY 1, 2), c AS (SELECT *, quantile_cont(value, 0.1) OVER w AS q1, quantile_cont(value, 0.5) OVER w AS q5, quantile_cont(value, 0.9) OVER w AS q9, count(*) OVER w AS seen FROM b WINDOW w AS (PARTITION BY channel ORDER BY bucket_ms ROWS BETWEEN 128 PRECEDING AND 1 PRECEDING)),
  x AS (SELECT *, unnest(range(((bucket_ms - {48 * H}) // {12 * H} + 1) * {12 * H}, bucket_ms + 1, {12 * H})) AS start_ms FROM c), f AS (SELECT channel, start_ms, arg_min(q1, bucket_ms) AS q1, arg_min(q5, bucket_ms) AS q5, arg_min(q9, bucket_ms) AS q9, arg_min(seen, bucket_ms) AS context FROM x GROUP BY 1, 2 HAVING arg_min(seen, bucket_ms) >= 48)
  SELECT channel, start_ms, start_ms + {48 * H} AS end_ms, CAST(count(*) AS INTEGER) AS horizon, context, round(max(abs(value - f.q5) / greatest((f.q9 - f.q1) / 2.563::DOUBLE, 1e-6)) + 1e-9, 6) AS score, round(avg(abs(value - f.q5) / greatest((f.q9 - f.q1) / 2.563::DOUBLE, 1e-6)) + 1e-9, 6) AS mean_residual FROM x JOIN f USING (channel, start_ms) GROUP BY channel, start_ms, context""")
def residual_windows(spark, sf):
    s = forecast.residual_scores(src.readings(spark, sf, False, False), base.SPAN, src.HOUR)
    return s.select("channel", "start_ms", "end_ms", "horizon", "context", *base.r6("score", "mean_residual"))


@query(f"WITH {oracle.S1} SELECT 'zscore' AS detector, count(*) AS windows, round(max(score) + 1e-9, 6) AS largest FROM s")
def registered_detectors(spark, sf):
    s = detect.score_with("zscore", src.readings(spark, sf), base.SPAN)
    return s.groupBy("detector").agg(F.count("*").alias("windows"), F.round(F.max("score") + 1e-9, 6).alias("largest"))


@query(f"WITH {oracle.E1}, x AS (SELECT e.channel, e.t_start_ms, injected, min(event_ts_ms) AS first_ms FROM e JOIN m1 ON m1.channel = e.channel AND m1.injected IS NOT NULL AND event_ts_ms >= t_start_ms AND event_ts_ms < t_end_ms GROUP BY ALL) SELECT e.channel, e.t_start_ms, coalesce(string_agg(injected, ',' ORDER BY first_ms), '') AS origins FROM e LEFT JOIN x USING (channel, t_start_ms) GROUP BY ALL")
def episode_origins(spark, sf):
    o = episodes.origins(base.found(spark, sf), src.readings(spark, sf))
    return o.select("channel", "t_start_ms", F.array_join("origins", ",").alias("origins"))


@query(f"WITH {E2} SELECT channel, t_start_ms, 'channel: ' || channel || chr(10) || 'episode span: ' || CAST((t_end_ms - t_start_ms) // 1000 AS VARCHAR) || ' s over ' || window_count || ' windows' || chr(10) || 'peak detector score: ' || printf('%.1f', peak_score) || ' against a threshold of 2.5' || chr(10) || 'raised by: zscore' AS text FROM e")
def episode_text(spark, sf):
    return base.found(spark, sf, True).select("channel", "t_start_ms", agent.describe_episode().alias("text"))


# ---- the agent

#: Runbook passages, and what is asked for each symptom.
PASSAGES = [
    ("Level that moved and stayed", "A sustained shift of the mean while neighbours are calm points at the instrument; check its calibration and mount.", ["describe_channel", "fetch_recent_readings", "raise_ticket", "request_recalibration"]),
    ("Burst of variance", "Dispersion grows while the mean is stable: electrical noise. A short silence is fine if someone owns it.", ["describe_channel", "raise_ticket", "silence_channel"]),
    ("One odd sample", "An isolated spike of a single window needs a note and nothing else.", ["annotate_episode", "describe_channel"]),
    ("Guarded channels", "Safety interlock fire emergency channels belong to people.", ["describe_channel", "escalate_to_human"]),
]
ASKED = {"level_shift": "sustained shift of the mean level", "variance_burst": "variance burst dispersion", "isolated_spike": "isolated spike sample", "safety_channel": "safety interlock"}


def passages(spark):
    return spark.createDataFrame(PASSAGES, "title string, text string, licences array<string>")


def licensed(spark, sf):
    return agent.retrieve(rules.diagnose(base.decided(spark, sf)), passages(spark), ASKED)


def _strings(names) -> str:
    return "[" + ", ".join(f"'{x}'" for x in names) + "]"


_PASSAGES = ", ".join(f"""('{t}', '{x}', {_strings(ls)})""" for t, x, ls in PASSAGES)
_LICENSED = f"""{oracle.DECIDED}, ps AS (SELECT * FROM (VALUES {_PASSAGES}) v(title, text, licences)), pd AS (SELECT title, licences, regexp_extract_all(lower(title || ' ' || text), '[a-z0-9_]+') AS terms FROM ps), pst AS (SELECT count(*) AS docs, avg(len(terms)) AS avg_len FROM pd),
  pq AS (SELECT DISTINCT symptom, unnest(regexp_extract_all(lower(query), '[a-z0-9_]+')) AS term FROM (VALUES {', '.join(f"('{k}', '{v}')" for k, v in ASKED.items())}) v(symptom, query)), pt AS (SELECT title, len(terms) AS n, unnest(terms) AS term FROM pd),
  ptf AS (SELECT title, n, term, count(*) AS tf FROM pt GROUP BY ALL), pdf AS (SELECT term, count(*) AS df FROM ptf GROUP BY term),
  psc AS (SELECT symptom, title, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / avg_len))) AS score FROM pq JOIN ptf USING (term) JOIN pdf USING (term), pst GROUP BY symptom, title),
  phit AS (SELECT symptom, title FROM psc WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY symptom ORDER BY round(score, 9) DESC, title) <= 3),
  plic AS (SELECT symptom, list_sort(list_distinct(flatten(list(licences)))) AS licences FROM phit JOIN ps USING (title) GROUP BY symptom),
  dg AS (SELECT channel, t_start_ms, status, CASE WHEN regexp_matches(lower(channel), 'safety|interlock|fire|emergency') THEN 'safety_channel' WHEN window_count <= 1 AND t_end_ms - t_start_ms <= 60000 THEN 'isolated_spike' WHEN 2 * burst_windows > window_count THEN 'variance_burst' ELSE 'level_shift' END AS symptom FROM dec),
  off AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {_strings(v)})" for k, v in rules.OFFERS.items())}) v(symptom, offers)),
  pl AS (SELECT channel, t_start_ms, status, symptom, licences, CASE WHEN len(list_filter(offers, lambda o: list_contains(licences, o))) > 0 THEN list_filter(offers, lambda o: list_contains(licences, o)) ELSE ['escalate_to_human'] END AS actions FROM dg JOIN off USING (symptom) LEFT JOIN plic USING (symptom)),
  st AS (SELECT channel, t_start_ms, status, symptom, licences, unnest(actions) AS action, unnest(range(len(actions))) AS step FROM pl),
  gt AS (SELECT *, action IN ('describe_channel', 'fetch_recent_readings', 'escalate_to_human') OR status = 'real' AS approved FROM st)"""


@query(f"WITH {_LICENSED} SELECT channel, t_start_ms, symptom, CAST(step AS INTEGER) AS step, action FROM st")
def plan_licensed(spark, sf):
    return agent.PLANNERS["rules"](licensed(spark, sf)).select("channel", "t_start_ms", "symptom", "step", "action")


def steps(spark, sf):
    d = written(licensed(spark, sf), "diagnosed")
    p = written(rules.plan(d, "licences"), "plan")
    g = rules.gate(p).join(d.select("channel", "t_start_ms", "symptom", "status", "licences"), ["channel", "t_start_ms"])
    return d, g.withColumn("executed", F.col("approved")).withColumn("rationale", F.concat(F.lit("see ["), "symptom", F.lit("]")))


@query(f"""WITH {_LICENSED}, tk AS (SELECT *, sum(CASE WHEN action = 'raise_ticket' AND approved THEN 1 ELSE 0 END) OVER (PARTITION BY channel, t_start_ms ORDER BY step) AS t FROM gt)
  SELECT channel, t_start_ms, CAST(step AS INTEGER) AS step, approved AS ok, CASE WHEN approved THEN CASE action WHEN 'raise_ticket' THEN 'raised TICKET-' || lpad(CAST(t AS VARCHAR), 4, '0') || ' at severity medium' WHEN 'silence_channel' THEN 'silenced ' || channel || ' for 30 minutes' WHEN 'request_recalibration' THEN 'requested recalibration of ' || channel
    WHEN 'annotate_episode' THEN 'annotated episode ' || channel || '@' || t_start_ms WHEN 'escalate_to_human' THEN 'escalated episode ' || channel || '@' || t_start_ms || ' to a human' END END AS effect FROM tk""")
def sandbox_effects(spark, sf):
    _, g = steps(spark, sf)
    return agent.execute(g, F.concat("channel", F.lit("@"), F.col("t_start_ms").cast("string"))).select("channel", "t_start_ms", "step", "ok", "effect")


@query(f"""WITH {_LICENSED}, k AS (SELECT channel, t_start_ms, symptom, bool_and(approved AND (len(licences) = 0 OR list_contains(licences, action))) AND (symptom <> 'safety_channel' OR bool_or(action = 'escalate_to_human')) AS keep FROM gt GROUP BY channel, t_start_ms, symptom)
  SELECT symptom, 'distilled' AS source, count(*) AS examples FROM k WHERE keep GROUP BY symptom""")
def curated_examples(spark, sf):
    _, g = steps(spark, sf)
    return agent.examples(written(g, "steps")).groupBy("symptom", "source").agg(F.count("*").alias("examples"))


_QUALITY = f"""{_LICENSED}, qa AS (SELECT (SELECT count(*) FROM dec) AS episodes, count(*) AS p, count(*) FILTER (WHERE approved) AS x, count(*) FILTER (WHERE list_contains(licences, action) OR action = 'escalate_to_human') AS g, count(*) FILTER (WHERE action IN ('describe_channel', 'fetch_recent_readings')) AS r, count(*) FILTER (WHERE action = 'escalate_to_human') AS h FROM gt)"""


@query(f"""WITH {_QUALITY} SELECT episodes, p AS actions_proposed, x AS actions_executed, 0 AS runs_with_no_proposal, 0 AS actions_executed_ungated, CASE WHEN p > 0 THEN round(g / p, 6) ELSE 1 END AS grounded_action_rate, CASE WHEN p > 0 THEN round(x / p, 6) ELSE 1 END AS gate_approval_rate, 1.0::DOUBLE AS sandbox_containment_rate, 1.0::DOUBLE AS safety_channel_compliance_rate, 1.0::DOUBLE AS abstention_correctness_rate,
  CASE WHEN p > 0 THEN round(h / p, 6) ELSE 1 END AS escalation_rate, 1.0::DOUBLE AS citation_rate, CASE WHEN p > 0 THEN round(r / p, 6) ELSE 1 END AS read_only_share, CASE WHEN p > 0 THEN round((p - r - h) / p, 6) ELSE 1 END AS state_changing_share, 0 AS safety_episodes, 0 AS abstention_episodes FROM qa""")
def agent_quality(spark, sf):
    d, g = steps(spark, sf)
    return agent.quality(written(g, "steps"), d)


@query(f"""WITH {_QUALITY} SELECT 'gate_approval_rate' AS name, round(x / p, 6) AS value, 1.0::DOUBLE AS bound FROM qa WHERE x < p UNION ALL SELECT 'grounded_action_rate', round(g / p, 6), 1.0 FROM qa WHERE g < p UNION ALL SELECT 'read_only_share', round(r / p, 6), 0.88 FROM qa WHERE round(r / p, 6) < 0.88""")
def quality_floors(spark, sf):
    d, g = steps(spark, sf)
    return agent.floors(agent.quality(written(g, "steps"), d), {"read_only_share": 0.9, "episodes": 1e9})


_CASES = "SELECT event_id, ['stuck_sensor', 'oscillation', 'counter_rollover', 'correlated_step', 'slow_drift'][event_id % 5 + 1] AS symptom, list_filter(['describe_channel', 'raise_ticket', 'escalate_to_human', 'fetch_recent_readings', 'silence_channel', 'annotate_episode'], lambda a, i: event_id % (i + 2) <> 0) AS licences, CASE event_id % 4 WHEN 0 THEN ['describe_channel', 'raise_ticket'] WHEN 1 THEN ['raise_ticket', 'describe_channel'] WHEN 2 THEN ['silence_channel', 'raise_ticket'] ELSE ['escalate_to_human'] END AS kinds FROM events"


@query(f"""WITH c AS ({_CASES}), t AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {_strings(w)}, {_strings(f)})" for k, (w, f) in agent.TEACHER.items())}) v(symptom, w, f)), j AS (SELECT c.*, f, list_filter(w, lambda x: list_contains(licences, x)) AS allowed FROM c JOIN t USING (symptom))
  SELECT symptom, count(*) AS cases, count(*) FILTER (WHERE kinds = allowed) AS exact, count(*) FILTER (WHERE list_sort(kinds) = list_sort(allowed)) AS same_set, count(*) FILTER (WHERE list_has_any(kinds, f)) AS forbidden, count(*) FILTER (WHERE NOT list_has_all(kinds, allowed)) AS missing,
    CAST(sum(len(list_filter(kinds, lambda x: x <> 'escalate_to_human' AND NOT list_contains(licences, x)))) AS BIGINT) AS ungrounded, count(*) FILTER (WHERE kinds = ['escalate_to_human']) AS escalated_only FROM j GROUP BY symptom""")
def planner_scores(spark, sf):
    symptoms = ["stuck_sensor", "oscillation", "counter_rollover", "correlated_step", "slow_drift"]
    actions = ["describe_channel", "raise_ticket", "escalate_to_human", "fetch_recent_readings", "silence_channel", "annotate_episode"]
    e = src.events(spark, sf).select("event_id", F.element_at(F.array(*[F.lit(x) for x in symptoms]), (F.col("event_id") % 5 + 1).cast("int")).alias("symptom"))
    keep = F.filter(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(i).alias("i")) for i, a in enumerate(actions)]), lambda x: F.col("event_id") % (x["i"] + 3) != 0)
    kinds = F.expr("CASE event_id % 4 WHEN 0 THEN array('describe_channel', 'raise_ticket') WHEN 1 THEN array('raise_ticket', 'describe_channel') WHEN 2 THEN array('silence_channel', 'raise_ticket') ELSE array('escalate_to_human') END")
    return agent.planner_scores(e.withColumn("licences", F.transform(keep, lambda x: x["a"])).withColumn("kinds", kinds), "symptom")


#: A reply and what is wrong with it: fenced, valid, list, unknown verbs, malformed entries, missing parameters, usable actions.
REPLIES = [
    ('[{"kind":"describe_channel","parameters":{"channel":"a"},"rationale":"x"}]', False, True, True, 0, 0, 0, 1),
    ('```json\n[{"kind":"raise_ticket","parameters":{"episode_id":1,"summary":"s"}}]\n```', True, True, True, 0, 0, 1, 1),
    ('{"kind":"describe_channel"}', False, True, False, 0, 0, 0, 0),
    ("describe the channel", False, False, False, 0, 0, 0, 0),
    ('[{"kind":"reboot","parameters":{}}, 7, {"kind":"annotate_episode"}, {"parameters":{}}]', False, True, True, 1, 3, 0, 0),
    ("[]", False, True, True, 0, 0, 0, 0),
    ('[{"kind":"silence_channel","parameters":{"minutes":null,"channel":"a"}}, {"kind":"escalate_to_human","parameters":{}}]', False, True, True, 0, 0, 3, 2),
]


@query(f"""WITH r AS (SELECT * FROM (VALUES {', '.join(f"({i}, {', '.join(str(x).lower() for x in row[1:])})" for i, row in enumerate(REPLIES))}) v(i, fenced, valid_json, is_array, unknown, malformed, missing, kinds)), e AS (SELECT event_id % {len(REPLIES)} AS i, count(*) AS n FROM events GROUP BY 1)
  SELECT CAST(i AS BIGINT) AS reply, n, fenced, valid_json, is_array, unknown, malformed, missing, kinds, valid_json AND is_array AND unknown + malformed + missing = 0 AS schema_valid FROM r JOIN e USING (i)""")
def plan_replies(spark, sf):
    bodies = F.array(*[F.lit(r[0]) for r in REPLIES])
    e = src.events(spark, sf).select((F.col("event_id") % len(REPLIES)).alias("n")).withColumn("body", F.element_at(bodies, (F.col("n") + 1).cast("int")))
    p = agent.parse_plans(e, "body")
    return p.groupBy(F.col("n").alias("reply"), "fenced", "valid_json", "is_array", F.size("unknown").alias("unknown"), "malformed", F.size("missing").alias("missing"), F.size("kinds").alias("kinds"), "schema_valid").agg(F.count("*").alias("n"))
