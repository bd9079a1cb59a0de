"""DuckDB SQL for the named queries, written from the definitions and not from the plans."""

from __future__ import annotations

H, DAY, FIRST = 3_600_000, 86_400_000, 1_704_067_200_000
INJECTED = "CASE WHEN event_id % 97 = 0 THEN 'spike' WHEN event_id % 89 = 0 THEN 'level_shift' END AS injected"
NODE = "'pump-' || lpad(CAST(user_id % 12 AS VARCHAR), 2, '0') || '.' || event_type"


def _readings(name: str, channel: str) -> str:
    return f"{name} AS (SELECT {channel} AS channel, row_number() OVER (PARTITION BY {channel} ORDER BY event_id) AS seq, event_id AS arrival, epoch_us(ts) // 1000 AS event_ts_ms, value, 'p' || CAST(event_id % 6 AS VARCHAR) AS source, {INJECTED} FROM events)"


M1, M2 = _readings("m1", "event_type"), _readings("m2", NODE)
M3 = f"""{M1}, k AS (SELECT *, event_ts_ms + (arrival % 7) * 10000 AS ingest_wall_ms FROM m1 WHERE arrival % 101 <> 50), m3 AS (
  SELECT * REPLACE (CASE WHEN arrival % 37 = 11 THEN arrival * 10 + 405 ELSE arrival * 10 END AS arrival) FROM k
  UNION ALL SELECT * REPLACE (arrival * 10 + 5 AS arrival) FROM k WHERE arrival % 53 = 7)"""


def _windows(m: str, size: int, slide: int, least: int, x: str = "") -> str:
    return f"""a{x} AS (SELECT *, unnest(range(((event_ts_ms - {size}) // {slide} + 1) * {slide}, event_ts_ms + 1, {slide})) AS start_ms FROM {m}),
    w{x} AS (SELECT channel, start_ms, start_ms + {size} AS end_ms, count(*) AS n, avg(value) AS mean, coalesce(var_samp(value), 0) AS var FROM a{x} GROUP BY channel, start_ms HAVING count(*) >= {least})"""


def _scores(m: str, size: int, slide: int, x: str = "") -> str:
    return f"""{_windows(m, size, slide, 8, x)}, o{x} AS (SELECT *, row_number() OVER (PARTITION BY channel, start_ms ORDER BY event_ts_ms DESC, arrival DESC) - 1 AS back FROM a{x}),
    p{x} AS (SELECT channel, start_ms, sum(pow(0.995, back)) AS dw, sum(pow(0.995, back) * value) AS d1, sum(pow(0.995, back) * value * value) AS d2 FROM o{x} GROUP BY channel, start_ms),
    c{x} AS (SELECT w{x}.*, dw, d1, d2, sum(n) OVER (PARTITION BY channel ORDER BY start_ms) AS cum FROM w{x} JOIN p{x} USING (channel, start_ms)),
    g{x} AS (SELECT b.channel, b.start_ms, sum(j.n) AS seen, sum(pow(0.995, b.cum - b.n - j.cum) * j.dw) AS dw, sum(pow(0.995, b.cum - b.n - j.cum) * j.d1) AS d1, sum(pow(0.995, b.cum - b.n - j.cum) * j.d2) AS d2
      FROM c{x} b JOIN c{x} j ON j.channel = b.channel AND j.start_ms < b.start_ms GROUP BY b.channel, b.start_ms),
    h{x} AS (SELECT channel, start_ms, seen, d1 / dw AS mu, sqrt(greatest(d2 - d1 * d1 / dw, 0) / (dw - 1)) AS sigma FROM g{x} WHERE seen >= 120),
    s{x} AS (SELECT w{x}.channel, start_ms, end_ms, n, mean AS window_mean, mu AS reference_mean, sigma AS reference_sigma, abs(mean - mu) / sigma * sqrt(n) AS mean_z, abs(sqrt(var) / sigma - 1) * sqrt(n / 2.0::DOUBLE) AS dispersion_z,
      greatest(abs(mean - mu) / sigma * sqrt(n), abs(sqrt(var) / sigma - 1) * sqrt(n / 2.0::DOUBLE)) AS score FROM w{x} JOIN h{x} USING (channel, start_ms) WHERE sigma > 1e-9)"""


def _episodes(threshold: float) -> str:
    return f"""u AS (SELECT s.channel, s.start_ms, s.end_ms, s.score, s.mean_z, s.dispersion_z, a.event_ts_ms, a.arrival, abs(a.value - s.reference_mean) AS off, s.reference_sigma AS sigma
      FROM s JOIN a ON a.channel = s.channel AND a.start_ms = s.start_ms),
    q AS (SELECT channel, start_ms, min(CASE WHEN off >= 3 * sigma THEN event_ts_ms END) AS first FROM u GROUP BY channel, start_ms),
    v AS (SELECT channel, start_ms, event_ts_ms AS farthest FROM u QUALIFY row_number() OVER (PARTITION BY channel, start_ms ORDER BY off DESC, event_ts_ms, arrival) = 1),
    onset AS (SELECT channel, start_ms, coalesce(first, farthest) AS onset_ms FROM q JOIN v USING (channel, start_ms)),
    f AS (SELECT s.*, onset_ms, lag(end_ms) OVER (PARTITION BY channel ORDER BY start_ms) AS before FROM s JOIN onset USING (channel, start_ms) WHERE score >= {threshold}),
    i AS (SELECT *, sum(CASE WHEN before IS NULL OR start_ms - before >= {24 * H} THEN 1 ELSE 0 END) OVER (PARTITION BY channel ORDER BY start_ms) AS island FROM f),
    e AS (SELECT channel, min(start_ms) AS t_start_ms, max(end_ms) AS t_end_ms, count(*) AS window_count, max(score) AS peak_score, avg(score) AS mean_score, arg_min(onset_ms, start_ms) AS onset_ms,
      count(*) FILTER (WHERE dispersion_z > mean_z) AS burst_windows FROM i GROUP BY channel, island)"""


S1 = f"{M1}, {_scores('m1', 48 * H, 12 * H)}"
S2 = f"{M2}, {_scores('m2', 48 * H, 12 * H)}"
E1, E2 = f"{S1}, {_episodes(1.5)}", f"{S2}, {_episodes(2.5)}"
LEDGER = f"""{M3}, l0 AS (SELECT *, max(seq) OVER (PARTITION BY channel ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM m3),
  l AS (SELECT *, CASE WHEN seq > high + 1 THEN seq - high - 1 ELSE 0 END AS missing, CASE WHEN seq = high THEN 1 ELSE 0 END AS duplicate, CASE WHEN seq < high THEN 1 ELSE 0 END AS regression FROM l0)"""
CHANNELS = f"""{LEDGER}, t AS (SELECT channel, count(*) AS readings, arg_min(seq, arrival) AS first_seq, max(seq) AS last_seq, sum(missing) AS missing, sum(duplicate) AS duplicates, sum(regression) AS regressions FROM l GROUP BY channel),
  drift AS (SELECT *, last_seq - first_seq + 1 AS span, last_seq - first_seq + 1 - readings AS drift FROM t)"""
_HEALTH = f"""h0 AS (SELECT event_ts_ms // {DAY} * {DAY} AS window_start_ms, count(DISTINCT channel) AS channels, count(*) AS readings, CAST(sum(missing) AS BIGINT) AS missing, CAST(sum(duplicate) AS BIGINT) AS duplicates, CAST(sum(regression) AS BIGINT) AS regressions,
    greatest(0, max(ingest_wall_ms - event_ts_ms)) AS max_lag_ms FROM l GROUP BY 1),
  health AS (SELECT *, window_start_ms + {DAY} AS window_end_ms, CASE WHEN missing >= 100 OR duplicates >= 100 OR max_lag_ms >= 120000 THEN 'critical' WHEN missing >= 1 OR duplicates >= 1 OR regressions > 0 OR max_lag_ms >= 30000 THEN 'warning' WHEN max_lag_ms >= 5000 THEN 'info' ELSE 'ok' END AS severity FROM h0)"""
HEALTH = f"{LEDGER}, {_HEALTH}"
_PIPELINE = """pe AS (SELECT 'pipeline-' || window_start_ms AS event_id, 'pipeline' AS kind, window_start_ms AS t_start_ms, window_end_ms AS t_end_ms, CASE severity WHEN 'ok' THEN 'info' ELSE severity END AS severity,
    'readings=' || readings || ' channels=' || channels || ' missing=' || missing || ' duplicates=' || duplicates || ' reordered=' || regressions || ' max_lag_ms=' || max_lag_ms || ' severity=' || severity AS detail, missing > 0 OR duplicates > 0 OR regressions > 0 AS disturbed FROM health)"""
_KINDS = "(VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view')) kinds(kind)"
# Deploys with their scope one row a channel (none: the whole fleet).
DEPLOYS = f"""dep AS (SELECT d, 'deploy-' || lpad(CAST(d AS VARCHAR), 2, '0') AS event_id, {FIRST} + d * {DAY} + 6 * {H} AS c0, {FIRST} + d * {DAY} + 12 * {H} AS c1 FROM range(30) r(d)),
  scope AS (SELECT d, event_id, 'pump-' || lpad(CAST((d + x) % 12 AS VARCHAR), 2, '0') || '.' || kind AS channel FROM dep, range(3) y(x), {_KINDS} WHERE d % 5 <> 0 AND (d % 7 <> 0 OR (x = 0 AND kind = 'click')))"""
TRUTH = f"""fault AS (SELECT 'fault-' || lpad(CAST(d AS VARCHAR), 2, '0') AS incident, 'pump-' || lpad(CAST(5 * d % 12 AS VARCHAR), 2, '0') || '.' || kind AS channel, {FIRST} + d * {DAY} + 8 * {H} AS f0, {FIRST} + d * {DAY} + 10 * {H} AS f1 FROM range(30) r(d), {_KINDS}),
  artifact AS (SELECT channel, c0 AS f0, c0 + {H} AS f1 FROM dep JOIN scope USING (d, event_id) WHERE d % 2 = 0)"""
TOPOLOGY = """chan AS (SELECT DISTINCT channel, split_part(channel, '.', 1) AS node FROM m2), nodes AS (SELECT DISTINCT node FROM chan),
  numbered AS (SELECT node, dense_rank() OVER (ORDER BY node) - 1 AS i, count(*) OVER () AS all_nodes FROM nodes),
  topo AS (SELECT channel, node, 'rack-' || lpad(CAST(i // 3 AS VARCHAR), 2, '0') AS rack, i % greatest(1, all_nodes // 3) AS ring FROM chan JOIN numbered USING (node))"""
_OVERLAP = "ov AS (SELECT e.channel, e.t_start_ms, dep.d, dep.event_id, d % 5 = 0 OR EXISTS (SELECT 1 FROM scope s2 WHERE s2.d = dep.d AND s2.channel = e.channel) AS in_scope FROM e JOIN dep ON e.t_start_ms <= dep.c1 AND dep.c0 <= e.t_end_ms)"
_NEAR = "SELECT x.channel, x.t_start_ms, y.channel AS sibling FROM e x JOIN e y ON x.channel <> y.channel AND abs(x.onset_ms - y.onset_ms) <= {within} GROUP BY ALL"
DECIDED = f"""{E2}, {DEPLOYS}, {TOPOLOGY}, {LEDGER.replace('k AS (', 'kk AS (').replace('FROM k', 'FROM kk')}, {_HEALTH}, {_PIPELINE}, {_OVERLAP}, sib AS ({_NEAR.format(within=6 * H)}),
  ins AS (SELECT ov.channel, ov.t_start_ms, ov.d, sib.sibling FROM ov JOIN sib USING (channel, t_start_ms) WHERE ov.d % 5 = 0 OR EXISTS (SELECT 1 FROM scope s2 WHERE s2.d = ov.d AND s2.channel = sib.sibling)),
  pert AS (SELECT * FROM ins UNION SELECT channel, t_start_ms, d, channel FROM ov),
  obs AS (SELECT pert.channel, t_start_ms, d, count(DISTINCT sibling) AS corr, count(DISTINCT node) AS on_, count(DISTINCT rack) AS or_ FROM pert JOIN topo ON topo.channel = pert.sibling GROUP BY pert.channel, t_start_ms, d),
  decl AS (SELECT d, count(*) AS size, count(DISTINCT node) AS dn, count(DISTINCT rack) AS dr FROM scope LEFT JOIN topo USING (channel) GROUP BY d),
  fleet AS (SELECT count(DISTINCT node) AS fn, count(DISTINCT rack) AS fr FROM topo),
  ev AS (SELECT channel, t_start_ms, event_id, false AS pipe, d AS ord, CASE WHEN NOT in_scope THEN 'out_of_scope' WHEN corr < 2 OR corr < 0.25 * coalesce(size, corr) THEN 'isolated' WHEN coalesce(dn, fn) < 2 THEN 'narrow_blast_radius'
      WHEN on_ < 2 THEN 'fault_domain' WHEN fr > 1 AND or_ = 1 AND coalesce(dr, fr) <> 1 THEN 'fault_domain' ELSE 'corroborated' END AS verdict FROM ov JOIN obs USING (channel, t_start_ms, d) LEFT JOIN decl USING (d), fleet
    UNION ALL SELECT channel, e.t_start_ms, event_id, true, 1000, CASE WHEN disturbed THEN 'pipeline_disturbed' ELSE 'implausible' END FROM e JOIN pe ON e.t_start_ms <= pe.t_end_ms AND pe.t_start_ms <= e.t_end_ms),
  best AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY channel, t_start_ms ORDER BY CASE verdict WHEN 'corroborated' THEN 0 WHEN 'pipeline_disturbed' THEN 0 WHEN 'fault_domain' THEN 1 WHEN 'narrow_blast_radius' THEN 2 WHEN 'isolated' THEN 3 WHEN 'implausible' THEN 4 ELSE 5 END, pipe, ord, event_id) = 1),
  dec AS (SELECT e.*, coalesce(verdict, 'no_context') AS verdict, CASE WHEN verdict IN ('corroborated', 'pipeline_disturbed') THEN 'attributed' ELSE 'real' END AS status, CASE WHEN verdict IN ('corroborated', 'pipeline_disturbed') THEN event_id END AS attributed_to
    FROM e LEFT JOIN best USING (channel, t_start_ms))"""
_RECUR = f"SELECT x.channel, x.t_start_ms, count(y.onset_ms) AS recurrences FROM e x LEFT JOIN e y ON x.channel = y.channel AND y.onset_ms <> x.onset_ms AND abs(x.onset_ms - y.onset_ms) <= {5 * DAY} GROUP BY ALL"
_SHOULDER = "sh0 AS (SELECT e.channel, e.t_start_ms, s.start_ms, s.score, max(CASE WHEN s.score < 1.25 THEN s.start_ms END) OVER (PARTITION BY e.channel, e.t_start_ms) AS failed FROM e JOIN s ON s.channel = e.channel AND s.end_ms <= e.t_start_ms), sh AS (SELECT e.channel, e.t_start_ms, count(sh0.start_ms) FILTER (WHERE failed IS NULL OR sh0.start_ms > failed) AS shoulder FROM e LEFT JOIN sh0 USING (channel, t_start_ms) GROUP BY ALL)"
_SECOND = f"{_scores('m2', 72 * H, 24 * H, '2')}, op AS (SELECT e.channel, e.t_start_ms, CASE WHEN max(CASE WHEN s2.start_ms <= e.t_end_ms AND e.t_start_ms <= s2.end_ms THEN s2.score END) >= 2.0 THEN 'agrees' WHEN max(CASE WHEN s2.start_ms <= e.t_end_ms AND e.t_start_ms <= s2.end_ms THEN s2.score END) IS NULL OR max(s2.end_ms) < max(e.t_end_ms) THEN 'abstains' ELSE 'dissents' END AS opinion, max(CASE WHEN s2.start_ms <= e.t_end_ms AND e.t_start_ms <= s2.end_ms THEN s2.score END) AS best FROM e LEFT JOIN s2 ON s2.channel = e.channel GROUP BY e.channel, e.t_start_ms)"
_CLASS = "EXISTS (SELECT 1 FROM fault t WHERE t.channel = x.channel AND x.t_start_ms <= t.f1 + 30000 AND t.f0 - 30000 <= x.t_end_ms) AS on_fault, EXISTS (SELECT 1 FROM artifact t WHERE t.channel = x.channel AND x.t_start_ms <= t.f1 + 30000 AND t.f0 - 30000 <= x.t_end_ms) AS on_artifact"
LABELLED = "z AS (SELECT doc_id AS pos, CAST(n_chars AS DOUBLE) AS score, toxic AS label FROM labels JOIN documents USING (doc_id))"
CURVE = f"{LABELLED}, y AS (SELECT score, sum(label) AS p, count(*) AS n FROM z GROUP BY score), pr AS (SELECT score, CAST(sum(p) OVER (ORDER BY score DESC) AS BIGINT) AS tp, CAST(sum(n - p) OVER (ORDER BY score DESC) AS BIGINT) AS fp, CAST(sum(p) OVER () AS BIGINT) AS total FROM y), pc AS (SELECT score, tp, fp, tp / (tp + fp) AS precision, CASE WHEN total > 0 THEN tp / total ELSE 0 END AS recall FROM pr)"
REGIONS = f"{LABELLED}, r0 AS (SELECT *, CASE WHEN label = 1 AND coalesce(lag(label) OVER (ORDER BY pos), 0) <> 1 THEN 1 ELSE 0 END AS new FROM z), r1 AS (SELECT *, sum(new) OVER (ORDER BY pos) AS region FROM r0), reg AS (SELECT region, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS points FROM r1 WHERE label = 1 GROUP BY region)"
EXAMPLES = "ex AS (SELECT doc_id AS ord, text AS prompt, lang AS symptom, source, CASE WHEN CAST('0x' || substr(md5(source), 1, 4) AS BIGINT) % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM documents)"
_WIRE = "arrival % 51 <> 0 AND arrival % 50 <> 0"
MINUTES = f"{M3}, id AS (SELECT channel, seq, event_ts_ms, sum(value) AS s, count(*) AS n, min(value) AS lo, max(value) AS hi FROM m3 GROUP BY ALL)"

FINISHED = f"""{DECIDED}, {_SECOND}, {_SHOULDER}, rec AS ({_RECUR}),
  y1 AS (SELECT dec.*, opinion, recurrences, shoulder, opinion = 'agrees' AND status = 'attributed' AS back, opinion = 'dissents' AND status = 'real' AS gone FROM dec JOIN op USING (channel, t_start_ms) JOIN rec USING (channel, t_start_ms) JOIN sh USING (channel, t_start_ms)),
  y2 AS (SELECT channel, t_start_ms, window_count, recurrences, shoulder, CASE WHEN back THEN 'second_opinion_agrees' WHEN gone THEN 'second_opinion_dissents' ELSE verdict END AS verdict, CASE WHEN back THEN 'real' WHEN gone THEN 'attributed' ELSE status END AS status, CASE WHEN NOT back AND NOT gone THEN attributed_to END AS attributed_to FROM y1),
  y3 AS (SELECT *, window_count < 2 AND recurrences = 0 AND shoulder = 0 AND status = 'real' AS flicker FROM y2),
  done AS (SELECT channel, t_start_ms, CASE WHEN flicker THEN 'no_persistence' ELSE verdict END AS verdict, CASE WHEN flicker THEN 'attributed' ELSE status END AS status, CASE WHEN NOT flicker THEN attributed_to END AS attributed_to FROM y3)"""
COVERED = "cov AS (SELECT f.channel, f.incident, f.f0, f.f1, arg_min(dep.event_id, dep.d) AS window_id, arg_min(dep.d % 2 = 0, dep.d) AS window_perturbed FROM fault f LEFT JOIN dep ON f.f0 <= dep.c1 AND dep.c0 <= f.f1 AND (dep.d % 5 = 0 OR EXISTS (SELECT 1 FROM scope sc WHERE sc.d = dep.d AND sc.channel = f.channel)) GROUP BY ALL)"
PASSES = f"""{DECIDED}, {TRUTH}, {COVERED}, obs2 AS (SELECT 'shadow' AS label, channel, t_start_ms, t_end_ms, 'real' AS status FROM dec UNION ALL SELECT 'conditioned', channel, t_start_ms, t_end_ms, status FROM dec),
  pg AS (SELECT x.label, {_CLASS} FROM obs2 x WHERE x.status = 'real'),
  pn AS (SELECT l.label, (SELECT count(*) FROM obs2 WHERE obs2.label = l.label) AS episodes, count(pg.label) AS paged, count(*) FILTER (WHERE on_artifact) AS artifact_pages, count(*) FILTER (WHERE NOT on_artifact AND NOT on_fault) AS unexplained_pages FROM (VALUES ('shadow'), ('conditioned')) l(label) LEFT JOIN pg ON pg.label = l.label GROUP BY l.label),
  fd AS (SELECT l.label, cov.*, EXISTS (SELECT 1 FROM obs2 o WHERE o.label = l.label AND o.status = 'real' AND o.channel = cov.channel AND o.t_start_ms <= f1 + 30000 AND f0 - 30000 <= o.t_end_ms) AS found FROM cov, (VALUES ('shadow'), ('conditioned')) l(label)),
  inc AS (SELECT label, incident, bool_or(found) AS found, count(*) AS k, count(*) FILTER (WHERE found) AS kf, arg_min(window_id, f0::VARCHAR || channel) FILTER (WHERE window_id IS NOT NULL) AS wid, arg_min(window_perturbed, f0::VARCHAR || channel) FILTER (WHERE window_id IS NOT NULL) AS wp FROM fd GROUP BY ALL),
  ir AS (SELECT label, count(*) AS faults_total, count(*) FILTER (WHERE found) AS faults_detected, count(wid) AS inside_total, count(wid) FILTER (WHERE found) AS inside_detected, count(*) FILTER (WHERE wid IS NULL) AS outside_total, count(*) FILTER (WHERE wid IS NULL AND found) AS outside_detected,
    count(*) FILTER (WHERE NOT wp) AS quiet_total, count(*) FILTER (WHERE NOT wp AND found) AS quiet_detected, CAST(sum(k) AS BIGINT) AS channels_total, CAST(sum(kf) AS BIGINT) AS channels_detected FROM inc GROUP BY label),
  scores AS (SELECT *, artifact_pages + unexplained_pages AS false_pages, faults_detected / faults_total AS recall, CASE WHEN inside_total > 0 THEN inside_detected / inside_total ELSE 0 END AS recall_inside FROM pn JOIN ir USING (label))"""

SQL: dict[str, str] = {
    "decode_readings": f"SELECT event_id AS arrival, event_type AS channel, event_id AS seq, event_id * 1000 AS event_ts_ms, user_id + 0.5::DOUBLE AS value FROM events WHERE {_WIRE.replace('arrival', 'event_id')}",
    "malformed_split": f"SELECT {_WIRE.replace('arrival', 'event_id')} AS ok, count(*) AS n FROM events GROUP BY 1",
    "payload_fanout": "WITH u AS (SELECT l_returnflag || '.quantity' AS channel, l_orderkey * 10 + l_linenumber AS key, CAST(l_quantity AS DOUBLE) AS value FROM lineitem UNION ALL SELECT l_returnflag || '.charge', l_orderkey * 10 + l_linenumber, l_extendedprice * (1 - l_discount) FROM lineitem UNION ALL SELECT l_returnflag || '.high_tax', l_orderkey * 10 + l_linenumber, l_tax FROM lineitem WHERE l_tax > 0.04) SELECT channel, count(*) AS readings, round(sum(value), 2) AS total, max(key) AS last_key FROM u GROUP BY channel",
    "sliding_windows": f"WITH {M1}, {_windows('m1', 48 * H, 12 * H, 8)} SELECT channel, start_ms, end_ms, n, round(mean + 1e-9, 6) AS mean, round(var + 1e-9, 6) AS var FROM w",
    "tumbling_windows": f"WITH {M1} SELECT channel, event_ts_ms // {DAY} * {DAY} AS start_ms, event_ts_ms // {DAY} * {DAY} + {DAY} AS end_ms, count(*) AS n, round(avg(value) + 1e-9, 6) AS mean FROM m1 GROUP BY ALL",
    "late_filter": f"WITH {M3}, x AS (SELECT channel, event_ts_ms < max(event_ts_ms) OVER (PARTITION BY channel ORDER BY arrival ROWS UNBOUNDED PRECEDING) - {H} AS late FROM m3) SELECT channel, count(*) AS readings, count(*) FILTER (WHERE late) AS late FROM x GROUP BY channel",
    "zscore_scores": f"WITH {S1} SELECT channel, start_ms, end_ms, n, round(window_mean + 1e-9, 6) AS window_mean, round(reference_mean + 1e-9, 6) AS reference_mean, round(mean_z + 1e-9, 6) AS mean_z, round(dispersion_z + 1e-9, 6) AS dispersion_z, round(score + 1e-9, 6) AS score FROM s",
    "score_onset": f"WITH {E1} SELECT channel, start_ms, onset_ms FROM onset",
    "detect_episodes": f"WITH {E1} SELECT channel, t_start_ms, t_end_ms, window_count, onset_ms, round(peak_score + 1e-9, 6) AS peak_score, round(mean_score + 1e-9, 6) AS mean_score FROM e",
    "detect_node_episodes": f"WITH {E2} SELECT channel, t_start_ms, t_end_ms, window_count, onset_ms, round(peak_score + 1e-9, 6) AS peak_score FROM e",
    "episode_scores": f"WITH {E1} SELECT e.channel, t_start_ms, start_ms, round(score + 1e-9, 6) AS score FROM e JOIN s ON s.channel = e.channel AND s.start_ms >= t_start_ms AND s.end_ms <= t_end_ms WHERE score >= 1.5",
    "detector_stats": f"WITH {E1} SELECT 'zscore' AS raised_by, count(*) AS episodes, round(avg(peak_score), 2) AS mean_peak, round(max(peak_score), 2) AS max_peak, CAST(sum(window_count) AS BIGINT) AS windows FROM e",
    "score_percentiles": f"WITH {S1}, r AS (SELECT round(score + 1e-9, 6) AS score FROM s) SELECT quantile_disc(score, 0.5) AS p50, quantile_disc(score, 0.95) AS p95, quantile_disc(score, 0.99) AS p99, max(score) AS max_score, count(*) AS n FROM r",
    "nearest_rank_pct": f"WITH {E2}, r AS (SELECT round(peak_score + 1e-9, 6) AS v, row_number() OVER (ORDER BY peak_score) - 1 AS i, count(*) OVER () AS n FROM e) SELECT 'zscore' AS raised_by, max(CASE WHEN i = least(CAST(floor(n * 0.5) AS BIGINT), n - 1) THEN v END) AS p50, max(CASE WHEN i = least(CAST(floor(n * 0.9) AS BIGINT), n - 1) THEN v END) AS p90, max(v) AS p100 FROM r HAVING count(*) > 0",
    "recent_episodes": f"WITH {E2} SELECT channel, t_start_ms, round((t_end_ms - t_start_ms) / 1000, 1) AS duration_s FROM e ORDER BY t_start_ms DESC, channel DESC LIMIT 10",
    "episodes_in_span": f"WITH {E2} SELECT channel, t_start_ms, t_end_ms FROM e WHERE t_start_ms <= {FIRST + 15 * DAY} AND t_end_ms >= {FIRST + 10 * DAY}",
    "interval_union": f"WITH {E2}, b AS (SELECT t_start_ms, t_end_ms, max(t_end_ms) OVER (ORDER BY t_start_ms, t_end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e), n AS (SELECT *, sum(CASE WHEN before IS NULL OR t_start_ms > before THEN 1 ELSE 0 END) OVER (ORDER BY t_start_ms, t_end_ms ROWS UNBOUNDED PRECEDING) AS isl FROM b) SELECT min(t_start_ms) AS t_start_ms, max(t_end_ms) AS t_end_ms, count(*) AS merged FROM n GROUP BY isl",
    "sequence_ledger": f"WITH {LEDGER} SELECT channel, arrival, seq, missing, duplicate, regression FROM l WHERE missing > 0 OR duplicate > 0 OR regression > 0",
    "channel_drift": f"WITH {CHANNELS} SELECT channel, readings, first_seq, last_seq, CAST(missing AS BIGINT) AS missing, CAST(duplicates AS BIGINT) AS duplicates, CAST(regressions AS BIGINT) AS regressions, span, drift FROM drift",
    "drift_report": f"WITH {CHANNELS} SELECT CAST(sum(readings) AS BIGINT) AS readings, CAST(sum(missing) AS BIGINT) AS missing, CAST(sum(duplicates) AS BIGINT) AS duplicates, CAST(sum(regressions) AS BIGINT) AS regressions, CAST(sum(drift) AS BIGINT) AS drift, count(*) AS channels, count(*) FILTER (WHERE drift <> 0) AS unhealthy FROM drift",
    "pipeline_health": f"WITH {HEALTH} SELECT * FROM health",
    "health_histogram": f"WITH {HEALTH} SELECT severity, count(*) AS windows, CAST(sum(missing) AS BIGINT) AS missing FROM health GROUP BY severity",
    "health_context_events": f"WITH {HEALTH}, {_PIPELINE} SELECT event_id, kind, t_start_ms, t_end_ms, severity, detail FROM pe",
    "source_watermark": f"WITH {M3}, x AS (SELECT source, max(event_ts_ms) AS high_ms, count(*) AS readings FROM m3 GROUP BY source) SELECT *, min(high_ms) OVER () AS watermark_ms FROM x",
    "dedup_exact": f"WITH {M3}, x AS (SELECT channel, seq, event_ts_ms, max(arrival) AS arrival FROM m3 GROUP BY ALL) SELECT channel, count(*) AS readings, CAST(sum(arrival) AS BIGINT) AS arrivals FROM x GROUP BY channel",
    "duplicate_rows": f"WITH {M3}, x AS (SELECT DISTINCT channel, seq, event_ts_ms FROM m3) SELECT (SELECT count(*) FROM m3) AS rows, (SELECT count(*) FROM x) AS distinct_rows, (SELECT count(*) FROM m3) - (SELECT count(*) FROM x) AS duplicate_rows",
    "lake_identities": f"WITH {M3}, x AS (SELECT DISTINCT channel, seq, event_ts_ms FROM m3) SELECT channel, count(*) AS readings, count(DISTINCT seq) AS distinct_seq, min(seq) AS seq_min, max(seq) AS seq_max, max(seq) - min(seq) + 1 - count(DISTINCT seq) AS drift, count(*) - count(DISTINCT seq) AS reused_seq FROM x GROUP BY channel",
    "ledger_vs_lake": f"WITH {M3}, x AS (SELECT DISTINCT channel, seq, event_ts_ms FROM m3 WHERE channel <> 'view'), b AS (SELECT channel, count(*) AS n FROM x GROUP BY channel), c AS (SELECT channel, count(*) AS n FROM m3 GROUP BY channel) SELECT channel, c.n AS in_ledger, coalesce(b.n, 0) AS in_store, c.n - coalesce(b.n, 0) AS difference FROM c FULL JOIN b USING (channel)",
    "rollup_minute": f"WITH {MINUTES} SELECT channel, event_ts_ms // {H} * {H} AS minute_ms, count(*) AS readings, min(lo) AS value_min, max(hi) AS value_max, min(seq) AS seq_min, max(seq) AS seq_max, round(sum(s) / sum(n) + 1e-9, 4) AS mean FROM id GROUP BY 1, 2",
    "rollup_merge": f"WITH {M3}, id AS (SELECT channel, seq, event_ts_ms, any_value(value) AS value FROM m3 GROUP BY ALL) SELECT channel, event_ts_ms // {H} * {H} AS minute_ms, count(*) AS readings, min(value) AS value_min, max(value) AS value_max, min(seq) AS seq_min, max(seq) AS seq_max, round(avg(value) + 1e-9, 4) AS mean FROM id GROUP BY 1, 2",
    "encoded_readings": f"WITH {M1} SELECT true AS ok, channel, coalesce(injected, '') AS injected, count(*) AS readings, CAST(sum(seq) AS BIGINT) AS seqs, max(event_ts_ms) AS last_ms FROM m1 GROUP BY ALL",
    "batched_scores": f"WITH {M1}, {_windows('m1', 48 * H, 12 * H, 8)} SELECT channel, start_ms, round(mean * 2 + 1e-9, 6) AS score FROM w",
    "channel_summary": f"WITH {MINUTES} SELECT channel, count(*) AS readings, round(sum(s) / sum(n) + 1e-9, 4) AS mean, min(lo) AS low, max(hi) AS high, min(seq) AS seq_min, max(seq) AS seq_max, count(DISTINCT event_ts_ms // 60000) AS minutes, max(seq) - min(seq) + 1 - count(*) AS gap FROM id GROUP BY channel",
    "channel_series": f"WITH {M1} SELECT event_ts_ms // 60000 * 60000 AS minute_ms, count(*) AS readings, round(avg(value) + 1e-9, 4) AS mean FROM m1 WHERE channel = 'click' GROUP BY 1 ORDER BY 1 DESC LIMIT 60",
    "recent_points": f"WITH {M1}, x AS (SELECT channel, event_ts_ms // 1000 * 1000 AS second_ms, round(avg(value) + 1e-9, 6) AS value, count(*) AS n FROM m1 WHERE event_ts_ms >= (SELECT max(event_ts_ms) FROM m1) - 3600000 GROUP BY 1, 2), c AS (SELECT channel FROM x GROUP BY channel ORDER BY count(*) DESC, channel LIMIT 3) SELECT * FROM x WHERE channel IN (SELECT channel FROM c)",
    "score_distribution": f"WITH {S1} SELECT 'zscore' AS detector, count(*) AS windows, count(DISTINCT channel) AS channels, round(avg(score) + 1e-9, 6) AS mean_score, round(max(score) + 1e-9, 6) AS max_score, round(quantile_cont(score, 0.95) + 1e-9, 6) AS p95, round(quantile_cont(score, 0.99) + 1e-9, 6) AS p99 FROM s",
    "context_overlap": f"WITH {E2}, {DEPLOYS}, {_OVERLAP} SELECT channel, t_start_ms, event_id, in_scope FROM ov",
    "context_scope": f"WITH {E2}, {DEPLOYS}, {_OVERLAP} SELECT event_id, count(*) AS episodes, count(*) FILTER (WHERE in_scope) AS in_scope FROM ov GROUP BY event_id",
    "retention_filter": f"WITH {DEPLOYS} SELECT event_id, c1 AS t_end_ms FROM dep WHERE c1 >= (SELECT max(c1) FROM dep) - {5 * DAY}",
    "synchronous_siblings": f"WITH {E2}, sib AS ({_NEAR.format(within=6 * H)}) SELECT e.channel, e.t_start_ms, coalesce(string_agg(sibling, ',' ORDER BY sibling), '') AS siblings FROM e LEFT JOIN sib USING (channel, t_start_ms) GROUP BY ALL",
    "flagged_in_span": f"WITH {E2}, x AS (SELECT DISTINCT x.channel, x.t_start_ms, y.channel AS f FROM e x JOIN e y ON y.onset_ms BETWEEN x.t_start_ms AND x.t_end_ms) SELECT channel, t_start_ms, string_agg(f, ',' ORDER BY f) AS flagged FROM x GROUP BY ALL",
    "recurrences": f"WITH {E2} {_RECUR}",
    "topology_derive": f"WITH {M2}, {TOPOLOGY} SELECT channel, node, rack, ring FROM topo",
    "topology_summary": f"WITH {M2}, {TOPOLOGY} SELECT rack, count(*) AS channels, count(DISTINCT node) AS nodes, string_agg(DISTINCT node, ',' ORDER BY node) AS names FROM topo GROUP BY rack",
    "footprint": f"WITH {M2}, {TOPOLOGY}, {DEPLOYS} SELECT event_id, count(DISTINCT node) AS declared_nodes, count(DISTINCT rack) AS declared_racks, count(*) FILTER (WHERE node IS NULL) AS declared_unplaced FROM scope LEFT JOIN topo USING (channel) GROUP BY event_id",
    "second_opinion": f"WITH {E2}, {_SECOND} SELECT channel, t_start_ms, opinion, round(best + 1e-9, 6) AS best FROM op",
    "persistence_shoulder": f"WITH {E2}, {_SHOULDER} SELECT * FROM sh",
    "context_verdicts": f"WITH {DECIDED} SELECT channel, t_start_ms, verdict, status, attributed_to FROM dec",
    "final_verdicts": f"WITH {FINISHED} SELECT channel, t_start_ms, verdict, status, attributed_to FROM done",
    "verdict_histogram": f"WITH {DECIDED}, {TRUTH}, x AS (SELECT verdict, {_CLASS} FROM dec x) SELECT verdict, count(*) FILTER (WHERE on_fault) AS fault, count(*) FILTER (WHERE on_artifact AND NOT on_fault) AS artifact, count(*) FILTER (WHERE NOT on_artifact AND NOT on_fault) AS unexplained FROM x GROUP BY verdict",
    "fleet_watermark": f"WITH {M2}, x AS (SELECT channel, max(event_ts_ms) - {H} AS mark FROM m2 GROUP BY channel) SELECT min(mark) AS watermark_ms, count(*) AS channels FROM x WHERE mark >= (SELECT max(mark) FROM x) - {6 * H}",
    "barrier_release": f"WITH {E2} SELECT channel, t_start_ms, onset_ms AS began_ms, onset_ms + 30000 <= {FIRST + 15 * DAY} AS released FROM e",
    "nearest_point": f"WITH {E1}, x AS (SELECT e.channel, t_start_ms + 12345 AS at_ms, m1.event_ts_ms, value, row_number() OVER (PARTITION BY e.channel, t_start_ms ORDER BY abs(m1.event_ts_ms - t_start_ms - 12345), m1.event_ts_ms, m1.arrival) AS i FROM e JOIN m1 ON m1.channel = e.channel) SELECT channel, at_ms, event_ts_ms, value FROM x WHERE i = 1",
    "paired_scores": f"""WITH {PASSES} SELECT a.paged AS shadow_paged, a.false_pages AS shadow_false_pages, b.paged AS conditioned_paged, b.false_pages AS conditioned_false_pages,
      round(a.recall + 1e-9, 6) AS shadow_recall, round(b.recall + 1e-9, 6) AS conditioned_recall, round(red + 1e-9, 6) AS false_reduction, round(a.recall - b.recall + 1e-9, 6) AS recall_loss, round(a.recall_inside - b.recall_inside + 1e-9, 6) AS recall_loss_inside,
      red >= 0.4 AND a.recall - b.recall <= 0.05 AS meets_target FROM scores a, scores b, (SELECT CASE WHEN max(CASE WHEN label = 'shadow' THEN false_pages END) > 0 THEN (max(CASE WHEN label = 'shadow' THEN false_pages END) - max(CASE WHEN label <> 'shadow' THEN false_pages END)) / max(CASE WHEN label = 'shadow' THEN false_pages END) ELSE 0 END AS red FROM scores)
      WHERE a.label = 'shadow' AND b.label = 'conditioned'""",
    "paired_report": f"""WITH {PASSES} SELECT label, episodes, paged, episodes - paged AS attributed, artifact_pages, unexplained_pages, faults_total, faults_detected, inside_total, inside_detected, outside_total, outside_detected, quiet_total, quiet_detected, channels_total, channels_detected,
      round(recall + 1e-9, 6) AS recall, round(recall_inside + 1e-9, 6) AS recall_inside, round(CASE WHEN outside_total > 0 THEN outside_detected / outside_total ELSE 0 END + 1e-9, 6) AS recall_outside, round(CASE WHEN quiet_total > 0 THEN quiet_detected / quiet_total ELSE 0 END + 1e-9, 6) AS recall_quiet,
      round(CASE WHEN channels_total > 0 THEN channels_detected / channels_total ELSE 0 END + 1e-9, 6) AS recall_channels, round(CASE WHEN paged > 0 THEN (paged - false_pages) / paged ELSE 0 END + 1e-9, 6) AS precision FROM scores""",
    "fault_windows": f"WITH {DEPLOYS}, {TRUTH}, {COVERED} SELECT channel, f0 AS t_start_ms, incident, window_id, window_perturbed FROM cov",
    "verdict_breakdown": f"WITH {FINISHED}, {TRUTH}, x AS (SELECT verdict, {_CLASS} FROM (SELECT done.*, e.t_end_ms FROM done JOIN e USING (channel, t_start_ms)) x) SELECT verdict, count(*) FILTER (WHERE on_fault) AS fault, count(*) FILTER (WHERE on_artifact AND NOT on_fault) AS artifact, count(*) FILTER (WHERE NOT on_artifact AND NOT on_fault) AS unexplained FROM x GROUP BY verdict",
    "fail_open_compare": f"""WITH {DECIDED}, n AS (SELECT count(*) AS k, count(*) FILTER (WHERE status <> 'real') AS s, count(attributed_to) AS a FROM dec)
      SELECT p AS pass, k AS shadow_episodes, k AS fail_open_episodes, CASE p WHEN 'conditioned' THEN k - s ELSE k END AS identical, 0 AS missing, 0 AS extra, CASE p WHEN 'conditioned' THEN s ELSE 0 END AS suppressed, CASE p WHEN 'conditioned' THEN a ELSE 0 END AS attributed,
      p <> 'conditioned' OR (s = 0 AND a = 0) AS held FROM n, (VALUES ('no_events'), ('unavailable'), ('conditioned')) v(p)""",
    "recall_by_domain": f"WITH {E2}, {DEPLOYS}, {TRUTH}, x AS (SELECT incident, max(CASE WHEN e.channel IS NOT NULL THEN 1 ELSE 0 END) AS found FROM fault LEFT JOIN e ON e.channel = fault.channel AND e.t_start_ms <= f1 + 30000 AND f0 - 30000 <= e.t_end_ms GROUP BY incident) SELECT 'node' AS domain, count(*) AS incidents, CAST(sum(found) AS BIGINT) AS found FROM x",
    "fail_open_check": f"WITH {E2} SELECT 'fail_open' AS verdict, 'real' AS status, count(*) AS episodes FROM e HAVING count(*) > 0",
    "pr_curve": f"WITH {CURVE} SELECT score, tp, fp, round(precision + 1e-9, 6) AS precision, round(recall + 1e-9, 6) AS recall FROM pc",
    "auc_pr": f"WITH {CURVE}, x AS (SELECT (recall - coalesce(lag(recall) OVER (ORDER BY score DESC), 0)) * precision AS a FROM pc) SELECT round(coalesce(sum(a), 0) + 1e-9, 6) AS auc_pr FROM x",
    "roc_auc": f"WITH {LABELLED}, x AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS r FROM z), t AS (SELECT sum(CASE WHEN label = 1 THEN r END) AS s, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS q FROM x) SELECT round((s - p * (p + 1) / 2) / (p * q) + 1e-9, 6) AS roc_auc FROM t",
    "budget_f1": f"WITH {LABELLED}, x AS (SELECT label, row_number() OVER (ORDER BY score DESC, pos) AS i, greatest(1, sum(label) OVER ()) AS budget FROM z), t AS (SELECT CAST(max(budget) AS BIGINT) AS budget, CAST(sum(label) FILTER (WHERE i <= budget) AS BIGINT) AS hits FROM x) SELECT budget, hits, round(hits / budget + 1e-9, 6) AS precision, round(hits / budget + 1e-9, 6) AS recall, round(hits / budget + 1e-9, 6) AS f1 FROM t",
    "labelled_regions": f"WITH {REGIONS} SELECT CAST(region AS BIGINT) AS region, first_pos, last_pos, points FROM reg",
    "detection_delay": f"WITH {REGIONS} SELECT CAST(region AS BIGINT) AS region, min(z.pos) - any_value(first_pos) AS delay FROM reg LEFT JOIN z ON z.pos BETWEEN first_pos AND last_pos AND z.score >= 5000 GROUP BY region",
    "benchmark_fold": f"WITH {S2}, x AS (SELECT split_part(s.channel, '.', 1) AS series, s.start_ms, s.score, CASE WHEN EXISTS (SELECT 1 FROM m2 WHERE m2.channel = s.channel AND m2.injected IS NOT NULL AND m2.event_ts_ms >= s.start_ms AND m2.event_ts_ms < s.end_ms) THEN 1 ELSE 0 END AS label FROM s) SELECT series, start_ms, round(max(score) + 1e-9, 6) AS score, max(label) AS label FROM x GROUP BY ALL",
    "parity_compare": f"WITH {S1} SELECT count(*) FILTER (WHERE channel <> 'view') AS shared, count(*) FILTER (WHERE channel = 'view') AS only_left, 0 AS only_right, count(*) FILTER (WHERE channel <> 'view' AND n % 5 = 0) AS disagreements, CASE WHEN count(*) FILTER (WHERE channel <> 'view' AND n % 5 = 0) > 0 THEN 1.0::DOUBLE WHEN count(*) FILTER (WHERE channel <> 'view') > 0 THEN 0.0::DOUBLE END AS largest FROM s",
    "corroboration_sweep": f"WITH {E2}, sib AS ({_NEAR.format(within=24 * H)}), x AS (SELECT e.channel, e.t_start_ms, count(sibling) + 1 AS n FROM e LEFT JOIN sib USING (channel, t_start_ms) GROUP BY ALL) SELECT CAST(bar AS INTEGER) AS bar, count(x.n) AS n FROM (VALUES (1), (2), (3), (4), (6), (8)) b(bar) LEFT JOIN x ON x.n >= bar GROUP BY bar",
    "bm25_search": """WITH d AS (SELECT doc_id AS title, regexp_extract_all(lower(doc_id || ' ' || text), '[a-z0-9_]+') AS terms FROM documents), st AS (SELECT count(*) AS docs, avg(len(terms)) AS avg_len FROM d),
      q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM benchmark), t AS (SELECT title, len(terms) AS n, unnest(terms) AS term FROM d),
      tf AS (SELECT title, n, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
      s AS (SELECT query_id, title, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / avg_len))) AS score FROM q JOIN tf USING (term) JOIN df USING (term), st GROUP BY query_id, title),
      r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, title) AS rank FROM s WHERE score > 0) SELECT query_id, title, rank, round(score + 1e-9, 6) AS score FROM r WHERE rank <= 3""",
    "diagnose": f"WITH {E2} SELECT channel, t_start_ms, CASE WHEN regexp_matches(lower(channel), 'safety|interlock|fire|emergency') THEN 'safety_channel' WHEN window_count <= 1 AND t_end_ms - t_start_ms <= 60000 THEN 'isolated_spike' WHEN 2 * burst_windows > window_count THEN 'variance_burst' ELSE 'level_shift' END AS symptom FROM e",
    "plan_actions": f"""WITH {E2}, x AS (SELECT channel, t_start_ms, CASE WHEN 2 * burst_windows > window_count THEN ['describe_channel', 'fetch_recent_readings', 'raise_ticket'] ELSE ['describe_channel', 'fetch_recent_readings', 'request_recalibration', 'raise_ticket'] END AS actions FROM e)
      SELECT channel, t_start_ms, CAST(i AS INTEGER) AS step, actions[i + 1] AS action FROM (SELECT *, unnest(range(len(actions))) AS i FROM x)""",
    "gate_verdicts": f"""WITH {DECIDED}, x AS (SELECT status, unnest(CASE WHEN 2 * burst_windows > window_count THEN ['describe_channel', 'fetch_recent_readings', 'raise_ticket'] ELSE ['describe_channel', 'fetch_recent_readings', 'request_recalibration', 'raise_ticket'] END) AS action FROM dec)
      SELECT action, action IN ('describe_channel', 'fetch_recent_readings') OR status = 'real' AS approved, CASE WHEN action IN ('describe_channel', 'fetch_recent_readings') THEN 'read_only' WHEN status = 'real' THEN 'within_limits' ELSE 'episode_not_actionable' END AS reason, count(*) AS n FROM x GROUP BY ALL""",
    "prompt_dedup_cap": f"WITH {EXAMPLES}, x AS (SELECT *, sha256(prompt) AS digest, row_number() OVER (PARTITION BY prompt ORDER BY ord) AS i FROM ex), y AS (SELECT *, row_number() OVER (PARTITION BY split, symptom ORDER BY ord) AS k FROM x WHERE i = 1) SELECT ord, split, symptom, digest FROM y WHERE k <= 40",
    "channel_split": f"WITH {EXAMPLES} SELECT source, split, count(*) AS n FROM ex GROUP BY ALL",
    "dataset_summary": f"WITH {EXAMPLES} SELECT split, symptom, count(*) AS n, count(DISTINCT source) AS sources FROM ex GROUP BY ALL",
    "leakage_check": f"WITH {EXAMPLES} SELECT count(*) AS shared_sources FROM (SELECT source FROM ex GROUP BY source HAVING count(DISTINCT split) > 1)",
    "stream_windows": f"WITH {M3}, x AS (SELECT *, max(event_ts_ms) OVER (PARTITION BY channel ORDER BY arrival ROWS UNBOUNDED PRECEDING) - {H} AS mark FROM m3), kept AS (SELECT * FROM x WHERE event_ts_ms >= mark), {_windows('kept', 48 * H, 12 * H, 8)} SELECT channel, start_ms, end_ms, n, round(mean + 1e-9, 6) AS mean FROM w",
    "stream_ledger": f"WITH {CHANNELS} SELECT channel, readings, last_seq, CAST(missing AS BIGINT) AS missing, CAST(duplicates AS BIGINT) AS duplicates, CAST(regressions AS BIGINT) AS regressions FROM drift",
    "stream_dedup": f"WITH {M3}, x AS (SELECT DISTINCT channel, seq, event_ts_ms FROM m3) SELECT channel, count(*) AS readings, max(seq) AS seq_max FROM x GROUP BY channel",
    "stream_rollup": f"WITH {M3} SELECT channel, event_ts_ms // {DAY} * {DAY} AS start_ms, min(value) AS low, max(value) AS high FROM m3 GROUP BY 1, 2",
    "stream_episodes": f"WITH {M3}, x AS (SELECT *, max(event_ts_ms) OVER (PARTITION BY channel ORDER BY arrival ROWS UNBOUNDED PRECEDING) - {H} AS mark FROM m3), kept AS (SELECT * FROM x WHERE event_ts_ms >= mark), {_scores('kept', 48 * H, 12 * H)}, {_episodes(1.5)} SELECT channel, t_start_ms, t_end_ms, window_count, round(peak_score + 1e-9, 6) AS peak_score, round(mean_score + 1e-9, 6) AS mean_score FROM e",
    "stream_recovery": f"WITH {CHANNELS} SELECT channel, readings, last_seq, CAST(missing AS BIGINT) AS missing, CAST(duplicates AS BIGINT) AS duplicates, CAST(regressions AS BIGINT) AS regressions FROM drift",
    "stream_health": f"WITH {HEALTH} SELECT window_start_ms, readings, missing, duplicates, regressions, max_lag_ms, channels FROM health",
    "buffered_sink": f"WITH {M3}, pt AS (SELECT CAST(floor(arrival * 3 / (SELECT max(arrival) + 1 FROM m3)) AS INTEGER) AS part, count(*) AS n FROM m3 GROUP BY 1), z AS (SELECT coalesce(max(n) FILTER (WHERE part = 0), 0) AS a, coalesce(max(n) FILTER (WHERE part = 1), 0) AS b, coalesce(max(n) FILTER (WHERE part = 2), 0) AS c FROM pt), y AS (SELECT *, CASE WHEN a >= 5000 THEN 1 ELSE 0 END AS f1, CASE WHEN a >= 5000 THEN 0 ELSE a END AS w1 FROM z), x AS (SELECT *, CASE WHEN w1 + b >= 5000 THEN 1 ELSE 0 END AS f2, CASE WHEN w1 + b >= 5000 THEN 0 ELSE w1 + b END AS w2 FROM y) SELECT a + b + c AS rows, f1 + f2 + CASE WHEN w2 + c > 0 THEN 1 ELSE 0 END AS writes FROM x",
    "stream_barrier": f"WITH {E2}, mk AS (SELECT min(t) AS w FROM (SELECT channel, max(event_ts_ms) AS t FROM m2 GROUP BY channel)) SELECT channel, t_start_ms, onset_ms AS began_ms, CASE WHEN onset_ms + {DAY} <= w THEN 'watermark' ELSE 'flush' END AS \"on\" FROM e, mk",
}
