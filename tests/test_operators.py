"""Behaviour of the operators on small inline tables."""

import math

import pytest
from pyspark.sql import functions as F

from tidelens.functions.expressions import disturbed, grade, nearest_rank
from tidelens.operators import detect, episodes, evaluate, intervals, ledger, policy, retrieval, rollup, rules, store, windows
from tidelens.sources import readings as src

READING = "channel string, seq bigint, arrival bigint, event_ts_ms bigint, value double"


def readings(spark, rows):
    return spark.createDataFrame([("c", i + 1, i, t, float(v)) for i, (t, v) in enumerate(rows)], READING)


def test_a_reading_belongs_to_each_window_that_covers_it(spark):
    r = windows.assign(readings(spark, [(25_000, 1), (30_000, 1)]), 30_000, 10_000)
    got = sorted(tuple(x) for x in r.select("event_ts_ms", "start_ms").collect())
    assert got == [(25_000, 0), (25_000, 10_000), (25_000, 20_000), (30_000, 10_000), (30_000, 20_000), (30_000, 30_000)]


def test_size_must_be_a_multiple_of_slide():
    with pytest.raises(ValueError):
        windows.Sliding(25, 10)


def test_windows_before_the_epoch_floor(spark):
    r = windows.assign(readings(spark, [(-5, 1)]), 20, 10).select("start_ms").collect()
    assert sorted(x[0] for x in r) == [-20, -10]


def test_lateness_is_judged_by_the_channels_highest_event_time(spark):
    r = windows.mark_late(readings(spark, [(5000, 1), (1000, 2), (9000, 3), (3000, 4)]), 5000)
    assert [x[0] for x in r.where("not is_late").orderBy("arrival").select("event_ts_ms").collect()] == [5000, 1000, 9000]


def test_summaries_equal_direct_sums_and_thin_windows_go(spark):
    rows = [(i * 700, math.sin(i) * 10 + 1e6) for i in range(100)]
    got = windows.summaries(readings(spark, rows), windows.Sliding(30_000, 10_000, 8)).collect()
    assert got and all(x["n"] >= 8 for x in got)
    for x in got:
        own = [v for t, v in rows if x["start_ms"] <= t < x["end_ms"]]
        assert x["n"] == len(own) and math.isclose(x["mean"], sum(own) / len(own))
        assert math.isclose(x["dw"], sum(windows.DECAY ** (len(own) - 1 - i) for i in range(len(own))))


def welford(blocks):
    w = mu = m2 = 0.0
    for v in blocks:
        w = windows.DECAY * w + 1
        d = v - mu
        mu += d / w
        m2 = windows.DECAY * m2 + d * (v - mu)
    return w, mu, math.sqrt(max(m2 / (w - 1), 0))


def test_scores_equal_a_sequential_decayed_fold(spark):
    rows = [(i * 500, math.sin(i * 1.7) * 3 + (20 if 450 < i < 470 else 0)) for i in range(600)]
    w = windows.Sliding(30_000, 10_000, 8)
    got = {x["start_ms"]: x for x in detect.zscores(readings(spark, rows), w).collect()}
    seen = []
    for start in range(-20_000, 300_000, 10_000):
        own = [v for t, v in rows if start <= t < start + 30_000]
        if len(own) < 8:
            continue
        if len(seen) >= detect.WARMUP:
            _, mu, sigma = welford(seen)
            mean = sum(own) / len(own)
            assert math.isclose(got[start]["mean_z"], abs(mean - mu) / sigma * math.sqrt(len(own)), rel_tol=1e-6, abs_tol=1e-9)
        else:
            assert start not in got
        seen += own


def test_flat_channels_get_no_score(spark):
    assert detect.zscores(readings(spark, [(i * 500, 1.0) for i in range(400)]), windows.Sliding(30_000, 10_000, 8)).count() == 0


SCORE = "channel string, start_ms bigint, end_ms bigint, score double, mean_z double, dispersion_z double"


def scores(spark, rows):
    return spark.createDataFrame([(c, s, s + 30, float(x), 1.0, 0.0) for c, s, x in rows], SCORE)


def test_episodes_merge_over_calm_windows_and_split_at_the_gap(spark):
    e = episodes.merge(scores(spark, [("a", 0, 9), ("a", 10, 1), ("a", 20, 8), ("a", 100, 9), ("b", 10, 8)]), 8.0, 50)
    got = sorted((x["channel"], x["t_start_ms"], x["t_end_ms"], x["window_count"], x["peak_score"]) for x in e.collect())
    assert got == [("a", 0, 50, 2, 9.0), ("a", 100, 130, 1, 9.0), ("b", 10, 40, 1, 8.0)]


def test_ledger_counts_gaps_duplicates_and_regressions(spark):
    seqs = [5, 6, 9, 9, 7, 10]
    r = spark.createDataFrame([("c", s, i, 0, 0.0) for i, s in enumerate(seqs)], READING)
    x = ledger.by_channel(ledger.label(r)).first()
    assert (x["missing"], x["duplicates"], x["regressions"], x["span"], x["readings"]) == (2, 1, 1, 6, 6)
    assert x["drift"] == x["missing"] - x["duplicates"] - x["regressions"]


def test_severity_and_disturbance(spark):
    rows = [(100, 0, 0, 0), (1, 0, 0, 0), (0, 0, 1, 0), (0, 0, 0, 5000), (0, 0, 0, 120_000), (0, 0, 0, 0)]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, m bigint, d bigint, r bigint, lag bigint")
    assert [x[0] for x in d.orderBy("i").select(grade("m", "d", "r", "lag")).collect()] == ["critical", "warning", "warning", "info", "critical", "ok"]
    details = [("missing=3 duplicates=0", "info", True), ("missing=0 duplicates=0", "critical", False), ("lag=1", "critical", True), ("lag=1", "info", False), (None, "warning", True)]
    d = spark.createDataFrame([(i, *x) for i, x in enumerate(details)], "i int, detail string, severity string, want boolean")
    assert all(x[0] == x[1] for x in d.select(disturbed("detail", "severity"), "want").collect())


def test_replay_leaves_identities_unchanged(spark):
    r = readings(spark, [(i, i) for i in range(10)])
    twice = r.union(r)
    assert sorted(rollup.identities(r).collect()) == sorted(rollup.identities(twice).collect())
    assert rollup.duplicates(twice).first()["duplicate_rows"] == 10
    assert rollup.per_minute(twice).first()["readings"] == 10


def test_upsert_grows_extremes_and_keeps_the_first_onset(spark):
    shape = "channel string, t_start_ms bigint, raised_by string, t_end_ms bigint, peak_score double, window_count bigint, mean_score double, status string, attributed_to string, onset_ms bigint"
    old = spark.createDataFrame([("a", 0, "z", 10, 9.0, 1, 9.0, "real", "x", 3)], shape)
    new = spark.createDataFrame([("a", 0, "z", 30, 8.0, 3, 8.5, "attributed", None, 7)], shape)
    x = store.upsert_episodes(old, new).first()
    assert (x["t_end_ms"], x["peak_score"], x["window_count"], x["mean_score"], x["status"], x["attributed_to"], x["onset_ms"]) == (30, 9.0, 3, 8.5, "attributed", "x", 3)


def test_overlap_join_takes_each_pair_once(spark):
    import random

    rng = random.Random(1)
    a = [(i, s, s + rng.randrange(40)) for i in range(60) for s in [rng.randrange(300)]]
    b = [(i, s, s + rng.randrange(40)) for i in range(60) for s in [rng.randrange(300)]]
    got = intervals.overlap_join(spark.createDataFrame(a, "i int, s bigint, e bigint"), spark.createDataFrame(b, "j int, u bigint, v bigint"), ("s", "e"), ("u", "v"), 7)
    assert sorted(tuple(x) for x in got.select("i", "j").collect()) == sorted((x[0], y[0]) for x in a for y in b if x[1] <= y[2] and y[1] <= x[2])


def test_siblings_within_the_tolerance(spark):
    e = spark.createDataFrame([("a", 0, 0), ("b", 1, 5), ("c", 2, 11), ("d", 3, 6)], "channel string, t_start_ms bigint, onset_ms bigint")
    got = {x["channel"]: x["siblings"] for x in intervals.siblings(e, 5).collect()}
    assert got == {"a": ["b"], "b": ["a", "d"], "c": ["d"], "d": ["b", "c"]}


def test_nearest_point_prefers_the_earlier_of_two(spark):
    p = readings(spark, [(10, 1), (20, 2), (40, 3)])
    m = spark.createDataFrame([("c", 15), ("c", 31), ("c", 0), ("c", 99)], "channel string, at_ms bigint")
    assert sorted((x["at_ms"], x["event_ts_ms"]) for x in intervals.nearest(p, m).collect()) == [(0, 10), (15, 10), (31, 40), (99, 40)]


def verdict(spark, channels, scope, kind="deploy", detail="", severity="info", topology=None):
    e = spark.createDataFrame([(c, 0, 100, 10) for c in channels], "channel string, t_start_ms bigint, t_end_ms bigint, onset_ms bigint")
    c = spark.createDataFrame([("x", kind, 50, 60, severity, detail, scope, 0)], "event_id string, kind string, t_start_ms bigint, t_end_ms bigint, severity string, detail string, scope array<string>, ord bigint")
    t = src.topology(spark.createDataFrame([(x,) for x in (topology or channels)], "channel string"))
    d = policy.decide(e, policy.event_verdicts(e, c, t, 1000, 5))
    return {x["channel"]: (x["verdict"], x["status"]) for x in d.collect()}


FLEET = [f"n{i}.{m}" for i in range(6) for m in ("a", "b")]


def test_verdicts_of_deploys(spark):
    assert verdict(spark, ["n0.a", "n3.a"], ["n0.a", "n3.a"], topology=FLEET)["n0.a"] == ("corroborated", "attributed")
    assert verdict(spark, ["n0.a"], ["n0.a", "n3.a"], topology=FLEET)["n0.a"] == ("isolated", "real")
    assert verdict(spark, ["n0.a", "n0.b"], ["n0.a", "n0.b"], topology=FLEET)["n0.a"] == ("narrow_blast_radius", "real")
    assert verdict(spark, ["n0.a", "n0.b"], ["n0.a", "n0.b", "n3.a"], topology=FLEET)["n0.a"] == ("fault_domain", "real")
    assert verdict(spark, ["n0.a", "n1.a"], ["n0.a", "n1.a", "n3.a"], topology=FLEET)["n0.a"] == ("fault_domain", "real")
    assert verdict(spark, ["n0.a", "n3.a"], ["n5.a"], topology=FLEET)["n0.a"] == ("out_of_scope", "real")
    assert verdict(spark, ["n0.a", "n3.a"], [], topology=FLEET)["n0.a"] == ("corroborated", "attributed")


def test_verdicts_of_pipeline_events(spark):
    assert verdict(spark, ["n0.a"], [], "pipeline", "missing=2", topology=FLEET)["n0.a"] == ("pipeline_disturbed", "attributed")
    assert verdict(spark, ["n0.a"], [], "pipeline", "missing=0", "critical", topology=FLEET)["n0.a"] == ("implausible", "real")


def test_metrics(spark):
    def rows(pairs):
        return spark.createDataFrame([(i, float(s), y) for i, (s, y) in enumerate(pairs)], "pos bigint, score double, label int")

    perfect = rows([(0.9, 1), (0.8, 1), (0.2, 0), (0.1, 0)])
    assert evaluate.auc_pr(perfect).first()[0] == 1 and evaluate.roc_auc(perfect).first()[0] == 1
    assert evaluate.auc_pr(rows([(0.9, 0), (0.8, 0)])).first()[0] == 0
    b = evaluate.budget(rows([(float("nan"), 1), (0.5, 0), (0.5, 1)])).first()
    assert (b["budget"], b["hits"]) == (2, 1)
    r = evaluate.regions(rows([(0, 1), (0, 1), (0, 0), (0, 1)])).orderBy("region").collect()
    assert [(x["first_pos"], x["last_pos"]) for x in r] == [(0, 1), (3, 3)]


def test_bm25_ranks_and_breaks_ties_by_title(spark):
    p = spark.createDataFrame([("b", "pump noise"), ("a", "pump noise"), ("c", "other words here")], "title string, text string")
    q = spark.createDataFrame([(1, "Pump noise!")], "query_id int, query string")
    assert [x["title"] for x in retrieval.search(p, q).orderBy("rank").collect()] == ["a", "b"]


def test_rules(spark):
    shape = "channel string, t_start_ms bigint, t_end_ms bigint, window_count bigint, burst_windows bigint, status string"
    e = spark.createDataFrame([("u.safety", 0, 9, 1, 0, "real"), ("u.a", 0, 9, 1, 0, "real"), ("u.b", 0, 9, 4, 3, "real"), ("u.c", 0, 99_999, 1, 0, "attributed")], shape)
    d = rules.diagnose(e)
    assert {x["channel"]: x["symptom"] for x in d.collect()} == {"u.safety": "safety_channel", "u.a": "isolated_spike", "u.b": "variance_burst", "u.c": "level_shift"}
    p = rules.plan(d, ["describe_channel", "silence_channel", "raise_ticket", "request_recalibration"])
    got = {(x["channel"], x["action"]): (x["approved"], x["reason"]) for x in rules.gate(p).collect()}
    assert got[("u.b", "silence_channel")] == (True, "within_limits") and got[("u.b", "raise_ticket")] == (True, "within_limits")
    assert got[("u.c", "raise_ticket")] == (False, "episode_not_actionable") and got[("u.a", "describe_channel")] == (True, "read_only")
    assert ("u.a", "escalate_to_human") not in got
    assert [x["action"] for x in rules.plan(d.where("channel = 'u.a'"), []).collect()] == ["escalate_to_human"]


def test_budgets_count_what_was_approved(spark):
    rows = [("c", 0, i, a, "real", m) for i, (a, m) in enumerate([("annotate_episode", None), ("silence_channel", 90), ("raise_ticket", None), ("annotate_episode", None), ("escalate_to_human", None), ("describe_channel", None)])]
    a = spark.createDataFrame(rows, "channel string, t_start_ms bigint, step int, action string, status string, minutes int")
    assert [x["reason"] for x in rules.gate(a).orderBy("step").collect()] == ["within_limits", "limit_exceeded", "within_limits", "budget_exhausted", "escalation_always_allowed", "read_only"]


def test_decoding_marks_what_is_malformed(spark):
    wire = ['{"channel":"a","seq":"5","ts":5.0,"value":"2.5"}', '{"channel":"a","seq":1,"ts":2}', '{"channel":"a",']
    d = src.decode(spark.createDataFrame([(i, w) for i, w in enumerate(wire)], "i int, wire string")).orderBy("i").collect()
    assert [x["ok"] for x in d] == [True, False, False] and (d[0]["seq"], d[0]["event_ts_ms"], d[0]["value"]) == (5, 5, 2.5)


def test_nearest_rank(spark):
    d = spark.createDataFrame([([3.0, 1.0, 2.0],), ([],)], "v array<double>")
    assert [x[0] for x in d.select(nearest_rank(F.col("v"), 0.5)).collect()] == [2.0, None]
