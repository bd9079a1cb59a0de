"""Sources, sinks, the agent and streams on small inline tables."""

import json
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_operators import READING, readings
from tidelens.operators import agent, chunks, detect, episodes, evaluate, forecast, intervals, ledger, policy, rules, serving, store, windows
from tidelens.sources import codecs, context, documents, faults, feed, synthetic, topics
from tidelens.streaming import channel, sinks, storage


def test_scores_hold_at_a_large_offset(spark):
    r = random.Random(1)
    noise = [r.gauss(0, 0.01) for _ in range(600)]

    def scored(offset):
        w = windows.Sliding(30_000, 10_000, 8)
        rows = readings(spark, [(i * 1000, v + offset) for i, v in enumerate(noise)])
        return {x["start_ms"]: x for x in windows.summaries(rows, w).collect()}, {x["start_ms"]: x for x in detect.zscores(rows, w).collect()}

    plain, scores = scored(0.0)
    far, shifted = scored(2.0**30)
    assert plain.keys() == far.keys() and scores.keys() == shifted.keys() and len(scores) > 40
    for k, x in plain.items():
        own = [v for i, v in enumerate(noise) if k <= i * 1000 < k + 30_000]
        assert x["var"] == pytest.approx(statistics.variance(own), rel=1e-9) and far[k]["var"] == pytest.approx(x["var"], rel=1e-3)
    assert max(abs(shifted[k]["score"] - x["score"]) for k, x in scores.items()) < 0.01


@pytest.mark.parametrize("chunk", [1, 3, 1 << 20])
def test_running_windows_are_the_same_in_any_chunks(spark, chunk):
    r = random.Random(2)
    rows = [(r.choice("ab"), i, r.randint(-9, 9)) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, i bigint, v bigint").repartition(3)
    got = {x["i"]: x for x in chunks.running(df, "i", {"top": ("max", F.col("v")), "low": ("min", F.col("v")), "all": ("sum", F.col("v"))}, ("k",), chunk).collect()}
    last = {x["i"]: x["p"] for x in chunks.previous(df, "i", "v", "p", ("k",), chunk).collect()}
    for k, i, _ in rows:
        before = [v for k2, j, v in rows if k2 == k and j < i]
        assert (got[i]["top"], got[i]["low"], got[i]["all"], last[i]) == (max(before, default=None), min(before, default=None), sum(before), before[-1] if before else None)


def brute_gaps(times, factor=6, held=32, least=8, floor=1000):
    kept, out = [], []
    for a, b in zip(times, times[1:], strict=False):
        m = statistics.median(kept[-held:]) if kept else 0
        if len(kept[-held:]) >= least and b - a > max(factor * m, floor):
            out.append((a, b, float(m), max(0, round((b - a) / m) - 1) if m else 0))
        else:
            kept.append(b - a)
    return out


def test_gap_watch_equals_a_fold_by_brute_force(spark):
    r = random.Random(3)
    rows, want = [], {}
    for c in "abcd":
        t, times = 0, []
        for _ in range(400):
            t += r.choice([0, 10, 100, 200, 200, 200, 300]) if r.random() < 0.97 else r.randint(1000, 9000)
            times.append(t)
        want[c] = brute_gaps(times)
        rows += [(c, t) for t in times]
    r.shuffle(rows)
    got = ledger.gaps(spark.createDataFrame(rows, "channel string, event_ts_ms bigint")).collect()
    for c, w in want.items():
        assert sorted(tuple(x)[1:] for x in got if x["channel"] == c) == w and len(w) > 3


def test_feed_messages_become_readings(spark):
    site = {"Site_ID": "SITE_001", "ts": "2026-09-06T04:31:55.125720+00:00", "Expected_Power_MW": 22.29, "AC_Power_MW": 21, "Performance_Ratio": "0.9", "Availability_%": True, "Soiling_Index": None}
    inverter = {"Inverter_ID": "I", "ts": "2026-09-06T06:31:55+02:00", "Output_AC_Power_kW": 30.0, "Rated_AC_kW": 40.0, "PR_Local": 0.5}
    rows = [("sites", json.dumps(site), 1), ("inverters", json.dumps(inverter), 2), ("inverters", json.dumps(inverter | {"Rated_AC_kW": 60}), 3), ("tides", json.dumps(site), 4), ("sites", "{", 5), ("sites", json.dumps(site | {"ts": "soon"}), 6), ("sites", json.dumps(site | {"Site_ID": 7}), 7), (None, None, 8)]
    got = {(x["channel"], x["seq"]): x for x in feed.map_payloads(spark.createDataFrame(rows, "topic string, payload string, arrival bigint")).collect()}
    assert {k for k, _ in got} == {"SITE_001.power_shortfall_mw", "SITE_001.ac_power_mw", "SITE_001.expected_power_mw", "I.pr_local", "I.output_ac_power_kw", "I.capacity_factor"}
    assert got["SITE_001.power_shortfall_mw", 1]["value"] == pytest.approx(1.29) and got["SITE_001.ac_power_mw", 1]["event_ts_ms"] == 1788669115125
    assert got["I.capacity_factor", 1]["value"] == 0.5 and got["I.pr_local", 2]["arrival"] == 3 and feed.primary("strings") == "deviation_pct"


def test_codecs_mark_what_they_cannot_use(spark):
    lines = ['{"event_id":"a","kind":"deploy","t_start_ms":"5","t_end_ms":7.9,"severity":"info","detail":""}', '{"event_id":"b","kind":"deploy","t_start_ms":5,"t_end_ms":7,"severity":"loud","detail":""}', "nonsense", None]
    got = codecs.decode_context(spark.createDataFrame([(x,) for x in lines], "wire string")).collect()
    assert [x["ok"] for x in got] == [True, False, False, False] and (got[0]["t_start_ms"], got[0]["t_end_ms"], got[0]["scope"]) == (5, 7, [])
    score = codecs.decode_scores(spark.createDataFrame([('{"detector":"z","channel":"c","window_start_ms":1,"window_end_ms":2,"score":"3.5"}',), ('{"detector":"z"}',)], "wire string")).collect()
    assert [(x["ok"], x["score"], x["latency_ms"]) for x in score] == [(True, 3.5, 0.0), (False, None, 0.0)]


def test_sources_of_context(spark):
    e = spark.createDataFrame([("a", 0, 10), ("b", 0, 5_000), ("c", 0, 4_000_000)], "event_id string, t_start_ms bigint, t_end_ms bigint")
    t = context.tail(e)
    assert sorted(x["event_id"] for x in t.events.collect()) == ["c"] and sorted(x[0] for x in context.tail(e, 3_995_000).events.select("event_id").collect()) == ["b", "c"]
    both = context.joint(t, context.Context(e, available=False))
    assert both.events.count() == 4 and not both.available and context.tail(e.limit(0)).events.count() == 0


def test_series_and_runbooks(spark, tmp_path):
    (tmp_path / "s.csv").write_text("a,b,flat,Label\n" + "\n".join(f"{i % 2},{i},7,{int(i > 5)}" for i in range(10)) + "\n")
    s = documents.load_series(spark, f"file://{tmp_path}/s.csv", max_points=8, max_features=1).orderBy("t").collect()
    assert [(x["t"], x["feature"], x["value"], x["label"]) for x in s] == [(i, "b", float(i), int(i > 5)) for i in range(8)]
    assert {x["feature"] for x in documents.load_series(spark, f"file://{tmp_path}/s.csv").collect()} == {"a", "b"}
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        documents.load_series(spark, f"file://{tmp_path}/bad.csv")
    (tmp_path / "books").mkdir()
    (tmp_path / "books" / "pumps.md").write_text("# Pumps\n\nintro\n\n## One \n\nbody\nLicensed-Actions: b, a,, b\n## Empty\n\n\n### sub\n## Two\r\nlast")
    got = documents.load_runbooks(spark, f"file://{tmp_path}/books").orderBy("ord").collect()
    assert [(x["runbook"], x["title"], x["licences"]) for x in got] == [("pumps", "One", ["a", "b"]), ("pumps", "Empty", []), ("pumps", "Two", [])] and got[2]["text"] == "last"


def test_a_scenario_is_the_same_for_its_seed(spark):
    t = [(f"pump-{n:02d}.{m}", f"pump-{n:02d}", f"rack-{n // 2:02d}", n % 2) for n in range(4) for m in "ab"]
    one, two = (synthetic.scenario(spark, t, 3600.0, seed=5) for _ in range(2))
    assert all(a.collect() == b.collect() for a, b in zip(one, two, strict=True))
    d, a, f = one
    assert d.where("t_start_ms > t_end_ms").isEmpty() and a.join(d.where("not perturbed"), F.col("incident") == F.col("event_id")).isEmpty() and f.select("incident").distinct().count() == 40


def test_topics_keep_offsets_and_order(spark, tmp_path):
    path, rows = f"file://{tmp_path}/topic", spark.createDataFrame([(f"k{i % 3}", i) for i in range(30)], "k string, i bigint")
    first = topics.publish(rows.where("i < 20"), path, "k", "i", 2)
    topics.publish(rows.where("i >= 20"), path, "k", "i", 2)
    got = topics.subscribe(spark, path).collect()
    for k in ("k0", "k1", "k2"):
        own = sorted((x["offset"], json.loads(x["value"])["i"]) for x in got if x["key"] == k)
        assert [i for _, i in own] == sorted(i for _, i in own) and len({x["partition"] for x in got if x["key"] == k}) == 1
    ends = {x["partition"]: x["high"] for x in first.collect()}
    assert topics.subscribe(spark, path, ends).count() == 10
    assert topics.kafka_options("s", "t", committed_only=True)["kafka.isolation.level"] == "read_committed" and topics.producer_options("s", "t")["kafka.enable.idempotence"] == "true"


def test_batches_and_positions_commit_together(spark, tmp_path):
    path, r = f"file://{tmp_path}/lake", spark.createDataFrame([(s, i) for i in range(10) for s in "ab"], "source string, arrival bigint")
    store.append(r.where("arrival < 4"), path, 0)
    r.where("arrival < 9").write.parquet(f"{path}/data/batch=1")  # a batch that broke off before its manifest
    assert store.scan(spark, path).count() == 8 and store.committed_offsets(spark, path).collect()[0]["next"] == 4
    for _ in range(2):
        store.append(store.resume(r, store.committed_offsets(spark, path)).where("arrival < 7"), path, 1)
    store.append(r.where("false"), path, 2)
    assert store.scan(spark, path).count() == 14 and store.snapshots(spark, path) == 2


def test_upserts(spark):
    row = "event_id string, v int"
    old, new = spark.createDataFrame([("a", 1), ("b", 1)], row), spark.createDataFrame([("b", 2), ("c", 2), ("c", 2)], row)
    assert sorted(map(tuple, store.insert_context(old, new).collect())) == [("a", 1), ("b", 1), ("c", 2)]
    h = "window_start_ms bigint, readings bigint, max_lag_ms bigint"
    up = store.upsert_health(spark.createDataFrame([(0, 5, 90)], h), spark.createDataFrame([(0, 6, 10), (1, 1, 1)], h))
    assert sorted(map(tuple, up.collect())) == [(0, 6, 90), (1, 1, 1)]
    assert faults.replay(spark.createDataFrame([(1,), (2,), (3,)], "arrival bigint"), 2).orderBy("arrival").collect()[-1][0] == 5


def test_replies_are_checked(spark):
    bodies = ['[{"kind":"describe_channel","parameters":{"channel":1}}]', "```\n[]\n```", '{"a":1}', "x", '[{"kind":"dance","parameters":{}},3,{"kind":"raise_ticket","parameters":[]},{"kind":"escalate_to_human","parameters":{"reason":null}}]', None, ""]
    got = agent.parse_plans(spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, reply string")).orderBy("i").collect()
    assert [x["schema_valid"] for x in got] == [True, True, False, False, False, False, False]
    assert (got[4]["unknown"], got[4]["malformed"], got[4]["missing"], got[4]["kinds"]) == (["dance"], 2, ["escalate_to_human.episode_id"], ["escalate_to_human"]) and got[1]["fenced"]


def test_effects_and_traces_of_a_sandbox(spark):
    rows = [("c", 0, i, a, ok, "r") for i, (a, ok) in enumerate([("describe_channel", True), ("raise_ticket", True), ("raise_ticket", False), ("raise_ticket", True), ("escalate_to_human", True)])]
    got = agent.execute(spark.createDataFrame(rows, "channel string, t_start_ms bigint, step int, action string, approved boolean, reason string"), F.col("channel")).orderBy("step").collect()
    assert [x["effect"] for x in got] == [None, "raised TICKET-0001 at severity medium", None, "raised TICKET-0002 at severity medium", "escalated episode c to a human"]
    assert "execution" not in json.loads(got[2]["trace"]) and json.loads(got[1]["trace"])["execution"] == {"ok": True, "effects": ["raised TICKET-0001 at severity medium"]}


def test_teacher_and_floors(spark):
    c = spark.createDataFrame([("slow_drift", ["raise_ticket", "describe_channel"]), ("oscillation", ["silence_channel"])], "symptom string, licences array<string>")
    assert sorted(x["wanted"] for x in agent.teacher_actions(c).collect()) == [["describe_channel", "raise_ticket"], ["escalate_to_human"]]
    steps = spark.createDataFrame([("c.safety", 0, "silence_channel", True, True, ["silence_channel"], "x")], "channel string, t_start_ms bigint, action string, approved boolean, executed boolean, licences array<string>, rationale string")
    q = agent.quality(steps, spark.createDataFrame([("c.safety", 0), ("d", 0)], "channel string, t_start_ms bigint"))
    assert sorted(x["name"] for x in agent.floors(q).collect()) == ["runs_with_no_proposal", "safety_channel_compliance_rate"]


def test_forecast_needs_context_and_sees_a_step(spark):
    rows = [(i * 1000, float(i % 5) + (50 if 100 <= i < 110 else 0)) for i in range(140)]
    got = {x["start_ms"]: x for x in forecast.residual_scores(readings(spark, rows), windows.Sliding(10_000, 10_000, 1), 1000).collect()}
    assert min(got) == 50_000 and got[100_000]["score"] > 10 > got[90_000]["score"] and got[100_000]["horizon"] == 10


def test_first_largest_score_names_the_detector(spark):
    s = spark.createDataFrame([("c", 0, 10, 5.0, "a"), ("c", 10, 20, 9.0, "b"), ("c", 20, 30, 9.0, "z"), ("c", 99, 109, 4.0, "a")], "channel string, start_ms bigint, end_ms bigint, score double, detector string")
    assert [(x["raised_by"], x["window_count"]) for x in episodes.merge(s, 4.0, 50).orderBy("t_start_ms").collect()] == [("b", 3), ("a", 1)]


def test_nearest_points_over_empty_buckets(spark):
    p = readings(spark, [(0, 1), (0, 2), (500, 3), (10_000, 4)])
    marks = spark.createDataFrame([("c", t) for t in (-5, 250, 251, 5_000, 5_250, 5_251, 99_999)] + [("d", 1)], "channel string, at_ms bigint")
    got = {x["at_ms"]: (x["event_ts_ms"], x["value"]) for x in intervals.nearest(p, marks, bucket_ms=1000).collect()}
    assert got == {-5: (0, 1.0), 250: (0, 1.0), 251: (500, 3.0), 5_000: (500, 3.0), 5_250: (500, 3.0), 5_251: (10_000, 4.0), 99_999: (10_000, 4.0)}


def test_late_readings_count_but_have_no_window(spark):
    rows = [("c", 1, 1, 0, 1.0, "a", 0), ("c", 2, 2, 10, 1.0, "b", 10), ("c", 3, 3, 100, 1.0, "a", 100), ("c", 4, 4, 95, 1.0, "b", 95), ("c", 5, 5, 20, 1.0, "b", 20), ("c", 6, 6, 79, 1.0, "b", 99)]
    df = spark.createDataFrame(rows, f"{READING}, source string, ingest_wall_ms bigint")
    s = ledger.sealed(ledger.label(df), 10)
    assert [x["seq"] for x in s.where("is_late").collect()] == [5, 6] and ledger.by_channel(s).first()["readings"] == 6
    assert ledger.health(s, 10).agg(F.sum("readings")).first()[0] == 4


def test_idle_and_silent_sources(spark):
    s = spark.createDataFrame([("a", 50, 100.0), ("b", 20, 60.0), ("c", None, 99.0)], "source string, high_ms bigint, seen_s double")
    assert ledger.source_watermark(s, 30).first()["watermark_ms"] is None and ledger.source_watermark(s.where("source != 'c'"), 30).first()["watermark_ms"] == 50
    assert ledger.source_watermark(s.where("source != 'c'"), 100).first()["watermark_ms"] == 20


def test_paired_scores_keep_their_two_views(spark):
    e = spark.createDataFrame([("a", 0, 100, "real"), ("b", 0, 100, "attributed"), ("c", 0, 100, "real")], "channel string, t_start_ms bigint, t_end_ms bigint, status string").withColumn("verdict", F.lit(None).cast("string"))
    fault = spark.createDataFrame([("a", 50, 60, "i", "node"), ("b", 50, 60, "i", "node"), ("b", 900_000, 900_001, "j", "channel")], "channel string, t_start_ms bigint, t_end_ms bigint, incident string, domain string")
    artifact = fault.where("channel = 'a'").select("channel", "t_start_ms", "t_end_ms")
    w = spark.createDataFrame([("w1", 55, 70, ["b"], False, 0), ("w2", 0, 99, [], True, 1)], "event_id string, t_start_ms bigint, t_end_ms bigint, scope array<string>, perturbed boolean, ord bigint")
    s = evaluate.score_pass(e, fault, artifact, w, 0).first()
    assert (s["paged"], s["artifact_pages"], s["unexplained_pages"], s["faults_total"], s["faults_detected"], s["inside_total"], s["quiet_total"], s["recall_channels"]) == (2, 1, 1, 2, 1, 1, 0, 1 / 3)
    assert {x["verdict"]: (x["fault"], x["unexplained"]) for x in evaluate.breakdown(e, fault, artifact, 0).collect()} == {"unconditioned": (2, 1)}


def test_release_is_in_order_of_onset(spark):
    e = spark.createDataFrame([("a", 5, 50), ("b", 1, 10), ("c", 9, None)], "channel string, t_start_ms bigint, onset_ms bigint")
    assert [(x["channel"], x["released"]) for x in policy.release(e, 40, 30).collect()] == [("c", True), ("b", True), ("a", False)]


def test_a_channels_state_gives_what_a_batch_gives(spark):
    r = np.random.default_rng(4)
    ts = np.cumsum(r.integers(200, 1500, 900))
    value = r.normal(0, 1, 900) + np.where((ts > 400_000) & (ts < 440_000), 6, 0)
    w, c, got = windows.Sliding(30_000, 10_000, 8), channel.Channel(), []
    for i in range(0, 900, 70):
        c = channel.Channel.load(c.dump())
        c.add(ts[i : i + 70], np.arange(i, min(900, i + 70)), value[i : i + 70], w, 0)
        due = c.close(w, 0)
        got += [e for x in due for e in c.flag(x[0], x[0] + w.size, c.score(x), 4.0, 20_000)] + c.idle(w, 20_000)
    c.add(np.array([channel.END_MS]), np.array([900]), np.array([0.0]), w, 0)
    got += [e for x in c.close(w, 0) for e in c.flag(x[0], x[0] + w.size, c.score(x), 4.0, 20_000)] + c.idle(w, 20_000)
    batch = episodes.merge(detect.zscores(readings(spark, list(zip(ts.tolist(), value.tolist(), strict=True))), w), 4.0, 20_000).orderBy("t_start_ms").collect()
    assert [(e[0], e[1], e[2]) for e in got] == [(x["t_start_ms"], x["t_end_ms"], x["window_count"]) for x in batch] and len(batch) > 0
    assert [e[3] for e in got] == pytest.approx([x["peak_score"] for x in batch])


def test_sinks_can_run_a_batch_again(spark, tmp_path):
    rows = "channel string, arrival bigint, event_ts_ms bigint, source string, ingest_wall_ms bigint, missing bigint, duplicate bigint, regression bigint"
    sink = sinks.HealthWindows(spark, f"file://{tmp_path}/h", 10, sources=["a", "b"])
    one = spark.createDataFrame([("c", 1, 5, "a", 6, 0, 0, 0), ("c", 2, 100, "a", 100, 1, 0, 0)], rows)
    two = spark.createDataFrame([("d", 3, 99, "b", 99, 0, 0, 0), ("d", 4, 101, "b", 101, 0, 0, 0)], rows)
    three = spark.createDataFrame([("d", 5, 6, "b", 6, 0, 0, 1), ("d", 6, 100, "a", 130, 0, 0, 0)], rows)
    for n, b in ((0, one), (1, two), (1, two), (2, three), (2, three)):
        sink(b, n)
    got = {x["window_start_ms"]: (x["readings"], x["channels"], x["max_lag_ms"]) for x in sink.finish().collect()}
    assert got == {0: (1, 1, 1), 90: (1, 1, 0), 100: (3, 2, 30)} and sink.note(3)["late"] == 1


def test_a_sink_without_batches_is_empty(spark, tmp_path):
    (tmp_path / "in").mkdir()
    s = spark.readStream.schema("k string, v bigint").parquet(f"file://{tmp_path}/in")
    storage.declare(s, f"file://{tmp_path}/out")
    (tmp_path / "out").mkdir()
    assert storage.committed(spark, f"file://{tmp_path}/out").columns == ["k", "v", "batch"]


def test_serving_on_empty_and_plain_tables(spark):
    e = spark.createDataFrame([], "channel string, t_start_ms bigint, t_end_ms bigint, peak_score double, window_count bigint, raised_by string")
    assert serving.detectors(e, spark.createDataFrame([], "raised_by string, latency_ms double")).count() == 0 and serving.episode_list(e).count() == 0
    c = spark.createDataFrame([("c", 0, 5.0), ("c", 10, 7.0), ("c", 20, 2.0)], "channel string, event_ts_ms bigint, value double")
    assert {x["at_ms"]: x["increase"] for x in serving.increases(c, 20, 10).collect()} == {10: 0.0, 20: 2.0, 30: 4.0, 40: 2.0}
    assert [x["scaled"] for x in serving.scaled(c).orderBy("event_ts_ms").collect()] == pytest.approx([0.6, 1.0, 0.0])


def test_rules_take_licences_from_a_column(spark):
    d = spark.createDataFrame([("a", 0, "level_shift", "real", ["raise_ticket"]), ("b", 0, "level_shift", "real", [])], "channel string, t_start_ms bigint, symptom string, status string, licences array<string>")
    assert sorted((x["channel"], x["action"]) for x in rules.plan(d, "licences").collect()) == [("a", "raise_ticket"), ("b", "escalate_to_human")]


def test_a_stream_recovers_with_its_state_in_rocksdb(spark, tmp_path):
    from tidelens.streaming import processors, queries

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    storage.durable(spark)
    try:
        out, check, path = (f"file://{tmp_path}/{x}" for x in ("out", "check", "in"))
        for part in ([(1, 0), (2, 1)], [(4, 2), (4, 3), (3, 4)]):
            spark.createDataFrame([("c", s, a, 0, 0.0) for s, a in part], READING).coalesce(1).write.mode("append").parquet(path)
            queries.drain(processors.track_sequences(spark.readStream.schema(READING).parquet(path)), "update", out, check)
        x = storage.latest(spark, out, "channel").first()
        assert (x["readings"], x["missing"], x["duplicates"], x["regressions"]) == (5, 1, 1, 1)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_a_query_runs_by_name(spark, tmp_path, capsys):
    from tidelens.__main__ import main

    assert main(["topology_summary", "/root/testdata/sf0.001", "--out", f"file://{tmp_path}/out"]) == 0 and spark.read.parquet(f"file://{tmp_path}/out").count() > 0
    assert main(["lake_identities", "/root/testdata/sf0.001"]) == 0 and "click" in capsys.readouterr().out
