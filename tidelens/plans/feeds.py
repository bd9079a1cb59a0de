"""Queries on sources and sinks, with their SQL beside them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelens.operators import evaluate, ledger, policy, rollup, store
from tidelens.plans import oracle
from tidelens.plans import queries as base
from tidelens.sources import codecs, context, documents, faults, feed, synthetic, topics
from tidelens.sources import readings as src
from tidelens.streaming.storage import folder, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
M1, M3, FIRST, DAY, H = oracle.M1, oracle.M3, oracle.FIRST, oracle.DAY, oracle.H


def query(sql: str = ""):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _fields(topic: str) -> list[str]:
    """The payload fields of a topic, in order of first use."""
    found: dict[str, None] = {}
    for spec in feed.TOPICS[topic][1].values():
        found.update(dict.fromkeys([spec] if isinstance(spec, str) else spec[1:]))
    return list(found)


def _payload() -> str:
    """SQL of an event's message, the same in both engines: numbers, and here and there none, a truth value, text, or no usable time or entity."""
    def one(i: int, name: str) -> str:
        return f"""CASE WHEN (event_id + {i}) % 11 = 0 THEN '' WHEN (event_id + {i}) % 13 = 0 THEN ',"{name}":true' WHEN (event_id + {i}) % 17 = 0 THEN ',"{name}":"7"'
          ELSE concat(',"{name}":', cast((event_id * {i + 3}) % 97 AS STRING), '.5') END"""

    def message(n: int, topic: str) -> str:
        entity = f"""CASE WHEN event_id % 31 = 0 THEN '{{"{feed.TOPICS[topic][0]}":7' ELSE concat('{{"{feed.TOPICS[topic][0]}":"E', cast(user_id % 5 AS STRING), '"') END"""
        stamp = """CASE WHEN event_id % 29 = 0 THEN ',"ts":"yesterday"' ELSE concat(',"ts":"2024-01-0', cast(1 + event_id % 9 AS STRING), 'T04:31:', lpad(cast(event_id % 60 AS STRING), 2, '0'), '.125720+02:00"') END"""
        return f"WHEN {n} THEN concat({entity}, {stamp}, {', '.join(one(i, f) for i, f in enumerate(_fields(topic)))}, '}}')"

    return f"CASE event_id % 6 {' '.join(message(n, t) for n, t in enumerate(feed.TOPICS))} ELSE '{{\"odd\":1}}' END"


def _feed_sql() -> str:
    def value(topic: str, name: str) -> str:
        i = _fields(topic).index(name)
        return f"CASE WHEN (event_id + {i}) % 11 = 0 OR (event_id + {i}) % 13 = 0 OR (event_id + {i}) % 17 = 0 THEN NULL ELSE (event_id * {i + 3}) % 97 + 0.5::DOUBLE END"

    def metric(topic: str, spec) -> str:
        if isinstance(spec, str):
            return value(topic, spec)
        how, a, b = spec
        return f"({value(topic, a)}) - ({value(topic, b)})" if how == "-" else f"CASE WHEN ({value(topic, b)}) >= 50 THEN ({value(topic, a)}) / ({value(topic, b)}) END"

    rows = " UNION ALL ".join(
        f"SELECT event_id, 'E' || CAST(user_id % 5 AS VARCHAR) || '.{m}' AS channel, {metric(t, s)} AS value FROM events WHERE event_id % 6 = {n} AND event_id % 31 <> 0 AND event_id % 29 <> 0" for n, (t, (_, specs)) in enumerate(feed.TOPICS.items()) for m, s in specs.items()
    )
    stamp = f"{FIRST} + (event_id % 9) * {DAY} + 2 * {H} + 31 * 60000 + (event_id % 60) * 1000 + 125"
    return f"WITH r AS ({rows}) SELECT channel, count(*) AS readings, max({stamp}) AS last_ms, round(sum(value) + 1e-9, 6) AS total, CAST(sum(event_id) AS BIGINT) AS arrivals FROM r WHERE value IS NOT NULL GROUP BY channel"


@query(_feed_sql())
def feed_readings(spark, sf):
    names = " ".join(f"WHEN {n} THEN '{t}'" for n, t in enumerate(feed.TOPICS))
    m = src.events(spark, sf).select(F.expr(f"CASE event_id % 6 {names} ELSE 'tides' END").alias("topic"), F.expr(_payload()).alias("payload"), F.col("event_id").alias("arrival"))
    by = feed.map_payloads(m).groupBy("channel").agg(F.count("*").alias("readings"), F.max("event_ts_ms").alias("last_ms"), F.round(F.sum("value") + 1e-9, 6).alias("total"), F.sum("arrival").alias("arrivals"), F.max("seq").alias("seq"))
    return by.where("seq = readings").drop("seq")


@query(f"""WITH {oracle.DEPLOYS}, n AS (SELECT d, count(*) AS k FROM scope GROUP BY d)
  SELECT CASE WHEN d % 6 <> 1 THEN event_id END AS event_id, CASE WHEN d % 6 = 1 THEN NULL WHEN d % 6 = 2 THEN 'party' ELSE 'deploy' END AS kind, CASE WHEN d % 6 <> 1 THEN c0 END AS t_start_ms, CASE WHEN d % 6 <> 1 THEN coalesce(k, 0) ELSE 0 END AS scope_size, CASE WHEN d % 6 <> 1 THEN d % 2 = 0 END AS perturbed_telemetry, d % 6 NOT IN (1, 2) AS ok
  FROM dep LEFT JOIN n USING (d)""")
def context_codec(spark, sf):
    e = src.deploys(spark).withColumn("perturbed_telemetry", F.col("ord") % 2 == 0)
    e = e.withColumn("kind", F.when(F.col("ord") % 6 == 2, "party").otherwise(F.col("kind")))
    broken = codecs.encode_context(e.where("ord % 6 = 1")).select(F.expr("substring(wire, 1, 30)").alias("wire"))
    d = codecs.decode_context(codecs.encode_context(e.where("ord % 6 != 1")).unionByName(broken))
    return d.select("event_id", "kind", "t_start_ms", F.size("scope").cast("bigint").alias("scope_size"), "perturbed_telemetry", "ok")


@query(f"WITH {oracle.S1} SELECT n % 7 <> 0 AS ok, count(*) AS scores, CAST(sum(n) AS BIGINT) AS points, round(sum(CASE WHEN n % 7 <> 0 THEN score END) + 1e-9, 5) AS total FROM s GROUP BY 1")
def score_codec(spark, sf):
    wire = codecs.encode_scores(base.scored(spark, sf), "zscore")
    wire = wire.withColumn("wire", F.when(F.expr("get_json_object(wire, '$.points') % 7 = 0"), F.regexp_replace("wire", '"score":[^,]*,', '"score":"high",')).otherwise(F.col("wire")))
    d = codecs.decode_scores(wire)
    return d.groupBy("ok").agg(F.count("*").alias("scores"), F.sum("detail.points").alias("points"), F.round(F.sum("score") + 1e-9, 5).alias("total"))


_TAIL = f"WITH {oracle.HEALTH}, {oracle._PIPELINE}, {oracle.DEPLOYS}, c AS (SELECT event_id, kind, t_end_ms FROM pe UNION ALL SELECT event_id, 'deploy', c1 FROM dep)"


@query(f"{_TAIL} SELECT event_id, kind, t_end_ms FROM c WHERE t_end_ms >= (SELECT max(t_end_ms) FROM c) - {3 * DAY}")
def context_tail(spark, sf):
    return context.tail(base.context(spark, sf), 3 * src.DAY).events.select("event_id", "kind", "t_end_ms")


@query(f"""WITH {oracle.DECIDED} SELECT true AS available, verdict, count(*) AS episodes FROM dec GROUP BY verdict UNION ALL SELECT false, 'fail_open', count(*) FROM e HAVING count(*) > 0""")
def joint_context(spark, sf):
    e = base.episodes_once(spark, sf)
    pipeline = ledger.context_events(base.daily_health(spark, sf)).withColumn("ord", F.lit(1000).cast("bigint"))
    out = []
    for up in (True, False):
        both = context.joint(context.Context(src.deploys(spark)), context.Context(pipeline, up))
        t = src.topology(src.readings(spark, sf, True, False).select("channel").distinct())
        d = policy.decide(e, policy.event_verdicts(e, both.events, t, src.DAY, base.SYNC), both.available)
        out.append(d.groupBy("verdict").agg(F.count("*").alias("episodes")).withColumn("available", F.lit(both.available)))
    return out[0].unionByName(out[1])


_SERIES = """WITH l AS (SELECT l_quantity::DOUBLE AS quantity, round(l_extendedprice::DOUBLE, 2) AS price, l_discount::DOUBLE AS discount, l_tax::DOUBLE AS tax, 0::DOUBLE AS zero, CASE WHEN l_tax > 0.04 THEN 1 ELSE 0 END AS label FROM lineitem),
  u AS (SELECT * FROM (SELECT quantity, price, discount, tax, zero, label FROM l) UNPIVOT (value FOR feature IN (quantity, price, discount, tax, zero))),
  k AS (SELECT feature FROM u GROUP BY feature HAVING min(value) < max(value) ORDER BY stddev_pop(value) DESC LIMIT 2)"""


@query(f"{_SERIES} SELECT feature, CASE feature WHEN 'quantity' THEN 0 WHEN 'price' THEN 1 WHEN 'discount' THEN 2 ELSE 3 END AS ord, count(*) AS points, count(*) - 1 AS last_t, round(sum(value), 2) AS total, CAST(sum(label) AS BIGINT) AS labelled FROM u WHERE feature IN (SELECT feature FROM k) GROUP BY feature")
def series_features(spark, sf):
    path = folder(spark, "series")
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("l_quantity AS quantity", "round(l_extendedprice, 2) AS price", "l_discount AS discount", "l_tax AS tax", "0 AS zero", "CASE WHEN l_tax > 0.04 THEN 1 ELSE 0 END AS Label")
    rows.write.option("header", True).csv(path)
    s = documents.load_series(spark, path, max_features=2)
    return s.groupBy("feature", "ord").agg(F.count("*").alias("points"), F.max("t").alias("last_t"), F.round(F.sum("value"), 2).alias("total"), F.sum("label").alias("labelled"))


@query(f"WITH {oracle.EXAMPLES} SELECT split, symptom, count(*) AS n, CAST(sum(len(prompt)) AS BIGINT) AS chars FROM ex GROUP BY ALL")
def jsonl_examples(spark, sf):
    path = folder(spark, "examples")
    e = base.examples(spark, sf).select(F.to_json(F.struct("ord", "prompt", "symptom", "split"), {"ignoreNullFields": "true"}).alias("value"))
    e.unionByName(spark.createDataFrame([("",), ("  ",)], "value string")).write.text(path)
    r = documents.read_jsonl(spark, path, "ord BIGINT, prompt STRING, symptom STRING, split STRING")
    return r.groupBy("split", "symptom").agg(F.count("*").alias("n"), F.sum(F.length("prompt")).alias("chars"))


def plan_text(spark: SparkSession) -> DataFrame:
    """The fixed faults, deploys and artifacts as one plan; every third fault lacks its incident and domain."""
    one = F.struct(F.lit("level_shift").alias("kind"), F.lit("fault").alias("origin"), "t_start_ms", "t_end_ms", F.when(F.col("n") % 3 != 0, F.col("incident")).alias("incident"), F.when(F.col("n") % 3 != 0, F.col("domain")).alias("domain"))
    f = src.truth(spark).withColumn("n", F.expr("cast(substring(incident, 7) AS int)")).groupBy("channel").agg(F.array_sort(F.collect_list(one)).alias("es"))
    f = f.agg(F.map_from_entries(F.collect_list(F.struct("channel", "es"))).alias("faults"))
    a = src.artifacts(spark).groupBy("event_id", "channel").agg(F.array_sort(F.collect_list(F.struct(F.lit("spike").alias("kind"), F.lit("deploy").alias("origin"), "t_start_ms", "t_end_ms"))).alias("es"))
    a = a.groupBy("event_id").agg(F.map_from_entries(F.collect_list(F.struct("channel", "es"))).alias("artifacts"))
    d = src.deploys(spark).join(a, "event_id", "left")
    event = F.struct("event_id", "t_start_ms", "t_end_ms", F.when(F.size("scope") > 0, F.col("scope")).alias("scope"), F.when(F.col("artifacts").isNotNull(), F.lit(True)).alias("perturbed_telemetry"))
    d = d.agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.to_json(F.struct(event.alias("event"), "artifacts")).alias("j")))), lambda x: x["j"]).alias("ds"))
    body = F.concat(F.lit('{"seed":1,"faults":'), F.to_json("faults"), F.lit(',"deploys":['), F.array_join("ds", ","), F.lit("]}"))
    return f.join(d).select(body.alias("plan"))


@query(f"""WITH {oracle.DEPLOYS}, {oracle.TRUTH} SELECT 'fault' AS part, channel, f0 AS t_start_ms, CASE WHEN CAST(substr(incident, 7) AS INTEGER) % 3 <> 0 THEN incident ELSE channel || '@' || f0 END AS incident, CASE WHEN CAST(substr(incident, 7) AS INTEGER) % 3 <> 0 THEN 'node' ELSE 'channel' END AS domain FROM fault
  UNION ALL SELECT 'artifact', channel, c0, event_id, 'ring' FROM dep JOIN scope USING (d, event_id) WHERE d % 2 = 0
  UNION ALL SELECT CASE WHEN d % 2 = 0 AND d % 5 <> 0 THEN 'loud window' ELSE 'quiet window' END, NULL, c0, event_id, CAST(d AS VARCHAR) FROM dep""")
def plan_truth(spark, sf):
    f, a, w = documents.read_plan(written(plan_text(spark), "plan"))
    rows = [f.select(F.lit("fault").alias("part"), "channel", "t_start_ms", "incident", "domain"), a.select(F.lit("artifact").alias("part"), "channel", "t_start_ms", "incident", "domain")]
    rows.append(w.select(F.when(F.col("perturbed"), "loud window").otherwise("quiet window").alias("part"), F.lit(None).cast("string").alias("channel"), "t_start_ms", F.col("event_id").alias("incident"), F.col("ord").cast("string").alias("domain")))
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(f"""WITH {oracle.DEPLOYS}, {oracle.TRUTH}, u AS (SELECT channel, f0, f1, 'fault' AS origin FROM fault UNION ALL SELECT channel, f0, f1, 'deploy' FROM artifact)
  SELECT channel, f0 AS t_start_ms, origin, row_number() OVER (PARTITION BY channel ORDER BY f0, origin) - 1 AS ord FROM u""")
def truth_union(spark, sf):
    both = src.truth(spark).select("channel", "t_start_ms", F.lit("fault").alias("origin")).unionByName(src.artifacts(spark).select("channel", "t_start_ms", F.lit("deploy").alias("origin")))
    from pyspark.sql import Window

    return both.withColumn("ord", (F.row_number().over(Window.partitionBy("channel").orderBy("t_start_ms", "origin")) - 1).cast("bigint"))


@query(f"WITH {oracle.M2}, {oracle.TOPOLOGY} SELECT channel, node, rack, ring FROM topo")
def topology_inventory(spark, sf):
    t = src.topology(src.readings(spark, sf, True, False).select("channel").distinct())
    j = t.agg(F.to_json(F.struct(F.collect_list(F.struct("channel", "node", "rack", "ring")).alias("placements"))).alias("inventory"))
    return documents.read_inventory(j)


@query("""WITH n AS (SELECT n_name AS title, 'licensed-actions: ' || CASE n_regionkey WHEN 0 THEN 'raise_ticket, describe_channel' WHEN 1 THEN 'annotate_episode,annotate_episode' ELSE 'silence_channel, ,raise_ticket' END AS text, n_regionkey AS r, n_nationkey AS k FROM nation)
  SELECT title, CASE r WHEN 0 THEN 'describe_channel,raise_ticket' WHEN 1 THEN 'annotate_episode' ELSE 'raise_ticket,silence_channel' END AS licences, CAST(length(text) + length('About ' || title || '.') + 2 AS INTEGER) AS chars FROM n WHERE k % 7 <> 3""")
def runbook_passages(spark, sf):
    n = spark.read.parquet(f"{sf}/nation.parquet")
    licences = F.expr("CASE n_regionkey WHEN 0 THEN 'raise_ticket, describe_channel' WHEN 1 THEN 'annotate_episode,annotate_episode' ELSE 'silence_channel, ,raise_ticket' END")
    body = F.when(F.col("n_nationkey") % 7 == 3, F.lit("\n \n")).otherwise(F.concat(F.lit("\nAbout "), "n_name", F.lit(".\n\nlicensed-actions: "), licences, F.lit("\n")))
    path = folder(spark, "runbooks")
    n.select(F.concat(F.lit("## "), "n_name", F.lit("\n"), body).alias("value")).write.text(path)
    return documents.load_runbooks(spark, path).select("title", F.array_join("licences", ",").alias("licences"), F.length("text").alias("chars"))


def _noise(t: str) -> str:
    u = "+".join(f"CAST('0x' || substr(md5(channel || ':' || ({t})), {1 + 8 * k}, 8) AS BIGINT) / 4294967296.0::DOUBLE" for k in range(4))
    return f"(({u}) - 2.0::DOUBLE) * sqrt(3.0::DOUBLE)"


def _part(k: int) -> str:
    return f"CAST('0x' || substr(md5(channel || '#{k}'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE"


@query(f"""WITH m AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{n}', {b}::DOUBLE, {a}::DOUBLE, {s}::DOUBLE)" for i, (n, b, a, s) in enumerate(synthetic.METRICS))}) v(i, metric, b, a, s)),
  c AS (SELECT r.c, 'pump-' || lpad(CAST(r.c // 4 AS VARCHAR), 2, '0') || '.' || metric AS channel, b, a, s FROM range(8) r(c) JOIN m ON m.i = r.c % 4),
  f AS (SELECT c, channel, b * (0.92 + 0.16 * {_part(0)}) AS b, a * (0.8 + 0.4 * {_part(1)}) AS a, s * (0.85 + 0.3 * {_part(2)}) AS s FROM c),
  x AS (SELECT f.*, t, k FROM f, range(120) r(t), range({synthetic.STEPS}) q(k)),
  e AS (SELECT c, channel, b, a, s, t, sum(pow({synthetic.PHI}, k) * {_noise('t - k')}) * sqrt(1 - {synthetic.PHI} * {synthetic.PHI}) AS e FROM x GROUP BY ALL)
  SELECT channel, t + 1 AS seq, t * 1000 AS event_ts_ms, round(b + a * sin(2 * pi() * t / 300) + s * e * CASE WHEN c = 2 AND t BETWEEN 60 AND 80 THEN 4 ELSE 1 END + CASE WHEN c = 0 AND t = 30 THEN 8 * s WHEN c = 1 AND t BETWEEN 40 AND 70 THEN -5 * s ELSE 0 END + 1e-9, 6) AS value,
    CASE WHEN c = 0 AND t = 30 THEN 'spike' WHEN c = 1 AND t BETWEEN 40 AND 70 THEN 'level_shift' WHEN c = 2 AND t BETWEEN 60 AND 80 THEN 'variance_burst' END AS injected FROM e""")
def synthetic_fleet(spark, sf):
    planned = [("pump-00.vibration_mm_s", "spike", "fault", 29_500, 29_500, 8.0, "a", "channel"), ("pump-00.bearing_temp_c", "level_shift", "fault", 40_000, 70_000, -5.0, "b", "channel"), ("pump-00.discharge_pressure_bar", "variance_burst", "deploy", 60_000, 80_000, 4.0, "c", "ring")]
    s = synthetic.simulate(spark, 8, 120, faults=spark.createDataFrame(planned, synthetic.FAULT))
    return s.select("channel", "seq", "event_ts_ms", F.round(F.col("value") + 1e-9, 6).alias("value"), "injected")


@query()
def scenario_plan(spark, sf):
    t = src.topology(synthetic.fleet(spark, 24).select("channel"))
    d, a, f = synthetic.scenario(spark, [tuple(r) for r in t.select("channel", "node", "rack", "ring").orderBy("channel").collect()], 3600.0)
    c = evaluate.covering(f, d)
    return c.groupBy("incident", "domain").agg(F.count("*").alias("channels"), F.min("t_start_ms").alias("t_start_ms"), F.min("window_id").alias("window_id"))


@query("SELECT 'pump-' || lpad(CAST(c // 4 AS VARCHAR), 2, '0') || '.' || ['vibration_mm_s', 'bearing_temp_c', 'discharge_pressure_bar', 'flow_m3_h'][c % 4 + 1] AS channel, 30 AS readings, 30 AS last_seq FROM range(8) r(c)")
def fleet_source(spark, sf):
    spark.dataSource.register(synthetic.FleetDataSource)
    r = spark.read.format("tidelens_fleet").option("channels", "8").option("steps", "30").load()
    return r.groupBy("channel").agg(F.count("*").alias("readings"), F.max("seq").alias("last_seq"))


@query(f"WITH {M1}, x AS (SELECT arrival FROM m1 UNION ALL SELECT arrival FROM m1 WHERE arrival >= 500), y AS (SELECT DISTINCT channel, seq, event_ts_ms FROM m1) SELECT (SELECT count(*) FROM x) AS rows, (SELECT count(*) FROM y) AS distinct_rows, (SELECT count(*) FROM x) - (SELECT count(*) FROM y) AS duplicate_rows")
def replayed(spark, sf):
    return rollup.duplicates(faults.replay(src.readings(spark, sf), 500))


@query(f"WITH {M3} SELECT channel, count(*) AS records, count(DISTINCT seq) AS distinct_seq, CAST(sum(seq) AS BIGINT) AS total FROM m3 GROUP BY channel")
def topic_roundtrip(spark, sf):
    path = folder(spark, "topic")
    r = src.faulty_readings(spark, sf).select("channel", "seq", F.col("event_ts_ms").alias("ts"), "value", "arrival")
    topics.publish(r.where("arrival < 50000"), path, "channel", "arrival")
    topics.publish(r.where("arrival >= 50000"), path, "channel", "arrival")
    got = topics.subscribe(spark, path)
    dense = got.groupBy("partition").agg(F.count("*").alias("n"), F.max("offset").alias("top"), F.count_distinct("offset").alias("d")).where("n != top + 1 OR n != d")
    d = src.decode(got.select("value"), "value").join(dense.agg(F.count("*").alias("bad"))).where("bad = 0 AND ok")
    return d.groupBy("channel").agg(F.count("*").alias("records"), F.count_distinct("seq").alias("distinct_seq"), F.sum("seq").alias("total"))


_LOG = f"{M3}, p AS (SELECT CAST(substr(source, 2) AS INTEGER) AS partition, count(*) AS n, count(*) FILTER (WHERE arrival < 60000) AS read FROM m3 GROUP BY 1)"


@query(f"WITH {_LOG} SELECT 0 AS low_watermark, CAST(sum(n) AS BIGINT) AS log_end, CAST(sum(read) AS BIGINT) AS consumed, CAST(sum(n) AS BIGINT) AS available, CAST(sum(n) - sum(read) AS BIGINT) AS drift FROM p")
def offset_audit(spark, sf):
    r = src.faulty_readings(spark, sf)
    log = r.groupBy("source").agg(F.lit(0).cast("bigint").alias("low"), F.count("*").alias("high"))
    return evaluate.offset_audit(log, r.where("arrival < 60000"))


@query(f"WITH {_LOG} SELECT 'detector' AS group, CAST(sum(n - read) AS BIGINT) AS lag FROM p")
def consumer_lag(spark, sf):
    r = src.faulty_readings(spark, sf).withColumn("partition", F.expr("cast(substring(source, 2) AS int)"))
    ends = r.groupBy("partition").agg(F.count("*").alias("high"))
    at = r.groupBy("partition").agg(F.count_if(F.col("arrival") < 60000).alias("position")).withColumn("group", F.lit("detector"))
    return topics.lag(ends, at)


_OLD = f"{oracle.E2}, n AS (SELECT *, row_number() OVER (ORDER BY channel, t_start_ms) AS i FROM e)"


@query(f"""WITH {_OLD} SELECT channel, t_start_ms, CASE WHEN i % 3 = 0 THEN t_end_ms ELSE t_end_ms + 1000 END AS t_end_ms, round(CASE WHEN i % 3 = 0 THEN peak_score ELSE greatest(peak_score, peak_score + (i % 2) - 0.5) END + 1e-9, 6) AS peak_score, round(CASE WHEN i % 3 = 0 THEN mean_score ELSE mean_score / 2 END + 1e-9, 6) AS mean_score,
  CASE WHEN i % 3 = 0 THEN window_count ELSE greatest(window_count, 2) END AS window_count, CASE WHEN i % 3 = 0 THEN 'real' ELSE 'attributed' END AS status, CASE WHEN i % 3 <> 0 AND i % 2 = 0 THEN 'deploy-01' ELSE 'deploy-00' END AS attributed_to, CASE WHEN i % 3 <> 0 THEN 'corroborated' END AS verdict, CASE WHEN i % 3 <> 0 THEN 'later' ELSE 'first' END AS explanation, onset_ms FROM n""")
def episode_upsert(spark, sf):
    from pyspark.sql import Window

    e = base.episodes_once(spark, sf).withColumn("i", F.row_number().over(Window.orderBy("channel", "t_start_ms")))
    old = e.withColumns({"status": F.lit("real"), "attributed_to": F.lit("deploy-00"), "verdict": F.lit(None).cast("string"), "explanation": F.lit("first")})
    new = old.where("i % 3 != 0").withColumns({
        "t_end_ms": F.col("t_end_ms") + 1000, "peak_score": F.col("peak_score") + F.col("i") % 2 - 0.5, "mean_score": F.col("mean_score") / 2, "window_count": F.lit(2).cast("bigint"), "status": F.lit("attributed"),
        "attributed_to": F.when(F.col("i") % 2 == 0, "deploy-01"), "verdict": F.lit("corroborated"), "explanation": F.lit(None).cast("string"), "onset_ms": F.col("onset_ms") + 5,
    })
    up = store.upsert_episodes(old, new)
    up = store.attach_explanations(up, new.select(*store.EPISODE, F.lit("later").alias("text")))
    return up.select("channel", "t_start_ms", "t_end_ms", *base.r6("peak_score", "mean_score"), "window_count", "status", "attributed_to", "verdict", "explanation", "onset_ms")


@query(f"""WITH {oracle.S1}, old AS (SELECT channel AS episode_id, 'zscore' AS detector, start_ms AS window_start_ms, end_ms AS window_end_ms, score, n FROM s) SELECT episode_id, count(*) AS scores, round(sum(CASE WHEN n % 2 = 0 THEN score + 1 ELSE score END) + 1e-9, 5) AS total, CAST(sum(CASE WHEN n % 2 = 0 THEN 7 ELSE 3 END) AS BIGINT) AS latency FROM old GROUP BY episode_id""")
def score_upsert(spark, sf):
    s = base.scored(spark, sf).select(F.col("channel").alias("episode_id"), F.lit("zscore").alias("detector"), F.col("start_ms").alias("window_start_ms"), F.col("end_ms").alias("window_end_ms"), "score", "n", F.lit(3).alias("latency_ms"))
    up = store.upsert_scores(s, s.where("n % 2 = 0").withColumn("score", F.col("score") + 1).withColumn("latency_ms", F.lit(7)))
    return up.groupBy("episode_id").agg(F.count("*").alias("scores"), F.round(F.sum("score") + 1e-9, 5).alias("total"), F.sum("latency_ms").alias("latency"))


@query(f"WITH {oracle.DEPLOYS} SELECT event_id, CASE WHEN d < 20 THEN 'info' ELSE 'critical' END AS severity, CASE WHEN d < 20 THEN c0 ELSE c0 + 1 END AS t_start_ms FROM dep")
def context_insert(spark, sf):
    d = src.deploys(spark)
    again = d.where("ord >= 10").withColumn("severity", F.lit("critical")).withColumn("t_start_ms", F.col("t_start_ms") + 1)
    return store.insert_context(d.where("ord < 20"), again).select("event_id", "severity", "t_start_ms")


@query(f"WITH {oracle.HEALTH} SELECT window_start_ms, CASE WHEN window_start_ms // {DAY} % 2 = 0 THEN readings + 1 ELSE readings END AS readings, CASE WHEN window_start_ms // {DAY} % 2 = 0 THEN greatest(max_lag_ms, 45000) ELSE max_lag_ms END AS max_lag_ms, CASE WHEN window_start_ms // {DAY} % 2 = 0 THEN 'warning' ELSE severity END AS severity FROM health")
def health_upsert(spark, sf):
    h = written(base.daily_health(spark, sf), "health")
    new = h.where(f"window_start_ms / {src.DAY} % 2 = 0").withColumn("readings", F.col("readings") + 1).withColumn("max_lag_ms", F.lit(45_000).cast("bigint")).withColumn("severity", F.lit("warning"))
    return store.upsert_health(h, new).select("window_start_ms", "readings", "max_lag_ms", "severity")


@query(f"WITH {M1} SELECT strftime(make_timestamp(event_ts_ms * 1000), '%Y-%m-%d') AS event_day, count(*) AS rows, count(*) FILTER (WHERE injected IS NULL) AS plain FROM m1 WHERE event_ts_ms >= {FIRST + 3 * DAY} AND event_ts_ms < {FIRST + 9 * DAY} GROUP BY 1")
def day_partitions(spark, sf):
    path = folder(spark, "days")
    store.write_days(store.blanked(src.readings(spark, sf), "injected"), path)
    d = spark.read.option("basePath", path).schema("channel string, event_ts_ms bigint, injected string, event_day string").parquet(path)
    return d.where("event_day >= '2024-01-04' AND event_day < '2024-01-10'").groupBy("event_day").agg(F.count("*").alias("rows"), F.count_if(F.col("injected") == "").alias("plain"))


@query(f"WITH {M3} SELECT source, max(arrival) + 1 AS next, count(*) AS rows, 3 AS snapshots FROM m3 GROUP BY source")
def lake_append(spark, sf):
    path, r = folder(spark, "lake"), src.faulty_readings(spark, sf)
    top = r.agg(F.max("arrival")).first()[0] or 0
    store.append(r.where(F.col("arrival") * 3 < top), path, 0)
    store.append(r.where((F.col("arrival") * 3 >= top) & (F.col("arrival") * 3 < 2 * top)), path, 1)
    store.append(r.where("false"), path, 9)
    store.append(store.resume(r, store.committed_offsets(spark, path)), path, 2)  # all rows are offered again
    store.append(store.resume(r, store.committed_offsets(spark, path)), path, 3)  # and once more
    n = store.snapshots(spark, path)
    return store.scan(spark, path).groupBy("source").agg(F.count("*").alias("rows")).join(store.committed_offsets(spark, path), "source").withColumn("snapshots", F.lit(n))


@query(f"""WITH {M3}, x AS (SELECT DISTINCT channel, seq, event_ts_ms FROM m3), y AS (SELECT channel, count(*) AS readings, max(seq) - min(seq) + 1 - count(DISTINCT seq) AS drift, count(*) - count(DISTINCT seq) AS reused FROM x GROUP BY channel)
  SELECT (SELECT count(*) FROM m3) AS rows, CAST(sum(readings) AS BIGINT) AS readings, count(*) AS channels, CAST(sum(drift) AS BIGINT) AS sequence_gaps, CAST((SELECT count(*) FROM m3) - sum(readings) AS BIGINT) AS duplicate_rows, CAST(sum(reused) AS BIGINT) AS reused_seq, 2 AS snapshots, sum(drift) = 0 AND (SELECT count(*) FROM m3) = sum(readings) AS clean FROM y""")
def lake_audit(spark, sf):
    path, r = folder(spark, "lake"), src.faulty_readings(spark, sf)
    for i, part in enumerate(("arrival % 2 = 0", "arrival % 2 = 1")):
        store.append(r.where(part), path, i)
    return evaluate.lake_audit(store.scan(spark, path), store.snapshots(spark, path))


@query(f"WITH {oracle.CHANNELS} SELECT kind, CAST(sum(readings) AS BIGINT) AS readings, CAST(sum(drift) AS BIGINT) AS drift FROM drift, (VALUES ('csv'), ('json')) k(kind) GROUP BY kind")
def report_files(spark, sf):
    report, out = base.drift_report(spark, sf), []
    for kind in ("json", "csv"):
        path = folder(spark, f"report-{kind}")
        store.write_report(report, path, kind)
        back = spark.read.schema(report.schema)
        out.append((back.json(path) if kind == "json" else back.option("header", True).csv(path)).select(F.lit(kind).alias("kind"), "readings", "drift"))
    return out[0].unionByName(out[1])


@query(f"""WITH {oracle.DECIDED}, bad AS (SELECT *, row_number() OVER (ORDER BY channel, t_start_ms) AS i FROM dec), st AS (SELECT count(*) FILTER (WHERE i % 4 = 0) AS a, count(*) FILTER (WHERE i % 5 = 0) AS b FROM bad), m AS (SELECT count(*) - count(DISTINCT (channel, seq, event_ts_ms)) AS twice FROM m3)
  SELECT 'episodes' AS table, 'status' AS constraint, a AS violations FROM st UNION ALL SELECT 'episodes', 'span', b FROM st UNION ALL SELECT 'episodes', 'peak', 0 UNION ALL SELECT 'episodes', 'unique', 0
  UNION ALL SELECT 'readings', c, 0 FROM (VALUES ('channel'), ('seq'), ('time'), ('value')) v(c) UNION ALL SELECT 'readings', 'unique', twice FROM m""")
def constraint_violations(spark, sf):
    from pyspark.sql import Window

    e = base.decided(spark, sf).withColumn("i", F.row_number().over(Window.orderBy("channel", "t_start_ms")))
    e = e.withColumn("status", F.when(F.col("i") % 4 == 0, "odd").otherwise(F.col("status"))).withColumn("t_end_ms", F.when(F.col("i") % 5 == 0, F.col("t_start_ms") - 1).otherwise(F.col("t_end_ms")))
    return store.violations("episodes", e).unionByName(store.violations("readings", src.faulty_readings(spark, sf)))


@query(f"WITH {oracle.DECIDED} SELECT attributed_to, count(*) AS episodes FROM dec WHERE attributed_to IS NOT NULL AND attributed_to NOT LIKE 'deploy%' GROUP BY 1")
def dangling_attributions(spark, sf):
    return store.dangling(base.decided(spark, sf), src.deploys(spark)).groupBy("attributed_to").agg(F.count("*").alias("episodes"))
