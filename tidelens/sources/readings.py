"""Readings, context and ground truth as tables, and their wire formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelens.functions.expressions import epoch_ms
from tidelens.operators.chunks import CHUNK, running
from tidelens.sources import faults

DAY, HOUR = 86_400_000, 3_600_000
FIRST_DAY = 1_704_067_200_000  # 2024-01-01
DAYS = 30
INJECTED = "CASE WHEN event_id % 97 = 0 THEN 'spike' WHEN event_id % 89 = 0 THEN 'level_shift' END"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def assign_sequence(rows: DataFrame, key: str = "channel", order: str = "arrival", chunk: int = CHUNK) -> DataFrame:
    """A dense number from 1 for each row of a channel in order of arrival."""
    return running(rows, order, {"seq": ("sum", F.lit(1).cast("bigint"))}, (key,), chunk, current=True)


def readings(spark: SparkSession, sf_dir: str, by_node: bool = False, numbered: bool = True) -> DataFrame:
    """Events as readings, a channel per event type, or per node and event type: ``channel, seq, arrival, event_ts_ms, value, source, injected``.

    What needs no ``seq`` asks for rows that are not ``numbered`` and spares the pass that counts them.
    """
    channel = F.concat(F.lit("pump-"), F.lpad((F.col("user_id") % 12).cast("string"), 2, "0"), F.lit("."), F.col("event_type")) if by_node else F.col("event_type")
    rows = events(spark, sf_dir).select(
        channel.alias("channel"),
        F.col("event_id").alias("arrival"),
        epoch_ms("ts").alias("event_ts_ms"),
        "value",
        F.concat(F.lit("p"), (F.col("event_id") % 6).cast("string")).alias("source"),
        F.expr(INJECTED).alias("injected"),
    )
    if not numbered:
        return rows
    return assign_sequence(rows).select("channel", "seq", "arrival", "event_ts_ms", "value", "source", "injected")


def faulty_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings with losses, repeats and delays put in after numbering, and the wall clock of their ingestion."""
    r = faults.drop(readings(spark, sf_dir).withColumn("id", F.col("arrival")), F.col("id") % 101 == 50)
    r = r.withColumn("ingest_wall_ms", F.expr("event_ts_ms + (id % 7) * 10000")).withColumn("arrival", F.col("id") * 10)
    again = r.where("id % 53 = 7").withColumn("arrival", F.col("arrival") + 5)
    return faults.delay(r, F.col("id") % 37 == 11, 405).unionByName(again).drop("id")


def decode(wire: DataFrame, column: str = "wire") -> DataFrame:
    """JSON readings to typed columns, with ``ok`` false where a required field is missing or no number.

    Fields are read as text and cast, so that numbers in quotes count; a bad document is marked, never an error.
    """
    fields = "channel STRING, seq STRING, ts STRING, value STRING, injected STRING, origin STRING"
    d = wire.withColumn("r", F.from_json(column, fields))
    d = d.withColumns({
        "channel": F.col("r.channel"),
        "seq": F.expr("try_cast(try_cast(r.seq AS DOUBLE) AS BIGINT)"),
        "event_ts_ms": F.expr("try_cast(try_cast(r.ts AS DOUBLE) AS BIGINT)"),
        "value": F.expr("try_cast(r.value AS DOUBLE)"),
        "injected": F.col("r.injected"),
    })
    return d.withColumn("ok", F.expr("channel IS NOT NULL AND seq IS NOT NULL AND event_ts_ms IS NOT NULL AND value IS NOT NULL")).drop("r", column)


def encode(rows: DataFrame) -> DataFrame:
    """Readings as JSON with ``ts`` for the event time; null fields are left out."""
    return rows.select(F.to_json(F.struct("channel", "seq", F.col("event_ts_ms").alias("ts"), "value", "injected")).alias("wire"))


def wire_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON lines of which some lack a field, break off or quote their numbers."""
    body = """concat('{"channel":"', event_type, '","seq":', CASE WHEN event_id % 7 = 0 THEN concat('"', event_id, '"') ELSE string(event_id) END,
      ',"ts":', string(event_id * 1000), CASE WHEN event_id % 50 = 0 THEN '' ELSE concat(',"value":', string(user_id), '.5') END, '}')"""
    wire = f"CASE WHEN event_id % 51 = 0 THEN substring({body}, 1, 20) ELSE {body} END"
    return events(spark, sf_dir).select(F.col("event_id").alias("arrival"), F.expr(wire).alias("wire"))


def fan_out(rows: DataFrame, entity: str, key: str, metrics: dict[str, str]) -> DataFrame:
    """One row of many numbers to a reading a metric: ``channel`` (entity.metric), ``key`` and ``value``; nulls give none."""
    one = F.array(*[F.struct(F.lit(name).alias("metric"), F.expr(f"cast({e} as double)").alias("value")) for name, e in metrics.items()])
    out = rows.select(F.col(entity).cast("string").alias("entity"), key, F.explode(one).alias("m")).where("m.value IS NOT NULL")
    return out.select(F.concat("entity", F.lit("."), "m.metric").alias("channel"), key, F.col("m.value").alias("value"))


def topology(channels: DataFrame, nodes_per_rack: int = 3, rings: int | None = None) -> DataFrame:
    """``channel, node, rack, ring``: the node is what stands before the first dot; racks and rings follow the nodes' order."""
    nodes = channels.select(F.substring_index("channel", ".", 1).alias("node")).distinct()
    nodes = nodes.withColumn("i", F.dense_rank().over(Window.orderBy("node")) - 1)
    n = F.count("*").over(Window.partitionBy())
    ring_count = F.lit(rings) if rings else F.greatest(F.lit(1), F.floor(n / nodes_per_rack))
    nodes = nodes.withColumn("rack", F.format_string("rack-%02d", F.floor(F.col("i") / nodes_per_rack).cast("int")))
    nodes = nodes.withColumn("ring", (F.col("i") % ring_count).cast("bigint")).drop("i")
    return channels.select("channel", F.substring_index("channel", ".", 1).alias("node")).distinct().join(nodes, "node").select("channel", "node", "rack", "ring")


KINDS = ("click", "error", "purchase", "signup", "view")


def deploys(spark: SparkSession) -> DataFrame:
    """One deploy a day from 6 to 12 o'clock: three nodes' channels, every fifth fleet-wide (empty scope), every seventh one channel."""
    kinds = "array('click','error','purchase','signup','view')"
    scope = f"""CASE WHEN d % 5 = 0 THEN cast(array() as array<string>)
      WHEN d % 7 = 0 THEN array(concat('pump-', lpad(string(d % 12), 2, '0'), '.click'))
      ELSE flatten(transform(array(d % 12, (d + 1) % 12, (d + 2) % 12), n -> transform({kinds}, k -> concat('pump-', lpad(string(n), 2, '0'), '.', k)))) END"""
    return spark.range(DAYS).select(
        F.expr("concat('deploy-', lpad(string(id), 2, '0'))").alias("event_id"),
        F.lit("deploy").alias("kind"),
        F.expr(f"{FIRST_DAY} + id * {DAY} + 6 * {HOUR}").alias("t_start_ms"),
        F.expr(f"{FIRST_DAY} + id * {DAY} + 12 * {HOUR}").alias("t_end_ms"),
        F.lit("info").alias("severity"),
        F.lit("").alias("detail"),
        F.expr(scope.replace("d ", "id ").replace("(d", "(id")).alias("scope"),
        F.col("id").alias("ord"),
    )


def truth(spark: SparkSession) -> DataFrame:
    """Ground truth: each day a fault on all channels of one node from 8 to 10 o'clock."""
    kinds = ",".join(f"'{k}'" for k in KINDS)
    return spark.range(DAYS).select(
        F.explode(F.expr(f"transform(array({kinds}), k -> concat('pump-', lpad(string((5 * id) % 12), 2, '0'), '.', k))")).alias("channel"),
        F.expr(f"{FIRST_DAY} + id * {DAY} + 8 * {HOUR}").alias("t_start_ms"),
        F.expr(f"{FIRST_DAY} + id * {DAY} + 10 * {HOUR}").alias("t_end_ms"),
        F.expr("concat('fault-', lpad(string(id), 2, '0'))").alias("incident"),
        F.lit("node").alias("domain"),
    )


def artifacts(spark: SparkSession) -> DataFrame:
    """Ground truth: on even days the first hour of the deploy disturbs the channels of its scope."""
    d = deploys(spark).where("ord % 2 = 0")
    return d.select(F.explode("scope").alias("channel"), "t_start_ms", F.expr(f"t_start_ms + {HOUR}").alias("t_end_ms"), "event_id")
