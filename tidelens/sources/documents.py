"""Series in CSV, examples in JSON lines, scenario plans, fleet inventories and runbooks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelens.operators.chunks import running

EPISODES = "ARRAY<STRUCT<kind STRING, origin STRING, t_start_ms BIGINT, t_end_ms BIGINT, incident STRING, domain STRING>>"
PLAN = (
    f"faults MAP<STRING, {EPISODES}>, deploys ARRAY<STRUCT<event STRUCT<event_id STRING, t_start_ms BIGINT, t_end_ms BIGINT, scope ARRAY<STRING>, perturbed_telemetry BOOLEAN>, "
    f"artifacts MAP<STRING, {EPISODES}>>>"
)


def load_series(spark: SparkSession, path: str, max_points: int = 0, max_features: int = 0) -> DataFrame:
    """``t, feature, ord, value, label`` of a CSV with a header, numbers, and a last column ``Label``.

    ``t`` numbers the rows from 0. With ``max_points`` only the first rows count, with ``max_features`` only the columns with the largest
    standard deviations, in the file's order. A column that never changes is left out.
    """
    header = spark.read.option("header", True).csv(path).columns
    if header[-1] != "Label":
        raise ValueError(f"a series ends in a column Label, this one in {header[-1]}")
    names = header[:-1]
    rows = spark.read.option("header", True).schema(", ".join(f"`{c}` DOUBLE" for c in header)).csv(path).withColumn("__i", F.monotonically_increasing_id())
    rows = running(rows, "__i", {"t": ("sum", F.lit(1).cast("bigint"))}, chunk=1 << 33).drop("__i")
    rows = rows.where(F.col("t") < max_points) if max_points else rows
    long = rows.select("t", F.col("Label").cast("int").alias("label"), F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(i).alias("ord"), F.col(f"`{c}`").alias("value")) for i, c in enumerate(names)])).alias("f"))
    long = long.select("t", "f.*", "label")
    kept = long.groupBy("feature", "ord").agg(F.stddev_pop("value").alias("spread"), F.min("value").alias("low"), F.max("value").alias("high")).where("low < high")
    kept = kept.orderBy(F.col("spread").desc(), "ord").limit(max_features) if max_features else kept  # one row a column of the file
    return long.join(F.broadcast(kept.select("feature")), "feature").select("t", "feature", "ord", "value", "label")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The objects of a file of JSON lines; blank lines are none."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", schema).alias("r")).select("r.*")


def read_plan(plans: DataFrame, column: str = "plan") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Faults, artifacts and context windows of scenario plans in JSON, the windows with their order in the plan (``ord``).

    A fault without an incident is its own, ``channel@start``, in the domain ``channel``; an artifact without one belongs to its deploy, in the
    domain ``ring``.
    """
    p = plans.select(F.from_json(column, PLAN).alias("p"))
    one = ["e.kind", "e.origin", "e.t_start_ms", "e.t_end_ms"]

    def otherwise(name: str, default) -> F.Column:
        return F.when(F.coalesce(F.col(f"e.{name}"), F.lit("")) != "", F.col(f"e.{name}")).otherwise(default).alias(name)

    faults = p.select(F.explode("p.faults").alias("channel", "es")).select("channel", F.explode("es").alias("e"))
    faults = faults.select("channel", *one, otherwise("incident", F.concat("channel", F.lit("@"), F.col("e.t_start_ms").cast("string"))), otherwise("domain", F.lit("channel")))
    deploys = p.select(F.posexplode("p.deploys").alias("ord", "d"))
    artifacts = deploys.select("d.event.event_id", F.explode("d.artifacts").alias("channel", "es")).select("event_id", "channel", F.explode("es").alias("e"))
    artifacts = artifacts.select("channel", *one, otherwise("incident", F.col("event_id")), otherwise("domain", F.lit("ring")))
    none = F.array().cast("array<string>")
    windows = deploys.select("d.event.event_id", "d.event.t_start_ms", "d.event.t_end_ms", F.coalesce("d.event.scope", none).alias("scope"), F.coalesce("d.event.perturbed_telemetry", F.lit(False)).alias("perturbed"), F.col("ord").cast("bigint").alias("ord"))
    return faults, artifacts, windows


def read_inventory(inventories: DataFrame, column: str = "inventory") -> DataFrame:
    """``channel, node, rack, ring`` of a fleet inventory in JSON."""
    return inventories.select(F.explode(F.from_json(column, "placements ARRAY<STRUCT<channel STRING, node STRING, rack STRING, ring BIGINT>>")["placements"]).alias("p")).select("p.*")


def split_runbooks(books: DataFrame) -> DataFrame:
    """``runbook, ord, title, text, licences`` of markdown (``runbook``, ``markdown``): a passage for each second-level heading with a body.

    What comes before the first heading is none. Licences are the comma-separated names of the first line ``licensed-actions:``, sorted.
    """
    body = F.regexp_replace("markdown", "\r\n?", "\n")
    parts = books.select("runbook", F.posexplode(F.slice(F.split(F.concat(F.lit("\n"), body), "\n## "), 2, 1 << 30)).alias("ord", "part"))
    blank = r"^\s+|\s+$"
    p = parts.select("runbook", "ord", F.regexp_replace(F.substring_index("part", "\n", 1), blank, "").alias("title"), F.regexp_replace(F.expr("CASE WHEN contains(part, '\n') THEN substring(part, instr(part, '\n')) ELSE '' END"), blank, "").alias("text"))
    names = F.split(F.regexp_extract("text", r"(?im)^\s*licensed-actions:\s*(.+)$", 1), ",")
    licences = F.array_sort(F.array_distinct(F.filter(F.transform(names, lambda x: F.trim(x)), lambda x: x != "")))
    return p.where("text != ''").withColumn("licences", licences)


def load_runbooks(spark: SparkSession, path: str) -> DataFrame:
    """The passages of all markdown files below a path."""
    books = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return split_runbooks(books.select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1).alias("runbook"), F.col("value").alias("markdown")))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Rows with ``ord`` from 0, for tables as small as a plan."""
    return rows.withColumn("ord", F.row_number().over(Window.orderBy(*order)) - 1)
